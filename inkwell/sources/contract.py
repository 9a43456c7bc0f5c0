"""The fields of the two sides, from a file that users may change."""

from __future__ import annotations

import json

from inkwell.functions import answers

DEFAULT = {"recto": answers.RECTO, "verso": answers.VERSO}


def fields(path: str | None = None) -> dict[str, tuple[str, ...]]:
    """The keys of each side from a JSON file {"recto": [{"key": ..., "type": ...}], "verso": [...]}; the default ones without a file.

    A file that can't be read, lacks a side or holds a field without a key is an error.
    """
    if path is None:
        return dict(DEFAULT)
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except FileNotFoundError:
        return dict(DEFAULT)
    except (OSError, ValueError) as e:
        raise ValueError(f"the field file {path} can't be read: {e}") from e
    out = {}
    for side in DEFAULT:
        items = found.get(side) if isinstance(found, dict) else None
        if not isinstance(items, list) or not all(isinstance(x, dict) and isinstance(x.get("key"), str) for x in items):
            raise ValueError(f"the field file {path} needs a list {side} of objects with a key")
        out[side] = tuple(x["key"] for x in items)
    return out
