"""Named numpy arrays in files of the shared folder, written whole and memory-mapped by workers."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

import numpy as np

ALIGN = 64


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """A header line with each array's place, then the arrays."""
    head, at = {}, 0
    for name, x in arrays.items():
        head[name] = [x.dtype.str, len(x), at]
        at += -(-x.nbytes // ALIGN) * ALIGN
    line = json.dumps(head).encode()
    line += b" " * (-(len(line) + 1) % ALIGN) + b"\n"
    return line + b"".join(x.tobytes() + b"\0" * (-x.nbytes % ALIGN) for x in arrays.values())


def is_local(path: str) -> str | None:
    """The plain path if any worker can open it as a file."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if ":/" in path else path


def save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Write under another name, then rename: a task that runs twice leaves one whole file."""
    data, own = pack(arrays), f"{name}.{uuid.uuid4().hex}.part"
    if local := is_local(folder):
        os.makedirs(local, exist_ok=True)
        with open(f"{local}/{own}", "wb") as f:
            f.write(data)
        os.replace(f"{local}/{own}", f"{local}/{name}")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{own}") as f:
        f.write(data)
    store.move(f"{path}/{own}", f"{path}/{name}")


def load(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays, mapped from the file; FileNotFoundError if there is no such file.

    A store that is no file system is read to a temporary file whose name is
    removed at once; the mapping holds it.
    """
    if local := is_local(folder):
        raw = np.memmap(f"{local}/{name}", np.uint8, "r")
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        if store.get_file_info(f"{path}/{name}").type == fs.FileType.NotFound:
            raise FileNotFoundError(f"{folder}/{name}")
        with tempfile.NamedTemporaryFile() as f:
            with store.open_input_stream(f"{path}/{name}") as source:
                while piece := source.read(1 << 24):
                    f.write(piece)
            f.flush()
            raw = np.memmap(f.name, np.uint8, "r")
    line = raw[: 1 << 16].tobytes().split(b"\n", 1)[0] + b"\n"
    out = {}
    for key, (kind, n, at) in json.loads(line).items():
        size = np.dtype(kind).itemsize * n
        out[key] = raw[len(line) + at : len(line) + at + size].view(kind)
    return out
