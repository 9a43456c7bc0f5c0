"""Files that tasks read and write in any store pyarrow opens: staged under another name, moved when whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from urllib.parse import urlparse

from pyarrow import fs
from pyspark.sql import SparkSession

#: What opens an address: the store and the path in it.
Opener = Callable[[str], tuple[fs.FileSystem, str]]


def open_store(address: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(address)


def checked_target(spark: SparkSession, target: str) -> str:
    """The folder, if all tasks share it: any in a local session; else one of another store, or below a folder the cluster names as shared."""
    if spark.sparkContext.master.startswith("local") or urlparse(target).scheme not in ("", "file"):
        return target.rstrip("/")
    plain = lambda x: "/" + urlparse(x).path.strip("/") + "/"
    shared = [x for x in (spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.sql.warehouse.dir", None)) if x]
    if not any(plain(target).startswith(plain(x)) for x in shared):
        raise ValueError(f"{target} is a folder of one machine: executors don't share it")
    return target.rstrip("/")


def write_pieces(address: str, pieces: Iterable[bytes], most: int, opened: Opener = open_store) -> int:
    """Write a file piece by piece, move it to its name when it is whole, and return its size; beyond ``most`` bytes it is refused."""
    store, path = opened(address)
    folder, _, name = path.rpartition("/")
    store.create_dir(folder, recursive=True)
    staged, size = f"{folder}/.{name}.{uuid.uuid4().hex}.part", 0
    try:
        with store.open_output_stream(staged) as f:
            for piece in pieces:
                size += len(piece)
                if size > most:
                    raise ValueError("the document is too large")
                f.write(piece)
        store.move(staged, path)
    except BaseException:
        if store.get_file_info(staged).type != fs.FileType.NotFound:
            store.delete_file(staged)
        raise
    return size
