"""ZIP archives split over tasks: members are listed from the central directory, entries read and extracted where they are dealt.

An archive with one unsafe member is rejected whole, before anything of it is
written; so is one that can't be read. Each entry is a row of its own, with its error if it has
one: a damaged entry takes no other down. Entries are dealt in runs of neighbours by size, so a large archive fills many tasks,
a small one is opened by few, and each task opens the archive at its own entries: only these bytes are read.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.shared import fresh_folder

from .files import unsafe_name
from .taskfiles import Opener, checked_target, open_store, write_pieces

MEMBERS = "archive string, member string, place int, size long, packed long, error string"
#: Bytes of entries that a task takes, and the largest entry that is read.
TASK_BYTES, MOST_BYTES, PIECE = 64 << 20, 1 << 30, 1 << 20
#: Runs of entries that a task takes on average, and the contents that leave it at once: bytes and rows.
RUNS, FRAME_BYTES, FRAME_ROWS = 4, 4 << 20, 1000


def opened_archive(address: str, opened: Opener) -> zipfile.ZipFile:
    store, path = opened(address)
    return zipfile.ZipFile(store.open_input_file(path))


def members(archives: DataFrame, path_col: str = "path", opened: Opener = open_store) -> DataFrame:
    """A row for each entry of the archives; a rejected archive is one row without a member, with the reason."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for address in batch["path"]:
                try:
                    with opened_archive(address, opened) as z:
                        found = [(address, i.filename, n, i.file_size, i.compress_size, None) for n, i in enumerate(z.infolist()) if not i.is_dir()]
                        unsafe = [i.filename for i in z.infolist() if unsafe_name(i.filename)]
                except (OSError, zipfile.BadZipFile, ValueError) as e:
                    found, unsafe = [(address, None, None, None, None, f"{type(e).__name__}: {e}")], []
                if unsafe:
                    found = [(address, None, None, None, None, f"unsafe member: {unsafe[0]}")]
                frame = pd.DataFrame(found, columns=["archive", "member", "place", "size", "packed", "error"])
                yield frame.astype({"place": "Int32", "size": "Int64", "packed": "Int64"})

    paths = archives.select(F.col(path_col).alias("path")).where("path is not null").distinct()
    return paths.mapInPandas(run, MEMBERS)


def dealt(listed: DataFrame) -> DataFrame:
    """Entries in as many parts as their bytes ask for, neighbours of an archive together and in order."""
    spark = listed.sparkSession
    # what makes the listing runs once; rows of the central directories move, no content
    path = fresh_folder(spark, "entries")
    listed.write.parquet(path)
    listed = spark.read.schema(listed.schema).parquet(path)
    total = listed.agg(F.sum("size")).first()[0] or 0
    before = F.sum(F.coalesce("size", F.lit(0))).over(Window.partitionBy("archive").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    runs = listed.withColumn("run_", F.floor(F.coalesce(before, F.lit(0)) / max(1, TASK_BYTES // RUNS)))
    return runs.repartition(max(1, -(-total // TASK_BYTES)), "archive", "run_").sortWithinPartitions("archive", "place").drop("run_")


def entries_of(batches: Iterator[pd.DataFrame], opened: Opener) -> Iterator[tuple[dict, zipfile.ZipFile | None]]:
    """Each row with its open archive; consecutive rows of an archive share it."""
    rows = (r for batch in batches for r in batch.to_dict("records"))
    for address, own in groupby(rows, key=lambda r: r["archive"]):
        known = list(own)
        if all(r["error"] is not None for r in known):
            yield from ((r, None) for r in known)
            continue
        with opened_archive(address, opened) as z:
            yield from ((r, z) for r in known)


def pieces_of(z: zipfile.ZipFile, place: int) -> Iterator[bytes]:
    """An entry's bytes, by its place: names may repeat."""
    with z.open(z.infolist()[place]) as f:
        while piece := f.read(PIECE):
            yield piece


def contents(listed: DataFrame, most: int = MOST_BYTES, opened: Opener = open_store) -> DataFrame:
    """archive, member, place, content and error of every entry."""

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["archive", "member", "place", "content", "error"]).astype({"place": "Int32"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        for r, z in entries_of(batches, opened):
            content, error = None, r["error"]
            if z is not None:
                try:
                    if r["size"] > most:
                        raise ValueError("the entry is too large")
                    content = b"".join(pieces_of(z, int(r["place"])))
                except (OSError, zipfile.BadZipFile, ValueError, NotImplementedError, RuntimeError) as e:
                    error = f"{type(e).__name__}: {e}"
            if out and size + len(content or b"") > FRAME_BYTES:
                yield frame(out)
                out, size = [], 0
            out.append((r["archive"], r["member"], r["place"], content, error))
            size += len(content or b"")
            if len(out) >= FRAME_ROWS:
                yield frame(out)
                out, size = [], 0
        if out:
            yield frame(out)

    return dealt(listed).mapInPandas(run, "archive string, member string, place int, content binary, error string")


def extract(listed: DataFrame, target: str, most: int = MOST_BYTES, opened: Opener = open_store) -> DataFrame:
    """Write every entry below ``target`` and its archive's name; archive, member, path, bytes and error of each."""
    target = checked_target(listed.sparkSession, target)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r, z in entries_of(batches, opened):
            path, size, error = None, None, r["error"]
            if z is not None:
                stem = r["archive"].rstrip("/").rpartition("/")[2].removesuffix(".zip")
                try:
                    path = f"{target}/{stem}/{r['member'].replace(chr(92), '/')}"
                    size = write_pieces(path, pieces_of(z, int(r["place"])), most, opened)
                except (OSError, zipfile.BadZipFile, ValueError, NotImplementedError, RuntimeError) as e:
                    path, error = None, f"{type(e).__name__}: {e}"
            yield pd.DataFrame([(r["archive"], r["member"], path, size, error)], columns=["archive", "member", "path", "bytes", "error"]).astype({"bytes": "Int64"})

    return dealt(listed).mapInPandas(run, "archive string, member string, path string, bytes long, error string")
