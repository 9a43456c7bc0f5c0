"""Near-duplicates by the Jaccard similarity of word-shingle sets, decided exactly.

A text is the set of its runs of ``size`` words (a shorter text: the one run of all
its words; a text without a word: the empty set). Equal sets are one node. Candidates
are found by SimHash, as operator 7 does: fingerprints of the same shingles that differ in at most
``BITS`` bits. That bound lies far above a similarity of 0.8 (there about 10 bits differ), so nodes
that agree in a band of ``ROWS`` minhashes are candidates too: a pair at similarity s
shares no band with probability (1 - s**ROWS) ** BANDS, 3e-6 at 0.8. Candidates'
components are groups, and inside a group every pair is compared, shingle by
shingle, except those that earlier links connect already. A group of over ``CHUNK`` sets is
dealt in pairs of chunks, so a task holds twice as many sets at most.

Defined cases: texts without a word are copies of each other; rows repeated under
one id are rows of their own, and so are rows of one id with different texts; rows
without an id are in no group; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .arrowtext import LOWER, STEP, mix64, narrow, span_hashes, text_chunks, words
from .shared import connected, kept, marked, marks

ROWS, BANDS, CHUNK = 5, 32, 1024
#: Blocks of a fingerprint and bits in which two may differ, as in operator 7.
BLOCKS, BITS = 6, 3
FACTORS = mix64(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of every row, sorted by row and hash, and where each row's begin (n + 1)."""
    n = len(offsets) - 1
    starts, ends, row = words(raw, offsets)
    if not len(row):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    word = span_hashes(LOWER[raw], starts, ends)
    total = np.zeros(len(word), np.uint64)
    for d in range(size):  # words behind the row's end count as 0
        here = np.zeros(len(word), np.uint64)
        there = max(0, len(row) - d)
        same = row[d:] == row[:there]
        here[:there][same] = word[d:][same]
        total = total * STEP + here
    count = np.bincount(row, minlength=n)
    within = np.arange(len(row)) - (np.cumsum(count) - count)[row]
    whole = (within + size <= count[row]) | (within == 0)
    hashes, row = mix64(total[whole]), row[whole]
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])]
    hashes, row = hashes[new], row[new]
    return hashes, np.searchsorted(row, np.arange(n + 1))


def set_names(hashes: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """A hash of every set."""
    sums = np.r_[np.uint64(0), np.cumsum(mix64(hashes ^ STEP))]
    return mix64(sums[cut[1:]] - sums[cut[:-1]] + np.diff(cut).astype(np.uint64) * STEP)


def band_keys(hashes: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """A hash of every band of every set that is not empty, a row each."""
    some = cut[:-1][np.diff(cut) > 0]
    keys = np.empty((len(some), BANDS), np.uint64)
    for b in range(BANDS if len(some) else 0):
        key = np.full(len(some), np.uint64(b))
        for f in FACTORS[b * ROWS : (b + 1) * ROWS]:
            key = mix64(key * STEP + np.minimum.reduceat(hashes * f, some))
        keys[:, b] = key
    return keys


def sketches(df: DataFrame, size: int) -> DataFrame:
    """doc_id, copy (a hash of the text), node (the set's name), keys and fp (the SimHash fingerprint) of every row of (doc_id, copy, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, offsets, raw, _ in text_chunks(batches):
            hashes, cut = shingle_sets(raw, offsets, size)
            keys = band_keys(hashes, cut)
            ends = np.r_[0, np.cumsum(np.where(np.diff(cut) > 0, BANDS, 0))]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel().view(np.int64)))
            whole, at = raw.tobytes(), offsets.tolist()
            fps = np.array([simhash.fingerprint(whole[a:b], size) for a, b in zip(at, at[1:], strict=False)], np.uint64)
            columns = [rows.column(0), rows.column(1), pa.array(set_names(hashes, cut).view(np.int64)), lists, pa.array(fps.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "copy", "node", "keys", "fp"])

    return df.select("doc_id", "copy", "text").mapInArrow(run, "doc_id long, copy long, node long, keys array<long>, fp long")


def fingerprint_edges(prints: DataFrame, blocks: int = BLOCKS, bits: int = BITS) -> DataFrame:
    """Edges (node, lo) whose components are those of all sets with fingerprints at most ``bits`` apart; texts without a word have none."""
    some = prints.where(F.size("keys") > 0).select("node", "fp").distinct()
    first = kept(some.groupBy("fp").agg(F.min("node").alias("lo")))
    links = simhash.links(first.select("fp"), blocks, bits)
    left, right = first.select(F.col("fp").alias("a"), F.col("lo").alias("node")), first.select(F.col("fp").alias("b"), "lo")
    return some.join(first, "fp").select("node", "lo").unionAll(links.join(left, "a").join(right, "b").select("node", "lo")).where("node <> lo")


def similar(sets: list[np.ndarray], least: float) -> tuple[list[int], list[int]]:
    """A spanning forest of the pairs whose Jaccard similarity is at least ``least``, as positions."""
    size = np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.r_[0, np.cumsum(size)]
    mark = np.zeros(int(flat.max()) + 1, bool)
    rest, left, right = np.ones(len(sets), bool), [], []
    for first in range(len(sets)):
        if not rest[first]:
            continue
        rest[first] = False
        todo = [first]
        while todo and rest.any():
            i = todo.pop()
            own = flat[starts[i] : starts[i + 1]]
            mark[own] = True
            both = np.add.reduceat(mark[flat], starts[:-1], dtype=np.int64)
            mark[own] = False
            new = np.flatnonzero(rest & (both >= least * (size + size[i] - both) - 1e-9)).tolist()
            rest[new] = False
            left += [i] * len(new)
            right += new
            todo += new
    return left, right


def verified(dealt: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) among the sets of each part; ``dealt`` has part, node and shingles, the rows of a part together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(part: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
            names = np.array(list(part), np.int64)
            a, b = similar(list(part.values()), least)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(names[a]), pa.array(names[b])], ["a", "b"])

        now, part = None, {}
        for batch in batches:
            for key, node, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if len(part) > 1:
                        yield from emit(part)
                    now, part = key, {}
                part[node] = np.frombuffer(shingles, np.uint64)
        if len(part) > 1:
            yield from emit(part)

    return dealt.mapInArrow(run, "a long, b long")


def parts(df: DataFrame, places: DataFrame, size: int) -> DataFrame:
    """part, node and shingles: each set of ``places`` (doc_id, node, label, chunk, chunks) in every pair of its group's chunks that has its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, offsets, raw, _ in text_chunks(batches):
            hashes, cut = shingle_sets(raw, offsets, size)
            node = set_names(hashes, cut).view(np.int64)
            keep = pa.array(node == np.asarray(rows.column(rows.schema.get_field_index("node"))))
            own = pa.array([hashes[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())
            columns = [rows.column(rows.schema.get_field_index(c)) for c in ("node", "label", "chunk", "chunks")]
            yield pa.RecordBatch.from_arrays([*columns, own], ["node", "label", "chunk", "chunks", "shingles"]).filter(keep)

    found = df.join(places, "doc_id").mapInArrow(run, "node long, label long, chunk long, chunks long, shingles binary")
    other = found.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    return other.select(F.struct("label", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j")).alias("p"), "node", "shingles").select(F.concat_ws(" ", "p.label", "p.i", "p.j").alias("part"), "node", "shingles")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8, chunk: int = CHUNK) -> DataFrame:
    """doc_id, copy and component_id (smallest id reachable by links) of every row that has an id.

    ``copy`` is xxhash64 of the text (null: 42), which tells rows of one id apart;
    ``component`` names the component, also where components share their smallest id.
    """
    texts = narrow(df, id_col, text_col).where("doc_id is not null").withColumn("copy", F.xxhash64("text"))
    prints = kept(sketches(texts, size))
    nodes = prints.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    placed = prints.select("node", F.explode("keys").alias("key")).distinct()
    company = placed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key", "lo")
    banded = placed.join(company, "key").select("node", "lo").where("node <> lo")
    groups = kept(connected(fingerprint_edges(prints).unionAll(banded).distinct()))
    sizes = groups.groupBy("label").agg(F.ceil(F.count("*") / chunk).alias("chunks"))
    places = groups.join(sizes, "label").join(nodes, "node").select("doc_id", "node", "label", F.pmod(F.xxhash64("node"), "chunks").alias("chunk"), "chunks")
    dealt = parts(texts, places, size).repartition("part").sortWithinPartitions("part")
    labels = connected(verified(dealt, least))
    named = kept(nodes.join(labels, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label")))
    component = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return prints.select("doc_id", "copy", "node").join(named.join(component, "label").select("node", "label", "component_id"), "node").select("doc_id", "copy", F.col("label").alias("component"), "component_id")


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component, with all its columns: of the smallest id, and there of the smallest text hash; rows without an id stay.

    Only rows that share a component with another row move, as far as a bitmap tells these.
    """
    found = kept(near_duplicates(df, id_col, text_col, **options))
    sizes = found.groupBy("component").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "copy")).alias("first")).where("n > 1")
    crowd = kept(found.join(sizes, "component").select("doc_id", "copy", (F.struct("doc_id", "copy") == F.col("first")).alias("stays")).distinct())
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("copy"))
    some, others = marked(rows, kept(marks(crowd, "doc_id")), "doc_id")
    one = some.groupBy("doc_id", "copy").agg(F.min_by("row", F.xxhash64("row")).alias("row"))  # combined in the map task
    met = one.join(crowd, ["doc_id", "copy"], "left")
    return met.where("stays is null or stays").select("row.*").unionAll(others.select("row.*"))
