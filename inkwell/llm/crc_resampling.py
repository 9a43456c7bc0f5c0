"""Target-distribution importance resampling over hashed word runs.

A text is lower-cased (A-Z only) and cut into runs of letters and digits. Its features
are all runs of 1 to ``n`` consecutive words, joined by one space. They are never
built: one scan of the document keeps a ring of running zlib CRC states, one for each of
the last ``n`` starts, extends every state by a space and the next word, opens a new one
at that word, and emits each state modulo the number of buckets. Texts are scanned in
pieces cut at spaces, the ring goes on from piece to piece, so a long text costs memory
for its buckets only.

Buckets of all documents are written once to the shared folder and counted there, those of the
target texts beside them. A bucket's gain is the floor of 1000 times the logarithm of its
smoothed share of the target over that of the corpus; a document's weight is the
floored mean of the gains of its features. Adding Gumbel noise, seeded by the id,
to the weights and taking the highest sums draws documents without replacement in
proportion to the exponential of their weights. Ranks come from a range partition
of the sums, numbered partition by partition; no task sees all documents.

Defined cases: null texts and texts without a word have no features and weight 0. A
bucket that neither side holds has the gain of its smoothed zeros. Texts with fewer than
``least_words`` words, and rows without an id (they have no noise, so no score), are never
drawn. Repeated rows are rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import narrow, small_batches, string_parts
from .shared import kept

#: a-z, digits and bytes of characters beyond ASCII stay, A-Z become small, the rest are spaces.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20


def pieces(text: bytes) -> Iterator[bytes]:
    """The text with words in small letters and spaces between, in pieces that end where a word ends."""
    at = 0
    while at < len(text):
        now = text[at : at + PIECE].translate(WORD_BYTES)
        if at + PIECE < len(text) and (end := now.rfind(b" ") + 1):
            now = now[:end]
        elif at + PIECE < len(text):  # one word reaches over the piece
            rest = text[at + PIECE :].translate(WORD_BYTES)
            now += rest[: rest.find(b" ") + 1] if b" " in rest else rest
        at += len(now)
        yield now


def buckets_of(text: bytes, n: int, buckets: int) -> tuple[np.ndarray, int]:
    """The bucket of every feature, and the number of words."""
    out, ring, words = [], [], 0
    for piece in pieces(text):
        states: list[int] = []
        for word in piece.split():
            spaced = b" " + word
            ring = [crc32(spaced, state) for state in ring[: n - 1]]
            ring.insert(0, crc32(word))
            states += ring
            words += 1
        out.append(np.array(states, np.uint32) % np.uint32(buckets))
    return (np.concatenate(out) if out else np.zeros(0, np.uint32)).astype(np.int32), words


def hashed(texts: DataFrame, n: int, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_words and the buckets of all features of every row, kept in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                offsets, raw, _ = string_parts(part.column(1))
                found = [buckets_of(raw[a:b].tobytes(), n, buckets) for a, b in pairwise(offsets.tolist())]
                sizes = np.cumsum([0, *[len(f[0]) for f in found]])
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([f[0] for f in found]), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f[1] for f in found], pa.int64()), lists], ["doc_id", "n_words", "buckets"])

    return kept(narrow(texts, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, buckets array<int>"))


def counted(rows: DataFrame, buckets: int) -> np.ndarray:
    """How many features each bucket holds: summed in every map task, at most ``buckets`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(np.asarray(batch.column(0).flatten()), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in small_batches(rows).select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floors of 1000 ln of each bucket's share of the target over that of the corpus, one added to every bucket."""
    n, whole, aimed = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (whole + n) / ((s + 1.0) * (aimed + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int, seed: int) -> int:
    """1000 times a Gumbel variate of the id, floored."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(rows: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column(2).value_lengths()).astype(np.int64)
            total = np.r_[0, np.cumsum(gain[np.asarray(batch.column(2).flatten())])]
            ends = np.cumsum(sizes)
            weight = (total[ends] - total[ends - sizes]) // np.maximum(sizes, 1)
            score = [None if i is None else w + noise(i, seed) for i, w in zip(batch.column(0).to_pylist(), weight.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), pa.array(weight), pa.array(score, pa.int64())], ["doc_id", "n_words", "n_features", "weight", "score"])

    return small_batches(rows).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, drawn: int) -> DataFrame:
    """The rows with their rank by score, then id, as far as ``drawn``; null beyond.

    Rows are dealt in ranges of that order and written with their place in their range;
    the ranges' counts, one for each task, give the rank of a range's first row.
    """
    # rows of equal score and id are dealt apart too: their scan's number settles the order
    numbered = kept(rows.withColumn("turn", F.monotonically_increasing_id()))
    order = [F.desc("score"), F.asc("doc_id"), F.asc("turn")]
    placed = kept(numbered.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("place", 33))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()
    first = np.cumsum([0, *[r["n"] for r in sizes]]).tolist()
    starts = rows.sparkSession.createDataFrame([(r["part"], f) for r, f in zip(sizes, first, strict=False)], "part long, before long")
    # a row for each task is broadcast
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    return placed.join(F.broadcast(starts), "part").select(*rows.columns, F.when(rank <= drawn, rank).alias("rank"))


def resample(
    documents: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024,
    id_col: str = "doc_id", text_col: str = "text", target_id_col: str = "item_id",
) -> DataFrame:
    """doc_id, n_features, weight, score, rank and n_words of every document; the drawn ``percent`` of those with enough words have a rank."""
    rows = hashed(documents, n, buckets, id_col, text_col)
    gain = gains(counted(rows, buckets), counted(hashed(target, n, buckets, target_id_col, text_col), buckets))
    scored = kept(weighted(rows, gain, seed))
    fit = F.coalesce((F.col("n_words") >= least_words) & F.col("score").isNotNull(), F.lit(False))
    names = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    able = scored.where(fit)
    drawn = able.count() * percent // 100
    return ranked(able, drawn).select(names).unionAll(scored.where(~fit).withColumn("rank", F.lit(None).cast("long")).select(names))
