"""Text quality by nearest-neighbour voting over latent-semantic vectors.

A text's terms are its words, lower-cased, and how it is written: the shape of
each word (runs of capitals, small letters, digits and each other byte), pairs of
neighbouring shapes, and words said again shortly after. Term counts become
TF-IDF over hashed terms, with document frequencies of all documents; a
randomised SVD of the labelled sample's matrix gives the latent space. The
labelled vectors, at most ``rows`` of them, are sent to all workers; every
document's cosines with all of them are computed exactly, in blocks, and the
``neighbours`` nearest vote with their labels, weighted by similarity and against
their label's share of the sample. Neighbours as near as the last of these vote too.

The fit is bounded: at most ``rows`` different labelled rows, the first by hash,
at most half of them of either label, and where there is room their copies. These and all scored texts are read whole;
only counts of terms reach the driver.

Defined cases: a null text is scored like an empty one, and texts without a word
get 0: nothing speaks for them; a text whose terms are all strange to the space
gets 0.5, as does every text with a word if there is no labelled row; with one
label only, that label; repeated rows give repeated results; a text of any length
is one block, and takes memory in proportion to its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import LOWER, mix64, narrow, small_batches, span_hashes, text_chunks, words
from .shared import sampled, sampled_texts

#: Hashed terms of writing, of which the last 32 tell repetition and length, and of words.
SHAPES, WORDS = 4096, 4096
TERMS = SHAPES + WORDS
#: Words said again within this many words make the terms of repetition.
NEAR = 8
#: Rows counted at once, and rows whose cosines are computed at once.
COUNTED, BLOCK = 128, 1024

#: A byte's class: capitals 1, other letters 2, digits 3, the rest themselves.
CLASSES = np.arange(256, dtype=np.uint8)
CLASSES[65:91] = 1
CLASSES[97:123] = CLASSES[128:] = 2
CLASSES[48:58] = 3


def term_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each hashed term occurs, per row."""
    n = len(offsets) - 1
    starts, ends, row = words(raw, offsets)
    out = np.zeros((n, TERMS), np.float32)
    if not len(starts):
        return out
    kind = CLASSES[raw]
    first = np.ones(len(raw), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[starts] = True
    at = np.r_[0, np.cumsum(first)]
    runs = kind[first]
    shape = span_hashes(runs, at[starts], at[ends])
    word = span_hashes(raw, starts, ends)
    inner = row[1:] == row[:-1]
    pair = mix64(shape[1:] * np.uint64(3) + shape[:-1] + np.uint64(1))[inner]
    again = np.zeros(len(word), np.int64)
    for d in range(NEAR, 0, -1):
        same = (word[d:] == word[:-d]) & (row[d:] == row[:-d])
        again[d:][same] = d
    said = again > 0
    long = np.minimum(ends - starts, 40) // 4
    terms = np.concatenate((shape >> np.uint64(53), (pair >> np.uint64(53)) + np.uint64(SHAPES // 2 - 32)))
    terms = np.minimum(terms.astype(np.int64), SHAPES - 33)
    special = np.concatenate((again[said], NEAR + 1 + long)) + SHAPES - 32
    lowered = span_hashes(LOWER[raw], starts, ends) >> np.uint64(52)
    flat = np.concatenate((np.concatenate((row, row[1:][inner])) * TERMS + terms, np.concatenate((row[said], row)) * TERMS + special, row * TERMS + SHAPES + lowered.astype(np.int64)))
    return np.bincount(flat, minlength=n * TERMS).astype(np.float32).reshape(n, TERMS)


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray  # (TERMS, dimensions)
    vectors: np.ndarray  # (labelled rows, dimensions), unit length
    labels: np.ndarray
    neighbours: int
    power: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors in the latent space; zero where there is no term."""
        x = weigh(counts) * self.idf
        v = x @ self.basis
        size = np.sqrt((v * v).sum(1, keepdims=True))
        return np.where(size > 1e-12, v / np.maximum(size, 1e-12), 0).astype(np.float32)

    def score(self, counts: np.ndarray) -> np.ndarray:
        v, words = self.embed(counts), counts.any(1)
        if not len(self.vectors):
            return np.where(words, 0.5, 0.0)
        share = self.labels.mean()
        if share in (0.0, 1.0):
            return np.where(words, share, 0.0)
        weight = np.where(self.labels == 1, 1 / share, 1 / (1 - share))
        k = min(self.neighbours, len(self.labels))
        out = np.empty(len(v))
        for i in range(0, len(v), BLOCK):
            cosine = v[i : i + BLOCK] @ self.vectors.T
            last = np.partition(cosine, len(self.labels) - k, axis=1)[:, len(self.labels) - k]
            row, near = np.nonzero(cosine >= np.maximum(last, 0)[:, None])  # ties with the last vote too
            vote = cosine[row, near].astype(np.float64) ** self.power * weight[near]
            total = np.bincount(row, vote, len(cosine))
            out[i : i + BLOCK] = np.where(total > 0, np.bincount(row, vote * self.labels[near], len(cosine)) / np.maximum(total, 1e-300), 0.5)
        return np.where(words, np.clip(out, 0, 1), 0.0)


def weigh(counts: np.ndarray) -> np.ndarray:
    """Square roots of the terms' shares of their text, words and writing apart, words at half weight (by cross-validation)."""
    out = np.sqrt(counts)
    for part in (slice(0, SHAPES), slice(SHAPES, TERMS)):
        out[:, part] /= np.sqrt(np.maximum(counts[:, part].sum(1, keepdims=True), 1))
    out[:, SHAPES:] /= 2
    return out


def randomised_svd(x: np.ndarray, k: int, rounds: int = 2, seed: int = 3) -> np.ndarray:
    """The k leading right singular vectors, by a randomised range finder with power iterations."""
    k = min(k, *x.shape)
    q = np.linalg.qr(x.T @ np.random.default_rng(seed).standard_normal((len(x), min(k + 8, *x.shape))).astype(np.float32))[0]
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ vt.T)[:, :k].astype(np.float32)


def counts_of(texts: list[str]) -> np.ndarray:
    raw = [t.encode() for t in texts]
    return term_counts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def fit(counts: np.ndarray, labels: list[int], idf: np.ndarray, dimensions: int = 48, neighbours: int = 25, power: float = 4.0) -> Model:
    """Learn the latent space of the labelled rows' term counts and keep their vectors."""
    if not len(counts):
        return Model(idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.int64), neighbours, power)
    basis = randomised_svd(weigh(counts) * idf, dimensions)
    model = Model(idf, basis, np.zeros((0, basis.shape[1]), np.float32), np.array(labels, np.int64), neighbours, power)
    model.vectors = model.embed(counts)
    return model


def blocks(offsets: np.ndarray, raw: np.ndarray) -> Iterator[np.ndarray]:
    """Term counts of at most COUNTED rows at a time."""
    for i in range(0, len(offsets) - 1, COUNTED):
        own = offsets[i : i + COUNTED + 1]
        yield term_counts(raw[own[0] : own[-1]], own - own[0])


def frequencies(documents: DataFrame, text_col: str = "text") -> np.ndarray:
    """IDF from the number of documents that have each term: all are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(TERMS, np.int64), 0
        for _, offsets, raw, _ in text_chunks(batches):
            for counts in blocks(offsets, raw):
                total += (counts > 0).sum(0)
                n += len(counts)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1]), pa.array(np.r_[total[some], n])], ["term", "n"])

    found = small_batches(documents).select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    there = {r["term"]: r["n"] for r in found}
    return np.log(1 + there.get(-1, 0) / (1 + np.array([there.get(i, 0) for i in range(TERMS)]))).astype(np.float32)


def with_copies(rows: list, most: int) -> list:
    """Each row once, then as many of their further copies as there is room for."""
    out, turn = rows[:most], 2
    while len(out) < most and (more := [r for r in rows if r["copies"] >= turn]):
        out += more[: most - len(out)]
        turn += 1
    return out


def train(documents: DataFrame, labels: DataFrame, learnable: Column, label_col: str = "quality", rows: int = 4000, **options) -> Model:
    """Fit on at most ``rows`` of the labelled documents where ``learnable`` holds; frequencies are of all documents."""
    known = labels.where(learnable).select("doc_id", F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1)).distinct()
    # as many ids of each label as rows may be learned are broadcast
    ids = sampled(known.withColumnRenamed("doc_id", "id"), "label", rows // 2, 2)
    texts = small_batches(documents).select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, offsets, raw, _ in text_chunks(batches):
            counts = np.concatenate(list(blocks(offsets, raw)))
            terms = [np.flatnonzero(c) for c in counts]
            packed = [pa.array([x.astype(kind).tobytes() for x in some], pa.binary()) for kind, some in (("<u2", terms), ("<f4", [c[t] for c, t in zip(counts, terms, strict=True)]))]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *packed], ["turn", "label", "copies", "terms", "counts"])

    sent = sampled_texts(texts, "label", rows // 2, 2).select("turn", "label", "copies", "text").mapInArrow(run, "turn long, label int, copies long, terms binary, counts binary")
    # at most ``rows`` rows
    once = sent.orderBy("turn", "label").collect()
    found = [r for label in (0, 1) for r in with_copies([r for r in once if r["label"] == label], rows // 2)]
    counts = np.zeros((len(found), TERMS), np.float32)
    for x, r in zip(counts, found, strict=True):
        x[np.frombuffer(r["terms"], "<u2")] = np.frombuffer(r["counts"], "<f4")
    return fit(counts, [r["label"] for r in found], frequencies(documents) if len(found) else np.ones(TERMS, np.float32), **options)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row, over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, offsets, raw, _ in text_chunks(batches):
            found = [model.score(counts) for counts in blocks(offsets, raw)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.concatenate(found))], ["doc_id", "score"])

    return narrow(df, id_col, text_col).mapInArrow(run, "doc_id long, score double")
