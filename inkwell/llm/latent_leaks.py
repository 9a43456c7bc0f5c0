"""Benchmark decontamination by latent semantic retrieval.

The benchmark's words are the terms. Their document frequencies are counted over
all documents; the benchmark's passages become TF-IDF rows, and a distributed
randomised SVD of that matrix gives the latent space: the tasks hold the rows and
send products with a thin matrix, which are summed. A space is made for at most
``SPACE`` items and has as many dimensions as items, so it loses nothing of them. A
document is cut into overlapping passages; each passage's cosine with every item of
the benchmark is computed, in blocks, and passages from ``cosine`` on are candidates.
So is every place where ``GRAM`` words of an item (all words of a shorter one) stand
in a row, by exact look-up. Around a candidate the longest common subsequence of words decides, taken over windows of
three times the item's words, so whatever lies within twice as many is found and words
scattered farther say nothing: a share of at least
``lcs`` of the item's words is a leak, and from ``answered_lcs`` on it is one if
the item's answer (its last sentence, or what follows its last question mark)
stands there word for word; an answer of under ``answer_words`` words is taken with
the words before it. Common words make any short item a subsequence of any text: an item
of under ``GRAM`` words is a leak only where it is a line of the text by itself.

Every place where candidates come together is decided by itself: one leak is enough.

The benchmark is taken in blocks of at most ``block_bytes`` of text, ``AT_ONCE`` of them in a pass over
the documents; what a task gets is these blocks' index, in proportion to their text (a space holds at most
``SPACE`` items and as many dimensions), whatever the size of benchmark and corpus.
The driver holds as many blocks and the benchmark's vocabulary; frequencies are counted
for all blocks at once. Documents are read whole.

A word is a run of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.
Defined cases: null and empty texts and items have no word and match nothing;
equal items are reported each; rows repeated under an id give their pairs
repeatedly; an empty benchmark or corpus gives no pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowtext import LOWER, STEP, mix64, narrow, numbered, span_hashes, text_chunks
from .shared import kept

IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Words of a block of a document, and blocks of a passage.
STRIDE, SPAN = 12, 4
#: Items of a latent space, which is also its greatest dimension, and words of a run that is looked up.
SPACE, GRAM = 256, 5
CHUNK = 1 << 20
#: Blocks of the benchmark that one pass over the documents looks for.
AT_ONCE = 4


def located_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first byte of every word."""
    lowered, solid = LOWER[raw], IN_WORD[raw]
    edge = np.ones(len(raw) + 1, bool)
    edge[1:-1] = solid[1:] != solid[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(solid & edge[:-1])
    ends = np.flatnonzero(solid & edge[1:]) + 1
    return span_hashes(lowered, starts, ends), np.searchsorted(offsets, starts, "right") - 1, starts


def hashed_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word."""
    return located_words(raw, offsets)[:2]


def words_of(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return hashed_words(raw, np.array([0, len(raw)]))[0]


def answer_of(text: str | None) -> np.ndarray:
    """The words of what follows the last question mark, or else of the last sentence."""
    t = (text or "").rstrip().rstrip(".!?")
    cut = t.rfind("?") if "?" in t else max(t.rfind(x) for x in (". ", ".\n", "! ", "!\n"))
    return words_of(t[cut + 1 :])


def common_subsequence(a: list[int], b: list[int]) -> int:
    """The length of the longest common subsequence, a word of b at a time on the bits of one number."""
    at: dict[int, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row = whole
    for w in b:
        hit = row & at.get(w, 0)
        row = (row + hit) | (row - hit)
    return len(a) - (row & whole).bit_count()


def contains(a: list[int], b: list[int]) -> bool:
    """Whether b stands in a without gaps."""
    return any(a[i : i + len(b)] == b for i, w in enumerate(a[: len(a) - len(b) + 1]) if w == b[0]) if b else False


def runs_of(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words."""
    total = np.full(max(0, len(words) - size + 1), np.uint64(size))
    for d in range(size):
        total = total * STEP + words[d : d + len(total)]
    return mix64(total)


@dataclass
class Space:
    """Some items of a block, in their latent space."""

    terms: np.ndarray  # sorted word hashes
    basis: np.ndarray  # (terms, dimensions), times idf
    vectors: np.ndarray  # (items, dimensions), unit length
    first: int  # the first item's place in its block

    def passages(self, hashes: np.ndarray, head: np.ndarray, size: np.ndarray, block_row: np.ndarray) -> np.ndarray:
        """The latent vector of every passage, of unit length: a block and the blocks behind it, in its row."""
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        term = np.where(self.terms[at] == hashes, at, len(self.terms))
        rows = np.concatenate((self.basis, np.zeros((1, self.basis.shape[1]), np.float32)))  # the last one is for words that are no terms
        sums = np.zeros((len(head), self.basis.shape[1]), np.float32)
        for j in range(STRIDE):  # word by word of all blocks
            at = np.minimum(head + j, len(term) - 1)
            own = np.flatnonzero((j < size) & (term[at] < len(self.terms)))
            sums[own] += rows[term[at[own]]]
        passage = sums.copy()
        for d in range(1, SPAN):
            passage[:-d] += sums[d:] * (block_row[d:] == block_row[:-d])[:, None]
        return passage / np.maximum(np.sqrt(np.einsum("ij,ij->i", passage, passage)), 1e-9)[:, None]


@dataclass
class Index:
    """A block of the benchmark: its latent spaces, and its runs of words."""

    spaces: list[Space]
    ids: list[int]
    words: list[list[int]]
    answers: list[list[int]]
    cosine: float = 0.5
    lcs: float = 0.6
    answered_lcs: float = 0.45
    answer_words: int = 5

    def __post_init__(self) -> None:
        self.answers = [w[-self.answer_words :] if 0 < len(a) < self.answer_words else a for w, a in zip(self.words, self.answers, strict=True)]
        #: Each item's different words, sorted, and how often the item has each of these.
        self.counts = [np.unique(np.array(w, np.uint64), return_counts=True) for w in self.words]
        #: By their number of words: the sorted hashes of the items' runs, each one's item, and its place there.
        self.runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted({min(GRAM, len(w)) for w in self.words} - {0}):
            own = [(i, runs_of(np.array(w, np.uint64), size)) for i, w in enumerate(self.words) if min(GRAM, len(w)) == size]
            runs = np.concatenate([x for _, x in own])
            order = np.argsort(runs, kind="stable")
            item, place = np.repeat([i for i, _ in own], [len(x) for _, x in own]), np.concatenate([np.arange(len(x)) for _, x in own])
            self.runs[size] = runs[order], item[order], place[order]

    def common_words(self, item: int, words: np.ndarray) -> float:
        """The share of the item's words that stand among the words in any order: no subsequence is longer."""
        own, count = self.counts[item]
        at = np.minimum(np.searchsorted(own, words), len(own) - 1)
        return np.minimum(np.bincount(at[own[at] == words], minlength=len(own)), count).sum() / len(self.words[item])

    def shared_runs(self, hashes: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(word, item, place) of every run of an item's words: where it starts in the text and in the item."""
        for size, (runs, items, places) in self.runs.items():
            found = runs_of(hashes, size)
            at = np.searchsorted(runs, found)
            hit = np.flatnonzero((runs[np.minimum(at, len(runs) - 1)] == found) & (row[: len(found)] == row[size - 1 :]))
            for w, lo, hi in zip(hit.tolist(), at[hit].tolist(), np.searchsorted(runs, found[hit], "right").tolist(), strict=True):
                for k in range(lo, hi):
                    yield w, int(items[k]), int(places[k])

    def leaks(self, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, float, float, bool]]:
        """(row, item, cosine, share of the item's words in order, answer found) of every leak."""
        hashes, row, starts = located_words(raw, offsets)
        if not len(hashes) or not self.spaces:
            return []
        line = np.cumsum(raw == 10)[starts]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        within = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
        head = np.flatnonzero(within % STRIDE == 0)  # where each block of words starts
        block_row = row[head]
        size = np.diff(np.r_[head, len(row)])
        runs: dict[int, list[tuple[int, int, int]]] = {}
        lines = set()
        for w, item, place in self.shared_runs(hashes, row):
            runs.setdefault(item // SPACE, []).append((w, item, place))
            end = w + len(self.words[item])
            starts_line = w == 0 or row[w - 1] != row[w] or line[w - 1] != line[w]
            if len(self.words[item]) < GRAM and starts_line and line[end - 1] == line[w] and (end == len(row) or row[end] != row[w] or line[end] != line[w]):
                lines.add((int(row[w]), item))
        near: dict[tuple[int, int], list[tuple[int, int, float]]] = {}  # from and to which word, cosine
        for space in self.spaces:
            passage = space.passages(hashes, head, size, block_row)
            for i in range(0, len(passage), 4096):
                c = passage[i : i + 4096] @ space.vectors.T
                for p, item in zip(*(x.tolist() for x in np.nonzero(c >= self.cosine)), strict=True):
                    margin = len(self.words[space.first + item]) // 2
                    at = int(head[i + p])
                    near.setdefault((int(block_row[i + p]), space.first + item), []).append((at - margin, at + STRIDE * SPAN + margin, float(c[p, item])))
            for w, item, place in runs.get(space.first // SPACE, ()):
                words, p = len(self.words[item]), int(np.searchsorted(head, w, "right")) - 1
                near.setdefault((int(row[w]), item), []).append((w - place - words // 2, w - place + words + words // 2, float(passage[p] @ space.vectors[item - space.first])))
        out = [(r, item, max(c for *_, c in near[r, item]), 1.0, False) for r, item in sorted(lines)]
        for (r, item), found in near.items():
            words, best = self.words[item], (False, 0.0, False)
            if len(words) < GRAM:
                continue
            a, b = int(np.searchsorted(row, r)), int(np.searchsorted(row, r, "right"))
            regions: list[list[int]] = []
            for lo, hi, _ in sorted(found):
                lo, hi = max(a, lo), min(b, hi)
                if regions and lo <= regions[-1][1] and max(hi, regions[-1][1]) - regions[-1][0] <= 4 * len(words) + 4 * STRIDE * SPAN:
                    regions[-1][1] = max(hi, regions[-1][1])
                else:
                    regions.append([lo, hi])
            for lo, hi in regions:
                if self.common_words(item, hashes[lo:hi]) < min(self.lcs, self.answered_lcs):
                    continue
                text, answer = hashes[lo:hi].tolist(), self.answers[item]
                for i in range(0, max(1, len(text) - 2 * len(words)), len(words)):
                    window = text[i : i + 3 * len(words)]
                    share = common_subsequence(words, window) / len(words)
                    answered = share >= self.answered_lcs and contains(window, answer)
                    best = max(best, (share >= self.lcs or answered, share, answered))
            if best[0]:
                out.append((r, item, max(c for *_, c in found), *best[1:]))
        return out


def thin_product(rows: DataFrame, terms: int, thin: np.ndarray) -> np.ndarray:
    """A' A thin for the matrix whose sparse rows are (places, weights): each task's sum in packed slices, then the sum of these."""
    width, slices = thin.shape[1], 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((terms, width))
        for batch in batches:
            for places, weights in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, w = np.array(places, np.int64), np.array(weights)
                total[at] += np.outer(w, w @ thin[at])
        for i in range(slices):
            at = np.flatnonzero(total[i::slices].any(1))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([at.astype("<i8").tobytes()], pa.binary()), pa.array([total[i::slices][at].tobytes()], pa.binary())], ["slice", "places", "packed"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, places, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = sums.setdefault(i, np.zeros((len(range(i, terms, slices)), width)))
                own[np.frombuffer(places, "<i8")] += np.frombuffer(packed).reshape(-1, width)
        for i, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([x.tobytes()], pa.binary())], ["slice", "packed"])

    each = rows.mapInArrow(run, "slice long, places binary, packed binary")
    out = np.zeros((terms, width))
    for r in each.repartition("slice").mapInArrow(add, "slice long, packed binary").collect():
        out[r["slice"] :: slices] = np.frombuffer(r["packed"]).reshape(-1, width)
    return out


def latent_space(rows: DataFrame, terms: int, items: int, dimensions: int, rounds: int = 2, seed: int = 5) -> np.ndarray:
    """The leading right singular vectors of the TF-IDF rows: randomised range finding with power iterations."""
    k = min(dimensions, terms, items)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, min(k + 8, terms))))[0]
    for _ in range(rounds):
        q = np.linalg.qr(thin_product(rows, terms, q))[0]
    values, turn = np.linalg.eigh(q.T @ thin_product(rows, terms, q))
    return q @ turn[:, np.argsort(-values)[:k]]


def document_frequencies(documents: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many documents each term occurs, and how many documents there are: all are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, n = np.zeros(len(terms), np.int64), 0
        for _, offsets, raw, _ in text_chunks(batches, CHUNK):
            hashes, row = hashed_words(raw, offsets)
            n += len(offsets) - 1
            at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
            hit = terms[at] == hashes
            count += np.bincount(np.unique(row[hit] * len(terms) + at[hit]) % len(terms), minlength=len(terms))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1]), pa.array(np.r_[count[some], n])], ["term", "n"])

    found = documents.select("doc_id", "text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    by_term = {r["term"]: r["n"] for r in found}
    return np.array([by_term.get(i, 0) for i in range(len(terms))]), by_term.get(-1, 0)


@dataclass
class Frequencies:
    """How many documents have each word of the benchmark."""

    terms: np.ndarray  # sorted word hashes
    there: np.ndarray
    documents: int

    def idf(self, words: np.ndarray) -> np.ndarray:
        return np.log(1 + self.documents / (1 + self.there[np.searchsorted(self.terms, words)]))


def frequencies(documents: DataFrame, items: DataFrame, at_once: int = 1 << 22) -> Frequencies:
    """Counted in one pass over the documents for each ``at_once`` different words of the whole benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, offsets, raw, _ in text_chunks(batches, CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(hashed_words(raw, offsets)[0]).view(np.int64))], ["word"])

    found = items.select("text").mapInArrow(run, "word long").distinct().toArrow().column("word").to_numpy()
    terms = np.sort(found.view(np.uint64))
    counted = [document_frequencies(documents, terms[i : i + at_once]) for i in range(0, len(terms), at_once)]
    return Frequencies(terms, np.concatenate([np.zeros(0, np.int64), *(x for x, _ in counted)]), max((n for _, n in counted), default=0))


def build(spark: SparkSession, items: list[tuple[int, str]], known: Frequencies, **options) -> Index:
    """The index of one block of the benchmark."""
    words = [words_of(t) for _, t in items]
    spaces = [space_of(spark, known, words[i : i + SPACE], i) for i in range(0, len(words), SPACE)]
    return Index([s for s in spaces if len(s.terms)], [i for i, _ in items], [w.tolist() for w in words], [answer_of(t).tolist() for _, t in items], **options)


def space_of(spark: SparkSession, known: Frequencies, words: list[np.ndarray], first: int) -> Space:
    """The latent space of a few items, of as many dimensions."""
    own = np.unique(np.concatenate(words))
    idf = known.idf(own)
    if not len(own):
        return Space(own, np.zeros((0, 1), np.float32), np.zeros((len(words), 1), np.float32), first)
    rows = []
    for w in words:
        at, count = np.unique(np.searchsorted(own, w), return_counts=True)
        x = count * idf[at]
        rows.append((at.tolist(), (x / max(np.sqrt((x * x).sum()), 1e-12)).tolist()))
    table = kept(spark.createDataFrame(rows, "places array<long>, weights array<double>"))
    space = latent_space(table, len(own), len(words), len(words))
    vectors = np.array([np.array(x) @ space[np.array(at, np.int64)] for at, x in rows])
    size = np.sqrt((vectors * vectors).sum(1, keepdims=True))
    vectors = np.where(size > 1e-9, vectors / np.maximum(size, 1e-9), 0)
    return Space(own, (space * idf[:, None]).astype(np.float32), vectors.astype(np.float32), first)


def indexes(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 1 << 20, **options) -> Iterator[Index]:
    """The benchmark's blocks, each of about ``block_bytes`` of text at most."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    texts = narrow(documents, id_col, text_col)
    known = frequencies(texts, items)
    for b in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        yield build(texts.sparkSession, [(r["item_id"], r["text"]) for r in some], known, **options)


def find(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row for each document and item that leaks into it: doc_id, item_id, cosine, lcs, answered."""
    found = None
    for together in batched(indexes(documents, benchmark, id_col, text_col, **options), AT_ONCE):

        def run(batches: Iterator[pa.RecordBatch], together: tuple[Index, ...] = together) -> Iterator[pa.RecordBatch]:
            for rows, offsets, raw, _ in text_chunks(batches, CHUNK):
                out = [(x[0], index.ids[x[1]], *x[2:]) for index in together for x in index.leaks(raw, offsets)]
                own = rows.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([own[r] for r, *_ in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.float64()), pa.array([x[3] for x in out], pa.float64()), pa.array([x[4] for x in out], pa.bool_())],
                    ["doc_id", "item_id", "cosine", "lcs", "answered"],
                )

        part = narrow(documents, id_col, text_col).mapInArrow(run, "doc_id long, item_id long, cosine double, lcs double, answered boolean")
        found = part if found is None else found.unionAll(part)
    return found


def clean(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``documents`` into which no item leaks, with all their columns."""
    rows = numbered(documents)
    out = rows
    place = documents.columns.index(text_col)
    for together in batched(indexes(documents, benchmark, id_col, text_col, **options), AT_ONCE):

        def run(batches: Iterator[pa.RecordBatch], together: tuple[Index, ...] = together) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                only = pa.RecordBatch.from_arrays([batch.column(place)], ["text"])
                at = 0
                for rows, offsets, raw, _ in text_chunks(iter([only]), CHUNK):
                    keep = np.ones(len(rows), bool)
                    keep[[r for index in together for r, *_ in index.leaks(raw, offsets)]] = False
                    yield batch.slice(at, len(rows)).filter(pa.array(keep))
                    at += len(rows)

        out = out.mapInArrow(run, rows.schema)
    return out.toDF(*documents.columns)
