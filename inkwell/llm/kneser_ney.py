"""Interpolated modified Kneser-Ney scores from sorted arrays that workers map.

The model has order two over word hashes. It is counted in Spark in three passes
of packed blocks, each combined in the map task before it is dealt:

1. words: a word's id is the rank of its 64-bit hash, in files dealt by hash;
2. pairs of ids, dealt by their first word, or by the pair where the first word
   is one of the ``HOT`` most frequent ones: sorted 64-bit pair keys with counts,
   and each context's total and its numbers of pairs seen once, twice, more often;
3. how many different words each word follows (its continuation count).

The arrays are files in the shared folder, written whole by the tasks that reduce
a part. Scoring tasks map them, look up the distinct words and pairs of a chunk
in order by binary search, and sum log probabilities by document. No table of
words or pairs reaches the driver: only sums do, and the HOT contexts.

There are as many parts as ``PART_BYTES`` go into the texts; a task reduces one part
at a time. A file that a part should have and has not is an error, never "no such word".

Words are told apart by keys of 128 bits: a word of up to 15 bytes by its bytes and their
number, a longer one by a digest under a secret, drawn anew for each model, so no
texts can be made to share one. A key is held in two halves: one, scrambled with the secret, is the hash
that orders the files; the other is held beside it and compared wherever hashes
agree. Two words of the training texts with one hash (of a thousand million words by
chance in 3 of 100 models) are an error, never one word; train anew then.

Lower-cased A-Z; tokens are white-space words and one end for each text. Defined
cases: a null or empty text is one end token; words not in training get the
uniform share of the continuation distribution; after an unknown word, and for
contexts never seen, the continuation distribution alone; without training
tokens every token has probability one over one; repeated rows count repeatedly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrayfiles
from .arrowtext import DIGEST, FIRST_BYTES, LOWER, digests, distinct_spans, eights, mix64, secret, small_batches, span_hashes, text_chunks, words
from .shared import fresh_path, kept, parts_for

#: The end token, the id before a text's first word, the id of unknown words.
END = np.frombuffer(b" end", np.uint8)
#: Words of up to so many bytes are their own keys.
SHORT = 15
BEGIN, UNKNOWN = 0xFFFFFFFF, 0xFFFFFFFE
#: So many different words have ids of 32 bits besides these two; more are an error.
MOST_WORDS = 0xFFFFFFFE
#: Contexts whose pairs are dealt by pair, and pairs (or half as many words) gathered before a block is sent.
HOT, FLUSH = 1024, 3_000_000
#: Bytes of text whose words or pairs make a part.
PART_BYTES = 64 << 20
BLOCKS = "part int, packed binary"


def word_keys(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: bytes) -> np.ndarray:
    """Hash and check of each word: the same two for the same bytes, and together never for others."""
    lane, size = eights(raw), ends - starts
    low = lane[starts] & FIRST_BYTES[np.minimum(size, 8)]
    high = lane[np.minimum(starts + 8, len(raw))] & FIRST_BYTES[np.clip(size - 8, 0, 7)]
    high |= np.minimum(size, 255).astype(np.uint64) << np.uint64(56)
    if (long := np.flatnonzero(size > SHORT)).size:
        first, which = distinct_spans(raw, starts[long], ends[long], span_hashes(raw, starts[long], ends[long]))
        found = digests(raw, starts[long][first], ends[long][first], key)[which]
        low[long], high[long] = found["hash"], found["check"] | np.uint64(0xFF << 56)
    out = np.empty(len(starts), DIGEST)
    one, two = np.frombuffer(key, "<u8")
    # given the check, the hash says the other half
    out["check"], out["hash"] = low, mix64(high ^ mix64(mix64(low ^ one) + two))
    return out


def tokens_of(raw: np.ndarray, offsets: np.ndarray, key: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the different tokens in order of their hash, which of them each token is, and its row: the words of a row, then its end."""
    lowered = LOWER[raw]
    starts, ends, row = words(lowered, offsets)
    n = len(offsets) - 1
    # the end is a token with a space, which no word has
    found = np.r_[word_keys(lowered, starts, ends, key), word_keys(END, np.array([0]), np.array([len(END)]), key)]
    order = np.argsort(found["hash"], kind="stable")
    new = np.r_[True, (found["hash"][order][1:] != found["hash"][order][:-1]) | (found["check"][order][1:] != found["check"][order][:-1])]
    token = np.empty(len(order), np.int64)
    token[order] = np.cumsum(new) - 1
    at = np.cumsum(np.bincount(row, minlength=n) + 1) - 1  # where each row's end stands
    out, rows = np.full(len(starts) + n, token[-1]), np.zeros(len(starts) + n, np.int64)
    word = np.ones(len(out), bool)
    word[at] = False
    out[word], rows[word], rows[at] = token[:-1], row, np.arange(n)
    return found[order[new]], out, rows


def combine_words(found: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words in order, with their summed counts; an error if two words have one hash."""
    at = np.argsort(found["hash"], kind="stable")
    found, counts = found[at], counts[at]
    new = np.r_[True, found["hash"][1:] != found["hash"][:-1]][: len(found)]
    if (found["check"][1:][~new[1:]] != found["check"][:-1][~new[1:]]).any():
        raise ValueError("two words have one hash under this model's key: train again")
    first = np.flatnonzero(new)
    return found[first], np.add.reduceat(counts, first) if len(first) else counts


def combine(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their summed counts."""
    at = np.argsort(keys, kind="stable")
    keys, counts = keys[at], counts[at]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Gather:
    """Keys and counts, combined whenever enough have come together."""

    def __init__(self, combine=combine) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.bytes, self.combine = 0, combine

    def add(self, found: np.ndarray, counts: np.ndarray) -> bool:
        self.held.append((found, counts))
        self.bytes += found.nbytes
        return self.bytes > 8 * FLUSH

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = self.combine(*(np.concatenate(x) for x in zip(*self.held, strict=True)))
        self.held, self.bytes = [], 0
        return keys, counts


def small_counts(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts in bytes; those from 255 on apart, with their places."""
    large = np.flatnonzero(counts >= 255)
    return {"count": np.minimum(counts, 255).astype(np.uint8), "large_at": large.astype(np.uint32), "large": counts[large].astype(np.int64)}


def full_counts(x: dict[str, np.ndarray], at: np.ndarray | None = None) -> np.ndarray:
    if at is None:
        out = x["count"].astype(np.int64)
        out[x["large_at"]] = x["large"]
        return out
    out = x["count"][at].astype(np.int64)
    if len(x["large_at"]) and (big := np.flatnonzero(out == 255)).size:
        out[big] = x["large"][np.searchsorted(x["large_at"], at[big])]
    return out


def unpack(data: bytes) -> dict[str, np.ndarray]:
    import json

    line = data.split(b"\n", 1)[0] + b"\n"
    return {k: np.frombuffer(data, kind, n, len(line) + at) for k, (kind, n, at) in json.loads(line).items()}


def hash_part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Parts in order of the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def pair_part(pairs: np.ndarray, parts: int, hot: np.ndarray) -> np.ndarray:
    first = pairs >> np.uint64(32)
    at = np.minimum(np.searchsorted(hot, first), max(len(hot) - 1, 0))
    is_hot = hot[at] == first if len(hot) else np.zeros(len(pairs), bool)
    return (mix64(np.where(is_hot, pairs, first)) % np.uint64(parts)).astype(np.int64)


def parted(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    at = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(part[at]) != 0]) if len(at) else np.zeros(0, np.int64)
    for some in np.split(at, cut[1:]) if len(at) else []:
        yield int(part[some[0]]), some


def block_rows(blocks: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in blocks], pa.int32()), pa.array([x for _, x in blocks], pa.binary())], ["part", "packed"])


def reduced(sent: DataFrame, parts: int, reduce, schema: str) -> DataFrame:
    """Hands each part's blocks to ``reduce(part, blocks)``, one part at a time; what it yields, kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []
        for batch in batches:
            for part, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != now and held:
                    yield from reduce(now, held)
                    held = []
                now = part
                held.append(unpack(x))
        if held:
            yield from reduce(now, held)

    return kept(sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, schema))


class Vocabulary:
    """Ids of word hashes, from the mapped files."""

    def __init__(self, folder: str, offsets: list[int]) -> None:
        self.folder, self.offsets, self.parts = folder, offsets, len(offsets) - 1
        self.files: dict[int, dict[str, np.ndarray]] = {}

    def part(self, p: int) -> dict[str, np.ndarray] | None:
        """A part's file; None if the part has no word. A file that should be there and isn't is an error."""
        if self.offsets[p] == self.offsets[p + 1]:
            return None
        if p not in self.files:
            self.files[p] = arrayfiles.load(self.folder, f"words-{p}")
        return self.files[p]

    def look_up(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id and training count of digests in order of their hash; UNKNOWN and 0 if not in training."""
        hashes = found["hash"]
        ids, counts = np.full(len(hashes), UNKNOWN, np.uint64), np.zeros(len(hashes), np.int64)
        for p, some in parted(hash_part(hashes, self.parts)):
            if (x := self.part(p)) is None:
                continue
            at = np.minimum(np.searchsorted(x["hash"], hashes[some]), len(x["hash"]) - 1)
            hit = (x["hash"][at] == hashes[some]) & (x["check"][at] == found["check"][some])
            ids[some[hit]] = (at[hit] + self.offsets[p]).astype(np.uint64)
            counts[some[hit]] = x["count"][at[hit]]
        return ids, counts


def pairs_of(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Each token's pair with the token before it in its row."""
    before = np.full(len(ids), BEGIN, np.uint64)
    same = rows[1:] == rows[:-1]
    before[1:][same] = ids[:-1][same]
    return before << np.uint64(32) | ids


def discounts(n: list[int]) -> list[float]:
    """D1, D2 and D3+ from the numbers of keys with counts 1, 2, 3 and 4."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.0), i + 1.0) for i, d in enumerate(raw)]


def discount(counts: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


class Model:
    """What scoring needs besides the files."""

    def __init__(self, folder: str, word_offsets: list[int], total: int, parts: int, hot: dict[int, tuple[int, int, int, int]], pair_counts: list[int], word_counts: list[int], pair_parts: set[int], key: bytes) -> None:
        self.pair_parts, self.key = pair_parts, key
        self.folder, self.word_offsets, self.total, self.parts = folder, word_offsets, total, parts
        self.size = word_offsets[-1]
        self.hot_ids = np.array(sorted(hot), np.uint64)
        self.hot_stats = np.array([hot[i] for i in sorted(hot)], np.int64).reshape(-1, 4)
        self.pair_discounts, self.word_discounts = discounts(pair_counts[:4]), discounts(word_counts[:4])
        self.pairs = pair_counts[4]  # distinct pairs: the sum of all continuation counts
        once, twice, more = word_counts[0], word_counts[1], word_counts[4] - word_counts[0] - word_counts[1]
        spare = sum(d * n for d, n in zip(self.word_discounts, (once, twice, more), strict=True))
        self.uniform = (spare / self.pairs if self.pairs else 1.0) / (self.size + 1)


class Scorer:
    """Looks probabilities up in the mapped files."""

    def __init__(self, model: Model) -> None:
        self.m, self.vocabulary = model, Vocabulary(model.folder, model.word_offsets)
        self.files: dict[str, dict[str, np.ndarray]] = {}

    def file(self, name: str) -> dict[str, np.ndarray]:
        if name not in self.files:
            self.files[name] = arrayfiles.load(self.m.folder, name)
        return self.files[name]

    def pairs(self, p: int) -> dict[str, np.ndarray] | None:
        """A part's pairs; None if it has none."""
        return self.file(f"pairs-{p}") if p in self.m.pair_parts else None

    def continuation(self, ids: np.ndarray) -> np.ndarray:
        """Probability of distinct ids from the continuation counts."""
        out = np.full(len(ids), self.m.uniform)
        known = np.flatnonzero(ids != UNKNOWN)
        part = np.searchsorted(self.m.word_offsets, ids[known], "right") - 1
        for p, some in parted(part):
            n = self.file(f"follows-{p}")["count"][(ids[known[some]] - np.uint64(self.m.word_offsets[p])).astype(np.int64)]
            out[known[some]] += np.maximum(n - discount(n, self.m.word_discounts), 0) / max(self.m.pairs, 1)
        return out

    def contexts(self, ids: np.ndarray) -> np.ndarray:
        """Total and pairs seen once, twice, more often, of distinct context ids."""
        out = np.zeros((len(ids), 4), np.int64)
        if len(self.m.hot_ids):
            at = np.minimum(np.searchsorted(self.m.hot_ids, ids), len(self.m.hot_ids) - 1)
            hit = self.m.hot_ids[at] == ids
            out[hit] = self.m.hot_stats[at[hit]]
        for p, some in parted((mix64(ids) % np.uint64(self.m.parts)).astype(np.int64)):
            x = self.pairs(p)
            if x is None or not len(x["context"]):
                continue
            at = np.minimum(np.searchsorted(x["context"], ids[some]), len(x["context"]) - 1)
            hit = x["context"][at] == ids[some]
            out[some[hit]] = np.stack([x[f][at[hit]] for f in ("total", "once", "twice", "more")], 1)
        return out

    def pair_counts(self, pairs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(pairs), np.int64)
        for p, some in parted(pair_part(pairs, self.m.parts, self.m.hot_ids)):
            x = self.pairs(p)
            if x is None or not len(x["pair"]):
                continue
            at = np.minimum(np.searchsorted(x["pair"], pairs[some]), len(x["pair"]) - 1)
            hit = x["pair"][at] == pairs[some]
            out[some[hit]] = full_counts(x, at[hit])
        return out

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Tokens, known tokens, base score and model score of each row."""
        m, n = self.m, len(offsets) - 1
        distinct, which, rows = tokens_of(raw, offsets, m.key)
        ids, counts = self.vocabulary.look_up(distinct)
        low = self.continuation(ids)
        pairs, of_pair = np.unique(pairs_of(ids[which], rows), return_inverse=True)
        context, of_context = np.unique(pairs >> np.uint64(32), return_inverse=True)
        total, once, twice, more = self.contexts(context).T
        seen = self.pair_counts(pairs)
        d = m.pair_discounts
        spare = np.where(total > 0, (d[0] * once + d[1] * twice + d[2] * more) / np.maximum(total, 1), 1.0)
        high = np.maximum(seen - discount(seen, d), 0) / np.maximum(total, 1)[of_context]
        p = high[of_pair] + spare[of_context][of_pair] * low[which]
        base = np.log10((counts + 0.1) / (m.total + 0.1 * (m.size + 1)))[which]
        return [np.bincount(rows, minlength=n), np.bincount(rows, (counts > 0)[which], n).astype(np.int64), np.bincount(rows, base, n), np.bincount(rows, np.log10(p), n)]


def train(df: DataFrame, trainable: Column, text_col: str = "text", parts: int | None = None) -> Model:
    """Count the rows where ``trainable`` holds and write the model's files."""
    spark = df.sparkSession
    folder, key = fresh_path(spark, "kneser-ney"), secret()
    texts = small_batches(df).where(trainable).select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = parts or parts_for(texts, PART_BYTES)

    def send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = Gather(combine_words)

        def flush() -> pa.RecordBatch:
            found, counts = gather.take()
            return block_rows([(p, arrayfiles.pack({"hash": found["hash"][some], "check": found["check"][some], **small_counts(counts[some])})) for p, some in parted(hash_part(found["hash"], parts))])

        for _, offsets, raw, _ in text_chunks(batches):
            found, which, _ = tokens_of(raw, offsets, key)
            if gather.add(found, np.bincount(which, minlength=len(found))):
                yield flush()
        if gather.held:
            yield flush()

    def meet_words(part: int, blocks: list[dict]) -> Iterator[pa.RecordBatch]:
        found = np.empty(sum(len(x["hash"]) for x in blocks), DIGEST)
        for name in DIGEST.names:
            found[name] = np.concatenate([x[name] for x in blocks])
        keys, counts = combine_words(found, np.concatenate([full_counts(x) for x in blocks]))
        arrayfiles.save(folder, f"words-{part}", {"hash": keys["hash"], "check": keys["check"], "count": counts})
        top = np.sort(np.argsort(-counts, kind="stable")[:HOT])
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([len(keys)]), pa.array([int(counts.sum())]), pa.array([top.tolist()], pa.list_(pa.int64())), pa.array([counts[top].tolist()], pa.list_(pa.int64()))], ["part", "n", "total", "top", "top_counts"])

    found = reduced(texts.mapInArrow(send_words, BLOCKS), parts, meet_words, "part long, n long, total long, top array<long>, top_counts array<long>")
    sizes = {r["part"]: (r["n"], r["total"]) for r in found.select("part", "n", "total").collect()}
    offsets = np.cumsum([0, *(sizes.get(p, (0, 0))[0] for p in range(parts))]).tolist()
    if offsets[-1] > MOST_WORDS:
        raise ValueError(f"{offsets[-1]} different words: ids of 32 bits tell at most {MOST_WORDS} apart")
    total = sum(t for _, t in sizes.values())
    each = found.select("part", F.posexplode("top").alias("i", "place"), "top_counts").select("part", "place", F.col("top_counts")[F.col("i")].alias("c"))
    top = each.orderBy(F.desc("c"), "part", "place").limit(HOT).collect()
    hot = np.array(sorted([offsets[r["part"]] + r["place"] for r in top] + [BEGIN]), np.uint64)

    def send_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather, vocabulary = Gather(), Vocabulary(folder, offsets)

        def flush() -> pa.RecordBatch:
            pairs, counts = gather.take()
            blocks = []
            for p, some in parted(pair_part(pairs, parts, hot)):
                own = pairs[some]
                first = np.flatnonzero(np.r_[True, (own[1:] >> np.uint64(32)) != (own[:-1] >> np.uint64(32))])
                blocks.append((p, arrayfiles.pack({"context": (own[first] >> np.uint64(32)).astype(np.uint32), "size": np.diff(np.r_[first, len(own)]).astype(np.uint32), "word": (own & np.uint64(0xFFFFFFFF)).astype(np.uint32), **small_counts(counts[some])})))
            return block_rows(blocks)

        for _, offs, raw, _ in text_chunks(batches):
            found, which, rows = tokens_of(raw, offs, key)
            if gather.add(*np.unique(pairs_of(vocabulary.look_up(found)[0][which], rows), return_counts=True)):
                yield flush()
        if gather.held:
            yield flush()

    def meet_pairs(part: int, blocks: list[dict]) -> Iterator[pa.RecordBatch]:
        pairs = np.concatenate([np.repeat(x["context"].astype(np.uint64), x["size"]) << np.uint64(32) | x["word"].astype(np.uint64) for x in blocks])
        pairs, counts = combine(pairs, np.concatenate([full_counts(x) for x in blocks]))
        context = pairs >> np.uint64(32)
        first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
        stats = [np.add.reduceat(x, first) for x in (counts, (counts == 1).astype(np.int64), (counts == 2).astype(np.int64), (counts > 2).astype(np.int64))]
        context = context[first]
        is_hot = np.isin(context, hot)
        columns = {name: x[~is_hot].astype(kind) for name, x, kind in zip(("total", "once", "twice", "more"), stats, (np.int64, np.uint32, np.uint32, np.uint32), strict=True)}
        arrayfiles.save(folder, f"pairs-{part}", {"pair": pairs, **small_counts(counts), "context": context[~is_hot].astype(np.uint32), **columns})
        n = np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist()
        at = np.flatnonzero(is_hot)
        yield pa.RecordBatch.from_arrays([pa.array([None] * len(at) + [part], pa.int32()), pa.array([*context[at].astype(np.int64).tolist(), None], pa.int64()), pa.array([*np.stack([x[at] for x in stats], 1).tolist(), [*n, len(pairs)]], pa.list_(pa.int64())), pa.nulls(len(at) + 1, pa.binary())], ["part", "context", "n", "packed"])
        words_, follows = np.unique(pairs & np.uint64(0xFFFFFFFF), return_counts=True)
        for p, some in parted(np.searchsorted(offsets, words_, "right") - 1):
            packed = arrayfiles.pack({"word": words_[some].astype(np.uint32), **small_counts(follows[some])})
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int64())), pa.array([packed], pa.binary())], ["part", "context", "n", "packed"])

    counted = reduced(texts.mapInArrow(send_pairs, BLOCKS), parts, meet_pairs, "part int, context long, n array<long>, packed binary")
    sums = [F.sum(F.col("n")[i]) for i in range(5)]
    contexts = counted.where("context is not null").groupBy("context").agg(*[s.alias(f"s{i}") for i, s in enumerate(sums[:4])]).collect()
    pair_counts = [x or 0 for x in counted.where("context is null and n is not null").agg(*sums).first()]
    pair_parts = {r["part"] for r in counted.where("context is null and n is not null").select("part").collect()}

    def meet_follows(part: int, blocks: list[dict]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(offsets[part + 1] - offsets[part], np.int64)
        for x in blocks:
            np.add.at(out, x["word"].astype(np.int64) - offsets[part], full_counts(x))
        arrayfiles.save(folder, f"follows-{part}", {"count": out.astype(np.uint32) if not len(out) or out.max() < 1 << 32 else out})
        yield pa.RecordBatch.from_arrays([pa.array([[*np.bincount(np.minimum(out, 5), minlength=6)[1:5].tolist(), int((out > 0).sum())]], pa.list_(pa.int64()))], ["n"])

    words_counted = reduced(counted.where("packed is not null").select("part", "packed"), parts, meet_follows, "n array<long>")
    word_counts = [x or 0 for x in words_counted.agg(*sums).first()]
    return Model(folder, offsets, total, parts, {r["context"]: (r["s0"], r["s1"], r["s2"], r["s3"]) for r in contexts}, pair_counts, word_counts, pair_parts, key)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row, over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for rows, offsets, raw, _ in text_chunks(batches):
            n, known, base, own = scorer.score(raw, offsets)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n), pa.array(known), pa.array(np.full(len(n), model.total)), pa.array(base), pa.array(own), pa.array(10 ** (-own / n))], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    rows = small_batches(df).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
