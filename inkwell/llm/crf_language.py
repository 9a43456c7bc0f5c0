"""Language identification by a linear-chain conditional random field over words.

A word is a run of letters, lower-cased. Its emission scores add hashed weights
of its prefixes and suffixes, its character bigrams and trigrams (word ends
included) and, if the lexicon holds it, the word itself. Transition scores are
learned with them on word sequences of one language and on sequences switched
between languages, by gradient ascent on the conditional likelihood
(forward-backward, AdaGrad). At prediction, forward-backward gives every word of
a whole text its language marginals; the text's language is the one with the
largest sum, the score is that language's share.

The fit is bounded, language by language: at most ``rows_per_language`` different rows, the
first by a hash, and of these as many as have ``characters_per_language`` characters
together. They are read whole; a text longer than that bound is learned from only
if its language has no other, the shortest of them then. All languages
are learned; over ``most_languages`` of them are an error. Prediction reads whole texts.

Defined cases: null texts and texts without a letter are ``und`` with score 0,
as is every text if there is no training row; of equal sums the alphabetically
first language wins; repeated rows give repeated results (scores but for rounding); texts of one id with
different languages are learned with each; a text of any length is one chain,
handled alone, which takes about 40 bytes of memory a byte of text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import distinct_spans, mix64, narrow, numbered, span_hashes, text_chunks
from .shared import sampled_texts

BITS, LEXICON_BITS = 16, 14
SEGMENT = 64
LETTER_A, LETTER_B, LETTER_C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@dataclass
class Words:
    """The words of a chunk: their row and which distinct word each is; the features of the distinct ones."""

    row: np.ndarray
    which: np.ndarray
    key: np.ndarray  # of each distinct word
    grams: np.ndarray  # feature ids, flat
    gram_starts: np.ndarray
    affixes: np.ndarray  # (distinct words, 8)


def slot(h: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def words_of(texts: list[str]) -> Words:
    lowered = [t.lower() for t in texts]
    bounds = np.cumsum([0, *map(len, lowered)])
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    there = np.flatnonzero(np.bincount(codes))
    table = np.zeros(int(there[-1]) + 1 if len(there) else 1, bool)
    table[there] = [chr(c).isalpha() for c in there.tolist()]
    letter = table[codes]
    edge = np.ones(len(codes) + 1, bool)  # before a character: no word goes on
    edge[1:-1] = letter[1:] != letter[:-1]
    edge[bounds] = True
    starts = np.flatnonzero(letter & edge[:-1])
    ends = np.flatnonzero(letter & edge[1:]) + 1
    row = np.searchsorted(bounds, starts, "right") - 1

    raw = codes.view(np.uint8)
    hashes = span_hashes(raw, 4 * starts, 4 * ends)
    first, which = distinct_spans(raw, 4 * starts, 4 * ends, hashes)
    key = hashes[first]

    # the distinct words one behind another, a 0 before each and after the last
    at, size = starts[first], (ends - starts)[first]
    head = np.cumsum(size + 1) - size
    c = np.zeros(int(head[-1] + size[-1]) + 1 if len(head) else 1, np.uint64)
    inside = np.ones(len(c), bool)
    inside[head - 1] = inside[-1] = False
    c[inside] = codes[np.repeat(at - head, size) + np.flatnonzero(inside)]
    pair = c[:-1] * LETTER_A + c[1:] * LETTER_B
    grams = np.zeros((len(c), 2), np.int64)
    grams[:-1, 0] = slot((pair + np.uint64(2)) * LETTER_C)
    grams[:-2, 1] = slot((pair[:-1] * LETTER_B + c[2:] * LETTER_A + np.uint64(3)) * LETTER_C)
    grams[:, 1] = np.where(np.r_[inside[1:], False], grams[:, 1], grams[:, 0])  # no trigram across words
    last = head + size - 1
    some = []
    for n in (1, 2, 3, 4):  # prefixes and suffixes of n letters
        front, tail = np.full(len(at), n, np.uint64), np.full(len(at), n + 16, np.uint64)
        for i in range(n):
            front = (front * LETTER_C) ^ np.where(size > i, c[np.minimum(head + i, len(c) - 1)], 0)
            tail = (tail * LETTER_C) ^ np.where(size > i, c[np.maximum(last - i, 0)], 0)
        some += [slot(mix64(front)), slot(mix64(tail))]
    return Words(row, which, key, grams.ravel(), 2 * (head - 1), np.stack(some, 1))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (2 ** BITS, languages)
    lexicon: np.ndarray  # the word key of each lexicon slot, 0 if none
    lexicon_weights: np.ndarray
    transitions: np.ndarray

    def emissions(self, w: Words) -> np.ndarray:
        """Scores (words, languages)."""
        if not len(w.row):
            return np.zeros((0, len(self.languages)), np.float32)
        total = np.zeros((len(w.grams) + 1, len(self.languages)))
        np.cumsum(self.weights[w.grams], axis=0, out=total[1:])
        out = (total[np.r_[w.gram_starts[1:], len(w.grams) - 2]] - total[w.gram_starts]).astype(np.float32)
        for j in range(w.affixes.shape[1]):
            out += self.weights[w.affixes[:, j]]
        at = slot(w.key, LEXICON_BITS)
        out += np.where((self.lexicon[at] == w.key)[:, None], self.lexicon_weights[at], np.float32(0))
        return out[w.which]

    def marginals(self, emissions: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Language marginals of every word by forward-backward along its row.

        Rows are cut into segments of up to SEGMENT words. All segments run
        side by side: first each one's transfer matrix, then the messages that
        enter it from left and right, then the words inside.
        """
        n, k = emissions.shape
        if not n:
            return emissions
        e = np.exp(emissions - emissions.max(1, keepdims=True))
        t = np.exp(self.transitions - self.transitions.max()).astype(np.float32)
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        length = np.diff(np.r_[first, n])
        parts = -(-length // SEGMENT)
        head = np.r_[0, np.cumsum(parts)]
        owner = np.repeat(np.arange(len(first)), parts)
        place = np.arange(head[-1]) - head[:-1][owner]
        start = first[owner] + place * SEGMENT
        size = np.minimum(SEGMENT, length[owner] - place * SEGMENT)

        by_size = np.argsort(-size, kind="stable")  # the segments that reach a place are the first ones
        start, size = start[by_size], size[by_size]
        reach = np.searchsorted(-size, -np.arange(int(size[0]) + 1), "left")
        where = np.empty_like(by_size)
        where[by_size] = np.arange(len(by_size))

        transfer = np.zeros((len(start), k, k), np.float32)
        if (parts > 1).any():
            transfer[:, np.arange(k), np.arange(k)] = e[start]
            for i in range(1, int(size[0])):
                m = reach[i]
                step = (transfer[:m].reshape(-1, k) @ t).reshape(-1, k, k) * e[start[:m] + i][:, None, :]
                transfer[:m] = step / step.max((1, 2), keepdims=True) if i % 4 == 0 else step
            transfer /= transfer.max((1, 2), keepdims=True)
        into, back = np.ones((len(start), k), np.float32), np.ones((len(start), k), np.float32)
        for j in range(1, int(parts.max())):
            s = head[:-1][parts > j] + j
            v = np.einsum("sk,skl->sl", into[where[s - 1]], transfer[where[s - 1]]) @ t
            into[where[s]] = v / v.max(1, keepdims=True)
            s = head[1:][parts > j] - 1 - j
            v = np.einsum("skl,sl->sk", transfer[where[s + 1]], back[where[s + 1]]) @ t.T
            back[where[s]] = v / v.max(1, keepdims=True)
        left, right = np.empty_like(e), np.empty_like(e)
        left[start] = v = into * e[start]
        for i in range(1, int(size[0])):
            at = start[: reach[i]] + i
            v = (v[: reach[i]] @ t) * e[at]
            v /= v.max(1, keepdims=True)
            left[at] = v
        v = back.copy()
        right[start + size - 1] = v
        for i in range(int(size[0]) - 2, -1, -1):
            m = reach[i + 1]
            at = start[:m] + i
            w = (v[:m] * e[at + 1]) @ t.T
            w /= w.max(1, keepdims=True)
            right[at] = v[:m] = w
        out = left * right
        return out / out.sum(1, keepdims=True)


    def languages_of(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words, np.ndarray]:
        """Language (the number of languages if none), its share and the words of each row; the words and their marginals."""
        whole, cut, k = raw.tobytes(), offsets.tolist(), len(self.languages)
        n = len(cut) - 1
        w = words_of([whole[a:b].decode() for a, b in zip(cut, cut[1:], strict=False)])
        count = np.bincount(w.row, minlength=n)
        p = self.marginals(self.emissions(w), w.row) if k else np.zeros((len(w.row), 0))
        sums = np.stack([np.bincount(w.row, p[:, j], n) for j in range(k)], 1) if k else np.zeros((n, 1))
        known = (count > 0) & (k > 0)
        best = sums.argmax(1)
        score = np.where(known, sums[np.arange(n), best] / np.maximum(sums.sum(1), 1e-300), 0.0)
        return np.where(known, best, k), np.minimum(score, 1.0), count, w, p


def sequences(docs: list[tuple[Words, int]], length: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word, label) of training sequences: half of one text, half switched between texts."""
    pieces = [(d, i) for d, (w, _) in enumerate(docs) for i in range(0, len(w.row), length)]
    order = rng.permutation(len(pieces))
    doc, word, label = [], [], []
    for a, b in zip(order[::2].tolist(), order[1::2].tolist(), strict=False):
        for (d, i), other in (((pieces[a]), pieces[b]), ((pieces[b]), None)):
            own = [(d, j) for j in range(i, min(i + length, len(docs[d][0].row)))]
            if other:
                d2, i2 = other
                more = [(d2, j) for j in range(i2, min(i2 + length, len(docs[d2][0].row)))]
                cut = int(rng.integers(4, length - 3))
                own = own[:cut] + more
            if len(own) >= length:
                doc.append([x for x, _ in own[:length]])
                word.append([x for _, x in own[:length]])
                label.append([docs[x][1] for x, _ in own[:length]])
    return np.array(doc), np.array(word), np.array(label)


def fit(texts: list[str], langs: list[str], length: int = 16, lexicon_words: int = 1000, epochs: int = 4, seed: int = 7) -> Model:
    """Learn all weights; ``lexicon_words`` most frequent words of each language make the lexicon."""
    languages = sorted(set(langs))
    k = len(languages)
    model = Model(languages, np.zeros((1 << BITS, k), np.float32), np.zeros(1 << LEXICON_BITS, np.uint64), np.zeros((1 << LEXICON_BITS, k), np.float32), np.zeros((k, k), np.float32))
    docs = [(words_of([t]), languages.index(x)) for t, x in zip(texts, langs, strict=True)]
    docs = [(w, y) for w, y in docs if len(w.row)]
    for y in range(k):
        keys = np.concatenate([w.key[w.which] for w, z in docs if z == y] or [np.zeros(0, np.uint64)])
        key, count = np.unique(keys, return_counts=True)
        best = key[np.argsort(-count, kind="stable")[:lexicon_words]]
        model.lexicon[slot(best, LEXICON_BITS)] = best
    rng = np.random.default_rng(seed)
    doc, word, label = sequences(docs, length, rng)
    if k < 2 or not len(doc):
        return model

    def features(d: int, j: int) -> list[int]:
        w, j = docs[d][0], docs[d][0].which[j]
        own = w.grams[w.gram_starts[j] : w.gram_starts[j + 1] if j + 1 < len(w.gram_starts) else -2].tolist() + w.affixes[j].tolist()
        at = int(slot(w.key[j : j + 1], LEXICON_BITS)[0])
        return own + ([(1 << BITS) + at] if model.lexicon[at] == w.key[j] else [])

    found = [[features(d, j) for d, j in zip(a, b, strict=True)] for a, b in zip(doc.tolist(), word.tolist(), strict=True)]
    table = np.zeros(((1 << BITS) + (1 << LEXICON_BITS), k))
    squares, trans, trans_squares = np.full_like(table, 1e-6), np.zeros((k, k)), np.full((k, k), 1e-6)
    batch = 256
    for _ in range(epochs):
        order = rng.permutation(len(found))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            flat = [f for s in some.tolist() for f in found[s]]
            owner = np.repeat(np.arange(len(flat)), [len(f) for f in flat])
            index = np.array([x for f in flat for x in f])
            size = len(some)
            e = np.stack([np.bincount(owner, table[index, y], len(flat)) for y in range(k)], 1).reshape(size, length, k)
            e = np.exp(e - e.max(2, keepdims=True))
            t = np.exp(trans)
            alpha, beta = np.empty_like(e), np.ones_like(e)
            alpha[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
            for i in range(1, length):
                v = (alpha[:, i - 1] @ t) * e[:, i]
                alpha[:, i] = v / v.sum(1, keepdims=True)
            for i in range(length - 2, -1, -1):
                v = (beta[:, i + 1] * e[:, i + 1]) @ t.T
                beta[:, i] = v / v.sum(1, keepdims=True)
            p = alpha * beta
            p /= p.sum(2, keepdims=True)
            y = label[some]
            diff = np.eye(k)[y] - p
            pair = alpha[:, :-1, :, None] * t[None, None] * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
            pair /= pair.sum((2, 3), keepdims=True)
            gold = np.zeros((k, k))
            np.add.at(gold, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            grad_t = (gold - pair.sum((0, 1))) / size
            diff = diff.reshape(-1, k) / size
            touched, inverse = np.unique(index, return_inverse=True)
            grad = np.stack([np.bincount(inverse, diff[owner, j], len(touched)) for j in range(k)], 1) - 1e-5 * table[touched]
            squares[touched] += grad**2
            table[touched] += 0.3 * grad / np.sqrt(squares[touched])
            trans_squares += grad_t**2
            trans += 0.1 * grad_t / np.sqrt(trans_squares)
    model.weights = table[: 1 << BITS].astype(np.float32)
    model.lexicon_weights = table[1 << BITS :].astype(np.float32)
    model.transitions = trans.astype(np.float32)
    return model


def train(
    df: DataFrame, trainable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    rows_per_language: int = 250, characters_per_language: int = 250_000, most_languages: int = 1000,
) -> Model:
    """Fit on a bounded sample of the labelled rows where ``trainable`` holds."""
    texts = df.where(trainable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    texts = texts.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    few = sampled_texts(texts, "lang", rows_per_language, most_languages).withColumn("size", F.length("text"))
    # a window over ``rows_per_language`` rows: those that fit in by hash, then longer ones by length
    long = F.when(F.col("size") > characters_per_language, F.col("size")).otherwise(0)
    order = Window.partitionBy("lang").orderBy(long, "turn")
    placed = few.withColumns({"place": F.row_number().over(order), "upto": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    rows = placed.where((F.col("place") == 1) | (F.col("upto") <= characters_per_language)).orderBy("turn", "lang").collect()
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", runs: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, n_words of every row; with ``runs`` also the languages of its words, run by run."""
    schema = "doc_id long, lang_pred string, score double, n_words long" + ", runs array<struct<lang: string, words: int>>" * runs
    k = len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, offsets, raw, _ in text_chunks(batches):
            best, score, count, w, p = model.languages_of(raw, offsets)
            n = len(best)
            names = np.array([*model.languages, "und"], object)
            columns = [rows.column(0), pa.array(names[best], pa.string()), pa.array(score), pa.array(count)]
            if runs:
                label = p.argmax(1) if k else np.zeros(len(w.row), int)
                change = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (w.row[1:] != w.row[:-1])]) if len(label) else np.zeros(0, int)
                lists: list[list] = [[] for _ in range(n)]
                for i, size in zip(change.tolist(), np.diff(np.r_[change, len(label)]).tolist(), strict=True):
                    lists[w.row[i]].append({"lang": names[label[i] if k else 0], "words": size})
                columns.append(pa.array(lists, pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32())]))))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "n_words", "runs"][: len(columns)])

    return narrow(df, id_col, text_col).mapInArrow(run, schema)


def accepted(df: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows whose text has a language with at least that share of its words, with all their columns: neither ``und`` nor mixed."""
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for rows, offsets, raw, _ in text_chunks(iter([pa.RecordBatch.from_arrays([batch.column(place)], ["text"])])):
                keep = model.languages_of(raw, offsets)[1] >= least
                yield batch.slice(at, len(rows)).filter(pa.array(keep))
                at += len(rows)

    rows = numbered(df)
    return rows.mapInArrow(run, rows.schema).toDF(*df.columns)
