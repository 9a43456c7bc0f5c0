"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text becomes segments that no piece of the model crosses. The distinct
segments of a chunk lie in one flat numpy array of symbols. Each round finds
every segment's minimum pair rank (segmented minimum), merges its leftmost
pairs of that rank at once, compacts the array and sets finished segments
aside, until no pair remains. Where a merge could create a pair that ranks
before the one just merged, only the leftmost pair of the segment is merged in
that round, so the order is always that of the library.

Defined cases: a null text encodes like an empty one (no ids, empty decoded
text); repeated rows give repeated results; an empty table gives an empty one; a
text of any length is encoded whole, in time n log n; columns named ids and decoded
are replaced by those found.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import distinct_spans, narrow, numbered, span_hashes, text_chunks

SPACE = "▁"
#: Segments of more symbols than this take the priority queue: rounds would cost their length squared.
LONG = 400
NONE = np.iinfo(np.int32).max


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i], ..., starts[i] + lengths[i] - 1, for one i behind another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class Bpe:
    """The merge tables of a model file, and the texts of its pieces."""

    def __init__(self, model_path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_path)
        n = model.vocab_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.unknown = model.unk_id()
        self.byte_ids = {int(pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.ids = {pieces[i]: i for i in normal}
        scores = np.array([model.get_score(i) for i in range(n)])
        order = np.unique(-scores[normal], return_inverse=True)[1]
        rank = np.full(n, NONE, np.int32)
        rank[normal] = order
        self.rank = rank
        tied = np.bincount(order)[order] > 1

        pairs: dict[tuple[int, int], int] = {}
        hasty = np.zeros(n, bool)  # after such a merge a pair that ranks no later may appear
        hasty[np.array(normal)[tied]] = True
        for i in normal:
            for cut in range(1, len(pieces[i])):
                left, right = self.ids.get(pieces[i][:cut]), self.ids.get(pieces[i][cut:])
                if left is not None and right is not None:
                    pairs[left, right] = i
                    for part in (left, right):
                        hasty[part] |= rank[i] <= rank[part]
        self.size = n
        self.hasty = hasty
        self.pairs = pairs
        keys = np.array([a * n + b for a, b in pairs], np.int64)
        at = np.argsort(keys)
        self.keys, self.merged = keys[at], np.array(list(pairs.values()), np.int32)[at]
        self.texts = [pieces[i].replace(SPACE, " ").encode() for i in range(n)]
        for byte, i in self.byte_ids.items():
            self.texts[i] = bytes([byte])
        self.texts[self.unknown] = " ⁇ ".encode()
        for i in range(n):
            if model.is_control(i):
                self.texts[i] = b""
        self.text_sizes = np.array([len(t) for t in self.texts])
        self.text_starts = np.cumsum(self.text_sizes) - self.text_sizes
        self.text_pool = np.frombuffer(b"".join(self.texts), np.uint8)
        self.characters = np.full(0x110000, -1, np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.characters[ord(piece)] = i
        inner = [p for p in self.ids if SPACE in p.lstrip(SPACE) or "\n" in p]
        #: No piece holds a space mark behind another character, or a line feed: texts part there.
        self.parts = not inner

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged piece of each pair, -1 where there is none."""
        key = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.size + right, -1)
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.merged[at], -1).astype(np.int32)

    def rounds(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges until no pair remains: the symbols of all segments in order, and each one's count.

        Negative symbols stand for characters outside the model and never merge.
        """
        count = len(lengths)
        owner = np.repeat(np.arange(count), lengths)
        merge = np.full(len(symbols), -1, np.int32)
        inside = owner[1:] == owner[:-1]
        merge[:-1][inside] = self.look_up(symbols[:-1][inside], symbols[1:][inside])
        done_symbols, done_owner = [], []
        while len(symbols):
            rank = np.where(merge >= 0, self.rank[merge], NONE)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[first, len(owner)])
            least = np.minimum.reduceat(rank, first)
            ended = np.repeat(least == NONE, sizes)
            if ended.any():
                done_symbols.append(symbols[ended])
                done_owner.append(owner[ended])
                on = ~ended
                symbols, owner, merge, rank = symbols[on], owner[on], merge[on], rank[on]
                sizes, least = sizes[least != NONE], least[least != NONE]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            # of pairs that overlap, every second one from the left; they lie next to each other
            fresh = np.r_[True, (np.diff(hit) != 1) | (owner[hit[1:]] != owner[hit[:-1]])]
            since = np.arange(len(hit)) - np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            leftmost = np.r_[True, owner[hit[1:]] != owner[hit[:-1]]]
            hit = hit[np.where(self.hasty[merge[hit]], leftmost, since % 2 == 0)]
            symbols[hit] = merge[hit]
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            moved = hit - np.arange(len(hit))  # where the merged symbols lie after compaction
            symbols, owner, merge = symbols[stay], owner[stay], merge[stay]
            touched = np.zeros(len(symbols), bool)
            touched[moved] = True
            touched[moved[moved > 0] - 1] = True
            changed = np.flatnonzero(touched)
            last = changed == len(symbols) - 1
            merge[changed[last]] = -1
            changed = changed[~last]
            same = owner[changed] == owner[changed + 1]
            merge[changed] = np.where(same, self.look_up(symbols[changed], symbols[changed + 1]), -1)
        if not done_symbols:
            return np.zeros(0, np.int32), np.zeros(count, np.int64)
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        at = np.argsort(owner, kind="stable")
        return symbols[at], np.bincount(owner, minlength=count)

    def queue(self, symbols: list[int]) -> list[int]:
        """The same merges for one long segment, by a priority queue over a linked list."""
        n = len(symbols)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j < n and (to := self.pairs.get((symbols[i], symbols[j]))) is not None:
                heapq.heappush(heap, (int(self.rank[to]), i, symbols[i], symbols[j], to))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, left, right, to = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or symbols[i] != left or symbols[j] != right:
                continue
            symbols[i], alive[j], after[i] = to, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [x for x, y in zip(symbols, alive, strict=True) if y]

    def symbols_of(self, text: str) -> np.ndarray:
        """A symbol per character; -1 - code point where the model has no such piece."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        found = self.characters[codes]
        return np.where(found >= 0, found, -1 - codes.astype(np.int32))

    def merge_all(self, text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and their count for segments of so many characters, which lie one behind another in text."""
        symbols = self.symbols_of(text)
        if not (long := np.flatnonzero(sizes > LONG)).size:
            return self.rounds(symbols, sizes)
        ends = np.cumsum(sizes)
        short = np.repeat(sizes <= LONG, sizes)
        done, counts = self.rounds(symbols[short], np.where(sizes <= LONG, sizes, 0))
        pieces, at, cut = [], 0, np.r_[0, np.cumsum(counts)]
        for i in long.tolist():
            merged = np.array(self.queue(symbols[ends[i] - sizes[i] : ends[i]].tolist()), np.int32)
            pieces += [done[at : cut[i]], merged]
            at, counts[i] = cut[i], len(merged)
        return np.concatenate([*pieces, done[at:]]), counts

    def spell(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters outside the model as byte pieces."""
        if not (foreign := np.flatnonzero(symbols < 0)).size:
            return symbols, counts
        spelled = [[self.byte_ids[b] for b in chr(-1 - x).encode()] if self.byte_ids else [self.unknown] for x in symbols[foreign].tolist()]
        width = np.ones(len(symbols), np.int64)
        width[foreign] = [len(x) for x in spelled]
        ends = np.r_[0, np.cumsum(width)]
        counts = np.diff(ends[np.r_[0, np.cumsum(counts)]])
        symbols = np.repeat(symbols, width)
        for i, ids in zip(ends[foreign].tolist(), spelled, strict=True):
            symbols[i : i + len(ids)] = ids
        return symbols, counts

    def encode_block(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and decoded bytes of whole texts, each flat and with offsets."""
        raw = b"".join([b" " + t if t else b"" for t in texts])
        size = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        if SPACE.encode() in raw:  # the mark itself counts as a space
            return self.encode_block([t.replace(SPACE.encode(), b" ") for t in texts])
        buf, ends = np.frombuffer(raw, np.uint8), np.r_[0, np.cumsum(size)]
        if not len(buf):
            return np.zeros(0, np.int32), ends, buf, ends
        start = np.zeros(len(buf), bool)
        start[ends[:-1][size > 0]] = True
        if self.parts:
            space, line = buf == 32, buf == 10
            start[1:] |= (space[1:] & ~space[:-1]) | (line[1:] != line[:-1])
        starts = np.flatnonzero(start)
        stops = np.r_[starts[1:], len(buf)]
        first, which = distinct_spans(buf, starts, stops, span_hashes(buf, starts, stops))

        lengths = (stops - starts)[first]
        chosen = buf[spread(starts[first], lengths)]
        head = np.r_[0, np.cumsum((chosen & 0xC0) != 0x80)]
        cut = np.r_[0, np.cumsum(lengths)]
        text = chosen.tobytes().decode("utf-8").replace(" ", SPACE)
        ids, counts = self.spell(*self.merge_all(text, np.diff(head[cut])))
        out = ids[spread((np.cumsum(counts) - counts)[which], counts[which])]
        at = np.r_[0, np.cumsum(counts[which])][np.searchsorted(starts, ends)]

        width = self.text_sizes[out]
        decoded = self.text_pool[spread(self.text_starts[out], width)]
        gone = np.ones(len(decoded), bool)
        cut = np.r_[0, np.cumsum(width)][at]
        gone[cut[:-1][size > 0]] = False  # the space put in front
        return out, at, decoded[gone], cut - np.r_[0, np.cumsum(size > 0)]

    def encode_columns(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Ids and decoded texts of a chunk as Arrow columns."""
        whole, cut = raw.tobytes(), offsets.tolist()
        ids, at, decoded, to = self.encode_block([whole[a:b] for a, b in zip(cut, cut[1:], strict=False)])
        text = pa.StringArray.from_buffers(len(cut) - 1, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(decoded.tobytes()))
        return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids, pa.int32())), text

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join([self.texts[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if ids and self.texts[ids[0]][:1] == b" " else text


def encode_decode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id, ids array<int> and decoded string for every row, whole texts.

    The model file is a path that every worker can open; each worker loads it once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(model_path)
        for rows, offsets, raw, _ in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), *bpe.encode_columns(raw, offsets)], ["doc_id", "ids", "decoded"])

    return narrow(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_rows(df: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """All columns of every row, and ids and decoded behind them (in the place of columns of these names)."""
    df = df.drop("ids", "decoded")
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(model_path)
        for batch in batches:
            at = 0
            for rows, offsets, raw, _ in text_chunks(iter([pa.RecordBatch.from_arrays([batch.column(place)], ["text"])])):
                ids, decoded = bpe.encode_columns(raw, offsets)
                part = batch.slice(at, len(rows))
                yield pa.RecordBatch.from_arrays([*part.columns, ids, decoded], [*batch.schema.names, "ids", "decoded"])
                at += len(rows)

    rows = numbered(df)
    more = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *more.fields])).toDF(*df.columns, "ids", "decoded")


def digests(encoded: DataFrame) -> DataFrame:
    """Token counts and SHA-256 digests of what ``encode_decode`` returns."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
