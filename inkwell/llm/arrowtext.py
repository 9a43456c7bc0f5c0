"""Helpers shared by the Arrow-batch operators of this subpackage.

Operators read only the columns they name, so extra columns of any name in the
input never clash with what they return.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

#: Bytes of text handled at once inside an Arrow batch; one longer text is handled alone.
CHUNK_BYTES = 1 << 19
#: Bytes of an Arrow batch: executors and their workers hold several at a time.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """The table itself; lets its session send batches of BATCH_BYTES to workers, unless the session says how large they are."""
    conf = df.sparkSession.conf
    if BATCH_SETTING not in conf.getAll:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df


def narrow(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id and the text, under those names, and nothing else."""
    return small_batches(df).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def numbered(df: DataFrame) -> DataFrame:
    """The table with columns named c0, c1 and so on, for functions over whole rows: names with dots would fail there."""
    return small_batches(df).toDF(*[f"c{i}" for i in range(len(df.columns))])


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets (n + 1, from 0), UTF-8 bytes and validity of a string column; nulls are empty."""
    n = len(column)
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column = column.cast(pa.string())
        kind = np.int32
    valid = np.ones(n, bool) if not column.null_count else ~np.asarray(column.is_null())
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8), valid
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind, n + 1 + column.offset)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[ends[0] : ends[-1]]
    ends -= ends[0]
    if not valid.all() and np.diff(ends)[~valid].any():  # bytes under nulls are not text
        keep = np.repeat(valid, np.diff(ends))
        raw = raw[keep]
        ends = np.r_[0, np.cumsum(np.where(valid, np.diff(ends), 0))]
    return ends, raw, valid


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges that hold at most ``limit`` bytes, or one row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def text_chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, offsets, bytes, validity) for slices of the batches; the batches have a column ``text``."""
    for batch in batches:
        offsets, raw, valid = string_parts(batch.column(batch.schema.get_field_index("text")))
        for i, j in row_chunks(offsets, limit):
            yield batch.slice(i, j - i), offsets[i : j + 1] - offsets[i], raw[offsets[i] : offsets[j]], valid[i:j]


def run_starts(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Masks that leave the first 0 to 8 bytes of eight.
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Spans of more bytes than this are hashed one by one.
LONG_SPAN = 256
STEP = np.uint64(0x9E3779B97F4A7C15)


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as one number, zeros behind the end."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, eight at a time, scrambled after each step.

    Equal spans have equal hashes; that different ones differ is only likely,
    so whoever needs certainty compares (``distinct_spans``).
    """
    lane, size = eights(raw), ends - starts
    out = mix64(size.astype(np.uint64) + STEP)
    on = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    at, left = starts[on], size[on]
    while len(on):
        out[on] = mix64((out[on] ^ (lane[at] & FIRST_BYTES[np.minimum(left, 8)])) * STEP)
        more = left > 8
        on, at, left = on[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        out[i] = xxh64_intdigest(raw[starts[i] : ends[i]].tobytes(), 42)
    return out


def distinct_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One position of each different span, and which of these every span equals: told by hash, decided by bytes."""
    first, which = np.unique(hashes, return_index=True, return_inverse=True)[1:]
    size, model = ends - starts, starts[first][which]
    wrong = size != size[first][which]
    lane = eights(raw)
    on = np.flatnonzero(~wrong & (size <= LONG_SPAN) & (model != starts))
    at, other, left = starts[on], model[on], size[on]
    while len(on):
        wrong[on] |= ((lane[at] ^ lane[other]) & FIRST_BYTES[np.minimum(left, 8)]) != 0
        more = left > 8
        on, at, other, left = on[more], at[more] + 8, other[more] + 8, left[more] - 8
    for i in np.flatnonzero(~wrong & (size > LONG_SPAN) & (model != starts)).tolist():
        wrong[i] = not np.array_equal(raw[starts[i] : ends[i]], raw[model[i] : model[i] + size[i]])
    if wrong.any():
        own: dict[bytes, int] = {}
        extra = []
        for i in np.flatnonzero(wrong).tolist():
            text = raw[starts[i] : ends[i]].tobytes()
            if text not in own:
                own[text] = len(first) + len(extra)
                extra.append(i)
            which[i] = own[text]
        first = np.r_[first, extra]
    return first, which


#: Two halves of a digest of 128 bits.
DIGEST = np.dtype([("hash", "<u8"), ("check", "<u8")])


def secret() -> bytes:
    """A new key for ``digests``: made on the driver, the same in all tasks of a run and in their repetitions."""
    return os.urandom(16)


def digests(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: bytes, kind: np.dtype = DIGEST) -> np.ndarray:
    """A keyed BLAKE2 digest of each span, as many bits as ``kind`` has.

    Unlike ``span_hashes`` no texts can be made to collide: the key is not known when they are
    written. Two different spans out of n agree with probability n * n / 2 ** (bits + 1).
    """
    whole = raw.tobytes()
    found = [blake2b(whole[a:b], key=key, digest_size=kind.itemsize).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return np.frombuffer(b"".join(found), kind)


class Rolling:
    """Hashes of all spans of one length, from prefix sums modulo 2**64: equal spans agree, different ones may, so they only filter."""

    BASE = int(STEP)

    def __init__(self) -> None:
        self.table = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            ones = np.full(n, STEP)
            ones[0] = 1
            self.up = np.multiply.accumulate(ones)
            ones[1:] = np.uint64(pow(self.BASE, -1, 1 << 64))
            self.down = np.multiply.accumulate(ones)

    def spans(self, raw: np.ndarray, size: int) -> np.ndarray:
        """A hash of the ``size`` bytes from each byte on, as far as they go."""
        self.grow(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.table[raw] * self.up[: len(raw)], out=total[1:])
        n = max(0, len(raw) - size + 1)
        return mix64((total[size:] - total[:n]) * self.down[:n])


#: White space of the word rules: 0x20 and 0x09-0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each white-space word; words never cross rows."""
    solid = ~IS_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[1:-1] = solid[1:] & solid[:-1]
    inner = offsets[1:-1]
    edge[inner[inner < len(raw)]] = False  # a row's first byte never continues the row before
    starts = np.flatnonzero(solid & ~edge[:-1])
    ends = np.flatnonzero(solid & ~edge[1:]) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1
