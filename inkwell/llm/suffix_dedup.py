"""Repeated byte windows by a depth-limited radix sort of suffixes.

Suffixes are ordered only through ``depth`` bytes, by most-significant-digit
passes of ``digit`` bytes each: digit k holds the bytes from k * digit on (the last
digit ends at ``depth``). Every pass orders what the pass before has left in
groups; a group of one leaves after the pass that isolates it, and the groups of
the last pass are exactly the repeated windows. Suffixes of equal windows that
lie in one long repeated passage are ordered once for all of its copies.

So that not every byte of the corpus travels, two filters come first. They only
leave out suffixes whose windows occur once, or that stand in a copied passage
of which one copy goes on:

1. Each window's anchor is its smallest ``digit``-byte gram by a rolling hash (the
   leftmost of equal ones). Windows that share an anchor in place lie next to each
   other and form a run. Equal windows have equal anchors at equal offsets, so a run
   whose gram occurs nowhere else leaves.
2. Runs with one gram and equal bytes are copies: all their windows are repeated.
   Where the gram occurs in other runs too, one of the copies goes on.

Then the passes. A suffix travels with its digits, each as a digest of 64 bits, and a
task orders its records digit by digit: a pass sorts every group that is left by
the next digit and takes out the groups of one.

What is removed was told to be equal by digests with a secret key, drawn anew for each
run: all digits of two suffixes together, at least 128 bits, or 96 bits of two runs of
one gram. The key is not known when the texts are written, so no texts can be made to
agree; of 10**13 different suffixes two do by chance with probability 1e-13. A row is known
by 96 bits of hashes of the key, id and text. Rolling and other plain hashes
only choose anchors and parts.

Passes travel as packed blocks of records. A map task orders what it holds, and
sends one of equal suffixes or runs on, so a group's records in a part are at
most as many as map blocks however many copies there are; a gram with more than
``HOT`` different runs in one block goes on to the digits there and then, with a
marker in the runs' stead. There are as many parts as ``PART_BYTES`` go into the
texts, and a task reduces one part at a time.

Positions are of bytes in UTF-8. Defined cases: a null text is an empty one; a
text shorter than ``depth`` has no window; rows repeated whole, under one id or
many, repeat each other; an empty table gives an empty one; texts longer than
``BLOCK`` are handled in parts; other columns come back in ``rest``, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import Rolling, digests as digests_of, mix64, row_chunks, run_starts, secret, small_batches, string_parts
from .shared import kept, marked, marks, parts_for

#: Start positions handled at once, records gathered before a block is sent, and runs of a gram that make it hot in a block.
BLOCK, FLUSH, HOT = 1 << 17, 1 << 16, 512
#: Bytes of text whose records make a part.
PART_BYTES = 64 << 20
POSITION_BITS = 23
RUN = np.dtype([("gram", "<u8"), ("span", "<u8"), ("more", "<u4"), ("row", "<i8"), ("tag", "<u4"), ("lo", "<u4"), ("width", "<u2"), ("flag", "u1")])
#: What tells runs apart.
BYTES = ["gram", "span", "more"]
SPAN, DIGIT = np.dtype([("span", "<u8"), ("more", "<u4")]), np.dtype("<u8")
ANSWER = np.dtype([("row", "<i8"), ("tag", "<u4"), ("lo", "<u4"), ("hi", "<u4"), ("kind", "u1")])
#: Flags of records: has been seen twice, stands for runs that went on, has no owner that waits for an answer.
TWICE, MARKER, OWNERLESS = 1, 2, 4
#: What is found: a repeated run or window; a run to go through window by window; the same, known to be repeated.
REPEATED, OPEN, SAMPLE = 0, 1, 2
ONE = np.uint64(1)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every w neighbouring values."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def digit_starts(depth: int, digit: int) -> list[int]:
    """Where the digits of a suffix start: the last one ends at ``depth``."""
    if not 0 < 2 * digit <= depth:
        raise ValueError("a suffix has two digits or more")
    return [min(at, depth - digit) for at in range(0, depth, digit)]


def suffix_kind(depth: int, digit: int) -> np.dtype:
    """A record of a suffix: d0, d1 and so on are its digits."""
    return np.dtype([*((f"d{k}", "<u8") for k in range(len(digit_starts(depth, digit)))), ("row", "<i8"), ("tag", "<u4"), ("lo", "<u4"), ("flag", "u1")])


def digit_names(records: np.ndarray) -> list[str]:
    return [f for f in records.dtype.names if f[0] == "d"]


def suffixes_of(raw: np.ndarray, offsets: np.ndarray, keys: np.ndarray, tags: np.ndarray, row: np.ndarray, lo: np.ndarray, end: np.ndarray, depth: int, digit: int, key: bytes) -> np.ndarray:
    """The suffixes that start at lo, ..., end - 1 in a row, for ranges in order of row and lo.

    Only the bytes that they cover are hashed, and each of them once: ranges that touch come together.
    """
    count = end - lo
    ends = np.cumsum(count)
    at = np.repeat(lo - ends + count, count) + np.arange(ends[-1])
    where = np.repeat(offsets[row], count) + at
    base = int(where[0])
    edge = np.zeros(int(where.max()) + depth - base + 1, np.int32)
    np.add.at(edge, offsets[row] + lo - base, 1)
    np.add.at(edge, offsets[row] + end - 1 + depth - base, -1)
    covered = np.cumsum(edge[:-1]) > 0
    place = np.cumsum(covered) - 1
    bytes_ = raw[base : base + len(covered)][covered]
    # one digest serves as a digit of several suffixes
    first = np.arange(len(bytes_) - digit + 1)
    digest = digests_of(bytes_, first, first + digit, key, DIGIT)
    out = np.zeros(len(at), suffix_kind(depth, digit))
    mine = place[where - base]
    for k, start in enumerate(digit_starts(depth, digit)):
        out[f"d{k}"] = digest[mine + start]
    out["row"], out["tag"], out["lo"] = np.repeat(keys[row], count), np.repeat(tags[row], count), at
    return out


def runs_of(raw: np.ndarray, offsets: np.ndarray, rows: np.ndarray, tags: np.ndarray, base: np.ndarray, depth: int, digit: int, rolling: Rolling, key: bytes) -> np.ndarray:
    """The runs of windows of the texts of a block; ``base`` is each text's position in its row."""
    if len(raw) < depth:
        return np.zeros(0, RUN)
    grams = rolling.spans(raw, digit)
    mask = np.uint64((1 << POSITION_BITS) - 1)
    least = sliding_min((grams & ~mask) | np.arange(len(grams), dtype=np.uint64), depth - digit + 1)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    window = np.flatnonzero(np.arange(len(least)) + depth <= offsets[1:][text])
    if not len(window):
        return np.zeros(0, RUN)
    at, text = (least[window] & mask).astype(np.int64), text[window]
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
    lo, hi = window[first], window[np.r_[first[1:] - 1, len(window) - 1]]
    at, text = at[first], text[first]
    out = np.zeros(len(first), RUN)
    out["gram"] = grams[at]
    span = digests_of(raw, lo, hi + depth, key, SPAN)
    out["span"], out["more"] = span["span"] + (at - lo).astype(np.uint64), span["more"]
    out["row"], out["tag"], out["lo"], out["width"] = rows[text], tags[text], lo - offsets[text] + base[text], hi - lo
    return out


def blocks_of(offsets: np.ndarray, limit: int, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, first byte, end) of the parts of a block; texts longer than the limit are cut into parts whose windows don't overlap."""
    sizes, i = np.diff(offsets), 0
    while i < len(sizes):
        if sizes[i] > limit:
            for a in range(0, int(sizes[i]) - depth + 1, limit):
                yield np.array([i]), np.array([a]), np.array([min(a + limit + depth - 1, int(sizes[i]))])
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        some = np.arange(i, j)
        yield some, np.zeros(len(some), np.int64), sizes[i:j]
        i = j


def settle(records: np.ndarray, fields: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The records in order of the fields, and whether each one's digits occur twice or have been seen twice."""
    records = records[np.lexsort([records[f] for f in reversed(fields)])]
    fresh = np.ones(len(records), bool)
    fresh[1:] = np.logical_or.reduce([records[f][1:] != records[f][:-1] for f in fields])
    group = np.cumsum(fresh) - 1
    counts = np.bincount(group)
    twice = (counts > 1) | (np.bincount(group, records["flag"] & TWICE) > 0)
    return records, twice[group] if len(records) else np.zeros(0, bool)


def first_of_each(records: np.ndarray, fields: list[str]) -> np.ndarray:
    fresh = np.ones(len(records), bool)
    fresh[1:] = np.logical_or.reduce([records[f][1:] != records[f][:-1] for f in fields])
    return fresh


def answers(records: np.ndarray, hi: np.ndarray, kind: np.ndarray | int) -> np.ndarray:
    out = np.zeros(len(records), ANSWER)
    out["row"], out["tag"], out["lo"], out["hi"], out["kind"] = records["row"], records["tag"], records["lo"], hi, kind
    return out


def tail_of(records: np.ndarray, depth: int) -> np.ndarray:
    return records["lo"] + records["width"] + depth


def dealt(records: np.ndarray, fields: list[str], parts: int) -> pa.RecordBatch:
    """One packed block for each part; parts go by the scrambled sum of the fields."""
    key = np.zeros(len(records), np.uint64)
    for f in fields:
        key += records[f].astype(np.uint64)
    part = (mix64(key) % np.uint64(parts)).astype(np.int32)
    at = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(part[at]) != 0]) if len(at) else np.zeros(0, np.int64)
    records, part = records[at], part[at]
    packed = [x.tobytes() for x in np.split(records, cut[1:])] if len(at) else []
    return pa.RecordBatch.from_arrays([pa.array(part[cut]), pa.array([records.dtype == ANSWER] * len(packed), pa.bool_()), pa.array(packed, pa.binary())], ["part", "answered", "packed"])


def listed(found: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found["row"]), *[pa.array(found[f].astype(np.int64)) for f in ("tag", "lo", "hi")], pa.array(found["kind"].astype(np.int32))], ["row", "tag", "lo", "hi", "kind"])


NAMES = ["doc_id", "n_bytes", "spans", "kept", "text", "rest"]
SENT = "part int, answered boolean, packed binary"
FOUND = "row long, tag long, lo long, hi long, kind int"


def send_runs(records: np.ndarray, depth: int, parts: int) -> Iterator[pa.RecordBatch]:
    """What a map block knows of its runs already, and the rest, dealt by gram."""
    records, twice = settle(records, BYTES)
    if not len(records):
        return
    known = [answers(records[twice], tail_of(records[twice], depth), REPEATED)]
    one = first_of_each(records, BYTES)
    records, twice = records[one], twice[one]
    records["flag"][twice] |= TWICE
    group = np.cumsum(first_of_each(records, ["gram"])) - 1
    hot = (np.bincount(group) > HOT)[group]
    if hot.any():
        known.append(answers(records[hot], tail_of(records[hot], depth), np.where(twice[hot], SAMPLE, OPEN)))
        marks = records[hot][first_of_each(records[hot], ["gram"])]
        marks["flag"] = MARKER
        for f in ("span", "more", "row", "tag", "lo"):
            marks[f] = 0
        records = np.concatenate((records[~hot], marks))
    yield dealt(records, ["gram"], parts)
    yield dealt(np.unique(np.concatenate(known)), ["row"], parts)


def meet_runs(records: np.ndarray, depth: int) -> Iterator[np.ndarray]:
    """Repeated runs, and the runs whose suffixes go on, of whole groups of one gram."""
    records, twice = settle(records, BYTES)
    if not len(records):
        return
    group = np.cumsum(first_of_each(records, ["gram"])) - 1
    different = np.bincount(group, first_of_each(records, BYTES))
    mixed = (different > 1)[group]
    marker = records["flag"] & MARKER > 0
    twice &= ~marker
    first = first_of_each(records, BYTES)
    end = tail_of(records, depth)
    yield answers(records[twice], end[twice], REPEATED)
    sample = twice & mixed & first
    yield answers(records[sample], end[sample], SAMPLE)
    some = mixed & ~twice & ~marker
    yield answers(records[some], end[some], OPEN)


def passes(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that share all digits with another or have done so, in order, and those that stand alone.

    A pass orders each group that the passes before have left by the next digit. Groups of one leave.
    """
    names, out = digit_names(records), []
    group = np.zeros(len(records), np.int64)
    for k in range(len(names)):
        order = np.lexsort((records[names[k]], group))
        records, group = records[order], group[order]
        fresh = np.ones(len(records), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (records[names[k]][1:] != records[names[k]][:-1])
        alone = fresh & np.r_[fresh[1:], True][: len(fresh)] & (records["flag"] & TWICE == 0)
        out.append(records[alone])
        records, group = records[~alone], (np.cumsum(fresh) - 1)[~alone]
    return records, np.concatenate(out)


def send_suffixes(records: np.ndarray, depth: int, parts: int) -> Iterator[pa.RecordBatch]:
    """What the passes over a map block tell already, and one suffix of each group, dealt by all digits."""
    groups, alone = passes(records)
    known = groups[groups["flag"] & OWNERLESS == 0]
    yield dealt(np.unique(answers(known, known["lo"] + depth, REPEATED)), ["row"], parts)
    names = digit_names(records)
    one = groups[first_of_each(groups, names)]
    one["flag"] |= TWICE | OWNERLESS
    yield dealt(np.concatenate((one, alone)), names, parts)


def meet_suffixes(records: np.ndarray, depth: int) -> Iterator[np.ndarray]:
    """The windows of the groups that the passes over a whole part leave."""
    groups, _ = passes(records)
    known = groups[groups["flag"] & OWNERLESS == 0]
    yield answers(known, known["lo"] + depth, REPEATED)


def meet(sent: DataFrame, kind: np.dtype, reduce, depth: int, parts: int) -> DataFrame:
    """Unpacks each part's blocks together and reduces them, one part at a time; answers pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(packed: list[bytes]) -> Iterator[pa.RecordBatch]:
            for found in reduce(np.frombuffer(b"".join(packed), kind).copy(), depth):
                yield listed(found)

        now, packed = -1, []
        for batch in batches:
            for part, answered, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if answered:
                    yield listed(np.frombuffer(x, ANSWER))
                    continue
                if part != now and packed:
                    yield from emit(packed)
                    packed = []
                now = part
                packed.append(x)
        if packed:
            yield from emit(packed)

    return sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, FOUND)


def keyed(df: DataFrame, id_col: str, text_col: str, key: bytes) -> DataFrame:
    """Rows with a key (row, tag) from the run's key, id and text; rows of one key are copies of each other, id and all. ``rest`` holds the other columns."""
    others = [F.col(f"`{c}`") for c in df.columns if c not in (id_col, text_col)]
    rest = F.struct(*others) if others else F.struct(F.lit(None).cast("int").alias("none"))
    rows = small_batches(df).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), rest.alias("rest"))
    return rows.select(F.xxhash64(F.lit(key), "doc_id", "text").alias("row"), F.crc32("text").alias("tag"), "doc_id", "text", "rest")


def repeated(rows: DataFrame, key: bytes, depth: int = 200, digit: int = 100, parts: int | None = None) -> DataFrame:
    """(row, tag, lo, hi): byte ranges of ``rows`` (row, tag, text) whose union is what windows of ``depth`` bytes repeat."""
    long = rows.where(F.octet_length("text") >= depth).select("row", "tag", "text")
    parts = parts or parts_for(long, PART_BYTES)

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, held, n = Rolling(), [], 0
        for batch in batches:
            rows_, tags = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            offsets, raw, _ = string_parts(batch.column(2))
            for text, a, b in blocks_of(offsets, BLOCK, depth):
                part = raw[offsets[text[0]] + a[0] : offsets[text[-1]] + b[-1]]
                held.append(runs_of(part, np.r_[0, np.cumsum(b - a)], rows_[text], tags[text], a, depth, digit, rolling, key))
                n += len(held[-1])
                if n > FLUSH:
                    yield from send_runs(np.concatenate(held), depth, parts)
                    held, n = [], 0
        if held:
            yield from send_runs(np.concatenate(held), depth, parts)

    def digit_passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            keys, tags = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            offsets, raw, _ = string_parts(batch.column(2))
            wanted = batch.column(3)
            row = np.repeat(np.arange(len(batch)), np.diff(np.asarray(wanted.offsets)))
            lo, hi, kind = (np.asarray(wanted.flatten().field(f)) for f in ("lo", "hi", "kind"))
            order = np.lexsort((kind, lo, row))
            row, lo, hi, kind = row[order], lo[order], hi[order], kind[order]
            for i, j in row_chunks(np.r_[0, np.cumsum(hi - lo - depth + 1)], FLUSH):
                own = row[i:j], lo[i:j], hi[i:j] - depth + 1
                held.append(suffixes_of(raw, offsets, keys, tags, *own, depth, digit, key))
                held[-1]["flag"] = np.repeat(np.where(kind[i:j] == SAMPLE, OWNERLESS, 0), own[2] - own[1])
                n += len(held[-1])
                if n > FLUSH:
                    yield from send_suffixes(np.concatenate(held), depth, parts)
                    held, n = [], 0
        if held:
            yield from send_suffixes(np.concatenate(held), depth, parts)

    found = kept(meet(long.mapInArrow(first_pass, SENT), RUN, meet_runs, depth, parts))
    # a set of ranges, combined in the map task: copies under one id ask and answer once
    asked = kept(found.where(F.col("kind") != REPEATED).groupBy("row", "tag").agg(F.collect_set(F.struct("lo", "hi", "kind")).alias("asked")))
    some, _ = marked(long, kept(marks(asked, "row")), "row")
    suffixes = some.join(asked, ["row", "tag"]).select("row", "tag", "text", "asked").mapInArrow(digit_passes, SENT)
    more = meet(suffixes, suffix_kind(depth, digit), meet_suffixes, depth, parts)
    return found.where(F.col("kind") == REPEATED).select("row", "tag", "lo", "hi").unionAll(more.select("row", "tag", "lo", "hi"))


def remove(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 200, digit: int = 100, parts: int | None = None) -> DataFrame:
    """doc_id, n_bytes, spans (lo, hi: the maximal removed ranges of bytes), kept (the other bytes), text and rest of every row.

    ``text`` is what is kept without the bytes of characters that were cut in two; ``rest`` is a struct of the other columns.
    """
    key = secret()
    rows = keyed(df, id_col, text_col, key)
    ranges = kept(repeated(rows, key, depth, digit, parts).groupBy("row", "tag").agg(F.collect_set(F.struct(F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"))).alias("ranges")))
    some, others = marked(rows, kept(marks(ranges, "row")), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        for batch in batches:
            offsets, raw, _ = string_parts(batch.column(1))
            wanted = batch.column(2)
            cut = np.asarray(wanted.offsets)
            lo, hi = (np.asarray(wanted.values.field(f)) for f in ("lo", "hi"))
            for first, last in row_chunks(offsets, BLOCK):
                spans, rest = [], []
                for i in range(first, last):
                    text = raw[offsets[i] : offsets[i + 1]]
                    gone = np.zeros(len(text) + 1, np.int32)
                    np.add.at(gone, lo[cut[i] : cut[i + 1]], 1)
                    np.add.at(gone, hi[cut[i] : cut[i + 1]], -1)
                    gone = np.cumsum(gone)[:-1] > 0
                    a, b = run_starts(gone)
                    spans.append([{"lo": x, "hi": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
                    rest.append(text[~gone].tobytes())
                whole = pa.array([x.decode("utf-8", "ignore") for x in rest], pa.string())
                own, size = batch.slice(first, last - first), np.diff(offsets[first : last + 1])
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(size), pa.array(spans, kind), pa.array(rest, pa.binary()), whole, own.column(3)], NAMES)

    schema = T._parse_datatype_string("doc_id long, n_bytes long, spans array<struct<lo: bigint, hi: bigint>>, kept binary, text string").add("rest", rows.schema["rest"].dataType)
    empty = F.array().cast("array<struct<lo: int, hi: int>>")
    touched = some.join(ranges, ["row", "tag"], "left").select("doc_id", "text", F.coalesce("ranges", empty).alias("ranges"), "rest").mapInArrow(run, schema)
    return touched.unionAll(others.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.array().cast("array<struct<lo: bigint, hi: bigint>>").alias("spans"), F.encode("text", "UTF-8").alias("kept"), "text", "rest"))


def digests(removed: DataFrame) -> DataFrame:
    """Counts and the SHA-256 of what is left."""
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["hi"] - x["lo"])
    return removed.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))
