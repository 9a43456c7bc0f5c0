"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint's 64 bits lie in ``blocks`` blocks. Two fingerprints that differ
in at most ``distance`` bits agree in at least ``blocks - distance`` of them, so
they share the key of some such choice. Distinct fingerprints are joined on
these keys and verified by their Hamming distance inside each key's bucket.
A bucket gives a spanning forest of its links, never all its pairs; copies share
a fingerprint and are one node. A bucket of over ``HOT`` fingerprints is dealt anew
by further blocks of the bits that it does not share; what is still as large
there is dealt in pairs of chunks. So no task compares more than two chunks.

Defined cases: texts without a word (null and empty ones too) have fingerprint
zero and link like any others; rows repeated under one id stay rows; a null id
has a fingerprint, and a component named by the smallest id that is not null; a
text of any length is hashed whole, in memory in proportion to its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .arrowtext import narrow, text_chunks
from .shared import connected, kept

BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: Buckets up to this size compare neighbours at each offset; larger ones search breadth first.
SMALL = 24
#: Fingerprints of a bucket that one task compares.
HOT = 4096


def shingle_hashes(words: list[bytes], size: int) -> list[int]:
    """XXH64 (seed 42) of every run of ``size`` words joined by a space, or of all words if fewer."""
    if len(words) <= size:
        return [xxh64_intdigest(b" ".join(words), 42)] if words else []
    return [xxh64_intdigest(x, 42) for x in map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))]


def fingerprint(text: bytes, size: int = 3) -> int:
    """A bit is 1 where it is set in over half of the shingle hashes."""
    hashes = shingle_hashes(text.lower().split(), size)
    if not hashes:
        return 0
    rows = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    counts = np.bincount((rows + np.arange(0, 2048, 256)).ravel(), minlength=2048).reshape(8, 256)
    bits = 2 * (counts @ BYTE_BITS) > len(rows)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, offsets, raw, _ in text_chunks(batches):
            whole, cut = raw.tobytes(), offsets.tolist()
            found = [fingerprint(whole[a:b], size) for a, b in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return narrow(df, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def block_keys(blocks: int, distance: int) -> list[tuple[int, int]]:
    """The number and the bit mask of each choice of blocks that a close pair may share."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return list(enumerate(sum(masks[i] for i in some) for some in combinations(range(blocks), blocks - distance)))


def bucket_links(fps: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links among distinct fingerprints, as positions."""
    rest, left, right = np.arange(len(fps)), [], []
    while len(rest):
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            i = todo.pop()
            near = np.bitwise_count(fps[rest] ^ fps[i]) <= distance
            new = rest[near].tolist()
            left += [i] * len(new)
            right += new
            todo += new
            rest = rest[~near]
    return left, right


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def further_masks(mask: int, distance: int) -> list[int]:
    """The bits outside of a mask in ``distance + 1`` blocks: a pair that agrees in the mask shares one of them too."""
    free = [b for b in range(64) if not mask >> b & 1]
    edges = [len(free) * i // (distance + 1) for i in range(distance + 2)]
    return [sum(1 << b for b in free[x:y]) for x, y in zip(edges, edges[1:], strict=False)]


def bucketed(placed: DataFrame, distance: int, hot: int | None = None) -> DataFrame:
    """Links (a, b) inside the buckets of ``placed`` (n, bits, fp); of buckets over ``hot`` the members instead, as (n, bits, a) with b null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n", "bits", "a", "b"]

        def emit(key: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            change = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
            sizes = np.diff(np.r_[change, len(key)])
            pairs = []
            group = np.repeat(np.arange(len(sizes)), sizes)
            small = sizes[group] <= SMALL
            for d in range(1, min(SMALL, int(sizes.max()))):
                hit = (group[d:] == group[:-d]) & small[d:]
                hit &= np.bitwise_count(fps[d:] ^ fps[:-d]) <= distance
                at = np.flatnonzero(hit)
                pairs.append((fps[at], fps[at + d]))
            for g in np.flatnonzero(sizes > SMALL).tolist():
                own = fps[change[g] : change[g] + sizes[g]]
                x, y = bucket_links(own, distance)
                pairs.append((own[x], own[y]))
            if pairs:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*pairs, strict=True))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b)], names)

        def over(key: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(fps.view(np.int64)), pa.nulls(len(fps), pa.int64())], names)

        key, fps, spilled = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64), None
        for batch in batches:
            key = np.concatenate((key, np.stack([np.asarray(batch.column(0)), np.asarray(batch.column(1))], 1)))
            fps = np.concatenate((fps, np.asarray(batch.column(2)).view(np.uint64)))
            if spilled is not None and len(key):  # a large bucket goes on
                same = int((np.r_[(key != spilled).any(axis=1), True]).argmax())
                if same:
                    yield over(key[:same], fps[:same])
                    key, fps = key[same:], fps[same:]
                if len(key):
                    spilled = None
            if not len(key):
                continue
            change = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
            done = int(change[-1])  # the last bucket may go on in the next batch
            if hot:
                sizes = np.diff(np.r_[change, len(key)])
                large = np.repeat(sizes > hot, sizes)
                if large.any():
                    yield over(key[large], fps[large])
                    if large[-1]:
                        spilled, done = key[-1], len(key)
                    keep = ~large
                    done = int(keep[:done].sum())
                    key, fps = key[keep], fps[keep]
            if done:
                yield from emit(key[:done], fps[:done])
                key, fps = key[done:], fps[done:]
        if len(key):
            yield from emit(key, fps)

    dealt = placed.select(F.xxhash64("n", "bits").alias("key"), "n", "bits", "fp").repartition("key").sortWithinPartitions("n", "bits")
    return dealt.select(F.col("n").cast("long"), "bits", "fp").mapInArrow(run, "n long, bits long, a long, b long")


def links(distinct: DataFrame, blocks: int = 6, distance: int = 3, hot: int | None = None) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs within the distance. ``distinct`` has one column fp."""
    hot, keys = hot or HOT, block_keys(blocks, distance)
    entries = F.array(*[F.struct(F.lit(n).cast("long").alias("n"), F.col("fp").bitwiseAND(F.lit(signed(mask))).alias("bits")) for n, mask in keys])
    found = kept(bucketed(distinct.select("fp", F.explode(entries).alias("k")).select("k.n", "k.bits", "fp"), distance, hot))
    edges, rest = found.where("b is not null").select("a", "b"), found.where("b is null")
    if rest.isEmpty():
        return edges.distinct()
    further = F.array(*[F.array(*[F.lit(signed(m)) for m in further_masks(mask, distance)]) for _, mask in keys])
    again = rest.select("n", "bits", F.col("a").alias("fp"), F.posexplode(F.element_at(further, (F.col("n") + 1).cast("int"))).alias("i", "mask"))
    again = again.select((F.col("n") * (distance + 1) + F.col("i")).alias("n"), F.col("bits").bitwiseOR(F.col("fp").bitwiseAND(F.col("mask"))).alias("bits"), "fp")
    found = kept(bucketed(again, distance, hot))
    edges, rest = edges.unionAll(found.where("b is not null").select("a", "b")), found.where("b is null")
    if rest.isEmpty():
        return edges.distinct()
    sizes = rest.groupBy("n", "bits").agg(F.ceil(F.count("*") / hot).alias("chunks"))
    chunk = F.pmod(F.xxhash64("a"), F.col("chunks"))
    pairs = rest.join(sizes, ["n", "bits"]).select("n", "bits", "a", chunk.alias("chunk"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"))
    pairs = pairs.select(F.xxhash64("n", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("n"), "bits", F.col("a").alias("fp"))
    return edges.unionAll(bucketed(pairs, distance).select("a", "b")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, blocks: int = 6, distance: int = 3) -> DataFrame:
    """doc_id, fp and component_id (smallest id reachable by links) of every row."""
    prints = kept(fingerprints(df, id_col, text_col, size))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = connected(links(distinct.select("fp"), blocks, distance))
    named = kept(distinct.join(labels, distinct.fp == labels.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label")))
    component = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(component, "label").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def digests(found: DataFrame) -> DataFrame:
    """The fingerprint as 16 lower-case hex digits."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
