"""Shards by k-d tree partitioning, in DataFrame operations only.

Every row is a point whose dimensions are metadata of its text: UTF-8 bytes,
characters, words, and lines. A node is split at the weighted median (weight:
bytes) of its widest dimension, the one whose range takes the largest part of
the whole table's range, until leaves reach the target bytes: a node is split while
its halves would be nearer to the target. A number of shards, a power of two, asks
for as many leaves instead. Along a dimension, rows with the same value are ordered
by 31 bits of a hash of the text, so equal texts always share a shard.

The medians are exact. All nodes of a level are searched together: rounds of
equal-width bins narrow each node's bracket by ``bins`` until the bracket is one
value. A round is one aggregation with partial sums to at most ``bins`` rows a
node; only these small tables, never rows, reach the driver. The table of points
is written once to the shared folder, without texts.

Defined cases: a null text has no bytes, weighs 1 and is placed like an empty
one; equal texts stay together, so a group of copies larger than a shard makes
that shard larger; repeated rows get their own slots; an empty table gives an
empty result; a text of any length is a point like others; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept

DIMENSIONS = ("bytes", "chars", "words", "lines")


def points(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, weight, checksums and dimensions of every row."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    pieces = lambda c: (F.length("t") - F.length(F.replace("t", F.lit(c), F.lit("")))).cast("long")
    return rows.select(
        "doc_id",
        (F.octet_length("t") + F.lit(1)).cast("long").alias("size"),
        F.crc32("t").alias("text_crc32"),
        F.octet_length("t").cast("long").alias("bytes"),
        F.length("t").cast("long").alias("chars"),
        pieces(" ").alias("words"),
        pieces("\n").alias("lines"),
        # the order among rows of one value: 31 bits, a function of the text alone
        F.shiftrightunsigned(F.xxhash64("t"), 33).alias("tie"),
    )


def key_of(dimension: str | Column) -> Column:
    """A dimension's value, then the tie, as one sortable number."""
    value = F.col(dimension) if isinstance(dimension, str) else dimension
    return value * F.lit(1 << 31) + F.col("tie")


def medians(rows: DataFrame, bins: int) -> dict[int, int]:
    """For each node of ``rows`` (node, k, size): the greatest key of its left part.

    The left part is the smallest prefix, in key order, of at least half of the
    node's weight; if that is the whole node, the largest proper prefix.
    """
    brackets = {r["node"]: [r["lo"], r["hi"], 0, r["total"]] for r in rows.groupBy("node").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.sum("size").alias("total")).collect()}
    spread = {n: b for n, b in brackets.items() if b[0] < b[1]}
    tops = {n: b[1] for n, b in spread.items()}
    while active := {n: b for n, b in spread.items() if b[0] < b[1]}:
        width = {n: -(-(b[1] - b[0] + 1) // bins) for n, b in active.items()}
        low, step = F.lit(None).cast("long"), F.lit(None).cast("long")
        inside = F.lit(False)
        for n, b in active.items():
            here = F.col("node") == n
            low, step = F.when(here, F.lit(b[0])).otherwise(low), F.when(here, F.lit(width[n])).otherwise(step)
            inside = inside | (here & F.col("k").between(b[0], b[1]))
        past = F.col("k") - low
        binned = rows.where(inside).groupBy("node", ((past - F.pmod(past, step)) / step).cast("long").alias("bin"))
        counted = binned.agg(F.sum("size").alias("w"), F.min("k").alias("first"), F.max("k").alias("last")).collect()
        for n, b in active.items():
            before = b[2]
            own = sorted((r["bin"], r["w"], r["first"], r["last"]) for r in counted if r["node"] == n)
            for _, w, first, last in own:
                if 2 * (before + w) >= b[3]:
                    b[0], b[1], b[2] = first, last, before
                    break
                before += w
    return {n: b[1] if b[1] < tops[n] else b[1] - 1 for n, b in spread.items()}


def grown(at: DataFrame, node: Column, wanted: Column | None, whole: dict[str, float], bins: int) -> list[tuple[int, str, int]]:
    """The splits of all nodes of a level (those where ``wanted`` holds) that have more than one point."""
    placed = at.withColumn("node", node)
    placed = placed if wanted is None else placed.where(wanted)
    ranges = placed.groupBy("node").agg(*[f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]).collect()
    if not whole:
        whole |= {d: max([1, *(r[f"hi_{d}"] - r[f"lo_{d}"] for r in ranges)]) for d in DIMENSIONS}
    widest = {r["node"]: max(DIMENSIONS, key=lambda d: ((r[f"hi_{d}"] - r[f"lo_{d}"]) / whole[d], -DIMENSIONS.index(d))) for r in ranges}
    value = F.lit(0).cast("long")
    for n, d in widest.items():
        value = F.when(F.col("node") == n, F.col(d)).otherwise(value)
    found = medians(placed.select("node", key_of(value).alias("k"), "size"), bins)
    return [(n, widest[n], cut) for n, cut in sorted(found.items())]


def tree(at: DataFrame, shards: int, bins: int = 2048) -> list[tuple[int, str, int]]:
    """Splits (node, dimension, greatest key of the left child) down to so many leaves; node 1 is the root, 2n and 2n + 1 its children."""
    splits: list[tuple[int, str, int]] = []
    whole: dict[str, float] = {}
    nodes = 1
    while nodes < shards:
        splits += grown(at, leaf(splits, nodes), None, whole, bins)
        nodes *= 2
    return splits


def tree_to(at: DataFrame, target_bytes: int, bins: int = 2048) -> list[tuple[int, str, int]]:
    """Splits of every node whose halves are nearer to the target bytes than it is, until there is none; the leaves may lie at any depth."""
    splits: list[tuple[int, str, int]] = []
    whole: dict[str, float] = {}
    single: set[int] = set()  # nodes of one point, which can't be split
    while True:
        sizes = at.withColumn("node", leaf(splits)).groupBy("node").agg(F.sum("size").alias("size")).collect()
        large = [r["node"] for r in sizes if 3 * r["size"] > 4 * target_bytes and r["node"] not in single]
        if not large:
            return splits
        found = grown(at, leaf(splits), F.col("node").isin(large), whole, bins)
        single |= set(large) - {n for n, *_ in found}
        splits += found


def shard_of(splits: list[tuple[int, str, int]]) -> Column:
    """The place of a row's leaf among the leaves, from left to right."""
    by_node = {n for n, *_ in splits}

    def leaves(n: int) -> list[int]:
        return leaves(2 * n) + leaves(2 * n + 1) if n in by_node else [n]

    places = {n: i for i, n in enumerate(leaves(1))}
    return leaf(splits, name=lambda n: places[n])


def leaf(splits: list[tuple[int, str, int]], nodes: int = 0, name=lambda n: n) -> Column:
    """The node that a row comes to; with ``nodes`` the one of that level, where a node that can't be split goes on as its left child."""
    by_node = {n: (d, cut) for n, d, cut in splits}

    def below(n: int) -> Column:
        if n in by_node and not n >= nodes > 0:
            d, cut = by_node[n]
            return F.when(key_of(d) <= F.lit(cut), below(2 * n)).otherwise(below(2 * n + 1))
        return below(2 * n) if n < nodes else F.lit(name(n))

    return below(1)


def shard(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", target_bytes: int | None = None, part_rows: int = 1_000_000) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row.

    ``shards`` is a power of two; with ``target_bytes`` there are as many as leaves
    of that size come out. Slots count from 0 in each shard without gaps: parts of a
    shard, by a hash of the row, are numbered side by side and follow one another; a
    part has about ``part_rows`` rows at most.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("the number of shards is a power of two")
    at = kept(points(df, id_col, text_col))
    if target_bytes:
        shard_column = shard_of(tree_to(at, target_bytes))
    else:
        shard_column = leaf(tree(at, shards), shards) - F.lit(shards)
    parts = max(64, -(-at.count() // part_rows))
    placed = at.select("doc_id", "size", "text_crc32", shard_column.cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)).cast("int").alias("part"))
    counts = placed.groupBy("shard", "part").count()
    before = counts.select("shard", "part", (F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count")).alias("before"))
    turn = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32")
    # at most shards * parts rows are broadcast
    numbered = placed.withColumn("n", F.row_number().over(turn)).join(F.broadcast(before), ["shard", "part"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("n") - 1 + F.col("before")).cast("long").alias("slot"))
