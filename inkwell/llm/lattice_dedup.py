"""Near-duplicate embeddings by lattice hashing.

Each of ``tables`` tables projects the unit vectors by a random matrix to
``blocks`` groups of eight coordinates and decodes every group to its nearest E8
lattice point. The points of all groups, with the label, name the vector's cell.
Besides its own cell a vector probes neighbouring cells: those where one group
moves to the next nearest lattice points. A pair is found in a table if one of
the two probes the other's own cell; found pairs are verified by their cosine in
double precision.

Equal vectors of one label are one node with a count. Inside a cell the pairs are
compared in blocks; a cell gives each node's number of links and a spanning
forest, never its pairs. A pair found in several tables counts in the first one
only, which both nodes' cells tell.

Cells of one node are left out before any vector moves. A cell of more than
``chunk`` distinct nodes is dealt in pairs of blocks to as many tasks.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows without a label, link with nothing: 0 links, their own
component; so do rows with a null id. Vectors of different lengths never link. A
repeated vector links with its repetitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import mix64, small_batches
from .shared import connected, kept

#: The lattice's shortest vectors: all (+-1, +-1, 0, ...) and all (+-1/2, ...) with an even number of minus signs.
SHORTEST = np.array(
    [[s * (k == i) + t * (k == j) for k in range(8)] for i in range(8) for j in range(i) for s in (1, -1) for t in (1, -1)]
    + [[0.5 - (b >> k & 1) for k in range(8)] for b in range(256) if b.bit_count() % 2 == 0]
)


def nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum, per row."""
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(1)
    rows = np.flatnonzero(near.sum(1).astype(np.int64) % 2)
    near[rows, worst[rows]] += np.where(off[rows, worst[rows]] >= 0, 1, -1)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points: of the even integer points and those shifted by a half, the closer."""
    a, b = nearest_even(x), nearest_even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


@dataclass
class Tables:
    """The random projections of all tables for vectors of one length."""

    count: int = 8
    blocks: int = 2
    probes: int = 2
    scale: float = 2.0
    seed: int = 11

    def projections(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng([self.seed, size])
        return rng.standard_normal((size, self.count * self.blocks * 8)) / self.scale, rng.random(self.count * self.blocks * 8)

    def cells(self, unit: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own cells (n, tables) and probed cells (n, tables, blocks * probes) as hashes."""
        matrix, shift = self.projections(unit.shape[1])
        n = len(unit)
        x = (unit @ matrix + shift).reshape(n * self.count * self.blocks, 8)
        own = nearest_e8(x)
        # the next nearest points: the shortest vectors most along the remainder
        step = np.argpartition(-((x - own) @ SHORTEST.T), self.probes - 1, axis=1)[:, : self.probes]
        odd = mix64(np.arange(101, 109, dtype=np.uint64)) | np.uint64(1)

        def key(p: np.ndarray) -> np.ndarray:
            return mix64(((2 * p).astype(np.int64).view(np.uint64) * odd).sum(-1, dtype=np.uint64))

        shape = (n, self.count, self.blocks)
        mine = key(own).reshape(shape)
        others = key(own[:, None, :] + SHORTEST[step]).reshape(*shape, self.probes)
        salt = mix64(np.arange(1, self.blocks + 1, dtype=np.uint64))
        table = mix64(np.arange(1, self.count + 1, dtype=np.uint64) << np.uint64(32))[None, :] ^ mix64(label.astype(np.int64).view(np.uint64) + np.uint64(77) + (np.uint64(unit.shape[1]) << np.uint64(40)))[:, None]
        whole = (mine * (salt | np.uint64(1))).sum(2, dtype=np.uint64) + table
        moved = whole[:, :, None, None] + (others - mine[..., None]) * (salt | np.uint64(1))[None, None, :, None]
        return mix64(whole), mix64(moved).reshape(n, self.count, -1)


def vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label and v, the vector in doubles; v is null if the row links with nothing."""
    rows = small_batches(df).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~odd & F.exists("v", lambda x: x != 0)
    return rows.select("vec_id", "label", F.when(good, F.transform("v", lambda x: x + F.lit(0.0))).alias("v"))


def unit_rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and unit vectors, for each length of vector in a list column."""
    sizes = np.asarray(column.value_lengths()).astype(np.int64)
    flat, ends = np.asarray(column.flatten()), np.r_[0, np.cumsum(sizes)]
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        x = flat[ends[at][:, None] + np.arange(size)]
        x = x / np.abs(x).max(1, keepdims=True)
        yield at, x / np.sqrt((x * x).sum(1, keepdims=True))


def forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of a symmetric adjacency matrix."""
    rest, left, right = near.any(1), [], []
    while rest.any():
        todo = [int(rest.argmax())]
        rest[todo[0]] = False
        while todo:
            i = todo.pop()
            new = np.flatnonzero(near[i] & rest)
            rest[new] = False
            left += [i] * len(new)
            right += new.tolist()
            todo += new.tolist()
    return np.array(left, np.int64), np.array(right, np.int64)


def compare(cell: int, side: np.ndarray, own: np.ndarray, unit: np.ndarray, label: np.ndarray, tables: Tables, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which nodes of a cell link, which of these pairs count here, and a forest of the links.

    ``side`` is 0 or 1 where two blocks of a large cell meet (then only pairs
    across count), 2 where a block meets itself.
    """
    near = (unit @ unit.T) >= least
    near &= (own[:, None] | own[None, :]) & (label[:, None] == label[None, :])
    near &= (side[:, None] != side[None, :]) | (side[:, None] == 2)
    np.fill_diagonal(near, False)
    here = np.zeros_like(near)
    if (some := np.flatnonzero(near.any(1))).size:
        mine, probed = tables.cells(unit[some], label[some])
        every = np.concatenate((mine[:, :, None], probed), 2)
        i, j = np.nonzero(np.triu(near[np.ix_(some, some)]))
        for a in range(0, len(i), 20_000):
            x, y = i[a : a + 20_000], j[a : a + 20_000]
            of_y = np.where((every[x] == mine[y][:, :, None]).any(2), mine[y], np.uint64(0))
            of_x = np.where((every[y] == mine[x][:, :, None]).any(2), mine[x], np.uint64(0))
            found = np.maximum(of_x, of_y)  # 0 in the tables that don't find the pair
            first = found[np.arange(len(x)), (found > 0).argmax(1)]
            at = first == np.uint64(cell)
            here[some[x[at]], some[y[at]]] = here[some[y[at]], some[x[at]]] = True
    return here, *forest(near)


def links(nodes: DataFrame, tables: Tables, least: float, chunk: int) -> DataFrame:
    """Rows (a, b, linked): edges a-b with linked 0, which connect what links, and parts of a's number of links, b null.

    ``nodes`` has node, n (its rows), label and v.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 2048):
                part = batch.slice(i, 2048)
                node, label = np.asarray(part.column(0)), np.asarray(part.column(1))
                for at, unit in unit_rows(part.column(2)):
                    mine, probed = tables.cells(unit, label[at])
                    cells = np.concatenate((mine.reshape(len(at), -1), probed.reshape(len(at), -1)), 1)
                    own = np.arange(cells.shape[1]) < mine.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(cells.ravel().view(np.int64)), pa.array(np.tile(own, len(at))), pa.array(np.repeat(node[at], cells.shape[1]))], ["cell", "own", "node"])

    entries = kept(nodes.select("node", "label", "v").mapInArrow(place, "cell long, own boolean, node long"))
    busy = entries.groupBy("cell").agg(F.count("*").alias("members"), F.max("own").alias("owned")).where("owned and members > 1")
    dealt = entries.join(busy, "cell").withColumn("blocks", F.ceil(F.col("members") / chunk).cast("int"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    dealt = dealt.select("cell", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), side.cast("long").alias("side"), "own", "node")
    full = dealt.join(nodes, "node").select("cell", "low", "high", "side", "own", "node", "n", "label", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(part: pa.Table) -> Iterator[pa.RecordBatch]:
            key = np.stack([np.asarray(part.column(c)) for c in range(3)], 1)
            change = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])
            column = part.column(8).combine_chunks()
            side, own, node, n, label = (np.asarray(part.column(c)) for c in range(3, 8))
            for a, b in zip(change.tolist(), [*change[1:].tolist(), len(key)], strict=True):
                if b - a < 2:
                    continue
                for at, unit in unit_rows(column.slice(a, b - a)):
                    at = at + a
                    here, left, right = compare(int(key[a, 0]) & (1 << 64) - 1, side[at], own[at], unit, label[at], tables, least)
                    linked = here @ n[at]
                    some = np.flatnonzero(linked)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate((node[at][some], node[at][left]))), pa.array(np.concatenate((np.zeros(len(some), np.int64), node[at][right])), mask=np.arange(len(some) + len(left)) < len(some)), pa.array(np.concatenate((linked[some], np.zeros(len(left), np.int64))))],
                        ["a", "b", "linked"],
                    )

        rest = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            rest = now if rest is None else pa.concat_tables([rest, now]).combine_chunks()
            key = np.stack([np.asarray(rest.column(c)) for c in range(3)], 1)
            done = int(np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])[-1]) if len(key) else 0
            if done:
                yield from emit(rest.slice(0, done))  # the last cell may go on in the next batch
                rest = rest.slice(done)
        if rest is not None and len(rest):
            yield from emit(rest)

    return full.repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high", "node").mapInArrow(run, "a long, b long, linked long")


def near_duplicates(df: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tables: Tables | None = None, chunk: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows = vectors(df, id_col, vector_col, label_col)
    nodes = kept(rows.where("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")))
    found = kept(links(nodes.select("node", "n", "label", "v"), tables or Tables(), least, chunk))
    labels = connected(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy("a").agg(F.sum("linked").alias("linked"))
    named = nodes.join(counts, nodes.node == counts.a, "left").join(labels.select(F.col("node").alias("x"), F.col("label").alias("root")), F.col("node") == F.col("x"), "left")
    named = named.select("label", "v", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("links"), F.coalesce("root", "node").alias("root"))
    good = rows.where("v is not null")
    # many copies of one vector are one large key of this join, which adaptive execution splits
    linked = good.join(named, (good.label == named.label) & (good.v == named.v)).select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("root").alias("component_id"))
    # rows that link with nothing meet no one
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
