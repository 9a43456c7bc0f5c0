"""Centroid clustering by ball k-means, in exact integers.

Every vector becomes integers floor(scale * x). A cluster is a ball: its centroid
and a radius within which all its members lie. After a round's assignments the
radius is the largest distance of a member; when the centroid then moves by d, all
members lie within radius + d of its new place. Another centroid can only win a
member if half its distance from the ball's centroid is at most the radius: these
are the ball's neighbours. A member nearer to its centroid than half the way to the
nearest neighbour is in the stable core and keeps its cluster. Half the distances
of the neighbours, in order, cut the rest of the ball into annuli: a member of the
k-th annulus is compared with the k nearest neighbours only. A ball that, with all
its neighbours, stands still keeps its members unseen. In the first round all
vectors are one ball around centroid 0, without a radius.

Nothing is approximate: cores and annuli are told by squared distances in integers,
so the result is that of comparing every vector with every centroid. Each round
is one pass over a table in the shared folder; sums, counts and radii of clusters
are combined in the map tasks, and a row for each cluster reaches the driver.

Defined cases: vectors that are null, of another length, or hold null or non-finite
components are left out. Centroids start as the vectors with the smallest SHA-256 of
seed and id; rows of one id follow in the order of their vectors, rows without
an id never start a centroid but are clustered. With fewer vectors than ``k`` there are
as many centroids as vectors with an id; without any, no rows. Equal distances go to
the smaller number; empty clusters keep their centroid. Integers beyond 2**26 are an
error, as squared distances of 64 components would leave 64 bits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import small_batches
from .shared import kept

#: Integers of at most this size: 64 squared differences stay below 2**60.
LARGEST = 1 << 26
#: Rows handled at once inside an Arrow batch.
ROWS = 8192


def integers(df: DataFrame, size: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v, the integer components, of the vectors that count."""
    rows = small_batches(df).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    odd = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform("x", lambda x: F.when(F.abs(x) * scale < LARGEST, F.floor(x * F.lit(float(scale)))).otherwise(F.raise_error(F.lit(f"a component times {scale} is not below {LARGEST}")).cast("long")))
    return rows.where((F.size("x") == size) & ~odd).select("vec_id", scaled.alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors with the k smallest hashes of seed and id."""
    turn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    # a top-k: k rows reach the driver
    rows = vectors.where("vec_id is not null").select(turn.alias("turn"), "v").orderBy("turn", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


@dataclass
class Balls:
    """What a pass needs to know of the clusters: centroids, for each its neighbours in order of distance, and which stand still."""

    centroids: np.ndarray
    between: list[np.ndarray]
    others: list[np.ndarray]
    still: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray, radius: np.ndarray, moved: np.ndarray) -> Balls:
        """Neighbours by radii: ``radius`` bounds each cluster's members around the centroids as they stand now."""
        gaps = ((centroids[:, None] - centroids[None]) ** 2).sum(2)
        between, others = [], []
        for i, own in enumerate(gaps):
            order = np.argsort(own, kind="stable")
            # half the distance is at most the radius; a little more, as radii are rounded
            order = order[(order != i) & (np.sqrt(own[order].astype(float)) <= 2 * radius[i] * (1 + 1e-9) + 1e-9)]
            between.append(own[order])
            others.append(order)
        still = np.array([not moved[i] and not moved[others[i]].any() for i in range(len(centroids))], bool)
        return cls(centroids, between, others, still)

    def assign(self, v: np.ndarray, cluster: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's nearest centroid and squared distance, from its cluster and distance of the round before."""
        cluster, distance = cluster.copy(), distance.copy()
        was = cluster.copy()
        for i in np.unique(was).tolist():
            if self.still[i]:
                continue
            rows = np.flatnonzero(was == i)
            own = ((v[rows] - self.centroids[i]) ** 2).sum(1)
            # (2 d)^2 against the squared distances of the neighbours: 0 is the core, k the k-th annulus
            annulus = np.searchsorted(self.between[i], 4 * own, "right")
            best, index = own, np.full(len(rows), i)
            for k, j in enumerate(self.others[i].tolist()):
                some = np.flatnonzero(annulus > k)
                if not len(some):
                    break
                far = ((v[rows[some]] - self.centroids[j]) ** 2).sum(1)
                wins = (far < best[some]) | ((far == best[some]) & (j < index[some]))
                best[some[wins]], index[some[wins]] = far[wins], j
            cluster[rows], distance[rows] = index, best
        return cluster, distance


def assigned(rows: DataFrame, balls: Balls) -> DataFrame:
    """vec_id, v, cluster and distance after one pass over rows that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                part = batch.slice(i, ROWS)
                v = np.asarray(part.column(1).flatten()).reshape(len(part), -1)
                cluster, distance = balls.assign(v, np.asarray(part.column(2)), np.asarray(part.column(3)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "v", "cluster", "distance"])

    return rows.mapInArrow(run, "vec_id long, v array<long>, cluster int, distance long")


def moved_centroids(rows: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact floors of the clusters' means, and the largest distance of a member from the centroid it was assigned to."""
    size = centroids.shape[1]
    sums = [F.sum(F.col("v")[i].cast("decimal(20, 0)")).alias(f"s{i}") for i in range(size)]
    # a row for each cluster, combined in the map tasks
    found = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("far"), *sums).collect()
    out, radius = centroids.copy(), np.zeros(len(centroids))
    for r in found:
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(size)]
        radius[r["cluster"]] = math.sqrt(r["far"])
    return out, radius


@dataclass
class Clusters:
    centroids: np.ndarray
    members: DataFrame  # vec_id, v, cluster, distance


def fit(df: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> Clusters:
    """``rounds`` rounds of assigning and moving, then a last assignment."""
    rows = integers(df, size, scale, id_col, vector_col).withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long")})
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        # without an id no vector starts a centroid
        return Clusters(np.zeros((0, size), np.int64), rows.where(F.lit(False)))
    radius, moved = np.full(len(centroids), np.inf), np.ones(len(centroids), bool)
    for _ in range(rounds):
        rows = kept(assigned(rows, Balls.of(centroids, radius, moved)))
        before = centroids
        centroids, radius = moved_centroids(rows, before)
        step = np.sqrt(((centroids - before) ** 2).sum(1).astype(float))
        radius, moved = radius + step, step > 0
    return Clusters(centroids, assigned(rows, Balls.of(centroids, radius, moved)))


def digests(found: Clusters) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that counts."""
    members = kept(found.members.select("vec_id", "cluster", "distance"))
    spark = members.sparkSession
    # a row for each cluster
    totals = {r["cluster"]: int(r["sum"]) for r in members.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20, 0)")).alias("sum")).collect()}
    whole = sum(totals.values())
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    named = spark.createDataFrame([(i, n, whole, sha[i]) for i, n in sorted(totals.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # at most k rows are broadcast
    return members.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
