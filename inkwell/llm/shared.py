"""Checkpoints and connected components for the iterative operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only in a local session without a name, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints"))
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder, with their lineage cut.

    Written as a table, so what comes after reads only the columns it names.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def parts_for(texts: DataFrame, part_bytes: int) -> int:
    """How many parts records of the column text are dealt to: those of the session, more where the bytes ask for them."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // part_bytes))


def sampled(ids: DataFrame, kind: str, rows: int, most: int) -> DataFrame:
    """The first ``rows`` ids by hash of each kind of ``ids`` (id and kind); an error if there are over ``most`` kinds.

    A threshold on the hash, from the kinds' numbers of different ids, leaves
    about twice as many as are wanted before these are ranked.
    """
    known = ids.where(F.col(kind).isNotNull())
    counts = known.groupBy(kind).agg(F.approx_count_distinct("id", 0.02).alias("ids_")).limit(most + 1)
    found = [(r[0], min(1.0, (2 * rows + 100) / max(r[1], 1)) * (1 << 30)) for r in counts.collect()]
    if len(found) > most:
        raise ValueError(f"column {kind} has over {most} different values")
    limits = ids.sparkSession.createDataFrame(found, f"{kind} {dict(ids.dtypes)[kind]}, limit_ double")
    order = Window.partitionBy(kind).orderBy(F.xxhash64("id"), "id")
    # at most ``most`` rows are broadcast
    near = known.join(F.broadcast(limits), kind).where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= F.col("limit_")).select("id", kind).distinct()
    return near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows).drop("n")


def sampled_texts(texts: DataFrame, kind: str, rows: int, most: int) -> DataFrame:
    """turn, the kind, id, text and copies of at most ``rows`` different rows of each kind (of columns id, kind and text), the first by hash.

    Ids are chosen first, then rows among theirs, so neither an id with many rows nor
    a kind with many crowds others out; equal rows are one, with their number.
    """
    # at most ``rows`` ids of each kind, then as many rows, are broadcast
    near = texts.join(F.broadcast(sampled(texts.select("id", kind), kind, rows, most)), ["id", kind]).withColumn("turn", F.xxhash64("id", "text"))
    few = sampled(near.select(F.col("turn").alias("id"), kind), kind, rows, most).withColumnRenamed("id", "turn")
    return near.join(F.broadcast(few), ["turn", kind]).groupBy("turn", kind).agg(F.min("id").alias("id"), F.min("text").alias("text"), F.count("*").alias("copies"))


MARKS = 1 << 24


def marks(rows: DataFrame, key: str) -> DataFrame:
    """A bitmap of MARKS bits with the rows' keys, as at most MARKS / 32768 rows of 4 kB: a filter that lets few others pass."""
    bit = F.pmod(key, F.lit(MARKS))
    return rows.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))


def marked(rows: DataFrame, bitmap: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose bit is set, and the others; ``rows`` has no columns bucket and bits."""
    bit = F.pmod(key, F.lit(MARKS))
    place = F.bitmap_bit_position(bit)
    # 2 MB at most are broadcast
    found = rows.join(F.broadcast(bitmap), F.bitmap_bucket_number(bit) == F.col("bucket"), "left")
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1, F.lit(False))
    names = rows.columns
    return found.where(is_set).select(names), found.where(~is_set).select(names)


def connected(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph: (node, label), label the smallest node of the component.

    ``edges`` has two long columns, in any order, repeats allowed; only nodes
    with an edge to another node are returned. Each round first hangs every
    larger neighbour of a node on its smallest neighbour, then every node's
    smaller neighbours on their smallest one, so the rounds grow with the
    logarithm of the longest path. Rounds are tables in the shared folder;
    nothing but two sums reaches the driver.
    """
    a, b = edges.columns
    now = kept(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.expr("sum(cast(xxhash64(hi, lo) as decimal(38, 0)))")).first())

    seen = mark(now)
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo"))
        now = kept(small.where("hi <> lo").distinct())
        if (found := mark(now)) == seen:
            break
        seen = found
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("label")).union(now.select("lo", "lo").distinct())
