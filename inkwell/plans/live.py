"""Queries that run streams over the events table until what is there is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.shared import fresh_folder
from inkwell.streaming import live

from .registry import Register

Q = Register()
#: Events in a file of a batch that is dealt out.
BATCH_FILE = 250_000
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Events as answers of models that arrive."""
    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(d)
    return stream.select(F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("client"), F.col("event_type").alias("model"), F.col("value").alias("latency"), (F.get_json_object("props", "$.k").cast("long") / 100).alias("score"))


@Q.add("stream_late_split", "SELECT event_id AS seq, CASE WHEN value > 100 THEN 'timeout' ELSE 'success' END AS status, CASE WHEN value <= 100 THEN json_extract_string(props, '$.k')::BIGINT / 100 END AS score FROM events")
def late(spark: SparkSession, d: str) -> DataFrame:
    scored, _ = live.split_late(answers(spark, d), 100.0)
    return live.to_table(spark, scored.select("seq", "status", "score"), "append", fresh_folder(spark, "stream"))


@Q.add("stream_traces", "SELECT event_id AS seq, CASE WHEN value > 100 THEN 'late_after_timeout' ELSE 'on_time' END AS timing FROM events")
def traces(spark: SparkSession, d: str) -> DataFrame:
    _, trace = live.split_late(answers(spark, d), 100.0)
    return live.to_table(spark, trace.select("seq", "timing"), "append", fresh_folder(spark, "stream"))


@Q.add("stream_running_summary", "SELECT event_type AS model, count(*) AS documents, count(*) FILTER (WHERE value <= 100) AS success, CAST(sum(CASE WHEN value <= 100 THEN json_extract_string(props, '$.k')::BIGINT END) / 100 AS DOUBLE) AS score FROM events GROUP BY event_type")
def running(spark: SparkSession, d: str) -> DataFrame:
    scored, _ = live.split_late(answers(spark, d), 100.0)
    return live.to_table(spark, live.running_summary(scored), "complete", fresh_folder(spark, "stream")).withColumn("score", F.col("score").cast("double"))


@Q.add("stream_queue_state", "SELECT user_id AS client, arg_max(event_type, event_id) AS model, arg_max(value, event_id) FILTER (WHERE value > 50) AS latency FROM events GROUP BY user_id")
def queue(spark: SparkSession, d: str) -> DataFrame:
    """A later event without a latency leaves the earlier one."""
    rows = answers(spark, d).withColumn("latency", F.when(F.col("latency") > 50, F.col("latency")))
    state = live.queue_state(rows, "client", "seq", ["model", "latency"])
    return live.to_table(spark, state, "complete", fresh_folder(spark, "stream"))


@Q.add("stream_error_cutoff", "SELECT client, seq, status FROM (SELECT *, sum((status <> 'success')::INT) OVER (PARTITION BY client ORDER BY seq ROWS UNBOUNDED PRECEDING) - (status <> 'success')::INT AS b FROM (SELECT user_id AS client, event_id AS seq, CASE WHEN value > 100 THEN 'timeout' ELSE 'success' END AS status FROM events)) WHERE b < 3")
def cutoff(spark: SparkSession, d: str) -> DataFrame:
    scored, _ = live.split_late(answers(spark, d), 100.0)
    return live.to_table(spark, live.until_errors(scored.select("client", "seq", "status"), "client", "seq", 3), "append", fresh_folder(spark, "stream"))


@Q.add("k5_checkpoint", "SELECT event_id AS seq, CASE WHEN value > 100 THEN 'timeout' ELSE 'success' END AS status FROM events")
def checkpoint(spark: SparkSession, d: str) -> DataFrame:
    """A run that stops and goes on from its checkpoint: every result is written once."""
    folder = fresh_folder(spark, "stream")
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("seq"), F.col("value").alias("latency"), F.lit(1.0).alias("score"))
    for half in (0, 1):
        rows.where(F.pmod("seq", F.lit(2)) == half).write.mode("append").parquet(f"{folder}/in")
        scored, _ = live.split_late(spark.readStream.schema("seq long, latency double, score double").parquet(f"{folder}/in"), 100.0)
        out = live.to_table(spark, scored.select("seq", "status"), "append", folder)
    return out


@Q.add("stream_window_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type AS model, count(*) AS n FROM events GROUP BY ALL")
def windows(spark: SparkSession, d: str) -> DataFrame:
    return live.to_table(spark, live.per_window(answers(spark, d), "ts", "1 day", "40 days"), "complete", fresh_folder(spark, "stream"))


@Q.add("stream_error_cutoff_unordered", "SELECT client, seq, status FROM (SELECT *, sum((status <> 'success')::INT) OVER (PARTITION BY client ORDER BY seq ROWS UNBOUNDED PRECEDING) - (status <> 'success')::INT AS b FROM (SELECT user_id AS client, event_id AS seq, CASE WHEN value > 100 THEN 'timeout' ELSE 'success' END AS status FROM events)) WHERE b < 3")
def unordered(spark: SparkSession, d: str) -> DataFrame:
    """The cut-off over events that come in any order: an event is dealt to its own batch or the next but one, a closing one ends the stream."""
    folder, rows = fresh_folder(spark, "stream"), answers_once(spark, d)
    batches, schema = 4, "client long, seq long, at timestamp, status string"
    ends = rows.agg(F.min("seq").alias("least"), F.max("seq").alias("most"), F.count("*").alias("n")).first()
    # numbers stand for seconds: how far events stray is then known
    own = F.floor((F.col("seq") - F.lit(ends.least)) * batches / F.lit((ends.most or 0) - (ends.least or 0) + 1)) + F.pmod(F.xxhash64("seq"), F.lit(3))
    dealt = rows.select("client", "seq", F.timestamp_seconds(F.col("seq") + 1_000_000_000).alias("at"), "status").withColumn("batch", own)
    stray = 3 * ((ends.most or 0) - (ends.least or 0) + batches) // batches + 1
    # a batch is as many files as its rows ask for; in whatever groups these are read, events stray no further
    files = max(1, -(-ends.n // (batches * BATCH_FILE)))
    for i in range(batches + 3):
        dealt.where(F.col("batch") == i).drop("batch").repartition(files).write.mode("append").parquet(f"{folder}/in/{i:02d}")
    closing = spark.range(1).select(F.lit(-1).cast("long").alias("client"), F.lit(0).cast("long").alias("seq"), F.timestamp_seconds(F.lit(1_000_000_000 + (ends.most or 0) + 2 * stray)).alias("at"), F.lit("success").alias("status"))
    closing.write.parquet(f"{folder}/in/99")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in/*")
    out = live.to_table(spark, live.until_errors_unordered(stream, "client", "seq", "at", f"{stray} seconds", 3), "append", folder)
    return out.where("client >= 0").select("client", "seq", "status")


def answers_once(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet")
    return rows.select(F.col("user_id").alias("client"), F.col("event_id").alias("seq"), F.when(F.col("value") > 100, "timeout").otherwise("success").alias("status"))


IMPORT_STATES = ["discovered", "documents_detected", "downloaded", "label_normalized", "ready", "ready_without_label", "failed"]
_LEGAL = ", ".join(f"('{a}', '{b}')" for a, bs in live.FOLLOWS.items() for b in bs)


@Q.add(
    "stream_import_states",
    f"""WITH RECURSIVE raw AS (SELECT user_id AS client, event_id AS seq, {IMPORT_STATES}[CASE WHEN event_id % 3 = 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 ELSE (event_id // 7) % 5 END + 1] AS status FROM events),
twice AS (SELECT *, 0 AS copy FROM raw UNION ALL SELECT *, 1 FROM raw WHERE seq % 5 = 0), told AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY seq, copy) AS n FROM twice),
legal(before, after) AS (VALUES {_LEGAL}),
walk AS (SELECT DISTINCT client, 0::BIGINT AS n, NULL::BIGINT AS seq, '' AS status, '' AS verdict, '' AS state FROM raw UNION ALL
SELECT client, n, seq, status, verdict, CASE WHEN verdict = 'accepted' THEN status ELSE before END FROM (SELECT t.client, t.n, t.seq, t.status, w.state AS before, CASE WHEN t.copy = 1 THEN 'repeated' WHEN (w.state, t.status) IN (SELECT (before, after) FROM legal) THEN 'accepted' ELSE 'illegal' END AS verdict FROM walk w JOIN told t ON t.client = w.client AND t.n = w.n + 1))
SELECT client, seq, status, verdict, state FROM walk WHERE n > 0""",
)
def import_states(spark: SparkSession, d: str) -> DataFrame:
    """Every third event is a state at random, every fifth comes twice: the accepted and the refused, as the stream parts them."""
    k = F.get_json_object("props", "$.k").cast("long")
    turn = F.when(F.pmod("event_id", F.lit(3)) == 0, F.pmod(k, F.lit(7))).otherwise(F.pmod(F.floor(F.col("event_id") / 7), F.lit(5)))
    status = F.element_at(F.array(*[F.lit(s) for s in IMPORT_STATES]), (turn + 1).cast("int"))
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(d).select(F.col("user_id").alias("client"), F.col("event_id").alias("seq"), status.alias("status"))
    twice = rows.withColumn("copy", F.explode(F.when(F.pmod("seq", F.lit(5)) == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy")
    return live.to_parted_table(spark, live.import_states(twice, "client", "seq", "status"), "verdict", fresh_folder(spark, "stream"))
