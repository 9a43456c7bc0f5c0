"""The domain's frames on the test tables, in Spark and as SQL for the comparison.

``scored`` crosses the benchmark's texts with three mock models and scores every
whole text. ``results`` reads each event as one result of a run: the event type
is the model, the value the latency, the rest follows from its number k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import strings, text
from inkwell.operators import joins

MODELS = [(1, "mock-strong", 5), (2, "mock-fair", 15), (3, "mock-weak", 40)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Narrow rows dealt out by key to all cores, before work that costs far more than moving them.

    The number of parts is said, as adaptive execution would put few bytes together into one task.
    """
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("receipt"), F.lit("table"), F.lit("note")), (F.pmod("item_id", F.lit(3)) + 1).cast("int"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("ground_truth"), F.concat(F.lit("/scans/"), F.col("item_id").cast("string"), F.lit(".png")).alias("image_path"), kind.alias("category"))


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, "m long, model string, k long")


def inferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = joins.model_cases(models(spark), cases(spark, sf_dir))
    latency = 0.3 + F.pmod(F.col("case_id") * 37 + F.col("m") * 11, F.lit(900)) / 1000
    status = F.when(F.pmod(F.col("case_id") * 7 + F.col("m"), F.lit(23)) == 0, "failed").when(latency > 1.1, "timeout").otherwise("success")
    return rows.withColumns({"extracted": strings.corrupted(F.col("ground_truth"), F.col("case_id"), F.col("m"), F.col("k")), "latency": latency, "status": status, "seq": F.col("m") * 1_000_000 + F.col("case_id")})


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inferences with the standard scores; failed and late ones have none."""
    rows = inferences(spark, sf_dir)
    scores = text.standard_scores(F.col("ground_truth"), F.col("extracted"))
    return rows.withColumns({n: F.when(F.col("status") == "success", c) for n, c in scores.items()})


CASES_SQL = """models(m, model, k) AS (VALUES (1, 'mock-strong', 5), (2, 'mock-fair', 15), (3, 'mock-weak', 40)),
cases AS (SELECT item_id AS case_id, text AS ground_truth, '/scans/' || item_id || '.png' AS image_path, CASE item_id % 3 WHEN 0 THEN 'receipt' WHEN 1 THEN 'table' ELSE 'note' END AS category FROM benchmark),
words AS (SELECT *, regexp_split_to_array(ground_truth, '\\s+') AS w FROM cases),
inferences AS (SELECT model, m, case_id, ground_truth, image_path, category, m * 1000000 + case_id AS seq,
  array_to_string(list_transform(list_filter(range(len(w)), lambda i: (case_id * 31 + i * 17 + m * 7) % 100 >= k / 2),
    lambda i: CASE WHEN (case_id * 13 + i * 29 + m * 11) % 100 < k THEN translate(w[i + 1], 'bghnuvzBDZ', '6qbrvu2802') ELSE w[i + 1] END), ' ') AS extracted,
  0.3::DOUBLE + ((case_id * 37 + m * 11) % 900) / 1000.0::DOUBLE AS latency,
  CASE WHEN (case_id * 7 + m) % 23 = 0 THEN 'failed' WHEN 0.3::DOUBLE + ((case_id * 37 + m * 11) % 900) / 1000.0::DOUBLE > 1.1 THEN 'timeout' ELSE 'success' END AS status
  FROM words, models)"""


def normal_sql(column: str) -> str:
    """Normalised, with each letter outside ASCII as one free ASCII character: DuckDB's edit distance counts bytes."""
    return f"translate(trim(regexp_replace(regexp_replace(lower({column}), '[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}]', '', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g')), 'ßäçèéêíñóöü', '!#%&()*+;<=')"


SCORED_SQL = (
    CASES_SQL
    + f""",
normal AS (SELECT *, {normal_sql('ground_truth')} AS r, {normal_sql('extracted')} AS h FROM inferences),
listed AS (SELECT *, CASE WHEN r = '' THEN [] ELSE string_split(r, ' ') END AS rw, CASE WHEN h = '' THEN [] ELSE string_split(h, ' ') END AS hw FROM normal),
known AS (SELECT *, list_distinct(list_concat(rw, hw)) AS d FROM listed),
rates AS (SELECT *,
  CASE WHEN r = '' THEN CASE WHEN h = '' THEN 0.0 ELSE 1.0 END ELSE levenshtein(r, h)::DOUBLE / length(r) END AS cer_all,
  CASE WHEN len(rw) = 0 THEN CASE WHEN len(hw) = 0 THEN 0.0 ELSE 1.0 END ELSE levenshtein(array_to_string(list_transform(rw, lambda x: chr(list_position(d, x)::INT)), ''), array_to_string(list_transform(hw, lambda x: chr(list_position(d, x)::INT)), ''))::DOUBLE / len(rw) END AS wer_all
  FROM known),
scored AS (SELECT model, m, case_id, ground_truth, extracted, image_path, category, seq, latency, status, r, h, cer_all, wer_all,
  CASE WHEN status = 'success' THEN cer_all END AS cer, CASE WHEN status = 'success' THEN wer_all END AS wer,
  CASE WHEN status = 'success' THEN greatest(0.0, 1 - cer_all) END AS accuracy FROM rates)"""
)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of as many results as there are events."""
    k = F.get_json_object("props", "$.k").cast("long")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("model"), F.col("user_id").alias("client"), "ts", F.col("value").alias("latency"), k.alias("k"))
    ok = F.col("status") == "success"
    rows = rows.withColumn("status", F.when(F.col("latency") > 150, "timeout").when(F.pmod("k", F.lit(17)) == 0, "failed").otherwise("success"))
    share = F.col("k") / 100.0
    pick = lambda n, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.pmod("k", F.lit(n)) + 1).cast("int"))
    return rows.select(
        "*",
        F.concat(F.lit("/data/"), F.col("client").cast("string"), F.lit("/"), F.col("seq").cast("string"), F.lit(".png")).alias("image_path"),
        pick(5, "form", "invoice", "note", "receipt", "table").alias("category"),
        F.when(ok, share).alias("accuracy"),
        F.when(ok, 1 - share).alias("cer"),
        F.when(ok, (1 - share) * 1.5).alias("wer"),
        F.when(F.pmod("k", F.lit(7)) != 0, F.col("k") * 3).alias("output_tokens"),
        F.when(F.pmod("k", F.lit(7)) != 0, F.try_divide(F.col("k") * 3.0, F.col("latency"))).alias("tokens_per_second"),
        pick(4, "", "cpu", "cuda", "mps").alias("device"),
        F.when(F.pmod("k", F.lit(3)) > 0, (F.pmod("k", F.lit(3)) - 1).cast("double")).alias("table_score"),
        F.when(F.pmod("k", F.lit(4)) > 1, (F.pmod("k", F.lit(4)) - 2).cast("double")).alias("math_score"),
        F.when(F.pmod("k", F.lit(6)) > 0, F.pmod("k", F.lit(6)) / 5.0).alias("iban_emr"),
        F.when(F.pmod("k", F.lit(8)) > 0, F.pmod("k", F.lit(8)) / 7.0).alias("amount_emr"),
        (F.col("k") == 99).alias("exact"),
    )


RESULTS_SQL = """raw AS (SELECT event_id AS seq, event_type AS model, user_id AS client, ts, value AS latency, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
marked AS (SELECT *, CASE WHEN latency > 150 THEN 'timeout' WHEN k % 17 = 0 THEN 'failed' ELSE 'success' END AS status FROM raw),
results AS (SELECT *, '/data/' || client || '/' || seq || '.png' AS image_path, ['form','invoice','note','receipt','table'][k % 5 + 1] AS category,
  CASE WHEN status = 'success' THEN k / 100.0::DOUBLE END AS accuracy, CASE WHEN status = 'success' THEN 1 - k / 100.0::DOUBLE END AS cer, CASE WHEN status = 'success' THEN (1 - k / 100.0::DOUBLE) * 1.5 END AS wer,
  CASE WHEN k % 7 <> 0 THEN k * 3 END AS output_tokens, CASE WHEN k % 7 <> 0 AND latency <> 0 THEN k * 3.0::DOUBLE / latency END AS tokens_per_second,
  ['','cpu','cuda','mps'][k % 4 + 1] AS device, CASE WHEN k % 3 > 0 THEN (k % 3 - 1)::DOUBLE END AS table_score, CASE WHEN k % 4 > 1 THEN (k % 4 - 2)::DOUBLE END AS math_score,
  CASE WHEN k % 6 > 0 THEN (k % 6) / 5.0::DOUBLE END AS iban_emr, CASE WHEN k % 8 > 0 THEN (k % 8) / 7.0::DOUBLE END AS amount_emr, k = 99 AS exact FROM marked)"""

SUMMARY_COLUMNS = ["success_rate", "quality", "latency_mean", "latency_median", "latency_p95", "documents_per_second", "tokens_per_second", "cer", "wer", "table_score", "math_score", "iban_emr", "amount_emr"]
_ok = "FILTER (WHERE status = 'success')"
SUMMARY_SQL = (
    RESULTS_SQL
    + f""",
summary AS (SELECT model, min(seq) AS first, count(*) AS documents, avg(CASE WHEN status = 'success' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS success_rate, avg(accuracy) {_ok} AS quality, avg(latency) {_ok} AS latency_mean,
  median(latency) {_ok} AS latency_median, quantile_cont(latency, 0.95) {_ok} AS latency_p95, 1.0 / nullif(avg(latency) {_ok}, 0) AS documents_per_second, avg(tokens_per_second) {_ok} AS tokens_per_second,
  CAST(sum(output_tokens) {_ok} AS BIGINT) AS output_tokens, avg(cer) {_ok} AS cer, avg(wer) {_ok} AS wer, avg(table_score) {_ok} AS table_score, avg(math_score) {_ok} AS math_score, avg(iban_emr) {_ok} AS iban_emr, avg(amount_emr) {_ok} AS amount_emr
  FROM results GROUP BY model)"""
)


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label states of documents as a folder scan gives them."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").distinct()
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length("text").alias("bytes")).join(labels, "doc_id", "left")
    status = F.when(F.col("bytes") > 200, "ready").otherwise("incomplete")
    label = F.when(F.col("quality").isNull(), "label_not_found").when(F.col("quality") == 0, "label_parse_failed").otherwise("label_materialized")
    return rows.select("doc_id", "source", status.alias("status"), label.alias("label_status"))


CLIENTS_SQL = """clients AS (SELECT d.doc_id, d.source, CASE WHEN strlen(d.text) > 200 THEN 'ready' ELSE 'incomplete' END AS status,
  CASE WHEN l.quality IS NULL THEN 'label_not_found' WHEN l.quality = 0 THEN 'label_parse_failed' ELSE 'label_materialized' END AS label_status
  FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels) l USING (doc_id))"""
