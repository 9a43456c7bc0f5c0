"""Queries over a run's results: summaries, rankings, filters, samples, views, running state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import measures
from inkwell.operators import joins, selection, summary, views

from . import frames
from .registry import Register, round_sql, rounded

Q = Register()
RES, SUM = frames.RESULTS_SQL, frames.SUMMARY_SQL
NAMES = frames.SUMMARY_COLUMNS


def add_sql(name: str, sql: str, with_: str = RES):
    return Q.add(name, f"WITH {with_} {sql}")


def summed(spark: SparkSession, d: str) -> DataFrame:
    return summary.model_summary(frames.results(spark, d))


@add_sql("a1_model_summary", f"SELECT model, first, documents, output_tokens, {round_sql(*NAMES)} FROM summary", SUM)
def a1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summed(spark, d), *NAMES)


@add_sql("a2_device_list", "SELECT model, string_agg(DISTINCT device, ', ' ORDER BY device) FILTER (WHERE device <> '') AS devices FROM results GROUP BY model")
def a2(spark: SparkSession, d: str) -> DataFrame:
    return summary.devices(frames.results(spark, d))


@add_sql("a3_category_quality", "SELECT model, category, round(avg(accuracy), 6) AS quality FROM results WHERE status = 'success' GROUP BY ALL")
def a3(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summary.mean_by(frames.results(spark, d), ["model", "category"], "accuracy", "quality", True), "quality")


@add_sql("a3_quality_rollup", "SELECT model, category, round(avg(accuracy), 6) AS quality, count(*) AS documents FROM results WHERE status = 'success' GROUP BY ROLLUP (model, category)")
def a3_rollup(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summary.rollup_quality(frames.results(spark, d)), "quality")


@add_sql("a4_cni_accuracy", "SELECT model, round(avg(accuracy), 6) AS accuracy FROM results WHERE accuracy IS NOT NULL GROUP BY model")
def a4(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summary.mean_by(frames.results(spark, d).where("accuracy is not null"), ["model"], "accuracy", "accuracy", False), "accuracy")


@add_sql("a5_cni_latency", "SELECT model, round(avg(latency), 6) AS latency FROM results GROUP BY model")
def a5(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summary.mean_by(frames.results(spark, d), ["model"], "latency", "latency", False), "latency")


@add_sql("a6_reliability", "SELECT model, round(success_rate * 100, 6) AS success_percent, round(100 - success_rate * 100, 6) AS failed_percent FROM summary", SUM)
def a6(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summary.reliability(summed(spark, d)), "success_percent", "failed_percent")


@add_sql("a7_quality_speed", "SELECT model, round(latency_mean, 6) AS latency_mean, round(quality * 100, 6) AS quality_percent FROM summary WHERE latency_mean IS NOT NULL AND quality IS NOT NULL", SUM)
def a7(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summary.quality_speed(summed(spark, d)), "latency_mean", "quality_percent")


@add_sql("a8_latency_long", "SELECT model, measure, round(seconds, 6) AS seconds FROM (SELECT model, latency_mean, latency_median, latency_p95 FROM summary) UNPIVOT (seconds FOR measure IN (latency_mean, latency_median, latency_p95))", SUM)
def a8(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summary.latency_long(summed(spark, d)), "seconds")


@add_sql("a9_category_counts", "SELECT category, count(*) AS n, 3 * count(*) AS evaluations FROM cases GROUP BY category", frames.CASES_SQL)
def a9(spark: SparkSession, d: str) -> DataFrame:
    return frames.cases(spark, d).groupBy("category").agg(F.count("*").alias("n")).withColumn("evaluations", F.col("n") * len(frames.MODELS))


NOTE = "notes AS (SELECT model, count(*) AS documents, avg((status = 'success')::INT) AS success_rate, avg(latency) AS latency_mean, quantile_cont(latency, 0.95) AS latency_p95, avg(cer) AS cer, avg(wer) AS wer, avg(exact::INT) AS exact_match FROM results GROUP BY model)"
NOTE_NAMES = ["success_rate", "latency_mean", "latency_p95", "cer", "wer", "exact_match"]


@add_sql("a10_colab_summary", f"SELECT model, documents, {round_sql(*NOTE_NAMES)} FROM notes", f"{RES}, {NOTE}")
def a10(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summary.notebook_summary(frames.results(spark, d)), *NOTE_NAMES)


@Q.add("a11_value_counts", "SELECT source AS category, count(*) AS n FROM documents GROUP BY source")
def a11(spark: SparkSession, d: str) -> DataFrame:
    return frames.table(spark, d, "documents").groupBy(F.col("source").alias("category")).agg(F.count("*").alias("n"))


STATES = ["discovered", "documents_detected", "downloaded", "label_normalized", "ready", "ready_without_label", "failed"]
QUEUE = "queue AS (SELECT client, seq, ['discovered','documents_detected','downloaded','label_normalized','ready','ready_without_label','failed'][k % 7 + 1] AS state, k % 2 = 0 AS picked FROM raw), last AS (SELECT client, arg_max(state, seq) AS state, arg_max(picked, seq) AS picked FROM queue GROUP BY client)"


def queue(spark: SparkSession, d: str) -> DataFrame:
    """Each client's last state in the import queue."""
    rows = frames.results(spark, d).withColumn("state", F.element_at(F.array(*[F.lit(s) for s in STATES]), (F.pmod("k", F.lit(7)) + 1).cast("int"))).withColumn("picked", F.pmod("k", F.lit(2)) == 0)
    return joins.latest(rows, "client", "seq", ["state", "picked"])


@add_sql("a12_queue_counts", "SELECT count(*) FILTER (WHERE state IN ('ready', 'ready_without_label')) AS ready, count(*) FILTER (WHERE state IN ('discovered', 'documents_detected', 'downloaded', 'label_normalized')) AS waiting, count(*) FILTER (WHERE state = 'failed') AS failed, count(*) FILTER (WHERE picked) AS selected FROM last", f"{RES}, {QUEUE}")
def a12(spark: SparkSession, d: str) -> DataFrame:
    return views.queue_counts(queue(spark, d))


@add_sql("a13_scan_counts", "SELECT count(*) FILTER (WHERE status = 'ready') AS ready, count(*) FILTER (WHERE label_status = 'label_materialized') AS labels, count(*) FILTER (WHERE status = 'ready' AND label_status <> 'label_materialized') AS unlabeled FROM clients", frames.CLIENTS_SQL)
def a13(spark: SparkSession, d: str) -> DataFrame:
    return views.scan_counts(frames.clients(spark, d))


@add_sql("a14_box_stats", f"SELECT model, {round_sql('q1', 'q2', 'q3')}, low, high FROM (SELECT model, quantile_cont(latency, 0.25) AS q1, quantile_cont(latency, 0.5) AS q2, quantile_cont(latency, 0.75) AS q3, min(latency) AS low, max(latency) AS high FROM results GROUP BY model)")
def a14(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summary.quartiles(frames.results(spark, d)), "q1", "q2", "q3")


FILES = "files AS (SELECT event_id, user_id AS client, CASE WHEN event_type IN ('view', 'click') THEN 'recto' ELSE 'verso' END AS side, 'in/' || user_id || '/' || event_id || '.png' AS path FROM events)"


def files(spark: SparkSession, d: str) -> DataFrame:
    side = F.when(F.col("event_type").isin("view", "click"), "recto").otherwise("verso")
    path = F.concat(F.lit("in/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_id").cast("string"), F.lit(".png"))
    return frames.table(spark, d, "events").select("event_id", F.col("user_id").alias("client"), side.alias("side"), path.alias("path"))


@add_sql("a15_folder_pivot", "SELECT client, r AS recto_source, v AS verso_source, array_to_string(list_filter([CASE WHEN r IS NULL THEN 'missing_recto' END, CASE WHEN v IS NULL THEN 'missing_verso' END, CASE WHEN nr > 1 THEN 'duplicate_recto' END, CASE WHEN nv > 1 THEN 'duplicate_verso' END], lambda x: x IS NOT NULL), ',') AS issues, CASE WHEN r IS NOT NULL AND v IS NOT NULL THEN 'ready' ELSE 'incomplete' END AS status FROM (SELECT client, min(path) FILTER (WHERE side = 'recto') AS r, min(path) FILTER (WHERE side = 'verso') AS v, count(*) FILTER (WHERE side = 'recto') AS nr, count(*) FILTER (WHERE side = 'verso') AS nv FROM files GROUP BY client)", FILES)
def a15(spark: SparkSession, d: str) -> DataFrame:
    return joins.sides(files(spark, d), "client", "side").withColumn("issues", F.array_join("issues", ","))


@add_sql("a16_distinct_models", "SELECT model, min(seq) AS first FROM results GROUP BY model")
def a16(spark: SparkSession, d: str) -> DataFrame:
    return frames.results(spark, d).groupBy("model").agg(F.min("seq").alias("first"))


@add_sql("a17_failed_counters", "SELECT model, count(*) AS processed, count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status <> 'success') AS errors FROM results GROUP BY model")
def a17(spark: SparkSession, d: str) -> DataFrame:
    return frames.results(spark, d).groupBy("model").agg(F.count("*").alias("processed"), F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") != "success").alias("errors"))


# Running views


@add_sql("w1_live_tail", "SELECT seq, model, image_path, status, position FROM (SELECT *, row_number() OVER (ORDER BY seq) AS position, count(*) OVER () AS n FROM results) WHERE position > n - 25")
def w1(spark: SparkSession, d: str) -> DataFrame:
    return summary.live_tail(frames.results(spark, d)).select("seq", "model", "image_path", "status", "position")


@add_sql("w2_progress", 'SELECT client, seq, done, total, elapsed, elapsed / done * (total - done) AS "left", errors FROM (SELECT client, seq, row_number() OVER w AS done, count(*) OVER (PARTITION BY client) AS total, CAST(sum(latency::DECIMAL(18, 4)) OVER w AS DOUBLE) AS elapsed, CAST(sum((status <> \'success\')::INT) OVER w AS BIGINT) AS errors FROM results WINDOW w AS (PARTITION BY client ORDER BY seq ROWS UNBOUNDED PRECEDING))')
def w2(spark: SparkSession, d: str) -> DataFrame:
    return summary.progress(frames.results(spark, d), ["client"])


@add_sql("w3_error_cutoff", "SELECT client, seq, status FROM (SELECT *, sum((status <> 'success')::INT) OVER (PARTITION BY client ORDER BY seq ROWS UNBOUNDED PRECEDING) - (status <> 'success')::INT AS b FROM results) WHERE b < 3")
def w3(spark: SparkSession, d: str) -> DataFrame:
    return summary.until_errors(frames.results(spark, d), ["client"], 3).select("client", "seq", "status")


@add_sql("w4_running_summary", "SELECT model, seq, count(*) OVER w AS documents, (sum((status = 'success')::INT) OVER w)::DOUBLE / count(*) OVER w AS success_rate, (sum(accuracy::DECIMAL(18, 6)) OVER w)::DOUBLE / nullif(count(accuracy) OVER w, 0) AS quality FROM results WINDOW w AS (PARTITION BY model ORDER BY seq ROWS UNBOUNDED PRECEDING)")
def w4(spark: SparkSession, d: str) -> DataFrame:
    return summary.running_summary(frames.results(spark, d))


@add_sql("w5_duplicates", "SELECT client, side, path, row_number() OVER (PARTITION BY client, side ORDER BY path) > 1 AS duplicate FROM files", FILES)
def w5(spark: SparkSession, d: str) -> DataFrame:
    return views.duplicates(files(spark, d), ["client", "side"], "path")


BOXES = "boxes AS (SELECT l_orderkey AS page, l_linenumber AS id, CAST(l_quantity AS BIGINT) * 4 AS top, CAST(l_extendedprice AS BIGINT) % 500 AS \"left\", l_returnflag || l_linenumber AS text FROM lineitem)"


@Q.add("w6_line_cluster")
def w6(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of a page as lines of text: a fold, which SQL can't express; tested against plain Python."""
    t = frames.table(spark, d, "lineitem")
    boxes = t.select(F.col("l_orderkey").alias("page"), (F.col("l_quantity").cast("long") * 4).cast("double").alias("top"), F.pmod(F.col("l_extendedprice").cast("long"), F.lit(500)).cast("double").alias("left"), F.lit(10.0).alias("height"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("text"))
    return views.lines_of(boxes, "page")


@add_sql("w7_run_order", "SELECT run_id, row_number() OVER (ORDER BY run_id DESC) AS position FROM runs", "runs AS (SELECT DISTINCT strftime(ts, '%Y%m%d-%H%M%S') || '-' || lpad(lower(to_hex(user_id)), 8, '0') AS run_id FROM events)")
def w7(spark: SparkSession, d: str) -> DataFrame:
    return views.numbered(run_ids(spark, d), F.desc("run_id"), "run_id")


def run_ids(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.date_format("ts", "yyyyMMdd-HHmmss"), F.lit("-"), F.lower(F.lpad(F.hex("user_id"), 8, "0")))
    return frames.table(spark, d, "events").select(made.alias("run_id")).distinct()


# Rankings and samples


@add_sql("t1_recommend", "SELECT model FROM summary WHERE success_rate >= 0.90 AND quality IS NOT NULL ORDER BY quality DESC NULLS LAST, latency_p95 NULLS LAST, model LIMIT 1", SUM)
def t1(spark: SparkSession, d: str) -> DataFrame:
    return summary.recommended(summed(spark, d), 0.90).select("model")


@add_sql("t2_colab_best", "SELECT model FROM notes ORDER BY success_rate DESC NULLS LAST, cer NULLS LAST, latency_mean NULLS LAST, model LIMIT 1", f"{RES}, {NOTE}")
def t2(spark: SparkSession, d: str) -> DataFrame:
    return summary.notebook_best(summary.notebook_summary(frames.results(spark, d))).select("model")


@Q.add("t3_select_all", "SELECT doc_id, md5('42|' || doc_id) AS turn FROM documents")
def t3(spark: SparkSession, d: str) -> DataFrame:
    return frames.table(spark, d, "documents").select("doc_id", selection.shuffled(42, "doc_id").alias("turn")).orderBy("turn", "doc_id")


@Q.add("t4_global_quantity", "SELECT doc_id, lang FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 100")
def t4(spark: SparkSession, d: str) -> DataFrame:
    return selection.sample(frames.table(spark, d, "documents").select("doc_id", "lang"), 100, 42, "doc_id")


QUOTAS = [("en", 20), ("fr", 5), ("de", 1000)]


@Q.add("t5_per_category", "WITH q(lang, requested) AS (VALUES ('en', 20), ('fr', 5), ('de', 1000)), n AS (SELECT doc_id, lang, requested, row_number() OVER (PARTITION BY lang ORDER BY md5('7|' || doc_id), doc_id)::INT AS turn FROM documents JOIN q USING (lang)) SELECT doc_id, lang, turn FROM n WHERE turn <= requested")
def t5(spark: SparkSession, d: str) -> DataFrame:
    quotas = spark.createDataFrame(QUOTAS, "lang string, requested int")
    return selection.sample_by(frames.table(spark, d, "documents").select("doc_id", "lang"), quotas, 7, "doc_id", "lang")


@Q.add("t6_colab_select", "WITH q(c_mktsegment, requested) AS (VALUES ('BUILDING', 10), ('MACHINERY', 3)), n AS (SELECT c_custkey, c_mktsegment, requested, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('3|' || c_custkey), c_custkey)::INT AS turn FROM customer JOIN q USING (c_mktsegment)) SELECT c_custkey, c_mktsegment, turn FROM n WHERE turn <= requested")
def t6(spark: SparkSession, d: str) -> DataFrame:
    quotas = spark.createDataFrame([("BUILDING", 10), ("MACHINERY", 3)], "c_mktsegment string, requested int")
    return selection.sample_by(frames.table(spark, d, "customer").select("c_custkey", "c_mktsegment"), quotas, 3, "c_custkey", "c_mktsegment")


@Q.add("t7_first_20", "SELECT p_name || '-' || p_partkey || '.png' AS filename, p_type AS identity FROM part WHERE p_type IS NOT NULL AND trim(p_type) <> '' AND p_type <> 'ECONOMY' ORDER BY filename LIMIT 20")
def t7(spark: SparkSession, d: str) -> DataFrame:
    rows = frames.table(spark, d, "part").select(F.concat("p_name", F.lit("-"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("filename"), F.col("p_type").alias("identity"))
    return views.readable(rows, "identity", "ECONOMY").orderBy("filename").limit(20)


# Filters


@add_sql("f1_category_filter", "SELECT case_id, category FROM cases WHERE category = 'receipt'", frames.CASES_SQL)
def f1(spark: SparkSession, d: str) -> DataFrame:
    return selection.in_category(frames.cases(spark, d), "receipt").select("case_id", "category")


@add_sql("f2_ready_filter", "SELECT doc_id FROM clients WHERE status = 'ready'", frames.CLIENTS_SQL)
def f2(spark: SparkSession, d: str) -> DataFrame:
    return frames.clients(spark, d).where("status = 'ready'").select("doc_id")


@add_sql("f3_success_filter", "SELECT seq, model, accuracy FROM results WHERE status = 'success' AND accuracy IS NOT NULL")
def f3(spark: SparkSession, d: str) -> DataFrame:
    return frames.results(spark, d).where("status = 'success' and accuracy is not null").select("seq", "model", "accuracy")


@add_sql("f4_failure_filter", "SELECT seq, model, status FROM results WHERE status <> 'success'")
def f4(spark: SparkSession, d: str) -> DataFrame:
    return frames.results(spark, d).where("status <> 'success'").select("seq", "model", "status")


@add_sql("f5_accuracy_range", "SELECT seq, accuracy FROM results WHERE accuracy IS NULL OR accuracy * 100 BETWEEN 25 AND 75")
def f5(spark: SparkSession, d: str) -> DataFrame:
    return selection.accuracy_range(frames.results(spark, d), 75, 25, True).select("seq", "accuracy")


@add_sql("f6_label_gate", "SELECT doc_id, label_status FROM clients WHERE status = 'ready' AND label_status <> 'label_materialized'", frames.CLIENTS_SQL)
def f6(spark: SparkSession, d: str) -> DataFrame:
    return frames.clients(spark, d).where("status = 'ready' and label_status <> 'label_materialized'").select("doc_id", "label_status")


@add_sql("f7_qualified_candidates", f"SELECT model, {round_sql('success_rate', 'quality')} FROM summary WHERE success_rate >= 0.90 AND quality IS NOT NULL", SUM)
def f7(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summary.qualified(summed(spark, d), 0.90).select("model", "success_rate", "quality"), "success_rate", "quality")


@Q.add("f8_selection_mask", "SELECT c.c_custkey, c.c_name FROM customer c SEMI JOIN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') o ON c.c_custkey = o.o_custkey")
def f8(spark: SparkSession, d: str) -> DataFrame:
    mask = frames.table(spark, d, "orders").select(F.col("o_custkey").alias("position"), (F.col("o_orderstatus") == "F").alias("ticked"))
    return selection.at_mask(frames.table(spark, d, "customer").select(F.col("c_custkey").alias("position"), "c_name"), mask).select(F.col("position").alias("c_custkey"), "c_name")


@add_sql("f9_run_id_filter", "SELECT run_id, regexp_full_match(run_id, '(cni-)?\\d{8}-\\d{6}-[a-f0-9]{8}') AS valid FROM runs", "runs AS (SELECT DISTINCT CASE WHEN user_id % 5 = 0 THEN 'tmp' ELSE '' END || strftime(ts, '%Y%m%d-%H%M%S') || '-' || lpad(lower(to_hex(user_id)), 8, '0') AS run_id FROM events)")
def f9(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.when(F.pmod("user_id", F.lit(5)) == 0, "tmp").otherwise(""), F.date_format("ts", "yyyyMMdd-HHmmss"), F.lit("-"), F.lower(F.lpad(F.hex("user_id"), 8, "0")))
    return frames.table(spark, d, "events").select(made.alias("run_id")).distinct().withColumn("valid", F.col("run_id").rlike(selection.RUN_ID))


@Q.add("f10_retention", "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-31' - INTERVAL 10 DAY")
def f10(spark: SparkSession, d: str) -> DataFrame:
    return views.expired(frames.table(spark, d, "events"), "ts", "2024-01-31", 10).select("event_id")


@Q.add("f11_client_id_valid", "SELECT page_id, regexp_full_match(url, '[A-Za-z0-9][A-Za-z0-9._-]{0,127}') AS whole, regexp_full_match(regexp_replace(url, '^https?://|[/?#&=]', '', 'g'), '[A-Za-z0-9][A-Za-z0-9._-]{0,127}') AS flat FROM pages")
def f11(spark: SparkSession, d: str) -> DataFrame:
    flat = F.regexp_replace("url", "^https?://|[/?#&=]", "")
    return frames.table(spark, d, "pages").select("page_id", F.col("url").rlike(selection.CLIENT_ID).alias("whole"), flat.rlike(selection.CLIENT_ID).alias("flat"))


@Q.add("f12_readable_label", "SELECT p_partkey, p_type FROM part WHERE p_type IS NOT NULL AND trim(p_type) <> '' AND p_type <> 'ECONOMY'")
def f12(spark: SparkSession, d: str) -> DataFrame:
    return views.readable(frames.table(spark, d, "part").select("p_partkey", "p_type"), "p_type", "ECONOMY")


@Q.add("f13_host_allowlist", "SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) IN ('thther.example.org', 'therin.example.net') AS allowed, CASE WHEN url LIKE 'https:%' THEN 443 ELSE 80 END AS port FROM pages")
def f13(spark: SparkSession, d: str) -> DataFrame:
    return frames.table(spark, d, "pages").select("page_id", selection.host_allowed(F.col("url"), ["thther.example.org", "therin.example.net"]).alias("allowed"), selection.port(F.col("url")).alias("port"))


# Views


@add_sql("p1_live_table", "SELECT seq, model, regexp_extract(image_path, '[^/]+$') AS image, category, status, CASE WHEN accuracy IS NULL THEN 'N/A' ELSE printf('%.2f %%', accuracy * 100) END AS score, round(latency, 3) AS latency FROM results")
def p1(spark: SparkSession, d: str) -> DataFrame:
    return views.live_table(frames.results(spark, d))


@add_sql("p2_display_summary", "SELECT model, coalesce(printf('%.2f%%', quality * 100), '') AS quality, coalesce(printf('%.3f', latency_mean), '') AS latency FROM summary", SUM)
def p2(spark: SparkSession, d: str) -> DataFrame:
    return views.display_summary(summed(spark, d))


@add_sql("p3_cni_tables", "SELECT client, recto_source IS NOT NULL AS recto, verso_source IS NOT NULL AS verso, CASE WHEN recto_source IS NOT NULL AND verso_source IS NOT NULL THEN 'ready' ELSE 'incomplete' END AS status FROM (SELECT client, min(path) FILTER (WHERE side = 'recto') AS recto_source, min(path) FILTER (WHERE side = 'verso') AS verso_source FROM files GROUP BY client)", FILES)
def p3(spark: SparkSession, d: str) -> DataFrame:
    rows = joins.sides(files(spark, d), "client", "side")
    return rows.select("client", F.col("recto_source").isNotNull().alias("recto"), F.col("verso_source").isNotNull().alias("verso"), "status")


@add_sql("p4_status_labels", "SELECT client, state, CASE state WHEN 'discovered' THEN 'Découvert' WHEN 'documents_detected' THEN 'Documents détectés' WHEN 'downloaded' THEN 'Téléchargé' WHEN 'label_normalized' THEN 'Label normalisé' WHEN 'ready' THEN 'Prêt' WHEN 'ready_without_label' THEN 'Prêt sans label' WHEN 'failed' THEN 'Erreur' ELSE state END AS label FROM last", f"{RES}, {QUEUE}")
def p4(spark: SparkSession, d: str) -> DataFrame:
    return queue(spark, d).select("client", "state", views.state_label(F.col("state")).alias("label"))


@add_sql("p5_source_choices", "SELECT client, side, path FROM (SELECT client, min(path) FILTER (WHERE side = 'recto') AS recto, min(path) FILTER (WHERE side = 'verso') AS verso FROM files GROUP BY client) UNPIVOT (path FOR side IN (recto, verso))", FILES)
def p5(spark: SparkSession, d: str) -> DataFrame:
    rows = joins.sides(files(spark, d), "client", "side").select("client", F.col("recto_source").alias("recto"), F.col("verso_source").alias("verso"))
    return rows.unpivot("client", ["recto", "verso"], "side", "path").where("path is not null")


@Q.add("p6_duration_format", "SELECT event_id, lpad((s // 3600)::VARCHAR, 2, '0') || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS duration FROM (SELECT event_id, floor(value * 60)::BIGINT AS s FROM events)")
def p6(spark: SparkSession, d: str) -> DataFrame:
    return frames.table(spark, d, "events").select("event_id", measures.duration(F.col("value") * 60).alias("duration"))


@Q.add("p7_customer_table", "SELECT c_custkey, c_name, coalesce(nullif(c_mktsegment, 'BUILDING'), n_name) AS agency FROM customer JOIN nation ON c_nationkey = n_nationkey")
def p7(spark: SparkSession, d: str) -> DataFrame:
    nation = frames.table(spark, d, "nation")
    rows = frames.table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", "c_name", F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), "n_name").alias("agency"))


@add_sql("p8_hidden_columns", "SELECT seq, model, status, latency FROM results")
def p8(spark: SparkSession, d: str) -> DataFrame:
    rows = frames.results(spark, d)
    return rows.drop(*[c for c in rows.columns if c not in ("seq", "model", "status", "latency")])


@add_sql("p9_prev_next", "SELECT seq, client, greatest(least(position + 1, n - 1), 0) AS next, greatest(least(position - 1, n - 1), 0) AS previous FROM (SELECT seq, client, row_number() OVER (PARTITION BY client ORDER BY seq) - 1 AS position, count(*) OVER (PARTITION BY client) AS n FROM results)")
def p9(spark: SparkSession, d: str) -> DataFrame:
    return views.neighbours(frames.results(spark, d), "client", "seq")
