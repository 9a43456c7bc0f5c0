"""Queries through files and models: each writes a table as the source has it, reads it back and goes on."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell import inference
from inkwell.operators import summary
from inkwell.shared import fresh_folder
from inkwell.sources import archives, files, sinks, taskfiles

from . import frames
from .registry import Register

Q = Register()
table = frames.table


@Q.add("s1_catalog_scan", "SELECT '/scans/' || item_id || '.png' AS image_path, text AS ground_truth, 'note' AS category, CASE WHEN item_id % 4 = 0 THEN 'ground_truth' ELSE '' END AS missing FROM benchmark WHERE item_id % 4 <> 0 UNION ALL SELECT '/scans/' || item_id || '.png', NULL, 'note', 'ground_truth' FROM benchmark WHERE item_id % 4 = 0")
def s1(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_folder(spark, "catalog")
    rows = table(spark, d, "benchmark").select(F.concat(F.lit("\\scans\\"), F.col("item_id").cast("string"), F.lit(".png")).alias("image_path"), F.when(F.pmod("item_id", F.lit(4)) != 0, F.col("text")).alias("ground_truth"), F.lit("note").alias("category"))
    rows.write.json(path)
    found = files.json_lines(spark, path, files.CATALOG)
    found = found.withColumn("image_path", F.translate("image_path", "\\", "/"))
    return found.select("image_path", "ground_truth", "category", F.array_join(files.missing_keys(found), ",").alias("missing"))


@Q.add("s2_jsonl_scan", "SELECT page_id, url, md5(html) AS html FROM pages")
def s2(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_folder(spark, "lines")
    table(spark, d, "pages").write.json(path)
    return files.json_lines(spark, path, "page_id long, url string, html string").withColumn("html", F.md5("html"))


@Q.add("s3_csv_scan", "SELECT doc_id, md5(replace(text, chr(13), '')) AS text, lang FROM documents")
def s3(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_folder(spark, "labels")
    table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\r"), F.lit("")).alias("text"), "lang").write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return files.csv_labels(spark, path, "doc_id long, text string, lang string").withColumn("text", F.md5("text"))


@Q.add("s4_json_nested_scan", "SELECT l_orderkey AS page, l_linenumber AS id, l_shipdate::DATE::VARCHAR AS text, (l_quantity)::INT AS top FROM lineitem")
def s4(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_folder(spark, "forms")
    box = F.array(F.lit(0), F.col("l_quantity").cast("int"), F.lit(9), F.lit(9))
    item = F.struct(box.alias("box"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("text"), F.col("l_linenumber").alias("id"))
    table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("form")).write.json(path)
    rows = spark.read.schema(f"l_orderkey long, {files.FORM}").json(path).select(F.col("l_orderkey").alias("page"), F.explode("form").alias("f"))
    return rows.select("page", "f.id", "f.text", F.col("f.box")[1].alias("top"))


@Q.add("s5_text_file_scan", "SELECT md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS text FROM benchmark")
def s5(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_folder(spark, "texts")
    table(spark, d, "benchmark").select("text", F.col("item_id").alias("item")).write.partitionBy("item").text(path, lineSep="\n\n")
    return files.text_files(spark, f"{path}/*").select(F.md5("text").alias("text"))


@Q.add("s6_folder_scan", "SELECT item_id::VARCHAR AS client, 'recto' AS recto, CASE WHEN item_id % 2 = 0 THEN 'verso' END AS verso, CASE WHEN item_id % 2 = 0 THEN '' ELSE 'missing_verso' END AS issues, CASE WHEN item_id % 2 = 0 THEN 'ready' ELSE 'incomplete' END AS status FROM benchmark")
def s6(spark: SparkSession, d: str) -> DataFrame:
    """Client folders are stood in for by partition folders: a file of each side."""
    path = fresh_folder(spark, "clients")
    rows = table(spark, d, "benchmark")
    both = rows.select("text", F.col("item_id").alias("client"), F.lit("recto").alias("side")).union(rows.where("item_id % 2 = 0").select("text", "item_id", F.lit("verso")))
    both.write.partitionBy("client", "side").text(path)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path).select("path")
    found = listed.select("path", F.regexp_extract("path", "client=([^/]+)/", 1).alias("client"), F.regexp_extract("path", "side=([^/]+)/", 1).alias("side"))
    from inkwell.operators import joins

    grouped = joins.sides(found, "client", "side")
    name = lambda c: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), "side=([^/]+)/", 1), F.lit(""))
    return grouped.select("client", name("recto_source").alias("recto"), name("verso_source").alias("verso"), F.array_join("issues", ",").alias("issues"), "status")


@Q.add("s7_zip_members", "SELECT page_id, url LIKE '/%' OR regexp_matches(url, '^[A-Za-z]:') OR page_id % 7 = 0 AS unsafe FROM pages")
def s7(spark: SparkSession, d: str) -> DataFrame:
    path = F.when(F.pmod("page_id", F.lit(7)) == 0, F.concat(F.lit("a/../"), "url")).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", files.unsafe_member(path).alias("unsafe"))


@Q.add("s7_zip_entries", "SELECT doc_id, md5(text) AS digest, strlen(text) AS bytes FROM documents WHERE doc_id % 10 <> 3 AND text IS NOT NULL")
def s7_entries(spark: SparkSession, d: str) -> DataFrame:
    """Documents in archives that tasks make of them: listed, dealt and read back entry by entry; archives with an unsafe member are rejected whole."""
    path = fresh_folder(spark, "archives")
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", "text", (F.pmod("doc_id", F.lit(10)) == 3).alias("unsafe"))

    def pack(batches):
        for n, batch in enumerate(batches):
            for unsafe, own in batch.groupby("unsafe"):
                body = io.BytesIO()
                with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as z:
                    for i, text in zip(own["doc_id"], own["text"], strict=True):
                        z.writestr(f"in/{i}.txt" if not unsafe else f"../{i}.txt", text)
                address = f"{path}/{'un' if unsafe else ''}safe-{TaskContext.get().partitionId()}-{n}.zip"
                taskfiles.write_pieces(address, [body.getvalue()], 1 << 31)
                yield pd.DataFrame({"path": [address]})

    listed = archives.members(rows.mapInPandas(pack, "path string"))
    found = archives.contents(listed).where("error is null")
    return found.select(F.regexp_extract("member", r"(\d+)\.txt$", 1).cast("long").alias("doc_id"), F.md5("content").alias("digest"), F.octet_length("content").cast("long").alias("bytes"))


def receipt_sql(k: int) -> str:
    return f"rpad('item ' || (i * {k} % 97), 12, ' ') || ' ' || lpad(printf('%.2f', (i * {k} % 9973) / 100.0), 8, ' ') || ' EUR'"


@Q.add("s13_generated", f"SELECT i AS case_id, '/made/' || i || '.png' AS image_path, 'RECEIPT ' || i || chr(10) || {receipt_sql(3)} || chr(10) || {receipt_sql(7)} || chr(10) || {receipt_sql(11)} || chr(10) || 'TOTAL ' || printf('%.2f', (i * 3 % 9973 + i * 7 % 9973 + i * 11 % 9973) / 100.0) || ' EUR' AS ground_truth, ['receipt', 'receipt_blur', 'receipt_rotated'][i % 3 + 1] AS category FROM (SELECT unnest(range((SELECT count(*) FROM benchmark))) AS i)")
def s13(spark: SparkSession, d: str) -> DataFrame:
    """Texts of made receipts: as many as there are benchmark items."""
    return files.generated(spark, table(spark, d, "benchmark").count())


RUN = "seq long, model string, status string, image_path string, latency double"


@Q.add("s14_run_reader", f"WITH {frames.RESULTS_SQL} SELECT seq, model, status, image_path, latency FROM results")
def s14(spark: SparkSession, d: str) -> DataFrame:
    root = fresh_folder(spark, "runs")
    results = frames.results(spark, d)
    sinks.save_run(results.select("seq", "model", "status", "image_path", "latency"), summary.devices(results), f"{root}/20240131-120000-0a1b2c3d")
    return files.run_results(spark, root, "20240131-120000-0a1b2c3d", RUN)


@Q.add("k2_details_csv", f"WITH {frames.RESULTS_SQL} SELECT seq, model, latency FROM results")
def k2(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_folder(spark, "run")
    results = frames.results(spark, d)
    sinks.save_run(results.select("seq", "model", "latency"), summary.devices(results), path)
    return files.csv_labels(spark, f"{path}/details", "seq long, model string, latency double")


@Q.add("k3_traces", f"WITH {frames.RESULTS_SQL} SELECT seq, CASE WHEN latency > 100 THEN 'late_after_timeout' ELSE 'on_time' END AS timing FROM results")
def k3(spark: SparkSession, d: str) -> DataFrame:
    from inkwell.streaming import live

    path = fresh_folder(spark, "traces")
    rows = frames.results(spark, d).select("seq", live.timing("latency", 100.0).alias("timing"))
    sinks.append_traces(rows.where("timing = 'on_time'"), path)
    sinks.append_traces(rows.where("timing <> 'on_time'"), path)
    return files.json_lines(spark, path, "seq long, timing string")


@Q.add("k4_report_failures", f"WITH {frames.RESULTS_SQL} SELECT model, count(*) AS failures FROM results WHERE status <> 'success' GROUP BY model")
def k4(spark: SparkSession, d: str) -> DataFrame:
    """The written report's list of failures, counted from its lines."""
    results, path = frames.results(spark, d), fresh_folder(spark, "report")
    sinks.save_report(summary.devices(results), results.where("status <> 'success'"), path)
    lines = spark.read.text(path).where("value like '- %'")
    return lines.groupBy(F.split_part("value", F.lit(" "), F.lit(2)).alias("model")).agg(F.count("*").alias("failures"))


@Q.add("k1_whole_run", f"WITH {frames.RESULTS_SQL} SELECT seq, model, status, latency, count(*) FILTER (WHERE status <> 'success') OVER () AS failures FROM results")
def k1(spark: SparkSession, d: str) -> DataFrame:
    """Results, details, summary and report published as one; the results read back, with the number of failures the report lists."""
    path, results = fresh_folder(spark, "run"), frames.results(spark, d)
    sinks.save_whole_run(results.select("seq", "model", "status", "image_path", "latency"), summary.devices(results), path)
    listed = spark.read.text(f"{path}/report").where("value like '- %'").agg(F.count("*").alias("failures"))
    # one row is broadcast
    return spark.read.schema(RUN).json(f"{path}/results").select("seq", "model", "status", "latency").crossJoin(F.broadcast(listed))


@Q.add("k6_cni_artefacts", "SELECT o_orderstatus AS model, (o_custkey % 50)::VARCHAR AS folder_client_id, o_orderkey FROM orders")
def k6(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_folder(spark, "artefacts")
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("model"), F.pmod("o_custkey", F.lit(50)).cast("string").alias("folder_client_id"), "o_orderkey")
    sinks.save_artefacts(rows.repartition("model", "folder_client_id"), path)
    return spark.read.schema("o_orderkey long, model string, folder_client_id string").json(path)


@Q.add("k7_catalog_append", "SELECT image_path, ground_truth, lower(replace(trim(category), ' ', '_')) AS category FROM (SELECT '/p/' || p_partkey || CASE p_partkey % 5 WHEN 0 THEN '.exe' ELSE '.PNG' END AS image_path, CASE WHEN p_partkey % 3 = 0 THEN '  ' ELSE p_name END AS ground_truth, ' Big ' || p_type || ' ' AS category, p_size * 400000 AS bytes FROM part) WHERE image_path LIKE '%.PNG' AND bytes <= 15728640 AND trim(ground_truth) <> ''")
def k7(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_folder(spark, "catalog")
    key = F.col("p_partkey")
    entries = table(spark, d, "part").select(F.concat(F.lit("/p/"), key.cast("string"), F.when(F.pmod(key, F.lit(5)) == 0, ".exe").otherwise(".PNG")).alias("image_path"), F.when(F.pmod(key, F.lit(3)) == 0, "  ").otherwise(F.col("p_name")).alias("ground_truth"), F.concat(F.lit(" Big "), "p_type", F.lit(" ")).alias("category"), (F.col("p_size") * 400000).alias("bytes"))
    for half in (0, 1):  # two appends, two versions
        sinks.append_catalog(entries.where(F.pmod(F.crc32("image_path"), F.lit(2)) == half), path)
    return sinks.read_catalog(spark, path, "image_path string, ground_truth string, category string")


@Q.add("k8_label_materialize", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'label_not_found' WHEN l.quality = 1 THEN 'label_materialized' ELSE 'label_parse_failed' END AS status FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels) l USING (doc_id)")
def k8(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, '{"quality": 1}').otherwise('{"quality" 0}').alias("content")).distinct().withColumn("found", F.lit(True))
    rows = table(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left")
    return rows.select("doc_id", sinks.label_status(F.col("found"), F.col("content")).alias("status"))


@Q.add("k9_html_table", "SELECT n_regionkey, 1 AS page, '<table>' || string_agg('<tr><td>' || n_name || '</td><td>' || n_nationkey || '</td></tr>', '' ORDER BY '<tr><td>' || n_name || '</td><td>' || n_nationkey || '</td></tr>') || '</table>' AS html FROM nation GROUP BY n_regionkey")
def k9(spark: SparkSession, d: str) -> DataFrame:
    return sinks.html_table(table(spark, d, "nation"), "n_regionkey", ["n_name", "n_nationkey"])


@Q.add("inference_mock", f"WITH {frames.CASES_SQL} SELECT case_id, 'mock:2/15' AS model, CASE WHEN latency <= 1.1 THEN extracted END AS text, latency, CASE WHEN latency > 1.1 THEN 'timeout' ELSE 'success' END AS status FROM inferences WHERE m = 2")
def mock(spark: SparkSession, d: str) -> DataFrame:
    """The model boundary: an adapter from the registry over a table's partitions."""
    rows = inference.infer(frames.cases(spark, d).select("case_id", "ground_truth"), "mock:2/15", inference.mock_registry(), timeout=1.1)
    return inference.scored(rows).select("case_id", "model", "text", "latency", "status")


@Q.add("inference_traces", f"WITH {frames.CASES_SQL}, answers AS (SELECT *, latency > 1.1 AS late FROM inferences WHERE m = 2) SELECT case_id, CASE WHEN late THEN 'timeout' ELSE 'on_time' END AS timing, CASE WHEN NOT late THEN extracted END AS text FROM answers UNION ALL SELECT case_id, 'late_after_timeout', extracted FROM answers WHERE late")
def traces(spark: SparkSession, d: str) -> DataFrame:
    """Every answer of a run, late ones beside their case's timeout: the model is called once, what counts and the trace read what it wrote."""
    cases = frames.cases(spark, d).select("case_id", "ground_truth")
    _, trace = inference.run(cases, "mock:2/15", inference.mock_registry(), fresh_folder(spark, "answers"), timeout=1.1)
    return trace.select("case_id", "timing", "text")
