"""Queries: joins and sets, structured answers, strings, dates and geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import answers, measures, strings
from inkwell.operators import joins
from inkwell.sources import contract

from . import frames
from .registry import Register

Q = Register()
table = frames.table


# Joins


@Q.add("j2_annotation_pairs", "WITH a AS (SELECT 's' || p_size AS stem, max('img/' || p_brand || '/s' || p_size || '.png') AS image_path FROM part GROUP BY 1), b AS (SELECT 's' || (s_suppkey % 60) AS stem, max('ann/' || s_nationkey || '/s' || (s_suppkey % 60) || '.json') AS annotation_path FROM supplier GROUP BY 1) SELECT stem, image_path, annotation_path FROM a JOIN b USING (stem)")
def j2(spark: SparkSession, d: str) -> DataFrame:
    stem = F.concat(F.lit("s"), F.col("p_size").cast("string"))
    images = table(spark, d, "part").select(stem.alias("stem"), F.concat(F.lit("img/"), "p_brand", F.lit("/"), stem, F.lit(".png")).alias("path"))
    other = F.concat(F.lit("s"), F.pmod("s_suppkey", F.lit(60)).cast("string"))
    notes = table(spark, d, "supplier").select(other.alias("stem"), F.concat(F.lit("ann/"), F.col("s_nationkey").cast("string"), F.lit("/"), other, F.lit(".json")).alias("path"))
    return joins.pairs_by_stem(images, notes)


@Q.add("j3_csv_label_lookup", "WITH l AS (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS label FROM orders GROUP BY o_custkey) SELECT c_custkey, label FROM customer JOIN l ON c_custkey = o_custkey WHERE label <> '5-LOW' AND trim(label) <> ''")
def j3(spark: SparkSession, d: str) -> DataFrame:
    from inkwell.operators.views import readable

    labels = joins.last_by(table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderpriority").withColumnRenamed("o_orderpriority", "label")
    rows = table(spark, d, "customer").join(labels, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "label")
    return readable(rows, "label", "5-LOW")


@Q.add("j4_path_exists", "SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND EXISTS (SELECT 1 FROM pages p WHERE p.page_id = d.doc_id)")
def j4(spark: SparkSession, d: str) -> DataFrame:
    path = lambda c, kind: F.concat(F.lit(f"{kind}/"), F.col(c).cast("string"))
    rows = table(spark, d, "documents").select("doc_id", "source", path("doc_id", "image").alias("image_path"), path("doc_id", "text").alias("text_path"))
    files = table(spark, d, "labels").select(path("doc_id", "image").alias("path")).union(table(spark, d, "pages").select(path("page_id", "text")))
    return joins.existing(rows, files, ["image_path", "text_path"]).select("doc_id", "source")


@Q.add("j5_import_antijoin", "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def j5(spark: SparkSession, d: str) -> DataFrame:
    return joins.not_imported(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@Q.add("j6_client_label", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'label_not_found' ELSE 'label_found' END AS label_status FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def j6(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "labels").select("doc_id").distinct().withColumn("there", F.lit(True))
    rows = table(spark, d, "documents").select("doc_id").join(known, "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("there"), "label_found").otherwise("label_not_found").alias("label_status"))


@Q.add("j7_recto_verso", "WITH r AS (SELECT c_custkey AS client FROM customer WHERE c_mktsegment = 'BUILDING'), v AS (SELECT DISTINCT o_custkey AS client FROM orders WHERE o_orderstatus = 'F') SELECT coalesce(r.client, v.client) AS client, CASE WHEN r.client IS NULL THEN 'missing_recto' WHEN v.client IS NULL THEN 'missing_verso' ELSE '' END AS issue FROM r FULL JOIN v ON r.client = v.client")
def j7(spark: SparkSession, d: str) -> DataFrame:
    """A full outer match of two sides, as one conditional aggregation: one shuffle in place of two."""
    recto = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("client"), F.lit("recto").alias("side"))
    verso = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("client"), F.lit("verso").alias("side"))
    there = recto.union(verso).groupBy("client").agg(F.bool_or(F.col("side") == "recto").alias("recto"), F.bool_or(F.col("side") == "verso").alias("verso"))
    return there.select("client", F.when(~F.col("recto"), "missing_recto").when(~F.col("verso"), "missing_verso").otherwise("").alias("issue"))


@Q.add("j9_mock_lookup", "SELECT e.event_id, coalesce(p.p_name, 'no ground truth') AS text FROM events e LEFT JOIN part p ON p.p_partkey = e.event_id * 3")
def j9(spark: SparkSession, d: str) -> DataFrame:
    truth = table(spark, d, "part").select((F.col("p_partkey")).alias("key"), "p_name")
    return table(spark, d, "events").select("event_id", (F.col("event_id") * 3).alias("key")).join(truth, "key", "left").select("event_id", F.coalesce("p_name", F.lit("no ground truth")).alias("text"))


@Q.add("j10_latest_event", "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(CASE WHEN value > 50 THEN value END, event_id) FILTER (WHERE value > 50) AS value FROM events GROUP BY user_id")
def j10(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", F.when(F.col("value") > 50, F.col("value")).alias("value"))
    return joins.latest(rows, "user_id", "event_id", ["event_type", "value"])


@Q.add("j11_image_fallback", "WITH n AS (SELECT p_brand AS base, min(p_partkey) AS k FROM part GROUP BY p_brand HAVING count(*) = 1 OR p_brand < 'Brand#2'), f AS (SELECT p_brand AS base, count(*) AS c, min(p_name) AS path FROM part GROUP BY p_brand), s AS (SELECT s_suppkey, 'Brand#' || (s_suppkey % 30) AS base FROM supplier) SELECT s_suppkey, CASE WHEN f.c = 1 THEN f.path WHEN f.c > 1 THEN 'ambiguous' ELSE 'missing' END AS image FROM s LEFT JOIN f USING (base)")
def j11(spark: SparkSession, d: str) -> DataFrame:
    """A file by its name where its path is unknown: only a name that one file has."""
    files = table(spark, d, "part").groupBy(F.col("p_brand").alias("base")).agg(F.count("*").alias("c"), F.min("p_name").alias("path"))
    rows = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("Brand#"), F.pmod("s_suppkey", F.lit(30)).cast("string")).alias("base")).join(files, "base", "left")
    return rows.select("s_suppkey", F.when(F.col("c") == 1, F.col("path")).when(F.col("c") > 1, "ambiguous").otherwise("missing").alias("image"))


# Sets


@Q.add("u1_concat_sources", "SELECT doc_id AS id, 'documents' AS origin FROM documents UNION ALL SELECT page_id, 'pages' FROM pages UNION ALL SELECT item_id, 'benchmark' FROM benchmark")
def u1(spark: SparkSession, d: str) -> DataFrame:
    some = [table(spark, d, t).select(F.col(c).alias("id"), F.lit(t).alias("origin")) for t, c in (("documents", "doc_id"), ("pages", "page_id"), ("benchmark", "item_id"))]
    return some[0].unionByName(some[1]).unionByName(some[2])


@Q.add("u2_key_intersection", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def u2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").intersect(table(spark, d, "labels").select("doc_id"))


@Q.add("u3_required_missing", "SELECT event_id, array_to_string(list_filter(['k', 'path', 'category'], lambda x: NOT list_contains(json_keys(props), x)), ',') AS missing FROM events")
def u3(spark: SparkSession, d: str) -> DataFrame:
    required = F.array(*[F.lit(x) for x in ("k", "path", "category")])
    return table(spark, d, "events").select("event_id", F.array_join(F.array_except(required, F.json_object_keys("props")), ",").alias("missing"))


@Q.add("u4_category_union", "SELECT unnest(['receipt', 'table', 'note', 'handwriting', 'invoice', 'form']) AS category UNION SELECT source FROM documents")
def u4(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([(c,) for c in ("receipt", "table", "note", "handwriting", "invoice", "form")], "category string")
    return known.union(table(spark, d, "documents").select("source")).distinct()


@Q.add("u5_param_merge", "SELECT event_id, coalesce(CASE WHEN event_type <> 'click' THEN event_type END, 'extra') AS kind, '1' AS page FROM events")
def u5(spark: SparkSession, d: str) -> DataFrame:
    """Explicit parameters that are not null override the extra ones."""
    explicit = F.create_map(F.lit("kind"), F.when(F.col("event_type") != "click", F.col("event_type")))
    merged = merge_parameters(F.create_map(F.lit("kind"), F.lit("extra"), F.lit("page"), F.lit("1")), explicit)
    return table(spark, d, "events").select("event_id", merged["kind"].alias("kind"), merged["page"].alias("page"))


def merge_parameters(extra: F.Column, explicit: F.Column) -> F.Column:
    own = F.map_filter(explicit, lambda k, v: v.isNotNull())
    rest = F.map_filter(extra, lambda k, v: ~F.map_contains_key(own, k))
    return F.map_concat(rest, own)


# Structured answers


def replies(spark: SparkSession, d: str) -> DataFrame:
    """An answer for each event: plain, fenced, with a nested value, cut short, or no JSON at all."""
    k = F.get_json_object("props", "$.k").cast("long")
    body = F.concat(F.lit('{"cin": " AB'), k.cast("string"), F.lit('", "nom": "'), F.col("event_type"), F.lit('", "prenom": {"x": 1}, "date_naissance": '), k.cast("string"), F.lit(', "other": true, "date_validite": ""}'))
    turn = F.pmod("event_id", F.lit(5))
    reply = F.when(turn == 0, body).when(turn == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(turn == 2, F.concat(F.lit("Here: "), body, F.lit(" Done."))).when(turn == 3, F.concat(F.lit('{"cin": '), k.cast("string"), F.lit(' "x"}'))).otherwise("no object here")
    return frames.dealt(table(spark, d, "events").select("event_id", "event_type", "props"), "event_id").select("event_id", "event_type", k.alias("k"), reply.alias("reply"))


REPLIES = """replies AS (SELECT event_id, event_type, k, CASE event_id % 5 WHEN 0 THEN body WHEN 1 THEN '```json' || chr(10) || body || chr(10) || '```' WHEN 2 THEN 'Here: ' || body || ' Done.' WHEN 3 THEN '{"cin": ' || k || ' "x"}' ELSE 'no object here' END AS reply
  FROM (SELECT event_id, event_type, json_extract_string(props, '$.k')::BIGINT AS k, '{"cin": " AB' || json_extract_string(props, '$.k') || '", "nom": "' || event_type || '", "prenom": {"x": 1}, "date_naissance": ' || json_extract_string(props, '$.k') || ', "other": true, "date_validite": ""}' AS body FROM events)),
objects AS (SELECT *, nullif(regexp_extract(reply, '(?s)\\{.*\\}'), '') AS object FROM replies)"""


@Q.add("n1_extract_object", f"WITH {REPLIES} SELECT event_id, object FROM objects")
def n1(spark: SparkSession, d: str) -> DataFrame:
    return replies(spark, d).select("event_id", answers.json_object(F.col("reply")).alias("object"))


@Q.add("n2_parse_side", f"WITH {REPLIES} SELECT event_id, CASE WHEN object IS NULL THEN 'model_response_not_json' WHEN NOT json_valid(object) THEN 'model_response_invalid_json' END AS error, CASE WHEN json_valid(object) THEN 'AB' || k END AS cin, NULL::VARCHAR AS prenom, CASE WHEN json_valid(object) THEN event_type END AS nom, CASE WHEN json_valid(object) THEN k::VARCHAR END AS date_naissance, NULL::VARCHAR AS ville_naissance, NULL::VARCHAR AS date_validite FROM objects")
def n2(spark: SparkSession, d: str) -> DataFrame:
    rows = answers.with_parsed(replies(spark, d), "reply")
    return rows.select("event_id", F.col("parsed_error").alias("error"), answers.side(F.col("parsed"), answers.RECTO).alias("s")).select("event_id", "error", "s.*")


def combined(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    recto = F.concat(F.lit('"recto": {"cin": "a-'), k, F.lit('", "nom": "'), F.col("event_type"), F.lit('", "date_validite": "01/02/20'), F.lpad(k, 2, "0"), F.lit('"}'))
    verso = F.concat(F.lit('"verso": {"cin": "'), F.when(F.pmod("event_id", F.lit(3)) == 0, F.concat(F.lit("A "), k)).otherwise(F.concat(F.lit("B"), k)), F.lit('", "adresse": "rue '), k, F.lit('"}'))
    reply = F.when(F.pmod("event_id", F.lit(4)) == 0, F.concat(F.lit("{"), recto, F.lit(', "verso": 5}'))).otherwise(F.concat(F.lit("{"), recto, F.lit(", "), verso, F.lit("}")))
    return frames.dealt(table(spark, d, "events").select("event_id", "event_type", "props"), "event_id").select("event_id", "event_type", k.alias("k"), reply.alias("reply"))


def both_sides(spark: SparkSession, d: str) -> DataFrame:
    rows, value = answers.with_parsed(combined(spark, d), "reply"), F.col("parsed")
    return rows.select("event_id", "event_type", "k", answers.side(value, answers.RECTO, "recto").alias("recto"), answers.side(value, answers.VERSO, "verso").alias("verso"))


SIDES = "sides AS (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k, event_id % 4 = 0 AS alone, event_id % 3 = 0 AS same FROM events)"


@Q.add("n3_parse_combined", f"WITH {SIDES} SELECT event_id, 'a-' || k AS recto_cin, event_type AS recto_nom, CASE WHEN NOT alone THEN CASE WHEN same THEN 'A ' || k ELSE 'B' || k END END AS verso_cin, CASE WHEN NOT alone THEN 'rue ' || k END AS adresse FROM sides")
def n3(spark: SparkSession, d: str) -> DataFrame:
    return both_sides(spark, d).select("event_id", F.col("recto.cin").alias("recto_cin"), F.col("recto.nom").alias("recto_nom"), F.col("verso.cin").alias("verso_cin"), "verso.adresse")


@Q.add("n4_scalar_or_null", "SELECT event_id, json_extract_string(props, '$.k') AS k, NULL::VARCHAR AS object, 'True' AS flag, NULL::VARCHAR AS blank FROM events")
def n4(spark: SparkSession, d: str) -> DataFrame:
    made = F.try_parse_json(F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "object": {"a": [1]}, "flag": true, "blank": "  "}')))
    return table(spark, d, "events").select("event_id", *[answers.scalar(made, f"$.{n}").alias(n) for n in ("k", "object", "flag", "blank")])


@Q.add("n5_merge_sides", f"WITH {SIDES} SELECT event_id, CASE WHEN alone OR same THEN 'a-' || k END AS cin, CASE WHEN NOT alone THEN same END AS coherent FROM sides")
def n5(spark: SparkSession, d: str) -> DataFrame:
    value, same = answers.merged(F.col("recto.cin"), F.col("verso.cin"))
    return both_sides(spark, d).select("event_id", value.alias("cin"), same.alias("coherent"))


RECORD = "'c' || event_id AS folder_client_id, 'r' || k AS recto_document_id, CASE WHEN alone THEN NULL ELSE 'v' || k END AS verso_document_id, 'label_found' AS label_status, '{\"cin\":\"a-' || k || '\",\"prenom\":null,\"nom\":\"' || event_type || '\",\"date_naissance\":null,\"ville_naissance\":null,\"date_validite\":\"01/02/20' || lpad(left(k, 2), 2, '0') || '\"}' AS recto, CASE WHEN alone THEN '{\"cin\":null,\"date_validite\":null,\"adresse\":null}' ELSE '{\"cin\":\"' || CASE WHEN same THEN 'A ' || k ELSE 'B' || k END || '\",\"date_validite\":null,\"adresse\":\"rue ' || k || '\"}' END AS verso"


@Q.add("n6_global_record", f"WITH {SIDES} SELECT event_id, {RECORD}, 'a-' || k AS cin_recto, CASE WHEN NOT alone THEN CASE WHEN same THEN 'A ' || k ELSE 'B' || k END END AS cin_verso, CASE WHEN alone OR same THEN 'a-' || k END AS cin_fusionne, CASE WHEN NOT alone THEN same END AS cin_coherent, event_type AS nom, NULL::VARCHAR AS prenom, NULL::VARCHAR AS date_naissance, NULL::VARCHAR AS ville_naissance, '01/02/20' || lpad(left(k, 2), 2, '0') AS date_validite_recto, NULL::VARCHAR AS date_validite_verso, '01/02/20' || lpad(left(k, 2), 2, '0') AS date_validite_fusionnee, NULL::BOOLEAN AS date_validite_coherente, CASE WHEN NOT alone THEN 'rue ' || k END AS adresse FROM sides")
def n6(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    client = {"folder_client_id": F.concat(F.lit("c"), F.col("event_id").cast("string")), "recto_document_id": F.concat(F.lit("r"), k), "verso_document_id": F.when(F.pmod("event_id", F.lit(4)) != 0, F.concat(F.lit("v"), k)), "label_status": F.lit("label_found")}
    record = answers.global_record(F.col("recto"), F.col("verso"), client)
    whole = {n: F.to_json(record[n], {"ignoreNullFields": "false"}) for n in ("recto", "verso")}
    return both_sides(spark, d).select("event_id", *[c.alias(n) for n, c in (record | whole).items()])


LABELS = (
    "labels7 AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'A' || k WHEN 2 THEN 'B' || k ELSE 'a ' || k END AS cin, CASE event_id % 5 WHEN 0 THEN NULL ELSE 'C.L.I.C.K' END AS nom, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'x' END AS prenom, CASE event_id % 5 WHEN 0 THEN NULL ELSE '01-02-20' || lpad(left(k, 2), 2, '0') END AS date_validite, CASE event_id % 5 WHEN 0 THEN NULL WHEN 3 THEN 'Rue ' || k ELSE 'elsewhere' END AS adresse FROM sides), "
    "answers7 AS (SELECT event_id, CASE WHEN alone OR same THEN 'a-' || k END AS cin, event_type AS nom, NULL::VARCHAR AS prenom, '01/02/20' || lpad(left(k, 2), 2, '0') AS date_validite, CASE WHEN NOT alone THEN 'rue ' || k END AS adresse FROM sides)"
)


def verdict_sql(field: str) -> str:
    plain = lambda x: f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"
    return f"CASE WHEN l.{field} IS NULL OR l.{field} = '' THEN 'label_missing' WHEN a.{field} IS NULL OR a.{field} = '' THEN 'missing_model' WHEN {plain('l.' + field)} = {plain('a.' + field)} THEN 'correct' ELSE 'different' END AS {field}"


VERDICTS = ", ".join(verdict_sql(f) for f in ("cin", "prenom", "nom")) + ", 'label_missing' AS date_naissance, 'label_missing' AS ville_naissance, " + ", ".join(verdict_sql(f) for f in ("date_validite", "adresse"))


def label_frame(spark: SparkSession, d: str) -> DataFrame:
    """A label for each event, as JSON: none, flat, or with fields under a side."""
    k, turn = F.get_json_object("props", "$.k"), F.pmod("event_id", F.lit(5))
    day = F.concat(F.lit("01-02-20"), F.lpad(k, 2, "0"))
    flat = F.concat(F.lit('{"cin": "'), F.when(turn == 1, F.concat(F.lit("A"), k)).otherwise(F.concat(F.lit("a "), k)), F.lit('", "nom": "C.L.I.C.K", "prenom": "'), F.when(turn == 1, "").otherwise("x"), F.lit('", "date_validite": "'), day, F.lit('", "adresse": "'), F.when(turn == 3, F.concat(F.lit("Rue "), k)).otherwise("elsewhere"), F.lit('"}'))
    nested = F.concat(F.lit('{"nom": null, "recto": {"cin": "B'), k, F.lit('", "nom": "C.L.I.C.K", "prenom": "x", "date_validite": "'), day, F.lit('"}, "verso": {"cin": "other", "adresse": "elsewhere"}}'))
    text = F.when(turn == 0, None).when(turn == 2, nested).otherwise(flat)
    return table(spark, d, "events").select("event_id", F.try_parse_json(text).alias("label"))


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    rows = both_sides(spark, d).join(label_frame(spark, d), "event_id", "left")
    record = answers.global_record(F.col("recto"), F.col("verso"))
    return rows.select("event_id", *[c.alias(f) for f, c in answers.comparisons(F.col("label"), record).items()])


@Q.add("n7_field_compare", f"WITH {SIDES}, {LABELS} SELECT event_id, {VERDICTS} FROM labels7 l JOIN answers7 a USING (event_id)")
def n7(spark: SparkSession, d: str) -> DataFrame:
    """All seven fields, of labels that are flat, nested under a side, or absent."""
    return verdicts(spark, d)


@Q.add("j8_label_vs_extraction", f"WITH {SIDES}, {LABELS}, v AS (SELECT event_id, {VERDICTS} FROM labels7 l JOIN answers7 a USING (event_id)) UNPIVOT v ON cin, prenom, nom, date_naissance, ville_naissance, date_validite, adresse INTO NAME field VALUE verdict")
def j8(spark: SparkSession, d: str) -> DataFrame:
    return verdicts(spark, d).unpivot("event_id", list(answers.LABEL_FIELDS), "field", "verdict")


@Q.add("n8_confidence_rows", "SELECT event_id, 'cin' AS field, CASE WHEN event_type = 'click' THEN 'correct' ELSE 'different' END AS comparison, json_extract_string(props, '$.k')::DOUBLE AS confidence FROM events UNION ALL SELECT event_id, 'nom', 'correct', value FROM events")
def n8(spark: SparkSession, d: str) -> DataFrame:
    verdict = F.create_map(F.lit("cin"), F.when(F.col("event_type") == "click", "correct").otherwise("different"), F.lit("nom"), F.lit("correct"))
    confidence = F.create_map(F.lit("cin"), F.get_json_object("props", "$.k").cast("double"), F.lit("nom"), F.col("value"), F.lit("adresse"), F.lit(None).cast("double"))
    rows = table(spark, d, "events").select("event_id", verdict.alias("verdicts"), confidence.alias("confidences"))
    return answers.confidence_rows(rows, ["event_id"], "verdicts", "confidences")


@Q.add("n9_label_from_api", "SELECT c_custkey, 'ID' || c_custkey AS cin, NULL::VARCHAR AS prenom, c_name AS nom, strftime(DATE '2020-01-01' + (c_custkey % 365)::INT, '%Y-%m-%d') AS date_naissance, c_mktsegment AS ville_naissance, CASE WHEN c_custkey % 3 = 0 THEN 'unknown' ELSE '2031-05-06' END AS date_validite, NULL::VARCHAR AS adresse, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS nom_confidence, (CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END)::INT AS confidences, 'customer_data' AS label_source, c_custkey::VARCHAR AS customer_id FROM customer")
def n9(spark: SparkSession, d: str) -> DataFrame:
    """A label of seven fields from the payload of each customer."""
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.pmod("c_custkey", F.lit(365)).cast("int"))
    data = F.struct(
        F.concat(F.lit(" ID"), F.col("c_custkey").cast("string")).alias("cin_id"), F.lit("  ").alias("first_name"), F.col("c_name").alias("last_name"), F.date_format(day, "dd/MM/yyyy").alias("birth_date"), F.col("c_mktsegment").alias("birth_place"),
        F.when(F.pmod("c_custkey", F.lit(3)) == 0, "unknown").otherwise("2031-05-06T00:00").alias("validity_date"), F.lit("not of the card").alias("phone"),
        F.when(F.pmod("c_custkey", F.lit(2)) == 0, F.col("c_acctbal")).alias("last_name_confidence"), F.lit(90).alias("cin_id_confidence"),
    )
    customer = F.struct(F.col("c_custkey").alias("id"), data.alias("customer_data"))
    payload = F.struct(F.struct(F.struct(F.struct(customer.alias("customer")).alias("response_data")).alias("body")).alias("response"))
    rows = table(spark, d, "customer").select("c_custkey", F.parse_json(F.to_json(payload)).alias("payload"))
    found = rows.select("c_custkey", *[c.alias(n) for n, c in answers.customer_label(F.col("payload")).items()])
    return found.select("c_custkey", *answers.LABEL_FIELDS, F.try_element_at("field_confidence", F.lit("nom")).alias("nom_confidence"), F.size("field_confidence").alias("confidences"), "label_source", "customer_id")


@Q.add("n10_extra_params", "SELECT event_id, json_extract_string(props, '$.k') AS k, '' AS empty, 2::INT AS n FROM events")
def n10(spark: SparkSession, d: str) -> DataFrame:
    made = answers.parameters(F.concat(F.lit('{"gone": null, "empty": "", "k": '), F.get_json_object("props", "$.k"), F.lit("}")))
    return table(spark, d, "events").select("event_id", made["k"].alias("k"), made["empty"].alias("empty"), F.size(made).alias("n"))


@Q.add("n11_strip_fence", "SELECT doc_id, md5(CASE WHEN doc_id % 3 = 2 THEN '```json' || chr(10) || trim(text) || chr(10) || '```' ELSE trim(text) END) AS text FROM documents")
def n11(spark: SparkSession, d: str) -> DataFrame:
    head = F.element_at(F.array(F.lit("```\n"), F.lit("```markdown\n"), F.lit("```json\n")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.md5(answers.strip_fence(F.concat(head, F.trim("text"), F.lit("\n```")))).alias("text"))


@Q.add("n12_trace_preview", "SELECT doc_id, length(text) > 5000 AS cut, md5(CASE WHEN length(text) > 5000 THEN left(text, 5000) || chr(10) || '[5000 characters shown]' ELSE text END) AS shown FROM documents")
def n12(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", (F.length("text") > 5000).alias("cut"), F.md5(answers.preview(F.col("text"), 5000)).alias("shown"))


@Q.add("n13_message_parts", "SELECT conv_id, max(CASE WHEN role = 'system' THEN text END) AS system, count(*) FILTER (WHERE role = 'user') AS users, arg_max(text, turn) FILTER (WHERE role = 'user') AS last_user FROM conversations GROUP BY conv_id")
def n13(spark: SparkSession, d: str) -> DataFrame:
    of = lambda role: F.when(F.col("role") == role, F.col("text"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max(of("system")).alias("system"), F.count(of("user")).alias("users"), F.max_by(of("user"), F.when(F.col("role") == "user", F.col("turn"))).alias("last_user"))


HEADS = {"recto": "Read the recto side of this identity card.", "verso": "Read the verso side of this identity card.", "combined": "This image has the recto side of an identity card above its verso side. Read both, each for itself."}
FORMS = {"recto": '{"cin": null, "prenom": null, "nom": null, "date_naissance": null, "ville_naissance": null, "date_validite": null}', "verso": '{"cin": null, "date_validite": null, "adresse": null}'}
FORMS["combined"] = f'{{"recto": {FORMS["recto"]}, "verso": {FORMS["verso"]}}}'


def prompt_sql(kind: str) -> str:
    fixed = "\n".join([HEADS[kind], *answers.RULES, FORMS[kind]]).replace("'", "''")
    return f"'{fixed}' || coalesce(chr(10) || 'More instructions, which don''t change the form:' || chr(10) || left(nullif(trim(text), ''), 40), '') AS {kind}"


@Q.add("n14_prompt_build", f"SELECT item_id, {prompt_sql('recto')}, {prompt_sql('verso')}, {prompt_sql('combined')} FROM (SELECT item_id, CASE WHEN item_id % 3 <> 0 THEN text END AS text FROM benchmark)")
def n14(spark: SparkSession, d: str) -> DataFrame:
    fields, more = contract.fields(), F.when(F.pmod("item_id", F.lit(3)) != 0, F.col("text"))
    return table(spark, d, "benchmark").select("item_id", *[answers.prompt(s, fields, more, 40).alias(s) for s in fields], answers.combined_prompt(fields, more, 40).alias("combined"))


# Strings


@Q.add("g1_file_side", "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN user_id::VARCHAR END AS client FROM events")
def g1(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.col("user_id").cast("string"), F.when(F.col("event_type").isin("view", "click"), "_Recto.PDF").otherwise("_verso.png"))
    return table(spark, d, "events").select("event_id", strings.file_side(name, "_recto").alias("client"))


@Q.add("g2_find_pair", "SELECT event_id, 'CIN-Recto ' || user_id AS recto, CASE WHEN event_type = 'click' THEN 'x cin verso.png' END AS verso FROM events")
def g2(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(F.lit("contract.pdf"), F.concat(F.lit("CIN-Recto "), F.col("user_id").cast("string")), F.when(F.col("event_type") == "click", "x cin verso.png").otherwise("other"))
    return table(spark, d, "events").select("event_id", strings.find_side(names, "recto").alias("recto"), strings.find_side(names, "verso").alias("verso"))


@Q.add("g3_safe_name", "SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'unknown') AS name FROM pages")
def g3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", strings.safe_name(F.col("url")).alias("name"))


@Q.add("g4_path_normalize", "SELECT page_id, url AS path, regexp_extract(url, '[^/]*$') AS base FROM pages")
def g4(spark: SparkSession, d: str) -> DataFrame:
    back = F.translate("url", "/", "\\")
    return table(spark, d, "pages").select("page_id", strings.slashes(back).alias("path"), strings.base_name(back).alias("base"))


@Q.add("g5_url_parse", "WITH q AS (SELECT page_id, nullif(regexp_extract(url, '\\?([^#]*)', 1), '') AS q FROM pages), p AS (SELECT page_id, unnest(string_split(q, '&')) AS x, generate_subscripts(string_split(q, '&'), 1) - 1 AS pos FROM q WHERE q IS NOT NULL) SELECT page_id, pos::INT AS pos, split_part(x, '=', 1) AS name, substring(x, length(split_part(x, '=', 1)) + 2) AS value FROM p")
def g5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.posexplode(strings.query_pairs(F.col("url"))).alias("pos", "p")).select("page_id", "pos", "p.name", "p.value")


@Q.add("g6_url_build", "SELECT page_id, rtrim(regexp_extract(url, '^https?://[^/]+'), '/') || '/v1/list' AS url FROM pages")
def g6(spark: SparkSession, d: str) -> DataFrame:
    base = F.concat(F.regexp_extract("url", "^https?://[^/]+", 0), F.lit("//"))
    return table(spark, d, "pages").select("page_id", strings.join_url(base, F.lit(" /v1/list")).alias("url"))


def pairs_frame(spark: SparkSession, d: str) -> DataFrame:
    row = lambda name, value, on: F.struct(name.alias("name"), value.alias("value"), on.alias("enabled"))
    none = F.lit(None).cast("string")
    rows = F.array(row(F.col("event_type"), F.col("user_id").cast("string"), F.lit(True)), row(F.lit(" "), F.lit("x"), F.lit(True)), row(F.lit("Page"), none, F.lit(True)), row(F.lit("off"), F.lit("1"), F.col("event_type") == "click"))
    return table(spark, d, "events").select("event_id", "event_type", strings.enabled_pairs(rows).alias("pairs"))


def shown(pairs: F.Column) -> F.Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["name"], F.lit("="), p["value"])), "&")


@Q.add("g7_enabled_pairs", "SELECT event_id, event_type || '=' || user_id || '&Page=' || CASE WHEN event_type = 'click' THEN '&off=1' ELSE '' END AS pairs FROM events")
def g7(spark: SparkSession, d: str) -> DataFrame:
    return pairs_frame(spark, d).select("event_id", shown(F.col("pairs")).alias("pairs"))


@Q.add("g8_replace_params", "SELECT event_id, event_type || '=' || CASE WHEN event_type = 'click' THEN '9' ELSE user_id::VARCHAR END || '&Page=' || event_id || CASE WHEN event_type = 'click' THEN '&off=1' ELSE '&CLICK=9' END AS pairs FROM events")
def g8(spark: SparkSession, d: str) -> DataFrame:
    page = strings.replace_pair(F.col("pairs"), "page", F.col("event_id").cast("string"))
    return pairs_frame(spark, d).withColumn("pairs", page).select("event_id", shown(strings.replace_pair(F.col("pairs"), "CLICK", F.lit("9"))).alias("pairs"))


@Q.add("g9_mask_proxy", "SELECT event_id, CASE event_type WHEN 'view' THEN '' WHEN 'click' THEN 'http://proxy:80' ELSE 'http://u' || user_id || ':***@proxy:8080' END AS masked FROM events")
def g9(spark: SparkSession, d: str) -> DataFrame:
    url = F.when(F.col("event_type") == "view", "proxy only").when(F.col("event_type") == "click", "http://proxy:80").otherwise(F.concat(F.lit("http://u"), F.col("user_id").cast("string"), F.lit(":se?cret@proxy:8080")))
    url = F.regexp_replace(url, r"\?", "-")
    return table(spark, d, "events").select("event_id", strings.mask_password(url).alias("masked"))


@Q.add("g10_proxy_parse", "SELECT event_id, CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN 'http://p:' || user_id ELSE 'http://a:1' END AS http, CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN 'http://p:' || user_id ELSE 'https://b:2' END AS https FROM events")
def g10(spark: SparkSession, d: str) -> DataFrame:
    setting = F.when(F.col("event_type") == "view", " ").when(F.col("event_type") == "click", F.concat(F.lit("p:"), F.col("user_id").cast("string"))).otherwise("HTTP=a:1; ftp=c:3;https=https://b:2;bad")
    found = strings.proxy_map(setting)
    return table(spark, d, "events").select("event_id", F.try_element_at(found, F.lit("http")).alias("http"), F.try_element_at(found, F.lit("https")).alias("https"))


@Q.add("g11_route_format", "SELECT c_custkey, '/clients/' || url_encode(c_name) || '/label' AS route FROM customer")
def g11(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", strings.route(F.lit("/clients/{client_id}/label"), F.col("c_name")).alias("route"))


@Q.add("g12_model_spec", "SELECT event_id, CASE event_type WHEN 'view' THEN 'mock' WHEN 'click' THEN 'easyocr' ELSE 'ollama' END AS provider, CASE event_type WHEN 'view' THEN 'Mock-1' WHEN 'click' THEN 'EasyOCR-Local' WHEN 'signup' THEN 'llava:7b' ELSE 'qwen:' || user_id END AS name FROM events")
def g12(spark: SparkSession, d: str) -> DataFrame:
    spec = F.when(F.col("event_type") == "view", "Mock-1").when(F.col("event_type") == "click", "EasyOCR-Local").when(F.col("event_type") == "signup", "ollama:llava:7b").otherwise(F.concat(F.lit("qwen:"), F.col("user_id").cast("string")))
    provider, name = strings.model_spec(spec)
    return table(spark, d, "events").select("event_id", provider.alias("provider"), name.alias("name"))


@Q.add("g13_mock_corrupt", f"WITH {frames.CASES_SQL} SELECT model, case_id, extracted FROM inferences")
def g13(spark: SparkSession, d: str) -> DataFrame:
    return frames.inferences(spark, d).select("model", "case_id", "extracted")


@Q.add("g14_markdown_table", "SELECT r_regionkey, '| nation | key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |', chr(10) ORDER BY n_name) AS text FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def g14(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "region").join(table(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey").agg(F.array_sort(F.collect_list(F.array("n_name", F.col("n_nationkey").cast("string")))).alias("rows"))
    return rows.select("r_regionkey", strings.markdown_table(["nation", "key"], F.col("rows")).alias("text"))


@Q.add("g15_human_size", "SELECT doc_id, CASE WHEN b < 1024 THEN b || ' o' WHEN b < 1048576 THEN printf('%.1f KiB', floor(b / 102.4::DOUBLE + 0.5) / 10) ELSE printf('%.2f MiB', floor(b / 10485.76::DOUBLE + 0.5) / 100) END AS size FROM (SELECT doc_id, strlen(text) * (1 + doc_id % 100) AS b FROM documents)")
def g15(spark: SparkSession, d: str) -> DataFrame:
    size = F.octet_length("text").cast("long") * (1 + F.pmod("doc_id", F.lit(100)))
    return table(spark, d, "documents").select("doc_id", strings.human_size(size).alias("size"))


@Q.add("g16_content_type_ext", "SELECT event_id, CASE event_type WHEN 'view' THEN '.pdf' WHEN 'click' THEN '.jpg' WHEN 'signup' THEN '.png' END AS extension FROM events")
def g16(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "application/pdf; charset=x").when(F.col("event_type") == "click", "IMAGE/JPG").when(F.col("event_type") == "signup", "image/png").otherwise("text/html")
    return table(spark, d, "events").select("event_id", strings.extension_of(kind).alias("extension"))


@Q.add("g17_address_scope", "SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'loopback' WHEN user_id % 5 = 1 THEN 'private' WHEN user_id % 5 = 2 THEN 'link-local' WHEN user_id % 5 = 3 THEN 'global' END AS scope FROM events")
def g17(spark: SparkSession, d: str) -> DataFrame:
    head = F.element_at(F.array(*[F.lit(x) for x in ("127.0.0.", "192.168.1.", "169.254.7.", "8.8.4.", "host.")]), (F.pmod("user_id", F.lit(5)) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", strings.address_scope(F.concat(head, F.pmod("user_id", F.lit(256)).cast("string"))).alias("scope"))


# Dates, geometry, rates


@Q.add("m1_date_normalize", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def m1(spark: SparkSession, d: str) -> DataFrame:
    turn = F.pmod("o_orderkey", F.lit(4))
    written = F.when(turn == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(turn == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")).when(turn == 2, F.date_format("o_orderdate", "d/M/yyyy")).otherwise(" soon ")
    return table(spark, d, "orders").select("o_orderkey", measures.iso_date(written).alias("day"))


def crop_sql(most: str) -> str:
    return (
        "WITH b AS (SELECT l_orderkey, l_linenumber, 1200 AS w, 1600 AS h, (l_quantity * 10)::INT AS l, (l_quantity * 8)::INT AS t, (l_quantity * 10)::INT + 100 + (l_extendedprice % 700)::INT AS r, (l_quantity * 8)::INT + 80 + (l_extendedprice % 450)::INT AS bo FROM lineitem), "
        "p AS (SELECT *, greatest(0, l - 24) AS x1, greatest(0, t - 24) AS y1, least(w, r + 24) AS x2, least(h, bo + 24) AS y2 FROM b), "
        "q AS (SELECT *, (x2 - x1)::DOUBLE / (y2 - y1) AS ratio, ((x2 - x1) * (y2 - y1))::DOUBLE / (w * h) AS coverage FROM p) "
        f"SELECT l_orderkey, l_linenumber, x1 AS \"left\", y1 AS top, x2 AS \"right\", y2 AS bottom, coverage, CASE WHEN ratio BETWEEN 1.20 AND 2.05 AND coverage BETWEEN 0.02 AND {most} THEN 'crop_detected' ELSE 'crop_fallback_full_page' END AS crop_status FROM q"
    )


def cropped(spark: SparkSession, d: str, most: float) -> DataFrame:
    left, top = F.floor(F.col("l_quantity") * 10).cast("int"), F.floor(F.col("l_quantity") * 8).cast("int")
    box = (left, top, left + 100 + F.rint(F.col("l_extendedprice") % 700).cast("int"), top + 80 + F.rint(F.col("l_extendedprice") % 450).cast("int"))
    found = measures.crop(F.lit(1200), F.lit(1600), box, most)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[found[n].alias(n) for n in ("left", "top", "right", "bottom", "coverage", "crop_status")])


@Q.add("m2_crop_geometry", crop_sql("0.65"))
def m2(spark: SparkSession, d: str) -> DataFrame:
    return cropped(spark, d, 0.65)


@Q.add("m3_crop_geometry_lab", crop_sql("1.0"))
def m3(spark: SparkSession, d: str) -> DataFrame:
    return cropped(spark, d, 1.0)


@Q.add("m4_mm_to_px", "SELECT p_partkey, round_even(p_size * 10.0::DOUBLE / 25.4 * 300, 0)::BIGINT AS px, round(round_even(p_size * 10.0::DOUBLE / 25.4 * 300, 0) * 2480 / 1e6, 4) AS mpx FROM part")
def m4(spark: SparkSession, d: str) -> DataFrame:
    px = measures.pixels(F.col("p_size") * 10.0, F.lit(300))
    return table(spark, d, "part").select("p_partkey", px.alias("px"), F.round(px * 2480 / 1e6, 4).alias("mpx"))


@Q.add("m5_angle_search", "WITH c AS (SELECT user_id, unnest(range(-5, 6)) AS angle, avg(value) AS v FROM events GROUP BY user_id), s AS (SELECT *, abs(1.586 - (1 + abs(sin(angle + v)))) AS score FROM c) SELECT user_id, arg_min(angle, score)::INT AS angle FROM s GROUP BY user_id")
def m5(spark: SparkSession, d: str) -> DataFrame:
    """The angle whose card has the ratio nearest to 1.586."""
    rows = table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("v"))
    return rows.select("user_id", measures.best_angle(range(-5, 6), lambda angle: 1 + F.abs(F.sin(angle + F.col("v")))).alias("angle"))


_SEARCH = "SELECT user_id, angle, off, row_number() OVER (PARTITION BY user_id ORDER BY off, turn) AS r FROM (SELECT user_id, v, angle, turn, abs(1.586 - CASE WHEN (angle + user_id) % 7 <> 0 THEN 1 + abs(sin(angle / 20.0::DOUBLE + v)) END) AS off FROM {}) WHERE off IS NOT NULL"


@Q.add(
    "m5_angle_search_fine",
    "WITH c AS (SELECT user_id, avg(value) AS v FROM events GROUP BY user_id), "
    "tried AS (SELECT user_id, v, unnest(range(-90, 91, 6)) AS angle, angle AS turn FROM c), "
    f"coarse AS (SELECT * FROM ({_SEARCH.format('tried')}) WHERE r = 1), "
    "near AS (SELECT user_id, v, unnest(range(angle - 5, angle + 6)) AS angle, angle AS turn FROM c JOIN coarse USING (user_id) UNION ALL SELECT user_id, v, angle, -1000 FROM c JOIN coarse USING (user_id)), "
    f"fine AS (SELECT * FROM ({_SEARCH.format('near')}) WHERE r = 1) "
    "SELECT user_id, fine.angle::INT AS angle, coarse.angle::INT AS coarse_angle, round(fine.off, 6) AS off FROM fine JOIN coarse USING (user_id)",
)
def m5_fine(spark: SparkSession, d: str) -> DataFrame:
    """Every sixth degree, then each within five of the best; every seventh angle has no ratio."""
    rows = table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("v"))
    ratio = lambda angle: F.when((angle + F.col("user_id")) % 7 != 0, 1 + F.abs(F.sin(angle / F.lit(20.0) + F.col("v"))))
    found = rows.select("user_id", measures.searched_angle(ratio).alias("found"))
    return found.select("user_id", "found.angle", "found.coarse_angle", F.round("found.off", 6).alias("off"))


@Q.add("m6_tokens_per_second", f"WITH {frames.RESULTS_SQL} SELECT seq, round(output_tokens / nullif(latency, 0), 6) AS rate FROM results")
def m6(spark: SparkSession, d: str) -> DataFrame:
    return frames.results(spark, d).select("seq", F.round(measures.per_second(F.col("output_tokens"), F.col("latency")), 6).alias("rate"))


@Q.add("m7_sum_and_errors", f"WITH {frames.RESULTS_SQL} SELECT seq, CASE WHEN output_tokens IS NULL AND accuracy IS NULL THEN NULL ELSE coalesce(output_tokens, 0) + coalesce(CASE WHEN accuracy IS NOT NULL THEN k END, 0) END AS tokens, CASE WHEN status = 'success' AND output_tokens IS NOT NULL THEN NULL ELSE concat_ws(' | ', CASE WHEN status <> 'success' THEN status END, CASE WHEN output_tokens IS NULL THEN 'no tokens' END) END AS errors FROM results")
def m7(spark: SparkSession, d: str) -> DataFrame:
    scored = F.when(F.col("accuracy").isNotNull(), F.col("k"))
    return frames.results(spark, d).select("seq", measures.optional_sum(F.col("output_tokens"), scored).alias("tokens"), measures.joined(F.when(F.col("status") != "success", F.col("status")), F.when(F.col("output_tokens").isNull(), "no tokens")).alias("errors"))


@Q.add("m8_status_reduce", f"WITH {frames.RESULTS_SQL}, s AS (SELECT seq, status AS a, CASE k % 4 WHEN 0 THEN 'invalid_json' WHEN 1 THEN 'timeout' ELSE 'success' END AS b FROM results) SELECT seq, CASE WHEN 'timeout' IN (a, b) THEN 'timeout' WHEN 'failed' IN (a, b) THEN 'failed' WHEN 'invalid_json' IN (a, b) THEN 'invalid_json' ELSE 'success' END AS status FROM s")
def m8(spark: SparkSession, d: str) -> DataFrame:
    other = F.when(F.pmod("k", F.lit(4)) == 0, "invalid_json").when(F.pmod("k", F.lit(4)) == 1, "timeout").otherwise("success")
    return frames.results(spark, d).select("seq", measures.reduced_status(F.col("status"), other).alias("status"))
