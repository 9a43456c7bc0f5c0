"""Queries: text similarity, entities, scored runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import distance, entities, strings, text
from inkwell.operators import joins, summary

from . import frames
from .registry import Register, round_sql, rounded

Q = Register()
R, H = "ground_truth", "extracted"


@Q.add("x1_levenshtein", f"WITH {frames.SCORED_SQL} SELECT model, case_id, levenshtein(r, h) AS distance FROM scored")
def x1(spark: SparkSession, d: str) -> DataFrame:
    return frames.inferences(spark, d).select("model", "case_id", F.levenshtein(text.normalize(R), text.normalize(H)).cast("long").alias("distance"))


@Q.add("x2_normalize_text", "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s\\p{Z}]', '', 'g'), '[\\s\\p{Z}]+', ' ', 'g'))) AS normalized, length(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s\\p{Z}]', '', 'g'), '[\\s\\p{Z}]+', ' ', 'g'))) AS n FROM documents")
def x2(spark: SparkSession, d: str) -> DataFrame:
    rows = frames.table(spark, d, "documents").select("doc_id", text.normalize(F.col("text")).alias("t"))
    return rows.select("doc_id", F.md5("t").alias("normalized"), F.length("t").cast("long").alias("n"))


@Q.add("x3_cer", f"WITH {frames.SCORED_SQL} SELECT model, case_id, round(cer_all, 6) AS cer FROM scored")
def x3(spark: SparkSession, d: str) -> DataFrame:
    return frames.inferences(spark, d).select("model", "case_id", F.round(text.cer(R, H), 6).alias("cer"))


@Q.add("x3_cer_raw", f"WITH {frames.CASES_SQL}, coded AS (SELECT *, translate(ground_truth, 'ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü', '!\"#$%&()*+-/:;<=>?[]^') AS a, translate(extracted, 'ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü', '!\"#$%&()*+-/:;<=>?[]^') AS b FROM inferences) SELECT model, case_id, round(levenshtein(a, b)::DOUBLE / length(a), 6) AS cer FROM coded")
def x3_raw(spark: SparkSession, d: str) -> DataFrame:
    return frames.inferences(spark, d).select("model", "case_id", F.round(text.cer(R, H, normalized=False), 6).alias("cer"))


@Q.add("x4_wer", f"WITH {frames.SCORED_SQL} SELECT model, case_id, round(wer_all, 6) AS wer FROM scored")
def x4(spark: SparkSession, d: str) -> DataFrame:
    return frames.inferences(spark, d).select("model", "case_id", F.round(text.wer(R, H), 6).alias("wer"))


@Q.add("x5_accuracy", f"WITH {frames.SCORED_SQL} SELECT model, case_id, round(greatest(0.0, 1 - cer_all), 6) AS accuracy FROM scored")
def x5(spark: SparkSession, d: str) -> DataFrame:
    return frames.inferences(spark, d).select("model", "case_id", F.round(text.accuracy(text.cer(R, H)), 6).alias("accuracy"))


@Q.add("x6_numeric_cer", "WITH p AS (SELECT event_id, regexp_replace(props || value::VARCHAR, '[^0-9]', '', 'g') AS r, regexp_replace(replace(props, '7', '1') || value::VARCHAR, '[^0-9]', '', 'g') AS h FROM events) SELECT event_id, round(CASE WHEN r = '' THEN CASE WHEN h = '' THEN 0.0 ELSE 1.0 END ELSE levenshtein(r, h)::DOUBLE / length(r) END, 6) AS numeric_cer FROM p")
def x6(spark: SparkSession, d: str) -> DataFrame:
    value = F.col("value").cast("string")
    rows = frames.table(spark, d, "events").select("event_id", F.concat("props", value).alias("r"), F.concat(F.replace("props", F.lit("7"), F.lit("1")), value).alias("h"))
    return rows.select("event_id", F.round(text.numeric_cer(F.col("r"), F.col("h")), 6).alias("numeric_cer"))


@Q.add(
    "x7_structure",
    "WITH h AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN replace(text, '$', '') WHEN 1 THEN replace(text, '|', '') ELSE text || '| --- $' END AS hyp FROM documents), "
    "p AS (SELECT doc_id, contains(text, '|') AND contains(text, '---') AS rt, contains(hyp, '|') AND contains(hyp, '---') AS ht, contains(text, '$') AS rm, contains(hyp, '$') AS hm FROM h) "
    "SELECT doc_id, CASE WHEN rt THEN ht::INT::DOUBLE END AS table_score, "
    "CASE WHEN rt AND NOT ht THEN 'Table detected in Ground Truth, but missing in OCR output.' WHEN ht AND NOT rt THEN 'Table detected in OCR output, but not in Ground Truth (potential hallucination).' WHEN rt THEN 'Table structure preserved.' ELSE 'No tables present in document.' END AS table_status, "
    "CASE WHEN rm THEN hm::INT::DOUBLE END AS math_score, "
    "CASE WHEN rm AND NOT hm THEN 'Math notation detected in Ground Truth, but missing in OCR output.' WHEN hm AND NOT rm THEN 'Math notation detected in OCR output, but not in Ground Truth.' WHEN rm THEN 'Math notation preserved.' ELSE 'No mathematical notation present.' END AS math_status FROM p",
)
def x7(spark: SparkSession, d: str) -> DataFrame:
    t, turn = F.col("text"), F.pmod("doc_id", F.lit(3))
    hyp = F.when(turn == 0, F.replace(t, F.lit("$"), F.lit(""))).when(turn == 1, F.replace(t, F.lit("|"), F.lit(""))).otherwise(F.concat(t, F.lit("| --- $")))
    tables, maths = [text.has_table(x) for x in (t, hyp)], [text.has_math(x) for x in (t, hyp)]
    return frames.table(spark, d, "documents").select("doc_id", text.kept_score(*tables).alias("table_score"), text.kept_text(*tables, text.TABLE_TEXTS).alias("table_status"), text.kept_score(*maths).alias("math_score"), text.kept_text(*maths, text.MATH_TEXTS).alias("math_status"))


#: Raw rates: letters outside ASCII as one free ASCII character each, words as one character each.
RAW_SQL = """raw_words AS (SELECT *, translate(ground_truth, 'ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü', '!"#$%&()*+-/:;<=>?[]^') AS rc, translate(extracted, 'ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü', '!"#$%&()*+-/:;<=>?[]^') AS hc, list_filter(regexp_split_to_array(ground_truth, '\\s+'), lambda x: x <> '') AS rl, list_filter(regexp_split_to_array(extracted, '\\s+'), lambda x: x <> '') AS hl FROM scored),
raw_known AS (SELECT *, list_distinct(list_concat(rl, hl)) AS known FROM raw_words),
raw_rates AS (SELECT *, levenshtein(rc, hc)::DOUBLE / length(rc) AS cer_raw, levenshtein(array_to_string(list_transform(rl, lambda x: chr(list_position(known, x)::INT)), ''), array_to_string(list_transform(hl, lambda x: chr(list_position(known, x)::INT)), ''))::DOUBLE / len(rl) AS wer_raw FROM raw_known)"""


@Q.add("x8_evaluate_standard", f"WITH {frames.SCORED_SQL}, {RAW_SQL} SELECT model, case_id, round(cer_all, 6) AS cer, round(cer_raw, 6) AS cer_raw, round(wer_all, 6) AS wer, round(wer_raw, 6) AS wer_raw, round(greatest(0.0, 1 - cer_all), 6) AS accuracy, NULL::DOUBLE AS table_score, 'No tables present in document.' AS table_status, NULL::DOUBLE AS math_score, 'No mathematical notation present.' AS math_status FROM raw_rates")
def x8(spark: SparkSession, d: str) -> DataFrame:
    rows = frames.inferences(spark, d)
    return rounded(rows.select("model", "case_id", *[c.alias(n) for n, c in text.standard_scores(F.col(R), F.col(H)).items()]), "cer", "cer_raw", "wer", "wer_raw", "accuracy")


def invoices(spark: SparkSession, d: str) -> DataFrame:
    """A line with an IBAN and an amount for every order, and the line as a weak model reads it."""
    account = F.lpad(F.col("o_orderkey").cast("string"), 18, "0")
    total = F.format_string("%.2f", F.col("o_totalprice"))
    line = F.concat(F.lit("Pay "), total, F.lit(" EUR to "), entities.make_iban(F.lit("DE"), account), F.lit(" before "), F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = frames.dealt(frames.table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate"), "o_orderkey").select("o_orderkey", line.alias("reference"))
    read = F.when(F.pmod("o_orderkey", F.lit(3)) == 0, F.col("reference")).when(F.pmod("o_orderkey", F.lit(3)) == 1, F.replace("reference", F.lit("1"), F.lit("7"))).otherwise(F.replace("reference", F.lit(" EUR"), F.lit("")))
    return rows.withColumn("hypothesis", read)


_MOD97 = "(98 - CAST(({account}::HUGEINT * 1000000 + 131400) % 97 AS INT))"
INVOICES_SQL = (
    "plain AS (SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 18, '0') AS account, printf('%.2f', o_totalprice) AS total, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders), "
    f"ibans AS (SELECT *, 'DE' || lpad({_MOD97.format(account='o_orderkey')}::VARCHAR, 2, '0') || account AS iban FROM plain), "
    "lines AS (SELECT o_orderkey, iban, total, 'Pay ' || total || ' EUR to ' || rtrim(regexp_replace(iban, '(.{4})', '\\1 ', 'g')) || ' before ' || day AS reference FROM ibans), "
    "invoices AS (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN reference WHEN 1 THEN replace(reference, '1', '7') ELSE replace(reference, ' EUR', '') END AS hypothesis FROM lines), "
    "found AS (SELECT *, list_transform(regexp_extract_all(upper(reference), '\\b[A-Z]{2}[0-9]{2}(?:\\s?[A-Z0-9]{4}){2,7}(?:\\s?[A-Z0-9]{1,4})?\\b'), lambda x: replace(x, ' ', '')) AS ri, "
    "list_transform(regexp_extract_all(upper(hypothesis), '\\b[A-Z]{2}[0-9]{2}(?:\\s?[A-Z0-9]{4}){2,7}(?:\\s?[A-Z0-9]{1,4})?\\b'), lambda x: replace(x, ' ', '')) AS hi FROM invoices)"
)


@Q.add("e1_extract_ibans", f"WITH {INVOICES_SQL} SELECT o_orderkey, array_to_string(ri, ',') AS own, array_to_string(hi, ',') AS seen FROM found")
def e1(spark: SparkSession, d: str) -> DataFrame:
    return invoices(spark, d).select("o_orderkey", F.array_join(entities.ibans(F.col("reference")), ",").alias("own"), F.array_join(entities.ibans(F.col("hypothesis")), ",").alias("seen"))


_VALID = "(CAST(substring({x}, 5)::HUGEINT * 1000000 + 131400 + substring({x}, 3, 2)::INT AS HUGEINT) % 97 = 1)"


@Q.add("e2_iban_valid", f"WITH {INVOICES_SQL}, one AS (SELECT o_orderkey, unnest(hi) AS iban FROM found) SELECT o_orderkey, iban, {_VALID.format(x='iban')} AS valid FROM one")
def e2(spark: SparkSession, d: str) -> DataFrame:
    return invoices(spark, d).select("o_orderkey", F.explode(entities.ibans(F.col("hypothesis"))).alias("iban")).withColumn("valid", entities.iban_valid(F.col("iban")))


_CURRENCY = "(?i)(?:\\b\\d{1,3}(?:[.,]\\d{3})*(?:[.,]\\d{2})?\\s?(?:EUR|USD|GBP|CHF|\\$|€|£)\\b)|(?:\\b(?:EUR|USD|GBP|CHF|\\$|€|£)\\s?\\d{1,3}(?:[.,]\\d{3})*(?:[.,]\\d{2})?\\b)"


@Q.add("e3_extract_amounts", f"WITH {INVOICES_SQL}, a AS (SELECT o_orderkey, list_transform(list_concat(regexp_extract_all(reference, '{_CURRENCY}'), regexp_extract_all(reference, '\\b\\d{{1,9}}[.,]\\d{{2}}\\b')), lambda x: lower(replace(x, ' ', ''))) AS l FROM invoices) SELECT o_orderkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS amounts FROM a")
def e3(spark: SparkSession, d: str) -> DataFrame:
    return invoices(spark, d).select("o_orderkey", F.array_join(entities.amounts(F.col("reference")), ",").alias("amounts"))


@Q.add("e4_iban_emr", f"WITH {INVOICES_SQL} SELECT o_orderkey, CASE WHEN len(ri) > 0 THEN len(list_filter(ri, lambda x: list_contains(hi, x)))::DOUBLE / len(ri) END AS iban_emr FROM found")
def e4(spark: SparkSession, d: str) -> DataFrame:
    return invoices(spark, d).select("o_orderkey", entities.match_rate(entities.ibans(F.col("reference")), entities.ibans(F.col("hypothesis"))).alias("iban_emr"))


@Q.add("e5_iban_valid_rate", f"WITH {INVOICES_SQL} SELECT o_orderkey, CASE WHEN len(hi) > 0 THEN len(list_filter(hi, lambda x: {_VALID.format(x='x')}))::DOUBLE / len(hi) END AS iban_valid_rate FROM found")
def e5(spark: SparkSession, d: str) -> DataFrame:
    return invoices(spark, d).select("o_orderkey", entities.valid_rate(entities.ibans(F.col("hypothesis"))).alias("iban_valid_rate"))


@Q.add("e6_generate_iban", f"WITH {INVOICES_SQL} SELECT o_orderkey, rtrim(regexp_replace(iban, '(.{{4}})', '\\1 ', 'g')) AS iban FROM lines")
def e6(spark: SparkSession, d: str) -> DataFrame:
    account = F.lpad(F.col("o_orderkey").cast("string"), 18, "0")
    return frames.table(spark, d, "orders").select("o_orderkey", entities.make_iban(F.lit("DE"), account).alias("iban"))


@Q.add("e7_status_texts", f"WITH {INVOICES_SQL} SELECT o_orderkey, 'IBANs matched: ' || len(list_filter(ri, lambda x: list_contains(hi, x))) || '/' || len(ri) || ' (' || (100 * len(list_filter(ri, lambda x: list_contains(hi, x))) // len(ri)) || '%) | Output validity: ' || len(list_filter(hi, lambda x: {_VALID.format(x='x')})) || '/' || len(hi) || ' (' || (100 * len(list_filter(hi, lambda x: {_VALID.format(x='x')})) // len(hi)) || '%) valid' AS iban_status FROM found")
def e7(spark: SparkSession, d: str) -> DataFrame:
    return invoices(spark, d).select("o_orderkey", entities.iban_text(entities.ibans(F.col("reference")), entities.ibans(F.col("hypothesis"))).alias("iban_status"))


_NORM = frames.normal_sql


@Q.add(
    "x9_evaluate_bank",
    f"""WITH {INVOICES_SQL},
parts AS (SELECT *, regexp_replace(reference, '[^0-9]', '', 'g') AS rd, regexp_replace(hypothesis, '[^0-9]', '', 'g') AS hd, {_NORM('reference')} AS r, {_NORM('hypothesis')} AS h,
  list_distinct(list_transform(list_concat(regexp_extract_all(reference, '{_CURRENCY}'), regexp_extract_all(reference, '\\b\\d{{1,9}}[.,]\\d{{2}}\\b')), lambda x: lower(replace(x, ' ', '')))) AS ra,
  list_distinct(list_transform(list_concat(regexp_extract_all(hypothesis, '{_CURRENCY}'), regexp_extract_all(hypothesis, '\\b\\d{{1,9}}[.,]\\d{{2}}\\b')), lambda x: lower(replace(x, ' ', '')))) AS ha FROM found),
m AS (SELECT o_orderkey, levenshtein(rd, hd)::DOUBLE / length(rd) AS numeric_cer, CASE WHEN len(ri) > 0 THEN len(list_filter(ri, lambda x: list_contains(hi, x)))::DOUBLE / len(ri) END AS iban_emr,
  CASE WHEN len(ra) > 0 THEN len(list_filter(ra, lambda x: list_contains(ha, x)))::DOUBLE / len(ra) END AS amount_emr, greatest(0.0, 1 - levenshtein(r, h)::DOUBLE / length(r)) AS general_accuracy FROM parts)
SELECT o_orderkey, round((coalesce(0.35::DOUBLE * iban_emr, 0) + coalesce(0.25::DOUBLE * amount_emr, 0) + 0.2::DOUBLE * greatest(0.0, 1 - numeric_cer) + 0.2::DOUBLE * general_accuracy) / (CASE WHEN iban_emr IS NULL THEN 0 ELSE 0.35::DOUBLE END + CASE WHEN amount_emr IS NULL THEN 0 ELSE 0.25::DOUBLE END + 0.4::DOUBLE), 6) AS bank_score,
  {round_sql('numeric_cer', 'iban_emr', 'amount_emr', 'general_accuracy')} FROM m""",
)
def x9(spark: SparkSession, d: str) -> DataFrame:
    names = ["bank_score", "numeric_cer", "iban_emr", "amount_emr", "general_accuracy"]
    return rounded(entities.with_bank_scores(invoices(spark, d), "reference", "hypothesis").select("o_orderkey", *names), *names)


@Q.add(
    "x10_notebook_profile",
    f"""WITH {frames.CASES_SQL}, n AS (SELECT *, translate(trim(regexp_replace(lower(ground_truth), '[\\s\\p{{Z}}]+', ' ', 'g')), 'ßäçèéêíñóöü', '!#%&()*+;<=') AS r, translate(trim(regexp_replace(lower(extracted), '[\\s\\p{{Z}}]+', ' ', 'g')), 'ßäçèéêíñóöü', '!#%&()*+;<=') AS h FROM inferences)
SELECT model, case_id, round(levenshtein(r, h)::DOUBLE / length(r), 6) AS cer, round(levenshtein(r, h)::DOUBLE / len(string_split(r, ' ')), 6) AS wer, r = h AS exact FROM n""",
)
def x10(spark: SparkSession, d: str) -> DataFrame:
    same = text.normalize(R, "notebook") == text.normalize(H, "notebook")
    return frames.inferences(spark, d).select("model", "case_id", F.round(text.cer(R, H, profile="notebook"), 6).alias("cer"), F.round(text.notebook_wer(R, H), 6).alias("wer"), same.alias("exact"))


@Q.add("j1_model_case_matrix", f"WITH {frames.CASES_SQL} SELECT model, case_id, image_path, category FROM inferences")
def j1(spark: SparkSession, d: str) -> DataFrame:
    return joins.model_cases(frames.models(spark), frames.cases(spark, d)).select("model", "case_id", "image_path", "category")


@Q.add(
    "t1_recommend_ranking",
    f"""WITH {frames.SCORED_SQL}, s AS (SELECT model, count(*) AS documents, avg(CASE WHEN status = 'success' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS success_rate, avg(accuracy) AS quality, avg(cer) AS cer, avg(wer) AS wer, quantile_cont(CASE WHEN status = 'success' THEN latency END, 0.95) AS latency_p95 FROM scored GROUP BY model)
SELECT model, documents, {round_sql('success_rate', 'quality', 'cer', 'wer', 'latency_p95')}, row_number() OVER (ORDER BY CASE WHEN success_rate >= 0.95 AND quality IS NOT NULL THEN 0 ELSE 1 END, quality DESC NULLS LAST, latency_p95 ASC NULLS LAST, model)::INT AS rank FROM s""",
)
def t1_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: models by cases, scored, summarised and ranked in one plan."""
    null = F.lit(None).cast("double")
    rows = frames.scored(spark, d).withColumns({c: null for c in ("tokens_per_second", "output_tokens", "iban_emr", "amount_emr")})
    names = ["success_rate", "quality", "cer", "wer", "latency_p95"]
    return rounded(summary.ranked(summary.model_summary(rows)).select("model", "documents", *names, "rank"), *names)


@Q.add("a4_scored_accuracy", f"WITH {frames.SCORED_SQL} SELECT model, round(avg(accuracy), 6) AS accuracy FROM scored WHERE accuracy IS NOT NULL GROUP BY model")
def a4(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summary.mean_by(frames.scored(spark, d).where("accuracy is not null"), ["model"], "accuracy", "accuracy", False), "accuracy")


@Q.add("x3_cer_conversations", f"WITH p AS (SELECT conv_id, turn, {frames.normal_sql('text')} AS r, {frames.normal_sql(chr(39).join(('translate(text, ', 'bghnuvzBDZ', ', ', '6qbrvu2802', ')')))} AS h FROM conversations) SELECT conv_id, turn, round(CASE WHEN r = '' THEN CASE WHEN h = '' THEN 0.0 ELSE 1.0 END ELSE levenshtein(r, h)::DOUBLE / length(r) END, 6) AS cer FROM p")
def x3_conversations(spark: SparkSession, d: str) -> DataFrame:
    """Character error rates of a growing table's whole texts against their look-alikes."""
    t = F.col("text")
    # edit distance costs the product of the lengths: dealing the rows out keeps long texts from one task
    rows = frames.dealt(frames.table(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn")
    return rows.select("conv_id", "turn", F.round(text.cer(t, F.translate(t, *strings.LOOK_ALIKES)), 6).alias("cer"))


def read_documents(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents and what a weak model reads of them: words are missing, letters look alike."""
    # a pair costs the product of its lengths: dealing the rows out keeps long texts from one task
    rows = frames.dealt(frames.table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return rows.withColumn("read", strings.corrupted(F.col("text"), F.col("doc_id"), F.lit(2), F.lit(15)))


@Q.add("x3_cer_documents")
def x3_documents(spark: SparkSession, d: str) -> DataFrame:
    """Edit distance and character error rates of texts of any length, in full; too slow in SQL, tested against plain Python."""
    return distance.with_rates(read_documents(spark, d), "text", "read").select("doc_id", "distance", "cer", "accuracy")


@Q.add("x4_wer_documents")
def x4_documents(spark: SparkSession, d: str) -> DataFrame:
    """Word error rates of texts of any length, in full; too slow in SQL, tested against plain Python."""
    return distance.with_rates(read_documents(spark, d), "text", "read").select("doc_id", "wer")
