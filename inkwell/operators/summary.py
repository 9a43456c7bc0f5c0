"""Summaries of results by model, rankings, running views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import quantiles, running_sums, same


def good(value: str) -> Column:
    """The value where the result is a success; null elsewhere, so aggregates skip it."""
    return F.when(F.col("status") == "success", F.col(value))


def model_summary(results: DataFrame) -> DataFrame:
    """One row a model: counts over all rows, metrics over successes, in one aggregation; exact percentiles beside it.

    Metrics that are null everywhere stay null. ``first`` is the model's first appearance.
    """
    mean = lambda c: F.avg(good(c))
    latency = F.avg(good("latency"))
    latencies = quantiles(results.select("model", good("latency").alias("latency")), "model", "latency", {"latency_median": 0.5, "latency_p95": 0.95})
    return results.groupBy("model").agg(
        F.min("seq").alias("first"),
        F.count("*").alias("documents"),
        F.avg((F.col("status") == "success").cast("double")).alias("success_rate"),
        mean("accuracy").alias("quality"),
        latency.alias("latency_mean"),
        F.try_divide(F.lit(1.0), latency).alias("documents_per_second"),
        mean("tokens_per_second").alias("tokens_per_second"),
        F.sum(good("output_tokens")).alias("output_tokens"),
        mean("cer").alias("cer"),
        mean("wer").alias("wer"),
        mean("table_score").alias("table_score"),
        mean("math_score").alias("math_score"),
        mean("iban_emr").alias("iban_emr"),
        mean("amount_emr").alias("amount_emr"),
    ).join(latencies.withColumnRenamed("model", "model_key_"), same(["model"], ["model_key_"]), "left").drop("model_key_")


def devices(results: DataFrame) -> DataFrame:
    """The devices of each model, sorted, in one text."""
    return results.groupBy("model").agg(F.array_join(F.array_sort(F.collect_set(F.nullif("device", F.lit("")))), ", ").alias("devices"))


def mean_by(results: DataFrame, keys: list[str], value: str, name: str, only_success: bool) -> DataFrame:
    rows = results.where("status = 'success'") if only_success else results
    return rows.groupBy(*keys).agg(F.avg(value).alias(name))


def rollup_quality(results: DataFrame) -> DataFrame:
    """Quality by model and category, by model, and in all. An extension of the two summaries."""
    return results.where("status = 'success'").rollup("model", "category").agg(F.avg("accuracy").alias("quality"), F.count("*").alias("documents"))


def reliability(summary: DataFrame) -> DataFrame:
    return summary.select("model", (F.col("success_rate") * 100).alias("success_percent"), (100 - F.col("success_rate") * 100).alias("failed_percent"))


def quality_speed(summary: DataFrame) -> DataFrame:
    return summary.select("model", "latency_mean", (F.col("quality") * 100).alias("quality_percent")).dropna()


def latency_long(summary: DataFrame) -> DataFrame:
    return summary.unpivot("model", ["latency_mean", "latency_median", "latency_p95"], "measure", "seconds")


def notebook_summary(results: DataFrame) -> DataFrame:
    """The notebook's rules: metrics over all rows."""
    return results.groupBy("model").agg(
        F.count("*").alias("documents"), F.avg((F.col("status") == "success").cast("double")).alias("success_rate"),
        F.avg("latency").alias("latency_mean"),
        F.avg("cer").alias("cer"), F.avg("wer").alias("wer"), F.avg(F.col("exact").cast("double")).alias("exact_match"),
    ).join(quantiles(results, "model", "latency", {"latency_p95": 0.95}).withColumnRenamed("model", "model_key_"), same(["model"], ["model_key_"]), "left").drop("model_key_")


def qualified(summary: DataFrame, least: float = 0.95) -> DataFrame:
    """Candidates for a recommendation: reliable, with a quality."""
    return summary.where((F.col("success_rate") >= least) & F.col("quality").isNotNull())


def recommended(summary: DataFrame, least: float = 0.95) -> DataFrame:
    """The best candidate: quality, then the latency's 95th percentile."""
    return qualified(summary, least).orderBy(F.desc_nulls_last("quality"), F.asc_nulls_last("latency_p95"), "model").limit(1)


def ranked(summary: DataFrame) -> DataFrame:
    """All models in order of recommendation; a window over one row a model."""
    order = Window.orderBy(F.desc("eligible"), F.desc_nulls_last("quality"), F.asc_nulls_last("latency_p95"), "model")
    return summary.withColumn("eligible", ((F.col("success_rate") >= 0.95) & F.col("quality").isNotNull()).cast("int")).withColumn("rank", F.row_number().over(order))


def notebook_best(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.desc_nulls_last("success_rate"), F.asc_nulls_last("cer"), F.asc_nulls_last("latency_mean"), "model").limit(1)


def quartiles(results: DataFrame) -> DataFrame:
    ends = results.groupBy("model").agg(F.min("latency").alias("low"), F.max("latency").alias("high"))
    found = quantiles(results, "model", "latency", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).withColumnRenamed("model", "model_key_")
    return ends.join(found, same(["model"], ["model_key_"]), "left").select("model", "q1", "q2", "q3", "low", "high")


def live_tail(results: DataFrame, n: int = 25) -> DataFrame:
    """The last results with their number in the run: the tail is found first (a top-n), then numbered."""
    total = results.agg(F.count("*").alias("total"))
    tail = results.orderBy(F.desc("seq")).limit(n)
    # one row is broadcast
    numbered = tail.withColumn("back", F.row_number().over(Window.orderBy(F.desc("seq"))) - 1).crossJoin(F.broadcast(total))
    return numbered.withColumn("position", F.col("total") - F.col("back")).drop("back", "total")


def progress(results: DataFrame, by: list[str]) -> DataFrame:
    """After each result of a run: how many are done, the seconds so far, the seconds left."""
    sums = {"done": F.lit(1).cast("long"), "elapsed_": F.col("latency").cast("decimal(18, 4)"), "errors": (F.col("status") != "success").cast("long")}
    rows = running_sums(results.select(*by, "seq", "latency", "status"), by, "seq", sums)
    keys = [f"{c}_key_" for c in by]
    whole = results.groupBy(*by).agg(F.count("*").alias("total")).select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], "total")
    elapsed, done = F.col("elapsed_").cast("double"), F.col("done")
    return rows.join(whole, same(by, keys)).select(*by, "seq", "done", "total", elapsed.alias("elapsed"), (elapsed / done * (F.col("total") - done)).alias("left"), "errors")


def until_errors(results: DataFrame, by: list[str], most: int) -> DataFrame:
    """A run's results up to the one that reaches so many errors; all of them if ``most`` is not positive."""
    if most <= 0:
        return results
    error = (F.col("status") != "success").cast("long")
    return running_sums(results, by, "seq", {"errors_": error}).where(F.col("errors_") - error < most).drop("errors_")


def running_summary(results: DataFrame) -> DataFrame:
    """The model's success rate and quality after each of its results."""
    # decimals: a running sum of doubles depends on how an engine adds
    sums = {"documents": F.lit(1).cast("long"), "ok_": (F.col("status") == "success").cast("long"), "sum_": good("accuracy").cast("decimal(18, 6)"), "n_": good("accuracy").isNotNull().cast("long")}
    rows = running_sums(results.select("model", "seq", "status", "accuracy"), ["model"], "seq", sums)
    return rows.select("model", "seq", "documents", (F.col("ok_") / F.col("documents")).alias("success_rate"), F.try_divide(F.col("sum_").cast("double"), F.col("n_")).alias("quality"))
