"""Joins and set operations of the benchmark and of folder scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the models' side of the cross product: a run compares a handful of models.
MOST_MODELS = 1000


def model_cases(models: DataFrame, cases: DataFrame) -> DataFrame:
    """Every case for every model, model by model; the models are broadcast behind a check of their number."""
    if models.limit(MOST_MODELS + 1).count() > MOST_MODELS:
        raise ValueError(f"more than {MOST_MODELS} models")
    return cases.crossJoin(F.broadcast(models))


def last_by(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The last value of each key, pre-aggregated before the shuffle."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def pairs_by_stem(left: DataFrame, right: DataFrame) -> DataFrame:
    """Files of two folders with the same stem; of repeated stems the later path."""
    one = left.groupBy("stem").agg(F.max("path").alias("image_path"))
    return one.join(right.groupBy("stem").agg(F.max("path").alias("annotation_path")), "stem")


def existing(rows: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """The rows all of whose paths exist."""
    for key in keys:
        rows = rows.join(files.select(F.col("path").alias(key)), key, "left_semi")
    return rows


def not_imported(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known.select(key), key, "left_anti")


def latest(events: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """Each key's values, the last one that is not null of each: later events overwrite, absent fields stay."""
    return events.groupBy(key).agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values])


def sides(files: DataFrame, client: str, side: str) -> DataFrame:
    """One row a client: a source for each side, what is missing or repeated, and its status, in one aggregation."""
    of = lambda s: F.when(F.col(side) == s, F.col("path"))
    count = lambda s: F.count(of(s))
    grouped = files.groupBy(client).agg(*[F.min(of(s)).alias(f"{s}_source") for s in ("recto", "verso")], *[count(s).alias(f"{s}_files") for s in ("recto", "verso")])
    issues = F.array_compact(F.array(*[F.when(F.col(f"{s}_files") == 0, f"missing_{s}") for s in ("recto", "verso")], *[F.when(F.col(f"{s}_files") > 1, f"duplicate_{s}") for s in ("recto", "verso")]))
    ready = F.col("recto_source").isNotNull() & F.col("verso_source").isNotNull()
    return grouped.select(client, "recto_source", "verso_source", issues.alias("issues"), F.when(ready, "ready").otherwise("incomplete").alias("status"))
