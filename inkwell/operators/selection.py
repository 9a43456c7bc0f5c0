"""Filters, samples and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN_ID = r"^(cni-)?\d{8}-\d{6}-[a-f0-9]{8}$"
#: Quotas that are broadcast.
MOST_QUOTAS = 100_000
CLIENT_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"


def in_category(rows: DataFrame, category: str) -> DataFrame:
    return rows if category == "All" else rows.where(F.col("category") == category)


def accuracy_range(rows: DataFrame, one: float, other: float, unscored: bool) -> DataFrame:
    """Scores between two percents, in either order; rows without a score if wanted."""
    low, high = sorted((one, other))
    return rows.where((F.col("accuracy").isNull() & F.lit(unscored)) | (F.col("accuracy") * 100).between(low, high))


def shuffled(seed: int, key: str) -> Column:
    """A repeatable order that any engine can compute."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def sample(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows without replacement, all if there are fewer."""
    if n <= 0:
        raise ValueError("the number of rows is positive")
    return rows.orderBy(shuffled(seed, key), key).limit(n)


def sample_by(rows: DataFrame, quotas: DataFrame, seed: int, key: str, by: str) -> DataFrame:
    """At most ``requested`` rows of each group; groups without a quota give none.

    The group limit is pushed below the shuffle, so a large group sends few rows.
    Quotas are broadcast behind a check of their number, and joined by key beyond it.
    """
    turn = Window.partitionBy(by).orderBy(shuffled(seed, key), key)
    few = quotas.limit(MOST_QUOTAS + 1).count() <= MOST_QUOTAS
    wanted = quotas.select(by, "requested")
    top = rows.join(F.broadcast(wanted) if few else wanted, by)
    most = quotas.agg(F.max("requested")).first()[0] or 0
    return top.withColumn("turn", F.row_number().over(turn)).where((F.col("turn") <= most) & (F.col("turn") <= F.col("requested"))).drop("requested")


def at_mask(rows: DataFrame, mask: DataFrame) -> DataFrame:
    """The rows whose position is ticked in the mask (position, ticked)."""
    return rows.join(mask.where("ticked").select("position"), "position", "left_semi")


def host_allowed(url: Column, hosts: list[str]) -> Column:
    """Whether the scheme is http(s) and the host is listed; no list refuses all."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(url.rlike("^(?i)https?://") & host.isin(*hosts), F.lit(False)) if hosts else F.lit(False)


def port(url: Column) -> Column:
    own = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*:(\d+)", 1)
    return F.when(own != "", own.cast("int")).when(F.startswith(url, F.lit("https:")), 443).otherwise(80)
