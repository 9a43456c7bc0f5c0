"""Order statistics of groups of any size and shape: running sums over balanced ranges, exact quantiles by distributed selection.

Neither gathers a group in one task, whatever its share of the rows, however its
values lie, and however often one of them occurs. Null groups are groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.shared import fresh_folder

#: Brackets of quantiles are broadcast up to this number, and joined by key beyond it.
MOST_BRACKETS = 100_000


def kept(rows: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: read again, never computed again."""
    spark, path = rows.sparkSession, fresh_folder(rows.sparkSession, "kept")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def same(left: list[str], right: list[str]) -> Column:
    """Equality of keys in which null equals null."""
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)])


def running_sums(rows: DataFrame, by: list[str], order: str, sums: dict[str, Column], part_rows: int = 1_000_000) -> DataFrame:
    """The rows with sums up to and with each one, in the order of a number within ``by``; rows without a number come last.

    Up to ``part_rows`` rows are a window. More are dealt in ranges of group, number and
    turn, balanced by a sample of these, so a group, or one number in it, that holds most rows
    fills many ranges. The ranges are written; each is summed by itself. A range that goes on
    with a group starts with the sums of that group in the ranges before: an exclusive
    scan over one row for each group and range.
    """
    total = rows.count()
    if total <= part_rows:
        window = Window.partitionBy(*by).orderBy(F.asc_nulls_last(order)).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({n: F.sum(c).over(window) for n, c in sums.items()})
    own, names = {n: f"{n}_own_" for n in sums}, rows.columns
    turned = rows.withColumns({own[n]: c for n, c in sums.items()} | {"turn_": F.monotonically_increasing_id()})
    turned = kept(turned)
    keys = [*[F.asc(c) for c in by], F.asc_nulls_last(order), F.asc("turn_")]
    ranged = turned.repartitionByRange(-(-total // part_rows), *keys).sortWithinPartitions(*keys)
    # the number of a row holds its range and its place in it
    ranged = kept(ranged.withColumn("place_", F.monotonically_increasing_id())).withColumn("part_", F.shiftright("place_", 33))
    totals = ranged.groupBy(*by, "part_").agg(*[F.sum(own[n]).alias(f"{n}_whole_") for n in sums])
    earlier = Window.partitionBy(*by).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("*", F.count("*").over(earlier).alias("earlier_"), *[F.sum(f"{n}_whole_").over(earlier).alias(f"{n}_before_") for n in sums]).where("earlier_ > 0")
    # a group goes on into a range at most once for each range: a row a range is broadcast
    before = before.select(*[F.col(c).alias(f"{c}_key_") for c in by], F.col("part_").alias("part_key_"), *[f"{n}_before_" for n in sums])
    inside = Window.partitionBy(*by, "part_").orderBy("place_").rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumns({f"{n}_inside_": F.sum(own[n]).over(inside) for n in sums})
    summed = summed.join(F.broadcast(before), same([*by, "part_"], [*[f"{c}_key_" for c in by], "part_key_"]), "left")
    whole = lambda n: F.coalesce(F.col(f"{n}_inside_") + F.col(f"{n}_before_"), f"{n}_inside_", f"{n}_before_")
    return summed.select(*names, *[whole(n).alias(n) for n in sums])


def magnitude(value: Column) -> Column:
    """A whole number that never falls as the value rises: the sign and the power of two; not-a-number is the largest."""
    power = lambda x: F.least(F.floor(F.log2(x)), F.lit(1100)) + 2000
    return F.when(F.isnan(value), 4000).when(value > 0, power(value)).when(value < 0, -power(-value)).otherwise(0)


def selected(values: DataFrame, targets: DataFrame, few: int, bins: int) -> DataFrame:
    """g_, k_ and v_: the value at each target's place (k_, from 0) in its group's order.

    A target has a bracket: the least and the largest value among which it lies, how many values
    those are, and how many lie before them. Rounds of histograms, of all brackets
    at once, replace brackets of over ``few`` values by that of their bins which holds the
    place; the bracket's ends are the least and largest value of the bin, so a bin of one
    value ends the search however many rows hold it. The first bins are powers of two,
    later ones equal widths: some six rounds reach the last bit of a double.
    """
    if values.count() <= few:
        return ranked(values, targets.withColumn("at_", F.col("k_")), ["g_"]).select("g_", "k_", F.col("found_").alias("v_"))
    first = values.groupBy("g_", magnitude(F.col("v_")).alias("bin_")).agg(F.count("*").alias("n_"), F.min("v_").alias("lo_"), F.max("v_").alias("hi_"))
    found = narrowed(targets.withColumns({"at_": F.col("k_")}), first, ["g_"])
    done = []
    while True:
        found = kept(found)
        done.append(found.where("lo_ <=> hi_"))
        open_ = found.where("not (lo_ <=> hi_)")
        state = open_.agg(F.count("*"), F.max("n_")).first()
        if not state[0]:
            break
        brackets = open_.select("g_", "lo_", "hi_").distinct()
        inside = within(values, brackets, state[0])
        if state[1] <= few:
            ended = ranked(inside, open_, ["g_", "lo_", "hi_"]).drop("lo_", "hi_")
            done.append(ended.select("g_", "k_", "at_", "n_", F.col("found_").alias("lo_"), F.col("found_").alias("hi_")))
            break
        share = (F.col("v_") - F.col("lo_")) / (F.col("hi_") - F.col("lo_"))
        bin_ = F.least(F.floor(share * bins), F.lit(bins - 1))
        histogram = inside.groupBy("g_", "lo_", "hi_", bin_.alias("bin_")).agg(F.count("*").alias("n_"), F.min("v_").alias("low_"), F.max("v_").alias("high_"))
        found = narrowed(open_.drop("n_"), histogram, ["g_", "lo_", "hi_"], "low_", "high_")
    return reduce(DataFrame.unionByName, [d.select("g_", "k_", F.col("lo_").alias("v_")) for d in done])


def narrowed(targets: DataFrame, histogram: DataFrame, keys: list[str], low: str = "lo_", high: str = "hi_") -> DataFrame:
    """The targets with the bracket of the bin that holds them; a histogram has a bounded number of bins for each key."""
    upto = F.sum("n_").over(Window.partitionBy(*keys).orderBy("bin_"))
    bins = histogram.withColumn("upto_", upto).select(*[F.col(k).alias(f"{k}b_") for k in keys], F.col("n_").alias("bn_"), "upto_", F.col(low).alias("blo_"), F.col(high).alias("bhi_"))
    at = (F.col("upto_") - F.col("bn_") <= F.col("at_")) & (F.col("at_") < F.col("upto_"))
    both = targets.join(bins, same(keys, [f"{k}b_" for k in keys]) & at)
    return both.select("g_", "k_", (F.col("at_") - (F.col("upto_") - F.col("bn_"))).alias("at_"), F.col("bn_").alias("n_"), F.col("blo_").alias("lo_"), F.col("bhi_").alias("hi_"))


def ranked(values: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """The targets with found_, the value at their place among those of their keys: few, and sorted in one task."""
    upto = F.sum("m_").over(Window.partitionBy(*keys).orderBy("v_"))
    counted = values.groupBy(*keys, "v_").agg(F.count("*").alias("m_")).withColumn("upto_", upto)
    placed = counted.select(*[F.col(k).alias(f"{k}b_") for k in keys], F.col("v_").alias("found_"), "upto_", "m_")
    at = (F.col("upto_") - F.col("m_") <= F.col("at_")) & (F.col("at_") < F.col("upto_"))
    return targets.join(placed, same(keys, [f"{k}b_" for k in keys]) & at).select(*targets.columns, "found_")


def within(values: DataFrame, brackets: DataFrame, number: int) -> DataFrame:
    """The values that lie in brackets of their group, with these."""
    own = brackets.select(F.col("g_").alias("bg_"), "lo_", "hi_")
    # a checked number is broadcast; beyond it the groups are many, and a hot one is split by adaptive execution
    own = F.broadcast(own) if number <= MOST_BRACKETS else own
    return values.join(own, F.col("g_").eqNullSafe(F.col("bg_")) & (F.col("v_") >= F.col("lo_")) & (F.col("v_") <= F.col("hi_"))).select("g_", "v_", "lo_", "hi_")


def quantiles(rows: DataFrame, by: str, value: str, shares: dict[str, float], few: int = 1_000_000, bins: int = 2048) -> DataFrame:
    """Exact quantiles of each group, as doubles, interpolated between neighbours; nulls don't count, a group without a value has none.

    The places are selected, not sorted for: no task holds more than ``few`` values of a group.
    Not-a-number is larger than any other value.
    """
    values = kept(rows.where(F.col(value).isNotNull()).select(F.col(by).alias("g_"), F.col(value).cast("double").alias("v_")))
    totals = values.groupBy("g_").agg(F.count("*").alias("all_"))
    place = lambda p: F.lit(p) * (F.col("all_") - 1)
    ends = F.array(*[f(place(p)).cast("long") for p in shares.values() for f in (F.floor, F.ceil)])
    targets = totals.select("g_", F.explode(F.array_distinct(ends)).alias("k_"))
    found = selected(values, targets, few, bins).select(F.col("g_").alias("fg_"), F.col("k_"), F.col("v_"))
    # a row for each group and place, joined to a row for each group
    both = totals.join(found, F.col("g_").eqNullSafe(F.col("fg_")))
    value_at = lambda k: F.max(F.when(F.col("k_") == k.cast("long"), F.col("v_")))
    picked = [f for n, p in shares.items() for f in (value_at(F.floor(place(p))).alias(f"{n}_lo_"), value_at(F.ceil(place(p))).alias(f"{n}_hi_"))]
    out = both.groupBy("g_", "all_").agg(*picked)

    def between(n: str, p: float) -> Column:
        low, high = F.col(f"{n}_lo_"), F.col(f"{n}_hi_")
        # equal ends, infinite ones too, need no arithmetic
        return F.when(low.eqNullSafe(high), low).otherwise(low + (high - low) * (place(p) - F.floor(place(p))))

    return out.select(F.col("g_").alias(by), *[between(n, p).alias(n) for n, p in shares.items()])
