"""Tables for display, queue and scan counts, lines of text from boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import kept, running_sums, same

# The states of the import queue and how they are shown.
STATE_LABELS = {"discovered": "Découvert", "documents_detected": "Documents détectés", "downloaded": "Téléchargé", "label_normalized": "Label normalisé", "ready": "Prêt", "ready_without_label": "Prêt sans label", "failed": "Erreur"}
READY = ("ready", "ready_without_label")
WAITING = ("discovered", "documents_detected", "downloaded", "label_normalized")


def state_label(state: Column) -> Column:
    """The state's label, the state itself if it is unknown, a dash for null."""
    known = F.create_map(*[F.lit(x) for pair in STATE_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, state), state, F.lit("—"))


def queue_counts(queue: DataFrame) -> DataFrame:
    state = F.col("state")
    return queue.agg(F.count_if(state.isin(*READY)).alias("ready"), F.count_if(state.isin(*WAITING)).alias("waiting"), F.count_if(state == "failed").alias("failed"), F.count_if("picked").alias("selected"))


def scan_counts(clients: DataFrame) -> DataFrame:
    ready, labelled = F.col("status") == "ready", F.col("label_status") == "label_materialized"
    return clients.agg(F.count_if(ready).alias("ready"), F.count_if(labelled).alias("labels"), F.count_if(ready & ~labelled).alias("unlabeled"))


def duplicates(files: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Whether a file is the second or a later one of its keys; a key with most files is numbered in many ranges."""
    turned = running_sums(files.select(*keys, path), keys, path, {"turn_": F.lit(1).cast("long")})
    return turned.select(*keys, path, (F.col("turn_") > 1).alias("duplicate"))


def numbered(rows: DataFrame, order: Column, key: str, parts: int | None = None, part_rows: int = 1_000_000) -> DataFrame:
    """Positions from 1 in a total order, without one task that sees all rows.

    Rows are dealt by range; each range is numbered on its own and starts where
    the ranges before it end. Only the ranges' counts come together. There are as
    many ranges as ``part_rows`` go into the rows, unless ``parts`` says how many.
    """
    parts = parts or max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // part_rows))
    # written once, each row with its range and its place there: a lost executor can't deal them anew
    ranged = kept(rows.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn("place_", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("part_", F.shiftright("place_", 33))
    counts = ranged.groupBy("part_").count()
    # a row for each range is broadcast
    before = counts.select(F.col("part_").alias("range_"), (F.sum("count").over(Window.orderBy("part_")) - F.col("count")).alias("before_"))
    position = F.col("place_").bitwiseAND((1 << 33) - 1) + 1 + F.col("before_")
    return ranged.join(F.broadcast(before), F.col("part_") == F.col("range_")).select(*rows.columns, position.alias("position"))


def readable(rows: DataFrame, label: str, unreadable: str = "UNREADABLE") -> DataFrame:
    """Rows whose label is there, not blank, and not the mark of an unreadable one."""
    return rows.where(F.col(label).isNotNull() & (F.trim(label) != "") & (F.col(label) != unreadable))


def expired(rows: DataFrame, time: str, now: str, days: int | None) -> DataFrame:
    """Rows older than so many days; none if the days are null or negative."""
    if days is None or days < 0:
        return rows.where(F.lit(False))
    return rows.where(F.col(time) < F.to_timestamp(F.lit(now)) - F.make_interval(days=F.lit(days)))


def percent(value: str, form: str) -> Column:
    return F.format_string(form, F.col(value) * 100)


def live_table(results: DataFrame) -> DataFrame:
    score = F.when(F.col("accuracy").isNull(), "N/A").otherwise(percent("accuracy", "%.2f %%"))
    return results.select("seq", "model", F.element_at(F.split("image_path", "/"), -1).alias("image"), "category", "status", score.alias("score"), F.round("latency", 3).alias("latency"))


def display_summary(summary: DataFrame) -> DataFrame:
    """Numbers as text, nulls as empty text."""
    shown = lambda c, x: F.when(F.col(c).isNotNull(), x).otherwise("")
    return summary.select("model", shown("quality", percent("quality", "%.2f%%")).alias("quality"), shown("latency_mean", F.format_string("%.3f", "latency_mean")).alias("latency"))


def neighbours(rows: DataFrame, by: str, order: str) -> DataFrame:
    """The positions before and behind a row in its group, kept inside it."""
    turned = running_sums(rows.select(order, by), [by], order, {"turn_": F.lit(1).cast("long")})
    sizes = rows.groupBy(by).agg(F.count("*").alias("n_")).withColumnRenamed(by, "by_")
    inside = lambda p: F.greatest(F.least(p, F.col("n_") - 1), F.lit(0))
    # a row for each group, joined by key: adaptive execution splits a large one
    return turned.join(sizes, same([by], ["by_"])).select(order, by, inside(F.col("turn_")).alias("next"), inside(F.col("turn_") - 2).alias("previous"))


def lines_of(boxes: DataFrame, page: str, near: float = 10.0) -> DataFrame:
    """The text of each page from its boxes (top, left, height, text).

    In order of top and left, a box joins the last line if its middle is within
    ``near`` of the mean of the line's middles, and else begins a line; a line's
    boxes go from left to right. A fold over the page's boxes, in one aggregation.
    """
    box = F.struct(F.col("top").cast("double").alias("top"), F.col("left").cast("double").alias("left"), (F.col("top") + F.col("height") / 2).cast("double").alias("middle"), F.col("text").alias("text"))
    item = "struct<left: double, text: string>"
    start = F.array().cast(f"array<struct<sum: double, n: int, items: array<{item}>>>")

    def step(lines: Column, b: Column) -> Column:
        own = F.struct(b["left"].alias("left"), b["text"].alias("text"))
        last = F.try_element_at(lines, F.lit(-1))
        joins = F.coalesce(F.abs(b["middle"] - last["sum"] / last["n"]) <= near, F.lit(False))
        grown = F.struct((last["sum"] + b["middle"]).alias("sum"), (last["n"] + 1).cast("int").alias("n"), F.concat(last["items"], F.array(own)).alias("items"))
        fresh = F.struct(b["middle"].alias("sum"), F.lit(1).alias("n"), F.array(own).alias("items"))
        return F.when(joins, F.concat(F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(lines, F.array(fresh)))

    def finish(lines: Column) -> Column:
        return F.array_join(F.transform(lines, lambda x: F.array_join(F.transform(F.array_sort(x["items"]), lambda i: i["text"]), " | ")), "\n")

    return boxes.groupBy(page).agg(F.array_sort(F.collect_list(box)).alias("boxes")).select(page, F.aggregate("boxes", start, step, finish).alias("text"))
