"""Sinks: a run's files, traces, reports, catalog entries, labels, retention."""

from __future__ import annotations

import json
import os
import re
import shutil
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import ordered, selection

from .runs import RunSink
from .store import Store

EXTENSIONS = (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tif", ".tiff", ".pdf")
MOST_BYTES, MOST_LABEL = 15 << 20, 100_000


def save_run(results: DataFrame, summary: DataFrame, path: str) -> None:
    """results as JSON, details and summary as CSV; Spark's commit protocol makes each whole or absent."""
    results.write.mode("overwrite").json(f"{path}/results")
    results.write.mode("overwrite").option("header", True).csv(f"{path}/details")
    summary.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/summary")


def save_whole_run(results: DataFrame, summary: DataFrame, path: str, overwrite: bool = False) -> None:
    """One pass over the results publishes them, their details, the summary (a row a model) and the report together, or nothing."""
    results.sparkSession.dataSource.register(RunSink)
    rows = [r.asDict(recursive=True) for r in summary.collect()]
    results.write.format(RunSink.name()).mode("overwrite" if overwrite else "append").option("summary", json.dumps({"columns": summary.columns, "rows": rows}, default=str)).option("path", path).save()


def append_traces(traces: DataFrame, path: str) -> None:
    traces.write.mode("append").json(path)


def save_artefacts(records: DataFrame, path: str) -> None:
    """Records by model and client."""
    records.write.mode("overwrite").partitionBy("model", "folder_client_id").json(path)


def report(summary: DataFrame, failures: DataFrame) -> DataFrame:
    """The lines (part, line) of a Markdown report: the summary's table, a row a model, then every failure."""
    columns = summary.columns
    line = lambda cells: "| " + " | ".join("" if c is None else f"{c:.4f}" if isinstance(c, float) else str(c) for c in cells) + " |"
    head = ["# Report", "", line(columns), line(["---"] * len(columns)), *[line(r) for r in summary.collect()], "", "## Failures", ""]
    top = summary.sparkSession.createDataFrame([(i, x) for i, x in enumerate(head)], "part int, line string")
    return top.unionAll(failures.select(F.lit(len(head)).alias("part"), F.concat_ws("", F.lit("- "), "model", F.lit(" "), "image_path", F.lit(": "), "status").alias("line")))


def save_report(summary: DataFrame, failures: DataFrame, path: str) -> None:
    """The report as text files that follow each other by name, in the order of its lines."""
    report(summary, failures).orderBy("part", "line").select("line").write.mode("overwrite").text(path)


def category_name(value: Column) -> Column:
    """Trimmed, lower case, underscores for spaces."""
    return F.regexp_replace(F.lower(F.trim(value)), r"\s+", "_")


def entry_error(name: Column, size: Column, label: Column) -> Column:
    """Why a catalog entry is refused, null if it is not."""
    extension = F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))
    text = F.trim(F.coalesce(label, F.lit("")))
    return F.when(~extension.isin(*EXTENSIONS), "extension").when(size > MOST_BYTES, "size").when(~F.length(text).between(1, MOST_LABEL), "label")


VERSIONS = "_versions"


def version_name(number: int) -> str:
    return f"{VERSIONS}/{number:012d}.json"


def latest_version(store: Store) -> int:
    """The newest version's number, 0 without one."""
    return max((int(n[:12]) for n in store.names(VERSIONS) if re.fullmatch(r"\d{12}\.json", n)), default=0)


def catalog_folders(store: Store, version: int | None = None) -> list[str]:
    """The folders of appended entries that make a version, the newest unless one is named."""
    number = latest_version(store) if version is None else version
    return json.loads(store.read(version_name(number)))["folders"] if number else []


def publish(store: Store, folder: str, tries: int = 100) -> int:
    """Add a folder to the catalog as its next version and return that; another append's version in between is built upon.

    A version's file is created only if it is absent, so two appends never take one number.
    """
    for _ in range(tries):
        number = latest_version(store)
        body = json.dumps({"folders": [*catalog_folders(store, number), folder]})
        if store.create(version_name(number + 1), body):
            return number + 1
    raise OSError(f"the catalog changed {tries} times while {folder} was to be added")


def append_catalog(entries: DataFrame, path: str) -> DataFrame:
    """Append the valid entries, all or none, and return the refused ones with the reason.

    Entries are staged in a folder that readers pass over and become part of the catalog with the
    version that names their folder. If anything fails before, the folder goes.
    """
    checked = entries.withColumn("error", entry_error(F.col("image_path"), F.col("bytes"), F.col("ground_truth"))).withColumn("category", category_name(F.col("category")))
    store, own = Store(entries.sparkSession, path), uuid.uuid4().hex
    staged, folder = f"_staged-{own}", f"append={own}"
    try:
        checked.where("error is null").drop("error", "bytes").write.json(f"{path}/{staged}")
        store.move(staged, folder)
        publish(store, folder)
    except BaseException:
        store.delete(staged)
        if folder not in catalog_folders(store):
            store.delete(folder)
        raise
    return checked.where("error is not null")


def read_catalog(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """The entries of a version of the catalog: one append's are there as a whole or not at all."""
    folders = [f"{path}/{f}" for f in catalog_folders(Store(spark, path), version)]
    return spark.read.schema(schema).json(folders) if folders else spark.createDataFrame([], schema)


def label_status(found: Column, content: Column) -> Column:
    """Whether a client's label was found and holds a JSON object or array."""
    kind = F.substring(F.ltrim(content), 1, 1)
    good = F.try_parse_json(content).isNotNull() & kind.isin("{", "[")
    return F.when(~F.coalesce(found, F.lit(False)), "label_not_found").when(F.coalesce(good, F.lit(False)), "label_materialized").otherwise("label_parse_failed")


def html_table(rows: DataFrame, key: str, columns: list[str], page_rows: int = 1000) -> DataFrame:
    """Each key's rows as HTML tables of at most ``page_rows`` rows, numbered by page from 1; a key with most rows is numbered in many ranges."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), safe(c), F.lit("</td>")) for c in columns], F.lit("</tr>"))
    turned = ordered.running_sums(rows.select(key, line.alias("line")), [key], "line", {"turn_": F.lit(1).cast("long")})
    paged = turned.withColumn("page", F.ceil(F.col("turn_") / page_rows).cast("int")).drop("turn_")
    return paged.groupBy(key, "page").agg(F.concat(F.lit("<table>"), F.array_join(F.array_sort(F.collect_list("line")), ""), F.lit("</table>")).alias("html"))


def purge_runs(root: str, days: int | None, now: float | None = None) -> list[str]:
    """Delete the run folders older than so many days; other folders are never touched."""
    if days is None or days < 0:
        return []
    limit, gone = (now or time.time()) - days * 86_400, []
    for name in sorted(os.listdir(root)):
        path = os.path.join(root, name)
        if re.fullmatch(selection.RUN_ID[1:-1], name) and os.path.isdir(path) and os.path.getmtime(path) < limit:
            shutil.rmtree(path)
            gone.append(name)
    return gone
