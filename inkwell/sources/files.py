"""Sources: catalogs, JSON lines, CSV labels, nested annotations, text files, folders, archives, runs."""

from __future__ import annotations

import os
import re
import zipfile
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import strings
from inkwell.operators import joins, selection

CATALOG = "image_path string, ground_truth string, category string, description string, source string, source_id string, license string, annotation_path string"
REQUIRED = ("image_path", "ground_truth", "category")
METADATA = "file_name string, source_id string, clearocr_text_path string, markdown_path string, invoice_json_path string, judges_path string"
FORM = "form array<struct<box: array<int>, text: string, label: string, words: array<struct<box: array<int>, text: string>>, linking: array<array<int>>, id: int>>"


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a catalog, a JSON array of objects, with unified slashes; the schema is fixed, never inferred."""
    return spark.read.schema(CATALOG).option("multiLine", True).json(path).withColumn("image_path", strings.slashes(F.col("image_path")))


def missing_keys(rows: DataFrame, required: tuple[str, ...] = REQUIRED) -> Column:
    """The required keys an entry lacks."""
    return F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))


def violations(rows: DataFrame) -> DataFrame:
    """The entries that lack a required key."""
    return rows.withColumn("missing", missing_keys(rows)).where(F.size("missing") > 0)


def json_lines(spark: SparkSession, path: str, schema: str = METADATA) -> DataFrame:
    """One object a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def csv_labels(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A label file with a header; missing values are empty texts."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path).fillna("")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """The boxes of annotated forms, one a row, with the file's stem."""
    rows = spark.read.schema(FORM).option("multiLine", True).json(path).withColumn("stem", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    return rows.select("stem", F.explode("form").alias("f")).select("stem", "f.*")


def boxes(forms: DataFrame) -> DataFrame:
    """Boxes as the line clustering wants them."""
    box = F.col("box")
    return forms.select(F.col("stem").alias("page"), box[1].cast("double").alias("top"), box[0].cast("double").alias("left"), (box[3] - box[1]).cast("double").alias("height"), "text")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as trimmed texts, by path."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("text"))


def folder(spark: SparkSession, path: str, suffixes: dict[str, str]) -> DataFrame:
    """One row a client folder: its sources by side, issues and status; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    parts = F.split("path", "/")
    files = files.select("path", F.element_at(parts, -2).alias("client"), F.element_at(parts, -1).alias("name"))
    side = F.coalesce(*[F.when(strings.file_side(F.col("name"), suffix).isNotNull(), F.lit(side)) for side, suffix in suffixes.items()])
    return joins.sides(files.withColumn("side", side).where("side is not null"), "client", "side")


def unsafe_member(path: Column) -> Column:
    """Whether an archive's member would leave the target folder."""
    flat = strings.slashes(path)
    return flat.startswith("/") | flat.rlike("^[A-Za-z]:") | F.array_contains(F.split(flat, "/"), "..")


def unsafe_name(name: str) -> bool:
    """The same of one name."""
    flat = name.replace("\\", "/")
    return flat.startswith("/") or bool(re.match("^[A-Za-z]:", flat)) or ".." in PurePosixPath(flat).parts


def unzip(archive: str, target: str) -> list[str]:
    """Extract an archive on the driver; one unsafe member rejects it before anything is written, an error undoes all."""
    written: list[str] = []
    with zipfile.ZipFile(archive) as z:
        for name in z.namelist():
            if unsafe_name(name):
                raise ValueError(f"unsafe member: {name}")
        try:
            for info in z.infolist():
                if not info.is_dir():
                    written.append(z.extract(info, target))
        except Exception:
            for path in written:
                os.unlink(path)
            raise
    return written


def run_results(spark: SparkSession, root: str, run_id: str, schema: str) -> DataFrame:
    """The results of a stored run."""
    if not re.fullmatch(selection.RUN_ID[1:-1], run_id):
        raise ValueError(f"not a run id: {run_id}")
    return spark.read.schema(schema).json(f"{root.rstrip('/')}/{run_id}/results")


def generated(spark: SparkSession, n: int) -> DataFrame:
    """Receipts for tests and demonstrations: text, category and path, made from the number alone."""
    i = F.col("id")
    line = lambda k: F.format_string("%-12s %8.2f EUR", F.concat(F.lit("item "), (i * k % 97).cast("string")), (i * k % 9973) / F.lit(100.0))
    text = F.concat_ws("\n", F.concat(F.lit("RECEIPT "), i.cast("string")), line(3), line(7), line(11), F.format_string("TOTAL %.2f EUR", (i * 3 % 9973 + i * 7 % 9973 + i * 11 % 9973) / F.lit(100.0)))
    return spark.range(n).select(i.alias("case_id"), F.concat(F.lit("/made/"), i.cast("string"), F.lit(".png")).alias("image_path"), text.alias("ground_truth"), F.element_at(F.array(F.lit("receipt"), F.lit("receipt_blur"), F.lit("receipt_rotated")), (i % 3 + 1).cast("int")).alias("category"))
