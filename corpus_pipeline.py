"""The corpus pipeline: language, near-duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes the table its predecessor wrote and works on all of it; its
decisions take effect. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import crf_language, latent_leaks, sentencepiece_bpe, shared, shingle_sets, suffix_dedup
from inkwell.llm.queries import remainder, tokenizer


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in which no language has half of the words, go."""
    model = crf_language.train(docs, remainder(4) != 2)
    return crf_language.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingle similarity >= 0.8 the row with the smallest id stays; rows without an id stay.

    Candidates by SimHash and, for what lies beyond its bound, by minhash bands; exact similarity decides.
    """
    return shingle_sets.representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that occur twice leave the texts; the documents stay."""
    left = suffix_dedup.remove(docs, depth=200)
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return left.select(*[own.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return latent_leaks.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text's ids, their number, and the text they decode to."""
    encoded = sentencepiece_bpe.encode_rows(docs, tokenizer())
    return encoded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("tokens", tokens),
]

#: SQL can express none of the first three stages; the pipeline's test holds it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each to what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared.fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
