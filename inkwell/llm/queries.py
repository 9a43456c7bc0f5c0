"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_kmeans, crc_resampling, crf_language, html_text, kd_shards, kneser_ney, knn_quality, latent_leaks, lattice_dedup, quality_rules, sentencepiece_bpe, simhash, suffix_dedup


def tokenizer(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(modulus: int) -> Column:
    """The fold of a document: CRC-32 of its id's decimal digits, modulo."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))


def op1_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = crf_language.train(documents, remainder(4) != 2)
    return crf_language.predict(documents, model).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score", "n_words")


def op2_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = knn_quality.train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"), remainder(5) != 0)
    scored = knn_quality.score(documents, model)
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kd_shards.shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = kneser_ney.train(documents, remainder(10) != 0)
    return kneser_ney.score(documents, model).withColumn("held_out", remainder(10) == 0)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.remove(spark.read.parquet(f"{sf_dir}/documents.parquet"), depth=200))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def op8_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.93)


def op9_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent_leaks.find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return sentencepiece_bpe.digests(sentencepiece_bpe.encode_decode(documents, tokenizer()))


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.digests(ball_kmeans.fit(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=16, rounds=3, size=64, scale=64, seed=1))


def op12_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "votes", "posterior"]
    return quality_rules.judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(names)


def op13_crc_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crc_resampling.resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=1, buckets=10_000, percent=10, least_words=20, seed=2024)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_crf_language": op1_crf_language,
        "op2_knn_quality": op2_knn_quality,
        "op3_kd_shards": op3_kd_shards,
        "op4_kneser_ney": op4_kneser_ney,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_html_text": op6_html_text,
        "op7_simhash": op7_simhash,
        "op8_lattice_dedup": op8_lattice_dedup,
        "op9_latent_leaks": op9_latent_leaks,
        "op10_sentencepiece": op10_sentencepiece,
        "op11_ball_kmeans": op11_ball_kmeans,
        "op12_weak_rules": op12_weak_rules,
        "op13_crc_resampling": op13_crc_resampling,
    }


def centroids_sql(k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1) -> str:
    """The rounds of operator 11 one after another: every vector is compared with every centroid."""
    steps = [
        f"v AS (SELECT vec_id, [CAST(floor({scale} * x) AS BIGINT) FOR x IN CAST(embedding AS DOUBLE[])] AS v FROM embeddings"
        f" WHERE len(embedding) = {size} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS INT) AS cluster, v AS c FROM v WHERE vec_id IS NOT NULL"
        f" QUALIFY row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) <= {k})",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"a{i} AS (SELECT vec_id, v, first(cluster ORDER BY d, cluster) AS cluster, min(d) AS distance FROM (SELECT n, vec_id, v, cluster,"
            f" CAST(list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v, c)]) AS BIGINT) AS d FROM (SELECT row_number() OVER () AS n, * FROM v), c{i}) GROUP BY n, vec_id, v)"
        )
        if i < rounds:
            steps.append(
                f"c{i + 1} AS (SELECT c{i}.cluster, coalesce(m, c) AS c FROM c{i} LEFT JOIN (SELECT cluster, list(f ORDER BY place) AS m FROM (SELECT cluster, place,"
                f" CAST((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS f FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{i}) GROUP BY cluster, place)"
                f" GROUP BY cluster) AS means ON c{i}.cluster = means.cluster)"
            )
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,"
        f" CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (cluster)"
    )


def oracle_sql() -> dict[str, str]:
    """The others can't be written in SQL; their tests hold them against brute force."""
    return {"op11_ball_kmeans": centroids_sql()}
