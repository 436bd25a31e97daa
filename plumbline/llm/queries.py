"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, language_id, likelihood_rules, line_dedup, mixing, ppm_score, quality, runs, secrets, surrogates, topk, vector_codes
from .common import crc_mod, read


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    docs = docs.select("doc_id", "text", "lang", held.alias("held_out"))
    model = language_id.fit_trees(language_id.sample(docs.where(~F.col("held_out"))))
    return language_id.identify(docs.drop("lang"), model)


def op2_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return ppm_score.score_texts(docs, F.coalesce(crc_mod(F.col("doc_id"), 7) == 2, F.lit(False)))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs, line_dedup.JOB_STEPS, line_dedup.JOB_CHARS, dropped="dropped", collapse=True)
    lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    n = F.size("dropped")
    return out.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(lines).cast("long").alias("n_kept"), n.cast("long").alias("n_dropped"), F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped_lines"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(read(spark, sf_dir, "documents"))


def op7_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    model = quality.fit_ranking(*quality.labelled_sample(docs, labels.where(crc_mod(F.col("doc_id"), 5) != 0)))
    return quality.score_quality(docs.select("doc_id", "text", held.alias("held_out")), model)


#: The key of the registered query; real runs bring their own secret.
SECRET = "plumbline-demo-key"


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymised(read(spark, sf_dir, "documents"), SECRET)


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return topk.exact_topk(vectors, vectors.where(F.col("vec_id") % 20 == 0))


#: Target weights of the mixing query; nodes that are not named count as 1.
WEIGHTS = {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d0/en": 2.0, "d1/de": 3.0, "d0/en/src0": 0.5}


def domain() -> F.Column:
    """The sources in four domains by their number."""
    return F.concat(F.lit("d"), F.coalesce(F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as int)") % 4, F.lit(0)).cast("string"))


def weights_table(spark: SparkSession, weights: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(list(weights.items()), "path string, weight double")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return mixing.mix_sources(docs, domain(), weights_table(spark, WEIGHTS), share=0.5)


def op11_likelihood_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return likelihood_rules.judge(docs, likelihood_rules.fit_rule(docs, read(spark, sf_dir, "labels")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_ppm_score, op3_line_dedup, op4_decontamination, op5_secret_scan, op6_jaccard_join, op7_quality_rank, op8_pii_surrogates, op9_exact_topk, op10_mixing, op11_likelihood_rules, op12_vector_codes, op13_periodic_runs)}
ORACLES: dict[str, str] = {}
