"""The corpus pipeline: quality, line dedup, near-duplicate join, decontamination, mixing.

Defined cases of all stages: an empty table gives an empty one; extra columns are carried along; repeated rows are decided alike.
Null texts pass through quality as empty texts do, are left alone by line dedup, are linked with nothing and hold no benchmark words; mixing takes
only rows with an id and at least one token. Rows with a null id pass line dedup and the join unchanged. The last stage returns a
reading plan (ids, epochs, places) without texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, jaccard, line_dedup, mixing, quality, queries
from plumbline.llm.common import checkpoint_folder, crc_mod, delete, read, shuffles_dropped, tables_dropped


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the pairwise ranking does not reject; without labels of both kinds all stay."""
    labels = read(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 5) != 0)
    return quality.keep_quality(docs, quality.fit_ranking(*quality.labelled_sample(docs, labels)))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated lines out of the texts and bring n_chars up to date; a document whose lines all go keeps the empty text."""
    out = line_dedup.dedup_lines(docs, line_dedup.JOB_STEPS, line_dedup.JOB_CHARS, collapse=True)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each near-duplicate group the document with the smallest id (each row that carries it); empty texts and null ids stay."""
    gone = jaccard.joined(docs).where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__doc")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__doc"), "left_anti")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents without any benchmark window; an empty benchmark keeps all."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Choose each source's seeded epochs towards the target weights; rows without id or tokens are in none."""
    return mixing.mix_sources(docs, queries.domain(), queries.weights_table(spark, queries.WEIGHTS), share=0.9)


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("near_duplicates", near_duplicate_stage), ("decontamination", decontamination_stage), ("mixing", mixing_stage)]

#: The stages are not expressible in SQL; tests/llm hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written as Parquet in the shared folder and read again. A stage's input and own tables are deleted when its result is written."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = read(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        with tables_dropped(spark), shuffles_dropped(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
