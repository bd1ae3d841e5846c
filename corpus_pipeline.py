"""A training-data pipeline of five stages over documents.

Each stage takes what its predecessor kept, works on all of it, and returns the rows that stay with the
columns of documents; the last returns the mixture: one row per use of a document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowproof.llm import decontam, exact_dedup, mixing, quality_zstd, simhash_bk
from rowproof.llm.common import scratch, shared_dir, written

#: Documents whose quality score is below this are rejected.
LEAST_QUALITY = 0.3
#: Near duplicates: shingles of five words and a similarity of 0.8 or more.  Candidates come from three
#: independent fingerprints within 6 of 64 bits and, complete for 0.8, from shared shingles of prefixes.
NEAR = {"words": 5, "radius": 6, "count": 3, "least": 0.8}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the compression classifier scores as bad."""
    model = quality_zstd.train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_zstd.score_quality(docs, model, keep=tuple(docs.columns), to="_quality_score")
    return scored.where(F.col("_quality_score") >= LEAST_QUALITY).select(docs.columns)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (up to white space) the document with the smallest id stays."""
    return exact_dedup.keep_first(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id.

    A row is its id and the hash of its text, so of an id on several texts only the near copies go; of equal
    ids the smaller hash stays, and a null id only where the whole group has null ids.  Whole repeated rows
    (the stage before leaves none) all stay or all go.
    """
    groups = simhash_bk.near_duplicates(docs, **NEAR)
    row = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")
    n = docs.count()
    groups = written(groups.select("root", row.alias("row")), "pipeline-groups", n)
    first = groups.groupBy("root").agg(F.min("row").alias("first"))
    lost = groups.join(first, "root").where("row.none <> first.none or not row.id <=> first.id or row.text_hash <> first.text_hash")
    lost = written(lost.select(F.col("row.id").alias("_i"), F.col("row.text_hash").alias("_h")).distinct(), "pipeline-near", n)
    # the list grows with the data: it is shuffled, at every size alike
    rows = docs.withColumn("_hash", F.xxhash64("text"))
    return rows.join(lost.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h")), "left_anti").select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that leak a benchmark item."""
    found = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=tuple(docs.columns), to="_leaks_found")
    return found.where(F.size("_leaks_found") == 0).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources: which document is used in which epoch, block and position."""
    return mixing.mix_sources(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("simhash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("source mixing", mixing_stage),
]

#: SQL cannot express the compression classifier, the fingerprints or the alignment.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each result is written as Parquet and read again.

    What a stage writes on its way is removed once its result is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/pipeline-{k}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
