"""The corpus pipeline: five stages over ``documents``, each on all that its predecessor kept.

Stages match rows by ``doc_id``, which is unique in ``documents``; rows with a null id are
never removed, and of rows with the same id the near-duplicate stage keeps one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailward.llm.contamination import find_contamination
from tailward.llm.packing import pack_texts
from tailward.llm.secrets import find_secrets, mask_secrets
from tailward.llm.similar import component_ids
from tailward.llm.toxicity import fit_toxicity, score_toxicity
from tailward.session import scratch_path, stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

TOXIC = 0.3  # documents of this score or more go


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below ``TOXIC``; the model learns from ``labels``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit_toxicity(docs.select("doc_id", "text"), labels)
    return score_toxicity(docs, model).where(F.col("toxic_score") < TOXIC).select(*docs.columns)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    found = stage(component_ids(docs.select("doc_id", "text")), "components")
    lesser = found.where("doc_id <> component_id").select("doc_id").distinct()
    repeated = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    once = docs.join(lesser.union(repeated).distinct(), "doc_id", "left_anti")
    again = docs.join(repeated.join(lesser, "doc_id", "left_anti"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(again).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of ``benchmark``."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_contamination(docs.select("doc_id", "text"), benchmark).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def mask_credentials(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    masked = find_secrets(docs).withColumn("text", mask_secrets(F.col("text"), F.col("secret_spans")))
    return masked.withColumn("n_chars", F.when(F.size("secret_spans") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    from public_tokenizers import path

    return pack_texts(docs.select("doc_id", "text"), path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_similar),
    ("decontamination", drop_contaminated),
    ("secrets", mask_credentials),
    ("packing", pack),
]

# The stages fit a model, follow links and pack by column generation, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        path = scratch_path(spark, f"pipeline-{name}-{uuid.uuid4().hex[:8]}")
        apply(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
