"""The stages of the corpus pipeline; all but the last return the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from understory.llm.decontaminate import benchmark_hits, contaminated
from understory.llm.jaccard import jaccard_components
from understory.llm.packing import pack
from understory.llm.quality import score_quality
from understory.llm.queries import END_ID, PACK_LIMITS, learnt_quality
from understory.llm.secrets import redact


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 1/2 or more."""
    return score_quality(docs, learnt_quality(spark, sf_dir, docs), out="_score").filter("_score >= 0.5").drop("_score")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their shingles, the one with the smallest id."""
    membership, _ = jaccard_components(docs, percent=75)
    others = membership.filter("id <> component_id").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)


def not_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a telling share of benchmark passages."""
    hits = benchmark_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), span=13)
    return hits.filter(~contaminated()).select(docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of the documents that are left, one row per piece, with its ids."""
    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"), PACK_LIMITS, END_ID)
    return pieces.withColumnRenamed("id", "doc_id")
