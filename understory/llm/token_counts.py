"""Token counts through a digest cache: only contents never counted before are encoded."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from understory.llm.text import pick, ready
from understory.llm.tokens import encoded_runs

CACHE_SCHEMA = "content binary, tokenizer string, n_tokens bigint"


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file and of the library's version; counts of another version are never reused."""
    import tokenizers
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version, one row per content; empty if the table isn't there yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], CACHE_SCHEMA).select("content", "n_tokens")
    found = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer") == version)
    # two writers may have appended the same content: equal counts
    return found.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, cache: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens.

    tokenizer: path of a tokenizers .json file, present on every worker. cache: path of a Parquet table in shared
    storage, made if absent; each call appends the counts of contents it did not find there. Content is the text with
    NULL read as empty; the byte-level vocabularies tell every other difference apart, so nothing else is normalised
    away. Ids may be NULL or repeated, rows are kept as they are. Other columns of docs are left out. An empty table
    gives no rows. No begin, end or other added tokens are counted; special strings in a text count as the library
    counts them by default.
    """
    spark = docs.sparkSession
    ready(spark)
    version = tokenizer_version(tokenizer)
    keyed = (pick(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
             .withColumn("content", F.unhex(F.sha2("text", 256))))
    missing = (keyed.select("content", "text").join(read_cache(spark, cache, version), "content", "left_anti")
               .groupBy("content").agg(F.first("text").alias("text")))

    def count(batches):
        for batch in batches:
            contents = batch.column(0)
            for start, end, _, counts in encoded_runs(batch.column(1), tokenizer, 4 << 20):
                yield pa.RecordBatch.from_arrays([contents.slice(start, end - start), pa.array(counts, pa.int64())],
                                                 names=["content", "n_tokens"])

    (missing.mapInArrow(count, "content binary, n_tokens bigint")
     .select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache))
    known = read_cache(spark, cache, version)
    return (keyed.select("id", F.octet_length("text").cast("bigint").alias("n_bytes"), "content")
            .join(known, "content").select(F.col("id").alias(id_col), "n_bytes", "n_tokens"))
