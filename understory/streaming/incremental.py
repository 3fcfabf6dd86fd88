"""Compute-if-absent and pending-work operators.

The workflow has no event streams: its only incremental behavior is to skip
results that already exist.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from understory.operators.joins import not_member_of
from understory.session import rename_path, scratch_dir, scratch_path


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read `path` if a finished result is there, else build, write and read it.

    Completion is the commit marker of the write, so a half-written folder left
    by a failed job is rebuilt rather than read.
    """
    if not path_exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def content_path(rows: DataFrame, name: str, what: object) -> str:
    """A path in the shared folder named by the rows (in any order) and by what is made of them.

    Other rows or parameters give another path, so nothing made of old rows is taken for new ones. `rows` should be stored.
    """
    spark = rows.sparkSession
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("h")).first()
    digest = spark.range(1).select(F.md5(F.lit(f"{rows.schema.simpleString()}|{found.n}|{found.h}|{what}"))).first()[0]
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{digest}"


def build_once(spark: SparkSession, path: str, build: Callable[[str], object]) -> str:
    """Build a folder of any content under a fresh name and move it to `path`, whole or not at all, unless it is there."""
    if not path_exists(spark, path):
        fresh = scratch_path(spark, "building")
        build(fresh)
        rename_path(spark, fresh, path)
    return path


def pending(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work items whose key has no finished output; a failed item simply stays pending."""
    return not_member_of(work, done, [(k, k) for k in keys])
