"""Session defaults, the shared scratch folder and plan-size checks."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WRITERS = 8  # tasks that share one partition folder of a stored table

_LOCAL_SCRATCH: dict[str, str] = {}


def build_session(app_name: str = "understory", cpus: int | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session for local runs; on a cluster the submitter supplies master and sizes."""
    builder = (SparkSession.builder.appName(app_name)
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC"))
    if cpus is not None:
        builder = (builder.master(f"local[{cpus}]")
                   .config("spark.driver.memory", "12g")
                   .config("spark.ui.enabled", "false")
                   .config("spark.ui.showConsoleProgress", "false")
                   .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus)))
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Only a local-mode session that names none gets a folder of its own: on a
    cluster a machine-local path would be invisible to the other executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="understory-")
    return _LOCAL_SCRATCH[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused path below the scratch folder."""
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write a frame to a fresh table in the shared scratch folder and read it back.

    Cuts the lineage through shared storage: the plan becomes a scan, and a lost
    executor costs a re-read. Rows of one partition folder are first brought
    together in a few slices by source task, so there are few files and a hot
    folder still has several writers. Partition values keep their type.
    """
    path = scratch_path(df.sparkSession, name)
    out = df
    if partition_by:
        out = (df.withColumn("_slice", F.spark_partition_id() % WRITERS).repartition(*partition_by, "_slice").drop("_slice"))
    out.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_limit(spark: SparkSession) -> int:
    """spark.sql.autoBroadcastJoinThreshold in bytes (-1 when broadcasting is switched off)."""
    raw = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760").strip().lower()
    for suffix, factor in (("gb", 2**30), ("mb", 2**20), ("kb", 2**10),
                           ("g", 2**30), ("m", 2**20), ("k", 2**10), ("b", 1)):
        if raw.endswith(suffix):
            return int(float(raw[: -len(suffix)]) * factor)
    return int(raw)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's own size estimate for a frame."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Hint a broadcast only when the estimated size is under the session's limit.

    Above the limit the frame is returned unhinted, so the join is planned as a
    shuffled one and AQE may still split its skewed partitions.
    """
    limit = broadcast_limit(df.sparkSession)
    return F.broadcast(df) if 0 <= plan_bytes(df) <= limit else df


def ship_package(spark: SparkSession) -> None:
    """Let Python workers that share the driver's file system import this package; elsewhere it is installed or sent along."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, known) if x)


def rename_path(spark: SparkSession, source: str, target: str) -> None:
    """Move a finished folder to its name in one step; if another run was first, its equal result stays."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path(target)) and not files.rename(path(source), path(target)):
        raise OSError(f"cannot move {source} to {target}")
