"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the plans rely on; everything else is left to the cluster.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Rows that lie by a part of a join's keys are not shuffled again for it.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Joins whose shuffled parts are all small on one side are hashed, not sorted.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "16m",
    # Sorted rows are grouped as they come, in one step.
    "spark.sql.execution.replaceHashWithSortAgg": "true",
    # Methods above this size are never compiled by the JVM; such a stage runs operator by operator instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors reach: the one named by the session.

    Only a session that runs in one process may go without; it gets a folder of its own.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


#: Shuffle files of a write are of no use once it is done.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    The written table survives lost executors, unlike cached blocks. The write's own shuffle
    files are dropped at its end, so a chain of saved steps holds the disk of one step.
    """
    spark = df.sparkSession
    safe = re.sub(r"[^a-z0-9_]+", "_", name.lower())
    path = f"{shared_dir(spark)}/lexloom/{safe}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*kept: DataFrame) -> None:
    """Delete tables that ``save`` wrote and that no later step reads."""
    for df in kept:
        spark, ours = df.sparkSession, f"{shared_dir(df.sparkSession)}/lexloom/"
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            if _inside(spark, ours, path):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _inside(spark: SparkSession, root: str, path) -> bool:
    """Whether the path is a table of our own folder."""
    parent = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getParent().toUri().getPath() == parent.toUri().getPath()
