"""Session settings and the shared folder used for checkpoints and scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split skewed join partitions even when a later operator then needs its own shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # First k rows per key are cut per task before the shuffle for larger k, too (Spark: up to 1,000).
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings every operator here assumes; safe to call repeatedly."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    current = sc.getCheckpointDir()
    if current is not None:
        return current
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused folder path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Whether a query's shuffle files are deleted when it ends; without it they stay until the driver's JVM collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, path: str) -> None:
    """Write ``df`` as Parquet and delete the shuffle files of this one job, which the table replaces."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    For a derived input that several jobs read: it is computed once, later reads are
    pruned to the columns they need, and a lost executor re-reads files.
    """
    path = scratch_path(df.sparkSession, name)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_tasks(spark: SparkSession) -> int:
    """How many tasks a shuffle is dealt to before small ones are merged."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table of the shared folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Rounds:
    """The written state of a loop: each ``put`` replaces the table of the round before."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.path = spark, name, None

    def put(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, self.name)
        write_table(df, path)
        self.drop()
        self.path = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        if self.path is not None:
            discard(self.spark, self.path)
            self.path = None


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise the state of a loop.

    A written table, not ``checkpoint()``: a checkpointed plan keeps the constraints that
    Catalyst derived for it, and in a loop these multiply from round to round until
    planning takes longer than the job.
    """
    return settle(df, "round")
