"""Session, tables and checkpoints: the only places that know about the surroundings."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "spagyric") -> SparkSession:
    """A session for tests and benches on one machine; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPAGYRIC_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def is_local(spark: SparkSession) -> bool:
    """Whether all of the session is one process, so that its local folders are shared by all tasks."""
    return spark.sparkContext.master.partition("[")[0] == "local"


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share. Only on one machine is a temporary one made where
    that setting is absent; a cluster without it is an error, as its executors would write to folders of their own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not is_local(spark):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share ({purpose})")
    return tempfile.mkdtemp(prefix="spagyric-")


def shared_checkpoints(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable. Files of checkpoints that nothing refers to any more are removed by Spark where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, as ``local_session`` does."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(spark, "checkpoints"))


#: Rows up to which a side of a join is broadcast.
BROADCAST_ROWS = 200_000


def joinable(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The side of a join, to be broadcast if it has no more rows than ``most``; else Spark joins as it will. df must be kept
    (a checkpoint), as it is counted."""
    return F.broadcast(df) if df.count() <= most else df


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Give a small input as many partitions as there are cores before Python work; leave a large one alone.

    The check reads only the plan's file layout, so it costs no job.
    """
    spark = df.sparkSession
    least = least or spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    return df.repartition(least) if len(files) < least else df


def settled(df: DataFrame) -> DataFrame:
    """The same rows, behind a step through which the optimizer moves no filter: a filter on a long chain of
    derived columns would be moved to its start and with it repeat the whole chain, several times over."""
    return df.withColumn("_row", F.monotonically_increasing_id()).where("_row >= 0").drop("_row")
