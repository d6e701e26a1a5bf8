"""Session settings shared by the command line, the tests and the benchmark."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, *, app: str = "gridlens", shuffle_partitions: int | None = None,
                  driver_memory: str | None = None) -> SparkSession:
    """Create a session; a cluster's own settings win wherever an argument is left out."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    Only a local master may fall back to a folder of its own; a cluster has to name a shared one, since a
    checkpoint on one machine would be lost with that machine.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "")
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="gridlens-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def file_system(spark: SparkSession, path: str):
    """Hadoop file system and path object of a path, wherever it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def child_numbers(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """Numbers of the complete table versions ``prefix<number>`` in a folder, in ascending order."""
    system, place = file_system(spark, folder)
    if not system.exists(place):
        return []
    names = [s.getPath().getName() for s in system.listStatus(place)]
    marked = [n for n in names if n.startswith(prefix) and n[len(prefix):].isdigit()
              and system.exists(file_system(spark, f"{folder}/{n}/_SUCCESS")[1])]
    return sorted(int(n[len(prefix):]) for n in marked)


def delete_folder(spark: SparkSession, folder: str) -> None:
    system, place = file_system(spark, folder)
    system.delete(place, True)
