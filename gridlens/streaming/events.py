"""Attempt events as a stream: cell state and throughput windows.

Every micro-batch folds into a versioned table under the shared checkpoint folder.  A version is named by its batch, so
a batch that is replayed after a failure overwrites its own version and nothing is counted twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.operators.distributed import first_per_key
from gridlens.session import child_numbers, delete_folder, ensure_checkpoint_dir, file_system


def read_events(spark: SparkSession, folder: str, name: str = "events", files_per_batch: int = 64) -> DataFrame:
    """One table as a stream, stored as a folder of files or as a single file; the schema is the table's own."""
    path = f"{folder}/{name}.parquet"
    system, place = file_system(spark, path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    if system.getFileStatus(place).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


class VersionedTable:
    """Latest state of a folded stream: one parquet folder per committed batch, the last two of them kept.

    Committed batches are read from the store, so a job that is started again with the same ``folder`` goes on where
    the last one ended.
    """

    def __init__(self, spark: SparkSession, name: str, folder: str | None = None):
        self.spark = spark
        self.root = folder or f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, batch: int) -> str:
        return f"{self.root}/state/batch={batch}"

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/checkpoint"

    def batches(self) -> list[int]:
        return child_numbers(self.spark, f"{self.root}/state", "batch=")

    def before(self, batch: int) -> DataFrame | None:
        earlier = [b for b in self.batches() if b < batch]
        return self.spark.read.parquet(self.path(max(earlier))) if earlier else None

    def commit(self, batch: int, frame: DataFrame) -> None:
        frame.write.mode("overwrite").parquet(self.path(batch))
        for old in [b for b in self.batches() if b < batch][:-1]:
            delete_folder(self.spark, self.path(old))

    def latest(self) -> DataFrame | None:
        committed = self.batches()
        return self.spark.read.parquet(self.path(committed[-1])) if committed else None


def fold_stream(stream: DataFrame, table: VersionedTable, fold: Callable[[DataFrame | None, DataFrame], DataFrame], *,
                mode: str = "append") -> DataFrame:
    """Run a bounded stream to its end, folding every micro-batch into the table; no batch at all folds an empty one."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        table.commit(batch_id, fold(table.before(batch_id), batch))

    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", table.checkpoint)
             .trigger(availableNow=True).foreachBatch(apply).start())
    query.awaitTermination()
    found = table.latest()
    return fold(None, table.spark.createDataFrame([], stream.schema)) if found is None else found


def fold_latest(before: DataFrame | None, batch: DataFrame, key: str = "cell_id", order: str = "event_id") -> DataFrame:
    """Last event of every key over all batches so far."""
    rows = batch if before is None else before.unionByName(batch)
    return first_per_key(rows, [key], order, last=True)


def fold_rows(before: DataFrame | None, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Updated rows replace earlier rows of the same keys."""
    return batch if before is None else before.join(batch.select(*keys), keys, "left_anti").unionByName(batch)


def throughput(stream: DataFrame, time: str, kind: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and cost per window and kind, with late events admitted up to the watermark."""
    return (stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind)
            .agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))
            .select(F.col("w.start").alias("start"), kind, "n", "cents"))
