"""Small Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.session import ensure_checkpoint_dir


#: Bytes that a Python function is handed at once, unless the session has its own bound: 10,000 long texts are large both
#: in the executor's buffers and in its Python workers.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(*BATCH)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(frame: DataFrame) -> DataFrame:
    """Write a frame to the shared checkpoint folder: later jobs read it instead of its lineage."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def few_tasks(frame: DataFrame, rows: int, per_task: int = 50_000) -> DataFrame:
    """The frame in a task per so many rows, if that makes fewer; ``rows`` is how many it has at most.

    A table of a few rows in hundreds of partitions is hundreds of files here and in each later shuffle.
    """
    return frame.coalesce(-(-rows // per_task) or 1)


#: Bits set per key, taken from three ranges of its hash.
_SHIFTS = (0, 19, 38)


def bitmap(keys: DataFrame, column: str, log_bits: int) -> bytes:
    """A Bloom filter over hashed keys, of fixed size whatever their number; it never misses a member.

    At most 2^(log_bits - 6) words reach the driver.
    """
    slots = F.array(*[F.shiftrightunsigned(column, n).bitwiseAND(F.lit((1 << log_bits) - 1)) for n in _SHIFTS])
    words = (
        keys.select(F.explode(slots).alias("slot"))
        .select(F.shiftright("slot", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bits"))
        .groupBy("word").agg(F.bit_or("bits").alias("bits"))
    )
    bits = np.zeros(1 << (log_bits - 6), dtype=np.int64)
    part = words.toArrow()
    bits[part["word"].to_numpy()] = part["bits"].to_numpy()
    return bits.tobytes()


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be members; ``bits`` is what :func:`bitmap` returned, as 64-bit words."""
    words, mask = bits.view(np.uint64), np.uint64(len(bits) * 64 - 1)
    found = np.ones(len(hashes), bool)
    for n in _SHIFTS:
        slot = hashes >> np.uint64(n) & mask
        found &= (words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) > 0
    return found


def held_out(doc_id: str | Column, folds: int = 5) -> Column:
    """Rows whose crc32 of the decimal id leaves no remainder."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % folds == 0


def written(frame: DataFrame) -> DataFrame:
    """Like :func:`stored`, but compressed by column; for wide tables."""
    import uuid

    path = f"{ensure_checkpoint_dir(frame.sparkSession)}/table-{uuid.uuid4()}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free_name(frame: DataFrame, wanted: str) -> str:
    """``wanted`` with as many underscores in front as it takes to be no column of the frame (case does not matter)."""
    taken = {c.lower() for c in frame.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


class Memo(dict):
    """A dict that computes what it lacks and starts over once it is full."""

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value
