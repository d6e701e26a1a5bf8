"""Whole-table order operators that never gather the table into one task.

Spark evaluates a window without PARTITION BY in a single task.  These helpers keep the range partitions of a
global sort instead: positions and running totals are taken inside each partition and shifted by the totals of
the partitions before it, which is one row per partition.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.session import ensure_checkpoint_dir

# monotonically_increasing_id keeps the partition in the upper bits and the row in the lower 33.
_ROW_BITS = 33
_ROW_MASK = (1 << _ROW_BITS) - 1


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame to the shared checkpoint folder and read it back with short lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _sorted_slices(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    placed = df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = placed.withColumn("_slice", F.shiftright("_place", _ROW_BITS).cast("int"))
    return materialize(placed)


def global_row_number(df: DataFrame, order: Sequence[Column | str], name: str = "row_number") -> DataFrame:
    """Add the one-based position of every row in a total order.

    ``order`` has to end in a unique column, both for a defined result and so that ties never share a partition.
    """
    placed = _sorted_slices(df, order)
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # One row per sort partition: the only window without PARTITION BY runs over this small table.
    offsets = placed.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n")).select(
        "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return (
        placed.join(offsets, "_slice")
        .withColumn(name, F.col("_place").bitwiseAND(F.lit(_ROW_MASK)) + 1 + F.col("_before"))
        .drop("_slice", "_place", "_before")
    )


#: Leading hexadecimal digits by which rows are counted, and rows that a task numbers, as far as the digits tell them apart.
_DIGITS = 3
_SLICE_ROWS = 250_000


def hashed_row_number(df: DataFrame, order: Mapping[str, Column], name: str = "row_number") -> DataFrame:
    """Add the hashes of ``order``, expressions of the columns of ``df``, and the one-based position of every row in their order.

    The first is the lower-case hexadecimal text of an evenly spread hash.  Its leading digits are counted first, which
    gives every slice of the order its offset; then rows are dealt over the slices without their hashes and numbered
    where they arrive.  They are shuffled once and stored nowhere, so ``df`` is computed twice and has to come out the
    same.  Missing hashes come first; rows that agree on all hashes are numbered in any order.
    """
    leading = F.substring(next(iter(order.values())), 1, _DIGITS)
    counts = df.groupBy(leading.alias("_digits")).agg(F.count(F.lit(1)).alias("_n")).collect()
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(sum(r["_n"] for r in counts) / _SLICE_ROWS))
    slices = min(tasks, 16**_DIGITS)
    sizes = [0] * slices
    for r in counts:
        sizes[int(r["_digits"] or "0", 16) * slices >> 4 * _DIGITS] += r["_n"]
    offsets = F.array(*[F.lit(n) for n in itertools.accumulate(sizes[:-1], initial=0)]).cast("array<bigint>")

    digits = F.coalesce(F.conv(leading, 16, 10).cast("int"), F.lit(0))
    placed = df.withColumn("_slice", F.shiftright(digits * slices, 4 * _DIGITS)).repartitionById(slices, "_slice")
    placed = placed.withColumns(dict(order)).sortWithinPartitions(*order).withColumn(
        "_place", F.monotonically_increasing_id())
    # Places count from the start of a slice only as long as every task holds one whole slice.
    position = F.when(F.shiftright("_place", _ROW_BITS) == F.col("_slice"),
                      F.col("_place").bitwiseAND(F.lit(_ROW_MASK)) + 1 + F.get(offsets, F.col("_slice")))
    moved = F.raise_error(F.lit("a slice of the order is not in the task of its number"))
    return placed.withColumn(name, position.otherwise(moved)).drop("_slice", "_place")


_COMBINE = {
    "sum": (F.sum, lambda inside, before: inside + F.coalesce(before, F.lit(0))),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
}


def running(df: DataFrame, order: Sequence[str], measures: Mapping[str, tuple[str, Column]], *,
            keys: Sequence[str] = ()) -> DataFrame:
    """Inclusive running sums, minima and maxima in a total order, restarting at every key.

    ``measures`` maps an output name to (``sum``/``min``/``max``, value).  Rows are range partitioned by keys and
    order, so even a key that holds a third of all rows is spread over many tasks; what crosses between tasks is
    one row per key and slice.
    """
    keys = list(keys)
    inputs = {out: f"_in{i}" for i, out in enumerate(measures)}
    source = df
    for out, (_, value) in measures.items():
        source = source.withColumn(inputs[out], value)
    placed = _sorted_slices(source, [*keys, *order])
    totals = placed.groupBy(*keys, "_slice").agg(
        *[_COMBINE[kind][0](inputs[out]).alias(f"_tot{i}") for i, (out, (kind, _)) in enumerate(measures.items())])
    by_key = Window.partitionBy(*keys) if keys else Window
    earlier = by_key.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_slice", *[
        _COMBINE[kind][0](f"_tot{i}").over(earlier).alias(f"_off{i}")
        for i, (kind, _) in enumerate(measures.values())])
    inside = Window.partitionBy(*keys, "_slice").orderBy("_place").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    result = placed.select("*", *[
        _COMBINE[kind][0](inputs[out]).over(inside).alias(f"_run{i}")
        for i, (out, (kind, _)) in enumerate(measures.items())])
    result = null_safe_join(result, offsets, [*keys, "_slice"])
    return result.select(*df.columns, *[
        _COMBINE[kind][1](F.col(f"_run{i}"), F.col(f"_off{i}")).alias(out)
        for i, (out, (kind, _)) in enumerate(measures.items())])


def first_per_key(df: DataFrame, key: Sequence[str], row_id: str, *, last: bool = False) -> DataFrame:
    """Keep each key's row with the smallest (or largest) unique id.

    The extreme is partially aggregated before the shuffle, so a key held by a third of all rows costs one
    number per map task instead of one oversized window partition; the rows come back by their unique id.
    """
    pick = F.max if last else F.min
    winners = df.groupBy(*key).agg(pick(row_id).alias(row_id)).select(row_id)
    return df.join(winners, row_id, "left_semi")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that lets missing keys match each other; the left keys are kept.

    Spark turns ``<=>`` into an ordinary hashed or sorted equi-join.
    """
    renamed = right.select(*[F.col(k).alias(f"_right_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])
