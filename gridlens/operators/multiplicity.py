"""Multiplicity adjustment over contrast tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def holm(tests: DataFrame, family: Sequence[str], order: Sequence[str], *, p_value: str = "p_value",
         out: str = "holm_p_value") -> DataFrame:
    """Step-down adjustment inside each family; missing p-values stay missing and do not count.

    A family is a declared handful of contrasts, never data rows, so a window per family stays small.
    ``order`` breaks ties between equal p-values.
    """
    tested = F.col(p_value).isNotNull()
    members = Window.partitionBy(*family, tested)
    ranked = members.orderBy(F.col(p_value), *order)
    running = ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scaled = (F.count(F.lit(1)).over(members) - F.row_number().over(ranked) + 1) * F.col(p_value)
    return (
        tests.withColumn("_scaled", scaled)
        .withColumn(out, F.when(tested, F.least(F.lit(1.0), F.max("_scaled").over(running))))
        .drop("_scaled")
    )
