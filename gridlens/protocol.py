"""Fixed design of the experiment grid: conditions, contrast groups, statuses and pairings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Condition order and the copy locations each one holds.
CONDITIONS = {
    "zero": (False, False, False),
    "system": (True, False, False),
    "before": (False, True, False),
    "after": (False, False, True),
    "system_before": (True, True, False),
    "system_after": (True, False, True),
    "before_after": (False, True, True),
    "system_before_after": (True, True, True),
}
CONDITION_IDS = tuple(CONDITIONS)
FACTORS = ("system", "before", "after")

# Condition groups compared by the contrasts.
SINGLE = ("system", "before", "after")
DOUBLE = ("system_before", "system_after", "before_after")
TRAILING_TREATMENT = ("system_after", "before_after")
TRAILING_CONTROL = ("system", "before")
AFTER_ONLY = ("after",)
CONVENTIONAL = ("system", "before")
BEFORE_ONLY = ("before",)
SYSTEM_ONLY = ("system",)

# One-copy condition, two-copy condition, and the location added.
PAIRINGS = (
    ("system", "system_before", "before"),
    ("system", "system_after", "after"),
    ("before", "system_before", "system"),
    ("before", "before_after", "after"),
    ("after", "system_after", "system"),
    ("after", "before_after", "before"),
)

# Additive predictions and the single-copy cells they are built from.
ADDITIVE_TARGETS = {
    "system_before": ("system", "before"),
    "system_after": ("system", "after"),
    "before_after": ("before", "after"),
    "system_before_after": ("system", "before", "after"),
}

# Factorial terms in report order.
FACTORIAL_TERMS = (
    ("system",),
    ("before",),
    ("after",),
    ("system", "before"),
    ("system", "after"),
    ("before", "after"),
    ("system", "before", "after"),
)

CELL_STATUSES = ("pending", "running", "completed", "retryable", "budget_blocked", "truncated", "refused", "failed")
OPEN_STATUSES = ("pending", "retryable", "budget_blocked")


@dataclass(frozen=True)
class Condition:
    id: str
    system: bool
    before: bool
    after: bool

    @property
    def copies(self) -> int:
        return self.system + self.before + self.after


def condition(name: str) -> Condition:
    return Condition(name, *CONDITIONS[name])


def conditions_table(spark: SparkSession) -> DataFrame:
    """The eight-row condition table (fixed size)."""
    rows = [(i, c, *flags, sum(flags)) for i, (c, flags) in enumerate(CONDITIONS.items())]
    return spark.createDataFrame(
        rows, "ordinal int, condition_id string, system boolean, before boolean, after boolean, copies int"
    )


def condition_array() -> Column:
    """All condition ids as an array literal, so the grid needs no join to expand."""
    return F.array(*[F.lit(c) for c in CONDITION_IDS])


def condition_ordinal(condition_id: Column) -> Column:
    return F.array_position(condition_array(), condition_id) - 1


def copies(condition_id: Column) -> Column:
    """Number of instruction copies a condition holds."""
    branches = F.lit(None).cast("int")
    for name in reversed(CONDITION_IDS):
        branches = F.when(condition_id == name, F.lit(condition(name).copies)).otherwise(branches)
    return branches


def factor_flag(condition_id: Column, factor: str) -> Column:
    holders = [name for name, flags in CONDITIONS.items() if flags[FACTORS.index(factor)]]
    return condition_id.isin(holders)


def term_sign(name: str, term: tuple[str, ...]) -> int:
    """Product of the +1/-1 codes of a term's factors in one condition."""
    flags = dict(zip(FACTORS, CONDITIONS[name]))
    negatives = sum(1 for factor in term if not flags[factor])
    return -1 if negatives % 2 else 1
