"""Paired, question-clustered contrasts over a grid of cells.

A *cell* frame has one row per (question_id, model_id, condition_id) with outcome columns.  A *unit* is one
question under one model.  Everything here is two ordinary aggregations: cells to units (conditions become eight
columns) and units to questions, both of which combine on the map side.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens import protocol as P

UNIT_KEYS = ("question_id", "model_id")


@dataclass(frozen=True)
class Spec:
    """One comparison of condition groups, evaluated for every listed outcome."""

    family: str
    outcomes: tuple[str, ...]
    treatment: tuple[str, ...] = ()
    control: tuple[str, ...] = ()
    term: tuple[str, ...] = ()
    group: str | None = None
    groups: tuple[str, ...] = ()
    usable_only: bool = False
    seed_base: int = 0
    outcome_stride: int = 100
    group_stride: int = 1000
    seed_offset: int = 0

    @property
    def label(self) -> str:
        return " x ".join(self.term)

    @property
    def population(self) -> str:
        return "per-protocol sensitivity" if self.usable_only else "intention-to-treat"


def finite(value: Column) -> Column:
    """Booleans become 0/1; NaN and infinities become null."""
    number = value.cast("double")
    return F.when(F.isnan(number) | (F.abs(number) == float("inf")), None).otherwise(number)


def long_outcomes(cells: DataFrame, outcomes: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Unpivot outcome columns to (outcome, value) rows, leaving undefined values out."""
    pairs = F.array(*[F.struct(F.lit(o).alias("outcome"), finite(F.col(o)).alias("value")) for o in outcomes])
    return (
        cells.select(*keep, F.explode(pairs).alias("pair"))
        .select(*keep, "pair.outcome", "pair.value")
        .filter(F.col("value").isNotNull())
    )


def unit_pivot(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per unit and outcome with a column for each of the eight conditions."""
    return long.groupBy(*keys, "outcome").agg(
        *[F.max(F.when(F.col("condition_id") == c, F.col("value"))).alias(c) for c in P.CONDITION_IDS]
    )


def mean_of(columns: Sequence[str]) -> Column:
    """Mean of columns; null as soon as one of them is missing."""
    total = F.col(columns[0])
    for name in columns[1:]:
        total = total + F.col(name)
    return total / F.lit(float(len(columns)))


def spec_means(spec: Spec) -> tuple[Column, Column]:
    """The high and low mean of one unit under a comparison; null for incomplete units."""
    if spec.term:
        complete = F.lit(True)
        for name in P.CONDITION_IDS:
            complete = complete & F.col(name).isNotNull()
        high = [c for c in P.CONDITION_IDS if P.term_sign(c, spec.term) > 0]
        low = [c for c in P.CONDITION_IDS if P.term_sign(c, spec.term) < 0]
        return F.when(complete, mean_of(high)), F.when(complete, mean_of(low))
    high, low = mean_of(spec.treatment), mean_of(spec.control)
    both = high.isNotNull() & low.isNotNull()
    return F.when(both, high), F.when(both, low)


def zero_as_absent(cells: DataFrame, outcomes: Iterable[str]) -> DataFrame:
    """Score the zero condition 0 where an absent protocol leaves the outcome undefined."""
    result = cells
    for name in outcomes:
        value = finite(F.col(name))
        result = result.withColumn(name, F.coalesce(value, F.when(F.col("condition_id") == "zero", F.lit(0.0))))
    return result


def _spec_rows(spec: Spec) -> list[Column]:
    """Struct literals (one per group attribute) that a unit contributes for a comparison."""
    high, low = spec_means(spec)
    group = F.col(spec.group) if spec.group else F.lit(None).cast("string")
    applies = F.col("outcome").isin(list(spec.outcomes))
    if spec.groups:
        applies = applies & group.isin(list(spec.groups))
    row = F.struct(
        F.lit(spec.family).alias("family"),
        F.lit(spec.label).alias("term"),
        group.alias("group_value"),
        high.alias("high"),
        low.alias("low"),
    )
    return [F.when(applies, row)]


def question_differences(cells: DataFrame, specs: Sequence[Spec], *, zero_absent: Sequence[str] = (),
                         model_order: str = "model_ord") -> DataFrame:
    """Per-question treatment and control means for every comparison.

    Result: family, term, group_value, outcome, question_id, high, low, diff, units, incomplete, first_model.
    ``first_model`` is the ordinal of the first model with a complete unit; sorting by (first_model, question_id)
    gives the order in which the resamplers consume the differences.
    """
    parts = []
    plain = [s for s in specs if not s.term]
    factorial = [s for s in specs if s.term]
    if any(not s.usable_only for s in plain):
        parts.append((cells, [s for s in plain if not s.usable_only]))
    if any(s.usable_only for s in plain):
        parts.append((cells.filter(F.coalesce(F.col("generation_usable"), F.lit(False))),
                      [s for s in plain if s.usable_only]))
    if factorial:
        absent = [o for s in factorial for o in s.outcomes if o in zero_absent]
        parts.append((zero_as_absent(cells, dict.fromkeys(absent)), factorial))

    exploded = None
    for source, group in parts:
        attributes = list(dict.fromkeys(s.group for s in group if s.group and s.group not in UNIT_KEYS))
        ordinal = [model_order] if model_order in source.columns else []
        keys = [*UNIT_KEYS, *ordinal, *attributes]
        outcomes = list(dict.fromkeys(o for s in group for o in s.outcomes))
        units = unit_pivot(long_outcomes(source, outcomes, [*keys, "condition_id"]), keys)
        rows = F.array_compact(F.array(*[row for s in group for row in _spec_rows(s)]))
        first = F.col(model_order) if ordinal else F.lit(0)
        part = units.select(
            "question_id", "outcome", first.cast("int").alias("model_ord"), F.explode(rows).alias("r")
        ).select("r.*", "outcome", "question_id", "model_ord")
        exploded = part if exploded is None else exploded.unionByName(part)

    complete = F.col("high").isNotNull()
    per_question = exploded.groupBy("family", "term", "group_value", "outcome", "question_id").agg(
        F.avg("high").alias("high"),
        F.avg("low").alias("low"),
        F.count("high").alias("units"),
        F.sum(F.when(complete, 0).otherwise(1)).alias("incomplete"),
        F.min(F.when(complete, F.col("model_ord"))).alias("first_model"),
    )
    return per_question.withColumn("diff", F.col("high") - F.col("low"))


def contrast_summary(differences: DataFrame) -> DataFrame:
    """Equal-weight means over question clusters, one row per contrast."""
    return differences.groupBy("family", "term", "group_value", "outcome").agg(
        F.avg("high").alias("treatment_mean"),
        F.avg("low").alias("control_mean"),
        F.avg("diff").alias("effect"),
        F.count("diff").alias("question_clusters"),
        F.sum("incomplete").cast("bigint").alias("incomplete_units"),
    )


def condition_means(cells: DataFrame, outcomes: Sequence[str]) -> DataFrame:
    """Mean and count of every outcome in every condition."""
    long = long_outcomes(cells, outcomes, ["condition_id"])
    return long.groupBy("condition_id", "outcome").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


def sample_summary(cells: DataFrame) -> DataFrame:
    """One row of distinct counts and usable cells.

    Each distinct count runs over an already reduced set, so no row is multiplied for the separate counts.
    """
    units = cells.groupBy("question_id", "model_id", "dataset").agg(
        F.count(F.lit(1)).alias("cells"),
        F.sum(F.coalesce(F.col("generation_usable"), F.lit(False)).cast("bigint")).alias("usable"),
    )
    return units.agg(
        F.countDistinct("model_id").alias("models"),
        F.countDistinct("dataset").alias("datasets"),
        F.countDistinct("question_id").alias("questions"),
        F.sum("cells").alias("cells"),
        F.sum("usable").alias("usable_cells"),
    )


def status_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def condition_table(cells: DataFrame, outcomes: Sequence[str]) -> DataFrame:
    """Scheduled cells, end states, mean tokens (missing counted as zero) and outcome means by condition."""
    measures = [
        F.count(F.lit(1)).alias("n_scheduled"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "truncated", "failed")],
        F.avg(F.coalesce(F.col("output_tokens"), F.lit(0)).cast("double")).alias("mean_output_tokens"),
    ]
    for name in outcomes:
        measures += [F.avg(finite(F.col(name))).alias(name), F.count(finite(F.col(name))).alias(f"{name}_n")]
    return cells.groupBy("condition_id").agg(*measures)


def status_by_copies(cells: DataFrame) -> DataFrame:
    """End states by number of instruction copies."""
    return cells.groupBy(P.copies(F.col("condition_id")).alias("copies")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "truncated", "failed")],
    )


def status_indicators(cells: DataFrame) -> DataFrame:
    """Status outcomes as 0/1 columns, to be compared like any other outcome."""
    return cells.select(
        "*",
        (F.col("status") == "truncated").cast("double").alias("is_truncated"),
        (F.col("status") == "failed").cast("double").alias("is_failed"),
        (F.col("status") != "completed").cast("double").alias("not_completed"),
    )


def accuracy_rollup(cells: DataFrame) -> DataFrame:
    """Correct and scheduled cells by copy group and condition, with subtotals."""
    group = F.when(F.col("condition_id").isin(list(P.SINGLE)), "one_copy").when(
        F.col("condition_id").isin(list(P.DOUBLE)), "two_copy"
    )
    counted = cells.select(group.alias("copy_group"), "condition_id", "accuracy").filter("copy_group is not null")
    return counted.rollup("copy_group", "condition_id").agg(
        F.sum(F.coalesce(F.col("accuracy"), F.lit(0)).cast("bigint")).alias("correct"),
        F.count(F.lit(1)).alias("scheduled"),
    )


def additive_residuals(cells: DataFrame, outcomes: Sequence[str], *, zero_absent: Sequence[str] = ()) -> DataFrame:
    """Observed multi-copy cells against the sum of their single-copy effects, clustered by question.

    Result: outcome, target_condition, question_id, observed, predicted, diff, first_model.
    """
    source = zero_as_absent(cells, [o for o in outcomes if o in zero_absent])
    ordinal = ["model_ord"] if "model_ord" in source.columns else []
    keys = [*UNIT_KEYS, *ordinal]
    units = unit_pivot(long_outcomes(source, outcomes, [*keys, "condition_id"]), keys)
    targets = []
    for target, singles in P.ADDITIVE_TARGETS.items():
        predicted = F.col(singles[0])
        for name in singles[1:]:
            predicted = predicted + F.col(name)
        predicted = predicted - F.lit(float(len(singles) - 1)) * F.col("zero")
        targets.append(F.struct(F.lit(target).alias("target_condition"), F.col(target).alias("observed"),
                                predicted.alias("predicted")))
    first = F.col("model_ord") if ordinal else F.lit(0)
    rows = units.select("outcome", "question_id", first.alias("model_ord"), F.explode(F.array(*targets)).alias("t"))
    complete = rows.select("outcome", "question_id", "model_ord", "t.*").filter(
        "observed is not null and predicted is not null"
    )
    return complete.groupBy("outcome", "target_condition", "question_id").agg(
        F.avg("observed").alias("observed"),
        F.avg("predicted").alias("predicted"),
        F.avg(F.col("observed") - F.col("predicted")).alias("diff"),
        F.min("model_ord").alias("first_model"),
    )


def residual_summary(residuals: DataFrame) -> DataFrame:
    return residuals.groupBy("outcome", "target_condition").agg(
        F.avg("observed").alias("observed_mean"),
        F.avg("predicted").alias("predicted_mean"),
        F.avg("diff").alias("residual"),
        F.count("diff").alias("question_clusters"),
    )


def benefit_ranks(contrasts: DataFrame, adverse: Sequence[str]) -> DataFrame:
    """Rank models within each outcome by effect in the beneficial direction; undefined effects are left out."""
    benefit = F.when(F.col("outcome").isin(list(adverse)), -F.col("effect")).otherwise(F.col("effect"))
    window = Window.partitionBy("outcome").orderBy(F.col("benefit").desc(), F.col("model_id"))
    return (
        contrasts.withColumn("benefit", benefit)
        .filter(F.col("benefit").isNotNull())
        .withColumn("benefit_rank", F.row_number().over(window))
    )


def effect_matrix(contrasts: DataFrame, models: Sequence[str]) -> DataFrame:
    """Outcome-by-model matrix of effects."""
    return contrasts.groupBy("outcome").pivot("model_id", list(models)).agg(F.first("effect"))
