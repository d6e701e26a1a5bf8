"""Expansion, scheduling and validation of the planned grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens import protocol as P
from gridlens.functions import keys
from gridlens.operators.distributed import global_row_number, hashed_row_number


def expand(questions: DataFrame, models: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Every question under every model and condition, with stable keys; columns to ``keep`` go with each cell.

    Models and conditions are the fixed design, so each question row expands in place; nothing is joined.
    """
    design = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model_id"), F.lit(c).alias("condition_id")) for m in models for c in P.CONDITION_IDS]))
    cells = questions.select("question_id", *keep, design.alias("d")).select(
        "question_id", "d.model_id", "d.condition_id", *keep)
    cells = cells.withColumn("cell_id", keys.cell_key(F.col("question_id"), F.col("model_id"), F.col("condition_id")))
    return cells.withColumn("schedule_key", keys.schedule_key(F.col("cell_id")))


def schedule(cells: DataFrame) -> DataFrame:
    """Zero-based position of every cell in the hashed order.

    Cells without ``schedule_key`` and ``cell_id`` get both, as from :func:`expand`, where they are numbered: two keys
    of 64 digits are most of a cell, and a large plan is shuffled and not stored without them.
    """
    if "schedule_key" in cells.columns:
        numbered = global_row_number(cells, ["schedule_key", "cell_id"], "schedule_index")
    else:
        cell = keys.cell_key(F.col("question_id"), F.col("model_id"), F.col("condition_id"))
        order = {"schedule_key": keys.schedule_key(cell), "cell_id": cell}
        numbered = hashed_row_number(cells, order, "schedule_index")
    return numbered.withColumn("schedule_index", F.col("schedule_index") - 1)


def plan_counts(cells: DataFrame) -> DataFrame:
    """Planned cells with their distinct questions and models, for comparison with a manifest.

    Each kind of distinct value is counted by itself: several in one aggregation would shuffle every value once per kind.
    """
    models = cells.groupBy("model_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("cells"), F.count("model_id").alias("models"))
    questions = cells.groupBy("question_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count("question_id").alias("questions"))
    return models.crossJoin(questions).select("cells", "questions", "models")


def first_appearance(rows: DataFrame, key: str, sequence: str) -> DataFrame:
    """Distinct keys with the position at which each first appears."""
    return rows.groupBy(key).agg(F.min(sequence).alias("first_seen"), F.count(F.lit(1)).alias("n"))


def largest_by(rows: DataFrame, measure: Column, tie: str, n: int = 1) -> DataFrame:
    """The n rows with the largest measure; ties go to the smaller id."""
    return rows.orderBy(measure.desc(), F.col(tie)).limit(n)


def violations(frame: DataFrame, row_id: str, rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule and row; an unknown condition does not count as broken."""
    broken = F.array_compact(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()]))
    return frame.select(F.col(row_id).alias("row_id"), F.explode(broken).alias("rule"))


def duplicates(frame: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return frame.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose parent does not exist."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def cell_rules() -> dict[str, Column]:
    """Integrity rules of stored cells."""
    filled = lambda name: F.trim(F.col(name)) != ""
    return {
        "question_present": filled("question_id"),
        "model_present": filled("model_id"),
        "condition_known": F.col("condition_id").isin(list(P.CONDITION_IDS)),
        "copies_match_condition": F.col("copies") == P.copies(F.col("condition_id")),
        "status_known": F.col("status").isin(list(P.CELL_STATUSES)),
        "completed_has_content": (F.col("status") != "completed") | (F.coalesce(F.trim("content"), F.lit("")) != ""),
        "failure_has_error": ~F.col("status").isin("failed", "retryable", "truncated", "refused")
        | (F.coalesce(F.trim("error"), F.lit("")) != ""),
        "tokens_not_negative": (F.coalesce("input_tokens", F.lit(0)) >= 0)
        & (F.coalesce("output_tokens", F.lit(0)) >= 0),
    }


def question_rules(normalized: Column) -> dict[str, Column]:
    """Domain rules of questions whose choices are an ordered array of (label, text).

    ``normalized`` is the array of normalised choice texts.
    """
    labels = F.transform("choices", lambda c: c["label"])
    expected = F.transform(F.sequence(F.lit(0), F.size("choices") - 1), lambda i: F.char(i + 65))
    return {
        "choice_count": F.size("choices").between(2, 26),
        "labels_contiguous": labels == expected,
        "texts_distinct": F.size(F.array_distinct(normalized)) == F.size("choices"),
        "texts_present": ~F.exists(normalized, lambda t: t == ""),
        "gold_is_label": F.array_contains(labels, F.col("gold")),
        "gold_text_matches": F.get(F.filter("choices", lambda c: c["label"] == F.col("gold")), F.lit(0))["text"]
        == F.col("gold_text"),
        "stem_present": F.trim("stem") != "",
    }


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only."""
    missing = left.select(key).distinct().exceptAll(right.select(key).distinct()).withColumn("side", F.lit("left"))
    extra = right.select(key).distinct().exceptAll(left.select(key).distinct()).withColumn("side", F.lit("right"))
    return missing.unionByName(extra)
