"""A blinded study from pairs to its test: changed roles, frozen rating sheets, confirmations and sentinels."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.functions.keys import hash_key
from gridlens.operators.agreement import rating_direction

RATINGS = ("A", "B", "same", "cannot_tell")
_TOLERANCE = 1e-12


def role_changes(control: Mapping[str, Column], treatment: Mapping[str, Column]) -> Column:
    """Roles whose score differs, in the order given, with both scores; a role with a missing score has no change."""
    rows = [F.struct(F.lit(role).alias("role"), control[role].cast("double").alias("control_score"),
                     treatment[role].cast("double").alias("treatment_score")) for role in control]
    return F.filter(F.array(*rows), lambda r: F.abs(r["treatment_score"] - r["control_score"]) > _TOLERANCE)


def tied_role(control: Mapping[str, Column], treatment: Mapping[str, Column], pair: Column, seed: str) -> Column:
    """The role that a tie is shown for: of those with equal scores, the one whose hash with the pair is smallest."""
    rows = [F.when(F.abs(treatment[role] - control[role]) <= _TOLERANCE,
                   F.struct(hash_key(seed, "tie-role", pair, role).alias("hash"), F.lit(role).alias("role"))) for role in control]
    return F.array_min(F.array_compact(F.array(*rows)))["role"]


def completion_stratum(control: Sequence[Column], treatment: Sequence[Column], written: Column) -> Column:
    """Change of "all roles complete"; none where a side has no text or an unscored role."""
    before, after = (F.forall(F.array(*[s.cast("double") for s in side]), lambda s: s >= 1) for side in (control, treatment))
    before, after = before.cast("int"), after.cast("int")
    return F.when(written & before.isNotNull() & after.isNotNull(), F.when(after > before, "improvement").when(
        after < before, "degradation").otherwise("tie"))


def study_key(pairs: DataFrame, roles: Sequence[str], seed: str, *, written: Column) -> DataFrame:
    """The hidden key: one row per pair with its stratum, the roles it is shown for, sides and the side the scores prefer.

    ``pairs`` has control_role and treatment_role columns.  Improvements and degradations are shown for every changed
    role, ties for one tied role.  Pairs without a stratum leave.
    """
    control = {r: F.col(f"control_{r}") for r in roles}
    treatment = {r: F.col(f"treatment_{r}") for r in roles}
    stratum = completion_stratum(list(control.values()), list(treatment.values()), written)
    keyed = pairs.withColumn("stratum", stratum).filter("stratum is not null")
    changed = F.transform(role_changes(control, treatment), lambda r: r["role"])
    shown = F.when(F.col("stratum") == "tie", F.array_compact(F.array(tied_role(control, treatment, F.col("pair_id"), seed)))
                   ).otherwise(changed)
    parity = F.conv(F.substring(hash_key(seed, "side", F.col("pair_id")), 64, 1), 16, 10).cast("int") % 2
    side = F.when(parity == 0, "A").otherwise("B")
    other = F.when(parity == 0, "B").otherwise("A")
    preferred = F.when(F.col("stratum") == "improvement", side).when(F.col("stratum") == "degradation", other).otherwise("same")
    return keyed.select("pair_id", "question_id", "model_id", "dataset", "stratum", changed.alias("changed_roles"),
                        shown.alias("shown_roles"), side.alias("treatment_response"), preferred.alias("preferred"))


def sheet_violations(sheets: DataFrame, *, version: str, audit: str, tasks: int) -> DataFrame:
    """What keeps rating sheets from being frozen: one row per sheet, rule and (for rules on tasks) task.

    ``sheets`` has one row per answer: sheet_id, version, audit_id, reviewer, task_id, rating.  Answers meet by sheet
    and task first, so a repeated task costs one row.
    """
    by_task = sheets.groupBy("sheet_id", "task_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("rating").isin(*RATINGS), F.lit(False))).alias("allowed"),
        F.bool_and(F.coalesce(F.col("version") == version, F.lit(False))).alias("version"),
        F.bool_and(F.coalesce(F.col("audit_id") == audit, F.lit(False))).alias("audit"),
        F.bool_and(F.coalesce(F.trim("reviewer") != "", F.lit(False))).alias("reviewer"))
    task_rules = F.array_compact(F.array(F.when(F.col("n") > 1, F.lit("task_rated_once")),
                                         F.when(F.col("allowed") < F.col("n"), F.lit("rating_allowed"))))
    of_tasks = by_task.select("sheet_id", "task_id", F.explode(task_rules).alias("rule"))
    by_sheet = by_task.groupBy("sheet_id").agg(
        F.sum("n").alias("n"), *[F.bool_and(c).alias(c) for c in ("version", "audit", "reviewer")])
    sheet_rules = F.array_compact(F.array(
        F.when(~F.col("version"), F.lit("version_known")), F.when(~F.col("audit"), F.lit("audit_matches")),
        F.when(~F.col("reviewer"), F.lit("reviewer_named")), F.when(F.col("n") != tasks, F.lit("all_tasks_rated"))))
    of_sheets = by_sheet.select("sheet_id", F.lit(None).cast("string").alias("task_id"), F.explode(sheet_rules).alias("rule"))
    return of_tasks.unionByName(of_sheets)


def frozen_sheets(sheets: DataFrame, *, version: str, audit: str, tasks: int) -> DataFrame:
    """Sheets without violations with a digest of their answers; each has exactly ``tasks`` answers."""
    bad = sheet_violations(sheets, version=version, audit=audit, tasks=tasks).select("sheet_id").distinct()
    good = sheets.join(bad, "sheet_id", "left_anti")
    lines = F.array_sort(F.collect_list(F.concat_ws("\t", "task_id", "rating")))
    return good.groupBy("sheet_id").agg(F.max("reviewer").alias("reviewer"), F.count(F.lit(1)).alias("n"),
                                        F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))


def confirmations(key: DataFrame, ratings: DataFrame) -> DataFrame:
    """Key rows with their rating; undecided answers confirm nothing, a missing rating stays missing."""
    human, machine = rating_direction(F.col("rating")), rating_direction(F.col("preferred"))
    confirmed = F.when(F.col("rating").isNotNull(), F.coalesce(human == machine, F.lit(False)))
    return key.join(ratings, "pair_id", "left").withColumn("confirmed", confirmed).withColumn(
        "opposite", F.coalesce((human == -machine) & (machine != 0), F.lit(False)))


def sentinels(decoded: DataFrame, by: Sequence[str]) -> DataFrame:
    """Answers and confirmations per group."""
    return decoded.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("confirmed").alias("confirmed"),
        *[F.count_if(F.col("rating") == r).alias(f"human_{r}") for r in RATINGS])


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function by the modified Lentz rule."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / ((1 - (a + b) * x / (a + 1)) or tiny)
    value = d
    m = 1
    while True:
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / ((1 + term * d) or tiny)
            c = (1 + term / c) or tiny
            value *= d * c
        if abs(d * c - 1) < 1e-15:
            return value
        m += 1


def upper_tail(n: int, k: int, p: float) -> float:
    """P(X >= k) of a binomial count; time grows with the root of n and memory does not grow."""
    if k <= 0:
        return 1.0
    if k > n:
        return 0.0
    a, b = float(k), float(n - k + 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(p) + b * math.log1p(-p))
    if p < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, p) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - p) / b


def critical_count(n: int, p: float, alpha: float) -> int:
    """Fewest confirmations whose upper tail is at most alpha; n + 1 where there is none."""
    low, high = 0, n + 1
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if upper_tail(n, middle, p) <= alpha else (middle + 1, high)
    return low


def lower_limit(n: int, k: int, alpha: float) -> float:
    """One-sided exact lower bound of the confirmation probability."""
    if k == 0:
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if upper_tail(n, k, middle) < alpha else (low, middle)
    return low


def confirm_test(decoded: DataFrame, by: Sequence[str], *, p0: float = 0.5, alpha: float = 0.05) -> DataFrame:
    """Exact one-sided test of the confirmations over all rows and in every group of the ``by`` columns.

    Pairs are counted by Spark; the numbers of a group are a few and are worked out from its two counts.
    """
    rated = decoded.filter("confirmed is not null")
    counted = rated.groupingSets([[], list(by)], *by).agg(
        F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"), F.count_if("confirmed").alias("confirmations"),
        F.count_if(F.col("rating") == "same").alias("same"), F.count_if(F.col("rating") == "cannot_tell").alias("cannot_tell"),
        F.count_if("opposite").alias("opposite"))

    @F.pandas_udf("p_value double, lower_bound double, critical bigint")
    def exact(n: pd.Series, k: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({
            "p_value": [upper_tail(int(a), int(b), p0) for a, b in zip(n, k)],
            "lower_bound": [lower_limit(int(a), int(b), alpha) for a, b in zip(n, k)],
            "critical": [critical_count(int(a), p0, alpha) for a in n]})

    tested = counted.filter("n > 0").withColumn("t", exact("n", "confirmations"))
    return tested.select("*", (F.col("confirmations") / F.col("n")).alias("rate"), "t.p_value", "t.lower_bound", "t.critical",
                         (F.col("confirmations") >= F.col("t.critical")).alias("rejected")).drop("t")


def hint_lines(text: Column, pattern: str, *, lines: int = 4, width: int = 240) -> Column:
    """The first lines that match, trimmed and cut for display."""
    found = F.filter(F.split(text, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"), lambda line: line.rlike(pattern))
    return F.transform(F.slice(found, 1, lines), lambda line: F.substring(F.regexp_replace(line, r"(?U)^\s+|\s+$", ""), 1, width))


def flag_histogram(rows: DataFrame, flags: Column) -> DataFrame:
    """How often every combination of flags occurs, in the order of the flags; rows without flags are eligible."""
    return rows.select(F.array_join(F.array_compact(flags), "|").alias("flags")).groupBy("flags").agg(
        F.count(F.lit(1)).alias("n")).withColumn("eligible", F.col("flags") == "")
