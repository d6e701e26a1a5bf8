"""Human ratings against machine directions, and the exact design of such a study."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.functions.text import text_sign


def rating_direction(rating: Column) -> Column:
    return F.when(rating == "A", 1).when(rating == "B", -1).when(rating == "same", 0)


def treatment_direction(direction: Column, treatment_side: Column) -> Column:
    return F.when(treatment_side == "A", direction).otherwise(-direction)


def decode(key: DataFrame, ratings: DataFrame) -> DataFrame:
    """Key rows with human and machine directions; missing ratings and undecided ones stay visible."""
    joined = key.join(ratings, "task_id", "left")
    human = rating_direction(F.col("rating"))
    machine = text_sign(F.col("mechanical_a") - F.col("mechanical_b"))
    return joined.select(
        "*", human.alias("human_ab"), machine.alias("machine_ab"),
        (treatment_direction(human, F.col("treatment_response")) - treatment_direction(machine, F.col("treatment_response")))
        .alias("correction"))


def agreement(decoded: DataFrame) -> DataFrame:
    """Agreement overall, by task kind and by role, in one pass over grouping sets."""
    rated = decoded.filter(F.col("human_ab").isNotNull())
    same = F.col("human_ab") == F.col("machine_ab")
    untied = (F.col("human_ab") != 0) | (F.col("machine_ab") != 0)
    return rated.groupingSets([[], ["task_kind"], ["task_kind", "role"]], "task_kind", "role").agg(
        F.count(F.lit(1)).alias("evaluable"),
        F.avg(same.cast("double")).alias("raw_agreement"),
        F.avg(F.when(untied, same.cast("double"))).alias("non_tied_agreement"),
        F.avg(F.col("correction").cast("double")).alias("mean_correction"),
        F.grouping_id().cast("int").alias("level"))


def confusion(labels: DataFrame, human: str, machine: str) -> DataFrame:
    return labels.groupBy(human, machine).agg(F.count(F.lit(1)).alias("n"))


def confusion_summary(labels: DataFrame, human: str, machine: str) -> DataFrame:
    """Agreement, sensitivity and specificity of a binary machine label."""
    h, m = F.col(human) == 1, F.col(machine) == 1
    return labels.agg(
        F.count(F.lit(1)).alias("n"), F.avg((h == m).cast("double")).alias("agreement"),
        F.avg(F.when(h, m.cast("double"))).alias("sensitivity"),
        F.avg(F.when(~h, (~m).cast("double"))).alias("specificity"))


def binomial_upper_tail(n: int, k: int, p: float) -> float:
    """P(X >= k) of a binomial count."""
    return math.fsum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k, n + 1))


def exact_design(p0: float, p1: float, alpha: float, power: float) -> tuple[int, int, float]:
    """Smallest sample and critical count with the wanted size and power; one exists as p0 < p1."""
    if not (0 < p0 < p1 < 1 and 0 < alpha < 1 and 0 < power < 1):
        raise ValueError("need 0 < p0 < p1 < 1 and alpha, power inside (0, 1)")
    for n in itertools.count(1):
        k = next((k for k in range(n + 1) if binomial_upper_tail(n, k, p0) <= alpha), None)
        if k is not None and binomial_upper_tail(n, k, p1) >= power:
            return n, k, binomial_upper_tail(n, k, p1)
    raise AssertionError


def lower_bound(successes: int, n: int, alpha: float) -> float:
    """One-sided exact lower confidence bound of a success probability."""
    if successes == 0:
        return 0.0
    if successes == n:
        return alpha ** (1 / n)
    low, high = 0.0, 1.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if binomial_upper_tail(n, successes, middle) < alpha else (low, middle)
    return low


def discordant(decoded: DataFrame) -> DataFrame:
    """Wins, losses and ties of the treatment among rated tasks, by stratum."""
    direction = treatment_direction(F.col("human_ab"), F.col("treatment_response"))
    return decoded.filter(F.col("human_ab").isNotNull()).groupBy("task_kind").agg(
        F.count_if(direction > 0).alias("wins"), F.count_if(direction < 0).alias("losses"),
        F.count_if(direction == 0).alias("ties"))


def sign_test(wins: int, losses: int, alpha: float = 0.05) -> tuple[float, float | None]:
    """One-sided exact p-value among discordant pairs and the lower bound of the win probability."""
    n = wins + losses
    return (binomial_upper_tail(n, wins, 0.5) if n else 1.0), (lower_bound(wins, n, alpha) if n else None)
