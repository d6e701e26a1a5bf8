"""Fixed-effect least squares with cluster-robust errors, from sufficient statistics.

Demeaning inside a fixed-effect group needs only the group's sums, sums of squares and cross products.  So one
partially aggregated pass replaces a window over every group, and the cluster scores follow from the same sums
once the two coefficients are known.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def erfc(value: pd.Series) -> pd.Series:
    """Complementary error function, which Spark does not have."""
    return value.map(lambda x: None if pd.isna(x) else math.erfc(x))


def fixed_effect_fit(rows: DataFrame, effects: Sequence[str], cluster: str, *, treat: str = "t", length: str = "x",
                     outcome: str = "y") -> DataFrame:
    """Fit outcome ~ treat + length within fixed effects; standard errors clustered by ``cluster`` (CR1).

    One result row: cell, group and cluster counts, both coefficients, their errors and test results, and the
    plain means of both arms.
    """
    t, x, y = F.col(treat), F.col(length), F.col(outcome)
    keys = list(dict.fromkeys([*effects, cluster]))
    groups = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(t).alias("st"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
        F.sum(t * t).alias("stt"), F.sum(t * x).alias("stx"), F.sum(x * x).alias("sxx"),
        F.sum(t * y).alias("sty"), F.sum(x * y).alias("sxy"),
        F.sum(F.when(t == 0, y)).alias("y0"), F.sum(F.when(t == 1, y)).alias("y1"),
        F.sum(F.when(t == 0, x)).alias("x0"), F.sum(F.when(t == 1, x)).alias("x1"),
        F.count_if(t == 0).alias("n0"), F.count_if(t == 1).alias("n1"),
    )

    def centred(product: str, left: str, right: str):
        return F.col(product) - F.col(left) * F.col(right) / F.col("n")

    clusters = groups.groupBy(cluster).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"),
        F.sum(centred("stt", "st", "st")).alias("tt"), F.sum(centred("stx", "st", "sx")).alias("tx"),
        F.sum(centred("sxx", "sx", "sx")).alias("xx"), F.sum(centred("sty", "st", "sy")).alias("ty"),
        F.sum(centred("sxy", "sx", "sy")).alias("xy"),
        *[F.sum(c).alias(c) for c in ("y0", "y1", "x0", "x1", "n0", "n1")],
    )
    # The residual scores of a cluster are linear in the coefficients, so their squares need only the cluster-level
    # products below: one pass, no second look at the clusters once the coefficients are known.
    parts = ("tt", "tx", "xx", "ty", "xy")
    products = [(a, b) for i, a in enumerate(parts) for b in parts[i:]]
    totals = clusters.agg(
        F.sum("n").alias("n_cells"), F.sum("groups").alias("fixed_effects"), F.count(F.lit(1)).alias("clusters"),
        *[F.sum(c).alias(f"g_{c}") for c in parts],
        *[F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for a, b in products],
        (F.sum("y0") / F.sum("n0")).alias("control_outcome"), (F.sum("y1") / F.sum("n1")).alias("treated_outcome"),
        (F.sum("x0") / F.sum("n0")).alias("control_length"), (F.sum("x1") / F.sum("n1")).alias("treated_length"),
    )
    det = F.col("g_tt") * F.col("g_xx") - F.col("g_tx") * F.col("g_tx")
    totals = totals.select(
        "*",
        (F.col("g_xx") / det).alias("i_tt"), (-F.col("g_tx") / det).alias("i_tx"), (F.col("g_tt") / det).alias("i_xx"),
        ((F.col("g_xx") * F.col("g_ty") - F.col("g_tx") * F.col("g_xy")) / det).alias("b_t"),
        ((F.col("g_tt") * F.col("g_xy") - F.col("g_tx") * F.col("g_ty")) / det).alias("b_x"),
    )
    one, bt, bx = F.lit(1.0), -F.col("b_t"), -F.col("b_x")
    score_t = {"ty": one, "tt": bt, "tx": bx}
    score_x = {"xy": one, "tx": bt, "xx": bx}

    def score_product(left: dict, right: dict):
        total = F.lit(0.0)
        for a, weight_a in left.items():
            for b, weight_b in right.items():
                first, second = sorted((a, b), key=parts.index)
                total = total + weight_a * weight_b * F.col(f"p_{first}_{second}")
        return total

    both = totals.select(
        "*", score_product(score_t, score_t).alias("uu"), score_product(score_t, score_x).alias("uv"),
        score_product(score_x, score_x).alias("vv"),
    )
    n, g = F.col("n_cells"), F.col("clusters")
    correction = (g / (g - 1)) * ((n - 1) / (n - 2))

    def sandwich(a: str, b: str):
        return correction * (
            F.col(a) * F.col(a) * F.col("uu") + 2 * F.col(a) * F.col(b) * F.col("uv") + F.col(b) * F.col(b) * F.col("vv")
        )

    fitted = both.select(
        "n_cells", "fixed_effects", "clusters", "control_outcome", "treated_outcome", "control_length",
        "treated_length", F.col("b_t").alias("treat_coef"), F.sqrt(sandwich("i_tt", "i_tx")).alias("treat_se"),
        F.col("b_x").alias("length_coef"), F.sqrt(sandwich("i_tx", "i_xx")).alias("length_se"),
    )
    critical = F.lit(1.959963984540054)
    return fitted.select(
        "*",
        (F.col("treat_coef") - critical * F.col("treat_se")).alias("treat_ci_low"),
        (F.col("treat_coef") + critical * F.col("treat_se")).alias("treat_ci_high"),
    )


def with_p_values(fit: DataFrame) -> DataFrame:
    """Normal-approximation p-values of both coefficients."""
    root2 = math.sqrt(2.0)
    return fit.select(
        "*",
        erfc(F.abs(F.col("treat_coef") / F.col("treat_se")) / F.lit(root2)).alias("treat_p_value"),
        erfc(F.abs(F.col("length_coef") / F.col("length_se")) / F.lit(root2)).alias("length_p_value"),
    )
