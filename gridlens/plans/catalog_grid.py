"""Queries over the cell grid: contrasts, factorials, residuals, regressions and status tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlens import protocol as P
from gridlens.operators import multiplicity, regression, resample, units
from gridlens.operators.distributed import materialize
from gridlens.plans import contrasts as C
from gridlens.plans.adapters import CELLS_SQL, grid_cells
from gridlens.plans.registry import query
from gridlens.operators.units import Spec

OUTCOMES = ("recall", "tokens", "accuracy", "commitment_itt")
ABSENT = ("recall",)
# The outcome tuples of the line-item grid in the shape of the full analysis: every family, over the measures that the
# grid has.
GRID_OUTCOMES = C.Outcomes(
    primary=("recall", "commitment_itt"), key_secondary=("recall", "commitment_itt", "accuracy"), roles=("recall", "tokens"),
    length=("tokens", "output_tokens"), exploratory=("recall", "tokens", "commitment_observed"), complexity=("recall", "tokens"),
    factorial=("recall", "tokens", "accuracy"), zero_absent=ABSENT,
)


def _round(column: str, digits: int = 6):
    return F.round(F.col(column), digits).alias(column)


def _contrast_columns(frame, *keys):
    return frame.select(*keys, "outcome", _round("treatment_mean"), _round("control_mean"), _round("effect"),
                        "question_clusters", "incomplete_units")


def _names(items):
    return ", ".join(f"'{i}'" for i in items)


def paired_sql(treatment, control, *, group="", where="", outcomes=OUTCOMES):
    """SQL for one paired comparison with its own completeness rule."""
    needed = len(treatment) + len(control)
    keys = f"{group}, " if group else ""
    return f"""WITH {CELLS_SQL},
long AS (
  UNPIVOT (SELECT question_id, model_id, condition_id, dataset, fact_complexity, {', '.join(outcomes)}
           FROM cells WHERE true {where})
  ON {', '.join(outcomes)} INTO NAME outcome VALUE value),
unit AS (
  SELECT {keys}outcome, question_id, model_id,
         avg(value) FILTER (WHERE condition_id IN ({_names(treatment)})) AS t,
         avg(value) FILTER (WHERE condition_id IN ({_names(control)})) AS c,
         count(*) FILTER (WHERE condition_id IN ({_names(treatment + control)})) AS have
  FROM long GROUP BY ALL),
question AS (
  SELECT {keys}outcome, question_id, avg(t) FILTER (WHERE have = {needed}) AS t,
         avg(c) FILTER (WHERE have = {needed}) AS c,
         count(*) FILTER (WHERE have < {needed}) AS incomplete
  FROM unit GROUP BY ALL)
SELECT {keys}outcome, round(avg(t), 6) AS treatment_mean, round(avg(c), 6) AS control_mean,
       round(avg(t - c), 6) AS effect, count(t) AS question_clusters, sum(incomplete)::BIGINT AS incomplete_units
FROM question GROUP BY ALL"""


def _paired(spark, folder, treatment, control, *, group=None, usable_only=False, groups=()):
    spec = Spec("contrast", OUTCOMES, treatment, control, group=group, usable_only=usable_only, groups=groups)
    summary = units.contrast_summary(units.question_differences(grid_cells(spark, folder), [spec]))
    if group:
        return _contrast_columns(summary.withColumnRenamed("group_value", group), group)
    return _contrast_columns(summary)


@query("paired_contrast_itt", paired_sql(P.DOUBLE, P.SINGLE))
def paired_contrast_itt(spark, folder):
    return _paired(spark, folder, P.DOUBLE, P.SINGLE)


@query("paired_contrast_per_protocol", paired_sql(P.DOUBLE, P.SINGLE, where="AND generation_usable"))
def paired_contrast_per_protocol(spark, folder):
    return _paired(spark, folder, P.DOUBLE, P.SINGLE, usable_only=True)


@query("paired_contrast_trailing", paired_sql(P.TRAILING_TREATMENT, P.TRAILING_CONTROL))
def paired_contrast_trailing(spark, folder):
    return _paired(spark, folder, P.TRAILING_TREATMENT, P.TRAILING_CONTROL)


@query("paired_contrast_one_copy", paired_sql(P.AFTER_ONLY, P.CONVENTIONAL))
def paired_contrast_one_copy(spark, folder):
    return _paired(spark, folder, P.AFTER_ONLY, P.CONVENTIONAL)


@query("paired_contrast_by_model", paired_sql(P.DOUBLE, P.SINGLE, group="model_id"))
def paired_contrast_by_model(spark, folder):
    return _paired(spark, folder, P.DOUBLE, P.SINGLE, group="model_id")


@query("paired_contrast_by_dataset", paired_sql(P.DOUBLE, P.SINGLE, group="dataset"))
def paired_contrast_by_dataset(spark, folder):
    return _paired(spark, folder, P.DOUBLE, P.SINGLE, group="dataset")


@query("paired_contrast_by_complexity",
       paired_sql(P.DOUBLE, P.SINGLE, group="fact_complexity", where="AND fact_complexity <> 'inapplicable'"))
def paired_contrast_by_complexity(spark, folder):
    return _paired(spark, folder, P.DOUBLE, P.SINGLE, group="fact_complexity", groups=C.COMPLEXITY_GROUPS)


@query("unit_pivot", f"""WITH {CELLS_SQL}
SELECT question_id, model_id, """ + ", ".join(
    f"round(max(recall) FILTER (WHERE condition_id = '{c}'), 6) AS {c}" for c in P.CONDITION_IDS) + """
FROM cells WHERE recall IS NOT NULL GROUP BY ALL""")
def unit_pivot(spark, folder):
    long = units.long_outcomes(grid_cells(spark, folder), ["recall"], ["question_id", "model_id", "condition_id"])
    wide = units.unit_pivot(long, ["question_id", "model_id"])
    return wide.select("question_id", "model_id", *[_round(c) for c in P.CONDITION_IDS])


_SIGNS = "\nUNION ALL\n".join(
    f"SELECT {i} AS term_ord, '{' x '.join(t)}' AS term, [" +
    ", ".join(str(P.term_sign(c, t)) for c in P.CONDITION_IDS) + "] AS signs"
    for i, t in enumerate(P.FACTORIAL_TERMS))


@query("factorial_terms", f"""WITH {CELLS_SQL},
filled AS (
  SELECT question_id, model_id, condition_id,
         coalesce(recall, CASE WHEN condition_id = 'zero' THEN 0.0 END) AS recall, accuracy FROM cells),
long AS (UNPIVOT filled ON recall, accuracy INTO NAME outcome VALUE value),
terms AS ({_SIGNS}),
signed AS (
  SELECT term, outcome, question_id, model_id, value,
         signs[list_position([{_names(P.CONDITION_IDS)}], condition_id)] AS sign
  FROM long, terms),
unit AS (
  SELECT term, outcome, question_id, model_id, avg(value) FILTER (WHERE sign > 0) AS hi,
         avg(value) FILTER (WHERE sign < 0) AS lo, count(*) AS have FROM signed GROUP BY ALL),
question AS (
  SELECT term, outcome, question_id, avg(hi) FILTER (WHERE have = 8) AS hi, avg(lo) FILTER (WHERE have = 8) AS lo,
         count(*) FILTER (WHERE have < 8) AS incomplete FROM unit GROUP BY ALL)
SELECT term, outcome, round(avg(hi), 6) AS treatment_mean, round(avg(lo), 6) AS control_mean,
       round(avg(hi - lo), 6) AS effect, count(hi) AS question_clusters, sum(incomplete)::BIGINT AS incomplete_units
FROM question GROUP BY ALL""")
def factorial_terms(spark, folder):
    specs = [Spec("factorial", ("recall", "accuracy"), term=t) for t in P.FACTORIAL_TERMS]
    differences = units.question_differences(grid_cells(spark, folder), specs, zero_absent=ABSENT)
    return _contrast_columns(units.contrast_summary(differences), "term")


@query("condition_means_long", f"""WITH {CELLS_SQL},
long AS (UNPIVOT (SELECT condition_id, {', '.join(OUTCOMES)} FROM cells) ON {', '.join(OUTCOMES)}
         INTO NAME outcome VALUE value)
SELECT condition_id, outcome, round(avg(value), 6) AS mean, count(*) AS n FROM long GROUP BY ALL""")
def condition_means_long(spark, folder):
    means = units.condition_means(grid_cells(spark, folder), OUTCOMES)
    return means.select("condition_id", "outcome", _round("mean"), "n")


@query("sample_summary", f"""WITH {CELLS_SQL}
SELECT count(DISTINCT model_id) AS models, count(DISTINCT dataset) AS datasets,
       count(DISTINCT question_id) AS questions, count(*) AS cells,
       count(*) FILTER (WHERE generation_usable) AS usable_cells FROM cells""")
def sample_summary(spark, folder):
    return units.sample_summary(grid_cells(spark, folder))


@query("status_counts", f"WITH {CELLS_SQL} SELECT status, count(*) AS n FROM cells GROUP BY 1")
def status_counts(spark, folder):
    return units.status_counts(grid_cells(spark, folder))


@query("condition_table", f"""WITH {CELLS_SQL}
SELECT condition_id, count(*) AS n_scheduled, count(*) FILTER (WHERE status = 'completed') AS completed,
       count(*) FILTER (WHERE status = 'truncated') AS truncated, count(*) FILTER (WHERE status = 'failed') AS failed,
       round(avg(coalesce(output_tokens, 0)), 6) AS mean_output_tokens, round(avg(recall), 6) AS recall,
       count(recall) AS recall_n, round(avg(accuracy), 6) AS accuracy, count(accuracy) AS accuracy_n
FROM cells GROUP BY 1""")
def condition_table(spark, folder):
    frame = units.condition_table(grid_cells(spark, folder), ("recall", "accuracy"))
    return frame.select("condition_id", "n_scheduled", "completed", "truncated", "failed",
                        _round("mean_output_tokens"), _round("recall"), "recall_n", _round("accuracy"), "accuracy_n")


@query("status_by_copies", f"""WITH {CELLS_SQL}
SELECT CASE condition_id WHEN 'zero' THEN 0 WHEN 'system_before_after' THEN 3
            ELSE CASE WHEN condition_id LIKE '%\\_%' ESCAPE '\\' THEN 2 ELSE 1 END END AS copies,
       count(*) AS n, count(*) FILTER (WHERE status = 'completed') AS completed,
       count(*) FILTER (WHERE status = 'truncated') AS truncated, count(*) FILTER (WHERE status = 'failed') AS failed
FROM cells GROUP BY 1""")
def status_by_copies(spark, folder):
    return units.status_by_copies(grid_cells(spark, folder))


@query("paired_status", f"""WITH {CELLS_SQL},
flags AS (
  SELECT question_id, model_id, condition_id, (status = 'truncated')::INT::DOUBLE AS is_truncated,
         (status = 'failed')::INT::DOUBLE AS is_failed, (status <> 'completed')::INT::DOUBLE AS not_completed
  FROM cells WHERE condition_id NOT IN ('zero', 'system_before_after')),
long AS (UNPIVOT flags ON is_truncated, is_failed, not_completed INTO NAME outcome VALUE value),
unit AS (
  SELECT outcome, question_id, model_id, count(*) AS have,
         avg(value) FILTER (WHERE condition_id IN ({_names(P.DOUBLE)}))
           - avg(value) FILTER (WHERE condition_id IN ({_names(P.SINGLE)})) AS diff FROM long GROUP BY ALL),
question AS (SELECT outcome, question_id, avg(diff) AS diff FROM unit WHERE have = 6 GROUP BY ALL)
SELECT outcome, round(avg(diff), 6) AS effect, count(*) AS question_clusters FROM question GROUP BY 1""")
def paired_status(spark, folder):
    flags = units.status_indicators(grid_cells(spark, folder))
    spec = Spec("status", ("is_truncated", "is_failed", "not_completed"), P.DOUBLE, P.SINGLE)
    summary = units.contrast_summary(units.question_differences(flags, [spec]))
    return summary.select("outcome", _round("effect"), "question_clusters")


@query("accuracy_rollup", f"""WITH {CELLS_SQL},
counted AS (
  SELECT CASE WHEN condition_id IN ({_names(P.SINGLE)}) THEN 'one_copy'
              WHEN condition_id IN ({_names(P.DOUBLE)}) THEN 'two_copy' END AS copy_group, condition_id, accuracy
  FROM cells)
SELECT copy_group, condition_id, sum(accuracy)::BIGINT AS correct, count(*) AS scheduled
FROM counted WHERE copy_group IS NOT NULL GROUP BY ROLLUP (copy_group, condition_id)""")
def accuracy_rollup(spark, folder):
    return units.accuracy_rollup(grid_cells(spark, folder))


_RESIDUAL_ROWS = "\nUNION ALL\n".join(
    f"SELECT '{target}' AS target_condition, question_id, {target} AS observed, "
    f"{' + '.join(singles)} - {len(singles) - 1} * zero AS predicted FROM unit"
    for target, singles in P.ADDITIVE_TARGETS.items())


@query("additive_residuals", f"""WITH {CELLS_SQL},
filled AS (SELECT question_id, model_id, condition_id,
                  coalesce(recall, CASE WHEN condition_id = 'zero' THEN 0.0 END) AS recall FROM cells),
unit AS (SELECT question_id, model_id, {', '.join(
    f"max(recall) FILTER (WHERE condition_id = '{c}') AS {c}" for c in P.CONDITION_IDS)}
  FROM filled GROUP BY ALL),
rows AS ({_RESIDUAL_ROWS}),
question AS (
  SELECT target_condition, question_id, avg(observed) AS observed, avg(predicted) AS predicted,
         avg(observed - predicted) AS diff
  FROM rows WHERE observed IS NOT NULL AND predicted IS NOT NULL GROUP BY ALL)
SELECT target_condition, round(avg(observed), 6) AS observed_mean, round(avg(predicted), 6) AS predicted_mean,
       round(avg(diff), 6) AS residual, count(*) AS question_clusters FROM question GROUP BY 1""")
def additive_residuals(spark, folder):
    residuals = units.additive_residuals(grid_cells(spark, folder), ["recall"], zero_absent=ABSENT)
    summary = units.residual_summary(residuals)
    return summary.select("target_condition", _round("observed_mean"), _round("predicted_mean"), _round("residual"),
                          "question_clusters")


def _fit_sql(source: str, unit: str) -> str:
    return f"""WITH {CELLS_SQL},
obs AS ({source}),
dm AS (
  SELECT *, t - avg(t) OVER w AS dt, x - avg(x) OVER w AS dx, y - avg(y) OVER w AS dy
  FROM obs WINDOW w AS (PARTITION BY {unit})),
s AS (SELECT sum(dt*dt) AS tt, sum(dt*dx) AS tx, sum(dx*dx) AS xx, sum(dt*dy) AS ty, sum(dx*dy) AS xy FROM dm),
b AS (SELECT (xx*ty - tx*xy) / (tt*xx - tx*tx) AS bt, (tt*xy - tx*ty) / (tt*xx - tx*tx) AS bx,
             xx / (tt*xx - tx*tx) AS itt, -tx / (tt*xx - tx*tx) AS itx, tt / (tt*xx - tx*tx) AS ixx FROM s),
score AS (SELECT question_id, sum(dt * (dy - bt*dt - bx*dx)) AS u, sum(dx * (dy - bt*dt - bx*dx)) AS v
          FROM dm, b GROUP BY 1),
meat AS (SELECT sum(u*u) AS uu, sum(u*v) AS uv, sum(v*v) AS vv FROM score),
size AS (SELECT count(*) AS n, count(DISTINCT ({unit})) AS f, count(DISTINCT question_id) AS g,
                avg(y) FILTER (WHERE t = 0) AS y0, avg(y) FILTER (WHERE t = 1) AS y1,
                avg(x) FILTER (WHERE t = 0) AS x0, avg(x) FILTER (WHERE t = 1) AS x1 FROM obs)
SELECT n AS n_cells, f AS fixed_effects, g AS clusters, round(y0, 6) AS control_outcome,
       round(y1, 6) AS treated_outcome, round(x0, 6) AS control_length, round(x1, 6) AS treated_length,
       round(bt, 6) AS treat_coef, round(bx, 6) AS length_coef,
       round(sqrt(g / (g - 1) * (n - 1) / (n - 2) * (itt*itt*uu + 2*itt*itx*uv + itx*itx*vv)), 6) AS treat_se,
       round(sqrt(g / (g - 1) * (n - 1) / (n - 2) * (itx*itx*uu + 2*itx*ixx*uv + ixx*ixx*vv)), 6) AS length_se
FROM size, b, meat"""


def _fit_columns(fit):
    return fit.select("n_cells", "fixed_effects", "clusters", *[_round(c) for c in (
        "control_outcome", "treated_outcome", "control_length", "treated_length", "treat_coef", "length_coef",
        "treat_se", "length_se")])


@query("fe_ols_length", _fit_sql(
    f"""SELECT question_id, model_id, (condition_id IN ({_names(P.DOUBLE)}))::INT::DOUBLE AS t, recall AS y, tokens AS x
  FROM cells WHERE condition_id IN ({_names(P.SINGLE + P.DOUBLE)}) AND recall IS NOT NULL AND tokens IS NOT NULL""",
    "question_id, model_id"))
def fe_ols_length(spark, folder):
    return _fit_columns(regression.fixed_effect_fit(length_rows(spark, folder), ["question_id", "model_id"], "question_id"))


def length_rows(spark, folder):
    cells = grid_cells(spark, folder).filter(F.col("condition_id").isin(list(P.SINGLE + P.DOUBLE)))
    return cells.filter("recall is not null and tokens is not null").select(
        "question_id", "model_id", F.col("condition_id").isin(list(P.DOUBLE)).cast("double").alias("t"),
        F.col("recall").alias("y"), F.col("tokens").alias("x"))


@query("fe_ols_pairs", _fit_sql(
    """SELECT question_id, model_id, CASE WHEN condition_id IN ('system', 'system_after') THEN 0 ELSE 1 END AS pair_id,
         (condition_id IN ('system_after', 'before_after'))::INT::DOUBLE AS t, recall AS y, tokens AS x
  FROM cells WHERE condition_id IN ('system', 'system_after', 'before', 'before_after')
    AND recall IS NOT NULL AND tokens IS NOT NULL""", "question_id, model_id, pair_id"))
def fe_ols_pairs(spark, folder):
    cells = grid_cells(spark, folder).filter("recall is not null and tokens is not null")
    pair = (F.when(F.col("condition_id").isin("system", "system_after"), 0)
            .when(F.col("condition_id").isin("before", "before_after"), 1))
    rows = cells.select(
        "question_id", "model_id", pair.alias("pair_id"),
        F.col("condition_id").isin("system_after", "before_after").cast("double").alias("t"),
        F.col("recall").alias("y"), F.col("tokens").alias("x")).filter("pair_id is not null")
    fit = regression.fixed_effect_fit(rows, ["question_id", "model_id", "pair_id"], "question_id")
    return _fit_columns(fit)


@query("fe_ols_p_values")
def fe_ols_p_values(spark, folder):
    fit = regression.fixed_effect_fit(length_rows(spark, folder), ["question_id", "model_id"], "question_id")
    return regression.with_p_values(fit)


_EFFECTS_BY_MODEL = paired_sql(P.DOUBLE, P.SINGLE, group="model_id")


def _model_effects(spark, folder):
    return _paired(spark, folder, P.DOUBLE, P.SINGLE, group="model_id")


@query("benefit_rank", f"""WITH e AS ({_EFFECTS_BY_MODEL})
SELECT outcome, model_id, effect, row_number() OVER (PARTITION BY outcome ORDER BY
  CASE WHEN outcome = 'commitment_itt' THEN -effect ELSE effect END DESC, model_id) AS benefit_rank
FROM e WHERE effect IS NOT NULL""")
def benefit_rank(spark, folder):
    ranked = units.benefit_ranks(_model_effects(spark, folder), ["commitment_itt"])
    return ranked.select("outcome", "model_id", "effect", "benefit_rank")


@query("best_worst_model", f"""WITH e AS ({_EFFECTS_BY_MODEL}),
r AS (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY
        CASE WHEN outcome = 'commitment_itt' THEN -effect ELSE effect END DESC, model_id) AS k,
        count(*) OVER (PARTITION BY outcome) AS m FROM e WHERE effect IS NOT NULL)
SELECT outcome, max(model_id) FILTER (WHERE k = 1) AS best_model, max(effect) FILTER (WHERE k = 1) AS best_effect,
       max(model_id) FILTER (WHERE k = m) AS worst_model, max(effect) FILTER (WHERE k = m) AS worst_effect
FROM r GROUP BY 1""")
def best_worst_model(spark, folder):
    ranked = units.benefit_ranks(_model_effects(spark, folder), ["commitment_itt"])
    return ranked.groupBy("outcome").agg(
        F.min_by("model_id", "benefit_rank").alias("best_model"), F.min_by("effect", "benefit_rank").alias("best_effect"),
        F.max_by("model_id", "benefit_rank").alias("worst_model"),
        F.max_by("effect", "benefit_rank").alias("worst_effect"))


@query("effect_matrix", f"""WITH e AS ({_EFFECTS_BY_MODEL})
SELECT outcome, {', '.join(f"max(effect) FILTER (WHERE model_id = 'm{i}') AS m{i}" for i in range(7))}
FROM e GROUP BY 1""")
def effect_matrix(spark, folder):
    return units.effect_matrix(_model_effects(spark, folder), [f"m{i}" for i in range(7)])


# A p-like value per contrast, so that the adjustment itself can be checked in SQL.
_PSEUDO = "round(abs(effect) / (abs(effect) + abs(treatment_mean) / question_clusters), 6)"


@query("holm_family", f"""WITH e AS ({_EFFECTS_BY_MODEL}),
p AS (SELECT outcome, model_id, {_PSEUDO} AS p_value FROM e),
r AS (SELECT *, row_number() OVER (ORDER BY p_value, outcome, model_id) AS k, count(*) OVER () AS m FROM p)
SELECT outcome, model_id, p_value, least(1.0, round(max((m - k + 1) * p_value) OVER (ORDER BY k), 6)) AS holm_p_value
FROM r""")
def holm_family(spark, folder):
    tests = _model_effects(spark, folder).selectExpr("outcome", "model_id", f"{_PSEUDO} AS p_value", "'all' AS family")
    return multiplicity.holm(tests, ["family"], ["outcome", "model_id"]).select(
        "outcome", "model_id", "p_value", _round("holm_p_value"))


@query("holm_within_outcome", f"""WITH e AS ({_EFFECTS_BY_MODEL}),
p AS (SELECT outcome, model_id, {_PSEUDO} AS p_value FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY p_value, model_id) AS k,
             count(*) OVER (PARTITION BY outcome) AS m FROM p)
SELECT outcome, model_id, p_value,
       least(1.0, round(max((m - k + 1) * p_value) OVER (PARTITION BY outcome ORDER BY k), 6)) AS holm_p_value FROM r""")
def holm_within_outcome(spark, folder):
    tests = _model_effects(spark, folder).selectExpr("outcome", "model_id", f"{_PSEUDO} AS p_value")
    return multiplicity.holm(tests, ["outcome"], ["model_id"]).select(
        "outcome", "model_id", "p_value", _round("holm_p_value"))


@query("sign_flip_exact", """WITH cell AS (
  SELECT l_partkey % 12 AS q, l_suppkey % 7 AS m, l_orderkey % 8 AS c, avg(l_discount) AS v
  FROM lineitem GROUP BY 1, 2, 3),
unit AS (SELECT q, m, avg(v) FILTER (WHERE c BETWEEN 4 AND 6) - avg(v) FILTER (WHERE c BETWEEN 1 AND 3) AS d
         FROM cell WHERE c BETWEEN 1 AND 6 GROUP BY 1, 2 HAVING count(*) = 6),
diff AS (SELECT q, avg(d) AS d FROM unit GROUP BY 1),
n AS (SELECT count(*) AS n, sum(d) AS total FROM diff),
flips AS (
  SELECT mask, sum(CASE WHEN (mask >> q) & 1 = 1 THEN d ELSE -d END) AS s
  FROM diff, (SELECT unnest(range(4096)) AS mask) GROUP BY 1)
SELECT round(any_value(total / n), 6) AS effect, any_value(n) AS question_clusters,
       count(*) FILTER (WHERE abs(s / n) >= abs(total / n) - 1e-12) / count(*) AS p_value FROM flips, n""")
def sign_flip_exact(spark, folder):
    """Twelve clusters, so all 4,096 sign assignments are enumerated."""
    from gridlens.plans.adapters import table

    cells = table(spark, folder, "lineitem").groupBy(
        (F.col("l_partkey") % 12).alias("q"), (F.col("l_suppkey") % 7).alias("m"), (F.col("l_orderkey") % 8).alias("c")
    ).agg(F.avg("l_discount").alias("value")).select(
        F.col("q").cast("string").alias("question_id"), F.col("m").cast("string").alias("model_id"),
        F.col("m").cast("int").alias("model_ord"),
        F.element_at(P.condition_array(), (F.col("c") + 1).cast("int")).alias("condition_id"), "value")
    spec = Spec("exact", ("value",), P.DOUBLE, P.SINGLE)
    differences = materialize(units.question_differences(cells, [spec]))
    seeds = differences.select(*resample.CONTRAST_KEYS).distinct().withColumn("seed", F.lit(0).cast("bigint"))
    drawn = resample.resample(differences, seeds, bootstraps=10, permutations=10).select("outcome", "p_value")
    return units.contrast_summary(differences).join(drawn, "outcome").select(
        _round("effect"), "question_clusters", "p_value")


@query("contrast_plan_analysis")
def contrast_plan_analysis(spark, folder):
    """Every declared contrast of the grid with intervals, sign-flip tests and Holm adjustment in one job."""
    cells = grid_cells(spark, folder)
    return C.build_analysis(cells, outcomes=GRID_OUTCOMES)


_PLAN_SQL_MODELS = paired_sql(P.DOUBLE, P.SINGLE, group="model_id", outcomes=("recall", "commitment_itt"))


@query("analysis_model_repetition", f"""WITH e AS ({_PLAN_SQL_MODELS})
SELECT outcome, model_id, treatment_mean, control_mean, effect, question_clusters, incomplete_units,
       30000 + 100 * (CASE outcome WHEN 'recall' THEN 0 ELSE 1 END) + 1000 * substr(model_id, 2)::BIGINT AS seed
FROM e""")
def analysis_model_repetition(spark, folder):
    """The model-level family as the full plan emits it, seeds included."""
    table = C.build_analysis(grid_cells(spark, folder), outcomes=GRID_OUTCOMES, with_resampling=False)
    chosen = table.filter("family = 'model_repetition'").withColumnRenamed("group_value", "model_id")
    return chosen.select("outcome", "model_id", _round("treatment_mean"), _round("control_mean"), _round("effect"),
                         "question_clusters", "incomplete_units", "seed")
