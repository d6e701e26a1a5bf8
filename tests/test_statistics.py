from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlens import protocol as P
from gridlens.operators import agreement, multiplicity, resample, units
from gridlens.plans import contrasts as C


def test_holm_known_values(spark):
    tests = spark.createDataFrame([("f", i, p) for i, p in enumerate([0.01, 0.04, 0.03, None])],
                                  "family string, i int, p_value double")
    rows = multiplicity.holm(tests, ["family"], ["i"]).orderBy("i").collect()
    assert [r["holm_p_value"] and round(r["holm_p_value"], 12) for r in rows] == [0.03, 0.06, 0.06, None]


def _cells(spark, values):
    rows = [(q, "m", c, "d", True, v) for (q, c), v in values.items()]
    return spark.createDataFrame(
        rows, "question_id string, model_id string, condition_id string, dataset string, generation_usable boolean, y double")


def test_failed_cell_lowers_the_treatment_mean(spark):
    values = {(q, c): 1.0 for q in ("q1", "q2") for c in P.SINGLE + P.DOUBLE}
    values["q2", "system_before"] = 0.0
    spec = units.Spec("x", ("y",), P.DOUBLE, P.SINGLE)
    row = units.contrast_summary(units.question_differences(_cells(spark, values), [spec])).first()
    assert row["treatment_mean"] == pytest.approx(5 / 6)
    assert row["question_clusters"] == 2 and row["incomplete_units"] == 0


def test_incomplete_and_absent_units(spark):
    values = {("q1", c): 1.0 for c in P.SINGLE + P.DOUBLE}
    values.update({("q2", c): 0.5 for c in P.SINGLE})
    values.update({("q3", c): None for c in P.SINGLE})
    spec = units.Spec("x", ("y",), P.DOUBLE, P.SINGLE)
    row = units.contrast_summary(units.question_differences(_cells(spark, values), [spec])).first()
    assert (row["question_clusters"], row["incomplete_units"]) == (1, 1)


def test_one_copy_effect(spark):
    values = {("q1", "after"): 1.0, ("q1", "system"): 0.5, ("q1", "before"): 0.5}
    spec = units.Spec("x", ("y",), P.AFTER_ONLY, P.CONVENTIONAL)
    assert units.contrast_summary(units.question_differences(_cells(spark, values), [spec])).first()["effect"] == 0.5


def test_full_plan_size_and_seeds():
    plan = C.contrast_plan()
    groups = {"model_id": [f"m{i}" for i in range(7)], "dataset": ["a", "b", "c"]}
    assert C.work_units(plan, groups) == 720
    by_family = {s.family: s for s in plan}
    assert by_family["primary"].seed_base == 13_000 and by_family["model_additional"].seed_base == 45_000
    assert len(C.Outcomes().additional) == 48


def test_term_signs():
    for term in P.FACTORIAL_TERMS:
        assert sum(P.term_sign(c, term) for c in P.CONDITION_IDS) == 0


def test_exact_sign_flip_against_enumeration():
    values = np.array([0.3, -0.1, 0.2, 0.4, 0.05])
    observed = abs(values.mean())
    hits = sum(abs(np.dot(s, values)) / 5 >= observed - 1e-15 for s in itertools.product((-1, 1), repeat=5))
    assert resample.sign_flip_p(values, 100, 0) == hits / 32
    assert resample.sign_flip_p(np.zeros(4), 100, 0) == 1.0


def test_draws_do_not_depend_on_the_step():
    values = np.random.default_rng(3).normal(size=37)
    whole = np.random.default_rng(11)
    picks = np.concatenate([whole.integers(0, 37, size=(n, 37)) for n in (4096, 904)])
    assert np.array_equal(resample.bootstrap_draws(values, 5000, 11), values[picks].mean(axis=1))
    generator = np.random.default_rng(12)
    signs = np.concatenate([generator.integers(0, 2, size=(n, 37), dtype=np.int8) * 2 - 1 for n in (4096, 904)])
    assert np.allclose(resample._flip_sums(values, 5000, 12), signs @ values)


def _differences(spark, n):
    rng = np.random.default_rng(5)
    rows = [("f", "", None, "y", f"q{i:05d}", 0, float(v)) for i, v in enumerate(rng.normal(0.02, 1.0, size=n))]
    frame = spark.createDataFrame(
        rows, "family string, term string, group_value string, outcome string, question_id string, first_model int, diff double")
    return frame, np.array([r[-1] for r in rows])


def test_resampling_matches_the_plain_computation(spark):
    frame, values = _differences(spark, 200)
    seeds = spark.createDataFrame([("f", "", None, "y", 77)], "family string, term string, group_value string, outcome string, seed bigint")
    row = resample.resample(frame, seeds, bootstraps=400, permutations=800).first()
    low, high = resample.bootstrap_interval(values, 400, 78)
    assert (row["ci_low"], row["ci_high"]) == (low, high)
    assert row["p_value"] == resample.sign_flip_p(values, 800, 79)


def test_blocks_agree_with_the_whole(spark, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK", 64)
    frame, values = _differences(spark, 500)
    seeds = spark.createDataFrame([("f", "", None, "y", 77)], "family string, term string, group_value string, outcome string, seed bigint")
    row = resample.resample(frame, seeds, bootstraps=2000, permutations=4000).first()
    low, high = resample.bootstrap_interval(values, 2000, 78)
    assert row["ci_low"] == pytest.approx(low, abs=0.02) and row["ci_high"] == pytest.approx(high, abs=0.02)
    assert row["p_value"] == pytest.approx(resample.sign_flip_p(values, 4000, 79), abs=0.05)


def test_block_shares_add_up():
    sizes = np.array([5, 3, 7, 1, 4])
    shares = sum(resample._block_share(sizes, b, 50, 9) for b in range(5))
    assert np.array_equal(shares, np.full(50, 20))


def test_exact_design_known_answers():
    n, k, power = agreement.exact_design(0.80, 0.95, 0.05, 0.80)
    assert (n, k) == (30, 28) and power == pytest.approx(0.8122, abs=5e-5)
    assert agreement.binomial_upper_tail(30, 28, 0.8) == pytest.approx(0.04417898515199706)
    assert 0.80 < agreement.lower_bound(28, 30, 0.05) < 0.81
    assert agreement.lower_bound(10, 10, 0.05) == pytest.approx(0.05 ** 0.1)
    assert agreement.sign_test(10, 0) == (2.0 ** -10, pytest.approx(0.05 ** 0.1))


def test_complementary_error_function(spark):
    from gridlens.operators.regression import erfc

    row = spark.createDataFrame([(1.3,)], "x double").select(erfc(F.col("x"))).first()
    assert row[0] == math.erfc(1.3)
