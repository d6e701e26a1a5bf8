"""The blinded study: exact tests against plain sums, sheets with every kind of violation."""

from __future__ import annotations

from math import comb

import pytest
from pyspark.sql import functions as F

from gridlens.operators import study


def tail(n, k, p):
    return sum(comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k, n + 1))


@pytest.mark.parametrize("n,p", [(1, 0.5), (7, 0.3), (30, 0.5), (79, 0.8), (400, 0.05)])
def test_upper_tail_is_the_binomial_sum(n, p):
    for k in {0, 1, n // 3, n // 2, n - 1, n, n + 1}:
        assert study.upper_tail(n, k, p) == pytest.approx(tail(n, k, p), rel=1e-9, abs=1e-12)


def test_critical_count_and_lower_limit():
    assert study.critical_count(30, 0.5, 0.05) == next(k for k in range(31) if tail(30, k, 0.5) <= 0.05)
    assert study.critical_count(2, 0.5, 0.05) == 3
    assert study.lower_limit(10, 0, 0.05) == 0.0
    assert study.lower_limit(10, 10, 0.05) == pytest.approx(0.05 ** 0.1, abs=1e-9)
    low = study.lower_limit(30, 21, 0.05)
    assert tail(30, 21, low) == pytest.approx(0.05, abs=1e-9)
    assert 0.49 < study.lower_limit(10 ** 9, 5 * 10 ** 8, 0.05) < 0.5


def test_role_changes_and_tied_role(spark):
    frame = spark.createDataFrame([("p", 1.0, 0.0, None, 0.5, 1.0, 1.0)], "pair string, ca double, cb double, cc double, ta double, tb double, tc double")
    control, treatment = ({r: F.col(f"{side}{r}") for r in "abc"} for side in "ct")
    row = frame.select(study.role_changes(control, treatment).alias("r"),
                       study.tied_role(control, treatment, F.col("pair"), "s").alias("t")).first()
    assert [(r["role"], r["control_score"], r["treatment_score"]) for r in row["r"]] == [("a", 1.0, 0.5), ("b", 0.0, 1.0)]
    assert row["t"] is None


def test_stratum_needs_text_and_scores(spark):
    frame = spark.createDataFrame([(1, 0, 1, 1, True), (1, 1, 1, 0, True), (1, 0, 0, 1, True), (1, 0, 1, None, True), (1, 0, 1, 1, False)],
                                  "ca int, cb int, ta int, tb int, written boolean")
    found = frame.select(study.completion_stratum([F.col("ca"), F.col("cb")], [F.col("ta"), F.col("tb")], F.col("written"))).collect()
    assert [r[0] for r in found] == ["improvement", "degradation", "tie", None, None]


def test_sheets(spark):
    good = [("s1", "v", "a", "R1", "t1", "A"), ("s1", "v", "a", "R1", "t2", "cannot_tell")]
    bad = [("s2", "v", "a", "R1", "t1", "A"), ("s2", "v", "a", "R1", "t1", "B"), ("s3", "old", None, " ", "t1", None)]
    sheets = spark.createDataFrame(good + bad, "sheet_id string, version string, audit_id string, reviewer string, task_id string, rating string")
    found = {tuple(r) for r in study.sheet_violations(sheets, version="v", audit="a", tasks=2).collect()}
    assert found == {("s2", "t1", "task_rated_once"), ("s3", None, "version_known"), ("s3", None, "audit_matches"),
                     ("s3", None, "reviewer_named"), ("s3", None, "all_tasks_rated"), ("s3", "t1", "rating_allowed")}
    frozen = study.frozen_sheets(sheets, version="v", audit="a", tasks=2).collect()
    assert [(r["sheet_id"], r["n"]) for r in frozen] == [("s1", 2)]


def test_undecided_and_missing_answers(spark):
    key = spark.createDataFrame([(f"p{i}", "A") for i in range(4)] + [("p4", "same")], "pair_id string, preferred string")
    ratings = spark.createDataFrame([("p0", "A"), ("p1", "B"), ("p2", "cannot_tell"), ("p4", "same")], "pair_id string, rating string")
    rows = {r["pair_id"]: (r["confirmed"], r["opposite"]) for r in study.confirmations(key, ratings).collect()}
    assert rows == {"p0": (True, False), "p1": (False, True), "p2": (False, False), "p3": (None, False), "p4": (True, False)}


def test_hint_lines(spark):
    text = "1. x\r\n  6. What would change the answer  \n6) question " + "y" * 300
    frame = spark.createDataFrame([(text,), (None,)], "t string")
    rows = [r[0] for r in frame.select(study.hint_lines(F.col("t"), r"6[.)]")).collect()]
    assert rows[0][0] == "6. What would change the answer" and len(rows[0][1]) == 240 and rows[1] is None
