"""Findings of the fourth round: the schedule is shuffled once, without its keys, and has the rows it had before."""

from __future__ import annotations

import hashlib
import os

import pytest
from gridlens import protocol as P
from gridlens.operators import distributed, grid
from gridlens.plans import catalog
from pyspark.sql import functions as F


def _sha(*parts):
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()


def _expected(questions, models):
    cells = [_sha("cell-v2", q, m, c) for q in questions for m in models for c in P.CONDITION_IDS]
    return list(enumerate(sorted(cells, key=lambda cell: (_sha("sha256-balanced-cell-order-v1", cell), cell))))


def _parts(spark, tmp_path, keys):
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")


def _files(spark):
    context = spark.sparkContext
    kept = context._jsc.sc().getCheckpointDir()
    folders = [kept.get().removeprefix("file:")] if kept.isDefined() else []
    return {os.path.join(at, f) for folder in folders for at, _, names in os.walk(folder) for f in names}


def test_the_schedule_is_shuffled_without_keys_and_not_stored(spark, tmp_path):
    _parts(spark, tmp_path, range(60))
    before = _files(spark)
    found = catalog.QUERIES["schedule_order"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Scan ExistingRDD" not in plan and plan.count("Exchange ") == 2
    # What lies below the exchange over the cells names them; both keys are made above it.
    sent = plan.split("Exchange ")[1].splitlines()[1].partition("[")[2]
    assert sent.startswith("question_id") and "AS cell_id" not in sent and "AS schedule_key" not in sent
    assert found.count() == 60 * 56 and _files(spark) <= before


@pytest.mark.parametrize("rows", [97, 1_000_000])
def test_the_schedule_of_repeated_questions_is_whole(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(distributed, "_SLICE_ROWS", rows, raising=False)
    keys = [*range(40), 7, 7, 23, -5]
    _parts(spark, tmp_path, keys)
    found = catalog.QUERIES["schedule_order"](spark, str(tmp_path)).collect()
    assert sorted((r["schedule_index"], r["cell_id"]) for r in found) == _expected(
        map(str, keys), [f"m{i}" for i in range(7)])


def test_slices_are_no_more_than_leading_digits_tell_apart(spark, monkeypatch):
    monkeypatch.setattr(distributed, "_SLICE_ROWS", 3)
    monkeypatch.setattr(distributed, "_DIGITS", 1)
    questions = spark.range(25).select(F.col("id").cast("string").alias("question_id"), "id")
    cells = grid.expand(questions, ["a", "b"], keep=["id"]).drop("cell_id", "schedule_key")
    numbered = grid.schedule(cells)
    assert numbered.rdd.getNumPartitions() == 16
    rows = numbered.collect()
    assert sorted((r["schedule_index"], r["cell_id"]) for r in rows) == _expected(map(str, range(25)), ["a", "b"])
    assert all(r["cell_id"] == _sha("cell-v2", str(r["id"]), r["model_id"], r["condition_id"]) for r in rows)
    assert grid.schedule(cells.limit(0)).collect() == []


def test_cells_without_an_id_come_first_and_given_keys_are_kept(spark):
    questions = spark.createDataFrame([("a",), (None,), ("b",), (None,)], "question_id string")
    expanded = grid.expand(questions, ["m"])
    want = sorted((r["schedule_index"], r["cell_id"] or "") for r in grid.schedule(expanded).collect())
    found = grid.schedule(expanded.drop("cell_id", "schedule_key"))
    assert sorted((r["schedule_index"], r["cell_id"] or "") for r in found.collect()) == want
    assert [cell for _, cell in want[:16]] == [""] * 16 and all(cell for _, cell in want[16:])
    given = spark.createDataFrame([("x", "k2"), ("y", "k1"), ("z", None)], "cell_id string, schedule_key string")
    assert {r["cell_id"]: r["schedule_index"] for r in grid.schedule(given).collect()} == {"z": 0, "y": 1, "x": 2}
