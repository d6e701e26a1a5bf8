"""Paths outside the registered queries: incremental judging, streams over many files, row numbers, odd characters."""

from __future__ import annotations

import json

import pytest
from gridlens.__main__ import main
from gridlens.operators import ledger
from gridlens.operators.sections import recover
from gridlens.plans import catalog
from gridlens.session import child_numbers
from gridlens.sources import questions as Q
from gridlens.sources import sinks
from gridlens.streaming import events as E
from pyspark.sql import functions as F

STEMS = ["A patient has fever and a stiff neck. Which test is next?", "A child coughs at night. What is the most likely cause?"]


@pytest.fixture(scope="module")
def workspace(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("work")
    rows = [{"id": f"q{i}", "dataset": "d", "question": s, "options": {"A": "first", "B": "second"}, "answer": "A"} for i, s in enumerate(STEMS)]
    (root / "questions.jsonl").write_text("\n".join(map(json.dumps, rows)))
    years = ",".join(str(y) for y in range(2010, 2020))
    (root / "words.csv").write_text(f"word,{years}\n," + ",".join(["100"] * 10) + "\nfever," + ",".join(["2"] * 10) + "\n")
    main(["prepare", str(root), str(root / "questions.jsonl"), "--models", "m0"])
    return root


def respond(spark, root, suffix):
    cells = spark.read.parquet(f"{root}/state/cells")
    text = F.concat(F.lit("8. Final answer\nOption A"), F.when(F.col("condition_id") == "zero", suffix).otherwise(""))
    cells.select("cell_id", "question_id", "model_id", "condition_id", F.lit("completed").alias("status"), text.alias("content")).write.mode(
        "overwrite").parquet(f"{root}/state/responses")


def test_incremental_judging(spark, workspace):
    target = f"{workspace}/results/judgments"
    respond(spark, workspace, " it is.")
    main(["judge", str(workspace), str(workspace / "words.csv"), "--incremental"])
    first = {r.cell_id: r.content_hash for r in sinks.latest(spark, target).collect()}
    assert len(first) == 16
    respond(spark, workspace, " it is not.")
    main(["judge", str(workspace), str(workspace / "words.csv"), "--incremental"])
    second = {r.cell_id: r.content_hash for r in sinks.latest(spark, target).collect()}
    assert set(first) == set(second) and sum(first[c] != second[c] for c in first) == 2
    assert child_numbers(spark, target, "version-") == [1, 2]


def test_stale_cells(spark):
    from gridlens.functions import keys

    cells = spark.createDataFrame([("a", "completed", "x"), ("b", "completed", "y"), ("c", "failed", None), ("d", "completed", "z")],
                                  "cell_id string, status string, content string")
    known = cells.filter("cell_id <> 'd'").select("cell_id", keys.content_key(F.col("status"), F.col("content")).alias("content_hash"),
                                                  F.when(F.col("cell_id") == "b", "0").otherwise("1").alias("v"))
    changed = cells.withColumn("content", F.when(F.col("cell_id") == "a", "new").otherwise(F.col("content"))).withColumn("content_hash", F.lit("clash"))
    assert {r.cell_id for r in ledger.stale_cells(changed, known, {"v": "1"}).collect()} == {"a", "b", "d"}


def test_control_characters_are_no_marks(spark):
    text = "1. Facts\nFever.\x01x\x02 \x03 8. Final answer\nOption B"
    frame = spark.createDataFrame([("c", text, [{"label": "A", "text": "one"}, {"label": "B", "text": "two"}])],
                                  "cell_id string, content string, choices array<struct<label:string,text:string>>")
    frame = frame.select("*", F.lit("A").alias("gold"), F.lit("completed").alias("status"), F.lit("stem").alias("stem"),
                         F.lit("system").alias("condition_id"), F.lit("q").alias("question_id"))
    assert recover(frame).count() == 1


def test_streams_over_folders(spark, data, tmp_path):
    spark.read.parquet(f"{data}/events.parquet").repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("stream_cell_state", "stream_throughput"):
        whole = sorted(map(str, catalog.QUERIES[name](spark, data).collect()))
        assert whole and sorted(map(str, catalog.QUERIES[name](spark, str(tmp_path)).collect())) == whole


def test_streams_go_on_after_a_restart(spark, tmp_path):
    source, state = str(tmp_path / "events.parquet"), str(tmp_path / "state")
    fold = lambda before, batch: batch if before is None else before.unionByName(batch)
    for run in (1, 2):
        spark.range(run * 10, run * 10 + 5).write.mode("append").parquet(source)
        table = E.VersionedTable(spark, "t", state)
        found = E.fold_stream(E.read_events(spark, str(tmp_path), files_per_batch=2), table, fold)
        assert found.count() == 5 * run
    assert len(table.batches()) <= 2
    spark.createDataFrame([], "id long").write.parquet(str(tmp_path / "none.parquet"))
    assert E.fold_stream(E.read_events(spark, str(tmp_path), "none"), E.VersionedTable(spark, "n"), fold).count() == 0


@pytest.mark.parametrize("row,reason", [
    ({"question": "The following figure is typical."}, "media dependent"), ({"question": "Based on this radiograph, what is next?"}, "media dependent"),
    ({"question": "What does the table show?"}, "media dependent"), ({"question": "As shown above, what is next?"}, "media dependent"),
    ({"question": "Plain?", "tables": "x"}, "media dependent"), ({"question": "Plain?", "figures": ["f"]}, "media dependent"),
    ({"question": "Which image quality matters?"}, None), ({"question": "Plain?", "image_url": "u"}, None)])
def test_media_rule(spark, tmp_path, row, reason):
    (tmp_path / "q.jsonl").write_text(json.dumps({"options": {"A": "x", "B": "y"}, "answer": "A", **row}))
    found = Q.normalize_questions(Q.read_raw_questions(spark, str(tmp_path / "q.jsonl")), F.lit("d"), F.lit("test")).first()
    assert found.reject_reason == reason


def test_row_numbers_follow_the_files(spark, tmp_path):
    for name, lines in (("a", 3), ("b", 400), ("c", 2)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(json.dumps({"question": f"{name}{i}"}) for i in range(lines)) + "\n\n")
    rows = Q.read_raw_questions(spark, str(tmp_path)).select("row_index", F.try_variant_get("raw", "$.question", "string").alias("q")).collect()
    expected = [f"a{i}" for i in range(3)] + [f"b{i}" for i in range(400)] + ["c0", "c1"]
    assert [r.q for r in sorted(rows, key=lambda r: r.row_index)] == expected and {r.row_index for r in rows} == set(range(405))
