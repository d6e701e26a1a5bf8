from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from gridlens.sources import ledgers
from gridlens.sources import questions as Q


@pytest.mark.parametrize("question,options,required,stem,reason", [
    ("A patient has a finding. What is the diagnosis?\nAnswer Choices: (A) Alpha disease (B) Beta disease (C) Gamma disease",
     {"A": "Alpha disease", "B": "Beta disease", "C": "Gamma disease"}, True, "A patient has a finding. What is the diagnosis?", None),
    ("Question? Answer Choices: (A) Wrong text (B) Beta disease", {"A": "Alpha disease", "B": "Beta disease"}, True,
     "Question? Answer Choices: (A) Wrong text (B) Beta disease", "no block that mirrors the choices"),
    ("Question? Answer Choices: (A) Wrong text (B) Beta disease", {"A": "Alpha disease", "B": "Beta disease"}, False,
     "Question? Answer Choices: (A) Wrong text (B) Beta disease", None),
    ("First? Answer Choices: (A) x (B) y second? answer choices : (a) Élan! (b) b–c", {"A": "élan", "B": "B c"}, True,
     "First? Answer Choices: (A) x (B) y second?", None),
    ("Only Answer Choices: (A) vitamin (D) (B) y", {"A": "vitamin (D)", "B": "y"}, False, "Only Answer Choices: (A) vitamin (D) (B) y", None),
])
def test_choice_blocks(spark, question, options, required, stem, reason):
    raw = json.dumps({"id": "1", "question": question, "options": options, "answer_idx": "A"})
    frame = spark.createDataFrame([(raw, 0)], "raw string, row_index long").withColumn("raw", F.parse_json("raw"))
    found = Q.normalize_questions(frame, F.lit("d"), F.lit("test"), F.lit(required)).first()
    assert (found["stem"], found["reject_reason"]) == (stem, reason)


def test_ledgers_in_two_layouts_count_once(spark, tmp_path):
    row = lambda i, stem, **more: json.dumps({"id": f"d:{i}", "dataset": "d", "stem": stem, **more})
    first = [row(1, "One?"), row(2, "Two? Answer Choices: (A) x (B) y", choices={"A": "X", "B": "y"})]
    for place, lines in (("a/data", first), ("b/.instruction-duplication", first[::-1]), ("c", [row(1, "ONE"), row(3, "two"), row("", "")])):
        (tmp_path / place).mkdir(parents=True)
        (tmp_path / place / "questions.jsonl").write_text("\n".join(lines) + "\n\n")
    lines = ledgers.read_ledgers(spark, [str(tmp_path / w) for w in "abc"])
    entries = ledgers.unite_ledgers(lines)
    assert sorted((r["ledger_index"], r["id"], r["problem"] is None) for r in entries.collect()) == [
        (0, "d:1", True), (0, "d:2", True), (2, "d:", False), (2, "d:1", True), (2, "d:3", True)]
    audit = {r["ledger_index"]: (r["rows"], r["new_ids"], r["new_stems"]) for r in ledgers.ledger_audit(entries.filter("problem is null")).collect()}
    assert audit == {0: (2, 2, 2), 2: (2, 1, 0)}
    with pytest.raises(FileNotFoundError):
        ledgers.find_ledgers(spark, [str(tmp_path / "none")])


@pytest.mark.parametrize("name,kept", [("internal-test", True), ("Internal_Test", True), (" INTERNAL  test ", True), ("internaltest", True), ("train", False), (None, True)])
def test_split_names(spark, name, kept):
    frame = spark.createDataFrame([(name, None, None)], "a string, b string, c string")
    assert frame.select(Q.wanted_split(F.col("a"), F.col("b"), F.col("c"))).first()[0] is kept
