from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridlens.operators import facts, judge, lexical

STEM = "A patient has sudden left hearing loss for 2 hours and no ear pain."
CHOICES = [("A", "Sudden sensorineural hearing loss"), ("B", "Otitis media"), ("C", "Cerumen impaction"),
           ("D", "Otosclerosis")]


def response(change: str | None = None, **titles: str) -> str:
    a, b = CHOICES[0][1], CHOICES[1][1]
    lines = [
        "1. Facts", STEM, "2. Implications", f"The stated findings support {a} and argue against alternatives.",
        "3. Provisional answer", f"Option A, {a}, is provisional because it best fits the facts.",
        "4. Best alternative", f"Option B, {b}, is the best alternative but loses on the decisive finding.",
        "5. Decisive distinction", STEM, "6. What would change the answer",
        change or f"If the decisive finding changed to support {b}, option B would become best.",
        "7. Reconsideration", f"Retain option A after checking the stem again; the decisive evidence remains: {STEM}",
        "8. Final answer", f"Option A: {a}"]
    return "\n".join(lines)


ALIASES = {
    "1. Facts": "## Step 1: Case Facts", "2. Implications": "## Step 2: Interpretation",
    "3. Provisional answer": "## Step 3: Initial Answer", "4. Best alternative": "## Step 4: Second-Best Answer",
    "5. Decisive distinction": "## Step 5: Key Distinction",
    "6. What would change the answer": "## Step 6: Counterfactual Change",
    "7. Reconsideration": "## Step 7: Re-evaluation", "8. Final answer": "## Step 8: Final Answer",
}


def aliased() -> str:
    text = response()
    for old, new in ALIASES.items():
        text = text.replace(old, new)
    return text


def tagged() -> str:
    names = ("facts", "implications", "provisional_answer", "second_best", "decisive_fact", "answer_changing_change",
             "rereasoning", "final_answer")
    text = response()
    for (old, _), name in zip(ALIASES.items(), names):
        text = text.replace(old, f"<{name}>")
    return text


MEANINGFUL = ("This section contains meaningful generated material, but it does not explicitly establish that the "
              "stated best alternative would become the winning answer.")
TEMPLATE = "\n".join(ALIASES) + "\n\n"
CASES = {
    "plain": ("completed", "system", response()),
    "fenced": ("completed", "system", "```markdown\n" + response() + "\n```"),
    "aliased": ("completed", "system", aliased()),
    "tagged": ("completed", "system", tagged()),
    "template_first": ("completed", "system", TEMPLATE + response()),
    "meaningful_change": ("completed", "system", response(MEANINGFUL)),
    "filler_change": ("completed", "system", response("See above.")),
    "no_reconsideration": ("completed", "system", response().replace("7. Reconsideration\n", "")),
    "committed": ("completed", "system", response().replace("2. Implications", "2. Implications\nThe correct answer is option B.", 1)),
    "conditional": ("completed", "system", response().replace(
        "2. Implications", "2. Implications\nIf fever were present, the answer would be option B.", 1)),
    "wrong_final": ("completed", "system", response().replace("Option A: Sudden", "Option C: Sudden").replace(
        "8. Final answer\nOption C: Sudden sensorineural hearing loss", "8. Final answer\nOption C: Cerumen impaction")),
    "failed": ("failed", "system", None),
    "failed_zero": ("failed", "zero", None),
    "zero": ("completed", "zero", "Final answer: A."),
    "zero_conflict": ("completed", "zero", "The answer is B.\nFinal answer: A or the correct answer is C."),
    "zero_text": ("completed", "zero", "Reasoning first.\nTherefore, the answer\nA. Sudden sensorineural hearing loss"),
}


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(name, "q1", "m", condition, "d", status, STEM, [{"label": l, "text": t} for l, t in CHOICES], "A", content)
            for name, (status, condition, content) in CASES.items()]
    cells = spark.createDataFrame(
        rows, "cell_id string, question_id string, model_id string, condition_id string, dataset string, status string,"
              " stem string, choices array<struct<label:string,text:string>>, gold string, content string")
    cells = facts.fact_inventory(cells)
    frequencies = spark.createDataFrame([("hearing", 10), ("ear", 900)], "term string, df bigint")
    profiles = lexical.stem_profiles(cells.select("question_id", "stem").distinct(), frequencies, 1000)
    return {r["cell_id"]: r.asDict() for r in judge.judge(cells, profiles).collect()}


@pytest.mark.parametrize("name", ["plain", "fenced", "aliased", "tagged", "template_first"])
def test_complete_responses(judged, name):
    row = judged[name]
    assert row["identified_role_count"] == 8
    assert row["substantive_role_count"] == 8, {k: v for k, v in row.items() if k.startswith("role_")}
    assert row["role_completeness_score"] == 1.0
    assert row["roles_in_requested_order"] == 1.0
    assert row["accuracy"] == 1.0
    assert row["rereasoning_decision"] == "retain"
    if name != "template_first":
        assert row["unique_role_count"] == 8
        assert row["trajectory_complete"] == 1.0
        assert row["complete_role_scaffold"] == 1.0
        assert row["preanswer_discussion_complete"] == 1.0


def test_validated_sixth_role(judged):
    meaningful, filler = judged["meaningful_change"], judged["filler_change"]
    assert meaningful["role_answer_changing_change_complete"] == 0.0
    assert meaningful["role_answer_changing_change_nontrivial"] == 1.0
    assert meaningful["validated_role_count"] == 8
    assert meaningful["validated_complete_role_scaffold"] == 1.0
    assert filler["role_answer_changing_change_nontrivial"] == 0.0
    assert filler["validated_role_count"] == 7
    assert filler["all_roles_validated_complete"] == 0.0


def test_missing_role(judged):
    row = judged["no_reconsideration"]
    assert row["required_section_count"] == 7
    assert row["trajectory_complete"] == 0.0
    assert row["roles_in_requested_order"] == 0.0


def test_commitments(judged):
    assert judged["plain"]["preprovisional_commitment_itt"] == 0.0
    assert judged["conditional"]["preprovisional_commitment_itt"] == 0.0
    committed = judged["committed"]
    assert committed["preprovisional_commitment_itt"] == 1.0
    assert [e["option"] for e in committed["early_commitments"]] == ["B"]


def test_answers(judged):
    assert judged["zero"]["accuracy"] == 1.0
    assert judged["zero"]["required_section_count"] is None
    assert judged["zero_conflict"]["answer_extraction_status"] == "conflicting"
    assert judged["zero_text"]["final_option"] == "A"
    wrong = judged["wrong_final"]
    assert wrong["final_option"] == "C" and wrong["accuracy"] == 0.0 and wrong["decision_consistent"] == 0.0


def test_failure_matrix(judged):
    failed, zero = judged["failed"], judged["failed_zero"]
    assert failed["generation_usable"] is False
    assert failed["validated_role_count"] == 0.0 and failed["preprovisional_tfidf_recall"] == 0.0
    assert failed["preprovisional_commitment_itt"] == 1.0 and failed["preprovisional_commitment_observed"] is None
    assert zero["validated_role_count"] is None and zero["accuracy"] == 0.0
    assert zero["preprovisional_commitment_itt"] is None


def test_facts_of_the_stem(judged):
    assert judged["plain"]["atomic_fact_coverage"] == 1.0
    assert judged["plain"]["hard_qualifier_fact_recall"] == 1.0
    assert judged["plain"]["facts_anchor_recall"] == 1.0


@pytest.mark.parametrize("title,accepted", [
    ("6. What would change the answer to C?", True),
    ("**Counterfactual scenario**", True),
    ("Change needed to change the answer:", True),
    ("6) How to make the runner-up win", True),
    ("What would change?", False),
    ("The change of plan was sudden", False),
])
def test_sixth_heading_wordings(spark, title, accepted):
    from gridlens.operators.sections import recover

    text = response().replace("6. What would change the answer", title)
    frame = spark.createDataFrame([(text, [{"label": l, "text": t} for l, t in CHOICES])],
                                  "content string, choices array<struct<label:string,text:string>>")
    counts = recover(frame).select("role_counts").first()[0]
    assert (counts[5] == 1) is accepted


def test_anchor_known_answers(spark):
    pairs = [("computed tomography (CT)", "CT", 1.0), ("myocardial infarction", "MI", 1.0),
             ("morphine infusion", "MI", 0.0), ("chronic tinnitus", "CT", 0.0)]
    frame = spark.createDataFrame([(s, o) for s, o, _ in pairs], "stem string, output string")
    found = [r[0] for r in frame.select(lexical.anchor_recall(F.col("stem"), F.col("output"))).collect()]
    assert found == [e for *_, e in pairs]
