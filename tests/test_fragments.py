"""Choices named by their words instead of their labels."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridlens.functions import fragments
from gridlens.operators.sections import recover

DRUGS = ["Increase the dose of lisinopril", "Stopping metoprolol therapies", "Add spironolactone", "n/a"]
CELLS = ["Cells staining positive for CD15 and CD30", "Smudge cells on smear", "Auer rods in blasts", "Cells with CD20"]


def plain_stem(word):
    for ending, least, put in (("ing", 7, ""), ("ies", 6, "y"), ("ed", 6, "")):
        if word.endswith(ending) and len(word) >= least:
            return word[:-len(ending)] + put
    return word[:-1] if len(word) > 4 and word.endswith("s") and not word.endswith("ss") else word


def test_stems(spark):
    words = "ending starting dries therapies bleed stopped process doses gas ies seeing boss singings"
    found = spark.range(1).select(fragments.stems(F.lit(words)).alias("s")).first()["s"]
    assert found == list(dict.fromkeys(plain_stem(w) for w in words.split()))
    assert spark.range(1).select(fragments.stems(F.lit("")).alias("s")).first()["s"] == []


@pytest.mark.parametrize("choices, said, wording, own", [
    (DRUGS, "i would stop metoprolol therapy here", None, "B"),  # stopping keeps its second p
    (DRUGS, "the dose of lisinopril has to be increased", "A", "A"),
    (DRUGS, "adding spironolactone", None, None),  # stems: add is too short to lose its ending, one of two words
    (DRUGS, "dose lisinopril metoprolol therapy stop", None, None),  # two own words each
    (DRUGS, "something else", None, None),
    (DRUGS, "n a", None, None),
    (DRUGS, "", None, None),
    (CELLS, "they would express cd15 together with cd30", None, "A"),
    (CELLS, "auer rod and smudge on smear", None, "B"),  # rods is too short to lose its ending
    (["fever", "fever", "chills", "pain"], "fever", None, None),
    ([], "fever", None, None),
])
def test_fragments(spark, choices, said, wording, own):
    labels = F.array(*[F.lit(x) for x in "ABCD"[:len(choices)]])
    texts = F.array(*[F.lit(c.lower().replace("/", " ")) for c in choices]).cast("array<string>")
    row = spark.range(1).select(fragments.profiles(labels.cast("array<string>"), texts).alias("p"), fragments.stems(F.lit(said)).alias("s"))
    found = row.select(fragments.by_wording(F.col("s"), F.col("p")), fragments.by_own_words(F.col("s"), F.col("p"))).first()
    assert tuple(found) == (wording, own)


def test_line_break_debris(spark):
    texts = F.array(F.lit("fludarabinern"), F.lit("vincristinern"))
    row = spark.range(1).select(fragments.profiles(F.array(F.lit("A"), F.lit("B")), texts).alias("p"))
    assert row.select(fragments.by_wording(fragments.stems(F.lit("give vincristine")), F.col("p"))).first()[0] == "B"


def test_paraphrased_answers_are_recovered(spark):
    content = ("1. Facts\nCough.\n2. Implications\nHeart.\n3. Provisional answer\nWe ought to stop her metoprolol therapy.\n"
               "4. Best alternative\nThe dose of lisinopril might be increased (see above).\n5. Decisive distinction\nPulse.\n"
               "6. What would change the answer\nPotassium.\n7. Reconsideration\nKeep it.\n8. Final answer\nStop metoprolol therapy.")
    choices = [{"label": x, "text": t} for x, t in zip("ABCD", [DRUGS[0] + " (C)", *DRUGS[1:]])]
    frame = spark.createDataFrame([(content, choices), (None, choices), (content, []), (content, None)],
                                  "content string, choices array<struct<label string, text string>>")
    rows = [tuple(r) for r in recover(frame).select("provisional_option", "second_best_option", "recovered_final_option").collect()]
    assert rows == [("B", "A", "B"), (None, None, None), (None, None, None), (None, None, None)]
