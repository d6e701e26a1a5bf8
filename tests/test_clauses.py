"""Published example sentences, as fixed test data."""
from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridlens.functions import clauses
from gridlens.functions import text as X

WIN = [
    ({"A": "Ulcerative colitis", "D": "Crohn's disease"}, "If colonoscopy instead showed skip lesions or small-bowel involvement, "
     "this would strongly suggest Crohn's disease over ulcerative colitis.", "D", True),
    ({"F": "Release phase", "H": "Deceleration phase"}, "If the popping sensation occurred immediately after the ball was released, "
     "then F. Release phase or H. Deceleration phase would become the best answer. The altered timing changes the likely phase of injury.", "H", False),
    ({"F": "CT angiogram of the head and neck", "G": "Observation"}, "What would change the answer to favor the best alternative (F. CT angiogram of the "
     "head and neck) would be new focal neurological deficits or a family history of aneurysm. "
     "If the patient developed focal signs, urgent vascular evaluation would be warranted.", "F", True),
    ({"B": "It is caused by gram positive bacilli", "D": "Palatal paralysis is recognized"}, "If the question were changed to: 'Which of the following "
     "microbiological statements about diphtheria is true?', then B would become the best answer because the organism is a gram-positive bacillus.", "B", False),
    ({"B": "It is caused by gram positive bacilli", "D": "Palatal paralysis is recognized"}, "If option D had said that palatal paralysis occurs in every case, "
     "D would be false and B would become the best answer because B would then be the only accurate option.", "B", False),
    ({"A": "ABO incompatibility", "D": "Bacterial contamination"}, "If the question specified a delayed haemolytic reaction instead of an immediate one, "
     "D. Bacterial contamination could become the best answer because delayed reactions can arise from bacterial growth in stored blood.", "D", True),
    ({"A": "Glucagonoma", "D": "Celiac disease"}, "If the question specified dermatitis herpetiformis instead of necrolytic migratory erythema, the best answer "
     "would shift to D. Celiac disease because dermatitis herpetiformis is its classic skin manifestation.", "D", True),
    ({"B": "Atherosclerotic peripheral artery disease", "J": "Takayasu arteritis"}, "If the patient were a 42-year-old woman with pulse deficits, the diagnosis would "
     "shift toward J. Takayasu arteritis and Takayasu would become the more likely diagnosis.", "B", False),
    ({"A": "His mother", "C": "His father", "E": "His friend"}, "The smallest change that would make the best alternative (father) the best answer is specifying that "
     "the father has been the patient's primary caregiver for the past year and that the mother has not been involved in his recent care.", "C", True),
    ({"A": "Access to a firearm", "F": "Previous attempt"}, "If the patient had no access to a firearm because it had been sold or secured elsewhere, then the previous "
     "attempt (F) would become the most significant remaining risk factor. Removing access to the lethal means changes which factor is strongest.", "F", True),
    ({"A": "ABO incompatibility", "D": "Bacterial contamination"}, "If the reaction were delayed by several days, bacterial contamination might become more relevant. "
     "However, this does not establish it as the best answer.", "D", False),
    ({"A": "SNHL", "B": "Cerumen"}, "If a different finding were present, the other option would become the best answer because it would fit better.", "B", False),
    ({"A": "One", "B": "Two"}, "With fever, B would not be the best answer.", "B", False),
    ({"A": "Striae albicantes", "C": "Linea nigra"}, "An older scar would make striae albicantes the best answer.", "A", True),
    ({"A": "One", "C": "Two"}, "The answer would then change from A to C if there were fever.", "C", True),
]
SETTLED = [
    ("The answer is option A.", ["A"]), ("The answer is a treatment category under review.", []), ("The findings favor a benign diagnosis.", []),
    ("If the key fact were absent, the correct answer would be B.", []), ("Option A is the most likely candidate for being false.", ["A"]),
    ("Option A seems most likely.", ["A"]), ("A: one possibility.", []), ("Answer: A.", ["A"]), ("The most likely diagnosis is cerumen impaction.", ["B"]),
    ("Cerumen impaction is a possibility.", []), ("I would choose B", ["B"]), ("This finding would favor B.", []), ("Which option is best?", []),
    ("The findings support option B as the best answer.", ["B"]), ("The answer is not B.", []), ("That is the best answer.", [None]),
]


def _choices(choices):
    filled = {chr(c): choices.get(chr(c), f"Unused distractor {chr(c)}") for c in range(65, ord(max(choices)) + 1)}
    return list(filled), list(filled.values())


def test_winners(spark):
    rows = [(i, text, option, *_choices(choices)) for i, (choices, text, option, _) in enumerate(WIN)]
    frame = spark.createDataFrame(rows, "i int, text string, option string, labels array<string>, texts array<string>")
    normal = F.split(X.normalized(F.array_join("texts", " zzz ")), " zzz ")
    frame = frame.withColumn("normal", normal)
    found = {r["i"]: r["w"] for r in frame.select("i", clauses.wins_alone(F.col("text"), F.col("option"), F.col("labels"), F.col("normal")).alias("w")).collect()}
    assert found == {i: w for i, (*_, w) in enumerate(WIN)}


def test_settled(spark):
    from gridlens.operators.judge import commitments

    frame = spark.createDataFrame([(i, t, ["A", "B"], ["hearing loss", "cerumen impaction"]) for i, (t, _) in enumerate(SETTLED)],
                                  "i int, text string, labels array<string>, texts array<string>")
    found = frame.select("i", commitments(F.col("text"), F.lower("text"), F.col("labels"), F.col("texts")).alias("c")).collect()
    assert {SETTLED[r["i"]][0]: [e["option"] for e in r["c"]] for r in found} == dict(SETTLED)


@pytest.mark.parametrize("text,code", [("Option B is the best", "Bbt"), ("the best alternative (C. Two words) wins", "trCx"), ("answer = A.", "nbA")])
def test_codes(spark, text, code):
    frame = spark.createDataFrame([(text, ["A", "B", "C"], ["x", "y", "two words"])], "t string, l array<string>, c array<string>")
    assert frame.select(clauses.encoded(clauses.marked(F.col("t")), F.col("l"), F.col("c"))).first()[0] == code
