"""One line or text of a megabyte of each kind gives rows, whatever the operator."""
from __future__ import annotations

import pytest

from gridlens.llm import line_rules, quotations

SIZE = 1_000_000
LONG = {"menu": "home " * (SIZE // 5), "marks": ">" * SIZE, "blanks": " " * SIZE, "word": "word " * (SIZE // 5), "letter": "a" * SIZE,
        "stops": "." * SIZE + "a", "inner blanks": "a" + " " * SIZE + "b", "spaced marks": "> " * (SIZE // 2), "attribution": "am schrieb " * (SIZE // 11)}


@pytest.mark.parametrize("kind", LONG)
def test_long_lines(spark, kind):
    text = LONG[kind]
    cleaned = line_rules.line_first(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert cleaned["n_words"] == len(text.split()) and cleaned["kept"] is False
    rows = spark.createDataFrame([(1, 1, "user", text), (1, 2, "assistant", "answer\n" + text)], "conv_id long, turn int, role string, text string")
    found = quotations.link_quotations(rows).orderBy("turn").collect()
    assert [r["position"] for r in found] == [1, 2] and found[1]["reply_to"] == 1


def test_menus_and_marks_keep_their_meaning(spark):
    lines = ["Home | About us | Contacto", "homework help", "Home", "> Log in » Sign up", "menu of the day", "|", "contact us home"]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string")
    from pyspark.sql import functions as F
    navigation = F.rlike("x", F.lit(line_rules.FIRST_ITEM)) & (F.regexp_replace("x", line_rules.ITEMS, "") == "")
    assert [r[0] for r in frame.orderBy("i").select(navigation).collect()] == [True, False, True, True, False, False, True]
    marks = {"> a": (1, "a"), ">> b": (2, "b"), " > > c": (2, "c"), ">  > d": (1, " > d"), "  > e": (0, "  > e"), ">": (1, ""), "f > g": (0, "f > g"), "\t>\t>h": (2, "h"),
             "> ": (1, "")}
    got = spark.createDataFrame([(k,) for k in marks], "x string").select("x", quotations.quote_lines(F.col("x"))[0].alias("q")).collect()
    assert {r["x"]: (r["q"]["level"], r["q"]["line"]) for r in got} == marks
