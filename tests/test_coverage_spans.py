"""Coverage spans against a walk that uses up credits token by token."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from gridlens.operators import lexical

WORDS = "pain fever liver rash wound not the and 12 3.5%".split()


def walk(stem: str, counts: list[Counter]) -> set:
    found = set()
    for side, (mine, other) in zip("AB", (counts, counts[::-1])):
        common = Counter({t: min(n, other[t]) for t, n in mine.items()})
        unique = Counter({t: n - other[t] for t, n in mine.items() if n > other[t]})
        at = 0
        for token in stem.split(" "):
            if token not in ("not", "the", "and"):
                for kind, left in (("common", common), ("unique", unique)):
                    if left[token] > 0:
                        left[token] -= 1
                        found.add((side, at, at + len(token), token, kind))
                        break
            at += len(token) + 1
    return found


def test_spans_use_up_credits_in_text_order(spark):
    rng = random.Random(4)
    pick = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows = [(str(i), "case " + pick(12), pick(rng.randrange(9)), pick(rng.randrange(9))) for i in range(30)]
    rows.append(("empty", "", "", ""))
    frame = spark.createDataFrame(rows, "k string, stem string, first string, second string")
    frequencies = spark.createDataFrame([("pain", 40), ("liver", 2)], "term string, df bigint")
    found: dict[str, set] = {k: set() for k, *_ in rows}
    for r in lexical.coverage_spans(frame, frequencies, 100, key="k").collect():
        found[r["k"]].add((r["side"], r["start"], r["end"], r["term"], r["kind"]))
        assert (r["opacity"] is None) == (r["kind"] == "common")
    for k, stem, first, second in rows:
        counts = [Counter(t for t in side.split() if t not in ("not", "the", "and")) for side in (first, second)]
        assert found[k] == walk(stem, counts), (k, stem, first, second)


def test_missing_texts_give_no_spans(spark):
    frame = spark.createDataFrame([("a", None, "pain", None)], "k string, stem string, first string, second string")
    frequencies = spark.createDataFrame([], "term string, df bigint")
    assert lexical.coverage_spans(frame, frequencies, 1, key="k").select(F.count("*")).first()[0] == 0
