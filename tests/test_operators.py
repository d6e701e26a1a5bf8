from __future__ import annotations

import gzip
import random

import pytest
from pyspark.sql import functions as F

from gridlens.functions import choices, keys
from gridlens.functions import text as X
from gridlens.operators import facts, ledger, sampling
from gridlens.operators.distributed import global_row_number, running
from gridlens.sources import questions as Q
from gridlens.sources import sinks


def test_positions_and_running_values_over_slices(spark):
    rng = random.Random(4)
    rows = [(i, "hot" if i % 3 else f"k{i % 5}", rng.randrange(50)) for i in range(3000)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "id int, key string, v int").repartition(7)
    numbered = {r["id"]: r["n"] for r in global_row_number(frame, ["v", "id"], "n").collect()}
    assert [i for i, _ in sorted(numbered.items(), key=lambda kv: kv[1])] == [
        r[0] for r in sorted(rows, key=lambda r: (r[2], r[0]))]
    found = running(frame, ["id"], {"s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))},
                    keys=["key"])
    state: dict = {}
    expected = {}
    for i, key, v in sorted(rows):
        s, lo, hi = state.get(key, (0, 99, -1))
        state[key] = expected[i] = (s + v, min(lo, v), max(hi, v))
    assert {r["id"]: (r["s"], r["lo"], r["hi"]) for r in found.collect()} == expected


def test_quota_allocation(spark):
    counts = spark.createDataFrame([("a", 50), ("b", 30), ("c", 1)], "pattern string, count bigint")
    rows = sampling.proportional_quota(counts, 30, "pattern", F.col("pattern")).collect()
    assert {r["pattern"]: r["quota"] for r in rows} == {"a": 19, "b": 11, "c": 0}


@pytest.mark.parametrize("raw,expected", [
    ('{"A": "one", "B": "two"}', ["one", "two"]),
    ('{"0": "one", "1": "two"}', ["one", "two"]),
    ('["one", "two"]', ["one", "two"]),
    ("['one', 'two']", ["one", "two"]),
    ('[{"label": "B", "text": "two"}, {"label": "A", "text": "one"}]', ["one", "two"]),
    ('{"label": ["A", "B"], "text": ["one", "two"]}', ["one", "two"]),
    ("A) one\nB) two", ["one", "two"]),
    ("1. one\n2. two", ["one", "two"]),
])
def test_choice_encodings(raw, expected):
    assert list(choices.read_choices(raw).values()) == expected


@pytest.mark.parametrize("raw", ['{"A": "one", "C": "two"}', '["one", "One"]', '{"label": ["A"], "text": ["x", "y"]}'])
def test_choice_rejects(raw):
    with pytest.raises(choices.Rejected):
        choices.read_choices(raw)


def test_gold_encodings():
    options = {"A": "one", "B": "two", "C": "three"}
    assert choices.read_gold("B", options, None) == {"B"}
    assert choices.read_gold("A, C", options, None) == {"A", "C"}
    assert choices.read_gold("three", options, None) == {"C"}
    assert choices.read_gold("B. two", options, None) == {"B"}
    assert choices.read_gold(0, options, 0) == {"A"} and choices.read_gold("1", options, 1) == {"A"}
    assert choices.read_gold('{"A": false, "B": true}', options, None) == {"B"}
    with pytest.raises(choices.Rejected):
        choices.read_gold(1, options, None)


def test_frequency_table(spark, tmp_path):
    path = tmp_path / "table.csv.gz"
    years = [str(y) for y in range(2010, 2019)]
    with gzip.open(path, "wt") as out:
        out.write(",".join(["word", *years]) + "\n")
        for word, count in (("hearing", 2), ("ordinary", 7), ("", 100)):
            out.write(",".join([word, *[str(count)] * 9]) + "\n")
    terms = spark.createDataFrame([("hearing",), ("missing",)], "term string")
    total, found = Q.read_document_frequencies(spark, str(path), terms)
    assert total == 900 and {r["term"]: r["df"] for r in found.collect()} == {"hearing": 18, "missing": 0}


def test_raw_questions_from_json_lines(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    path.write_text('{"question": "Which one?", "options": ["x", "y"], "answer": "B", "id": 5}\n\n'
                    '{"question": "See the image below", "options": ["x", "y"], "answer": "A", "id": 6}\n'
                    '{"question": "Two golds", "options": ["x", "y"], "answer": "A", "correct": "B", "id": 7}\n')
    found = Q.normalize_questions(Q.read_raw_questions(spark, str(path)), F.lit("set"), F.lit("test"))
    rows = {r["id"]: (r["gold"], r["reject_reason"]) for r in found.collect()}
    assert rows["set:5"] == ("B", None)
    assert rows["set:6"][1] == "media dependent" and rows["set:7"][1] == "conflicting gold fields"


def test_unicode_text(spark):
    frame = spark.createDataFrame([("Straße ﬁne", "Ärzte naïve 5.5% patient’s x")], "a string, b string")
    row = frame.select(X.normalized(F.col("a")), X.raw_tokens(F.col("b"))).first()
    assert row[0] == "strasse fine"
    assert row[1] == ["ärzte", "naïve", "5.5%", "patient"]


def test_terms_and_stems(spark):
    words = ["children", "studies", "boxes", "losses", "virus", "days", "gas", "axes"]
    frame = spark.createDataFrame([(words, "14-hour-old infant", "12. A man")], "w array<string>, s string, t string")
    row = frame.select(X.canonical_terms(F.col("w")), X.measurement_stem(F.col("s")), X.measurement_stem(F.col("t"))).first()
    assert row[0] == ["child", "study", "box", "loss", "virus", "day", "gas", "axe"]
    assert row[1] == "14-hour-old infant" and row[2] == "A man"


def test_fact_clauses(spark):
    stem = ("A 5-year-old boy has fever for 3 days and denies pain. He is alert; the rash is red. "
            "Which of the following is best?")
    frame = spark.createDataFrame([("q", stem)], "question_id string, stem string")
    row = facts.fact_inventory(frame).first()
    assert [f["source_text"] for f in row["facts_list"]] == [
        "A 5-year-old boy has fever for 3 days", "denies pain.", "He is alert", "the rash is red."]
    assert row["fact_complexity"] == "three_or_more_facts"
    assert row["facts_list"][1]["hard_features"] == {"negation": ["denies"]}


def test_keys(spark):
    import hashlib

    frame = spark.createDataFrame([("q", "m", "zero")], "q string, m string, c string")
    key = frame.select(keys.cell_key(F.col("q"), F.col("m"), F.col("c"))).first()[0]
    assert key == hashlib.sha256(b"cell-v2\0q\0m\0zero").hexdigest()
    assert keys.canonical_json_text({"b": float("nan"), "a": 1.0}) == '{"a":1.0,"b":null}'


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([("a", 0.1), ("b", None), ("c", 2.0)], "k string, v double")
    sinks.write_csv(frame, str(tmp_path / "csv"), ["k"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("part-*")))
    assert [line for line in text.splitlines() if line != "k,v"] == ["a,0.1", "b,", "c,2"]
    sinks.write_jsonl(frame, str(tmp_path / "json"), ["k"])
    assert '{"k":"b","v":null}' in "".join(p.read_text() for p in (tmp_path / "json").glob("part-*"))
    sinks.write_document(spark, str(tmp_path / "doc.json"), {"x": float("inf")})
    assert (tmp_path / "doc.json").read_text() == '{\n  "x": null\n}\n'


def test_retry_after_dates(spark):
    from gridlens.functions.billing import retry_delay

    frame = spark.createDataFrame([("Sun, 06 Nov 1994 08:49:37 GMT",), ("Sunday, 06-Nov-94 08:49:37 GMT",),
                                   ("Sun Nov  6 08:49:37 1994",), ("75",), ("soon",)], "h string")
    now = F.to_timestamp(F.lit("1994-11-06 08:48:37"))
    rows = frame.select(retry_delay(F.lit("k"), F.lit(0), F.col("h"), now).alias("d")).collect()
    assert [round(r["d"]) for r in rows][:4] == [60, 60, 60, 75] and rows[4]["d"] < 2


def test_balanced_pick_is_the_greedy_walk(spark):
    import hashlib
    from collections import Counter

    rng = random.Random(2)
    rows = [(f"c{i}", f"q{i % 90}", f"m{rng.randrange(3)}", f"d{i % 90 % 2}", f"k{i}"[:2], rng.random() < 0.3)
            for i in range(400)]
    frame = spark.createDataFrame(
        rows, "cell_id string, question_id string, model_id string, dataset string, condition_id string, hinted boolean")
    counts, used, expected = [Counter(), Counter(), Counter()], set(), []
    while len(expected) < 25:
        pool = [r for r in rows if r[1] not in used]
        best = min(pool, key=lambda r: (counts[0][r[2]], counts[1][r[3]], counts[2][r[4]], not r[5],
                                        hashlib.sha256(f"s\0{r[0]}".encode()).hexdigest()))
        expected.append(best[0])
        used.add(best[1])
        for c, v in zip(counts, best[2:5]):
            c[v] += 1
    found = sampling.balanced_pick(frame, 25, "s").orderBy("pick").collect()
    assert [r["cell_id"] for r in found] == expected


def test_audit_tasks_never_reuse_a_pair(spark):
    rows = [(f"p{i}", f"q{i % 40}", i % 3 != 0, i % 2 == 0, i % 5 != 0) for i in range(240)]
    pairs = spark.createDataFrame(rows, "pair_id string, question_id string, lexical_eligible boolean, a boolean, b boolean")
    tasks = sampling.audit_tasks(pairs, "v", ["a", "b"], lexical_count=10, question_count=18, per_role=6).collect()
    assert len(tasks) == 22 and len({t["pair_id"] for t in tasks}) == 22
    assert len({t["question_id"] for t in tasks}) == 18
    flags = {r[0]: {"a": r[3], "b": r[4]} for r in rows}
    assert all(flags[t["pair_id"]][t["role"]] for t in tasks if t["task"] == "role")
    assert sorted(t["display_order"] for t in tasks) == list(range(1, 23))


def test_quota_overflow_goes_to_the_roomiest_group(spark):
    rng = random.Random(5)
    for n in (12, 25, 31):
        rows = [(f"g{i}", rng.randint(1, 30), rng.randint(0, 9)) for i in range(8)]
        rows[0] = ("g0", 30, 9)
        if sum(r[2] for r in rows) < n:
            continue
        counts = spark.createDataFrame(rows, "pattern string, count bigint, room bigint")
        plain = {r["pattern"]: r["quota"] for r in sampling.proportional_quota(counts, n, "pattern", F.col("pattern")).collect()}
        room = {p: r for p, _, r in rows}
        excess = sum(max(0, plain[p] - room[p]) for p in plain)
        expected = {p: min(plain[p], room[p]) for p in plain}
        for _ in range(excess):
            best = min((p for p in room if expected[p] < room[p]), key=lambda p: (expected[p] - room[p], p))
            expected[best] += 1
        found = sampling.proportional_quota(counts, n, "pattern", F.col("pattern"), capacity="room").collect()
        assert {r["pattern"]: r["quota"] for r in found} == expected
    with pytest.raises(Exception, match="more draws than the groups hold"):
        sampling.proportional_quota(counts, 500, "pattern", F.col("pattern"), capacity="room").collect()


def test_short_pools_are_errors(spark):
    pool = spark.createDataFrame([("p1", "q1"), ("p2", "q1")], "pair_id string, question_id string")
    with pytest.raises(ValueError, match="found 2"):
        sampling.hash_sample(pool, 3, "s", "primary", "pair_id")
    with pytest.raises(ValueError, match="found 1"):
        sampling.one_per_question(pool, 2, "v", "salt")
    flagged = pool.select("*", F.lit(True).alias("lexical_eligible"), F.lit(True).alias("a"))
    assert sampling.audit_tasks(flagged, "v", ["a"]).count() == 0


def test_highlighting(spark):
    frame = spark.createDataFrame([("Left ears & <pain>.", ["ear", "pain"])], "t string, w array<string>")
    row = frame.select(X.highlighted(F.col("t"), F.col("w"))).first()
    assert row[0] == "Left <mark>ears</mark> &amp; <mark>&lt;pain&gt;.</mark>"


def test_provider_order(spark):
    frame = spark.createDataFrame([(["b", "Zed", "a", "zed"], ["ZED", "x"])], "d array<string>, p array<string>")
    assert frame.select(sampling.preference_order(F.col("d"), F.col("p"))).first()[0] == ["zed", "a", "b"]
