"""Buckets of suffixes with more classes than one task is given."""

from __future__ import annotations

import random

import brute
from gridlens.llm import substring_dedup


def test_many_classes_of_one_passage(spark, monkeypatch):
    rnd = random.Random(5)
    noise = lambda n: "".join(rnd.choice("abcdefghé ") for _ in range(n))
    passage, other = noise(130), noise(45)
    texts = [(i, noise(rnd.randint(0, 150)) + passage[rnd.choice([0, 0, 9]):] + noise(rnd.randint(0, 60))) for i in range(60)]
    texts += [(100 + i, noise(50) + other + noise(50)) for i in range(3)] + [texts[0], (200, texts[1][1]), (None, None)]
    texts += [(300, texts[2][1][:160])]
    given = []
    sort = substring_dedup._sorted_buckets

    def spied(classes, length):
        given.extend(r["count"] for r in classes.groupBy("bucket").count().collect())
        return sort(classes, length)

    monkeypatch.setattr(substring_dedup, "SLICE_CLASSES", 4)
    monkeypatch.setattr(substring_dedup, "_sorted_buckets", spied)
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    for length in (40, 100):
        found = substring_dedup.remove_repeats(frame, length=length)
        key = lambda row: tuple((v is None, str(v)) for v in row)
        assert sorted(map(tuple, found.collect()), key=key) == sorted(brute.repeats(texts, length), key=key)
    assert given and max(given) <= 4  # no bucket above the limit is handed to one task


def test_windows_that_are_alike_are_not_taken_apart(spark, monkeypatch):
    rnd = random.Random(6)
    noise = lambda n: "".join(rnd.choice("abcdefghijkl ") for _ in range(n))
    passage = noise(700)
    texts = [(i, noise(300) + passage + noise(300)) for i in range(30)]
    texts += [(100 + i, noise(200) + passage[:250 + 40 * i] + noise(500)) for i in range(12)]
    made = []
    suffixes = substring_dedup._suffixes

    def spied(runs, length):
        found = suffixes(runs, length)
        made.append(found.count())
        return found

    monkeypatch.setattr(substring_dedup, "SLICE_CLASSES", 4)
    monkeypatch.setattr(substring_dedup, "_suffixes", spied)
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    found = substring_dedup.remove_repeats(frame).collect()
    assert sorted(map(tuple, found)) == sorted(brute.repeats(texts, 400))
    # Only the edges of the passage: 301 suffixes of it repeat in every one of 30 texts.
    assert 0 < made[0] < 30 * 100
