"""Pairs that cannot reach the threshold are dropped by a few bytes each, never a pair that reaches it."""

from __future__ import annotations

import random

import brute
import numpy as np
import pyarrow as pa
from gridlens.llm import ngram_join
from gridlens.llm import text_hash as th


def _sets(texts):
    return [ngram_join.Sets(p, th.Powers(), 1) for p in th.pieces(pa.array(texts))][0]


def test_parities_count_no_more_than_the_differences():
    rng = np.random.default_rng(3)
    for size in (1, 63, 64, 65, 120, 130, 500, 3000):
        for change in (0, 1, size // 10, size // 4, size):
            words = [f"w{x}" for x in rng.choice(10**6, size + change, replace=False)]
            a, b = words[:size], words[change:] + words[:1]
            sets = _sets([" ".join(a), " ".join(b), ""])
            apart = len(set(a) ^ set(b))
            x, y, _ = sets.parities()
            assert ngram_join.differences(x, y) == ngram_join.differences(y, x) <= apart
            # About a quarter of the sets has to differ before it shows for sure.
            assert change < size or ngram_join.differences(x, y) * 9 > len(set(a)) + len(set(b))
    assert _sets(["", "a"]).parities()[0] == bytes(8)


def test_texts_of_one_passage_are_not_met_in_full(spark, monkeypatch):
    rnd = random.Random(9)
    prose = lambda n: " ".join(f"{rnd.randrange(10**9):x}" for _ in range(n))
    passage, near = prose(120), prose(200).split(" ")
    texts = [(i, f"{prose(60)} {passage} {prose(60)}") for i in range(40)]
    texts += [(100 + i, " ".join([*near[:50 + 9 * i], prose(1), *near[51 + 9 * i:]])) for i in range(6)]
    met = []
    links = ngram_join._Join.links

    def spied(self, pairs):
        met.extend(map(tuple, pairs.select("a", "b").collect()))
        return links(self, pairs)

    monkeypatch.setattr(ngram_join._Join, "links", spied)
    monkeypatch.setattr(ngram_join, "SKETCH_BITS", 6)  # as full as the sketch is of many documents: no shingle is known as rare
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    found = sorted(map(tuple, ngram_join.similarity_groups(frame).collect()))
    assert found == sorted(brute.components(texts))
    assert [r[2] for r in found if r[0] >= 100] == [100] * 6
    assert 5 <= len(met) <= 15  # of 795 pairs, those of the six near copies
