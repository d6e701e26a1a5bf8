from __future__ import annotations

import math
import random

import brute
import numpy as np
import pytest

from gridlens.llm import minhash


def plain(rows, size=4):
    """From all pairs of texts with a common shingle."""
    real = brute.shingles
    brute.shingles = lambda text, n=size: real(text, n)
    try:
        found = brute.components(rows)
    finally:
        brute.shingles = real
    return [(key, n, root, key == root) for key, n, root in found]


def result(frame):
    return sorted(map(repr, (tuple(r) for r in frame.collect())))


def test_components_match_all_pairs(documents, texts):
    found = minhash.near_duplicates(documents)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert result(found) == sorted(map(repr, plain(texts)))


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    """Many variants of one text that share bands, few of them linked: what no pivot links is found in blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rnd = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words, edits = list(base), rnd.choice([2, 5, 9])
        for at in rnd.sample(range(len(words)), edits):
            words[at] = f"x{rnd.randrange(10**6)}"
        rows += [(2 * i, " ".join(words))] + ([(2 * i + 1, " ".join([*words[:-1], "end"]))] if i % 3 == 0 else [])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert result(minhash.near_duplicates(docs)) == sorted(map(repr, plain(rows)))


def test_empty_table_and_very_long_texts(spark, empty):
    assert minhash.near_duplicates(empty).collect() == []
    long = [(1, "home " * 200_000), (2, ">" * 1_000_000), (3, " " * 1_000_000), (4, "a b " * 250_000), (5, "home " * 100_000), (6, None)]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(
        spark.createDataFrame(long, "doc_id long, text string")).collect()}
    assert found == {1: (1, 1, True), 5: (1, 1, False), 2: (1, 2, True), 3: (0, 3, True), 4: (2, 4, True), 6: (0, 6, True)}


def test_least_matches_are_posterior_bounds():
    limits = minhash.least_matches(200, 25, 80, 1e-8)
    assert [n for n, _ in limits] == list(range(25, 201, 25))
    for n, m in limits:
        beyond = lambda k: sum(math.comb(n + 1, j) * .8**j * .2**(n + 1 - j) for j in range(k + 1))
        assert beyond(m) >= 1e-8 and (m == 0 or beyond(m - 1) < 1e-8)


@pytest.mark.parametrize("similarity", [0.8, 0.9])
def test_pairs_at_the_threshold_are_not_pruned(similarity):
    rng = np.random.default_rng(2)
    limits, functions = minhash.least_matches(200, 25, 80, 1e-8), minhash.hash_functions(200)
    common = int(400 * similarity)
    for _ in range(50):
        values = rng.integers(0, 2**63, 400 + (400 - common), dtype=np.int64).astype(np.uint64)
        # Intersection / union = common / 400, so both sides share ``common`` of 400 values.
        half = (400 - common) // 2
        a, b = values[:common + half], np.concatenate([values[:common], values[common + half:400]])
        rows = minhash.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), functions)
        assert len(minhash.surviving(rows[:1], rows[1:], limits)) == 1
        assert abs((rows[0] == rows[1]).mean() - similarity) < 0.15
