from __future__ import annotations

import math

import numpy as np
import pytest

from gridlens.llm import whitening


def plain(rows, components=16):
    """Eigenvectors of the covariance by LAPACK, and what follows from them."""
    kept = [(k, v) for k, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept], object)
    unique = np.array(sorted({tuple(r) for r in x.tolist()}), float)
    n, sums = len(unique), [sum(int(v) for v in c) for c in zip(*{tuple(r) for r in x.tolist()})]
    mean = np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh((unique - mean).T @ (unique - mean) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    white = (x.astype(float) - mean) @ (vectors / np.sqrt(values))[:, :components]
    deviations = [sum((n * int(v) - s) ** 2 for v, s in zip(r, sums)) for r in x]
    return kept, n, deviations, white, values / values.sum()


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    mix = rng.standard_normal((40, 40)) * np.linspace(1, 4, 40)
    rows = [(i, (rng.standard_normal(40) @ mix).astype(float).tolist()) for i in range(600)]
    rows += rows[:50] + [(1000 + i, rows[3][1]) for i in range(200)]
    rows += [(5000, None), (5001, [None] * 40), (5002, [math.nan] + [0.0] * 39), (5003, [math.inf] * 40), (5004, []), (None, rows[7][1])]
    return rows


def test_matches_dense_eigenvectors(spark, vectors):
    frame = spark.createDataFrame([(k, v, 1.0, "x") for k, v in vectors], "vec_id long, embedding array<double>, whitened double, key string").repartition(6)
    found = whitening.whiten(frame)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kept, n, deviations, white, explained = plain(vectors)
    rows = sorted(map(tuple, found.collect()), key=repr)
    assert len(rows) == 16 * len(kept)
    by_key: dict = {}
    for r in rows:
        by_key.setdefault(r[0], []).append(r)
    first = {r[1]: r[4] for r in by_key[0][:16]} if len(by_key[0]) == 16 else {r[1]: r[4] for r in by_key[100]}
    anchor = 0 if len(by_key[0]) == 16 else 100
    signs = {c: np.sign(v) * np.sign(white[anchor, c - 1]) for c, v in first.items()}
    for i, (key, _) in enumerate(kept):
        for r in by_key[key]:
            assert r[2] == n and r[3] == deviations[i] and r[6] < 1e-9
            assert r[4] == pytest.approx(signs[r[1]] * white[i, r[1] - 1], abs=1e-7)
            assert r[5] == pytest.approx(explained[r[1] - 1], rel=1e-10)


def test_flat_spectra_and_missed_directions():
    """Equal eigenvalues, a rank below the number of components, and a start block that misses a direction."""
    rng = np.random.default_rng(0)
    basis, _ = np.linalg.qr(rng.standard_normal((50, 50)))
    for values in (np.r_[[9.0] * 20, [1.0] * 30], np.r_[[5.0, 4, 3], [0.0] * 47], np.r_[np.linspace(2, 1.9, 30), [1.8] * 20], np.r_[[1e12], np.linspace(2, 1, 49)]):
        matrix = (basis * values) @ basis.T
        found = whitening.leading_eigenvectors(lambda q, m=matrix: m @ q, 50, 16)
        assert np.allclose(found.values, np.sort(values)[::-1][:16], atol=1e-12 * max(values))
        assert np.linalg.norm(matrix @ found.vectors - found.vectors * found.values, axis=0).max() < 1e-11 * max(values)


def test_edge_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []
    two = whitening.whiten(spark.createDataFrame([(1, [0.0, 0.5]), (2, [0.0, -0.5]), (3, [0.0, 0.5, 1.0])], schema)).collect()
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], abs(round(r["whitened"], 12)), r["explained"]) for r in sorted(two)] == [
        (1, 1, 2, 4096, 1.0, 1.0), (2, 1, 2, 4096, 1.0, 1.0)]


def test_deviations_beyond_64_bits(spark):
    far = whitening.whiten(spark.createDataFrame([(1, [2.0**50]), (2, [-2.0**50]), (3, [2.0**60])], "vec_id long, embedding array<double>"))
    assert [(r["vec_id"], r["deviation"], round(abs(r["whitened"]), 9)) for r in sorted(far.collect())] == [(1, None, 1.0), (2, None, 1.0)]
