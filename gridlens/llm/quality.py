"""Quality scores by regularised quadratic discriminant analysis of document statistics.

Each text becomes a short vector of transformed counts (length, symbols, case, punctuation, repetition).  Class means
and covariances come from sums over all labelled training rows, added up per task and then by Spark, so no row reaches
the driver and nothing is sampled.  Covariances are shrunk towards the pooled one and its diagonal; their Cholesky
factors are kept in the model, and a score is the difference of two Mahalanobis log-densities plus the log prior odds,
on the logistic scale.

Defined results: missing and empty texts have all counts zero and get that vector's score; rows keep their ids, missing
or repeated; an id with several labels counts as the lowest; without training rows of both classes every score is the
share of the class that is known, or one half.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm import text_hash as th
from gridlens.llm.tables import held_out, stored

SYMBOLS, STOPS, LOUD = b"#*$%&|<>", b".,;:", b"!?"
SIZE = 13


def statistics(piece: th.Piece, powers: th.Powers) -> np.ndarray:
    """One row of transformed counts per text."""
    low, high = piece.starts[:-1], piece.starts[1:]

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return (sums[high] - sums[low]).astype(float)

    def among(chars: bytes) -> np.ndarray:
        table = np.zeros(256, bool)
        table[list(chars)] = True
        return count(table[piece.data])

    words = th.words(piece, powers, th.WHITE)
    owner = th.owners(words.bounds)
    n = np.diff(words.bounds).astype(float)

    def distinct(hashes: np.ndarray, texts: np.ndarray) -> np.ndarray:
        order = np.lexsort((hashes, texts))
        h, t = hashes[order], texts[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
        return np.bincount(t[new], minlength=piece.count).astype(float)

    grams = th.grams(words.hashes, 5)
    inside = owner[:len(grams)] == owner[4:] if len(grams) else np.zeros(0, bool)
    n5 = np.bincount(owner[:len(grams)][inside], minlength=piece.count).astype(float)
    ink = np.bincount(owner, weights=words.end - words.start, minlength=piece.count)
    share = lambda part, whole: np.log((part + 0.5) / (whole + 1.0))
    return np.stack([
        np.log1p(n), np.log1p(ink / np.maximum(n, 1)), share(among(SYMBOLS), n), share(among(bytes(range(65, 91))), ink),
        share(among(bytes(range(48, 58))), ink), share(among(LOUD), n), share(among(STOPS), n), share(among(b"|"), n),
        share(among(b"\n"), n), share(distinct(words.hashes, owner), n), share(distinct(grams[inside], owner[:len(grams)][inside]), n5),
        share(among(bytes(range(128, 256))), ink), share(among(b"."), n)], axis=1)


def measured(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, x): the statistics of every whole text."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = th.Powers()
        for batch in batches:
            found = [statistics(piece, powers) for piece in th.pieces(batch.column("text"))]
            if found:
                flat = np.concatenate(found)
                x = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * SIZE, pa.int32()), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("key"), x], names=["key", "x"])

    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, x array<double>")


@dataclass
class Discriminant:
    """Class log priors, means and Cholesky factors of standardised statistics."""

    prior: float
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    means: list[np.ndarray] | None = None
    factors: list[np.ndarray] | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        odds = np.full(len(x), np.log(self.prior / (1 - self.prior)))
        if self.factors is not None:
            z = (x - self.centre) / self.scale
            for sign, mean, factor in zip((-1, 1), self.means, self.factors):
                away = np.linalg.solve(factor, (z - mean).T)
                odds += sign * (-0.5 * (away**2).sum(axis=0) - np.log(np.diag(factor)).sum())
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def _moments(rows: DataFrame) -> dict[int, np.ndarray]:
    """Per label the sums of (1, x)(1, x)^T; a fixed number of sums reaches the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SIZE + 1, SIZE + 1))
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, SIZE)
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            y = batch.column("label").to_numpy(zero_copy_only=False)
            for c in (0, 1):
                total[c] += x[y == c].T @ x[y == c]
        cell = np.arange(total[0].size)
        for c in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), c, np.int32)), pa.array(cell.astype(np.int32)), pa.array(total[c].ravel())],
                                             names=["label", "cell", "value"])

    sums = rows.mapInArrow(add, "label int, cell int, value double").groupBy("label", "cell").agg(F.sum("value").alias("value")).collect()
    found = {0: np.zeros((SIZE + 1) ** 2), 1: np.zeros((SIZE + 1) ** 2)}
    for r in sums:
        found[r["label"]][r["cell"]] = r["value"]
    return {c: v.reshape(SIZE + 1, SIZE + 1) for c, v in found.items()}


def fit(rows: DataFrame, labels: DataFrame, *, key: str = "doc_id", label: str = "quality", shrink: float = 0.1,
        diagonal: float = 0.2, floor: float = 1e-3) -> Discriminant:
    """From all rows of :func:`measured` that are labelled and not held out.

    A class covariance keeps ``1 - shrink`` of itself; of the pooled covariance that fills up, ``diagonal`` is its
    diagonal only.  ``floor`` is the least variance of a standardised statistic.
    """
    known = labels.filter(F.col(label).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("_id")).agg(F.min(F.col(label).cast("int")).alias("label"))
    sums = _moments(rows.join(known, F.col("key") == F.col("_id")).select("x", "label"))
    n = [sums[c][0, 0] for c in (0, 1)]
    if not n[0] or not n[1]:
        return Discriminant(np.clip(n[1] / (n[0] + n[1]), 0.01, 0.99) if n[0] + n[1] else 0.5)
    both = (sums[0] + sums[1]) / (n[0] + n[1])
    centre = both[0, 1:]
    scale = np.sqrt(np.maximum(np.diag(both)[1:] - centre**2, 1e-12))
    means, spread = [], []
    for c in (0, 1):
        mean = sums[c][0, 1:] / n[c]
        means.append((mean - centre) / scale)
        spread.append((sums[c][1:, 1:] / n[c] - np.outer(mean, mean)) / np.outer(scale, scale))
    pooled = (n[0] * spread[0] + n[1] * spread[1]) / (n[0] + n[1])
    pooled = (1 - diagonal) * pooled + diagonal * np.diag(np.diag(pooled))
    factors = [np.linalg.cholesky((1 - shrink) * s + shrink * pooled + floor * np.eye(SIZE)) for s in spread]
    return Discriminant(n[1] / (n[0] + n[1]), centre, scale, means, factors)


def score_documents(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = 0.3,
                    **settings: float) -> DataFrame:
    """Per row: key, held_out, score (1: likely good) and predicted; fitted on the rows outside the held-out fold."""
    rows = stored(measured(docs, key, text))
    model = fit(rows, labels, key=key, **settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, SIZE)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(model.score(x))], names=["key", "score"])

    scored = rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, score double")
    return scored.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
