"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The fit list holds each distinct vector once, packed into blocks of rows in the shared checkpoint folder.  One step of the
iteration is one distributed pass over it that adds up ``(X - mean)^T ((X - mean) Q) / n`` for a thin block of vectors Q;
rows are centred before they are multiplied and only sums of the size of Q reach the driver.

* A few Lanczos passes bound the spectrum from both ends.
* Each round applies a Chebyshev polynomial by its three-term recurrence, one pass a degree.  It is small on the
  unwanted part of the spectrum, between the lower bound and the block's smallest Ritz value, and grows fast above it.
* QR and a Rayleigh-Ritz step give Ritz pairs and their residuals.  Rounds go on until the residual of every wanted pair
  is at rounding level.
* A fresh random block, made orthogonal to the found one, is filtered last: if it holds a larger Ritz value, an
  eigenvector was missed; it joins the block and the rounds go on.

Defined results: rows with a missing vector, or with missing or non-finite entries, are dropped, as are those with entries
beyond 2^56, which have no exact 64-bit form.  The dimension is that of most remaining rows (of equals the smaller), other
rows are dropped.  Missing and repeated ids are returned as they are.  No remaining rows give no rows; components whose
eigenvalue is zero to rounding cannot be whitened and are left out.  A deviation beyond 64 bits is null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm.tables import stored

SHIFT, GRID = 1_000_000, 64
BLOCK_ROWS = 4096
#: Entries of the fit list that one task of a pass reads.
TASK_ENTRIES = 1 << 21
#: Eigenvalues below this share of the largest are zero to rounding.
ZERO = 1e-12


def grid(vectors: np.ndarray) -> np.ndarray:
    return np.floor(GRID * vectors.astype(np.float64)).astype(np.int64) + SHIFT


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _usable(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """Rows with a finite vector of the commonest dimension, that dimension (0 without rows) and their number."""
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < 2.0**56, F.lit(False)))
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
    return (rows.filter(F.size("v") == sizes["size"]), sizes["size"], sizes["n"]) if sizes else (rows, 0, 0)


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """(v): each distinct x vector once, less the shift, in as few bytes an entry as it needs."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = grid(_matrix(batch.column("v"), size)) - SHIFT
            most = np.abs(x).max(axis=1) if len(x) else np.zeros(0)
            kinds = [np.int16 if m < 2**15 else np.int32 if m < 2**31 else np.int64 for m in most.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([row.astype(k).tobytes() for row, k in zip(x, kinds)], pa.binary())], names=["v"])

    return rows.select("v").mapInArrow(pack, "v binary").distinct()


def _blocks(packed: DataFrame, size: int) -> DataFrame:
    """(width, n, data): rows of one entry width, many to a block."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, list[bytes]] = {}
        for batch in batches:
            for v in batch.column("v").to_pylist():
                rows = open_.setdefault(len(v) // size, [])
                rows.append(v)
                if len(rows) * size * len(v) >= BLOCK_ROWS * size * 128:
                    yield block(open_, len(v) // size)
        for width in list(open_):
            if open_[width]:
                yield block(open_, width)

    def block(open_: dict[int, list[bytes]], width: int) -> pa.RecordBatch:
        rows = open_[width]
        open_[width] = []
        return pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([len(rows)], pa.int64()), pa.array([b"".join(rows)], pa.binary())],
                                          names=["width", "n", "data"])

    return packed.mapInArrow(gather, "width int, n long, data binary")


def _unpacked(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[np.ndarray]:
    """Blocks of x vectors as 64-bit integers."""
    for batch in batches:
        for width, data in zip(batch.column("width").to_pylist(), batch.column("data")):
            yield np.frombuffer(data.as_buffer(), f"<i{width}").reshape(-1, size).astype(np.int64) + SHIFT


class FitList:
    """The distinct x vectors of a table with their number, exact sums, and passes over them."""

    def __init__(self, rows: DataFrame, size: int, n: int):
        self.size = size
        # Every pass is a task per part: as many parts as there are entries for, not as many as a shuffle happens to have.
        self.blocks = stored(_blocks(_packed(rows, size).coalesce(max(1, math.ceil(n * size / TASK_ENTRIES))), size))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = 0, [0] * size
            for x in _unpacked(batches, size):
                n += len(x)
                # Halves of 32 bits cannot overflow within a block.
                high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
                total = [t + (h << 32) + b for t, h, b in zip(total, high.tolist(), low.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, size), pa.int32()), pa.array([Decimal(v) for v in [n, *total]], pa.decimal128(38, 0))],
                                             names=["cell", "value"])

        sums = self.blocks.mapInArrow(add, "cell int, value decimal(38,0)").groupBy("cell").agg(F.sum("value").alias("value")).collect()
        found = {r["cell"]: int(r["value"]) for r in sums}
        self.n, self.sums = found.get(-1, 0), [found.get(i, 0) for i in range(size)]
        # The whole part and the rest, so that no digit of the mean is lost where x itself is large.
        self.base = np.array([s // self.n for s in self.sums], np.int64) if self.n else np.zeros(size, np.int64)
        self.rest = np.array([s % self.n / self.n for s in self.sums]) if self.n else np.zeros(size)

    def summed(self, width: int, height: int, value) -> np.ndarray:
        """Sum over all blocks of ``value(centred rows)``, a matrix of this shape."""
        size, base, rest = self.size, self.base, self.rest

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((height, width))
            for x in _unpacked(batches, size):
                total += value((x - base).astype(np.float64) - rest)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

        def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return a + b

        # One matrix a task; with many tasks they are added up in rounds before the driver sees them.
        parts = self.blocks.mapInArrow(run, "total binary").rdd.map(lambda r: np.frombuffer(r["total"]))
        return parts.treeReduce(add).reshape(height, width)

    def times(self, q: np.ndarray) -> np.ndarray:
        """Covariance times a thin block: one pass."""
        return self.summed(q.shape[1], self.size, lambda z: z.T @ (z @ q)) / self.n

    def trace(self) -> float:
        return float(self.summed(1, self.size, lambda z: (z**2).sum(axis=0)[:, None]).sum() / self.n)


def lanczos_bounds(times, size: int, steps: int, rng: np.random.Generator) -> tuple[float, float]:
    """Values below and above which (almost) no eigenvalue lies."""
    q, before, beta = rng.standard_normal((size, 1)), np.zeros((size, 1)), 0.0
    q /= np.linalg.norm(q)
    basis, diagonal, off = [q], [], []
    for _ in range(min(steps, size)):
        w = times(q) - beta * before
        diagonal.append(float((q.T @ w).item()))
        w -= diagonal[-1] * q
        for b in basis:
            w -= b @ (b.T @ w)
        beta = float(np.linalg.norm(w))
        if beta <= ZERO * max(map(abs, diagonal)):
            beta = 0.0
            break
        off.append(beta)
        before, q = q, w / beta
        basis.append(q)
    k = len(diagonal)
    t = np.diag(diagonal) + np.diag(off[:k - 1], 1) + np.diag(off[:k - 1], -1)
    values, vectors = np.linalg.eigh(t)
    errors = beta * np.abs(vectors[-1])
    return max(0.0, float(values[0] - 2 * errors[0])), float(values[-1] + errors[-1])


def chebyshev_filter(times, q: np.ndarray, aq: np.ndarray, degree: int, low: float, cut: float, top: float) -> np.ndarray:
    """Polynomial of the matrix applied to ``q``, of one at ``top`` and small between ``low`` and ``cut``.

    ``aq`` is the matrix times ``q``, which the Rayleigh-Ritz step before knows already.
    """
    half, centre = (cut - low) / 2, (cut + low) / 2
    sigma = first = half / (top - centre)
    last, now = q, (aq - centre * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        last, now = now, (times(now) - centre * now) * (2 * after / half) - last * (sigma * after)
        sigma = after
    return now


@dataclass
class Spectrum:
    values: np.ndarray
    vectors: np.ndarray
    residual: float
    passes: int


def leading_eigenvectors(times, size: int, wanted: int, *, guard: int = 32, steps: int = 10, tolerance: float = 5e-14, rounds: int = 60, seed: int = 1) -> Spectrum:
    """Leading eigenpairs of a positive semidefinite matrix that is known by its products with thin blocks.

    ``tolerance`` bounds the residual of each pair, relative to the largest eigenvalue.
    """
    rng = np.random.default_rng(seed)
    passes = 0

    def counted(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return times(q)

    def ritz(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, _ = np.linalg.qr(q / np.maximum(np.linalg.norm(q, axis=0), 1e-300))
        q, _ = np.linalg.qr(q)
        aq = counted(q)
        small = q.T @ aq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        turn = turn[:, ::-1]
        return values[::-1], q @ turn, aq @ turn

    wanted = min(wanted, size)
    width = min(size, wanted + guard)
    low, high = lanczos_bounds(counted, size, steps, rng)
    values, q, aq = ritz(rng.standard_normal((size, width)))
    best, stale = np.inf, 0
    for _ in range(rounds):
        residual = float(np.linalg.norm(aq - q * values, axis=0)[:wanted].max(initial=0.0) / max(values[0], 1e-300))
        stale = stale + 1 if residual > best / 2 else 0
        best = min(best, residual)
        # Rounding may leave the residual a little above the tolerance; then it no longer falls.
        if width == size or values[0] <= 0 or residual <= tolerance or (residual <= 100 * tolerance and stale > 2):
            if width == size or values[0] <= 0:
                break
            probe = rng.standard_normal((size, min(4, size - width)))
            probe -= q @ (q.T @ probe)
            cut = min(max(float(values[-1]), low + 1e-3 * (high - low)), high)
            if high > cut > low:
                probe = chebyshev_filter(counted, probe, counted(probe), 4, low, cut, high)
                probe -= q @ (q.T @ probe)
            probe, _ = np.linalg.qr(probe)
            missed = np.linalg.eigvalsh(probe.T @ counted(probe))[-1]
            if missed <= values[wanted - 1] * (1 + 1e-9) + tolerance * values[0]:
                break
            values, q, aq = ritz(np.concatenate([q[:, :width - probe.shape[1]], probe], axis=1))
            best, stale = np.inf, 0
            continue
        cut = max(float(values[-1]), low + 1e-3 * (high - low))
        top = max(float(values[0]), cut * (1 + 1e-9), cut + 1e-300)
        # The degree grows with the block's quality: columns of small eigenvalues must not drown in the large ones.
        half, centre = (cut - low) / 2, (cut + low) / 2
        growth = math.acosh(max(1.0, (top - centre) / half)) - math.acosh(max(1.0, (float(values[wanted - 1]) - centre) / half))
        degree = int(min(12, max(2, math.log(1e9) / max(growth, 1e-3))))
        values, q, aq = ritz(chebyshev_filter(counted, q, aq, degree, low, cut, top))
    return Spectrum(values[:wanted], q[:, :wanted], residual, passes)


def _moments(white: np.ndarray) -> np.ndarray:
    """Cross products of whitened rows, and their sums in a last row."""
    return np.concatenate([white.T @ white, white.sum(axis=0)[None]])


def whiten(embeddings: DataFrame, *, key: str = "vec_id", vector: str = "embedding", components: int = 16, **settings: float) -> DataFrame:
    """Per remaining row and component: key, component, n, deviation, whitened, explained and identity_error."""
    rows, size, count = _usable(embeddings.select(F.col(key).alias("key"), F.col(vector).alias("v")))
    kind = dict(rows.dtypes)["key"]
    schema = f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = FitList(rows, size, count) if size else None
    if fit is None or not fit.n:
        return embeddings.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    trace = fit.trace()
    found = leading_eigenvectors(fit.times, size, components, **settings)
    k = int((found.values > ZERO * max(trace, 1e-300)).sum())
    values, scaled = found.values[:k], found.vectors[:, :k] / np.sqrt(found.values[:k])
    error = 0.0
    if k:
        moments = fit.summed(k, k + 1, lambda z: _moments(z @ scaled)) / fit.n
        spread = moments[:k] - np.outer(moments[k], moments[k])
        error = float(np.abs(spread - np.eye(k)).max())
    n, sums, base, rest = fit.n, fit.sums, fit.base, fit.rest

    def deviations(x: np.ndarray) -> pa.Array:
        """Sum of squares of n * x - S; with Python's integers where 64 bits might not do."""
        far = int(np.abs(x - base).max(initial=0)) + 1
        if far * n < 2**31 / math.isqrt(size + 1):
            return pa.array((((x - base) * n - np.array([s - int(b) * n for s, b in zip(sums, base)])) ** 2).sum(axis=1))
        exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
        return pa.array([v if v < 2**63 else None for v in exact], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = grid(_matrix(batch.column("v"), size))
            m = len(x)
            if not m or not k:
                continue
            white = ((x - base).astype(np.float64) - rest) @ scaled
            row = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n)),
                 deviations(x).take(pa.array(row)), pa.array(white.ravel()), pa.array(np.tile(values / trace, m)), pa.array(np.full(m * k, error))],
                names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
