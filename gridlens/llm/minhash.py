"""Near-duplicate documents by MinHash bands and sequential Bayesian verification.

* A document is the set of its word shingles; equal sets form a class, and everything after that is done once a class.
* Bands of MinHash values deal classes into buckets; a pair is a candidate if it shares a bucket.  With 40 bands of 5
  values a pair at a similarity of 0.8 shares none with probability 1.2e-7, a closer one more rarely.
* Signatures of a candidate pair are compared batch by batch.  After each batch the posterior of the similarity (uniform
  prior, matches so far) gives the probability that it reaches the threshold; the pair is dropped once that is below
  ``miss``.  What survives all batches is verified on the full sets, so every link is exact.
* Buckets are worked on without spelling out their pairs.  Members are compared with two of them at first, each class
  with the one it shares most bands with before the others; what is linked counts as one.  Members of a bucket that are
  still in different components are then compared and verified in blocks of bounded size, each pair in the first bucket
  that it shares; only links become rows.

Defined results: a missing or empty text has no shingles and is linked with nothing; fewer words than the shingle size
are one shingle; repeated rows are each returned.  Missing ids are returned as they are and never name a component
unless all its ids are missing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm import text_hash as th
from gridlens.llm.components import connected_components
from gridlens.llm.ngram_join import Sets
from gridlens.llm.tables import bitmap, few_tasks, in_bitmap, stored, written

BUCKET_BITS, CLASS_BITS = 25, 24
#: Members of a bucket that are compared with each other at once.
BLOCK = 512


def hash_functions(count: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Factors and offsets of the functions x -> a x + b modulo 2^32, bijections that order shingles at random."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**32, count, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, count, dtype=np.uint32)


def signatures(hashes: np.ndarray, bounds: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sixteen bits of the least value of every function over every (non-empty) set: one row per set."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(functions[0]), len(bounds) - 1), np.uint16)
    buffer = np.empty_like(x)
    for i, (a, b) in enumerate(zip(*functions)):
        np.multiply(x, a, out=buffer)
        np.add(buffer, b, out=buffer)
        least = np.minimum.reduceat(buffer, bounds[:-1])
        out[i] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return np.ascontiguousarray(out.T)


def band_keys(rows: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit name per set and band."""
    values = rows.reshape(len(rows), bands, -1).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), values.shape[:2])
    for r in range(values.shape[2]):
        key = th.mix(key * np.uint64(th.BASE) + values[:, :, r], 21)
    return key


def least_matches(total: int, batch: int, percent: int, miss: float) -> list[tuple[int, int]]:
    """(values compared, least matches to go on) after each batch.

    With m of n matches and a uniform prior the similarity has a Beta(m + 1, n - m + 1) posterior, which exceeds t with
    the probability that n + 1 trials of chance t give m successes at most.
    """
    t, limits = percent / 100, []
    for n in [*range(batch, total, batch), total]:
        below, m = 0.0, 0
        while m <= n:
            below += math.comb(n + 1, m) * t**m * (1 - t)**(n + 1 - m)
            if below >= miss:
                break
            m += 1
        limits.append((n, m))
    return limits


def surviving(a: np.ndarray, b: np.ndarray, limits: list[tuple[int, int]]) -> np.ndarray:
    """Which pairs of signature rows pass every batch; rows that fail one are not compared further."""
    alive, matches, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, least in limits:
        matches = matches + (a[alive, done:n] == b[alive, done:n]).sum(axis=1)
        keep = matches >= least
        alive, matches, done = alive[keep], matches[keep], n
    return alive


def unpacked(data: bytes) -> np.ndarray:
    """Values of six bytes each."""
    parts = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return np.concatenate([parts, np.zeros((len(parts), 2), np.uint8)], axis=1).view(np.uint64).ravel()


def overlaps(packed: list[bytes], left: np.ndarray, right: np.ndarray, limit: int = 1 << 22) -> np.ndarray:
    """Sizes of the intersections of sets ``left`` with sets ``right``; ``left`` is in groups of equal numbers."""
    common = np.zeros(len(left), np.int64)
    sizes = np.array([len(p) // 6 for p in packed])
    at = 0
    while at < len(left):
        same = int(np.searchsorted(left, left[at], side="right"))
        end = at + max(1, int(np.searchsorted(np.cumsum(sizes[right[at:same]]), limit)))
        own = unpacked(packed[left[at]])
        others = unpacked(b"".join(packed[r] for r in right[at:end]))
        place = np.minimum(np.searchsorted(own, others), len(own) - 1)
        starts = np.cumsum(sizes[right[at:end]]) - sizes[right[at:end]]
        common[at:end] = np.add.reduceat((own[place] == others).astype(np.int64), starts)
        at = end
    return common


def _rows(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.array([np.frombuffer(x.as_buffer(), kind) for x in column], dtype=kind).reshape(-1, width)


class _NearDuplicates:
    """One run over one document table."""

    def __init__(self, docs: DataFrame, size: int, percent: int, bands: int, band_rows: int, batch: int, miss: float):
        self.docs, self.size, self.percent, self.bands = docs, size, percent, bands
        self.values = bands * band_rows
        self.limits = least_matches(self.values, batch, percent, miss)
        heads = written(self._heads())
        self.heads = heads.select("key", "n", "class")
        first = heads.filter("signature is not null")
        #: No table below has more classes; it bounds how many tasks they are written by.
        self.classes = first.count()
        first = first.groupBy("class").agg(F.first("n").alias("n"), F.first("signature").alias("signature"))
        self.signatures = written(few_tasks(first, self.classes, 5000))

    def _heads(self) -> DataFrame:
        """(key, n, class, signature) of every document; only where a task first meets a class with its signature."""
        rows = self.docs.select("key", "text")
        size, values = self.size, self.values

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            powers, seen, functions = th.Powers(), set(), hash_functions(values)
            for batch in batches:
                for piece in th.pieces(batch.column("text")):
                    sets = Sets(piece, powers, size)
                    classes = sets.classes()
                    fresh = np.array([n > 0 and c not in seen and not seen.add(c) for c, n in zip(classes.tolist(), sets.sizes.tolist())], bool)
                    signature: list[bytes | None] = [None] * piece.count
                    if fresh.any():
                        take = fresh[sets.texts]
                        bounds = np.concatenate([[0], np.cumsum(sets.sizes[fresh])])
                        made = signatures(sets.hashes[take], bounds, functions)
                        for i, row in zip(np.flatnonzero(fresh).tolist(), made):
                            signature[i] = row.tobytes()
                    part = batch.slice(piece.first, piece.count)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("key"), pa.array(sets.sizes, pa.int64()), pa.array(classes), pa.array(signature, pa.binary())],
                        names=["key", "n", "class", "signature"])

        return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, n long, class long, signature binary")

    def _banded(self, shared: bytes | None) -> DataFrame:
        """(bucket, band, class, n): every class once a band; with ``shared``, only where the bucket may have others."""
        bands, values = self.bands, self.values
        known = None if shared is None else self.docs.sparkSession.sparkContext.broadcast(shared)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = None if known is None else np.frombuffer(known.value, np.int64)
            for batch in batches:
                keys = band_keys(_rows(batch.column("signature"), np.uint16, values), bands).ravel()
                at = np.arange(len(keys)) if bits is None else np.flatnonzero(in_bitmap(bits, keys))
                row = pa.array(at // bands)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(th.signed(keys[at])), pa.array((at % bands).astype(np.int32)), *[batch.column(c).take(row) for c in ("class", "n")]],
                    names=["bucket", "band", "class", "n"])

        return self.signatures.mapInArrow(run, "bucket long, band int, class long, n long")

    def lists(self) -> DataFrame:
        """(bucket, band, class, n) of buckets with several classes."""
        rows = self.classes * self.bands
        shared = self._banded(None).groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("bucket")
        shared = stored(few_tasks(shared, rows // 2))
        return stored(few_tasks(self._banded(bitmap(shared, "bucket", BUCKET_BITS)).join(shared, "bucket", "left_semi"), rows))

    def sets(self, lists: DataFrame) -> DataFrame:
        """(class, values): sorted shingles of the listed classes, six bytes each; other classes' signatures are done with."""
        active = stored(few_tasks(lists.select("class").distinct(), self.classes))
        self.classes = active.count()
        self.signatures = written(few_tasks(self.signatures.join(active, "class", "left_semi"), self.classes, 5000))
        wanted = self.docs.sparkSession.sparkContext.broadcast(bitmap(active, "class", CLASS_BITS))
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            powers, seen, bits = th.Powers(), set(), np.frombuffer(wanted.value, np.int64)
            for batch in batches:
                for piece in th.pieces(batch.column("text")):
                    sets = Sets(piece, powers, size)
                    classes = sets.classes()
                    may = in_bitmap(bits, classes.view(np.uint64)) & (sets.sizes > 0)
                    names, values = [], []
                    for i in np.flatnonzero(may).tolist():
                        if (name := int(classes[i])) not in seen:
                            seen.add(name)
                            own = np.sort(sets.hashes[sets.bounds[i]:sets.bounds[i + 1]]) >> np.uint64(16)
                            names.append(name)
                            values.append(own.view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
                    if names:
                        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(values, pa.binary())], names=["class", "values"])

        found = self.docs.select("text").mapInArrow(run, "class long, values binary")
        found = found.join(active, "class", "left_semi").groupBy("class").agg(F.first("values").alias("values"))
        return written(few_tasks(found, self.classes, 2000))

    def pruned(self, pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b, na, nb) those that the sequential comparison lets pass."""
        values, limits = self.values, self.limits
        side = lambda c: self.signatures.select(F.col("class").alias(c), F.col("signature").alias(f"s{c}"))
        met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                alive = surviving(*[_rows(batch.column(c), np.uint16, values) for c in ("sa", "sb")], limits)
                yield batch.select(["a", "b", "na", "nb"]).take(pa.array(alive))

        return met.mapInArrow(run, "a long, b long, na long, nb long")

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Of the pairs (a, b, na, nb) those whose full sets reach the threshold.

        The set of ``b`` travels to ``a``, so a class in very many pairs sends its own set once and is split by Spark.
        """
        percent = self.percent
        side = lambda c: sets.select(F.col("class").alias(c), F.col("values").alias(f"v{c}"))
        met = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "va", "vb")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                common = np.array([np.isin(unpacked(x.as_buffer()), unpacked(y.as_buffer()), assume_unique=True, kind="sort").sum()
                                   for x, y in zip(batch.column("va"), batch.column("vb"))], np.int64)
                n = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb")]
                linked = np.flatnonzero(100 * common >= percent * (n[0] + n[1] - common))
                yield batch.select(["a", "b"]).take(pa.array(linked))

        return met.mapInArrow(run, "a long, b long")

    def _pairs(self, x: str, y: str) -> list:
        """Columns a < b, na, nb of two structs (class, n)."""
        low = F.col(f"{x}.class") < F.col(f"{y}.class")
        pick = lambda c, first: F.when(low == first, F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}"))
        return [pick("class", F.lit(True)).alias("a"), pick("class", F.lit(False)).alias("b"),
                pick("n", F.lit(True)).alias("na"), pick("n", F.lit(False)).alias("nb")]

    def _near(self, low: str, high: str):
        return F.least(low, high) * 100 >= F.greatest(low, high) * self.percent

    def _rooted(self, lists: DataFrame, roots: DataFrame | None) -> DataFrame:
        if roots is None:
            return lists.withColumn("root", F.col("class"))
        return lists.join(roots, F.col("class") == F.col("node"), "left").select("bucket", "band", "class", "n", F.coalesce("root", "class").alias("root"))

    def _mixed(self, rows: DataFrame) -> DataFrame:
        """Buckets whose members lie in different components, with the members of smallest and largest name."""
        member = F.struct("class", "n", "root")
        return rows.groupBy("bucket").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.min(member).alias("x"), F.max(member).alias("y"),
                                          F.count(F.lit(1)).alias("members")).filter("_low <> _high").drop("_low", "_high")

    def with_pivots(self, lists: DataFrame, roots: DataFrame | None, best: bool) -> DataFrame:
        """Pairs of bucket members with one of two members; with ``best``, one pair a class, of most shared buckets."""
        rows = self._rooted(lists, roots)
        met = rows.withColumn("z", F.struct("class", "n", "root")).join(self._mixed(rows), "bucket")
        ends = ["x"] if best else ["x", "y"]
        met = met.select("z", F.explode(F.array(*ends)).alias("x")).filter("x.root <> z.root").filter(self._near("x.n", "z.n"))
        if best:
            counted = met.groupBy("z", "x").agg(F.count(F.lit(1)).alias("shared"))
            met = counted.groupBy("z").agg(F.max(F.struct("shared", "x")).alias("most")).select("z", F.col("most.x").alias("x"))
        return met.select(*self._pairs("x", "z")).distinct()

    def in_blocks(self, lists: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
        """Links (a, b) between different components of buckets that are still mixed, besides those of the two pivots.

        Most members of a bucket usually lie in one component and need no comparison with each other.  The others are cut
        into parts, and so are all members; every part of the others meets every part of all in a block of its own.
        """
        rows = self._rooted(lists, roots)
        ends = rows.groupBy("bucket").agg(F.min("class").alias("_x"), F.max("class").alias("_y"), F.min("root").alias("_low"), F.max("root").alias("_high"))
        rows = rows.join(ends.filter("_low <> _high"), "bucket").filter("class <> _x and class <> _y").drop("_x", "_y", "_low", "_high")
        per_root = rows.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("m"))
        main = per_root.groupBy("bucket").agg(F.max(F.struct("m", "root")).alias("main"), F.sum("m").alias("members"))
        parts = lambda members: F.ceil(members / BLOCK).cast("int")
        main = main.filter("main.m < members").select("bucket", F.col("main.root").alias("_main"), parts(F.col("members") - F.col("main.m")).alias("rest"),
                                                      parts(F.col("members")).alias("all"))
        met = rows.join(main, "bucket").withColumn("h", F.xxhash64("class"))
        other = F.col("root") != F.col("_main")
        # As one of the others a member goes to all blocks of its row, as one of all to those of its column.
        row = F.transform(F.when(other, F.sequence(F.lit(0), F.col("all") - 1)).otherwise(F.array().cast("array<int>")),
                          lambda k: F.struct(F.lit(0).alias("side"), F.pmod("h", "rest").cast("int").alias("i"), k.alias("j")))
        column = F.transform(F.sequence(F.lit(0), F.col("rest") - 1), lambda k: F.struct(F.lit(1).alias("side"), k.alias("i"), F.pmod("h", "all").cast("int").alias("j")))
        dealt = met.select("bucket", "band", "class", "n", "root", other.cast("int").alias("other"), F.explode(F.concat(row, column)).alias("at"))
        dealt = dealt.join(self.signatures.select("class", "signature"), "class").join(sets, "class")
        dealt = dealt.select("bucket", "at.i", "at.j", "at.side", "other", "band", "class", "n", "root", "signature", "values")
        dealt = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side")
        values, bands, limits, percent = self.values, self.bands, self.limits, self.percent
        columns = ("bucket", "i", "j", "side", "other", "band", "class", "n", "root")

        def solve(rows: np.ndarray, signature: np.ndarray, packed: list[bytes]) -> list[np.ndarray]:
            side, other, band, name, n, root = rows[:, 3:].T
            cut = int(np.searchsorted(side, 1))
            left, right = np.repeat(np.arange(cut), len(rows) - cut), np.tile(np.arange(cut, len(rows)), cut)
            # Two of the others meet twice.
            fits = (other[right] == 0) | (name[left] < name[right])
            fits &= (root[left] != root[right]) & (100 * np.minimum(n[left], n[right]) >= percent * np.maximum(n[left], n[right]))
            left, right = left[fits], right[fits]
            alive = surviving(signature[left], signature[right], limits)
            left, right = left[alive], right[alive]
            equal = (signature[left] == signature[right]).reshape(len(left), bands, values // bands).all(axis=2)
            first = equal.argmax(axis=1) == band[left]
            left, right = left[first], right[first]
            common = overlaps(packed, left, right)
            linked = 100 * common >= percent * (n[left] + n[right] - common)
            a, b = name[left[linked]], name[right[linked]]
            return [np.minimum(a, b), np.maximum(a, b)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, marks, packed = np.zeros((0, len(columns)), np.int64), np.zeros((0, values), np.uint16), []
            for batch in _with_end(batches):
                if batch is not None:
                    held = np.concatenate([held, np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns], axis=1)])
                    marks = np.concatenate([marks, _rows(batch.column("signature"), np.uint16, values)])
                    packed += batch.column("values").to_pylist()
                if not len(held):
                    continue
                new = np.flatnonzero((held[1:, :3] != held[:-1, :3]).any(axis=1)) + 1
                starts = np.concatenate([[0], new])
                ends = np.append(new, len(held))
                whole = len(starts) - (batch is not None)
                found = [solve(held[s:e], marks[s:e], packed[s:e]) for s, e in zip(starts[:whole], ends[:whole]) if e - s > 1]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["a", "b"])
                cut = starts[whole] if batch is not None else len(held)
                held, marks, packed = held[cut:], marks[cut:], packed[cut:]

        return dealt.mapInArrow(run, "a long, b long").distinct()

    def roots(self) -> DataFrame:
        """(node, root) of every class that is linked with another one."""
        lists = self.lists()
        sets = self.sets(lists)
        best = stored(few_tasks(self.with_pivots(lists, None, True), self.classes))
        links = stored(self.verified(self.pruned(best), sets))
        # Two steps along the links name enough of the components to skip most further pairs.
        step = links.groupBy("b").agg(F.min("a").alias("a"))
        step = step.alias("p").join(step.alias("q"), F.col("p.a") == F.col("q.b"), "left").select(
            F.col("p.b").alias("node"), F.coalesce("q.a", "p.a").alias("root"))
        step = stored(few_tasks(step, self.classes))
        pairs = self.with_pivots(lists, step, False).join(best, ["a", "b"], "left_anti")
        links = links.union(stored(self.verified(self.pruned(pairs), sets)))
        roots = connected_components(links, "a", "b")
        further = stored(self.in_blocks(lists, roots, sets))
        late = further.count()
        for c in ("a", "b"):
            ends = roots.select(F.col("node").alias(c), F.col("root").alias(f"_{c}"))
            further = further.join(ends, c, "left").withColumn(f"_{c}", F.coalesce(f"_{c}", c))
        # Few components are joined late, so only these go through another contraction.
        joined = connected_components(further.select("_a", "_b"), "_a", "_b", late).select(F.col("node").alias("root"), F.col("root").alias("_joined"))
        known = roots.unionByName(joined.select(F.col("root").alias("node"), "root").join(roots, "node", "left_anti"))
        return known.join(joined, "root", "left").select("node", F.coalesce("_joined", "root").alias("root"))


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 4, percent: int = 80, bands: int = 40,
                    band_rows: int = 5, batch: int = 25, miss: float = 1e-8) -> DataFrame:
    """Per row: key, n_shingles, component_id (the smallest key reachable by links of ``percent`` Jaccard or more) and kept.

    A row is kept if its key names its component.  A candidate pair at the threshold is pruned with a probability of about
    ``miss`` a batch of signature values.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    run = _NearDuplicates(rows, size, percent, bands, band_rows, batch, miss)
    heads = run.heads.filter("n > 0")
    named = heads.groupBy("class").agg(F.min("key").alias("first")).join(run.roots(), F.col("class") == F.col("node"), "left")
    named = named.select("class", "first", F.coalesce("root", "class").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    full = heads.join(named.join(smallest, "root").select("class", "component_id"), "class").select("key", "n", "component_id")
    none = run.heads.filter("n = 0").select("key", "n", F.col("key").alias("component_id"))
    return full.union(none).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id",
                                   F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
