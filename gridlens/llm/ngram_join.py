"""Set-similarity join of documents by vertical partitioning.

A document is the set of its word shingles.  One global order over all shingles puts rare ones first: a counting
sketch of fixed size, filled from every document, gives the order's levels, and the hash decides within a level.

* Equal sets form a class; everything after that is done once per class.
* Classes whose sets can reach the threshold share one of the rarest ``n - ceil(0.8 n) + 1`` shingles of either.
  Shingles of such prefixes that two classes share are found by a map-side aggregate, so a shingle of a third of
  all documents is a handful of rows.
* A class keeps the parities of its hashes' remainders, one or two bits a shingle.  Where two classes' parities differ their
  shingles do, so most pairs below the threshold are dropped without their sets being met.
* The order is cut into fragments.  For every other pair each fragment's overlap is counted by itself, in its
  own row and task, and the partial counts are added up per pair.  A class in many pairs is spread over fragments.
* Components need not see all pairs of a group.  In each shared list, members are first compared with one class
  that shares most of its prefix; what is linked then counts as one.  Only classes of one list that are still in
  different components are compared with each other in the end, all of them, so no link between components is lost.

Defined results: a missing or empty text has no shingles and is linked with nothing; fewer words than the shingle
size are one shingle; repeated rows are each returned.  Missing ids are returned as they are and never name a
component unless all its ids are missing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm import text_hash as th
from gridlens.llm.components import connected_components
from gridlens.llm.tables import bitmap, in_bitmap, stored

SKETCH_BITS = 20
SKETCH_BLOCKS = 64
FILTER_BITS, CLASS_BITS = 25, 22
#: Rounds of comparing list members with one of them before all that is left is compared.
STAR_ROUNDS = 1


class Sets:
    """Shingle sets of the texts of a piece, sorted by text and hash."""

    def __init__(self, piece: th.Piece, powers: th.Powers, size: int):
        words = th.words(piece, powers, th.WHITE)
        owner = th.owners(words.bounds)
        whole = th.grams(words.hashes, size)
        inside = owner[:len(whole)] == owner[size - 1:] if len(whole) else np.zeros(0, bool)
        hashes, texts = [whole[inside]], [owner[:len(whole)][inside]]
        counts = np.diff(words.bounds)
        for n in range(1, size):
            short = np.flatnonzero(counts == n)
            hashes.append(th.grams(words.hashes, n)[words.bounds[short]] if len(short) else np.zeros(0, np.uint64))
            texts.append(short)
        h, t = np.concatenate(hashes), np.concatenate(texts)
        order = np.lexsort((h, t))
        h, t = h[order], t[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
        self.hashes, self.texts = h[new], t[new]
        self.bounds = np.searchsorted(self.texts, np.arange(piece.count + 1))
        self.sizes = np.diff(self.bounds)

    def classes(self) -> np.ndarray:
        """One number per set, equal for equal sets; 0 for the empty set."""
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(th.mix(self.hashes, 5))])
        value = th.mix(total[self.bounds[1:]] - total[self.bounds[:-1]] + self.sizes.astype(np.uint64), 6)
        value[self.sizes == 0] = 0
        return th.signed(value)

    def parities(self) -> list[bytes]:
        """Per set a bit for every remainder of the hashes, set if an odd number of shingles has it; a power of two of them, at least the set's size."""
        bits = np.left_shift(1, np.ceil(np.log2(np.maximum(self.sizes, 64))).astype(np.int64))
        ends = np.cumsum(bits)
        at = (ends - bits)[self.texts] + (self.hashes & (bits[self.texts] - 1).astype(np.uint64)).astype(np.int64)
        odd = np.bincount(at, minlength=bits.sum()).astype(np.uint8) & 1
        packed = np.packbits(odd, bitorder="little")
        return [packed[low:high].tobytes() for low, high in zip(((ends - bits) // 8).tolist(), (ends // 8).tolist())]

    def ordered(self, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Global order key of every shingle and the permutation that sorts each text's set by it."""
        level = levels[self.hashes >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64)
        key = level << np.uint64(58) | self.hashes >> np.uint64(6)
        return key, np.lexsort((key, self.texts))


def differences(left: bytes, right: bytes) -> int:
    """How many shingles, at least, are in one of two sets only, by their parities.

    A shingle of one set alone changes one bit; the longer parities are folded to the length of the shorter ones.
    """
    x, y = np.frombuffer(left, np.uint8), np.frombuffer(right, np.uint8)
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def _heads(docs: DataFrame, size: int) -> DataFrame:
    """Per document id, set size, class and parities; besides them, with ``block`` set, parts of the counting sketch."""
    rows = docs.select("key", "text", "uid")
    kind, names = dict(rows.dtypes)["key"], ["key", "uid", "n", "class", "parities", "block", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, sketch, key_type = th.Powers(), np.zeros(1 << SKETCH_BITS, np.int64), None
        for batch in batches:
            key_type = batch.column("key").type
            sizes, classes, parities = [], [], []
            for piece in th.pieces(batch.column("text")):
                sets = Sets(piece, powers, size)
                sizes.append(sets.sizes)
                classes.append(sets.classes())
                parities.extend(sets.parities())
                slots, counts = np.unique(sets.hashes >> np.uint64(64 - SKETCH_BITS), return_counts=True)
                sketch[slots] += counts
            if sizes:
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), batch.column("uid"), pa.array(np.concatenate(sizes), pa.int64()), pa.array(np.concatenate(classes)),
                     pa.array(parities, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        if key_type is not None:
            blocks = [pa.compress(b.tobytes(), "zstd", asbytes=True) for b in np.split(sketch, SKETCH_BLOCKS)]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(SKETCH_BLOCKS, key_type), *[pa.nulls(SKETCH_BLOCKS, pa.int64())] * 3, pa.nulls(SKETCH_BLOCKS, pa.binary()),
                 pa.array(range(SKETCH_BLOCKS), pa.int32()), pa.array(blocks, pa.binary())], names=names)

    return rows.mapInArrow(run, f"key {kind}, uid long, n long, class long, parities binary, block int, counts binary")


def _sketch(parts: DataFrame) -> np.ndarray:
    """Add up the sketch parts per block; 2^SKETCH_BITS numbers reach the driver at any input size."""

    width = (1 << SKETCH_BITS) // SKETCH_BLOCKS

    def add(key: tuple, part: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for counts in part.column("counts"):
            total += np.frombuffer(pa.decompress(counts.as_buffer(), width * 8, "zstd"), np.int64)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    found = parts.groupBy("block").applyInArrow(add, "block int, counts binary").toArrow()
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    for block, counts in zip(found["block"].to_pylist(), found["counts"]):
        sketch[block * width:(block + 1) * width] = np.frombuffer(counts.as_buffer(), np.int64)
    return sketch


def pivots(sketch: np.ndarray, levels: np.ndarray, fragments: int) -> np.ndarray:
    """Order keys that cut all shingle occurrences into fragments of about equal load."""
    load = np.bincount(levels, weights=sketch, minlength=64)
    ends = np.cumsum(load)
    at = ends[-1] * np.arange(1, fragments) / fragments
    level = np.minimum(np.searchsorted(ends, at, side="right"), len(ends) - 1)
    inside = (at - (ends - load)[level]) / np.maximum(load[level], 1)
    # Hashes are even within a level, so a share of its load is a share of its key range.
    return level.astype(np.uint64) << np.uint64(58) | (np.minimum(inside, 0.999) * 2**58).astype(np.uint64)


class _Join:
    """One run over one document table."""

    def __init__(self, docs: DataFrame, size: int, percent: int, fragments: int):
        self.docs, self.size, self.percent, self.fragments = docs, size, percent, fragments
        self.spark = docs.sparkSession
        heads = stored(_heads(docs, size))
        self.heads = heads.filter("block is null").select("key", "uid", "n", "class")
        self.parities = heads.filter("n > 0").select("class", "parities")
        sketch = _sketch(heads.filter("block is not null").select("block", "counts"))
        levels = np.log2(np.maximum(sketch, 1)).astype(np.uint8)
        # A fixed number of bytes, see SKETCH_BITS.
        self.levels = self.spark.sparkContext.broadcast(levels.tobytes())
        self.cuts = pivots(sketch, levels, fragments).tolist()

    def prefixes(self, shared: bytes | None) -> DataFrame:
        """(shingle, class, n, place in the order, score) of every prefix; with ``shared``, only those whose shingle may be shared.

        The score is the part of a prefix that may be shared.  Each task returns a row once.
        """
        levels, size, percent = self.levels, self.size, self.percent
        filter_bits = None if shared is None else self.spark.sparkContext.broadcast(shared)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            powers, seen = th.Powers(), set()
            table = np.frombuffer(levels.value, np.uint8)
            bits = None if filter_bits is None else np.frombuffer(filter_bits.value, np.int64)
            for batch in batches:
                for piece in th.pieces(batch.column("text")):
                    sets = Sets(piece, powers, size)
                    if not len(sets.hashes):
                        continue
                    classes = sets.classes()
                    _, order = sets.ordered(table)
                    length = np.where(sets.sizes > 0, sets.sizes + (-percent * sets.sizes) // 100 + 1, 0)
                    place = np.arange(len(order)) - sets.bounds[sets.texts]
                    fresh = np.array([c not in seen and not seen.add(c) for c in classes.tolist()])
                    take = (place < length[sets.texts]) & fresh[sets.texts]
                    hashes, texts, places = sets.hashes[order][take], sets.texts[take], place[take]
                    score = np.zeros(len(classes), np.float32)
                    if bits is not None:
                        may = in_bitmap(bits, hashes)
                        score = np.bincount(texts, weights=may, minlength=len(classes)) / np.maximum(length, 1)
                        hashes, texts, places = hashes[may], texts[may], places[may]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(th.signed(hashes)), pa.array(classes[texts]), pa.array(sets.sizes[texts], pa.int64()),
                         pa.array(places, pa.int64()), pa.array(score[texts], pa.float32())],
                        names=["shingle", "class", "n", "place", "score"])

        return self.docs.select("text").mapInArrow(run, "shingle long, class long, n long, place long, score float")

    def lists(self) -> DataFrame:
        """Prefix rows of shingles that at least two classes hold in their prefixes.

        A class whose copies lie in different tasks counts more than once at first; its list then has one row.
        """
        shared = stored(self.prefixes(None).groupBy("shingle").agg(F.count(F.lit(1)).alias("rows"))
                        .filter("rows > 1").select("shingle"))
        rows = self.prefixes(bitmap(shared, "shingle", FILTER_BITS))
        return stored(rows.join(shared, "shingle", "left_semi").groupBy("shingle", "class")
                      .agg(*[F.max(c).alias(c) for c in ("n", "place", "score")]))

    def segments(self, pairs: DataFrame) -> DataFrame:
        """(class, fragment, values): sorted set of each class that may be in ``pairs``, cut at the pivots.

        A value is the lower six bytes of an order key, which within a fragment stand for all of it.  A class whose
        copies lie in different tasks comes more than once.
        """
        active = pairs.select(F.explode(F.array("a", "b")).alias("class"))
        wanted = self.spark.sparkContext.broadcast(bitmap(active, "class", CLASS_BITS))
        levels, size, cuts = self.levels, self.size, self.cuts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            powers, seen = th.Powers(), set()
            table, bits = np.frombuffer(levels.value, np.uint8), np.frombuffer(wanted.value, np.int64)
            edges = np.array(cuts, np.uint64)
            for batch in batches:
                for piece in th.pieces(batch.column("text")):
                    sets = Sets(piece, powers, size)
                    classes = sets.classes()
                    may = in_bitmap(bits, classes.view(np.uint64)) & (sets.sizes > 0)
                    keys = None
                    out: tuple[list, list, list] = ([], [], [])
                    for i in np.flatnonzero(may).tolist():
                        name = int(classes[i])
                        if name in seen:
                            continue
                        seen.add(name)
                        if keys is None:
                            keys, order = sets.ordered(table)
                            keys = keys[order]
                        own = keys[sets.bounds[i]:sets.bounds[i + 1]]
                        ends = [0, *np.searchsorted(own, edges), len(own)]
                        for f, (low, high) in enumerate(zip(ends, ends[1:])):
                            if high > low:
                                out[0].append(name)
                                out[1].append(f)
                                out[2].append(own[low:high].view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
                    if out[0]:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())],
                            names=["class", "fragment", "values"])

        return self.docs.select("text").mapInArrow(run, "class long, fragment int, values binary")

    def close(self, pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b, na, nb) those whose parities do not rule out that they reach the threshold.

        Parities are a few bytes against all segments of two sets, and leave few pairs below the threshold.
        """
        percent = self.percent
        active = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
        known = self.parities.join(active, "class", "left_semi").groupBy("class").agg(F.first("parities").alias("parities"))
        met = pairs
        for side in "ab":
            met = met.join(known.select(F.col("class").alias(side), F.col("parities").alias(f"p{side}")), side)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                total = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
                apart = np.array([differences(x, y) for x, y in zip(batch.column("pa").to_pylist(), batch.column("pb").to_pylist())], np.int64)
                # The common shingles are at most half of what is left of both sets.
                may = (total - apart) * (100 + percent) >= 2 * percent * total
                yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(may))

        return met.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(run, "a long, b long, na long, nb long")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b, na, nb) those that reach the threshold, by partial overlaps per fragment."""
        sides = pairs.select("a", "b", "na", "nb", F.explode(F.array("a", "b")).alias("class"))
        side = F.struct("class", "values")
        met = self.segments(pairs).join(sides, "class").groupBy("a", "b", "na", "nb", "fragment").agg(
            F.min(side).alias("left"), F.max(side).alias("right"))
        met = met.filter("left.class <> right.class").select(
            "a", "b", "na", "nb", F.col("left.values").alias("left"), F.col("right.values").alias("right"))

        def values(cell: pa.Scalar) -> np.ndarray:
            parts = np.frombuffer(cell.as_buffer(), np.uint8).reshape(-1, 6)
            return np.concatenate([parts, np.zeros((len(parts), 2), np.uint8)], axis=1).view(np.uint64).ravel()

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                partial = [len(np.intersect1d(values(x), values(y), assume_unique=True))
                           for x, y in zip(batch.column("left"), batch.column("right"))]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("a", "b", "na", "nb")],
                                                  pa.array(partial, pa.int64())], names=["a", "b", "na", "nb", "partial"])

        partial = met.mapInArrow(count, "a long, b long, na long, nb long, partial long")
        total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("partial").alias("common"))
        return total.filter(F.col("common") * 100 >= self.percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")

    def near(self, low: str, high: str):
        """Whether two set sizes can reach the threshold at all."""
        return (F.least(low, high) * 100 >= F.greatest(low, high) * self.percent)

    def roots(self) -> DataFrame:
        """(class, root) of every class that is linked with another one."""
        lists = self.lists()
        done, links, roots = None, None, None
        for step in range(STAR_ROUNDS + 1):
            rows = lists
            if roots is not None:
                rows = rows.join(roots, F.col("class") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class"))
            else:
                rows = rows.withColumn("root", F.col("class"))
            rows = rows.select("shingle", "class", "n", "place", "score", "root")
            mixed = rows.groupBy("shingle").agg(
                F.min("root").alias("low"), F.max("root").alias("high"),
                F.max(F.struct("score", "class", "n", "place", "root")).alias("first")).filter("low <> high")
            if step < STAR_ROUNDS:
                met = rows.join(mixed.select("shingle", "first"), "shingle").select(
                    F.struct("first.class", "first.n", "first.place", "first.root").alias("x"),
                    F.struct("class", "n", "place", "root").alias("y"))
            else:
                row = F.struct("class", "n", "place", "root")
                left = rows.join(mixed.select("shingle"), "shingle", "left_semi").select("shingle", row.alias("x"))
                met = left.join(rows.select("shingle", row.alias("y")), "shingle").filter("x.class < y.class")
            # What stands before the first common shingle of two prefixes is not shared, so behind it there has to be
            # enough.  The row of the first common shingle of a pair that is linked always passes.
            most = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
            enough = most * (100 + self.percent) >= self.percent * (F.col("x.n") + F.col("y.n"))
            met = met.filter("x.root <> y.root").filter(self.near("x.n", "y.n") & enough).select(
                F.when(F.col("x.class") < F.col("y.class"), F.col("x")).otherwise(F.col("y")).alias("x"),
                F.when(F.col("x.class") < F.col("y.class"), F.col("y")).otherwise(F.col("x")).alias("y"))
            pairs = met.select(F.col("x.class").alias("a"), F.col("y.class").alias("b"), F.col("x.n").alias("na"),
                               F.col("y.n").alias("nb")).distinct()
            if done is not None:
                pairs = pairs.join(done, ["a", "b"], "left_anti")
            pairs = stored(pairs)
            close = stored(self.close(pairs))
            if links is not None and close.isEmpty():
                break
            found = stored(self.links(close))
            done = pairs.select("a", "b") if done is None else done.union(pairs.select("a", "b"))
            links = found if links is None else links.union(found)
            roots = connected_components(links, "a", "b")
        return roots.select(F.col("node").alias("class"), "root")


def similarity_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80,
                      fragments: int = 8, carry: bool = False) -> DataFrame:
    """Per row: key, n_shingles and component_id, the smallest key reachable by links of ``percent`` Jaccard or more.

    ``carry`` adds ``_uid``, a hash of key and text, and ``_root``, a name of the component that missing or repeated
    keys do not blur (null without shingles).
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    join = _Join(rows.withColumn("uid", F.xxhash64("key", "text")), size, percent, fragments)
    roots = join.roots()
    heads = join.heads
    classes = heads.filter("n > 0").groupBy("class").agg(F.min("key").alias("first"))
    named = classes.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "root").select("class", "component_id", "root")
    full = heads.filter("n > 0").join(named, "class").select("key", "uid", "n", "component_id", "root")
    none = heads.filter("n = 0").select("key", "uid", "n", F.col("key").alias("component_id"), F.lit(None).cast("long").alias("root"))
    result = full.union(none).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id",
                                     F.col("uid").alias("_uid"), F.col("root").alias("_root"))
    return result if carry else result.drop("_uid", "_root")
