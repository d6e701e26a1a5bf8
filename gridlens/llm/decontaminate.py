"""Benchmark decontamination by winnowing.

Of every ``span`` consecutive words the smallest hash among its ``gram``-word strings is kept, in documents and in
items alike.  Two texts that share ``span`` words keep the same string of them, so every shared span has a common
fingerprint; from there the words on both sides are compared and the match is extended.  Items shorter than a span
are looked up whole, by the hash of as many words as they have.

Documents are read once.  A bit set of fixed size over the items' fingerprints lets tasks drop nearly everything else
before the join; what passes wrongly fails the comparison of words.  A fingerprint in a third of all documents is a
skewed key of a plain equi-join with a small side, which adaptive execution splits.

Defined results: a missing text has no words; items without words are not counted; an item id that occurs twice is one
item; an item without an id hits words but is not counted or listed; repeated rows are each returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm import text_hash as th
from gridlens.llm.substring_dedup import _sliding_min
from gridlens.llm.tables import bitmap, in_bitmap, stored

FILTER_BITS = 23
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_MARK = "array<struct<print: long, size: int, at: int, left: int, words: string>>"


def _winnowed(words: th.Words, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the kept strings: leftmost smallest of each span inside one text."""
    hashes = th.grams(words.hashes, gram)
    if len(words.hashes) < span:
        return np.zeros(0, np.int64), hashes[:0]
    packed = hashes & np.uint64(0xFFFFFFFF00000000) | np.arange(len(hashes), dtype=np.uint64)
    kept = (_sliding_min(packed, span - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    owner = th.owners(words.bounds)
    inside = owner[:len(kept)] == owner[span - 1:]
    at = np.unique(kept[inside])
    return at, hashes[at]


def _marks(rows: DataFrame, span: int, gram: int, wanted: bytes | None, short: tuple[int, ...]) -> DataFrame:
    """(key, uid, n_words, marks): fingerprints of every text with the words around them.

    With ``wanted``, those that may be in that bit set, and all strings of the lengths in ``short`` that may be;
    without, also the whole of a text that is shorter than a span.
    """
    kind = dict(rows.dtypes)["key"]
    held = None if wanted is None else rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = th.Powers()
        bits = None if held is None else np.frombuffer(held.value, np.int64)
        for batch in batches:
            sizes, marks = [], []
            for piece in th.pieces(batch.column("text")):
                words = th.words(piece, powers, th.NOT_ALNUM)
                counts = np.diff(words.bounds)
                at, prints = _winnowed(words, span, gram)
                found = [(at, prints, 0)]
                if bits is None:
                    for n in range(1, span):
                        whole = words.bounds[:-1][counts == n]
                        if len(whole):
                            found.append((whole, th.grams(words.hashes, n)[whole], n))
                else:
                    owner = th.owners(words.bounds)
                    for n in short:
                        all_prints = th.grams(words.hashes, n)
                        inside = np.flatnonzero(owner[:len(all_prints)] == owner[n - 1:]) if len(all_prints) else []
                        found.append((np.array(inside, np.int64), all_prints[inside], n))
                    found = [(a[m], p[m], n) for a, p, n in found for m in [in_bitmap(bits, p)]]
                rows_of: list[list[dict]] = [[] for _ in range(piece.count)]
                for places, values, n in found:
                    texts = np.searchsorted(words.bounds, places, side="right") - 1
                    for a, value, t in zip(places.tolist(), th.signed(values).tolist(), texts.tolist()):
                        low, high = (a, a + n) if n else (max(a - (span - gram), words.bounds[t]),
                                                          min(a + span, words.bounds[t + 1]))
                        text = b" ".join(piece.data[words.start[i]:words.end[i]].tobytes() for i in range(low, high))
                        rows_of[t].append({"print": value, "size": n, "at": int(a - words.bounds[t]), "left": int(a - low),
                                           "words": text.translate(LOWER).decode()})
                sizes.append(counts)
                marks.extend(rows_of)
            if sizes:
                kind_of = pa.list_(pa.struct([("print", pa.int64()), ("size", pa.int32()), ("at", pa.int32()),
                                              ("left", pa.int32()), ("words", pa.string())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), batch.column("uid"), pa.array(np.concatenate(sizes), pa.int64()),
                     pa.array(marks, kind_of)], names=["key", "uid", "n_words", "marks"])

    return rows.mapInArrow(run, f"key {kind}, uid long, n_words long, marks {_MARK}")


def _extended(met: DataFrame, span: int, gram: int, item_kind: str) -> DataFrame:
    """Word ranges of documents, from pairs of equal fingerprints with the words around them."""

    def reach(a: list[str], b: list[str]) -> int:
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for row, (size, at, left, words, item_left, item_words) in enumerate(zip(*[
                    batch.column(c).to_pylist() for c in ("size", "at", "left", "words", "item_left", "item_words")])):
                if size:
                    if words == item_words:
                        out.append((row, at, at + size))
                    continue
                mine, theirs = words.split(" "), item_words.split(" ")
                ahead = reach(mine[left:], theirs[item_left:])
                behind = reach(mine[:left][::-1], theirs[:item_left][::-1])
                if ahead >= gram and ahead + behind >= span:
                    out.append((row, at - behind, at + ahead))
            rows = pa.array([o[0] for o in out], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid").take(rows), batch.column("item").take(rows), pa.array([o[1] for o in out], pa.int64()),
                 pa.array([o[2] for o in out], pa.int64())], names=["uid", "item", "low", "high"])

    return met.mapInArrow(run, f"uid long, item {item_kind}, low long, high long")


def contamination(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                  item_text: str = "text", span: int = 10, gram: int = 5, carry: bool = False) -> DataFrame:
    """Per row: key, n_words, n_hit, n_items, items_sha256 and contaminated; ``carry`` adds the row's ``_uid``."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("uid", F.xxhash64("key", "text"))
    tests = items.select(F.col(item_key).alias("key"), F.col(item_text).cast("string").alias("text"), F.lit(0).cast("long").alias("uid"))
    item_kind = dict(tests.dtypes)["key"]
    prints = stored(_marks(tests, span, gram, None, ()).select("key", F.explode("marks").alias("m")).select(
        F.col("key").alias("item"), F.col("m.print").alias("print"), F.col("m.size").alias("size"),
        F.col("m.left").alias("item_left"), F.col("m.words").alias("item_words")).distinct())
    short = tuple(sorted(r["size"] for r in prints.filter("size > 0").select("size").distinct().collect()))
    marked = stored(_marks(rows, span, gram, bitmap(prints, "print", FILTER_BITS), short))
    candidates = marked.select("uid", F.explode("marks").alias("m")).select(
        "uid", F.col("m.print").alias("print"), F.col("m.size").alias("size"), F.col("m.at").alias("at"),
        F.col("m.left").alias("left"), F.col("m.words").alias("words"))
    met = candidates.join(prints, ["print", "size"]).select("uid", "item", "size", "at", "left", "words", "item_left", "item_words")
    hits = _extended(met, span, gram, item_kind).groupBy("uid").agg(
        F.collect_set(F.struct("low", "high")).alias("ranges"), F.collect_set("item").alias("items"))
    covered = F.expr("aggregate(array_sort(ranges), named_struct('n', 0L, 'end', 0L), (s, r) -> named_struct("
                     "'n', s.n + greatest(0L, r.high - greatest(s.end, r.low)), 'end', greatest(s.end, r.high)), s -> s.n)")
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    hits = hits.select("uid", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                       F.sha2(names.cast("binary"), 256).alias("items_sha256"))
    result = marked.select("key", "uid", "n_words").join(hits, "uid", "left").select(
        F.col("key").alias(key), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0).cast("long")) > 0).alias("contaminated"), F.col("uid").alias("_uid"))
    return result if carry else result.drop("_uid")
