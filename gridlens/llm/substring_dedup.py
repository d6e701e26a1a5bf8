"""Removal of byte strings of a given length that start more than once in the corpus.

Suffixes are never sorted as a whole.  They are dealt into buckets by content: the bucket of a suffix is the
smallest hash among the ``length/2``-byte strings inside its first ``length`` bytes, so suffixes that agree on
``length`` bytes meet in one bucket, at the same distance before that string (their slot).  Neighbouring suffixes of
a text mostly share it; they travel as one run with the bytes they cover.

1. One pass counts buckets; runs of a bucket with one run can hold no repeat and are dropped.  The shared buckets
   reach the next pass as a bit set of fixed size.
2. Runs with the same bytes form a class.  A class of two runs repeats as a whole.  Up to here runs travel without
   their bytes.
3. Buckets with several classes are sorted one at a time (small ones together), one representative per class; only its
   bytes are cut from its text, and only texts with representatives are met with them.  The places of
   a difference cover are ranked in byte order by prefix doubling; a suffix is sorted by the bytes before the next
   such place and the rank there, so no suffix is spelled out and memory stays bounded.  Neighbours in this order are
   compared by bytes.
   The buckets' texts are laid out so that slots agree modulo the cover's period, which makes the distance to the
   next sampled place the same for all suffixes that can be equal.
   A bucket with very many classes goes to no task as a whole: a dozen neighbouring suffixes become a row (bucket, window,
   hashes of the bytes they share, hashes of the others).  Windows that share nothing are done, so are those alike in full.
   Only where windows share a core and differ around it the suffixes of one of each kind become rows (bucket, slot,
   hashes of both halves).  Equal ones are found by aggregates that combine on the map side and joined back.
4. Repeats go back to their texts as byte ranges and are cut out.

Defined results: a missing or empty text has no bytes and loses none; shorter texts than ``length`` lose none;
matches never cross texts; repeated rows are copies of each other and so lose every byte if long enough.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm import text_hash as th
from gridlens.llm.tables import bitmap, few_tasks, in_bitmap, stored, written

FILTER_BITS = 25
#: Classes of a bucket above which its suffixes are dealt out.
SLICE_CLASSES = 512
#: Slots whose suffixes are dealt out together as long as nothing tells them apart.
WINDOW = 12


def difference_cover(r: int) -> tuple[int, np.ndarray]:
    """Period and residues such that every distance modulo the period is one between two residues.

    The gaps follow the rule 1^r, r+1, (2r+1)^r, (4r+3)^(2r+1), (2r+2)^(r+1), 1^r.
    """
    gaps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, np.cumsum([0, *gaps])


def _blocks(column: pa.Array, length: int, limit: int = th.PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, offset in it, bytes, text starts); a text beyond ``limit`` comes in overlapping blocks."""
    for piece in th.pieces(column, limit):
        if piece.count == 1 and len(piece.data) > limit:
            for at in range(0, len(piece.data), limit):
                data = piece.data[at:at + limit + length - 1]
                yield piece.first, at, data, np.array([0, len(data)])
        else:
            yield piece.first, 0, piece.data, piece.starts


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, from running minima of blocks in both directions."""
    n = len(values)
    if n < width:
        return values[:0]
    top = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    top[:n] = values
    rows = top.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


class Runs:
    """Runs of suffixes of one block that share their bucket: first suffix, number, and place of the bucket string."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, length: int, powers: th.Powers):
        gram = length // 2
        sums = th.prefix_sums(data, powers)
        n = len(data)
        empty = np.zeros(0, np.int64)
        self.first = self.count = self.anchor = self.text = empty
        self.bucket = self.content = empty.view(np.uint64)
        if n < length:
            return
        at = np.arange(n - gram + 1)
        grams = th.span_hashes(sums, powers, at, at + gram)
        packed = grams & np.uint64(0xFFFFFFFF00000000) | at.astype(np.uint64)
        anchor = (_sliding_min(packed, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[:len(anchor)]
        good = np.arange(len(anchor)) + length <= starts[text + 1]
        where = np.flatnonzero(good)
        if not len(where):
            return
        anchor, text = anchor[where], text[where]
        new = np.ones(len(where), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        head = np.flatnonzero(new)
        self.first = where[head]
        self.count = np.diff(np.append(head, len(where)))
        self.anchor, self.text = anchor[head], text[head]
        self.bucket = grams[self.anchor]
        whole = th.span_hashes(sums, powers, self.first, self.first + self.count - 1 + length)
        self.content = th.mix(whole + (self.anchor - self.first).astype(np.uint64), 9)


def _bucket_counts(rows: DataFrame, length: int) -> DataFrame:
    """Runs by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = th.Powers()
        for batch in batches:
            for _, _, data, starts in _blocks(batch.column("text"), length):
                bucket, n = np.unique(Runs(data, starts, length, powers).bucket, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(th.signed(bucket)), pa.array(n, pa.int64())], names=["bucket", "n"])

    counts = rows.select("text").mapInArrow(run, "bucket long, n long")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def _runs(rows: DataFrame, length: int, shared: bytes) -> DataFrame:
    """Runs of buckets that may be shared, without their bytes."""
    wanted = rows.sparkSession.sparkContext.broadcast(shared)
    schema = "bucket long, class long, uid long, first int, lead int, count int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, bits = th.Powers(), np.frombuffer(wanted.value, np.int64)
        for batch in batches:
            uid = batch.column("uid").to_numpy(zero_copy_only=False)
            for begin, offset, data, starts in _blocks(batch.column("text"), length):
                runs = Runs(data, starts, length, powers)
                keep = np.flatnonzero(in_bitmap(bits, runs.bucket))
                first, text = runs.first[keep], runs.text[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(th.signed(runs.bucket[keep])), pa.array(th.signed(runs.content[keep])), pa.array(uid[begin + text]),
                     pa.array(first - starts[text] + offset, pa.int32()), pa.array(runs.anchor[keep] - first, pa.int32()),
                     pa.array(runs.count[keep], pa.int32())],
                    names=["bucket", "class", "uid", "first", "lead", "count"])

    return rows.select("uid", "text").mapInArrow(run, schema)


def _may_have(rows: DataFrame, bits: bytes) -> DataFrame:
    """(uid, text) of the rows whose uid may be in the bit set."""
    wanted = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(wanted.value, np.int64)
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(known, batch.column("uid").to_numpy(zero_copy_only=False).view(np.uint64))))

    return rows.select("uid", "text").mapInArrow(run, "uid long, text string")


def _contents(rows: DataFrame, classes: DataFrame, length: int) -> DataFrame:
    """(bucket, class, lead, content) of classes, each cut once from the text of its representative."""
    wanted = stored(classes.groupBy("uid").agg(F.collect_list(F.struct("bucket", "class", "first", "lead", "count")).alias("runs")))
    texts = _may_have(rows, bitmap(wanted, "uid", FILTER_BITS)).dropDuplicates(["uid"])
    columns = ("bucket", "class", "first", "lead", "count")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in [batch.slice(low, 64) for low in range(0, len(batch), 64)]:
                runs = part.column("runs")
                bucket, name, first, lead, count = [runs.flatten().field(c) for c in columns]
                texts = part.column("text").cast(pa.large_binary())
                owner = np.repeat(np.arange(len(part)), runs.value_lengths().to_numpy())
                low, n = first.to_numpy().astype(np.int64), count.to_numpy() + length - 1
                data = [memoryview(x.as_buffer()) for x in texts]
                content = [data[i][a:a + k] for i, a, k in zip(owner.tolist(), low.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([bucket, name, lead, pa.array(content, pa.binary())], names=["bucket", "class", "lead", "content"])

    return wanted.join(texts, "uid").mapInArrow(run, "bucket long, class long, lead int, content binary")


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a big-endian word; fewer are left near the end."""
    words = np.zeros(len(data), np.uint64)
    for i in range(8):
        words[:len(data) - i] |= data[i:].astype(np.uint64) << np.uint64(56 - 8 * i)
    return words


def _leading(words: np.ndarray, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """The first ``size`` bytes, up to eight, at each place."""
    spare = np.uint64(8) * (np.uint64(8) - np.asarray(size, np.uint64))
    found = words[np.minimum(at, len(words) - 1)]
    return np.where(spare < 64, found >> np.minimum(spare, np.uint64(63)), np.uint64(0))


def _ranked(keys: list[np.ndarray]) -> np.ndarray:
    """Dense ranks from 1 by keys, the first one counts most."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for key in keys:
        new[1:] |= key[order[1:]] != key[order[:-1]]
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(new) + 1
    return ranks


def cover_ranks(words: np.ndarray, sampled: np.ndarray, period: int, depth: int) -> np.ndarray:
    """Ranks of the suffixes at the sampled places, in byte order of ``depth`` bytes or more, by prefix doubling.

    ``sampled`` ascends and holds with a place the one a period later, up to the end of the data.
    """
    ranks = _ranked([_leading(words, sampled + k, min(8, period - k)) for k in range(0, period, 8)])
    reach = period
    while reach < depth and len(sampled):
        place = np.minimum(np.searchsorted(sampled, sampled + reach), len(sampled) - 1)
        ranks = _ranked([ranks, np.where(sampled[place] == sampled + reach, ranks[place], 0)])
        reach *= 2
    return ranks


def repeats_in_buckets(buckets: np.ndarray, contents: list[bytes], leads: np.ndarray, length: int) -> list[np.ndarray]:
    """Per run, which of its suffixes agree on ``length`` bytes with one of another run of the same bucket.

    Equal suffixes share their slot (distance before the bucket string, counted from the far end).
    """
    period, cover = difference_cover(1 if length >= 200 else 0)
    reach = length - length // 2
    sizes = np.array([len(c) for c in contents])
    # Bucket strings are placed at multiples of the period, so that equal suffixes are as far from the next sampled place.
    base = np.concatenate([[0], np.cumsum(-(-(sizes + period) // period) * period)])
    begin = base[:-1] - (leads + base[:-1]) % period + period
    data = np.zeros(base[-1] + 2 * period, np.uint8)
    for at, c in zip(begin.tolist(), contents):
        data[at:at + len(c)] = np.frombuffer(c, np.uint8)
    residues = np.zeros(period, bool)
    residues[cover % period] = True
    # The cover leaves half of the period free; further places there keep the next one within a word.
    residues[int(cover.max())::8] = True
    following = np.array([next(k for k in range(period) if residues[(p + k) % period]) for p in range(period)])

    counts = sizes - length + 1
    owner = np.repeat(np.arange(len(contents)), counts)
    index = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    slot, at = reach - leads[owner] + index, begin[owner] + index
    skip = following[at % period]
    sampled = np.flatnonzero(residues[np.arange(len(data)) % period])
    words = _words(data)
    rank = cover_ranks(words, sampled, period, length)[np.searchsorted(sampled, at + skip)]
    # Suffixes of a bucket and slot in byte order: the bytes before the sampled place, then its rank.
    group = np.unique(buckets, return_inverse=True)[1][owner] * (2 * length) + slot
    order = np.lexsort([rank, _leading(words, at, skip), group])
    upper, lower = order[:-1], order[1:]
    near = np.flatnonzero(group[upper] == group[lower])
    same = np.zeros(max(len(order) - 1, 0), bool)
    text = np.lib.stride_tricks.sliding_window_view(data, length)
    # Neighbours that differ mostly do so within a few bytes; only the others are compared in full.
    for part in np.array_split(near, len(near) // 8192 + 1):
        a, b = at[upper[part]], at[lower[part]]
        alike = np.flatnonzero((text[a, :16] == text[b, :16]).all(axis=1) & (text[a, -16:] == text[b, -16:]).all(axis=1))
        same[part[alike]] = (text[a[alike]] == text[b[alike]]).all(axis=1)
    hit = np.zeros(len(order), bool)
    hit[1:] |= same
    hit[:-1] |= same
    flags = np.zeros(len(owner), bool)
    flags[order[hit]] = True
    return np.split(flags, np.cumsum(counts)[:-1])


def _ranges(flags: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"low": int(a), "high": int(b)} for a, b in zip(edge[::2], edge[1::2])]


def _sorted_buckets(classes: DataFrame, length: int) -> DataFrame:
    """Repeated suffixes (bucket, class, low, high) of buckets that hold several classes, but not very many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(group: list[tuple]) -> pa.RecordBatch:
            flags = repeats_in_buckets(np.array([g[0] for g in group]), [g[2] for g in group], np.array([g[3] for g in group]), length)
            rows = [(g[0], g[1], r["low"], r["high"]) for g, f in zip(group, flags) if f.any() for r in _ranges(f)]
            columns = list(zip(*rows)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                                               pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())],
                                              names=["bucket", "class", "low", "high"])

        pending: list[tuple] = []  # whole buckets, then the rows of the last one
        size = 0
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("bucket", "class", "content", "lead")]):
                # Small buckets are worked on together.
                if pending and row[0] != pending[-1][0] and size > 1 << 19:
                    yield solve(pending)
                    pending, size = [], 0
                pending.append(row)
                size += len(row[2])
        if pending:
            yield solve(pending)

    dealt = classes.repartition("bucket").sortWithinPartitions("bucket", "class")
    return dealt.mapInArrow(run, "bucket long, class long, low int, high int")


def _spans(column: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all contents one after another, their sizes and where each begins."""
    sizes = np.array([len(c) for c in column], np.int64)
    return np.frombuffer(b"".join(column), np.uint8), sizes, np.cumsum(sizes) - sizes


def _windows(runs: DataFrame, length: int) -> DataFrame:
    """One row per WINDOW slots of the given classes: bucket, window, hashes of the two halves of what all
    suffixes of the window have in common, hashes of the bytes before and behind it that belong to the run's suffixes of
    the window, class, and the range of these suffixes in the run.
    """
    reach = length - length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = th.Powers()
        for batch in batches:
            for part in [batch.slice(low, 1024) for low in range(0, len(batch), 1024)]:
                data, sizes, begin = _spans(part.column("content").to_pylist())
                sums = th.prefix_sums(data, powers)
                bucket, name, lead = [part.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "class", "lead")]
                slot, counts = reach - lead.astype(np.int64), sizes - length + 1
                number = (slot + counts - 1) // WINDOW - slot // WINDOW + 1
                owner = np.repeat(np.arange(len(number)), number)
                window = slot[owner] // WINDOW + np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
                low = np.maximum(window * WINDOW - slot[owner], 0)
                high = np.minimum((window + 1) * WINDOW - slot[owner], counts[owner])
                # Places in the data: of slot s is begin + s - slot.
                zero = (begin - slot)[owner]
                core, behind = zero + window * WINDOW + WINDOW - 1, zero + window * WINDOW + length
                middle = (core + behind) // 2
                first, last = begin[owner] + low, begin[owner] + high - 1 + length
                head, tail = th.span_hashes(sums, powers, core, middle), th.span_hashes(sums, powers, middle, behind)
                before, after = th.span_hashes(sums, powers, first, core), th.span_hashes(sums, powers, behind, last)
                before, after = th.mix(before + (core - first).astype(np.uint64), 11), th.mix(after + (last - behind).astype(np.uint64), 12)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[owner]), pa.array(window, pa.int32()), *[pa.array(th.signed(h)) for h in (head, tail, before, after)],
                     pa.array(name[owner]), pa.array(low, pa.int32()), pa.array(high, pa.int32())],
                    names=["bucket", "window", "head", "tail", "before", "after", "class", "low", "high"])

    return runs.select("bucket", "class", "lead", "content").mapInArrow(
        run, "bucket long, window int, head long, tail long, before long, after long, class long, low int, high int")


def _suffixes(runs: DataFrame, length: int) -> DataFrame:
    """One row per suffix in the ``windows`` of each run: bucket, slot, hashes of its two halves, class, index."""
    reach, half = length - length // 2, length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = th.Powers()
        for batch in batches:
            for part in [batch.slice(low, 1024) for low in range(0, len(batch), 1024)]:
                data, sizes, begin = _spans(part.column("content").to_pylist())
                sums = th.prefix_sums(data, powers)
                bucket, name, lead = [part.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "class", "lead")]
                slot = reach - lead.astype(np.int64)
                windows = part.column("windows").to_pylist()
                owner = np.repeat(np.arange(len(windows)), [len(w) * WINDOW for w in windows])
                index = (np.array([w for ws in windows for w in ws], np.int64)[:, None] * WINDOW + np.arange(WINDOW)).ravel() - slot[owner]
                inside = (index >= 0) & (index <= sizes[owner] - length)
                owner, index = owner[inside], index[inside]
                at = begin[owner] + index
                head, tail = th.span_hashes(sums, powers, at, at + half), th.span_hashes(sums, powers, at + half, at + length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[owner]), pa.array(slot[owner] + index, pa.int32()), pa.array(th.signed(head)),
                     pa.array(th.signed(tail)), pa.array(name[owner]), pa.array(index, pa.int32())],
                    names=["bucket", "slot", "head", "tail", "class", "index"])

    return runs.select("bucket", "class", "lead", "content", "windows").mapInArrow(
        run, "bucket long, slot int, head long, tail long, class long, index int")


def _dealt_suffixes(runs: DataFrame, length: int) -> DataFrame:
    """Repeated suffixes (bucket, class, low, high) of large buckets, whatever number of classes they have."""
    core = ["bucket", "window", "head", "tail"]
    whole = [*core, "before", "after"]
    windows = _windows(runs, length)
    kinds = stored(windows.groupBy(*whole).agg(F.min("class").alias("a"), F.max("class").alias("b")))
    # Windows that are alike in full repeat in full.  Stored, so that the join has a shuffle on both sides and a key with
    # many rows is split.
    alike = windows.join(stored(kinds.filter("a < b").select(*whole)), whole, "left_semi").select("bucket", "class", "low", "high").distinct()
    # Of windows with the same core that differ elsewhere one of each kind is taken apart.
    mixed = kinds.groupBy(*core).agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select(*core)
    apart = kinds.join(stored(mixed), core, "left_semi").select("bucket", F.col("a").alias("class"), "window")
    apart = apart.groupBy("bucket", "class").agg(F.collect_set("window").alias("windows"))
    first = runs.join(apart, ["bucket", "class"]).groupBy("bucket", "class").agg(
        *[F.first(c).alias(c) for c in ("lead", "content", "windows")])
    suffixes = _suffixes(stored(first), length)
    key = ["bucket", "slot", "head", "tail"]
    repeated = suffixes.groupBy(*key).agg(F.min("class").alias("a"), F.max("class").alias("b")).filter("a < b").select(*key)
    found = suffixes.join(stored(repeated), key, "left_semi")
    # At most length - length // 2 + 1 suffixes make a class.
    found = found.groupBy("bucket", "class").agg(F.sort_array(F.collect_set("index")).alias("i"))
    lows = F.filter("i", lambda x, k: F.coalesce(F.get("i", k - 1), x - 2) != x - 1)
    highs = F.filter("i", lambda x, k: F.coalesce(F.get("i", k + 1), x + 2) != x + 1)
    ranges = found.select("bucket", "class", F.explode(F.arrays_zip(lows.alias("low"), highs.alias("high"))).alias("r"))
    return ranges.select("bucket", "class", F.col("r.low").alias("low"), (F.col("r.high") + 1).alias("high")).union(alike)


def repeated_ranges(rows: DataFrame, length: int) -> DataFrame:
    """(uid, ranges): byte ranges of each text that are covered by repeated strings."""
    counts = stored(_bucket_counts(rows, length).filter("n > 1").select("bucket"))
    runs = written(_runs(rows, length, bitmap(counts, "bucket", FILTER_BITS)).join(counts, "bucket", "left_semi"))
    # The text of the smallest uid represents a class, at one of its runs there.
    most = runs.count()
    classes = written(few_tasks(runs.groupBy("bucket", "class").agg(
        F.count(F.lit(1)).alias("n"), F.max("lead").alias("lead"), F.max("count").alias("count"), F.min("uid").alias("uid"),
        F.min_by("first", "uid").alias("first")), most))
    several = stored(few_tasks(classes.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), most // 2))
    small, large = [several.filter(c).select("bucket") for c in (F.col("members") <= SLICE_CLASSES, F.col("members") > SLICE_CLASSES)]
    partial = _sorted_buckets(_contents(rows, classes.join(small, "bucket", "left_semi"), length), length)
    if not large.isEmpty():
        partial = partial.union(_dealt_suffixes(written(_contents(rows, classes.join(large, "bucket", "left_semi"), length)), length))
    # Classes of several runs repeat as a whole anyway.
    partial = partial.join(classes.filter("n = 1").select("bucket", "class"), ["bucket", "class"], "left_semi")
    whole = classes.filter("n > 1").select("bucket", "class", F.lit(0).alias("low"), F.col("count").alias("high"))
    found = stored(whole.union(partial))
    hits = runs.select("bucket", "class", "uid", "first").join(found, ["bucket", "class"]).select(
        "uid", (F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high") - 1 + length).alias("high"))
    return hits.groupBy("uid").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))


def _merged(ranges: list[dict[str, int]]) -> list[list[int]]:
    merged: list[list[int]] = []
    for low, high in sorted((r["low"], r["high"]) for r in ranges):
        if merged and low <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    return merged


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = 400,
                   carry: bool = False) -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans and kept_sha256 of what is left.

    With ``carry`` all columns of the row with ``text`` replaced by what is left, besides ``n_removed``; a character
    that a cut leaves incomplete is dropped.
    """
    if length < 32:
        raise ValueError("length has to be 32 bytes or more")
    # Rows that agree on key and text are the same to every step, so a hash of both names them.
    named = docs.withColumn("_uid", F.xxhash64(F.col(key), F.col(text).cast("string")))
    rows = named.select(F.col("_uid").alias("uid"), F.col(text).cast("string").alias("text"))
    ranges = repeated_ranges(rows, length).withColumnRenamed("uid", "_uid").withColumnRenamed("ranges", "_ranges")
    if carry:
        source, kept = named, docs.columns
        schema = docs.withColumn("n_removed", F.lit(0).cast("long")).schema
    else:
        source = named.select("_uid", F.col(key).alias("key"), F.col(text).cast("string").alias("_text"))
        kept = ["key"]
        schema = f"key {dict(source.dtypes)['key']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    column = text if carry else "_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, left = [], [], [], []
            for value, cuts in zip(batch.column(column), batch.column("_ranges")):
                data = (value.as_py() or "").encode()
                merged = _merged(cuts.as_py() or [])
                ends = [0, *[x for span in merged for x in span], len(data)]
                left.append(b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2])))
                sizes.append(len(data))
                spans.append(len(merged))
                removed.append(len(data) - len(left[-1]))
            if carry:
                texts = [b.decode(errors="ignore") if r else v for b, r, v in zip(left, removed, batch.column(column).to_pylist())]
                out = [pa.array(texts, batch.schema.field(c).type) if c == text else batch.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays([*out, pa.array(removed, pa.int64())], names=[*kept, "n_removed"])
            else:
                digests = [hashlib.sha256(b).hexdigest() for b in left]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), *[pa.array(x, pa.int64()) for x in (sizes, removed, spans)], pa.array(digests)],
                    names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    done = source.join(ranges, "_uid", "left").mapInArrow(run, schema)
    return done if carry else done.withColumnRenamed("key", key)
