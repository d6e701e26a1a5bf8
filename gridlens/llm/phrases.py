"""Collocation mining: phrases of a language that are said far more often than their parts suggest.

Suffix pointers (a word with the words behind it in its piece of text) are sorted by multikey three-way quicksort down
to the longest phrase, and the sizes of equal partitions are the phrase counts.

1. Words and leading word pairs are counted for the whole corpus, added up per task before any shuffle.  A phrase cannot
   be frequent where a word or pair of it is not, so a suffix ends there; most suffixes end before their third word.
2. Suffixes are routed by their two leading words.  A bound of every route's size is known beforehand (pairs are counted
   under half of their hash); infrequent routes are abandoned before they travel.  A route with very many suffixes is dealt out by the following two words as well, and
   its partial counts are added up afterwards.
3. Every task sorts some whole routes at a time: each round splits all open partitions by the word of their middle
   pointer into less, equal and greater; equal ones go a word deeper, and partitions lighter than the least count are
   abandoned.

Words are named by 64-bit hashes of language and bytes in between; names are looked up for the phrases that remain.
Sums and scores use decimals of 38 digits.

Defined results: a missing text has no words, a missing language is ``und``; texts without words, and empty tables,
give nothing; every row counts, repeated ones too; of equal scores and counts the phrase decides in UTF-8 byte order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlens.llm import text_hash as th
from gridlens.llm.tables import bitmap, in_bitmap, stored

PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
LONGEST = 5
WORD_BITS, PAIR_BITS, HOT_BITS = 25, 25, 20
#: Occurrences of a leading pair above which its route is dealt out by the following words as well.
SPLIT = 1 << 18
#: Suffixes that a task sorts at once.
CHUNK = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ENDS = np.zeros(256, bool)
_ENDS[list(PIECE_ENDS)] = True


class Tokens:
    """Words of some texts: id (of language and word), place, and a number of the piece each stands in."""

    def __init__(self, piece: th.Piece, languages: np.ndarray, powers: th.Powers):
        words = th.words(piece, powers, PIECE_ENDS + b" \t")
        owner = th.owners(words.bounds)
        ids = th.mix(words.hashes + th.mix(languages[piece.first:piece.first + piece.count], 11)[owner], 12)
        ids[ids == 0] = 1  # 0 is the end of a suffix
        self.ids, self.start, self.end, self.owner = ids, words.start, words.end, owner
        ends = np.concatenate([[0], np.cumsum(_ENDS[piece.data])])
        # Ends of pieces only come up, and so do texts, so words agree on the sum if they agree on both.
        self.piece = ends[self.start] + owner

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word but the last goes on in its piece, and the hash of it with the next word."""
        joined = self.piece[1:] == self.piece[:-1]
        return joined, pair_hash(self.ids[:-1], self.ids[1:])


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return th.mix(a * np.uint64(th.BASE) + b, 13)


def slot_of(pairs: np.ndarray) -> np.ndarray:
    """Half of a pair's hash, under which it is counted; pairs that share a slot only pass more easily."""
    return (pairs >> np.uint64(32)).astype(np.uint32)


def spread(slots: np.ndarray) -> np.ndarray:
    return th.mix(slots.astype(np.uint64), 14)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, th.Piece, Tokens]]:
    powers = th.Powers()
    for batch in batches:
        languages = batch.column("lid").to_numpy(zero_copy_only=False).view(np.uint64)
        for piece in th.pieces(batch.column("text")):
            yield batch, piece, Tokens(piece, languages, powers)


def _vocabulary(rows: DataFrame) -> DataFrame:
    """(id, lang, word, f) of every word, counted over the whole corpus, and under id 0 the number of all words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, piece, tokens in _tokens(batches):
            if not len(tokens.ids):
                continue
            ids, first, n = np.unique(tokens.ids, return_index=True, return_counts=True)
            text = _LOWER[piece.data].tobytes()
            words = [text[a:b] for a, b in zip(tokens.start[first].tolist(), tokens.end[first].tolist())]
            names = ["id", "lang", "word", "f"]
            lang = batch.column("lang").take(pa.array(piece.first + tokens.owner[first]))
            yield pa.RecordBatch.from_arrays([pa.array(th.signed(ids)), lang, pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=names)
            texts, n = np.unique(tokens.owner, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(texts), np.int64)), batch.column("lang").take(pa.array(piece.first + texts)),
                                              pa.nulls(len(texts), pa.string()), pa.array(n, pa.int64())], names=names)

    return rows.mapInArrow(run, "id long, lang string, word string, f long").groupBy("id", "lang", "word").agg(F.sum("f").alias("f"))


def _leading_pairs(rows: DataFrame, words: bytes) -> DataFrame:
    """(slot, f): how often the pairs of a slot occur whose words may be frequent, over the whole corpus."""
    known = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(known.value, np.int64)
        for _, _, tokens in _tokens(batches):
            may = in_bitmap(bits, tokens.ids)
            joined, names = tokens.pairs()
            slots, n = np.unique(slot_of(names[joined & may[1:] & may[:-1]]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slots.view(np.int32)), pa.array(n, pa.int64())], names=["slot", "f"])

    return rows.mapInArrow(run, "slot int, f long").groupBy("slot").agg(F.sum("f").alias("f"))


def _keys(slots: DataFrame) -> DataFrame:
    """(key): what a bit set of slots is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column("slot").to_numpy(zero_copy_only=False).view(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(th.signed(spread(slot)))], names=["key"])

    return slots.select("slot").mapInArrow(run, "key long")


_SUFFIX = [f"w{i}" for i in range(1, LONGEST + 1)]


def _suffixes(rows: DataFrame, pairs: bytes, hot: bytes, ways: int) -> DataFrame:
    """(w1 .. w5, way, n) of suffixes up to the first pair that cannot be frequent; 0 behind the end.

    Suffixes of a ``hot`` route go one of ``ways`` ways by their third and fourth word, others have -1.
    """
    context = rows.sparkSession.sparkContext
    known, large = context.broadcast(pairs), context.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, often = [np.frombuffer(b.value, np.int64) for b in (known, large)]
        for _, _, tokens in _tokens(batches):
            joined, pair = tokens.pairs()
            slots = spread(slot_of(pair))
            steps = np.zeros(len(tokens.ids) + LONGEST, bool)
            steps[:len(joined)] = joined & in_bitmap(bits, slots)
            at = np.flatnonzero(steps)
            padded = np.concatenate([tokens.ids, np.zeros(LONGEST, np.uint64)])
            columns, going, name = [padded[at]], np.ones(len(at), bool), padded[at]
            for d in range(1, LONGEST):
                going = going & steps[at + d - 1]
                columns.append(np.where(going, padded[at + d], np.uint64(0)))
                name = pair_hash(name, columns[-1])
            _, first, n = np.unique(name, return_index=True, return_counts=True)
            columns = [c[first] for c in columns]
            way = (pair_hash(columns[2], columns[3]) % np.uint64(ways)).astype(np.int32)
            way[~in_bitmap(often, slots[at[first]])] = -1
            yield pa.RecordBatch.from_arrays([*[pa.array(th.signed(c)) for c in columns], pa.array(way), pa.array(n, pa.int64())],
                                             names=[*_SUFFIX, "way", "n"])

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in _SUFFIX) + ", way int, n long")


def sort_suffixes(words: np.ndarray, n: np.ndarray, split: np.ndarray, minimum: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Multikey three-way quicksort of suffixes (rows of ``words``) that are grouped by their two leading words.

    Gives (depth, a row of every equal partition of that many leading words, its weight).  Partitions lighter than
    ``minimum`` are abandoned; of ``split`` routes other tasks may hold more, where they differ in the third and fourth
    word, so there the partitions of up to three words all stay.
    """
    found: list[tuple[int, np.ndarray, np.ndarray]] = []
    if not len(words):
        return found
    new = np.ones(len(words), bool)
    new[1:] = (words[1:, :2] != words[:-1, :2]).any(axis=1) | (split[1:] != split[:-1])
    pointers, starts = np.arange(len(words)), np.flatnonzero(new)
    weight = np.add.reduceat(n, starts)
    stays = (weight >= minimum) | split[starts]
    found.append((2, starts[stays], weight[stays]))
    sizes = np.diff(np.append(starts, len(words)))
    pointers, segment = pointers[np.repeat(stays, sizes)], np.repeat(np.arange(stays.sum()), sizes[stays])
    depth = np.full(stays.sum(), 2)  # of each open partition
    while len(pointers):
        starts = np.flatnonzero(np.diff(segment, prepend=-1))
        sizes = np.diff(np.append(starts, len(segment)))
        middle = pointers[starts + sizes // 2]
        pivot = words[middle, depth]
        value = words[pointers, depth[segment]]
        side = 1 + (value > pivot[segment]).astype(np.int64) - (value < pivot[segment])
        key = segment * 3 + side
        order = np.argsort(key, kind="stable")
        pointers, key = pointers[order], key[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        weight = np.add.reduceat(n[pointers], starts)
        parent, side = key[starts] // 3, key[starts] % 3
        deeper = depth[parent] + (side == 1)
        partial = split[pointers[starts]] & (depth[parent] == 2)
        stays = (weight >= minimum) | partial
        equal = (side == 1) & stays & (words[pointers[starts], depth[parent]] != 0)
        for d in range(3, LONGEST + 1):
            at = equal & (deeper == d)
            if at.any():
                found.append((d, pointers[starts[at]], weight[at]))
        stays &= (side != 1) | (equal & (deeper < LONGEST))
        number = np.cumsum(stays) - 1
        sizes = np.diff(np.append(starts, len(pointers)))
        keep = np.repeat(stays, sizes)
        pointers, segment = pointers[keep], np.repeat(number, sizes)[keep]
        depth = deeper[stays]
    return found


def _phrases(suffixes: DataFrame, minimum: int) -> DataFrame:
    """(p, f) of the frequent phrases of two words or more."""
    routed = suffixes.groupBy(*_SUFFIX, "way").agg(F.sum("n").alias("n"))
    routed = routed.repartition("w1", "w2", "way").sortWithinPartitions("w1", "w2", "way")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def solve(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            words = rows[:, :LONGEST].view(np.uint64)
            for depth, first, weight in sort_suffixes(words, rows[:, LONGEST], rows[:, LONGEST + 1] >= 0, minimum):
                columns = [pa.array(rows[first, d] if d < depth else np.zeros(len(first), np.int64)) for d in range(LONGEST)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(weight, pa.int64())], names=[*_SUFFIX, "n"])

        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*_SUFFIX, "n", "way")], axis=1))
            if sum(map(len, held)) >= CHUNK:
                rows = np.concatenate(held)
                # The last route may go on in the next batch.
                last = (rows[:, [0, 1, LONGEST + 1]] == rows[-1, [0, 1, LONGEST + 1]]).all(axis=1)
                cut = len(rows) - int(last.sum())
                yield from solve(rows[:cut])
                held = [rows[cut:]]
        if held:
            yield from solve(np.concatenate(held))

    sorted_ = routed.mapInArrow(run, ", ".join(f"{c} long" for c in _SUFFIX) + ", n long")
    total = sorted_.groupBy(*_SUFFIX).agg(F.sum("n").alias("f")).filter(F.col("f") >= minimum)
    return total.select(F.filter(F.array(*_SUFFIX), lambda w: w != 0).alias("p"), "f")


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", minimum: int = 100, top: int = 2000, split: int = SPLIT) -> DataFrame:
    """Per language its ``top`` phrases of 2 to 5 words: lang, rank, phrase, a, l, r, n, score.

    Phrases occur ``minimum`` times or more.  The lowest of ``1000 * a * n / (l * r)`` over all cuts into two parts, rounded
    down, is the score; a phrase that never stands outside a longer one is left out.
    """
    language = F.coalesce(F.col(lang).cast("string"), F.lit("und"))
    rows = docs.select(language.alias("lang"), F.xxhash64(language).alias("lid"), F.col(text).cast("string").alias("text")).filter("text is not null")
    vocabulary = stored(_vocabulary(rows).filter((F.col("f") >= minimum) | (F.col("id") == 0)))
    frequent = vocabulary.filter("id <> 0")
    pairs = stored(_leading_pairs(rows, bitmap(frequent, "id", WORD_BITS)).filter(F.col("f") >= minimum))
    most = pairs.agg(F.max("f")).first()[0] or 0
    hot = bitmap(_keys(pairs.filter(F.col("f") > split)), "key", HOT_BITS)
    suffixes = _suffixes(rows, bitmap(_keys(pairs), "key", PAIR_BITS), hot, -(-most // split) or 1)
    longer = _phrases(suffixes, minimum)
    counts = stored(frequent.select(F.array("id").alias("p"), "f").union(longer))

    phrases = counts.filter(F.size("p") > 1)
    # Whatever holds a phrase as often as it occurs has a part, one word longer than the phrase, that does so too.
    inside = phrases.filter(F.size("p") > 2).select(
        F.explode(F.array(F.expr("slice(p, 1, size(p) - 1)"), F.expr("slice(p, 2, size(p) - 1)"))).alias("p"), "f")
    phrases = phrases.join(inside, ["p", "f"], "left_anti")
    total = vocabulary.filter("id = 0").select("lang", F.col("f").alias("n"))
    named = phrases.join(frequent.select(F.col("id").alias("_id"), "lang"), F.get("p", F.lit(0)) == F.col("_id")).drop("_id").join(total, "lang")
    cuts = named.select("lang", "p", F.col("f").alias("a"), "n", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    parts = cuts.join(counts.select(F.col("p").alias("_left"), F.col("f").alias("l")), F.expr("slice(p, 1, k)") == F.col("_left")).join(
        counts.select(F.col("p").alias("_right"), F.col("f").alias("r")), F.expr("slice(p, k + 1, size(p) - k)") == F.col("_right"))
    score = F.expr("cast(1000 * cast(a as decimal(19,0)) * cast(n as decimal(19,0)) as decimal(38,0)) "
                   "div cast(cast(l as decimal(19,0)) * cast(r as decimal(19,0)) as decimal(38,0))")
    best = parts.withColumn("score", score).groupBy("p", "lang", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    words = best.select("p", F.posexplode("p").alias("at", "id")).join(frequent.select("id", "word"), "id")
    texts = words.groupBy("p").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    scored = best.join(texts, "p").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    ranked = scored.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
