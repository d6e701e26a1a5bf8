"""Line-first quality rules, in DataFrame operations only.

Each line is judged by itself: by its punctuation, as navigation, and as boilerplate.  Lines that fail are removed, and
a document that loses too much of its text that way is rejected, as is one that fails the base rules on words and
repetition.  Everything happens inside the row.

Defined results: a missing text has no words and is rejected for too few of them; blank lines are neither judged nor
counted; repeated rows are each returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.llm.tables import bind

WHITE = "\x20\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
TERMINAL = r"""[.!?…。！？:;,]["'”’»)\]]*$"""
ITEM = (r"(?:home|about(?: us)?|contacto|contact(?: us)?|log ?in|sign ?(?:in|up)|register|menu|search|site ?map|faq|help|next|previous|"
        r"back to top|startseite|kontakt|impressum|anmelden|accueil|connexion|inicio)")
SEPARATOR = r"[\s|>»•·/-]"
#: A line of menu items starts with one, and nothing is left without them.  No pattern repeats a group, as that takes
#: the task's stack by the length of the line.
FIRST_ITEM, ITEMS = f"(?i)^{SEPARATOR}*+{ITEM}", f"(?i){ITEM}|{SEPARATOR}++"
BOILERPLATE = (r"(?i)\b(?:all rights reserved|privacy policy|terms (?:of|and) (?:use|service|conditions)|cookie policy|"
               r"we use cookies|click here|subscribe to our|enable javascript|powered by|lorem ipsum|alle rechte vorbehalten|"
               r"datenschutzerklärung|tous droits réservés|mentions légales|todos los derechos reservados|política de privacidad)\b")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def ink(text: Column) -> Column:
    """Characters outside white space."""
    return F.length(F.translate(text, WHITE, ""))


def line_fails(line: Column, *, short: int, symbols: float, separators: int) -> Column:
    """Whether a line breaks the punctuation, navigation or boilerplate rule."""
    chars = ink(line)
    n_words = F.size(words_of(line))
    marks = chars - F.length(F.translate(line, WHITE + SYMBOLS, ""))
    bars = F.length(line) - F.length(F.translate(line, "|»•·", ""))
    punctuation = ((n_words < short) & ~F.rtrim(line).rlike(TERMINAL)) | (marks > symbols * chars)
    navigation = ((bars >= separators) & (bars * 4 >= n_words)) | (F.rlike(line, F.lit(FIRST_ITEM)) & (F.regexp_replace(line, ITEMS, "") == ""))
    return punctuation | navigation | F.rlike(line, F.lit(BOILERPLATE))


def repeated_words(words: Column, size: int = 5) -> Column:
    """Number of words inside windows of ``size`` words that occur at least twice."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    n = F.size(words)

    def windows(h: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(h) - size)
        return F.transform(places, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(size)]))

    def covered(w: Column) -> Column:
        # Equal windows are neighbours once sorted; then each repeated window adds what the one before left uncovered.
        pairs = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda p, i, j: F.coalesce(F.get(p, i + j)["h"] == F.get(p, i)["h"], F.lit(False))
        flagged = lambda p: F.transform(p, lambda x, i: F.when((i > 0) & same(p, i, -1) | same(p, i, 1), x["i"]))
        places = bind(pairs, lambda p: F.sort_array(F.array_compact(flagged(p))))
        return F.aggregate(
            places, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda s, p: F.struct((s["n"] + p + size - F.greatest(s["end"], p)).alias("n"), (p + size).alias("end")), lambda s: s["n"])

    def counted(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w))

    return F.when(n < size + 1, F.lit(0)).otherwise(bind(hashes, lambda h: bind(windows(h), counted))).cast("long")


def line_first(docs: DataFrame, *, key: str = "doc_id", text: str = "text", short: int = 4, symbols: float = 0.2,
               separators: int = 4, most_lost: float = 0.5, least_words: int = 10, most_repeated: int = 20) -> DataFrame:
    """Per row: key, the base counts, base_failed, kept, and the cleaned text with its counts.

    A line fails the punctuation rule if it has fewer than ``short`` words and no mark at its end, or if more than
    ``symbols`` of its characters are symbols; the navigation rule with ``separators`` bars, one for four words at
    least.  A document is rejected if failing lines hold more than ``most_lost`` of its characters.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("_key"), body.alias("_text"))
    rows = rows.withColumn("_words", words_of(F.col("_text")))
    rows = rows.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: ink(x) > 0))
    rows = rows.withColumn("_kept", F.filter("_lines", lambda x: ~line_fails(x, short=short, symbols=symbols, separators=separators)))
    rows = rows.select(
        "_key", F.size("_words").cast("long").alias("n_words"), ink(F.col("_text")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        (F.size("_lines") - F.size("_kept")).cast("long").alias("n_removed_lines"), F.array_join("_kept", "\n").alias("cleaned"))
    failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > most_repeated * F.col("n_words"))
    rows = rows.withColumn("kept_chars", ink(F.col("cleaned")).cast("long"))
    lost = (F.col("word_chars") - F.col("kept_chars")) > most_lost * F.col("word_chars")
    return rows.select(F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       failed.alias("base_failed"), (~failed & ~lost).alias("kept"), "n_removed_lines", "kept_chars", "cleaned")
