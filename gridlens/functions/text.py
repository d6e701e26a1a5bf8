"""Text normalisation, tokens and small text measures as column expressions.

Only compatibility normalisation and case folding of non-ASCII text need Python; ASCII rows never leave the JVM.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlens.functions import lexicon as L


@F.pandas_udf(T.StringType())
def _fold_unicode(text: pd.Series) -> pd.Series:
    return text.map(lambda s: s if s is None else unicodedata.normalize("NFKC", s).casefold())


# Spark writes out what lies between two chained Python functions wherever it is used.  Not so behind one whose values it may
# not compute again: a text that is cleaned once is then folded, cut and matched as a column.
_fold_unicode = _fold_unicode.asNondeterministic()


@F.pandas_udf(T.StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda s: s if s is None else html.unescape(s))


_unescape = _unescape.asNondeterministic()


def let(value: Column, body) -> Column:
    """Name a value inside one expression, so that lambdas refer to it instead of computing it per element."""
    return F.transform(F.array(value), body)[0]


def is_ascii(text: Column) -> Column:
    return ~text.rlike(r"[^\x00-\x7F]")


def folded(text: Column) -> Column:
    """Compatibility-normalised, case-folded text."""
    plain = is_ascii(text)
    return F.coalesce(F.when(plain, F.lower(text)), _fold_unicode(F.when(~plain, text)))


def unescaped(text: Column) -> Column:
    """HTML entities decoded; rows without an ampersand skip Python."""
    has = text.contains("&")
    return F.coalesce(F.when(~has, text), _unescape(F.when(has, text)))


def collapse(text: Column) -> Column:
    """Whitespace runs as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalized(text: Column) -> Column:
    """Letters and digits only, without option markers, for comparing texts."""
    quoted = F.replace(folded(text), F.lit("’"), F.lit("'"))
    unmarked = F.regexp_replace(quoted, r"(?U)\b(?:option|choice|answer)\s+[a-z]\b", " ")
    return F.trim(F.regexp_replace(unmarked, r"[^\p{L}\p{N}]+", " "))


def lexical_text(text: Column) -> Column:
    """Folded text with plain quotes and blanks for dashes."""
    return F.regexp_replace(F.translate(folded(text), "’‘", "''"), "[‐‑–—-]", " ")


def words(items: Sequence[str]) -> Column:
    """Constant array of words."""
    return F.split(F.lit(" ".join(items)), " ")


def _cut(token: Column, n: int) -> Column:
    return F.substring(token, F.lit(1), F.length(token) - n)


def listed_tokens(lexical: Column, stopwords: Sequence[str] = ()) -> Column:
    """Tokens of text that already went through :func:`lexical_text`."""
    found = F.regexp_extract_all(lexical, F.lit(L.TOKEN), F.lit(0))
    bare = F.transform(found, lambda t: F.when((F.length(t) > 2) & t.endswith("'s"), _cut(t, 2)).otherwise(t))
    if not stopwords:
        return F.filter(bare, lambda t: F.length(t) > 1)
    return F.filter(bare, lambda t: (F.length(t) > 1) & ~t.isin(list(stopwords)))


def raw_tokens(text: Column, stopwords: Sequence[str] = ()) -> Column:
    """Word and number tokens longer than one character, without possessive endings or stopwords."""
    return listed_tokens(lexical_text(text), stopwords)


def canonical_terms(tokens: Column) -> Column:
    """Collapse a few safe English inflections; tokens without a final s are left alone at once."""
    irregular = F.create_map(*[F.lit(part) for pair in L.IRREGULAR.items() for part in pair])

    def canonical(t: Column) -> Column:
        size = F.length(t)
        plural = (
            F.when((size > 4) & t.endswith("ies") & ~F.substring(t, -4, 1).isin(*"aeiou"), F.concat(_cut(t, 3), F.lit("y")))
            .when((size > 4) & (t.endswith("xes") | t.endswith("zes") | t.endswith("ches") | t.endswith("shes")
                                | t.endswith("sses")), _cut(t, 2))
            .when((size > 3) & ~F.substring(t, -2, 2).isin("ss", "us", "is"), _cut(t, 1))
            .otherwise(t)
        )
        return F.when(t.endswith("s"), plural).when(t.isin(list(L.IRREGULAR)), irregular[t]).otherwise(t)

    return F.transform(tokens, canonical)


def content_tokens(text: Column) -> Column:
    return raw_tokens(text, L.ANCHOR_STOPWORDS)


def term_tokens(text: Column) -> Column:
    """TF-IDF terms: stopwords leave before inflections collapse."""
    return canonical_terms(raw_tokens(text, L.TERM_STOPWORDS))


def anchor_tokens(text: Column) -> Column:
    """Canonical content terms followed by negation anchors for the three terms after each negator."""
    return with_negation_anchors(canonical_terms(content_tokens(text)))


def kept_words(tokens: Column, stopwords: Sequence[str]) -> Column:
    """Tokens longer than one character that are not stopwords."""
    return F.filter(tokens, lambda t: (F.length(t) > 1) & ~t.isin(list(stopwords)))


def with_negation_anchors(tokens: Column) -> Column:
    none = F.array().cast("array<string>")

    def anchored(items: Column) -> Column:
        scoped = F.transform(items, lambda t, i: F.when(
            t.isin(L.NEGATIONS), F.transform(F.slice(items, i + 2, F.lit(3)), lambda x: F.concat(F.lit("NEG::"), x)))
            .otherwise(none))
        return F.concat(items, F.flatten(scoped))

    return let(tokens, anchored)


_HEAVY = f"^(?:NEG::.*|{'|'.join(L.NEGATIONS)}|[.]*\\p{{Nd}}[\\p{{Nd}}.]*)$"
_MEDIUM = f"^(?:{'|'.join(L.LATERALITY + L.TIMING)}|.*%)$"


def anchor_weight(term: Column) -> Column:
    """Polarity and numbers weigh double, side, time and percentages one and a half."""
    return F.when(term.rlike(_HEAVY), 2.0).when(term.rlike(_MEDIUM), 1.5).otherwise(1.0)


def measurement_stem(stem: Column) -> Column:
    """Stem without its item number in the source."""
    return F.regexp_replace(stem, L.ITEM_NUMBER, "")


def contains_phrase(tokens: Column, phrase: Column) -> Column:
    """Whether the phrase occurs as consecutive tokens."""
    def padded(items: Column) -> Column:
        return F.concat(F.lit(" "), F.array_join(items, " "), F.lit(" "))

    return (F.size(phrase) > 0) & (F.instr(padded(tokens), padded(phrase)) > 0)


def informative(tokens: Column, minimum: int) -> Column:
    """Enough tokens, enough different ones, and none that makes up more than half."""
    def judged(items: Column) -> Column:
        size = F.size(items)
        # A token above one half of a sorted list must sit at its middle, so one candidate has to be counted.
        top = let(F.get(F.array_sort(items), F.floor((size - 1) / 2).cast("int")),
                  lambda middle: F.size(F.filter(items, lambda t: t == middle)))
        return (size >= minimum) & (F.size(F.array_distinct(items)) >= min(4, minimum)) & (size > 0) & (top * 2 <= size)

    return let(tokens, judged)


def strip_markdown(text: Column) -> Column:
    """Markdown headings and emphasis removed, line breaks kept."""
    return F.regexp_replace(F.regexp_replace(text, r"(?m)^[^\S\n]{0,3}#{1,6}[^\S\n]*", ""), r"\*\*|__|~~|`+", "")


def plain_text(text: Column, entities: Callable[[Column], Column] = unescaped) -> Column:
    """Visible text of markup: tags, fences and emphasis gone, ``entities`` decoded, whitespace collapsed."""
    untagged = F.regexp_replace(text, r"(?Us)</?(?:[^\W\d]|_)[\w.:-]*(?:\s+[^<>]*?)?\s*/?>", " ")
    unfenced = F.regexp_replace(untagged, r"(?i)```(?:xml|markdown|md|text)?", " ")
    bare = F.regexp_replace(unfenced, r"\*\*|__|~~|`+", "")
    return collapse(entities(bare))


def outer_fence_removed(text: Column) -> Column:
    """Document inside one whole-response code fence, else the trimmed text."""
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    fence = r"(?is)\A```(?:xml|markdown|md|text)?[ \t]*\r?\n(.*)\r?\n```\z"
    inner = F.regexp_replace(F.regexp_extract(trimmed, fence, 1), r"(?U)^\s+|\s+$", "")
    return F.when(trimmed.rlike(fence), inner).otherwise(trimmed)


def guidance_removed(text: Column, guidance: Column) -> Column:
    """Text without an exact leading copy of its guidance."""
    copied = text.startswith(F.concat(guidance, F.lit(" ")))
    rest = F.ltrim(F.substring(text, F.length(guidance) + 2, F.length(text)))
    return F.when(text == guidance, "").when(copied, rest).otherwise(text)


def sentences(text: Column) -> Column:
    """Sentences by end punctuation or line breaks, without empty ones."""
    parts = F.split(text, r"(?<=[.!?])\s+|\n+")
    return F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))), lambda s: s != "")


def fact_tokens(text: Column) -> Column:
    """Tokens of the fact measure: ASCII words with inner hyphens, and numbers."""
    found = F.regexp_extract_all(F.lower(text), F.lit(L.FACT_TOKEN), F.lit(0))
    return kept_words(found, L.FACT_STOPWORDS)


FEATURE_KINDS = ("numbers", "negation", "laterality", "timing", "direction")


def hard_features(text: Column, tokens: Column | None = None) -> Column:
    """Numbers with units, negation, side, timing and direction words, as a map without empty kinds."""
    tokens = fact_tokens(text) if tokens is None else tokens
    numbers = F.transform(F.regexp_extract_all(text, F.lit(L.NUMBER), F.lit(0)),
                          lambda n: F.replace(F.lower(n), F.lit(" "), F.lit("")))
    lists = (L.FACT_NEGATION, L.FACT_LATERALITY, L.FACT_TIMING, L.FACT_DIRECTION)
    values = [F.array_sort(numbers), *[F.array_sort(F.array_intersect(tokens, words(w))) for w in lists]]
    every = F.map_from_arrays(words(FEATURE_KINDS), F.array(*values))
    return F.map_filter(every, lambda _, v: F.size(v) > 0)


def text_sign(value: Column, tolerance: float = 1e-12) -> Column:
    return F.when(value > tolerance, 1).when(value < -tolerance, -1).otherwise(0)


def format_p(value: Column) -> Column:
    """p-value for a report."""
    return F.when(value.isNull(), "NA").when(value < 0.0001, "<0.0001").otherwise(F.format_string("%.4f", value))


def highlighted(text: Column, terms: Column) -> Column:
    """Text as HTML with every word whose canonical form is a wanted term marked."""
    parts = F.split(text, r"(?<=\s)(?=\S)|(?<=\S)(?=\s)")
    bare = F.transform(parts, lambda p: F.regexp_replace(F.lower(p), r"[^\p{L}\p{N}%.']|[.]$", ""))
    safe = F.transform(parts, lambda p: F.replace(F.replace(F.replace(p, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                                                  F.lit(">"), F.lit("&gt;")))
    pairs = F.arrays_zip(safe.alias("html"), canonical_terms(bare).alias("term"))
    return F.array_join(F.transform(pairs, lambda p: F.when(
        F.array_contains(terms, p["term"]), F.concat(F.lit("<mark>"), p["html"], F.lit("</mark>"))).otherwise(p["html"])), "")
