"""Which choice a piece of prose is about when it names no label: by shared stems, or by words only one choice has.

Every choice becomes a profile of word sets, computed once a question; a fragment becomes one set of stems.  Choices are then
compared by sizes of intersections: one wins if it is ahead of each other choice by a margin.  Shares are compared as
integer products.  A null or empty fragment, choices without words, and ties give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlens.functions import text as X

# Words that tell nothing about a choice, the share of a choice's stems that has to be said and its lead in
# percent, the lead of own words in words, or in percent of the own words, and the length of a word that may stand alone.
EMPTY_WORDS = "a an the of and or with for to in on is are cell answer choice option".split()
NOT_AVAILABLE = ("n", "a")
SHARE, LEAD = 80, 15
OWN_WORDS, OWN_LEAD, OWN_SHARE_LEAD, LONG_WORD = 2, 2, 35, 8


def stems(normalized: Column) -> Column:
    """Distinct words of normalised text without their endings: -ies, -ing, -ed and a single -s of longer words."""
    singular = F.regexp_replace(normalized, r"(?<=[^ ]{3})ies(?= |$)", "y")
    bare = F.regexp_replace(singular, r"(?<=[^ ]{4})(?:ing|ed)(?= |$)|(?<=[^ ]{3}[^s ])s(?= |$)", "")
    return F.array_distinct(F.filter(F.split(bare, " "), lambda w: w != ""))


def _repaired(choice_texts: Column) -> Column:
    """Without an ``rn`` that stands for a line break at the end of words, if two or more choices end in it."""
    broken = F.size(F.filter(choice_texts, lambda t: t.endswith("rn"))) >= 2
    return F.when(broken, F.transform(choice_texts, lambda t: F.regexp_replace(t, r"(?<=[^ ]{3})rn(?= |$)", ""))).otherwise(choice_texts)


def profiles(labels: Column, choice_texts: Column) -> Column:
    """Per choice: label, its stems, and its telling stems that no other choice has.

    ``choice_texts`` are normalised.  A choice that says nothing, or only that it is not available, has no stems.
    """
    def told(words: Column) -> Column:
        return F.filter(words, lambda w: ~w.isin(EMPTY_WORDS) & ((F.length(w) >= 3) | w.rlike(r"\p{Nd}")))

    def build(sets: Column) -> Column:
        return F.transform(sets, lambda mine, place: F.struct(
            F.get(labels, place).alias("label"),
            F.when(F.size(F.array_except(mine, X.words(NOT_AVAILABLE))) > 0, mine).otherwise(F.array().cast("array<string>")).alias("stems"),
            F.array_except(told(mine), F.flatten(F.filter(sets, lambda _, other: other != place))).alias("own")))

    return X.let(F.transform(_repaired(choice_texts), stems), build)


def _ahead(found: Column, beats) -> Column:
    """Label of the one entry that beats all others; every entry has its own label."""
    winners = F.filter(found, lambda c: F.forall(found, lambda other: (other["label"] == c["label"]) | beats(c, other)))
    return F.when(F.size(winners) == 1, winners[0]["label"])


def by_wording(fragment_stems: Column, choice_profiles: Column) -> Column:
    """The choice most of whose stems are said, by a clear lead."""
    counted = F.transform(F.filter(choice_profiles, lambda c: F.size(c["stems"]) > 0), lambda c: F.struct(
        c["label"].alias("label"), F.size(F.array_intersect(c["stems"], fragment_stems)).cast("long").alias("said"),
        F.size(c["stems"]).cast("long").alias("size")))

    def beats(a: Column, b: Column) -> Column:
        return 100 * (a["said"] * b["size"] - b["said"] * a["size"]) > LEAD * a["size"] * b["size"]

    def lead(found: Column) -> Column:
        top = _ahead(found, beats)
        return F.when(F.exists(found, lambda c: (c["label"] == top) & (100 * c["said"] >= SHARE * c["size"])), top)

    return X.let(counted, lead)


def by_own_words(fragment_stems: Column, choice_profiles: Column) -> Column:
    """The choice of which several words are said that no other choice has; a single long one or one with digits may do."""
    def alone(said: Column) -> Column:
        return F.exists(said, lambda w: (F.length(w) >= LONG_WORD) | w.rlike(r"\p{Nd}"))

    counted = F.transform(choice_profiles, lambda c: F.struct(
        c["label"].alias("label"), F.array_intersect(c["own"], fragment_stems).alias("words"), F.size(c["own"]).cast("long").alias("size")))
    sized = F.transform(
        F.filter(counted, lambda c: (F.size(c["words"]) >= OWN_WORDS) | ((F.size(c["words"]) == 1) & (c["size"] == 1) & alone(c["words"]))),
        lambda c: F.struct(c["label"].alias("label"), F.size(c["words"]).cast("long").alias("said"), c["size"].alias("size")))

    def beats(a: Column, b: Column) -> Column:
        wider = 100 * (a["said"] * b["size"] - b["said"] * a["size"]) >= OWN_SHARE_LEAD * a["size"] * b["size"]
        return (a["said"] >= b["said"] + OWN_LEAD) | ((a["said"] > b["said"]) & wider)

    return X.let(sized, lambda found: _ahead(found, beats))
