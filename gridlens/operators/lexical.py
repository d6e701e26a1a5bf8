"""Stem coverage of responses: TF-IDF recall, shared recall and polarity-aware anchor recall.

Stem terms with their weights are prepared once per question and joined to its responses.  A response is then
measured inside its own row: shared terms come from a hashed array intersection, and only terms that the stem
repeats need counting.  Response text is never exploded or shuffled for scoring.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.functions import lexicon as L
from gridlens.functions import text as X

_NO_TERMS = "array<string>"
_REVIEWED = json.dumps([{"abbr": a, "terms": e.split()} for a, e in L.ABBREVIATIONS.items()])


def smooth_idf(documents: Column, frequency: Column, cap: float = L.IDF_CAP) -> Column:
    return F.least(F.log((documents + F.lit(1.0)) / (frequency + F.lit(1.0))) + F.lit(1.0), F.lit(cap))


def term_weight(count: Column, idf: Column) -> Column:
    """Sublinear term frequency times IDF; zero for a missing term."""
    return F.when(count > 0, (F.lit(1.0) + F.log(count.cast("double"))) * idf).otherwise(F.lit(0.0))


def document_frequencies(documents: DataFrame, text: str) -> DataFrame:
    """Number of documents that hold each term."""
    terms = documents.select(F.explode(F.array_distinct(X.term_tokens(F.col(text)))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def term_frequencies(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Occurrences of each term in each document; all of a document's terms combine before the shuffle."""
    terms = documents.select(key, F.explode(X.term_tokens(F.col(text))).alias("term"))
    return terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def selected_terms(questions: DataFrame, stem: str) -> DataFrame:
    """Distinct terms of all stems."""
    return questions.select(F.explode(X.term_tokens(X.measurement_stem(F.col(stem)))).alias("term")).distinct()


def reference_frequencies(terms: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Document frequencies of the selected terms only; unknown terms have zero."""
    known = frequencies.join(terms, "term", "left_semi")
    return terms.join(known, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))


def _counted(tokens: Column) -> Column:
    """Distinct terms with their counts."""
    return X.let(tokens, lambda items: F.transform(F.array_distinct(items), lambda t: F.struct(
        t.alias("term"), F.size(F.filter(items, lambda x: x == t)).alias("n"))))


def expansions(stem: Column) -> Column:
    """Abbreviations that may stand for their expansion: the reviewed list and pairs spelled out in the stem.

    In ``long form (ABC)`` every word gives one initial, so only as many words as the abbreviation has letters can
    match; the stem's own pair replaces a reviewed one.
    """
    long = F.regexp_extract_all(stem, F.lit(L.SPELLED_OUT), F.lit(1))
    short = F.regexp_extract_all(stem, F.lit(L.SPELLED_OUT), F.lit(2))
    pairs = F.arrays_zip(long.alias("long"), short.alias("short"))

    def explicit(pair: Column) -> Column:
        parts = F.regexp_extract_all(pair["long"], F.lit("[A-Za-z0-9]+"), F.lit(0))
        width = F.length(pair["short"])
        window = F.when(F.size(parts) >= width, F.slice(parts, F.size(parts) - width + 1, width))
        initials = F.array_join(F.transform(window, lambda w: F.upper(F.substring(w, 1, 1))), "")
        terms = X.canonical_terms(X.kept_words(F.transform(window, lambda w: F.lower(w)), L.TERM_STOPWORDS))
        return F.when((initials == pair["short"]) & (F.size(terms) > 0),
                      F.struct(F.lower(pair["short"]).alias("abbr"), terms.alias("terms")))

    kind = "array<struct<abbr:string,terms:array<string>>>"
    # The pattern for spelled-out forms is costly, so it only runs where an abbreviation stands in parentheses.
    written = F.when(stem.rlike(r"\([A-Z][A-Z0-9]{1,7}\)"), F.array_compact(F.transform(pairs, explicit))).otherwise(
        F.array().cast(kind))

    def canonical(items: Column) -> Column:
        return F.transform(items, lambda p: F.struct(
            p["abbr"].alias("abbr"), X.canonical_terms(F.array(p["abbr"]))[0].alias("abbr_term"),
            X.canonical_terms(p["terms"]).alias("terms")))

    reviewed = canonical(F.from_json(F.lit(_REVIEWED), kind))

    def merged(found: Column) -> Column:
        # A later pair for the same abbreviation wins.
        last = F.filter(found, lambda p, i: ~F.exists(
            F.slice(found, i + 2, F.greatest(F.size(found) - i - 1, F.lit(0))), lambda q: q["abbr"] == p["abbr"]))
        own = F.transform(last, lambda p: p["abbr"])
        kept = F.filter(reviewed, lambda r: ~F.array_contains(own, r["abbr"]))
        return F.when(F.size(found) == 0, reviewed).otherwise(F.concat(kept, canonical(last)))

    return X.let(written, merged)


def stem_profiles(questions: DataFrame, frequencies: DataFrame, documents: int, *, key: str = "question_id",
                  stem: str = "stem") -> DataFrame:
    """Weighted stem terms of every question, ready to be joined to its responses.

    Result: key, stem_tokens, terms (term, n, idf), anchors (term, n, weight), expansions.
    """
    scored = questions.select(key, X.measurement_stem(F.col(stem)).alias("scored"))
    tokens = scored.select(key, "scored", X.term_tokens(X.measurement_stem(F.col("scored"))).alias("stem_tokens"),
                           X.anchor_tokens(F.col("scored")).alias("anchor_list"))
    exploded = tokens.select(key, F.explode(_counted(F.col("stem_tokens"))).alias("t")).select(key, "t.term", "t.n")
    idf = smooth_idf(F.lit(float(documents)), F.coalesce("df", F.lit(0)))
    weighted = exploded.join(frequencies.select("term", "df"), "term", "left").select(
        key, F.struct("term", "n", idf.alias("idf")).alias("entry"))
    grouped = weighted.groupBy(key).agg(F.sort_array(F.collect_list("entry")).alias("terms"))
    empty = F.array().cast("array<struct<term:string,n:int,idf:double>>")
    profile = tokens.join(grouped, key, "left")
    return profile.select(
        key, "stem_tokens", F.coalesce("terms", empty).alias("terms"),
        F.transform(_counted(F.col("anchor_list")), lambda e: F.struct(
            e["term"].alias("term"), e["n"].alias("n"), X.anchor_weight(e["term"]).alias("weight"))).alias("anchors"),
        "anchor_list", expansions(F.col("scored")).alias("expansions"))


def _with_credit(tokens: Column, stem_tokens: Column, known: Column) -> Column:
    """Response terms plus those credited through abbreviations, in either direction."""
    def credit(pair: Column) -> Column:
        to_short = F.when(F.array_contains(stem_tokens, pair["abbr_term"]) & X.contains_phrase(tokens, pair["terms"]),
                          F.array(pair["abbr_term"])).otherwise(F.array().cast(_NO_TERMS))
        to_long = F.when(F.array_contains(tokens, pair["abbr_term"]) & X.contains_phrase(stem_tokens, pair["terms"]),
                         pair["terms"]).otherwise(F.array().cast(_NO_TERMS))
        return F.concat(to_short, to_long)

    return F.concat(tokens, F.flatten(F.transform(known, credit)))


def _anchor_credit(candidate: Column, anchors: Column, stem_anchors: Column, known: Column) -> Column:
    """Anchor terms of a response plus abbreviation credit for written acronyms."""
    acronyms = F.transform(F.regexp_extract_all(candidate, F.lit(L.ACRONYM), F.lit(0)), lambda a: F.lower(a))

    def credited(written: Column) -> Column:
        def credit(pair: Column) -> Column:
            to_long = F.when(F.array_contains(written, pair["abbr"]) & X.contains_phrase(stem_anchors, pair["terms"]),
                             pair["terms"]).otherwise(F.array().cast(_NO_TERMS))
            to_short = F.when(
                F.array_contains(stem_anchors, pair["abbr_term"]) & X.contains_phrase(anchors, pair["terms"]),
                F.array(pair["abbr_term"])).otherwise(F.array().cast(_NO_TERMS))
            return F.concat(to_long, to_short)

        return F.concat(anchors, F.flatten(F.transform(known, credit)))

    return X.let(acronyms, credited)


def _overlap(entries: Column, first: Column, second: Column) -> Column:
    """Stem entries with the count the response shares with them (with both lists, where a second one is given).

    Shared terms come from a hashed intersection; a count beyond one is only looked up for terms the stem repeats.
    """
    names = F.transform(entries, lambda e: e["term"])
    sides = F.array_compact(F.array(
        F.struct(F.array_intersect(names, first).alias("hits"), first.alias("tokens")),
        F.when(second.isNotNull(), F.struct(F.array_intersect(names, second).alias("hits"), second.alias("tokens")))))

    def common(known: Column, entry: Column) -> Column:
        counts = F.transform(known, lambda side: F.when(~F.array_contains(side["hits"], entry["term"]), 0).when(
            entry["n"] == 1, 1).otherwise(F.size(F.filter(side["tokens"], lambda t: t == entry["term"]))))
        return F.least(entry["n"], F.array_min(counts))

    return X.let(sides, lambda known: F.transform(
        entries, lambda e: F.struct(e.alias("entry"), common(known, e).alias("shared"))))


def _sum(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda total, item: total + value(item))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _tfidf(overlap: Column) -> Column:
    """Recall, credited weight and recall over rare terms of an overlap."""
    weighed = F.transform(overlap, lambda o: F.struct(
        (o["entry"]["idf"] >= F.lit(L.HIGH_IDF)).cast("double").alias("rare"),
        term_weight(o["entry"]["n"], o["entry"]["idf"]).alias("whole"),
        term_weight(o["shared"], o["entry"]["idf"]).alias("part")))

    def measured(items: Column) -> Column:
        part, whole = _sum(items, lambda w: w["part"]), _sum(items, lambda w: w["whole"])
        rare_part, rare_whole = _sum(items, lambda w: w["part"] * w["rare"]), _sum(items, lambda w: w["whole"] * w["rare"])
        return F.struct(_ratio(part, whole).alias("recall"), part.alias("credit"),
                        _ratio(rare_part, rare_whole).alias("rare_recall"))

    return X.let(weighed, measured)


def _anchor(overlap: Column) -> Column:
    whole = _sum(overlap, lambda o: o["entry"]["weight"] * o["entry"]["n"])
    return _ratio(_sum(overlap, lambda o: o["entry"]["weight"] * o["shared"]), whole)


def _side(first: Column, second: Column | None = None) -> Column:
    return F.struct(first.alias("a"), (second if second is not None else F.lit(None).cast(_NO_TERMS)).alias("b"))


def score_coverage(responses: DataFrame, profiles: DataFrame, *, key: str = "question_id", facts: str = "facts",
                   implications: str = "implications", keep_all: bool = False,
                   further: dict[str, Column] | None = None) -> DataFrame:
    """Twelve coverage measures of every response; other columns pass through (all of them with ``keep_all``).

    ``further`` names more texts whose anchor recall is wanted.
    """
    further = further or {}
    joined = responses.join(profiles, key)
    texts = joined.select(
        "*", F.array(facts, implications, F.concat_ws(" ", facts, implications), *further.values()).alias("_texts"),
        F.array(X.lexical_text(F.col(facts)), X.lexical_text(F.col(implications))).alias("_lexical"),
        *([F.array(*[X.lexical_text(c) for c in further.values()]).alias("_further")] if further else []))
    whole = F.concat("_lexical", F.array(F.array_join("_lexical", " ")), *(["_further"] if further else []))
    prepared = texts.select(
        "*",
        F.transform("_lexical", lambda t: X.canonical_terms(X.listed_tokens(t, L.TERM_STOPWORDS))).alias("_terms"),
        F.transform(whole, lambda t: X.with_negation_anchors(
            X.canonical_terms(X.listed_tokens(t, L.ANCHOR_STOPWORDS)))).alias("_anchors"))
    stem, known, anchors = F.col("stem_tokens"), F.col("expansions"), F.col("anchor_list")
    credited = prepared.select(
        "*", F.transform("_terms", lambda t: _with_credit(t, stem, known)).alias("_t"),
        F.transform(F.arrays_zip("_texts", "_anchors"), lambda z: _anchor_credit(
            z["_texts"], z["_anchors"], anchors, known)).alias("_a"))
    t, a, plain = F.col("_t"), F.col("_a"), F.col("_anchors")
    term_sides = F.array(_side(t[0]), _side(t[1]), _side(F.concat(t[0], t[1])), _side(t[0], t[1]))
    anchor_sides = F.array(_side(a[0]), _side(a[1]), _side(a[2]), _side(plain[0], plain[1]),
                           *[_side(a[3 + i]) for i in range(len(further))])
    measured = credited.select(
        "*",
        F.transform(term_sides, lambda s: _tfidf(_overlap(F.col("terms"), s["a"], s["b"]))).alias("_tm"),
        F.transform(anchor_sides, lambda s: _anchor(_overlap(F.col("anchors"), s["a"], s["b"]))).alias("_am"),
        (F.size(F.col("_terms")[0]) + F.size(F.col("_terms")[1])).cast("double").alias("_n"))
    helpers = {"stem_tokens", "terms", "anchors", "anchor_list", "expansions"}
    own = {"_texts", "_lexical", "_terms", "_anchors", "_t", "_a", "_tm", "_am", "_n", "_further"}
    passed = [c for c in measured.columns if c not in own and c not in helpers
              and (keep_all or not c.startswith("_"))]
    tm, am, n = F.col("_tm"), F.col("_am"), F.col("_n")
    return measured.select(
        *passed,
        tm[0]["recall"].alias("facts_tfidf_recall"),
        tm[1]["recall"].alias("implications_tfidf_recall"),
        tm[2]["recall"].alias("preanswer_tfidf_recall"),
        tm[2]["rare_recall"].alias("preanswer_high_idf_tfidf_recall"),
        tm[3]["recall"].alias("facts_implications_shared_tfidf_recall"),
        tm[3]["rare_recall"].alias("facts_implications_shared_high_idf_recall"),
        F.when(n > 0, F.lit(100.0) * tm[2]["credit"] / n).otherwise(0.0).alias("preanswer_tfidf_density_per_100_tokens"),
        n.alias("preanswer_tfidf_token_count"),
        am[0].alias("facts_anchor_recall"),
        am[1].alias("implications_anchor_recall"),
        am[2].alias("preanswer_anchor_recall"),
        am[3].alias("shared_anchor_recall"),
        *[am[4 + i].alias(name) for i, name in enumerate(further)],
    )


def anchor_recall(stem: Column, output: Column) -> Column:
    """Anchor recall of one response for its stem, without prepared profiles."""
    scored = X.measurement_stem(stem)

    def measured(sides: Column) -> Column:
        entries = F.transform(_counted(sides["stem"]), lambda e: F.struct(
            e["term"].alias("term"), e["n"].alias("n"), X.anchor_weight(e["term"]).alias("weight")))
        tokens = _anchor_credit(output, sides["output"], sides["stem"], expansions(scored))
        return _anchor(_overlap(entries, tokens, F.lit(None).cast(_NO_TERMS)))

    return X.let(F.struct(X.anchor_tokens(scored).alias("stem"), X.anchor_tokens(output).alias("output")), measured)


def multiset_only_left(left: DataFrame, right: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Counts that the left side holds beyond the right."""
    other = right.select(*keys, F.col(count).alias("_other"))
    excess = F.col(count) - F.coalesce("_other", F.lit(0))
    return left.join(other, keys, "left").select(*keys, excess.alias(count)).filter(F.col(count) > 0)


def multiset_common(left: DataFrame, right: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Counts both sides share."""
    other = right.select(*keys, F.col(count).alias("_other"))
    return left.join(other, keys).select(*keys, F.least(count, "_other").alias(count))


def multiset_sum(left: DataFrame, right: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Added counts of both sides."""
    return left.unionByName(right).groupBy(*keys).agg(F.sum(count).alias(count)).filter(F.col(count) > 0)


def _credit_counts(rows: DataFrame, key: str, tokens: str, name: str) -> DataFrame:
    """Terms of a response with what abbreviations credit, counted per response."""
    terms = _with_credit(F.col(tokens), F.col("_stem_tokens"), F.col("_known"))
    return rows.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias(name))


def coverage_spans(rows: DataFrame, frequencies: DataFrame, documents: int, *, key: str, stem: str = "stem",
                   first: str = "first", second: str = "second", cap: float = L.IDF_CAP) -> DataFrame:
    """Where a stem is covered by either of two responses, as character spans for display.

    A response gives every term as many credits as it holds the term; they go to the term's places in text order, first
    those both responses have (``common``), then those only this one has (``unique``).  Stopwords and ``not`` are never
    marked, so a place depends on its rank among equal terms alone and no text is walked.  ``start`` counts from zero;
    ``opacity`` grows with the IDF of a unique term.  Result: key, side, start, end, term, kind, opacity.
    """
    base = rows.select(key, X.measurement_stem(F.col(stem)).alias("_source"), first, second).select(
        key, "_source", X.term_tokens(F.col("_source")).alias("_stem_tokens"), expansions(F.col("_source")).alias("_known"),
        X.term_tokens(F.col(first)).alias("_first"), X.term_tokens(F.col(second)).alias("_second"))
    surfaces = F.regexp_extract_all("_source", F.lit(L.TOKEN), F.lit(0)).alias("surface")
    gaps = F.split("_source", L.TOKEN, -1).alias("gap")
    places = base.select(key, F.posexplode(F.arrays_zip(gaps, surfaces)).alias("place", "part")).filter("part.surface is not null")
    before = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("part.surface")
    placed = places.select(key, "place", "part.surface", size.alias("_size"),
                           (F.sum(F.length("part.gap") + size).over(before) - size).alias("start"))
    term = X.term_tokens(F.col("surface"))
    shown = placed.withColumn("term", F.when(F.lower("surface") != "not", F.when(F.size(term) == 1, F.get(term, F.lit(0))))
                              ).filter("term is not null")
    counts = _credit_counts(base, key, "_first", "_n1").join(_credit_counts(base, key, "_second", "_n2"), [key, "term"], "full")
    joined = shown.join(counts.fillna(0, ["_n1", "_n2"]), [key, "term"]).withColumn(
        "_rank", F.row_number().over(Window.partitionBy(key, "term").orderBy("place")))
    kind = F.when(F.col("_rank") <= F.least("_n1", "_n2"), "common").otherwise("unique")
    sides = F.array_compact(F.array(*[F.when(F.col("_rank") <= F.col(n), F.struct(F.lit(side).alias("side"), kind.alias("kind")))
                                      for side, n in (("A", "_n1"), ("B", "_n2"))]))
    spans = joined.select(key, "term", "start", (F.col("start") + F.col("_size")).alias("end"), F.explode(sides).alias("s"))
    idf = smooth_idf(F.lit(float(documents)), F.coalesce("df", F.lit(0)), cap)
    strength = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (idf - 1) / max(1.0, cap - 1)))
    return spans.join(frequencies.select("term", "df"), "term", "left").select(
        key, "s.side", "start", "end", "term", "s.kind",
        F.when(F.col("s.kind") == "unique", F.lit(0.16) + F.lit(0.5) * strength).alias("opacity"))
