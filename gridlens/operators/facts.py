"""Clause-sized facts of question stems and their preservation in responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.functions import lexicon as L
from gridlens.functions import text as X


def _standalone(clause: Column) -> Column:
    """Whether a clause states something by itself."""
    return (
        (clause != "")
        & ~clause.rlike(L.SOURCE_NUMBER)
        & ~clause.rlike(L.QUESTION_START)
        & ~clause.rlike(L.TOPIC_ONLY)
        & ~clause.rlike(L.META_PREFIX)
        & ~clause.rlike(L.OPEN_ENDED)
        & (F.size(X.fact_tokens(clause)) > 0)
    )


def _trimmed(clause: Column) -> Column:
    return F.trim(clause, F.lit(" ,"))


def _without_question(sentence: Column) -> Column:
    """The statement before an explicit question clause."""
    tail = F.lit(" ,;:")
    before_capital = F.rtrim(F.regexp_extract(sentence, "(?s)^(.*?)" + L.QUESTION_CLAUSE, 1), tail)
    before_conditional = F.rtrim(F.regexp_extract(sentence, L.CONDITIONAL_QUESTION, 1), tail)
    return (
        F.when(sentence.rlike(L.QUESTION_START), "")
        .when(sentence.rlike(L.QUESTION_CLAUSE), before_capital)
        .when(sentence.rlike(L.CONDITIONAL_QUESTION), before_conditional)
        .otherwise(sentence)
    )


def fact_clauses(stem: Column) -> Column:
    """Declarative clauses of a stem, without its question."""
    whole = X.collapse(stem)
    sentences = F.transform(F.split(whole, r"(?<=[.!?])\s+|\s*;\s*"), lambda s: _without_question(F.trim(s)))
    stated = F.filter(sentences, lambda s: _standalone(_trimmed(s)))
    clauses = F.flatten(F.transform(stated, lambda s: F.transform(F.split(s, L.COORDINATE_SPLIT), _trimmed)))
    return F.when((whole == "") | whole.rlike(L.TOPIC_ONLY), F.array().cast("array<string>")).otherwise(
        F.filter(clauses, _standalone))


def fact_inventory(questions: DataFrame, key: str = "question_id", stem: str = "stem") -> DataFrame:
    """Facts of every question with weight, tokens and hard features.

    Result: key, stem, facts, repair_endpoint_eligible, inapplicability_reason, fact_complexity.
    """
    split = questions.select("*", fact_clauses(F.col(stem)).alias("_clauses"))

    def fact(clause: Column, index: Column) -> Column:
        features = X.hard_features(clause)
        return F.struct(
            F.concat(F.col(key).cast("string"), F.lit(":F"), F.lpad((index + 1).cast("string"), 2, "0")).alias("fact_id"),
            clause.alias("source_text"),
            F.when(F.size(F.map_keys(features)) > 0, 2).otherwise(1).alias("weight"),
            features.alias("hard_features"),
            F.array_distinct(X.fact_tokens(clause)).alias("tokens"),
        )

    size = F.size("_clauses")
    return split.select(
        "*", F.transform("_clauses", fact).alias("facts_list"),
        (size > 0).alias("repair_endpoint_eligible"),
        F.when(size == 0, "stem_has_no_standalone_fact_outside_the_question").alias("inapplicability_reason"),
        F.when(size == 0, "inapplicable").when(size == 1, "one_fact").when(size == 2, "two_facts")
        .otherwise("three_or_more_facts").alias("fact_complexity"),
    ).drop("_clauses")


def _measured_sentences(text: Column) -> Column:
    found = X.sentences(text)
    used = F.when(F.size(found) > 0, found).otherwise(F.array(text))
    return F.transform(used, lambda s: F.struct(
        s.alias("text"), F.array_distinct(X.fact_tokens(s)).alias("tokens"),
        F.regexp_replace(F.lower(s), r"\s+", "").alias("compact"), s.rlike(L.INFERENCE_CUE).alias("inference")))


def _match(fact: Column, sentence: Column, index: Column) -> Column:
    """How well one sentence represents one fact; recall and position come first and decide comparisons."""
    source = F.size(fact["tokens"])
    features = fact["hard_features"]
    none = F.array().cast("array<string>")
    numbers = F.coalesce(features["numbers"], none)
    direction = F.coalesce(features["direction"], none)
    terms = F.flatten(F.transform(X.words(X.FEATURE_KINDS[1:]), lambda kind: F.coalesce(features[kind], none)))
    total = F.size(numbers) + F.size(terms)
    present = F.size(F.filter(numbers, lambda n: F.contains(sentence["compact"], n))) + F.size(
        F.filter(terms, lambda t: F.array_contains(sentence["tokens"], t)))
    up, down = X.words(L.DIRECTION_UP), X.words(L.DIRECTION_DOWN)
    conflict = (F.arrays_overlap(direction, up) & F.arrays_overlap(sentence["tokens"], down)) | (
        F.arrays_overlap(direction, down) & F.arrays_overlap(sentence["tokens"], up))
    threshold = F.when(source >= 5, 0.55).otherwise(0.67)

    def measured(shared: Column) -> Column:
        recall = F.when(source > 0, F.size(shared) / source).otherwise(F.lit(0.0))
        lexical = (source > 0) & ((recall >= threshold) | (F.size(shared) >= 5))
        return F.struct(recall.alias("recall"), (-index).alias("order"),
                        (lexical & (present == total) & ~conflict).alias("represented"), present.alias("present"),
                        total.alias("total"), F.array_sort(shared).alias("matched"), sentence["text"].alias("evidence"))

    return X.let(F.array_intersect(fact["tokens"], sentence["tokens"]), measured)


def _best(fact: Column, sentences: Column) -> Column:
    """The first sentence with the highest recall."""
    return F.array_max(F.transform(sentences, lambda s, i: _match(fact, s, i)))


def score_facts(responses: DataFrame, *, facts: str = "facts", implications: str = "implications") -> DataFrame:
    """Fact coverage, inference tracing and qualifier recall; inapplicable questions have none."""
    prepared = responses.select(
        "*", _measured_sentences(F.col(facts)).alias("_fs"),
        F.filter(_measured_sentences(F.col(implications)), lambda s: s["inference"]).alias("_is"))
    compared = prepared.select("*", F.transform("facts_list", lambda f: F.struct(
        f["fact_id"].alias("fact_id"), f["source_text"].alias("source_text"), f["weight"].alias("weight"),
        _best(f, F.col("_fs")).alias("fact"), _best(f, F.col("_is")).alias("trace"))).alias("_details"))

    def total(value) -> Column:
        return F.aggregate("_details", F.lit(0.0), lambda s, d: s + F.coalesce(value(d).cast("double"), F.lit(0.0)))

    weight = total(lambda d: d["weight"])
    qualifiers = total(lambda d: d["fact"]["total"])
    eligible = F.col("repair_endpoint_eligible")

    def share(part: Column, whole: Column, empty: float) -> Column:
        return F.when(eligible, F.when(whole > 0, part / whole).otherwise(F.lit(empty)))

    measured = compared.select(
        "*",
        share(total(lambda d: F.when(d["fact"]["represented"], d["weight"])), weight, 0.0).alias("atomic_fact_coverage"),
        share(total(lambda d: F.when(d["trace"]["represented"], d["weight"])), weight, 0.0).alias(
            "atomic_implication_trace_coverage"),
        share(total(lambda d: d["fact"]["present"]), qualifiers, 1.0).alias("hard_qualifier_fact_recall"),
        share(total(lambda d: d["trace"]["present"]), qualifiers, 1.0).alias("hard_qualifier_trace_recall"),
    )
    return measured.withColumn("fact_coverage_details", F.transform("_details", lambda d: F.struct(
        d["fact_id"].alias("fact_id"), d["source_text"].alias("source_text"), d["weight"].alias("weight"),
        d["fact"]["represented"].alias("represented_in_facts"), d["fact"]["recall"].alias("facts_lexical_recall"),
        d["fact"]["matched"].alias("facts_matched_tokens"), d["fact"]["evidence"].alias("facts_evidence"),
        F.coalesce(d["trace"]["represented"], F.lit(False)).alias("traced_in_implications"),
        F.coalesce(d["trace"]["recall"], F.lit(0.0)).alias("implications_lexical_recall"),
        d["trace"]["evidence"].alias("implications_evidence")))).drop("_fs", "_is", "_details")


def question_review(questions: DataFrame, *, stem: str = "stem", gold_raw: str = "gold_raw") -> DataFrame:
    """Review flags of questions that already carry their fact inventory."""
    malformed = F.coalesce(~F.get_json_object(F.col(gold_raw), "$.malformed").isin("false", "0", "[]", "{}", ""),
                           F.lit(False))
    flags = F.array_compact(F.array(
        F.when(~F.col("repair_endpoint_eligible"), "repair_endpoints_inapplicable_topic_or_choice_dependent_stem"),
        F.when(malformed, "one_or_more_secondary_gold_fields_were_malformed"),
        F.when(F.size(X.fact_tokens(F.col(stem))) < 5, "very_short_stem")))
    return questions.withColumn("review_flags", flags).withColumn(
        "review_priority", F.when(F.size("review_flags") > 0, "targeted").otherwise("routine"))
