"""Judgment of every cell: roles, commitments, coverage, facts and accuracy as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.functions import clauses as G
from gridlens.functions import roles as R
from gridlens.functions import text as X
from gridlens.functions.answers import with_answer
from gridlens.operators.facts import score_facts
from gridlens.operators.lexical import score_coverage
from gridlens.operators.sections import recover

COVERAGE = (
    "facts_tfidf_recall", "implications_tfidf_recall", "preanswer_tfidf_recall", "preanswer_high_idf_tfidf_recall",
    "facts_implications_shared_tfidf_recall", "facts_implications_shared_high_idf_recall",
    "preanswer_tfidf_density_per_100_tokens", "preanswer_tfidf_token_count", "facts_anchor_recall",
    "implications_anchor_recall", "preanswer_anchor_recall", "shared_anchor_recall",
)
FACT_MEASURES = ("atomic_fact_coverage", "atomic_implication_trace_coverage", "hard_qualifier_fact_recall",
                 "hard_qualifier_trace_recall")
# Judged only where the question has standalone facts.
ELIGIBLE_ONLY = ("minimum_repair_scaffold", "contrastive_scaffold_complete", "correct_with_minimum_repair_scaffold",
                 "substantive_role_score", "contrastive_role_score", "preprovisional_tfidf_recall", *COVERAGE,
                 *FACT_MEASURES)


def _s(role: str) -> Column:
    return F.col("sections")[role]


def _choice_tokens(option: Column) -> Column:
    """Content tokens of one option's text."""
    index = (F.array_position("labels", option) - 1).cast("int")
    return F.coalesce(F.get("choice_tokens", index), F.array().cast("array<string>"))


def _residual(tokens: Column, named: Column) -> Column:
    """Tokens left after taking away one occurrence for every named token."""
    return X.let(tokens, lambda items: F.filter(items, lambda t, i: ~F.array_contains(named, t) | (
        F.size(F.filter(F.slice(items, F.lit(1), i + 1), lambda x: x == t))
        > F.size(F.filter(named, lambda x: x == t)))))


def _unlike(tokens: Column, boilerplate: Sequence[str]) -> Column:
    return F.array_except(tokens, X.words(boilerplate))


def _rationale(role: str, option: Column) -> Column:
    """Explanation beyond the answer's name: stem contact, a rationale cue or four specific terms."""
    def judged(left: Column) -> Column:
        return (F.size(left) >= 2) & (F.size(F.array_distinct(left)) >= 2) & (
            F.arrays_overlap(left, F.col("stem_content")) | _s(role).rlike(R.RATIONALE_CUE)
            | (F.size(_unlike(left, R.RATIONALE_BOILERPLATE)) >= 4))

    return X.let(_residual(F.col(f"tok_{role}"), _choice_tokens(option)), judged)


def _grounded(role: str, options: Sequence[Column] | None, references: Sequence[str]) -> Column:
    """Case-specific reasoning: stem contact, continuity with earlier roles, or choice material plus new terms."""
    tokens = F.col(f"tok_{role}")
    named = F.flatten(F.col("choice_tokens")) if options is None else F.concat(*[_choice_tokens(o) for o in options])

    def judged(pair: Column) -> Column:
        specific, mentions = pair["specific"], pair["mentions"]
        own = _unlike(tokens, R.REASONING_BOILERPLATE)
        continuity = F.lit(False)
        for reference in references:
            continuity = continuity | (F.size(F.array_intersect(own, F.col(f"tok_{reference}"))) >= 2)
        return F.when(mentions & (F.size(specific) == 0), False).otherwise(
            (F.col(f"anchor_{role}") >= 0.08) | continuity | (mentions & (F.size(specific) >= 3)))

    return X.let(F.struct(_unlike(_residual(tokens, named), R.REASONING_BOILERPLATE).alias("specific"),
                          F.arrays_overlap(tokens, named).alias("mentions")), judged)


def _counterfactual() -> Column:
    """A hypothetical change of the case under which exactly the declared alternative wins."""
    text, tokens, second = _s("answer_changing_change"), F.col("tok_answer_changing_change"), F.col("second_best_option")
    named = _choice_tokens(second)

    def judged(specific: Column) -> Column:
        introduced = F.size(F.array_except(specific, named))
        touches = F.arrays_overlap(tokens, named)
        return ((introduced >= 2) | (touches & text.rlike(R.RATIONALE_CUE))) & (
            (F.col("anchor_answer_changing_change") >= 0.05) | F.arrays_overlap(specific, named) | (introduced >= 3))

    boilerplate = [*R.RATIONALE_BOILERPLATE, "alternative", "become", "change", "changed", "instead", "question",
                   "scenario", "smallest", "were", "would"]
    return (
        X.informative(tokens, 7) & text.rlike(R.CHANGE_CUE) & F.coalesce(F.array_contains("labels", second), F.lit(False))
        & G.wins_alone(text, second, F.col("labels"), F.col("choice_texts")) & X.let(_unlike(tokens, boilerplate), judged)
    )


def commitments(text: Column, folded: Column, labels: Column, choice_texts: Column) -> Column:
    """Clauses that already settle on an answer, with the option where one is named.

    Questions, conditionals and relative hypotheticals are not commitments.  ``folded`` is the case-folded text; both
    are cut at the same characters, so their clauses pair up.
    """
    cut = r"(?<=[.;\n?!])"

    def clause(pair: Column) -> Column:
        raw, low = pair["raw"], pair["low"]

        def judged(code: Column) -> Column:
            excluded = raw.contains("?") | low.rlike(r"^[-*#>\s]*(?:key\s+)?question\s*[:—-]") | code.rlike(G.HYPOTHETICAL)
            options = G.options_in(code, G.SETTLED)
            generic = F.when((F.size(options) == 0) & code.rlike(G.SETTLED_UNNAMED), F.array(F.lit(None).cast("string")))
            return F.when(~excluded, F.transform(F.coalesce(generic, options), lambda o: F.struct(
                o.alias("option"), F.trim(raw).alias("evidence"))))

        return X.let(G.encoded(pair["marked"], labels, choice_texts), judged)

    pairs = F.arrays_zip(F.split(text, cut).alias("raw"), F.split(folded, cut).alias("low"))
    return F.flatten(F.array_compact(F.transform(pairs, lambda p: clause(F.struct(
        p["raw"].alias("raw"), p["low"].alias("low"), G.marked(p["raw"]).alias("marked"))))))


def _measured(recovered: DataFrame) -> DataFrame:
    """Token lists and anchor recalls of the sections."""
    raw = F.transform("choices", lambda c: F.regexp_replace(c["text"], r"\s+", " "))
    lexical = F.split(X.lexical_text(F.array_join(raw, "\n")), "\n")
    from gridlens.functions import lexicon as L

    tokens = recovered.select(
        "*", *[X.content_tokens(_s(r)).alias(f"tok_{r}") for r in R.ROLES],
        X.content_tokens(F.col("stem")).alias("stem_content"),
        F.transform(lexical, lambda t: X.listed_tokens(t, L.ANCHOR_STOPWORDS)).alias("choice_tokens"),
        F.regexp_extract_all(_s("facts"), F.lit(R.CHOICE_LIST_MARKER), F.lit(1)).alias("_listed"))
    return tokens.select(
        "*", (F.size(F.array_distinct(F.filter("_listed", lambda h: F.array_contains("labels", h)))) >= 2).alias(
            "facts_choice_list_leakage"))


def judge_instructed(cells: DataFrame, profiles: DataFrame, key: str = "question_id") -> DataFrame:
    """Judgment columns of completed cells that were asked to follow the protocol.

    ``cells`` holds the key, stem, choices, gold, content and the question's fact inventory columns.
    """
    measured = _measured(recover(cells))
    listed = F.regexp_extract(_s("facts"), f"(?s)^(.*?){R.CHOICE_LIST_MARKER}", 1)
    prepared = measured.select(
        "*", F.when(F.col("facts_choice_list_leakage"), F.rtrim(listed)).otherwise(_s("facts")).alias("_facts"),
        _s("facts").alias("_all_facts"), _s("implications").alias("_implications"), _s("final_answer").alias("_final"))
    scored = score_facts(prepared, facts="_facts", implications="_implications")
    scored = score_coverage_keeping(scored, profiles, key)
    answered = with_answer(scored, "_final", prefix="body")
    boundary = F.least(F.when(F.col("document").rlike(R.PROVISIONAL_BOUNDARY), F.length(
        F.regexp_extract("document", f"(?s)^(.*?)(?:{R.PROVISIONAL_BOUNDARY})", 1))), F.col("provisional_start"))
    early = F.regexp_replace(F.substring("document", F.lit(1), F.coalesce(boundary, F.length("document"))), r"[*_`~]", " ")
    answered = answered.withColumn("_early", early).withColumn("_early_folded", X.folded(F.col("_early")))
    answered = answered.withColumn("early_commitments", commitments(
        F.col("_early"), F.col("_early_folded"), F.col("labels"), F.col("choice_texts")))

    def valid(option: str) -> Column:
        return F.coalesce(F.array_contains("labels", F.col(option)), F.lit(False))

    option_ok = {o: valid(o) for o in ("provisional_option", "second_best_option", "recovered_final_option")}
    distinct = option_ok["second_best_option"] & ~F.col("second_best_option").eqNullSafe(F.col("provisional_option"))
    conflict = F.col("body_option").isNotNull() & (F.col("body_option") != F.col("recovered_final_option"))
    final_count = F.col("role_counts")[7]
    status = (F.when(final_count == 0, "missing_final_answer").when(~option_ok["recovered_final_option"], "invalid_label")
              .when(conflict, "conflicting").otherwise("parsed"))
    same = F.col("recovered_final_option") == F.col("provisional_option")
    consistent = F.coalesce(option_ok["provisional_option"] & option_ok["recovered_final_option"] & (
        ((F.col("decision") == "retain") & same) | ((F.col("decision") == "revise") & ~same)), F.lit(False))
    based = answered.select("*", status.alias("answer_extraction_status"), consistent.alias("decision_consistent"))

    def info(role: str, minimum: int) -> Column:
        return X.informative(F.col(f"tok_{role}"), minimum)

    provisional, second, final = (F.col(c) for c in ("provisional_option", "second_best_option", "recovered_final_option"))
    substantive = {
        "facts": info("facts", 4) & (F.col("facts_anchor_recall") > 0) & ~F.col("facts_choice_list_leakage"),
        "implications": info("implications", 6) & _grounded("implications", None, ["facts"]),
        "provisional_answer": option_ok["provisional_option"] & info("provisional_answer", 4)
        & _rationale("provisional_answer", provisional),
        "second_best": distinct & info("second_best", 5) & _rationale("second_best", second),
        "decisive_fact": info("decisive_fact", 3) & (
            _grounded("decisive_fact", [provisional, second], ["facts", "implications"])
            | (_s("decisive_fact").rlike(R.CONTRAST_CUE) & info("decisive_fact", 6))),
        "answer_changing_change": _counterfactual(),
        "rereasoning": info("rereasoning", 5) & F.col("decision_consistent") & _grounded(
            "rereasoning", [provisional, second, final],
            ["facts", "implications", "decisive_fact", "answer_changing_change"]),
        "final_answer": option_ok["recovered_final_option"] & (F.col("answer_extraction_status") != "conflicting"),
    }
    named = {"provisional_answer": provisional, "second_best": second, "final_answer": final}
    nontrivial = {}
    for k, role in enumerate(R.ROLES):
        meaningful = info(role, R.NONTRIVIAL_TOKENS[role])
        if role in named:
            meaningful = named[role].isNotNull() | meaningful
        if role == "rereasoning":
            meaningful = F.col("decision").isNotNull() | meaningful
        nontrivial[role] = (F.col("role_counts")[k] >= 1) & meaningful
    flagged = based.select(
        "*", *[F.coalesce(v, F.lit(False)).alias(f"sub_{r}") for r, v in substantive.items()],
        *[F.coalesce(v, F.lit(False)).alias(f"non_{r}") for r, v in nontrivial.items()])
    return _composed(flagged, option_ok, distinct)


def score_coverage_keeping(frame: DataFrame, profiles: DataFrame, key: str) -> DataFrame:
    """Coverage measures next to all columns of the frame."""
    return score_coverage(frame, profiles, key=key, facts="_all_facts", implications="_implications", keep_all=True,
                          further={f"anchor_{r}": _s(r) for r in (
                              "implications", "decisive_fact", "answer_changing_change", "rereasoning")})


def _share(flags: Sequence[Column]) -> Column:
    total = F.lit(0.0)
    for flag in flags:
        total = total + flag.cast("double")
    return total / F.lit(float(len(flags)))


def _count(flags: Sequence[Column]) -> Column:
    total = F.lit(0)
    for flag in flags:
        total = total + flag.cast("int")
    return total


def _all(flags: Sequence[Column]) -> Column:
    result = flags[0]
    for flag in flags[1:]:
        result = result & flag
    return result


def _composed(frame: DataFrame, option_ok: dict[str, Column], distinct: Column) -> DataFrame:
    """Counts, scores and scaffolds from the role flags."""
    sub = {r: F.col(f"sub_{r}") for r in R.ROLES}
    non = {r: F.col(f"non_{r}") for r in R.ROLES}
    validated = {**sub, "answer_changing_change": non["answer_changing_change"]}
    counts = [F.col("role_counts")[k] for k in range(len(R.ROLES))]
    present, unique = [c >= 1 for c in counts], [c == 1 for c in counts]
    ordered, consistent, decided = F.col("ordered"), F.col("decision_consistent"), F.col("decision").isNotNull()
    written = _all([_s(r) != "" for r in R.ROLES if r != "final_answer"])
    trajectory = _all([*unique, ordered, written, option_ok["provisional_option"], distinct,
                       option_ok["recovered_final_option"], decided])
    calm = F.size("early_commitments") == 0
    all_sub = _all(list(sub.values()))
    scaffold = trajectory & all_sub & consistent & calm
    discussed = X.informative(F.col("tok_facts"), 4) & (F.col("facts_anchor_recall") > 0)
    preanswer = _all([*unique[:3], F.col("preanswer_ordered"), option_ok["provisional_option"], discussed,
                      sub["implications"], sub["provisional_answer"], calm])
    contrast_roles = ("provisional_answer", "second_best", "decisive_fact", "answer_changing_change", "rereasoning")
    contrast = [sub[r] for r in contrast_roles]
    contrast_valid = [validated[r] for r in contrast_roles]
    contrastive = _all([trajectory, *[sub[r] for r in contrast_roles[1:]], consistent])
    parseable = F.col("answer_extraction_status") == "parsed"
    correct = parseable & (F.col("recovered_final_option") == F.col("gold"))
    depth = F.lit(0.0)
    for role, target in R.DEPTH_TARGETS.items():
        depth = depth + F.least(F.lit(1.0), F.size(f"tok_{role}") / F.lit(float(target)))
    number = lambda flag: flag.cast("double")
    measures = {
        "protocol_scaffold_complete": number(scaffold),
        "preanswer_discussion_complete": number(preanswer),
        "visible_reasoning_scaffold_complete": number(scaffold),
        "visible_preanswer_discussion_complete": number(preanswer),
        "minimum_repair_scaffold": number(scaffold),
        "contrastive_scaffold_complete": number(contrastive),
        "correct_with_minimum_repair_scaffold": number(scaffold & correct),
        "structure_score": _share([_all(unique), ordered, written, trajectory, option_ok["provisional_option"], distinct,
                                   option_ok["recovered_final_option"], decided, consistent]),
        "section_depth_score": depth / F.lit(float(len(R.DEPTH_TARGETS))),
        "substantive_role_score": _share(list(sub.values())),
        "contrastive_role_score": _share([*contrast[1:], consistent]),
        "visible_substantive_role_score": _share(list(sub.values())),
        "visible_contrastive_role_score": _share([*contrast[1:], consistent]),
        "identified_role_count": number(_count(present)),
        "unique_role_count": number(_count(unique)),
        "required_section_count": number(_count(present)),
        "nontrivial_section_count": number(_count(list(non.values()))),
        "substantive_role_count": number(_count(list(sub.values()))),
        "validated_role_count": number(_count(list(validated.values()))),
        "role_completeness_score": _share(list(sub.values())),
        "validated_role_completeness_score": _share(list(validated.values())),
        "contrastive_discussion_count": number(_count(contrast)),
        "contrastive_discussion_score": _share(contrast),
        "validated_contrastive_discussion_count": number(_count(contrast_valid)),
        "validated_contrastive_discussion_score": _share(contrast_valid),
        "provisional_answer_discussed": number(sub["provisional_answer"]),
        "best_alternative_discussed": number(sub["second_best"]),
        "decisive_distinction_discussed": number(sub["decisive_fact"]),
        "answer_change_discussed": number(sub["answer_changing_change"]),
        "reconsideration_discussed": number(sub["rereasoning"]),
        "all_roles_substantive": number(all_sub),
        "all_roles_validated_complete": number(_all(list(validated.values()))),
        "roles_in_requested_order": number(ordered),
        "complete_role_scaffold": number(all_sub & _all(unique) & ordered),
        "validated_complete_role_scaffold": number(_all([*validated.values(), *unique, ordered])),
        "role_facts_complete": number(sub["facts"]),
        "role_implications_complete": number(sub["implications"]),
        "role_provisional_answer_complete": number(sub["provisional_answer"]),
        "role_best_alternative_complete": number(sub["second_best"]),
        "role_decisive_distinction_complete": number(sub["decisive_fact"]),
        "role_answer_changing_change_complete": number(sub["answer_changing_change"]),
        "role_answer_changing_change_nontrivial": number(non["answer_changing_change"]),
        "role_reconsideration_complete": number(sub["rereasoning"]),
        "role_final_answer_complete": number(sub["final_answer"]),
        "trajectory_complete": number(trajectory),
        "preprovisional_commitment_observed": number(~calm),
        "preprovisional_commitment_itt": number(~calm),
        "preprovisional_tfidf_recall": F.col("preanswer_tfidf_recall"),
        "accuracy": number(correct),
        "accuracy_parseable": number(parseable),
    }
    eligible = F.col("repair_endpoint_eligible")
    kept = {**{name: F.col(name) for name in (*COVERAGE, *FACT_MEASURES)}, **measures}
    columns = [(F.when(eligible, v) if name in ELIGIBLE_ONLY else v).alias(name) for name, v in kept.items()]
    return frame.select(
        *[c for c in IDENTITY if c in frame.columns], *columns,
        F.col("facts_choice_list_leakage").cast("double").alias("facts_choice_list_leakage"),
        "answer_extraction_status", F.when(parseable, F.col("recovered_final_option")).alias("final_option"),
        "provisional_option", "second_best_option", F.col("decision").alias("rereasoning_decision"),
        F.col("decision_consistent").cast("double").alias("decision_consistent"), "early_commitments",
        "fact_coverage_details")


IDENTITY = ("cell_id", "question_id", "model_id", "condition_id", "dataset", "status", "repair_endpoint_eligible",
            "fact_complexity")
_ADVERSE = ("preprovisional_commitment_itt",)
_ALWAYS = ("accuracy", "accuracy_parseable")


def judge(cells: DataFrame, profiles: DataFrame, key: str = "question_id") -> DataFrame:
    """Judgments of all cells.

    Instructed failures score zero (one on the adverse endpoint), baseline cells have no protocol measures, and
    measures that need facts stay undefined where the question has none.
    """
    usable = (F.col("status") == "completed") & (F.coalesce(F.trim("content"), F.lit("")) != "")
    zero = F.col("condition_id") == "zero"
    instructed = judge_instructed(cells.filter(usable & ~zero), profiles, key).withColumn("generation_usable", F.lit(True))
    numeric = [f.name for f in instructed.schema.fields if f.dataType.simpleString() == "double"]
    eligible = F.col("repair_endpoint_eligible")

    baseline = cells.filter(usable & zero).withColumn("labels", R.labels_of(F.col("choices")))
    from gridlens.operators.sections import normalized_choices

    baseline = baseline.withColumn("choice_texts", normalized_choices(F.col("choices")))
    read = with_answer(baseline, "content", prefix="answer")
    parsed = read["answer_status"] == "parsed"
    base_rows = read.select(
        *[c for c in IDENTITY if c in read.columns],
        F.coalesce(parsed & (F.col("answer_option") == F.col("gold")), F.lit(False)).cast("double").alias("accuracy"),
        parsed.cast("double").alias("accuracy_parseable"), F.col("answer_status").alias("answer_extraction_status"),
        F.col("answer_option").alias("final_option"), F.lit(True).alias("generation_usable"))

    def failed_value(name: str) -> Column:
        if name in _ALWAYS:
            return F.lit(0.0)
        if name == "preprovisional_commitment_observed":
            return F.lit(None).cast("double")
        value = F.lit(1.0 if name in _ADVERSE else 0.0)
        return F.when(~zero & eligible, value) if name in ELIGIBLE_ONLY else F.when(~zero, value)

    failed = cells.filter(~usable)
    fail_rows = failed.select(*[c for c in IDENTITY if c in failed.columns],
                              *[failed_value(n).alias(n) for n in numeric], F.lit(False).alias("generation_usable"))
    return instructed.unionByName(base_rows, allowMissingColumns=True).unionByName(fail_rows, allowMissingColumns=True)
