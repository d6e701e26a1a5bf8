"""The complete contrast plan of an experiment and its evaluation in one job."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens import protocol as P
from gridlens.operators import resample as R
from gridlens.operators.distributed import materialize, null_safe_join
from gridlens.operators.multiplicity import holm
from gridlens.operators.units import Spec, contrast_summary, question_differences

# Outcome tuples of the published analysis.
PRIMARY = (
    "required_section_count", "nontrivial_section_count", "preprovisional_tfidf_recall",
    "validated_contrastive_discussion_score", "validated_role_count", "all_roles_validated_complete",
    "preprovisional_commitment_itt",
)
KEY_SECONDARY = (
    "required_section_count", "preprovisional_tfidf_recall", "validated_contrastive_discussion_score",
    "validated_role_count", "preprovisional_commitment_itt", "accuracy",
)
ROLE_DIAGNOSTICS = (
    "required_section_count", "nontrivial_section_count", "contrastive_discussion_count",
    "contrastive_discussion_score", "validated_contrastive_discussion_count",
    "validated_contrastive_discussion_score", "provisional_answer_discussed", "best_alternative_discussed",
    "decisive_distinction_discussed", "answer_change_discussed", "reconsideration_discussed",
    "identified_role_count", "unique_role_count", "substantive_role_count", "role_completeness_score",
    "all_roles_substantive", "validated_role_count", "validated_role_completeness_score",
    "all_roles_validated_complete", "roles_in_requested_order", "complete_role_scaffold",
    "validated_complete_role_scaffold", "role_facts_complete", "role_implications_complete",
    "role_provisional_answer_complete", "role_best_alternative_complete", "role_decisive_distinction_complete",
    "role_answer_changing_change_complete", "role_answer_changing_change_nontrivial",
    "role_reconsideration_complete", "role_final_answer_complete", "protocol_scaffold_complete",
    "preanswer_discussion_complete", "contrastive_scaffold_complete", "visible_preanswer_discussion_complete",
    "structure_score", "section_depth_score", "substantive_role_score", "contrastive_role_score",
    "trajectory_complete",
)
LENGTH = ("preanswer_tfidf_token_count", "preanswer_tfidf_density_per_100_tokens")
EXPLORATORY = (
    "facts_tfidf_recall", "implications_tfidf_recall", "preanswer_high_idf_tfidf_recall",
    "facts_implications_shared_high_idf_recall", "preanswer_tfidf_density_per_100_tokens", "facts_anchor_recall",
    "implications_anchor_recall", "preanswer_anchor_recall", "shared_anchor_recall", "atomic_fact_coverage",
    "atomic_implication_trace_coverage", "hard_qualifier_fact_recall", "hard_qualifier_trace_recall",
)
COMPLEXITY_OUTCOMES = (
    "nontrivial_section_count", "preprovisional_tfidf_recall", "validated_contrastive_discussion_score",
    "atomic_fact_coverage",
)
COMPLEXITY_GROUPS = ("one_fact", "two_facts", "three_or_more_facts")
FACTORIAL = (
    "required_section_count", "nontrivial_section_count", "preprovisional_tfidf_recall",
    "validated_contrastive_discussion_score", "accuracy",
)
# Diagnostics of an absent protocol that count as zero besides the role diagnostics above.
ZERO_ABSENT = tuple(o for o in ROLE_DIAGNOSTICS if o not in {
    "structure_score", "section_depth_score", "substantive_role_score", "contrastive_role_score",
    "trajectory_complete",
}) + (
    "visible_reasoning_scaffold_complete", "minimum_repair_scaffold", "correct_with_minimum_repair_scaffold",
    "preanswer_tfidf_recall", "preprovisional_tfidf_recall", "facts_implications_shared_tfidf_recall",
)
ADVERSE = ("preprovisional_commitment_itt", "preprovisional_commitment_observed", "facts_choice_list_leakage")


@dataclass(frozen=True)
class Outcomes:
    """Outcome tuples a plan is built over; a table with fewer metrics passes shorter tuples."""

    primary: tuple[str, ...] = PRIMARY
    key_secondary: tuple[str, ...] = KEY_SECONDARY
    roles: tuple[str, ...] = ROLE_DIAGNOSTICS
    length: tuple[str, ...] = LENGTH
    exploratory: tuple[str, ...] = EXPLORATORY
    complexity: tuple[str, ...] = COMPLEXITY_OUTCOMES
    factorial: tuple[str, ...] = FACTORIAL
    zero_absent: tuple[str, ...] = ZERO_ABSENT
    accuracy: str = "accuracy"

    @property
    def additional(self) -> tuple[str, ...]:
        """Model-comparison outcomes that are neither primary nor length measures."""
        shown = dict.fromkeys((*self.roles, *self.exploratory, self.accuracy))
        return tuple(o for o in shown if o not in {*self.primary, *self.length})


def contrast_plan(outcomes: Outcomes = Outcomes()) -> list[Spec]:
    """Every comparison of the published analysis with its seed base."""
    o = outcomes
    trailing = (*o.primary, "trajectory_complete") if "trajectory_complete" in o.roles else o.primary
    one_copy = (*trailing, o.accuracy)
    repeat = (P.DOUBLE, P.SINGLE)
    tail = (P.TRAILING_TREATMENT, P.TRAILING_CONTROL)
    conventional = (P.AFTER_ONLY, P.CONVENTIONAL)
    before = (P.AFTER_ONLY, P.BEFORE_ONLY)
    system = (P.AFTER_ONLY, P.SYSTEM_ONLY)
    plan = [
        Spec("primary", o.primary, *repeat, seed_base=13_000),
        Spec("repetition_length", o.length, *repeat, seed_base=14_000),
        Spec("trailing", trailing, *tail, seed_base=16_000),
        Spec("trailing_length", o.length, *tail, seed_base=17_000),
        Spec("one_copy_after", one_copy, *conventional, seed_base=60_000),
        Spec("one_copy_after_length", o.length, *conventional, seed_base=60_500),
        Spec("after_vs_before", one_copy, *before, seed_base=61_000),
        Spec("after_vs_before_length", o.length, *before, seed_base=61_500),
        Spec("after_vs_system", one_copy, *system, seed_base=62_000),
        Spec("after_vs_system_length", o.length, *system, seed_base=62_500),
        Spec("role_diagnostics", o.roles, *repeat, seed_base=18_000),
        Spec("exploratory", o.exploratory, *repeat, seed_base=20_000),
        Spec("accuracy", (o.accuracy,), *repeat, seed_base=21_100),
        Spec("per_protocol", o.primary, *repeat, seed_base=23_000, usable_only=True),
        Spec("complexity", o.complexity, *repeat, group="fact_complexity", groups=COMPLEXITY_GROUPS,
             seed_base=110_000),
        Spec("model_repetition", o.primary, *repeat, group="model_id", seed_base=30_000),
        Spec("model_robustness", o.length, *repeat, group="model_id", seed_base=40_000),
        Spec("model_additional", o.additional, *repeat, group="model_id", seed_base=45_000),
        Spec("model_trailing", o.primary, *tail, group="model_id", seed_base=70_000),
        Spec("model_one_copy", o.primary, *conventional, group="model_id", seed_base=80_000),
        Spec("dataset_repetition", o.primary, *repeat, group="dataset", seed_base=50_000),
        Spec("dataset_trailing", o.primary, *tail, group="dataset", seed_base=90_000),
        Spec("dataset_one_copy", o.primary, *conventional, group="dataset", seed_base=100_000),
    ]
    plan += [
        Spec("factorial", o.factorial, term=term, seed_base=120_000, outcome_stride=10_000, seed_offset=100 * i)
        for i, term in enumerate(P.FACTORIAL_TERMS)
    ]
    return [s for s in plan if s.outcomes]


def plan_table(spark, plan: Sequence[Spec], groups: dict[str, Sequence[str]]) -> DataFrame:
    """One row per contrast with its seed; ``groups`` lists the sorted values of each group attribute."""
    rows = []
    for spec in plan:
        values = [None] if spec.group is None else list(spec.groups or groups[spec.group])
        for g, value in enumerate(values):
            for i, outcome in enumerate(spec.outcomes):
                seed = spec.seed_base + spec.seed_offset + i * spec.outcome_stride + g * spec.group_stride
                rows.append((spec.family, spec.label, value, outcome, i, seed, spec.population,
                             list(spec.treatment), list(spec.control)))
    return spark.createDataFrame(
        rows,
        "family string, term string, group_value string, outcome string, outcome_index int, seed bigint,"
        " population string, treatment_conditions array<string>, control_conditions array<string>",
    )


def group_values(cells: DataFrame, plan: Sequence[Spec], *, limit: int = 10_000) -> dict[str, list[str]]:
    """Sorted distinct values of the grouping attributes.

    The panel of models and the list of datasets are declared design tables; a frame with more values than
    ``limit`` is not such a design and is refused instead of being gathered.
    """
    found = {}
    for name in dict.fromkeys(s.group for s in plan if s.group and not s.groups):
        values = [row[0] for row in cells.select(name).distinct().limit(limit + 1).collect()]
        if len(values) > limit:
            raise ValueError(f"{name} has more than {limit} values; it is not a design attribute")
        found[name] = sorted(values)
    return found


def with_model_order(cells: DataFrame, models: Sequence[str]) -> DataFrame:
    """Attach the rank of the model id, which decides the order of the resampled vectors."""
    ranks = F.create_map(*[item for i, m in enumerate(sorted(models)) for item in (F.lit(m), F.lit(i))])
    return cells.withColumn("model_ord", ranks[F.col("model_id")])


def work_units(plan: Sequence[Spec], groups: dict[str, Sequence[str]]) -> int:
    """Number of contrasts a plan computes."""
    total = 0
    for spec in plan:
        size = 1 if spec.group is None else len(spec.groups or groups[spec.group])
        total += size * len(spec.outcomes)
    return total


def build_analysis(cells: DataFrame, plan: Sequence[Spec] | None = None, *, outcomes: Outcomes = Outcomes(),
                   bootstraps: int = 10_000, permutations: int = 50_000, level: float = 0.95,
                   with_resampling: bool = True) -> DataFrame:
    """All contrasts with means, intervals, p-values and the declared Holm adjustments.

    The cells are reduced once to per-question differences for every comparison; that compact frame is written to
    the checkpoint folder, because the summary and both resamplers read it.
    """
    spark = cells.sparkSession
    plan = list(plan) if plan is not None else contrast_plan(outcomes)
    groups = group_values(cells, plan)
    models = groups.get("model_id") or group_values(cells, [Spec("", (), group="model_id")])["model_id"]
    ordered = with_model_order(cells, models)
    declared = plan_table(spark, plan, groups)
    differences = question_differences(ordered, plan, zero_absent=outcomes.zero_absent)
    if with_resampling:
        differences = materialize(differences)
    summary = contrast_summary(differences)
    keys = list(R.CONTRAST_KEYS)

    result = null_safe_join(declared, summary, keys, "left").select(
        *declared.columns, "treatment_mean", "control_mean", "effect",
        F.coalesce("question_clusters", F.lit(0)).alias("question_clusters"),
        F.coalesce("incomplete_units", F.lit(0)).alias("incomplete_units"),
    )
    if not with_resampling:
        return result
    drawn = R.resample(differences, declared.select(*keys, "seed"), bootstraps=bootstraps,
                       permutations=permutations, level=level)
    # The draws are the costly part and three branches below read them.
    result = materialize(null_safe_join(result, drawn, keys, "left"))
    return adjust_families(result, outcomes)


def adjust_families(contrasts: DataFrame, outcomes: Outcomes = Outcomes()) -> DataFrame:
    """Holm within each outcome for the model families; the key secondary family is emitted as copied rows."""
    secondary = contrasts.filter(
        ((F.col("family") == "primary") & F.col("outcome").isin(list(outcomes.key_secondary)))
        | ((F.col("family") == "accuracy") & F.lit(outcomes.accuracy in outcomes.key_secondary))
    ).withColumn("family", F.lit("key_secondary"))
    order = F.create_map(*[x for i, o in enumerate(outcomes.key_secondary) for x in (F.lit(o), F.lit(i))])
    secondary = secondary.withColumn("outcome_index", order[F.col("outcome")])
    adjusted = contrasts.filter(F.col("family").startswith("model_"))
    plain = contrasts.filter(~F.col("family").startswith("model_"))
    return (
        plain.withColumn("holm_p_value", F.lit(None).cast("double"))
        .unionByName(holm(secondary, ["family"], ["outcome_index"]))
        .unionByName(holm(adjusted, ["family", "outcome"], ["group_value"]))
    )


def model_table(contrasts: DataFrame, outcomes: Outcomes = Outcomes()) -> DataFrame:
    """The three model-level repetition families as one table in report order."""
    listed = list(dict.fromkeys((*outcomes.primary, *outcomes.length, *outcomes.roles, *outcomes.exploratory,
                                 outcomes.accuracy)))
    order = F.create_map(*[x for i, o in enumerate(listed) for x in (F.lit(o), F.lit(i))])
    return (
        contrasts.filter(F.col("family").isin("model_repetition", "model_robustness", "model_additional"))
        .withColumn("outcome_index", order[F.col("outcome")])
        .withColumnRenamed("group_value", "model_id")
        .orderBy("outcome_index", "model_id")
    )
