"""Command line: prepare, judge, analyze and status over a workspace folder of parquet tables."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from gridlens.functions import keys
from gridlens.operators import facts, grid, judge as judging, ledger, lexical, units
from gridlens.plans import contrasts
from gridlens.session import build_session
from gridlens.sources import questions as Q
from gridlens.sources import sinks


def prepare(spark, args) -> None:
    """Normalise questions, keep rejects with their reasons, and lay out the grid in schedule order."""
    raw = Q.read_raw_questions(spark, args.questions)
    name = F.coalesce(F.try_variant_get("raw", "$.dataset", "string"), F.lit("questions"))
    found = Q.normalize_questions(raw, name, F.lit("test"))
    found.write.mode("overwrite").parquet(f"{args.workspace}/data/normalized")
    stored = spark.read.parquet(f"{args.workspace}/data/normalized")
    accepted = facts.fact_inventory(Q.accept(stored).withColumnRenamed("id", "question_id"))
    accepted.write.mode("overwrite").parquet(f"{args.workspace}/data/questions")
    Q.rejection_histogram(stored).write.mode("overwrite").json(f"{args.workspace}/data/rejections")
    planned = grid.schedule(grid.expand(spark.read.parquet(f"{args.workspace}/data/questions"), args.models.split(",")))
    planned.withColumn("status", F.lit("pending")).write.mode("overwrite").parquet(f"{args.workspace}/state/cells")


def judge(spark, args) -> None:
    """Judge the cells whose judgment is missing or stale and fold the results into the stored ones."""
    questions = spark.read.parquet(f"{args.workspace}/data/questions")
    cells = spark.read.parquet(f"{args.workspace}/state/responses")
    total, frequencies = Q.read_document_frequencies(
        spark, args.frequencies, lexical.selected_terms(questions, "stem"))
    joined = cells.join(questions, "question_id")
    target = f"{args.workspace}/results/judgments"
    versions = {"judge_version": args.version}
    existing = sinks.latest(spark, target) if args.incremental else None
    wanted = ledger.stale_cells(joined, existing, versions) if existing is not None else joined
    profiles = lexical.stem_profiles(questions, frequencies, total)
    hashes = wanted.select("cell_id", keys.content_key(F.col("status"), F.col("content")).alias("content_hash"))
    fresh = judging.judge(wanted, profiles).join(hashes, "cell_id").withColumn("judge_version", F.lit(args.version))
    merged = ledger.upsert(existing, fresh, "cell_id") if existing is not None else fresh
    sinks.publish(merged, target)


def analyze(spark, args) -> None:
    """Every declared contrast, the condition means and the model tables."""
    judged = sinks.latest(spark, f"{args.workspace}/results/{args.judgments}")
    if judged is None:
        raise SystemExit("nothing is judged yet")
    table = contrasts.build_analysis(judged, bootstraps=args.bootstraps, permutations=args.permutations)
    table.write.mode("overwrite").parquet(f"{args.workspace}/results/contrasts")
    stored = spark.read.parquet(f"{args.workspace}/results/contrasts")
    effects = contrasts.model_table(stored).select("outcome", "model_id", "effect", "ci_low", "ci_high", "p_value",
                                                   "holm_p_value", "question_clusters", "incomplete_units")
    ranked = units.benefit_ranks(effects, contrasts.ADVERSE)
    sinks.write_csv(ranked, f"{args.workspace}/results/model-effects", ["outcome", "benefit_rank"])
    measured = [f.name for f in judged.schema.fields if f.dataType.simpleString() == "double"]
    units.condition_means(judged, measured).write.mode("overwrite").json(f"{args.workspace}/results/condition-means")
    sinks.write_document(spark, f"{args.workspace}/results/report.txt",
                         sinks.contrast_report(stored, "primary", "Two copies against one copy"))


def status(spark, args) -> None:
    units.status_counts(spark.read.parquet(f"{args.workspace}/state/cells")).orderBy("status").show(truncate=False)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gridlens")
    parser.add_argument("--master", default=None)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, function in (("prepare", prepare), ("judge", judge), ("analyze", analyze), ("status", status)):
        command = commands.add_parser(name, help=function.__doc__)
        command.add_argument("workspace")
        command.set_defaults(run=function)
        if name == "prepare":
            command.add_argument("questions")
            command.add_argument("--models", required=True, help="comma-separated model ids")
        if name == "judge":
            command.add_argument("frequencies")
            command.add_argument("--version", default="1")
            command.add_argument("--incremental", action="store_true")
        if name == "analyze":
            command.add_argument("--judgments", default="judgments")
            command.add_argument("--bootstraps", type=int, default=10_000)
            command.add_argument("--permutations", type=int, default=50_000)
    args = parser.parse_args(argv)
    args.run(build_session(args.master), args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
