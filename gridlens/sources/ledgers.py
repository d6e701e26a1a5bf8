"""Earlier question ledgers: found in their workspaces, each content read once, and united with their provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.functions import text as X
from gridlens.functions.choices import parse_choices
from gridlens.session import file_system
from gridlens.sources.questions import strip_choice_block

# Where a workspace keeps its questions, the first that exists counts.
PLACES = ("data/questions.jsonl", "questions.jsonl", ".instruction-duplication/data/questions.jsonl",
          ".instruction-duplication/questions.jsonl")


def find_ledgers(spark: SparkSession, workspaces: Sequence[str]) -> list[str]:
    """Path of every workspace's ledger (a file, or a folder of part files); a workspace without one is an error."""
    found = []
    for workspace in workspaces:
        if workspace.rstrip("/").endswith("questions.jsonl"):
            choices = [workspace.rstrip("/")]
        else:
            choices = [f"{workspace.rstrip('/')}/{place}" for place in PLACES]
        there = next((c for c in choices if file_system(spark, c)[0].exists(file_system(spark, c)[1])), None)
        if there is None:
            raise FileNotFoundError(f"no question ledger at any of {', '.join(choices)}")
        found.append(there)
    return found


def read_ledgers(spark: SparkSession, workspaces: Sequence[str]) -> DataFrame:
    """(ledger_index, ledger, value): the lines of every ledger, in the order of the workspaces."""
    frames = [spark.read.text(path).filter(F.trim("value") != "").select(F.lit(i).alias("ledger_index"), F.lit(path).alias("ledger"), "value")
              for i, path in enumerate(find_ledgers(spark, workspaces))]
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.union(frame)
    return whole


def content_digests(lines: DataFrame) -> DataFrame:
    """(ledger_index, digest, rows, first): a digest of each ledger's lines in any order, and the first ledger that has it.

    Lines are hashed where they lie and only sums are shuffled, so ledgers of any size are compared without being sorted.
    """
    parts = [F.sum(F.xxhash64("value").cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(7), "value").cast("decimal(38,0)"))]
    sums = lines.groupBy("ledger_index").agg(F.count(F.lit(1)).alias("rows"), *[p.alias(f"_s{i}") for i, p in enumerate(parts)])
    named = sums.select("ledger_index", "rows", F.sha2(F.concat_ws(":", "rows", "_s0", "_s1"), 256).alias("digest"))
    first = named.groupBy("digest").agg(F.min("ledger_index").alias("first"))
    return named.join(first, "digest").select("ledger_index", "digest", "rows", "first")


def unite_ledgers(lines: DataFrame) -> DataFrame:
    """(ledger_index, ledger, digest, id, dataset, stem, stem_key, problem) of every line of a ledger that is no copy of an earlier one.

    Stems are compared without an embedded block that mirrors the choices.  A line without id, dataset or stem keeps its place with
    ``problem`` set; it is for the caller to refuse.
    """
    fresh = content_digests(lines).filter("first = ledger_index").select("ledger_index", "digest")
    rows = lines.join(fresh, "ledger_index").withColumn("raw", F.try_parse_json("value"))
    field = lambda name: F.nullif(F.trim(F.try_variant_get("raw", f"$.{name}", "string")), F.lit(""))
    read = rows.select("ledger_index", "ledger", "digest", *[field(n).alias(n) for n in ("id", "dataset", "stem")],
                       parse_choices(F.try_variant_get("raw", "$.choices", "string"))["choices"].alias("_choices"))
    bare = strip_choice_block(F.col("stem"), F.col("_choices"))["stem"]
    problem = F.when(F.col("id").isNull() | F.col("dataset").isNull() | F.col("stem").isNull(), "ledger rows need id, dataset and stem")
    return read.select("ledger_index", "ledger", "digest", "id", "dataset", "stem", F.sha2(X.normalized(bare), 256).alias("stem_key"),
                       problem.alias("problem"))


def ledger_audit(entries: DataFrame) -> DataFrame:
    """Per ledger: its rows, datasets, and the ids and stems that it is the first to contribute."""
    from gridlens.sources.questions import ledger_additions

    base = entries.groupBy("ledger_index", "ledger", "digest").agg(
        F.count(F.lit(1)).alias("rows"), F.array_join(F.sort_array(F.collect_set("dataset")), ",").alias("datasets"))
    added = ledger_additions(entries)
    return base.join(added, "ledger_index", "left").select(
        "ledger_index", "ledger", "digest", "rows", "datasets", F.coalesce("new_ids", F.lit(0)).alias("new_ids"), F.coalesce("new_stems", F.lit(0)).alias("new_stems"))
