"""Training-data pipeline over ``documents``: toxicity, near duplicates, repeated passages, benchmarks, token ids.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given; all but the last return the columns they
got.  :func:`run` writes each stage's result as Parquet in the shared checkpoint folder before the next one reads it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.llm import bpe, decontaminate, ngram_join, substring_dedup, toxicity
from gridlens.llm.tables import free_name, stored, table, written


def _uid():
    return F.xxhash64("doc_id", F.col("text").cast("string"))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; missing texts stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "toxicity")
    return toxicity.score_documents(docs, model, carry=True, name=score).filter(F.col(score) < 0.5).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of every component, a missing id counting as largest; texts without words stay.

    Rows that agree on id and text count as one document.
    """
    groups = ngram_join.similarity_groups(docs, carry=True).filter("n_shingles > 0")
    first = groups.groupBy("_root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_uid")).alias("first"))
    dropped = stored(groups.join(first, F.col("first._uid") == F.col("_uid"), "left_anti").select("_uid").distinct())
    uid = free_name(docs, "_uid")
    named = docs.withColumn(uid, _uid()).join(dropped.withColumnRenamed("_uid", uid), uid, "left_anti")
    return named.dropDuplicates([uid]).select(*docs.columns)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages of 400 bytes or more that stand anywhere else too."""
    left = substring_dedup.remove_repeats(docs, carry=True)
    size = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", size).select(*docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words, or whole shorter item, with a benchmark item."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), carry=True)
    hit = stored(found.filter("contaminated").select("_uid").distinct())
    uid = free_name(docs, "_uid")
    return docs.withColumn(uid, _uid()).join(hit.withColumnRenamed("_uid", uid), uid, "left_anti").select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with digests of them and of the text decoded from them."""
    return bpe.encode_documents(docs, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", without_near_copies),
    ("suffix_array_dedup", without_repeated_passages),
    ("benchmark_decontamination", without_benchmarks),
    ("bpe_encoding", token_ids),
]

#: Learned scores and byte-level merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
