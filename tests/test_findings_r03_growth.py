"""Findings on growth of the third round: each test failed before its repair."""

from __future__ import annotations

import numpy as np
import pandas as pd
from gridlens.functions import text as X
from gridlens.llm import whitening
from gridlens.operators import resample
from gridlens.plans import adapters
from pyspark.sql import functions as F


def test_cleaned_text_is_a_column_and_not_written_out_again(spark, data):
    cleaned = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", X.plain_text(F.col("text")).alias("plain"))
    stripped = cleaned.select("*", X.guidance_removed(F.col("plain"), F.lit("State it.")).alias("stripped"))
    plan = stripped.select("*", X.normalized(F.col("stripped")).alias("folded"))._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.count("```(?:xml") for line in plan.splitlines()) <= 4


def test_blocks_are_drawn_by_bytes():
    sizes = np.array([700, 0, 300])
    ones = [resample._block_bootstrap_sums(np.ones(s), sizes, b, 500, 3) for b, s in enumerate(sizes.tolist()) if s]
    assert np.array_equal(sum(ones), np.full(500, 1000.0))
    means = resample._block_bootstrap_sums(np.arange(700.0), np.array([700]), 0, 4000, 5) / 700
    assert abs(means.mean() - 349.5) < 0.7 and abs(means.std() - np.arange(700).std() / 700**0.5) < 0.3
    flips = resample._block_flip_sums(2.0 ** np.arange(11), 40_000, [4, 1])
    # Every pattern of signs has a sum of its own.
    values, counts = np.unique(flips, return_counts=True)
    assert np.array_equal(values, np.arange(-2047.0, 2048, 2)) and counts.max() < 45


def test_passes_over_a_small_fit_list_are_few_tasks(spark):
    rows = [([float(i % 97), float(i), 0.5 * i],) for i in range(2000)]
    vectors = spark.createDataFrame(rows, "v array<double>").repartition(40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        fit = whitening.FitList(vectors, 3, 2000)
        assert fit.n == 2000 and fit.blocks.rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_python_functions_are_handed_bounded_batches(spark, tmp_path):
    long = F.when(F.col("id") < 4000, F.lit("x")).otherwise(F.repeat(F.lit("é"), 100_000))
    spark.range(4060).select(F.col("id").alias("doc_id"), long.alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")

    @F.pandas_udf("struct<n:long,chars:long>")
    def handed(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"n": [len(text)] * len(text), "chars": [int(text.str.len().sum())] * len(text)})

    most = adapters.table(spark, str(tmp_path), "documents").select(handed("text").alias("h")).agg(F.max("h.n"), F.max("h.chars")).first()
    assert most[0] <= 500 and most[1] <= 3_000_000
