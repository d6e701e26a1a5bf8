"""Findings of the third round: each test failed before its repair."""

from __future__ import annotations

import compare
from gridlens.operators import grid
from gridlens.plans import adapters, catalog
from pyspark.sql import functions as F


def test_entities_cut_off_by_a_tag_stay_as_they_are(spark, tmp_path):
    pages = [(1, "<title>this and&amp</title><p>a &amp; b &lt;i&gt; &copy 2</p>"), (2, "&**amp**; x"), (3, "plain")]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    sql = catalog.ORACLES["plain_text_html"].replace("FROM pages", f"FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    found = catalog.QUERIES["plain_text_html"](spark, str(tmp_path))
    assert compare.differences(found, compare.connect(str(tmp_path / "none")), sql) is None


def test_pending_cells_pass_no_table_through_the_driver(spark, data):
    plan = catalog.QUERIES["pending_cells"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_tasks_over_a_table_of_one_row_group_grow_with_it(spark, tmp_path):
    parts = spark.range(400_000).select(F.col("id").alias("p_partkey"), F.sha2(F.col("id").cast("string"), 256).alias("p_name"))
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    rows = adapters.dealt(spark, str(tmp_path), "part", "p_partkey", kilobytes=1024)
    counts = rows.groupBy(F.spark_partition_id()).count().collect()
    assert sum(c["count"] for c in counts) == 400_000
    assert len(counts) > 20 and max(c["count"] for c in counts) < 30_000


def test_role_cells_are_shuffled_once_over_tasks_by_size(spark, data):
    plan = catalog.QUERIES["role_differences"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "REPARTITION_BY_NUM" in plan


def test_plan_counts_do_not_multiply_their_cells(spark, data):
    plan = catalog.QUERIES["plan_counts"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_plan_counts_ignore_missing_keys(spark):
    cells = spark.createDataFrame([("a", "m0"), ("a", "m1"), ("b", None), (None, "m1")], "question_id string, model_id string")
    row = grid.plan_counts(cells).first()
    assert (row["cells"], row["questions"], row["models"]) == (4, 2, 2)
    assert grid.plan_counts(cells.limit(0)).first()["questions"] == 0
