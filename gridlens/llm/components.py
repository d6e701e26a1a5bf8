"""Connected components of an edge table with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm.tables import few_tasks, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, left: str, right: str, rows: int | None = None) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of its component.

    Large-star and small-star rounds alternate until the edges are stars around the smallest nodes and no longer
    change, which takes about the logarithm of the longest path.  Smallest neighbours are aggregated before the
    shuffle, so a node with a third of all edges is no single task's work.  Every round is written to the shared
    checkpoint folder, in as many parts as its edges need; ``rows`` is the number of edges, if known.  Loops and edges with a missing end are ignored; no edges give an empty table.
    """
    live = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).filter("u <> v").distinct()
    state, most = None, edges.count() if rows is None else rows
    if not most:
        return live.select(F.col("u").alias("node"), F.col("v").alias("root")).filter(F.lit(False))
    while True:
        # A large star makes an edge of an edge at most, a small star two.
        live = stored(few_tasks(_large_star(live), most))
        live = stored(few_tasks(_small_star(live), 2 * most))
        now = live.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state, most = now, now[0]
    roots = live.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stored(few_tasks(live.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots), 2 * now[0]))
