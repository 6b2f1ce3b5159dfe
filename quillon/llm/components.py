"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is an aggregation and a join on nodes; nothing about the graph comes to the driver but
whether a step changed anything. Each step is written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """edges: (a, b) with a > b. Links each node's larger (both: of all neighbours) ones to its least.

    The least neighbours are a table of their own, so that the join's shuffles are plain ones and Spark
    can split a hub's edges over several tasks.
    """
    if both:
        around = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "cc-least")
        out = around.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = materialize(edges.groupBy("a").agg(F.min("b").alias("m")), "cc-least")
        out = edges.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b) of any comparable type, either way round, repeats allowed. Returns (node, label)
    for every node with an edge: label is the least node reachable. Steps go on until one changes nothing;
    they are about the logarithm of the longest path."""
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    said = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    old = said(now)
    while old[0]:
        now = materialize(_star(_star(now, True), False), "cc")
        seen = said(now)
        if seen == old:
            break
        old = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b"), F.col("b")).distinct())
