"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is an aggregation over edges, pre-aggregated by Spark, and a join with its one row a node. Its
result is written to the shared folder, so a lost executor repeats one step at most. The star of a node
with very many neighbours passes through one task, as two numbers an edge, sorted with spill; the task
never holds it: of its neighbours only the least one is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.staging import drop, stage_path


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (large-star) or smaller (small-star) neighbours to its least neighbour."""
    if large:
        seen = edges.select("v", "u").union(edges.select("u", "v")).toDF("n", "m")
        least = seen.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("least"))
        return seen.join(least, "n").where("m > n").select(F.col("m").alias("v"), F.col("least").alias("u"))
    least = edges.groupBy("v").agg(F.min("u").alias("least"))
    joined = edges.join(least, "v")
    return joined.select(F.when(F.col("u") == F.col("least"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("least").alias("u"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node id of the component, for every node of edges (a, b)."""
    spark = edges.sparkSession
    start = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u < v").distinct()
    held, path = stage_path(start, "edges")
    mark = None
    while True:
        new = _stars(held, True).distinct()
        new = _stars(new, False).where("u < v").distinct()
        new, new_path = stage_path(new, "edges")
        got = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(spark, path)
        held, path = new, new_path
        if tuple(got) == mark:
            break
        mark = tuple(got)
    return held.select(F.col("v").alias("node"), F.col("u").alias("component")).union(held.select(F.col("u"), F.col("u")).distinct())
