"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node and root, the least node reachable, for every node that isn't a root itself.

    ``edges`` has child and parent, child > parent. Each round, a child keeps its least parent,
    its other parents are hung below that one, and every pointer is replaced by the pointer
    behind it. Tables stay linear in the edges. Rounds are written to the shared folder.
    """
    edges, n = scratch.keep(edges.select("child", "parent"), "edges0"), 0
    while True:
        best = edges.groupBy("child").agg(F.min("parent").alias("parent"))
        best = scratch.keep(best, f"best{n}")
        up = best.select(F.col("child").alias("parent"), F.col("parent").alias("above"))
        jumped = best.join(up, "parent", "left").select(
            "child", F.coalesce("above", "parent").alias("parent"),
            F.col("above").isNotNull().alias("moved"))
        other = edges.join(best.withColumnRenamed("parent", "least"), "child") \
            .where("parent <> least").select(F.col("parent").alias("child"),
                                             F.col("least").alias("parent"),
                                             F.lit(True).alias("moved"))
        edges = scratch.keep(jumped.unionByName(other).groupBy("child", "parent")
                             .agg(F.max("moved").alias("moved")), f"edges{n + 1}")
        if not edges.where("moved").limit(1).count():
            return edges.select(F.col("child").alias("node"), F.col("parent").alias("root"))
        n += 1
