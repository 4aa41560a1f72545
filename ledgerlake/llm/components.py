"""Connected components over an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import drop_stage, write_stage


def connected_components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reachable; nodes without an edge are not listed.

    Every round links all neighbours of a node to the smallest of them (large star, then small star):
    rows never outgrow the edges given, and rounds grow with the logarithm of the longest path.
    Minima are aggregates with map-side combination. The joins that hand them back are keyed by node:
    the edges of a hub meet in one shuffle partition, rows of two numbers, which adaptive skew handling
    splits where it is large. A round's table is deleted once the next one is written. Raises
    RuntimeError if it has not converged after ``most_rounds``.
    """
    current, folder = write_stage(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(most_rounds):
        # large star: for every node, link its larger neighbours to the smallest in its neighbourhood
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: link a node's smaller neighbours, and the node itself, to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        spark, last = edges.sparkSession, folder
        current, folder = write_stage(linked.where("u <> v").distinct())
        drop_stage(spark, last)
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = tuple(now)
    raise RuntimeError(f"components have not converged in {most_rounds} rounds")
