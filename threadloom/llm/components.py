"""Connected components by alternating large-star and small-star rounds on a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import Chain


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, src: str, dst: str, label: str = "edges") -> DataFrame:
    """(node, root) for every node of an edge between two different nodes; root is the smallest node of its component.

    Each round is two aggregations with map-side combine and two joins whose skewed keys the adaptive
    planner can split; nothing is gathered on the driver but a count and a checksum. Rounds grow with the
    logarithm of the longest path. Null ends are ignored; an empty table gives an empty result.
    """
    rounds = Chain(edges.sparkSession, label)
    now = rounds.put(edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter("u > v").distinct())
    before = _digest(now)
    while before[0]:
        # large star: a node's larger neighbours move to its smallest neighbour
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        )
        # small star: a node and its smaller neighbours move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u > v")
            .distinct()
        )
        now = rounds.put(small)
        after = _digest(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )
