"""Connected components of an edge table by alternating large and small stars.

Each round is two partially combined minima and two joins on the stored edges;
nothing reaches the driver but three sums.  A node with very many neighbours is
a hot key of plain sort-merge joins, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voicegrid.session import scratch_table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (``u`` > ``v``)."""
    if large:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionAll(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of the edges ``u``, ``v`` (bigint, no nulls)."""
    edges = scratch_table(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    before = None
    while True:
        edges = scratch_table(_star(scratch_table(_star(edges, True), "edges"), False), "edges")
        state = tuple(
            edges.agg(
                F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("v")
            ).first()
        )
        if state == before or state[0] == 0:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
