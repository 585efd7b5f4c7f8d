"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.plans.durable import counted
from trackloom.plans.hot_keys import attach


def _stars(edges: DataFrame, total: int, larger: bool) -> DataFrame:
    """Large-star: each vertex hands its larger neighbours to its least neighbour. Small-star: the
    smaller neighbours and itself. Both keep what is connected."""
    both = edges.select(F.col("v").alias("u"), F.col("u").alias("v")) if not larger else edges.union(edges.select("v", "u").toDF("u", "v"))
    least, _ = counted(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")))
    moved = attach(both, least, ["u"], "n", 2 * total)
    if larger:
        out = moved.where("v > u").select(F.col("m").alias("u"), "v")
    else:
        out = moved.select(F.col("m").alias("u"), "v").union(least.select(F.col("m").alias("u"), F.col("u").alias("v")))
    return out.where("u < v").distinct()


def _unsettled(edges: DataFrame) -> int:
    """Vertices that hang twice or hang and are hung on; none such, and it is a forest of stars."""
    ends = edges.select(F.col("v").alias("id"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
    ends = ends.union(edges.select("u", F.lit(0), F.lit(1))).groupBy("id").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return ends.agg(F.count_if(F.expr("hangs > 1 or hangs = 1 and holds = 1"))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of comparable ids -> ``(id, component)`` for every id on an edge with two
    different ends; the component is its least id. Hot vertices are spread (``attach``), no edge
    reaches the driver, and every round is written to the checkpoint folder."""
    edges, total = counted(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    while _unsettled(edges):
        edges, total = counted(_stars(_stars(edges, total, True), total, False))
    return edges.select(F.col("v").alias("id"), F.col("u").alias("component")).union(
        edges.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct())
