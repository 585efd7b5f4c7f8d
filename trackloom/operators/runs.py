"""Track segments, speeds and runs of a state: windows over one track, ordered by time.

A samples table has one row for each box: ``video_id, track, object_type, t, x1, y1, x2, y2`` (more
columns pass through). All windows are partitioned by video and track, so a shuffle deals tracks out
and nothing else; operators on the same table share that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions import geometry as G

TRACK = ["video_id", "track"]


def segments(samples: DataFrame, max_gap: float = 1.5, keys: list[str] = TRACK, order: str = "t", into: str = "segment") -> DataFrame:
    """Number the stretches of a track between gaps longer than ``max_gap``: a gap is unknown
    coverage, never continuous motion. ``key`` is ``track@segment`` where a track has several."""
    w = W.partitionBy(*keys).orderBy(order)
    gap = F.col(order) - F.lag(order).over(w)
    cut = samples.withColumn(into, F.sum(F.when(gap > max_gap, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    several = F.max(into).over(W.partitionBy(*keys)) > 0
    return cut.withColumn("key", F.when(several, F.concat_ws("@", F.col(keys[-1]).cast("string"), F.col(into).cast("string"))).otherwise(F.col(keys[-1]).cast("string")))


def edges(samples: DataFrame, keys: list[str] = ["video_id", "key"], scale: str = "first") -> DataFrame:
    """Adds ``i`` (place in the track, from 0), ``scale`` (height of the first box, or the median one)
    and ``speed`` of the step to the next sample (null at the last)."""
    w = W.partitionBy(*keys).orderBy("t")
    whole = W.partitionBy(*keys)
    high = F.col("y2") - F.col("y1")
    unit = F.first(high).over(w) if scale == "first" else F.percentile(high, 0.5).over(whole)
    out = samples.withColumn("scale", F.greatest(F.lit(1.0), unit)).withColumn("i", F.row_number().over(w) - 1)
    after = tuple(F.lead(c).over(w) for c in ("x1", "y1", "x2", "y2"))
    return out.withColumn("speed", G.speed(G.box(), after, F.col("scale"), F.lead("t").over(w) - F.col("t")))


def smoothed(edges_: DataFrame, keys: list[str] = ["video_id", "key"]) -> DataFrame:
    """Adds ``smooth``: median speed of the step with its neighbours (fewer at the ends)."""
    near = W.partitionBy(*keys).orderBy("t").rowsBetween(-1, 1)
    return edges_.withColumn("smooth", F.when(F.col("speed").isNotNull(), F.percentile("speed", 0.5).over(near)))


def runs(df: DataFrame, state: Column, keys: list[str], order: str = "t", kind: str = "edge") -> DataFrame:
    """Runs of equal ``state``: ``keys, state, start, end, first_i, last_i, n``, gaps and islands.

    ``edge``: states belong to the steps between samples (null at the last sample), and a run of
    steps ends at the sample where it stops. ``sample``: states belong to samples; a run ends at
    the first sample outside, or at the last sample if it is open.
    """
    w = W.partitionBy(*keys).orderBy(order)
    held = df.withColumn("__s", state).withColumn("__next", F.lead(order).over(w)).withColumn("__i", F.row_number().over(w) - 1)
    held = held.withColumn("__new", F.when(F.col("__s").eqNullSafe(F.lag("__s").over(w)), 0).otherwise(1))
    held = held.withColumn("__run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    if kind == "edge":
        held = held.where(F.col("__s").isNotNull())
    last = F.max(F.coalesce("__next", order))
    return held.groupBy(*keys, "__run").agg(
        F.first("__s").alias("state"), F.min(order).alias("start"), last.alias("end"),
        F.min("__i").alias("first_i"), F.max("__i").alias("last_i"), F.count("*").alias("n")).drop("__run")


def ends(samples: DataFrame, duration: Column, fps: Column, keys: list[str] = TRACK) -> DataFrame:
    """``appeared`` at a track's first sample; ``disappeared`` at its last if that is earlier than
    two frames before the recording's end."""
    seen = samples.groupBy(*keys).agg(F.min("t").alias("first"), F.max("t").alias("last"), F.max(duration - 2 / fps).alias("limit"))
    return seen.select(*keys, F.lit("appeared").alias("kind"), F.col("first").alias("t")).unionByName(
        seen.where("last < limit").select(*keys, F.lit("disappeared").alias("kind"), F.col("last").alias("t")))


def longest_hits(hits: DataFrame, keys: list[str], order: str, hit: Column) -> DataFrame:
    """Longest run of consecutive hits on a sample grid; a missed sample starts anew."""
    found = runs(hits, hit, keys, order, "sample").where("state")
    return hits.select(*keys).distinct().join(found.groupBy(*keys).agg(F.max("n").alias("n")), keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("longest"))


def gap_summary(samples: DataFrame, longer_than: float = 0.75, keys: list[str] = TRACK) -> DataFrame:
    """Number of samples, duration, gaps over a limit, and whether the track persists (two samples)."""
    step = F.col("t") - F.lag("t").over(W.partitionBy(*keys).orderBy("t"))
    return samples.withColumn("__gap", step).groupBy(*keys).agg(
        F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("duration"), F.count_if(F.col("__gap") > longer_than).alias("gaps"),
        (F.count("*") >= 2).alias("persistent"))


def motion_summary(samples: DataFrame, contiguous: float, still: float = 0.12, keys: list[str] = TRACK) -> DataFrame:
    """Motion of each track: displacement in median heights, median speed, greatest and least
    acceleration, seconds still, gaps, longest stretch without one. Steps over a gap have no speed."""
    own = [*keys]
    cut = segments(samples, contiguous, own, into="__seg")
    moved = edges(cut.withColumn("__key", F.concat_ws("@", F.col(own[-1]).cast("string"), "__seg")), [*own[:-1], "__key"], "median")
    w = W.partitionBy(*own).orderBy("t")
    moved = moved.withColumn("__dt", F.lead("t").over(w) - F.col("t"))
    inside = W.partitionBy(*own[:-1], "__key").orderBy("t")
    rate = (F.col("speed") - F.lag("speed").over(inside)) / F.greatest(F.lit(0.01), F.col("t") - F.lag("t").over(inside))
    moved = moved.withColumn("__acc", rate)
    whole = moved.groupBy(*own).agg(
        F.min_by(F.struct("x1", "y1", "x2", "y2"), "t").alias("a"), F.max_by(F.struct("x1", "y1", "x2", "y2"), "t").alias("b"),
        F.greatest(F.lit(1.0), F.percentile(F.col("y2") - F.col("y1"), 0.5)).alias("height"), F.percentile("speed", 0.5).alias("median_speed"),
        F.max("__acc").alias("max_acceleration"), F.min("__acc").alias("min_acceleration"),
        F.coalesce(F.sum(F.when(F.col("speed") <= still, F.col("__dt"))), F.lit(0.0)).alias("still_seconds"), F.max("__seg").alias("gaps"))
    longest = moved.groupBy(*own, "__key").agg((F.max("t") - F.min("t")).alias("d")).groupBy(*own).agg(F.max("d").alias("longest_stretch"))
    corner = lambda s: tuple(F.col(f"{s}.{c}") for c in ("x1", "y1", "x2", "y2"))
    return whole.withColumn("displacement", G.distance(corner("a"), corner("b"), F.col("height"))).drop("a", "b", "height").join(longest, own)
