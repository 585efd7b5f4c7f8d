"""What persons do with objects: picking up, placing and leaving unattended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions import geometry as G
from trackloom.operators.motion import OBJECT_MOVING, PORTABLE
from trackloom.operators.runs import edges, runs

NEAR, FAR = 1.5, 2.2


def _nearest(left: DataFrame, right: DataFrame, tolerance: float) -> DataFrame:
    """Each ``left(video_id, a, t, ...)`` sample with the nearest ``right(video_id, b, t2, ...)`` sample of
    every other track: equal buckets of time first."""
    near = right.withColumn("__b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.floor(F.col("t2") / tolerance) + i)))
    pairs = left.withColumn("__b", F.floor(F.col("t") / tolerance)).join(near, ["video_id", "__b"]).where((F.col("a") != F.col("b")) & (F.abs(F.col("t") - F.col("t2")) <= tolerance))
    rest = [c for c in (*left.columns, *right.columns) if c not in ("video_id", "a", "b", "t", "t2")]
    best = F.min(F.struct(F.abs(F.col("t") - F.col("t2")).alias("gap"), "t2", *rest)).alias("m")
    return pairs.groupBy("video_id", "a", "b", "t").agg(best).select("video_id", "a", "b", "t", *[F.col(f"m.{c}").alias(c) for c in rest])


def _sides(tracks: DataFrame, name: str, time: str, who: Column) -> DataFrame:
    (cx, cy), high = G.centre(G.box()), F.greatest(F.lit(1.0), F.col("y2") - F.col("y1"))
    first = F.first(F.col("y2") - F.col("y1")).over(W.partitionBy("video_id", "key").orderBy("t"))
    return tracks.withColumn("__first", F.greatest(F.lit(1.0), first)).where(who).select(
        "video_id", F.col("key").alias(name), F.col("t").alias(time), cx.alias(f"{name}x"), cy.alias(f"{name}y"), high.alias(f"{name}h"), F.col("__first").alias(f"{name}h0"))


def still_objects(tracks: DataFrame, least: float = 2.0) -> DataFrame:
    """Still runs of portable objects: ``video_id, object, start, end``."""
    moved = edges(tracks.where(F.col("object_type").isin(*PORTABLE)))
    found = runs(moved, F.when(F.col("speed").isNotNull(), F.col("speed") >= OBJECT_MOVING), ["video_id", "key"]).where(~F.col("state"))
    return found.where(F.col("end") - F.col("start") >= least).select("video_id", F.col("key").alias("object"), "start", "end")


def _coupled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Quality of the common motion of person ``a`` and object ``b`` in consecutive pairs: mean residual of
    the step vectors plus a tenth of the mean distance, over two agreeing steps or more; the
    object must be displaced. Lower is better."""
    w = W.partitionBy(*keys).orderBy("t")
    step = {c: F.col(c) - F.lag(c).over(w) for c in ("t", "ax", "ay", "bx", "by")}
    moved = rows.select(*keys, "t", "ax", "ay", "bx", "by", "ah", *[v.alias(f"d{c}") for c, v in step.items()], F.lag("ah").over(w).alias("h"))
    pn, on = F.hypot("dax", "day"), F.hypot("dbx", "dby")
    residual = F.hypot(F.col("dax") - F.col("dbx"), F.col("day") - F.col("dby")) / F.greatest(pn, on, F.lit(1.0))
    cosine = (F.col("dax") * F.col("dbx") + F.col("day") * F.col("dby")) / F.greatest(pn * on, F.lit(1e-9))
    far = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) / F.greatest(F.lit(1.0), F.col("h"))
    good = (F.col("dt") <= 1.5) & (pn >= 2) & (on >= 2) & (cosine >= 0.8) & (residual <= 0.35) & (far <= NEAR)
    ends = moved.groupBy(*keys).agg(
        F.count_if(good).alias("good"), F.avg(F.when(good, residual)).alias("r"), F.avg(F.when(good, far)).alias("f"),
        F.min_by(F.struct("bx", "by", "ah"), "t").alias("s"), F.max_by(F.struct("bx", "by"), "t").alias("e"))
    displaced = F.hypot(F.col("e.bx") - F.col("s.bx"), F.col("e.by") - F.col("s.by"))
    return ends.where((F.col("good") >= 2) & (displaced >= F.greatest(F.lit(4.0), 0.2 * F.col("s.ah")))).select(*keys, (F.col("r") + 0.1 * F.col("f")).alias("quality"))


def handled(tracks: DataFrame, tolerance: float = 0.3, margin: float = 0.05) -> DataFrame:
    """``picked_up`` and ``placed_object``: ``video_id, person, object, kind, start, end, quality``.

    Beside each still run of an object, in the three seconds after (picked up) or before (placed), the
    person whose motion fits best, unless a second fits almost as well. Picked up: near in the two
    seconds before the run's end, and twice after it. Placed: near in the run's first two seconds,
    then ``FAR`` away for two seconds.
    """
    person, thing = F.col("object_type") == "person", F.col("object_type").isin(*PORTABLE)
    met = _nearest(_sides(tracks, "a", "t", person), _sides(tracks, "b", "t2", thing), tolerance)
    met = met.withColumn("d", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) / F.col("ah0"))
    rest = still_objects(tracks).withColumnRenamed("object", "b")
    both = met.join(rest, ["video_id", "b"])
    keys = ["video_id", "b", "start", "end", "a"]
    t, d, s, e = (F.col(c) for c in ("t", "d", "start", "end"))
    picked = _coupled(both.where((t >= e) & (t <= e + 3)), keys).join(both.groupBy(*keys).agg(
        F.bool_or((t >= e - 2) & (t <= e) & (d <= NEAR)).alias("before"), F.count_if((t > e) & (t <= e + 3) & (d <= NEAR)).alias("n"),
        F.max(F.when((t > e) & (t <= e + 3) & (d <= NEAR), t)).alias("finish")), keys).where("before and n >= 2")
    close = both.withColumn("close", F.min(F.when((t >= s) & (t <= s + 2) & (d <= NEAR), t)).over(W.partitionBy(*keys)))
    left = close.withColumn("left", F.min(F.when((t > F.col("close")) & (t <= e) & (d >= FAR), t)).over(W.partitionBy(*keys)))
    gone = left.where((t >= F.col("left")) & (t <= F.least(e, F.col("left") + 2))).groupBy(*keys, "left").agg(F.max("t").alias("last"), F.bool_and(d >= FAR).alias("all"))
    placed = _coupled(both.where((t >= s - 3) & (t <= s)), keys).join(gone.where((F.col("last") - F.col("left") >= 2) & F.col("all")).select(*keys, F.col("left").alias("finish")), keys)
    found = picked.select(*keys, "quality", "finish", F.lit("picked_up").alias("kind")).unionByName(placed.select(*keys, "quality", "finish", F.lit("placed_object").alias("kind")))
    w = W.partitionBy("video_id", "b", "start", "kind").orderBy("quality", "a")
    found = found.withColumn("place", F.row_number().over(w)).withColumn("next", F.lead("quality").over(w)).where((F.col("place") == 1) & (F.col("next").isNull() | (F.col("next") - F.col("quality") >= margin)))
    begin = F.when(F.col("kind") == "picked_up", e).otherwise(s)
    return found.select("video_id", F.col("a").alias("person"), F.col("b").alias("object"), "kind", begin.alias("start"), F.col("finish").alias("end"), "quality")


def unattended(tracks: DataFrame, seconds: float = 5.0, tolerance: float = 0.3) -> DataFrame:
    """Objects left alone: a person was near a still object, then ``FAR`` away for ``seconds`` until near
    again or the run's end, and nobody else is near meanwhile. The first departure of each still run
    that holds: ``video_id, object, person, start, end``."""
    person, thing = F.col("object_type") == "person", F.col("object_type").isin(*PORTABLE)
    met = _nearest(_sides(tracks, "a", "t", person), _sides(tracks, "b", "t2", thing), tolerance)
    met = met.withColumn("d", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) / F.col("ah0")).select("video_id", "a", "b", "t", "d")
    both = met.join(still_objects(tracks).withColumnRenamed("object", "b"), ["video_id", "b"]).where("t >= start and t <= end")
    keys = ["video_id", "b", "start", "end", "a"]
    w = W.partitionBy(*keys)
    t, d = F.col("t"), F.col("d")
    seen = both.withColumn("near", F.min(F.when(d <= NEAR, t)).over(w)).withColumn("left", F.min(F.when((t > F.col("near")) & (d >= FAR), t)).over(w))
    gone = seen.where("left is not null").groupBy(*keys, "left").agg(F.min(F.when((t > F.col("left")) & (d <= NEAR), t)).alias("back")).withColumn("back", F.coalesce("back", "end"))
    gone = gone.where(F.col("back") - F.col("left") >= seconds)
    others = _nearest(_sides(tracks, "a", "t", thing), _sides(tracks, "b", "t2", person), tolerance)
    close = others.where(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) / F.col("bh") <= NEAR).select("video_id", F.col("a").alias("b"), F.col("b").alias("other"), F.col("t").alias("seen"))
    watched = gone.join(close, ["video_id", "b"]).where("other <> a and seen >= left and seen <= back").select(*keys).distinct()
    alone = gone.join(watched, keys, "left_anti")
    first = F.row_number().over(W.partitionBy("video_id", "b", "start").orderBy("left", "back", "a"))
    return alone.withColumn("place", first).where("place = 1").select("video_id", F.col("b").alias("object"), F.col("a").alias("person"), F.col("left").alias("start"), F.col("back").alias("end"))
