"""Joins on time: as-of, range and interval predicates, all by equal buckets of time first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPERATORS = ("before", "followed_by", "after", "during", "overlaps", "near", "within")


def holds(a: Column, b: Column, c: Column, d: Column, operator: str, window: float = 0) -> Column:
    """Whether ``[a, b]`` bears ``operator`` to ``[c, d]`` (seconds, endpoints included). A negative
    window leaves the gap of before, followed_by and after without a bound."""
    if window < -1:
        raise ValueError("the window is at least -1")
    if operator in ("before", "followed_by"):
        gap = c - b
    elif operator == "after":
        gap = a - d
    elif operator == "during":
        return (c <= a) & (b <= d)
    elif operator == "overlaps":
        return F.greatest(a, c) <= F.least(b, d)
    elif operator in ("near", "within"):
        return F.greatest(F.lit(0.0), c - b, a - d) <= window
    else:
        raise ValueError(f"unknown temporal operator {operator}")
    return (gap >= 0) & ((gap <= window) if window >= 0 else F.lit(True))


def _buckets(start: Column, end: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(start / width).cast("long"), F.floor(end / width).cast("long")))


def interval_join(left: DataFrame, right: DataFrame, operator: str, window: float, width: float, keys: list[str] = ()) -> DataFrame:
    """Pairs of ``left(id1, start1, end1, keys)`` and ``right(id2, start2, end2, keys)`` for which
    ``holds``; equal ``keys`` too, if given. Rows with reversed intervals are left out.

    Each side is dealt to the time buckets of ``width`` seconds that it reaches (the left by the
    window further), and a pair is taken in the one bucket where the later of its reaches begins:
    so no pair comes twice and no ``distinct`` is needed. An unbounded window has no bucket; it needs
    ``keys``.
    """
    keys = list(keys)
    a, b, c, d = (F.col(x) for x in ("start1", "end1", "start2", "end2"))
    one, two = left.where("start1 <= end1"), right.where("start2 <= end2")
    test = holds(a, b, c, d, operator, window)
    if window < 0 and operator in ("before", "followed_by", "after"):
        if not keys:
            raise ValueError("an unbounded window needs keys")
        return one.join(two, keys).where(test)
    reach = max(0.0, float(window))
    back = reach if operator in ("after", "near", "within") else 0.0
    ahead = reach if operator in ("before", "followed_by", "near", "within") else 0.0
    one = one.withColumn("__bucket", _buckets(a - back, b + ahead, width))
    two = two.withColumn("__bucket", _buckets(c, d, width))
    once = F.col("__bucket") == F.floor(F.greatest(a - back, c) / width)
    return one.join(two, [*keys, "__bucket"]).where(once & test).drop("__bucket")


def asof_nearest(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float, t1: str = "t1", t2: str = "t2", strict: bool = False) -> DataFrame:
    """Each left row with its nearest right row in time, at most ``tolerance`` away (less, if
    ``strict``); ties take the earlier, right rows may repeat. Left rows without one are dropped.

    Right rows are dealt to their bucket of ``tolerance`` seconds and both neighbours, so the join is
    on equal keys. ``left`` rows must be unique.
    """
    near = right.withColumn("__b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.floor(F.col(t2) / tolerance) + i)))
    gap = F.abs(F.col(t1) - F.col(t2))
    pairs = left.withColumn("__b", F.floor(F.col(t1) / tolerance)).join(near, [*keys, "__b"]).where(gap < tolerance if strict else gap <= tolerance)
    names = [c for c in left.columns]
    best = F.min(F.struct(gap.alias("gap"), F.col(t2).alias("t"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(right.columns) if c not in keys])).alias("m")
    picked = pairs.groupBy(*names).agg(best)
    return picked.select(*names, *[F.col(f"m.v{i}").alias(c) for i, c in enumerate(right.columns) if c not in keys])


def global_nearest(left: DataFrame, right: DataFrame, keys: list[str], t1: str = "t1", t2: str = "t2") -> DataFrame:
    """The single nearest pair of each key over all samples; the earlier pair wins a tie. Both sides
    are sorted together: a left sample's nearest is the last right one before it or the next."""
    rows = left.select(*keys, F.col(t1).alias("__t"), F.col(t1).alias("__l"), F.lit(None).cast("double").alias("__r")).unionByName(
        right.select(*keys, F.col(t2).alias("__t"), F.lit(None).cast("double").alias("__l"), F.col(t2).alias("__r")))
    w = W.partitionBy(*keys).orderBy("__t", F.col("__r").isNull())
    sides = F.array(F.max("__r").over(w.rowsBetween(W.unboundedPreceding, 0)), F.min("__r").over(w.rowsBetween(0, W.unboundedFollowing)))
    near = rows.withColumn("__near", F.array_compact(sides)).where("__l is not null").select(*keys, F.col("__l").alias(t1), F.explode("__near").alias(t2))
    return near.withColumn("gap", F.abs(F.col(t1) - F.col(t2))).groupBy(*keys).agg(F.min(F.struct("gap", t1, t2)).alias("m")).select(*keys, "m.*")


def sums_before(points: DataFrame, marks: DataFrame, keys: list[str], weights: list[str]) -> DataFrame:
    """``marks(keys, ..., t, late)`` with the sum of each weight over the points before ``t`` (up to it, if
    ``late``): ``points(keys, t, weights)``. Points and marks of a key are sorted together, so no point
    meets a mark."""
    names = [c for c in marks.columns if c not in (*keys, "t")]
    told = F.struct(*names)
    rows = marks.select(*keys, "t", F.when(F.col("late"), 2).otherwise(0).alias("__side"), told.alias("__mark"), *[F.lit(0).cast("long").alias(c) for c in weights])
    rows = rows.unionByName(points.select(*keys, "t", F.lit(1).alias("__side"), F.lit(None).cast(rows.schema["__mark"].dataType).alias("__mark"), *[F.col(c).cast("long") for c in weights]))
    w = W.partitionBy(*keys).orderBy("t", "__side").rowsBetween(W.unboundedPreceding, 0)
    return rows.select(*keys, "t", "__mark", *[F.sum(c).over(w).alias(c) for c in weights]).where("__mark is not null").select(*keys, "t", "__mark.*", *weights)


def before_after(points: DataFrame, events: DataFrame, keys: list[str], further: float) -> DataFrame:
    """For each event ``(keys, id, start, end)``: the last point ``t`` before its start, the first after its end,
    and how many lie in ``(end, end + further]``. One sort of each key's points and events."""
    at = F.array(*[F.struct(F.lit(name).alias("what"), t.alias("t"), F.lit(side).alias("side")) for name, t, side in (("start", F.col("start"), 0), ("end", F.col("end"), 2), ("far", F.col("end") + further, 2))])
    marks = events.select(*keys, F.struct("id", "start", "end").alias("__event"), F.explode(at).alias("m")).select(*keys, "__event", "m.what", "m.t", F.col("m.side").alias("__side"), F.lit(None).cast("double").alias("__p"))
    rows = marks.unionByName(points.select(*keys, F.lit(None).cast(marks.schema["__event"].dataType).alias("__event"), F.lit(None).cast("string").alias("what"), "t", F.lit(1).alias("__side"), F.col("t").cast("double").alias("__p")))
    w = W.partitionBy(*keys).orderBy("t", "__side")
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    rows = rows.withColumn("__last", F.max("__p").over(back)).withColumn("__n", F.count("__p").over(back)).withColumn("__next", F.min("__p").over(ahead)).where("__event is not null")
    of = lambda what, c: F.max(F.when(F.col("what") == what, F.col(c)))
    out = rows.groupBy(*keys, "__event").agg(of("start", "__last").alias("last_before"), of("end", "__next").alias("first_after"), (of("far", "__n") - of("end", "__n")).alias("n_after"))
    return out.select(*keys, "__event.*", "last_before", "first_after", "n_after")


def merged(intervals: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Union of intervals by key: touching or overlapping ones become one."""
    w = W.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = intervals.withColumn("__new", F.when(F.col(start) <= reach, 0).otherwise(1))
    marked = marked.withColumn("__island", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def covers(recorded: DataFrame, asked: DataFrame, group: list[str], width: float = 30.0, keys: list[str] = ()) -> DataFrame:
    """For each ``asked(id, after, before)``: whether one group's united intervals cover it. Nothing
    covers a reversed interval; an empty one is covered as soon as any recording exists. With ``keys``,
    columns of both, only recordings of equal keys count.

    A range is covered if of the united intervals that start up to ``after`` the farthest end reaches
    ``before``. That running maximum is taken inside buckets of ``width`` and over the buckets' maxima.
    """
    keys = list(keys)
    united = merged(recorded, [*keys, *group])
    bucket = F.floor(F.col("t") / width)
    rows = united.select(*keys, F.col("start").alias("t"), F.lit(0).alias("__side"), F.col("end").alias("__end"), F.lit(None).cast(asked.schema["id"].dataType).alias("id"), F.lit(None).cast("double").alias("before")).unionByName(
        asked.where("before > after").select(*keys, F.col("after").cast("double").alias("t"), F.lit(1).alias("__side"), F.lit(None).cast("double").alias("__end"), "id", F.col("before").cast("double").alias("before")))
    rows = rows.withColumn("__b", bucket)
    tops = rows.groupBy(*keys, "__b").agg(F.max("__end").alias("__top"))  # as many rows as there are buckets of time
    earlier = tops.select(*keys, "__b", F.max("__top").over(W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)).alias("__before"))
    inside = F.max("__end").over(W.partitionBy(*keys, "__b").orderBy("t", "__side").rowsBetween(W.unboundedPreceding, 0))
    reach = rows.withColumn("__in", inside).where("__side = 1").join(earlier, [*keys, "__b"]).withColumn("__reach", F.greatest("__in", "__before"))
    hit = reach.select("id", F.coalesce(F.col("__reach") >= F.col("before"), F.lit(False)).alias("__hit"))
    some = recorded.select(*keys, F.lit(True).alias("__any")).distinct() if keys else recorded.limit(1).select(F.lit(True).alias("__any"))
    out = asked.join(hit, "id", "left").join(some, keys or F.lit(True), "left")
    return out.select("id", F.when(F.col("before") == F.col("after"), F.coalesce("__any", F.lit(False))).otherwise(F.coalesce("__hit", F.lit(False))).alias("covered"))
