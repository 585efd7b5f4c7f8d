"""Contact runs of a hand with an object region, and the pickups and placements they suggest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions import geometry as G
from trackloom.operators.intervals import sums_before

KEYS = ["video_id", "person"]


def contact_runs(observations: DataFrame, threshold: float = 0.45, max_gap: float = 0.6, keys: list[str] = KEYS) -> DataFrame:
    """Runs of two or more consecutive observations with ``probability >= threshold``, each at most
    ``max_gap`` seconds after the one before; an observation below ends a run.

    ``observations(keys, id, t, hand, probability, x1..y2)`` are ordered by time, then hand, then
    id: both hands share one history. A run's ``stability`` is ``1 - mean acceleration / 800`` of
    the hand box, at least 0; 0.5 without two observations.
    """
    w = W.partitionBy(*keys).orderBy("t", "hand", "id")
    held = observations.withColumn("on", F.col("probability") >= threshold)
    new = ~F.coalesce(F.lag("on").over(w), F.lit(False)) | (F.col("t") - F.lag("t").over(w) > max_gap)
    held = held.withColumn("run", F.sum(new.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).where("on")
    own = W.partitionBy(*keys, "run").orderBy("t", "hand", "id")
    cx, cy = G.centre(G.box())
    dt = F.greatest(F.lit(0.001), F.col("t") - F.lag("t").over(own))
    held = held.withColumn("vx", (cx - F.lag(cx).over(own)) / dt).withColumn("vy", (cy - F.lag(cy).over(own)) / dt)
    turn = F.hypot(F.col("vx") - F.lag("vx").over(own), F.col("vy") - F.lag("vy").over(own)) / dt
    held = held.withColumn("speed", F.hypot("vx", "vy")).withColumn("turn", turn)
    runs = held.groupBy(*keys, "run").agg(
        F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n"), F.avg("probability").alias("mean_probability"),
        F.coalesce(F.avg("speed"), F.lit(0.0)).alias("mean_speed"), F.coalesce(F.avg("turn"), F.lit(0.0)).alias("mean_turn"))
    return runs.where("n >= 2").withColumn("stability", F.greatest(F.lit(0.0), 1 - F.col("mean_turn") / 800))


def _around(runs: DataFrame, observations: DataFrame, threshold: float, near: float, keys: list[str]) -> DataFrame:
    """Adds to each run whether something was observed in the ``near`` seconds before it, whether the
    hand was free then, and whether it is free in the ``near`` seconds after."""
    points = observations.select(*keys, "t", F.lit(1).alias("seen"), (F.col("probability") < threshold).cast("long").alias("free"))
    edge = lambda name, t, late: F.struct(F.lit(name).alias("what"), t.alias("t"), F.lit(late).alias("late"))
    edges = F.array(edge("b0", F.col("start") - near, False), edge("b1", F.col("start"), False), edge("a0", F.col("end"), True), edge("a1", F.col("end") + near, True))
    marks = runs.select(*keys, "run", F.explode(edges).alias("m")).select(*keys, "run", "m.what", "m.t", "m.late")
    sums = sums_before(points, marks, keys, ["seen", "free"])
    of = lambda what, c: F.max(F.when(F.col("what") == what, F.col(c)))
    told = sums.groupBy(*keys, "run").agg(
        (of("b1", "seen") > of("b0", "seen")).alias("seen_before"), (of("b1", "free") > of("b0", "free")).alias("free_before"), (of("a1", "free") > of("a0", "free")).alias("free_after"))
    return runs.join(told, [*keys, "run"])


def manipulations(observations: DataFrame, threshold: float = 0.45, max_gap: float = 0.6, persist: float = 0.5, near: float = 1.5, sure: float = 1.0, keys: list[str] = KEYS) -> DataFrame:
    """Pickups and placements, one for each finished run of ``persist`` seconds.

    Pickup: the hand was free in the ``near`` seconds before, or nothing was seen then; and the hand
    moves steadily (stability 0.5, under 800 a second) or the run lasts ``sure`` seconds. Placement:
    the hand is free in the ``near`` seconds after. Confidence: 0.7 of the mean probability plus
    0.3 of the stability, or 0.8 of the mean probability.
    """
    runs = _around(contact_runs(observations, threshold, max_gap, keys), observations, threshold, near, keys).where(F.col("end") - F.col("start") >= persist)
    steady = (F.col("stability") >= 0.5) & (F.col("mean_speed") < 800) | (F.col("end") - F.col("start") >= sure)
    picked = runs.where((F.col("free_before") | ~F.col("seen_before")) & steady).withColumn("kind", F.lit("pickup"))
    placed = runs.where("free_after").withColumn("kind", F.lit("placement"))
    sure_of = F.least(F.lit(1.0), 0.7 * F.col("mean_probability") + 0.3 * F.col("stability"))
    out = picked.withColumn("confidence", sure_of).unionByName(placed.withColumn("confidence", 0.8 * F.col("mean_probability")))
    return out.select(*keys, "run", "kind", "start", "end", "n", "confidence")


def without_overlaps(candidates: DataFrame, keys: list[str], most: float = 0.5) -> DataFrame:
    """In order of ``start, end``, drop a candidate that overlaps a kept one of its keys (track and
    kind) by more than ``most`` seconds: a fold over the sorted array."""
    grouped = candidates.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", *[c for c in candidates.columns if c not in (*keys, "start", "end")]))).alias("c"))
    shared = lambda a, b: F.least(a.getField("end"), b.getField("end")) - F.greatest(a.getField("start"), b.getField("start"))
    kept = F.aggregate(
        F.col("c"), F.filter("c", lambda x: F.lit(False)),
        lambda acc, x: F.when(F.exists(acc, lambda k: shared(k, x) > most), acc).otherwise(F.concat(acc, F.array(x))))
    return grouped.select(*keys, F.inline(kept))
