"""Regions round persons, joints, hand contact and confirmation scores, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions import geometry as G

# Width and height of a region in units of the scaled person box, and how far its middle is
# lowered in heights of the person.
REGIONS = {"expanded": (1.0, 1.0, 0.0), "lower": (1.0, 0.75, 0.25), "interaction": (1.4, 0.9, 0.0), "scene": (1.8, 1.4, 0.1)}
#: Joints by their index in the keypoint array.
JOINTS = {"left_shoulder": 5, "right_shoulder": 6, "left_elbow": 7, "right_elbow": 8, "left_wrist": 9, "right_wrist": 10, "left_hip": 11, "right_hip": 12}
SIDES = ("left", "right")
#: Weights of the confirmation features by mode.
MODES = {
    "localized_motion": {"motion": 1.0}, "relative_motion": {"coupling": 1.0}, "appearance_change": {"appearance": 1.0}, "separation": {"separation": 1.0},
    "best_two": {"appearance": 0.40, "separation": 0.60}, "best_three": {"motion": 0.25, "appearance": 0.35, "separation": 0.40},
    "all": {"motion": 0.20, "coupling": 0.15, "appearance": 0.25, "persistence": 0.15, "separation": 0.25},
}
CONFIRMED, WEAK = 0.45, 0.30


def search_region(b: G.Box, strategy: str, factor: float = 1.5) -> G.Box:
    """Where to look for objects near a person, before it is cut to the frame (``geometry.inside_frame``)."""
    wide, high, low = REGIONS[strategy]
    (cx, cy), h = G.centre(b), b[3] - b[1]
    half = (b[2] - b[0]) * (factor * wide / 2), h * (factor * high / 2)
    cy = cy + low * h
    return cx - half[0], cy - half[1], cx + half[0], cy + half[1]


def crop_region(b: G.Box) -> G.Box:
    """Twice the person's width and 1.6 heights, 64 pixels at least."""
    (cx, cy), rx, ry = G.centre(b), F.greatest(F.lit(32.0), b[2] - b[0]), F.greatest(F.lit(32.0), 0.8 * (b[3] - b[1]))
    return cx - rx, cy - ry, cx + rx, cy + ry


def joints(keypoints: Column, dx: Column, dy: Column) -> Column:
    """A struct of named joints (x, y, conf) of an ``array<array<double>>``, shifted by a crop's offset; null
    where the array is too short."""
    at = lambda i: F.get(keypoints, F.lit(i))
    one = lambda i: F.when(at(i).isNotNull(), F.struct((F.get(at(i), F.lit(0)) + dx).alias("x"), (F.get(at(i), F.lit(1)) + dy).alias("y"), F.get(at(i), F.lit(2)).alias("conf")))
    return F.struct(*[one(i).alias(name) for name, i in JOINTS.items()])


def _square(x: Column, y: Column, radius: Column) -> Column:
    low = lambda v: F.greatest(F.lit(0), (v - radius).cast("int"))
    return F.array(low(x), low(y), (x + radius).cast("int"), (y + radius).cast("int"))


def hand_states(people: DataFrame, least: float = 0.30) -> DataFrame:
    """Both hands of each row of ``people(..., y1, y2, joints, contrast)``: a row for each hand whose wrist
    is seen with confidence ``least``. ``contrast``: struct of the patch's deviation by side, or null.

    A hand outside the zone from chest to knees only shows a hand; near the body it is near an
    interaction; reaching out, its contact probability is 0.35 of the wrist's confidence, 0.35 of
    the reach and 0.30 of the contrast. Reach is the distance from the hip, else from the shoulder,
    in heights, with a bonus for a bent elbow.
    """
    part = lambda side, name: F.col("joints").getField(f"{side}_{name}").alias(name)
    deviation = lambda side: (F.col("contrast").getField(side) if "contrast" in people.columns else F.lit(None)).cast("double").alias("deviation")
    hands = F.array(*[F.struct(F.lit(s).alias("side"), *[part(s, n) for n in ("wrist", "elbow", "shoulder", "hip")], deviation(s)) for s in SIDES])
    rows = people.withColumn("hand", F.explode(hands)).where(F.col("hand.wrist.conf") >= least)
    far = lambda a, b: F.hypot(F.col(f"hand.{a}.x") - F.col(f"hand.{b}.x"), F.col(f"hand.{a}.y") - F.col(f"hand.{b}.y"))
    seen = lambda name: F.coalesce(F.col(f"hand.{name}.conf") >= 0.2, F.lit(False))
    high = F.greatest(F.lit(1.0), F.col("y2") - F.col("y1"))
    unit = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    arm = F.when(seen("shoulder"), far("wrist", "shoulder") / high).otherwise(F.lit(0.0))
    reach = F.when(seen("hip"), unit((far("wrist", "hip") / high - 0.10) / 0.35)).when(arm > 0.25, F.least(F.lit(1.0), arm / 0.50)).otherwise(F.lit(0.0))
    bones = far("shoulder", "elbow") + far("elbow", "wrist")
    bent = F.when(seen("elbow") & seen("shoulder") & (bones > 1e-3), 1 - far("wrist", "shoulder") / bones)
    rows = rows.withColumn("high", high).withColumn("reach", reach).withColumn("bent", bent)
    rows = rows.withColumn("reach", F.when(F.col("bent").isNotNull(), F.least(F.lit(1.0), F.col("reach") + 0.3 * F.col("bent"))).otherwise(F.col("reach")))
    rows = rows.withColumn("rel_y", (F.col("hand.wrist.y") - F.col("y1")) / F.col("high")).withColumn("patch", F.when(F.col("hand.deviation").isNull(), 0.5).otherwise(F.least(F.lit(1.0), F.col("hand.deviation") / 40)))
    conf, zone, close = F.col("hand.wrist.conf"), F.col("rel_y").between(0.35, 0.88), F.col("reach") < 0.25
    chance = F.when(~zone, 0.15 * conf).when(close, 0.25 * conf + 0.10 * F.col("patch")).otherwise(0.35 * conf + 0.35 * F.col("reach") + 0.30 * F.col("patch"))
    rows = rows.withColumn("probability", chance)
    level = F.when(~zone, "HAND_DETECTED").when(~close & (F.col("probability") >= 0.45), "CONTACT").otherwise("NEAR_INTERACTION")
    radius = lambda share, least: F.greatest(F.lit(least), (share * F.col("high")).cast("int"))
    x, y = F.col("hand.wrist.x"), F.col("hand.wrist.y")
    return rows.select(
        *[c for c in people.columns if c not in ("joints", "contrast")], F.col("hand.side").alias("side"), x.alias("wrist_x"), y.alias("wrist_y"), conf.alias("wrist_conf"), "rel_y", "reach", "patch",
        "probability", level.alias("level"), _square(x, y, radius(0.08, 6)).alias("hand_box"), _square(x, y, radius(0.14, 10)).alias("region"))


def confirmation_features(candidates: DataFrame, observations: DataFrame, after: DataFrame) -> DataFrame:
    """Five scores between 0 and 1 for each candidate: ``motion, coupling, appearance, persistence,
    separation``, and ``seen``, its number of observations.

    ``candidates(candidate, person_height, delta)``, ``delta``: mean difference of the site's patch before
    and after, null if not measured. ``observations(candidate, t, hand_box, region, inner, body)`` with
    the mean differences of the interaction's and the body's pixels (null at the first). ``after(candidate,
    hand_box)``: hands after its end. Without two observations coupling and persistence are 0.5.
    """
    unit = lambda v: F.when(v.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)))
    w = W.partitionBy("candidate").orderBy("t")
    hx, hy = G.centre(G.box_of(F.col("hand_box")))
    rows = observations.withColumn("hx", hx).withColumn("hy", hy).withColumn("dt", F.greatest(F.lit(0.001), F.col("t") - F.lag("t").over(w)))
    rows = rows.withColumn("dt", F.when(F.lag("t").over(w).isNotNull(), F.col("dt")))
    for c in ("hx", "hy"):
        rows = rows.withColumn(f"v{c}", (F.col(c) - F.lag(c).over(w)) / F.col("dt"))
    turn = F.hypot(F.col("vhx") - F.lag("vhx").over(w), F.col("vhy") - F.lag("vhy").over(w)) / F.col("dt")
    rows = rows.withColumn("turn", turn).withColumn("overlap", F.when(F.col("dt").isNotNull(), G.iou(tuple(F.lag(b).over(w) for b in G.box_of(F.col("region"))), G.box_of(F.col("region")), "area_one")))
    per = rows.groupBy("candidate").agg(
        F.count("*").alias("seen"), F.coalesce(F.avg("inner"), F.lit(0.0)).alias("inner"), F.coalesce(F.avg("body"), F.lit(0.0)).alias("body"), F.avg(F.hypot("vhx", "vhy")).alias("speed"),
        F.coalesce(F.avg("turn"), F.lit(0.0)).alias("turn"), F.avg("overlap").alias("overlap"), F.max_by("hand_box", "t").alias("last"))
    lx, ly = G.centre(G.box_of(F.col("last")))
    ax, ay = G.centre(G.box_of(F.col("hand_box")))
    gone = after.join(per.select("candidate", "last"), "candidate").groupBy("candidate").agg(F.max(F.hypot(ax - lx, ay - ly)).alias("gone"))
    joined = candidates.join(per, "candidate", "left").join(gone, "candidate", "left")
    # The scales of the five features.
    motion = F.when(F.col("body") > 35, F.greatest(F.lit(0.0), 0.6 - (F.col("body") - 35) / 50)).otherwise(unit((F.col("inner") / F.greatest(F.lit(1e-3), F.col("body")) - 0.5) / 1.5))
    steady = F.greatest(F.lit(0.0), 1 - F.col("turn") / 600)
    slow = F.when(F.col("speed") < 600, F.lit(1.0)).when(F.col("speed") >= 600, F.greatest(F.lit(0.0), 1 - (F.col("speed") - 600) / 400))
    return joined.select(
        "candidate", F.coalesce("seen", F.lit(0)).alias("seen"), motion.alias("motion"), F.coalesce(unit(steady * slow), F.lit(0.5)).alias("coupling"),
        F.coalesce(unit((F.col("delta") - 2) / 20), F.lit(0.4)).alias("appearance"), F.coalesce(unit(F.col("overlap") / 0.70), F.lit(0.5)).alias("persistence"),
        F.coalesce(unit((F.col("gone") / F.greatest(F.lit(1.0), F.col("person_height")) - 0.08) / 0.25), F.lit(0.45)).alias("separation"))


def gate(features: DataFrame, confidence: Column | None = None) -> DataFrame:
    """Score and status of each candidate under every mode: ``candidate, mode, score, status``.
    ``baseline`` passes all through with their own ``confidence``; without observations a
    candidate is rejected."""
    score = lambda weights: sum((w * F.coalesce(F.col(c), F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    modes = [F.struct(F.lit(m).alias("mode"), F.when(F.col("seen") > 0, score(weights)).otherwise(F.lit(0.0)).alias("score")) for m, weights in MODES.items()]
    if confidence is not None:
        modes.append(F.struct(F.lit("baseline").alias("mode"), confidence.cast("double").alias("score")))
    rows = features.select("candidate", "seen", F.explode(F.array(*modes)).alias("m")).select("candidate", "seen", "m.mode", "m.score")
    status = F.when(F.col("mode") == "baseline", "CONFIRMED").when(F.col("seen") == 0, "REJECTED").when(F.col("score") >= CONFIRMED, "CONFIRMED").when(F.col("score") >= WEAK, "WEAK").otherwise("REJECTED")
    return rows.select("candidate", "mode", "score", status.alias("status"))


def coupling(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """How an object moves with a person: ``pairs(keys, t, o_x1..o_y2, p_x1..p_y2)``, an aligned pair a row.
    Returns mean, first and last distance in person heights, approach, separation, first and last
    speed of the object, and ``coupled``: near on average, some step with agreeing directions
    (cosine .7) and some with a residual of .4 at most."""
    w = W.partitionBy(*keys).orderBy("t")
    (ox, oy), (px, py) = G.centre(G.box("o_")), G.centre(G.box("p_"))
    scale = F.greatest(F.lit(1.0), F.col("p_y2") - F.col("p_y1"))
    rows = pairs.select(*keys, "t", ox.alias("ox"), oy.alias("oy"), px.alias("px"), py.alias("py"), scale.alias("scale")).withColumn("far", F.hypot(F.col("ox") - F.col("px"), F.col("oy") - F.col("py")) / F.col("scale"))
    dt = F.greatest(F.lit(0.01), F.lead("t").over(w) - F.col("t"))
    rows = rows.withColumn("dt", F.when(F.lead("t").over(w).isNotNull() & (dt <= 1.5), dt))
    for c in ("ox", "oy", "px", "py"):
        rows = rows.withColumn(f"d{c}", F.when(F.col("dt").isNotNull(), F.lead(c).over(w) - F.col(c)))
    own, theirs = F.hypot("dox", "doy"), F.hypot("dpx", "dpy")
    rows = rows.withColumn("speed", own / F.col("scale") / F.col("dt")).withColumn("residual", F.hypot(F.col("dox") - F.col("dpx"), F.col("doy") - F.col("dpy")) / F.greatest(own, theirs, F.lit(1.0)))
    rows = rows.withColumn("cosine", (F.col("dox") * F.col("dpx") + F.col("doy") * F.col("dpy")) / F.greatest(own * theirs, F.lit(1e-9)))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("t")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("t")))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("pairs"), F.avg("far").alias("mean_distance"), first("far").alias("first_distance"), last("far").alias("last_distance"), first("speed").alias("first_speed"),
        last("speed").alias("last_speed"), F.max("cosine").alias("cosine"), F.min("residual").alias("residual"))
    change = F.col("first_distance") - F.col("last_distance")
    coupled = (F.col("mean_distance") <= 1.5) & F.coalesce((F.col("cosine") >= 0.7) & (F.col("residual") <= 0.4), F.lit(False))
    return out.withColumn("approach", F.greatest(F.lit(0.0), change)).withColumn("separation", F.greatest(F.lit(0.0), -change)).withColumn("coupled", coupled)


def pickup_verdict(stable: Column) -> Column:
    """Why a ``coupling`` row is or isn't a pickup."""
    return (
        F.when(~stable, "tracklet_not_stable").when(F.col("pairs") < 2, "insufficient_aligned_samples").when(F.col("first_speed") > 0.4, "object_not_initially_stationary")
        .when((F.col("mean_distance") > 1.5) & (F.col("approach") < 0.2), "no_approach_evidence").when(~F.col("coupled"), "no_coupled_motion").otherwise("pickup_verified"))


def placement_verdict(stable: Column) -> Column:
    """Why a ``coupling`` row is or isn't a placement."""
    return (
        F.when(~stable, "tracklet_not_stable").when(F.col("pairs") < 2, "insufficient_aligned_samples").when(F.col("first_distance") > 1.5, "not_initially_close")
        .when((F.col("separation") < 0.3) & (F.col("last_distance") < 1.8), "no_separation_evidence").when(F.col("last_speed") > 0.25, "object_not_stationary_after_placement").otherwise("placement_verified"))
