"""Hands and regions, persons with objects, actors against tracks, matching in space."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import geometry as G
from trackloom.functions import hands as H
from trackloom.operators import diagnostics as D
from trackloom.operators import linking as L
from trackloom.operators import motion as M
from trackloom.queries.tracks import _TRACE, GAP
from trackloom.sources.tables import SAMPLES, samples, table

_B = ["x1", "y1", "x2", "y2"]


def framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample of each track and day: its first; three videos of all kinds of tracks."""
    rows = samples(spark, sf_dir).withColumn("frame", F.floor(F.col("t") / 24).cast("int")).withColumn("video_id", F.concat(F.lit("V"), (F.col("track") % 3).cast("string")))
    first = rows.groupBy("video_id", "track", "frame").agg(F.min(F.struct("t", "object_type", *_B)).alias("m"))
    return first.select("video_id", "track", "frame", "m.*")


_FRAMED = f"""{SAMPLES}, fr as (select 'V' || (track % 3)::varchar as video_id, track, floor(t / 24)::int as frame, min(t) as t, arg_min(object_type, t) as object_type, arg_min(x1, t) as x1, arg_min(y1, t) as y1, arg_min(x2, t) as x2, arg_min(y2, t) as y2 from samples group by 1, 2, 3)"""


def _iou(a: str, b: str, kind: str = "floor") -> str:
    """SQL of the IoU of two rows' boxes."""
    shared = f"greatest(0, least({a}x2, {b}x2) - greatest({a}x1, {b}x1)) * greatest(0, least({a}y2, {b}y2) - greatest({a}y1, {b}y1))"
    return f"({shared}) / greatest(1.0::double, ({a}x2 - {a}x1) * ({a}y2 - {a}y1) + ({b}x2 - {b}x1) * ({b}y2 - {b}y1) - ({shared}))"


def search_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, high = F.lit(60), F.lit(50)
    kinds = {"lower": H.search_region(G.box(), "lower"), "interaction": H.search_region(G.box(), "interaction", 1.2), "scene": H.search_region(G.box(), "scene"), "expanded": H.search_region(G.box(), "expanded", 1.25), "crop": H.crop_region(G.box())}
    cut = [F.array(*G.inside_frame(r, wide, high)).alias(k) for k, r in kinds.items()]
    return samples(spark, sf_dir).select("video_id", "track", F.round("t", 6).alias("t"), *[F.array_join(c.cast("array<string>"), " ").alias(k) for k, c in ((k, c) for k, c in zip(kinds, cut, strict=True))])


def _keypoints() -> F.Column:
    i = F.sequence(F.lit(0), F.lit(16))
    return F.transform(i, lambda k: F.array(F.col("value") + k * 3, F.col("value") / 2 + (k * 7 + F.col("event_id")) % 40, (F.col("event_id") + k) % 10 / 10.0))


def hand_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "events").select(
        "event_id", (F.col("value") / 2).alias("y1"), (F.col("value") / 2 + 40).alias("y2"), H.joints(_keypoints(), F.lit(5.0), F.lit(2.013)).alias("joints"),
        F.struct((F.col("value") % 50).alias("left"), F.when(F.col("event_id") % 3 > 0, F.col("value") % 30).alias("right")).alias("contrast"))
    found = H.hand_states(people)
    return found.select("event_id", "side", "level", *[F.round(c, 6).alias(c) for c in ("rel_y", "reach", "patch", "probability")], F.array_join(F.col("region").cast("array<string>"), " ").alias("region"))


def _square(v: str, r: str) -> str:
    return f"array[{v} - {r}, {v} / 2 - {r}, {v} + {r}, {v} / 2 + {r}]"


def _candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Users as candidates, their events in order as observations (the purchases as hands after the end)."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("candidate"), (F.unix_micros(F.col("ts").cast("timestamp")) / 3600e6).alias("t"), F.col("value").alias("v"), "event_type")
    square = lambda r: F.array(F.col("v") - r, F.col("v") / 2 - r, F.col("v") + r, F.col("v") / 2 + r)
    seen = e.where("event_type <> 'purchase'").select("candidate", "t", square(8.0).alias("hand_box"), square(14.0).alias("region"), (F.col("v") % 20).alias("inner"), (F.col("v") % 45).alias("body"))
    after = e.where("event_type = 'purchase'").select("candidate", square(8.0).alias("hand_box"))
    own = e.select("candidate").distinct().withColumn("person_height", 40.0 + F.col("candidate") % 30).withColumn("delta", F.when(F.col("candidate") % 4 > 0, (F.col("candidate") % 25).cast("double")))
    return own, seen, after


def confirmation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.confirmation_features(*_candidates(spark, sf_dir)).select("candidate", "seen", *[F.round(c, 6).alias(c) for c in ("motion", "coupling", "appearance", "persistence", "separation")])


def confirmation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = H.gate(H.confirmation_features(*_candidates(spark, sf_dir)), F.lit(0.5))
    return found.groupBy("mode", "status").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("score"))


def object_couplings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each track with a person that follows it half as fast."""
    s = samples(spark, sf_dir)
    pairs = s.select("video_id", "track", "t", *[F.col(c).alias(f"o_{c}") for c in _B], (F.col("x1") * 0.7).alias("p_x1"), F.col("y1").alias("p_y1"), (F.col("x1") * 0.7 + 10).alias("p_x2"), (F.col("y1") + 30).alias("p_y2"))
    found = H.coupling(pairs, ["video_id", "track"])
    stable = F.col("pairs") >= 3
    return found.select("video_id", "track", "pairs", "coupled", *[F.round(c, 6).alias(c) for c in ("mean_distance", "approach", "separation", "first_speed", "last_speed")],
                        H.pickup_verdict(stable).alias("pickup"), H.placement_verdict(stable).alias("placement"))


def person_object_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = framed(spark, sf_dir)
    found = D.person_pairs(rows.where("object_type = 'bag'"), rows.where("object_type = 'person'").withColumnRenamed("track", "person"), max_gap=48.0)
    return found.select("video_id", "track", "person", "samples", *[F.round(c, 6).alias(c) for c in ("mean_distance", "median_distance", "relative_speed", "residual", "approach", "separation")])


def object_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = framed(spark, sf_dir)
    bags = rows.where("object_type = 'bag'")
    pairs = D.nearest_persons(bags, rows.where("object_type = 'person'").withColumnRenamed("track", "person"))
    kind = F.when(F.col("track") % 3 == 0, "backpack").otherwise("chair")
    return D.supported_tracks(bags.withColumn("kind", kind), D.owners(pairs, bags, 0.05))


def _actors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every track's middle frames as a label of one actor whose annotated boxes are the track's, moved."""
    rows = framed(spark, sf_dir)
    spans = rows.groupBy("video_id", "track").agg(F.min("frame").alias("a"), F.max("frame").alias("b"), F.min_by("object_type", "frame").alias("kind"))
    quarter = ((F.col("b") - F.col("a")) / 4).cast("int")
    actors = spans.select("video_id", F.col("track").alias("label"), F.col("track").alias("actor"), F.when(F.col("kind") == "car", "vehicle").when(F.col("kind") == "bag", "other").otherwise("person").alias("actor_type"),
                          (F.col("a") + quarter).alias("start_frame"), (F.col("b") - quarter).alias("end_frame"))
    move = F.col("track") % 7 * 2.0
    geometry = rows.select("video_id", F.col("track").alias("actor"), "frame", (F.col("x1") + move).alias("x1"), "y1", (F.col("x2") + move).alias("x2"), "y2")
    return actors, geometry, rows


def actor_coverages(spark: SparkSession, sf_dir: str) -> DataFrame:
    actors, geometry, rows = _actors(spark, sf_dir)
    hits = D.actor_hits(actors, geometry, rows, F.lit(4))
    out = D.actor_coverage(actors, hits, F.lit(1.0), 1.0)
    return out.select("label", "detected", "during", F.col("frames").cast("long"), F.col("fragments").cast("long"), F.col("longest").cast("long"), F.round("coverage", 6).alias("coverage"), F.array_join(F.col("tracks").cast("array<string>"), ",").alias("tracks"))


def actor_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    actors, geometry, rows = _actors(spark, sf_dir)
    return D.actor_tracks(D.actor_hits(actors, geometry, rows, F.lit(4)))


def same_actor_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    actors, geometry, rows = _actors(spark, sf_dir)
    covered = D.actor_coverage(actors, D.actor_hits(actors, geometry, rows, F.lit(4)), F.lit(1.0), 1.0)
    labels = actors.select("label", "video_id", F.lit("e").alias("event_type"), F.col("start_frame").alias("start"), F.col("end_frame").alias("end"))
    spans = rows.groupBy("video_id", "track").agg(F.min("frame").alias("start"), (F.min("frame") + 12).alias("end"))
    predictions = spans.select("video_id", F.lit("e").alias("event_type"), F.col("track").alias("prediction"), F.array("track").alias("track_ids"), "start", "end")
    found = D.same_actor_events(labels, covered, predictions)
    return found.select("label", F.array_join(F.col("predictions").cast("array<string>"), ",").alias("predictions"))


def spatial_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label with the predictions of its own track and of the next one of its video."""
    actors, geometry, rows = _actors(spark, sf_dir)
    activity = F.when(F.col("label") % 3 == 0, "person_picks_up_object").when(F.col("actor_type") == "vehicle", "vehicle_stops").otherwise("person_stands")
    made = actors.select("label", F.explode(F.array(F.col("label"), F.col("label") + 3)).alias("prediction"), activity.alias("activity"), F.col("start_frame").cast("double").alias("start"), F.col("end_frame").cast("double").alias("end"))
    boxes = rows.withColumnRenamed("track", "prediction").select("prediction", "object_type", "frame", "t", *_B)
    boxes = boxes.withColumn("t", F.col("frame").cast("double"))
    scores = D.spatial_scores(made, boxes, actors.select("label", "actor", "actor_type"), geometry, 2.0)
    kinds = rows.groupBy(F.col("track").alias("prediction")).agg(F.array_distinct(F.array(F.min_by("object_type", "frame"), F.lit("person"))).alias("entity_types"))
    found = D.matching_pairs(made.join(kinds, "prediction"), scores, 0.1)
    return found.select("label", "prediction", "activity", F.round("spatial", 6).alias("spatial"))


def label_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as labels, samples' types as detections."""
    label = F.element_at(F.array(*map(F.lit, ("person", "vehicle", "bag", "unknown_object", "phone", "other"))), (F.col("user_id") % 6 + 1).cast("int"))
    seen = F.element_at(F.array(*map(F.lit, ("person", "car", "backpack", "cell phone", "chair", "truck", "bicycle"))), (F.col("event_id") % 7 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(label.alias("label"), seen.alias("detected"))
    return rows.groupBy("label", "detected").agg(F.count("*").alias("n"), F.bool_and(D.label_compatible(F.col("label"), F.col("detected"))).alias("as_label"), F.bool_and(D.actor_compatible(F.col("label"), F.col("detected"))).alias("as_actor"))


def case_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    actors, geometry, rows = _actors(spark, sf_dir)
    cases = geometry.where("actor % 5 = 0").withColumnRenamed("actor", "case_id")
    found = D.case_evidence(cases, rows)
    return found.select("case_id", "frames", F.round("best", 6).alias("best"), "touched", "good", "tracks", "longest")


def tracklet_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' parts as tracklets that hit orders."""
    line = table(spark, sf_dir, "lineitem")
    sizes = line.groupBy(F.col("l_suppkey").alias("track")).agg((F.count("*") % 3).alias("boxes"))
    owned = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("track"), F.col("s_nationkey").alias("person"))
    actors = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.array((F.col("o_custkey") % 25), F.lit(3)).alias("persons"))
    return D.tracklet_hits(line.select(F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("track")), sizes, owned, actors)


def type_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    k, p = F.col("l_orderkey"), F.col("l_partkey")
    labels = line.select(F.col("l_linenumber").cast("string").alias("activity"), F.col("l_returnflag").alias("event_type"), (k % 3 == 0).alias("matched"), ((k % 3 == 0) | (p % 2 == 0)).alias("detected"), (p % 5 == 0).alias("related"),
                         F.col("l_tax").alias("tiou"), F.col("l_quantity").alias("start_error"), F.col("l_discount").alias("end_error"), F.when(p % 4 == 0, p % 5).alias("rank"))
    out = D.type_diagnosis(labels, table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "O", "R").otherwise("A").alias("event_type")))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def search_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("rank"))
    results = line.select((F.col("l_orderkey") % 7).alias("camera_id"), F.col("l_orderkey").alias("activity"), F.col("l_suppkey").alias("event_id"), "rank")
    matches = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("label"), (F.col("o_custkey") % 100).alias("event_id"), (F.col("o_orderkey") % 7).alias("camera_id"), F.col("o_orderkey").alias("activity"))
    return D.search_ranks(matches, results, 3)


def track_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).withColumn("confidence", F.when(F.col("x1") > 20, F.col("x1")))
    out = L.track_summary(rows, ["video_id", "track"], 24.0, 3)
    return out.select("video_id", "track", "samples", "gaps", "persistent", *[F.round(c, 6).alias(c) for c in ("start", "end", "duration", "confidence")])


def trace_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = M.state_trace(M.valid_tracks(samples(spark, sf_dir), GAP), unknown_gap=20.0, change=0.02)
    labels = trace.groupBy("video_id", "key").agg((F.min("t") + 20).alias("start"), (F.min("t") + 120).alias("end"))
    out = M.trace_metrics(trace, labels, ["video_id", "key"])
    return out.select("video_id", "key", "samples", "inside", *[F.round(c, 6).alias(c) for c in ("median_speed", "max_speed", "speed_before", "first_half", "second_half", "max_acceleration", "min_acceleration", "still_before", "longest_gap")])


QUERIES = {f.__name__: f for f in (
    search_regions, hand_contacts, confirmation_scores, confirmation_gate, object_couplings, person_object_pairs, object_owners, actor_coverages, actor_fragments, same_actor_predictions, spatial_matches,
    label_classes, case_evidence, tracklet_hits, type_diagnosis, search_ranks, track_summaries, trace_metrics)}


def _cut(x1: str, y1: str, x2: str, y2: str) -> str:
    part = lambda v, top: f"least({top}, greatest(0, trunc({v})::int))"
    return f"concat_ws(' ', {part(x1, 60)}, {part(y1, 50)}, {part(x2, 60)}, {part(y2, 50)})"


def _around(w: str, h: str, low: str = "0") -> str:
    cx, cy = "(x1 + x2) / 2", f"((y1 + y2) / 2 + {low} * (y2 - y1))"
    return _cut(f"{cx} - {w} / 2", f"{cy} - {h} / 2", f"{cx} + {w} / 2", f"{cy} + {h} / 2")


_W, _HT = "(x2 - x1)", "(y2 - y1)"
_HANDS = """k as (select event_id, value as v, side, 11 - side as s0, value % 50 as dl, case when event_id % 3 > 0 then value % 30 end as dr from events, (select unnest([1, 2]) as side)),
    j as (select *, 8 + side as w, 6 + side as e, 4 + side as s, 10 + side as h from k),
    xy as (select *, v + w * 3 + 5 as wx, v / 2 + (w * 7 + event_id) % 40 + 2.013::double as wy, (event_id + w) % 10 / 10.0::double as wc, v + e * 3 + 5 as ex, v / 2 + (e * 7 + event_id) % 40 + 2.013::double as ey, (event_id + e) % 10 / 10.0::double as ec,
        v + s * 3 + 5 as sx, v / 2 + (s * 7 + event_id) % 40 + 2.013::double as sy, (event_id + s) % 10 / 10.0::double as sc, v + h * 3 + 5 as hx, v / 2 + (h * 7 + event_id) % 40 + 2.013::double as hy, (event_id + h) % 10 / 10.0::double as hc from j),
    r as (select *, sqrt(pow(wx - sx, 2) + pow(wy - sy, 2)) as ws, sqrt(pow(wx - hx, 2) + pow(wy - hy, 2)) as wh, sqrt(pow(sx - ex, 2) + pow(sy - ey, 2)) + sqrt(pow(ex - wx, 2) + pow(ey - wy, 2)) as bones from xy where wc >= 0.3),
    a as (select *, case when hc >= 0.2 then least(1, greatest(0, (wh / 40 - 0.10::double) / 0.35::double)) when sc >= 0.2 and ws / 40 > 0.25 then least(1, ws / 40 / 0.5::double) else 0 end as r0 from r),
    c as (select *, case when ec >= 0.2 and sc >= 0.2 and bones > 1e-3 then least(1, r0 + 0.3::double * (1 - ws / bones)) else r0 end as reach, (wy - v / 2) / 40 as rel, case when case when side = 1 then dl else dr end is null then 0.5::double else least(1, case when side = 1 then dl else dr end / 40) end as patch from a),
    d as (select *, case when rel not between 0.35 and 0.88 then 0.15::double * wc when reach < 0.25 then 0.25::double * wc + 0.10::double * patch else 0.35::double * wc + 0.35::double * reach + 0.30::double * patch end as p from c)"""
_CONF = f"""o as (select user_id as candidate, epoch_us(ts)::double / 3600e6::double as t, value as v from events where event_type <> 'purchase'),
    m as (select *, lag(v) over w as pv, greatest(0.001, t - lag(t) over w) as dt, lag(t) over w is not null as two from o window w as (partition by candidate order by t)),
    n as (select *, case when two then (v - pv) / dt end as vx, case when two then (v / 2 - pv / 2) / dt end as vy from m),
    q as (select *, case when two then sqrt(pow(vx - lag(vx) over w, 2) + pow(vy - lag(vy) over w, 2)) / dt end as turn,
        case when two then (greatest(0, 28 - abs(v - pv)) * greatest(0, 28 - abs(v - pv) / 2)) / (2 * 784 - greatest(0, 28 - abs(v - pv)) * greatest(0, 28 - abs(v - pv) / 2)) end as ov from n window w as (partition by candidate order by t)),
    per as (select candidate, count(*) as seen, avg(v % 20) as im, avg(v % 45) as bm, avg(sqrt(vx * vx + vy * vy)) as sp, coalesce(avg(turn), 0) as turn, avg(ov) as ov, arg_max(v, t) as lv from q group by 1),
    gone as (select user_id as candidate, max(sqrt(pow(value - lv, 2) + pow(value / 2 - lv / 2, 2))) as gone from events join per on candidate = user_id where event_type = 'purchase' group by 1),
    f as (select u.candidate, coalesce(seen, 0) as seen, case when bm > 35 then greatest(0, 0.6::double - (bm - 35) / 50) else least(1, greatest(0, (im / greatest(0.001, bm) - 0.5::double) / 1.5::double)) end as motion,
        case when sp is null then 0.5::double else least(1, greatest(0, greatest(0, 1 - turn / 600) * case when sp < 600 then 1 else greatest(0, 1 - (sp - 600) / 400) end)) end as coupling,
        coalesce(case when u.candidate % 4 > 0 then least(1, greatest(0, (u.candidate % 25 - 2) / 20.0::double)) end, 0.4::double) as appearance, case when ov is null then 0.5::double else least(1, greatest(0, ov / 0.7::double)) end as persistence,
        case when gone is null then 0.45::double else least(1, greatest(0, (gone / (40 + u.candidate % 30) - 0.08::double) / 0.25::double)) end as separation
        from (select distinct user_id as candidate from events) u left join per using (candidate) left join gone using (candidate))"""
_COUP = f"""{SAMPLES}, c as (select video_id, track, t, x1 + 10 as ox, y1 + 20 as oy, x1 * 0.7::double + 5 as px, y1 + 15 as py from samples),
    s as (select *, sqrt(pow(ox - px, 2) + pow(oy - py, 2)) / 30 as far, case when greatest(0.01, lead(t) over w - t) <= 1.5 and lead(t) over w is not null then greatest(0.01, lead(t) over w - t) end as dt,
        lead(ox) over w - ox as dx, lead(oy) over w - oy as dy, lead(px) over w - px as ex, lead(py) over w - py as ey from c window w as (partition by video_id, track order by t)),
    z as (select *, case when dt is not null then sqrt(dx * dx + dy * dy) / 30 / dt end as speed, case when dt is not null then sqrt(pow(dx - ex, 2) + pow(dy - ey, 2)) / greatest(sqrt(dx * dx + dy * dy), sqrt(ex * ex + ey * ey), 1) end as residual,
        case when dt is not null then (dx * ex + dy * ey) / greatest(sqrt(dx * dx + dy * dy) * sqrt(ex * ex + ey * ey), 1e-9::double) end as cosine from s),
    g as (select video_id, track, count(*) as pairs, avg(far) as md, arg_min(far, t) as fd, arg_max(far, t) as ld, arg_min(speed, t) filter (speed is not null) as fs, arg_max(speed, t) filter (speed is not null) as ls, max(cosine) as cs, min(residual) as rs from z group by 1, 2),
    h as (select *, greatest(0, fd - ld) as ap, greatest(0, ld - fd) as sep, md <= 1.5 and coalesce(cs >= 0.7 and rs <= 0.4, false) as coupled from g)"""
_PAIRS = f"""{_FRAMED}, n as (select o.video_id, o.track, p.track as person, o.t, sqrt(pow((o.x1 + o.x2) / 2 - (p.x1 + p.x2) / 2, 2) + pow((o.y1 + o.y2) / 2 - (p.y1 + p.y2) / 2, 2)) / greatest(1, p.y2 - p.y1) as far,
        (o.x1 + o.x2) / 2 as ox, (o.y1 + o.y2) / 2 as oy, (p.x1 + p.x2) / 2 as px, (p.y1 + p.y2) / 2 as py, p.y2 - p.y1 as high from fr o join fr p on o.video_id = p.video_id and o.frame = p.frame and o.object_type = 'bag' and p.object_type = 'person'),
    d as (select *, ox - lag(ox) over w as dox, oy - lag(oy) over w as doy, px - lag(px) over w as dpx, py - lag(py) over w as dpy, t - lag(t) over w as dt, lag(high) over w as was from n where far <= 1.5 window w as (partition by video_id, track, person order by t)),
    e as (select *, sqrt(pow(dox - dpx, 2) + pow(doy - dpy, 2)) as apart, dt > 0 and dt <= 48 as near from d),
    pp as (select video_id, track, person, count(*) as samples, avg(far) as mean_distance, median(far) as median_distance, median(case when near then apart / greatest(1, was) / dt end) as relative_speed,
        median(case when near then apart / greatest(sqrt(dox * dox + doy * doy), sqrt(dpx * dpx + dpy * dpy), 1) end) as residual, greatest(0, arg_min(far, t) - arg_max(far, t)) as approach, greatest(0, arg_max(far, t) - arg_min(far, t)) as separation
        from e group by 1, 2, 3 having count(*) >= 2)"""
_ACT = f"""{_FRAMED}, sp as (select video_id, track, min(frame) as a, max(frame) as b, arg_min(object_type, frame) as kind from fr group by 1, 2),
    ac as (select video_id, track as label, case kind when 'car' then 'vehicle' when 'bag' then 'other' else 'person' end as actor_type, a + trunc((b - a) / 4.0)::int as sf, b - trunc((b - a) / 4.0)::int as ef from sp),
    ge as (select video_id, track as actor, frame, x1 + track % 7 * 2 as x1, y1, x2 + track % 7 * 2 as x2, y2 from fr),
    hit as (select label, sf, ef, b.track, b.frame, b.frame between sf and ef as inside from ac join ge g on g.video_id = ac.video_id and g.actor = ac.label and g.frame between sf - 4 and ef + 4 join fr b on b.video_id = g.video_id and b.frame = g.frame
        and case actor_type when 'person' then b.object_type = 'person' when 'vehicle' then b.object_type = 'car' else b.object_type = 'bag' end where {_iou("b.", "g.")} >= 0.1),
    tr as (select label, track, min(frame) as first_frame, max(frame) as last_frame, count(*) as samples, count(*) filter (inside) as inside from hit group by 1, 2),
    cov as (select label, count(*) as fragments, max(inside) as longest, list_sort(list(track)) as tracks from tr group by 1), fs as (select label, count(distinct frame) as frames from hit where inside group by 1)"""

ORACLES = {
    "trace_metrics": f"""with {_TRACE}, lb as (select video_id, key, min(t) + 20 as a, min(t) + 120 as b from trace group by 1, 2), j as (select trace.*, a, b, (a + b) / 2 as m, lead(t) over (partition by video_id, key order by t) - t as gap from trace join lb using (video_id, key))
        select video_id, key, count(*) as samples, count(*) filter (t between a and b) as inside, round(median(smooth), 6) as median_speed, round(max(smooth), 6) as max_speed, round(median(smooth) filter (t >= a - 2 and t < a), 6) as speed_before,
          round(median(smooth) filter (t >= a and t <= m), 6) as first_half, round(median(smooth) filter (t > m and t <= b), 6) as second_half, round(max(acceleration), 6) as max_acceleration, round(min(acceleration), 6) as min_acceleration,
          round(coalesce(sum(greatest(0, least(t + dt, a) - greatest(t, a - 4))) filter (state = 'STATIONARY'), 0), 6) as still_before, round(coalesce(max(gap), 0), 6) as longest_gap from j group by video_id, key, a, b""",
    "search_regions": f"""with {SAMPLES} select video_id, track, round(t, 6) as t, {_around(f"({_W} * 1.5::double)", f"({_HT} * 1.125::double)", "0.25::double")} as lower, {_around(f"({_W} * 1.68::double)", f"({_HT} * 1.08::double)")} as interaction,
        {_around(f"({_W} * 2.7::double)", f"({_HT} * 2.1::double)", "0.1::double")} as scene, {_around(f"({_W} * 1.25::double)", f"({_HT} * 1.25::double)")} as expanded,
        {_around(f"(2 * greatest(32.0::double, {_W}))", f"(2 * greatest(32.0::double, 0.8::double * {_HT}))")} as crop from samples""",
    "hand_contacts": f"""with {_HANDS} select event_id, case side when 1 then 'left' else 'right' end as side, case when rel not between 0.35 and 0.88 then 'HAND_DETECTED' when reach >= 0.25 and p >= 0.45 then 'CONTACT' else 'NEAR_INTERACTION' end as level,
        round(rel, 6) as rel_y, round(reach, 6) as reach, round(patch, 6) as patch, round(p, 6) as probability, concat_ws(' ', greatest(0, trunc(wx - 10)::int), greatest(0, trunc(wy - 10)::int), trunc(wx + 10)::int, trunc(wy + 10)::int) as region from d""",
    "confirmation_scores": f"""with {_CONF} select candidate, seen, round(motion, 6) as motion, round(coupling, 6) as coupling, round(appearance, 6) as appearance, round(persistence, 6) as persistence, round(separation, 6) as separation from f""",
    "confirmation_gate": f"""with {_CONF}, w as (select candidate, seen, unnest([{{'mode': 'localized_motion', 's': motion}}, {{'mode': 'relative_motion', 's': coupling}}, {{'mode': 'appearance_change', 's': appearance}}, {{'mode': 'separation', 's': separation}},
          {{'mode': 'best_two', 's': 0.4::double * appearance + 0.6::double * separation}}, {{'mode': 'best_three', 's': 0.25::double * motion + 0.35::double * appearance + 0.4::double * separation}},
          {{'mode': 'all', 's': 0.2::double * motion + 0.15::double * coupling + 0.25::double * appearance + 0.15::double * persistence + 0.25::double * separation}}, {{'mode': 'baseline', 's': 0.5::double}}]) as m from f),
        x as (select m.mode as mode, case when m.mode <> 'baseline' and seen = 0 then 0 else m.s end as score, seen from w)
        select mode, case when mode = 'baseline' or (seen > 0 and score >= 0.45) then 'CONFIRMED' when seen > 0 and score >= 0.3 then 'WEAK' else 'REJECTED' end as status, count(*) as n, round(sum(score), 4) as score from x group by 1, 2""",
    "object_couplings": f"""with {_COUP} select video_id, track, pairs, coupled, round(md, 6) as mean_distance, round(ap, 6) as approach, round(sep, 6) as separation, round(fs, 6) as first_speed, round(ls, 6) as last_speed,
        case when pairs < 3 then 'tracklet_not_stable' when fs > 0.4 then 'object_not_initially_stationary' when md > 1.5 and ap < 0.2 then 'no_approach_evidence' when not coupled then 'no_coupled_motion' else 'pickup_verified' end as pickup,
        case when pairs < 3 then 'tracklet_not_stable' when fd > 1.5 then 'not_initially_close' when sep < 0.3 and ld < 1.8 then 'no_separation_evidence' when ls > 0.25 then 'object_not_stationary_after_placement' else 'placement_verified' end as placement from h""",
    "person_object_pairs": f"""with {_PAIRS} select video_id, track, person, samples, round(mean_distance, 6) as mean_distance, round(median_distance, 6) as median_distance, round(relative_speed, 6) as relative_speed, round(residual, 6) as residual,
        round(approach, 6) as approach, round(separation, 6) as separation from pp""",
    "object_owners": f"""with {_PAIRS}, r as (select *, row_number() over w as rn, lead(mean_distance) over w - mean_distance as m from pp window w as (partition by video_id, track order by mean_distance, person))
        select r.video_id, r.track, 'backpack' as kind, person from r join (select video_id, track from fr where object_type = 'bag' group by 1, 2 having count(*) >= 2) using (video_id, track) where rn = 1 and (m is null or m >= 0.05) and track % 3 = 0""",
    "actor_coverages": f"""with {_ACT} select ac.label, fragments is not null as detected, coalesce(frames, 0) > 0 as during, coalesce(frames, 0) as frames, coalesce(fragments, 0) as fragments, coalesce(longest, 0) as longest,
        round(case when ef >= sf then coalesce(frames, 0) / (ef - sf + 1)::double end, 6) as coverage, coalesce(array_to_string(tracks, ','), '') as tracks from ac left join cov using (label) left join fs using (label)""",
    "actor_fragments": f"""with {_ACT} select label, label as actor, track, first_frame, last_frame, samples, inside from tr""",
    "same_actor_predictions": f"""with {_ACT}, p as (select video_id, track, min(frame) as s, min(frame) + 12 as e from fr group by 1, 2)
        select ac.label, string_agg(p.track::varchar, ',' order by p.track) as predictions from ac join fs using (label) join cov using (label) join p on p.video_id = ac.video_id and p.s <= ef + 2 and p.e >= sf - 2 and list_contains(tracks, p.track) group by 1""",
    "spatial_matches": f"""with {_ACT}, mk as (select label, unnest([label, label + 3]) as prediction, case when label % 3 = 0 then 'person_picks_up_object' when actor_type = 'vehicle' then 'vehicle_stops' else 'person_stands' end as activity, sf, ef, actor_type, video_id from ac),
        sc as (select mk.label, prediction, max({_iou("b.", "g.")}) as iou from mk join fr b on b.track = prediction and b.frame between sf - 2 and ef + 2 join ge g on g.actor = mk.label and g.frame = b.frame
            where case actor_type when 'person' then b.object_type = 'person' when 'vehicle' then b.object_type = 'car' else b.object_type <> 'person' end group by 1, 2),
        v as (select mk.*, case when activity = 'person_picks_up_object' then 0 else coalesce(iou, 0) end as spatial, kind from mk left join sc using (label, prediction) join sp on sp.track = prediction)
        select label, prediction, activity, round(spatial, 6) as spatial from v where spatial >= 0.1 and (activity <> 'vehicle_stops' or kind = 'car')""",
    "label_classes": """with r as (select list_value('person', 'vehicle', 'bag', 'unknown_object', 'phone', 'other')[(user_id % 6 + 1)::int] as label, list_value('person', 'car', 'backpack', 'cell phone', 'chair', 'truck', 'bicycle')[(event_id % 7 + 1)::int] as detected from events)
        select label, detected, count(*) as n, case label when 'unknown_object' then detected <> 'person' when 'person' then detected = 'person' when 'vehicle' then detected in ('car', 'truck') when 'bag' then detected = 'backpack' when 'phone' then detected = 'cell phone' else false end as as_label,
          case label when 'person' then detected = 'person' when 'vehicle' then detected in ('car', 'truck', 'bicycle') else detected not in ('person', 'car', 'truck', 'bicycle') end as as_actor from r group by 1, 2""",
    "case_evidence": f"""with {_ACT}, b as (select g.actor as case_id, g.frame, b.track, coalesce({_iou("b.", "g.")}, 0) as iou from ge g left join fr b on b.video_id = g.video_id and b.frame = g.frame where g.actor % 5 = 0),
        f as (select case_id, frame, max(iou) as best from b group by 1, 2), t as (select case_id, track, count(distinct frame) as n from b where iou >= 0.1 group by 1, 2), u as (select case_id, count(*) as tracks, max(n) as longest from t group by 1)
        select case_id, count(*) as frames, round(max(best), 6) as best, count(*) filter (best >= 0.1) as touched, count(*) filter (best >= 0.3) as good, coalesce(any_value(tracks), 0) as tracks, coalesce(any_value(longest), 0) as longest from f left join u using (case_id) group by 1""",
    "tracklet_hits": """with s as (select l_suppkey as track, count(*) % 3 as boxes from lineitem group by 1)
        select o_orderkey as case_id, count(l_suppkey) > 0 as hit, coalesce(bool_or(boxes >= 2), false) as tracked, coalesce(bool_or(boxes >= 2 and s_nationkey in (o_custkey % 25, 3)), false) as associated
        from orders left join lineitem on l_orderkey = o_orderkey left join s on track = l_suppkey left join supplier on s_suppkey = l_suppkey group by 1""",
    "type_diagnosis": """with l as (select l_linenumber::varchar as activity, l_returnflag as event_type, l_orderkey % 3 = 0 as m, l_orderkey % 3 = 0 or l_partkey % 2 = 0 as d, l_partkey % 5 = 0 as r, l_tax, l_quantity, l_discount, l_partkey % 4 = 0 as ranked from lineitem),
        p as (select case when o_orderstatus = 'O' then 'R' else 'A' end as event_type, count(*) as n from orders group by 1),
        g as (select activity, event_type, count(*) as labels, count(*) filter (m) as matched, count(*) filter (d) as detected, count(*) filter (d and r) as extracted, count(*) filter (m and ranked) as retrieved, avg(l_tax) filter (m) as tiou,
            avg(l_quantity) filter (m) as mean_start_error, median(l_quantity) filter (m) as median_start_error, avg(l_discount) filter (m) as mean_end_error, median(l_discount) filter (m) as median_end_error,
            count(*) filter (not m and not d) as at_perception, count(*) filter (not m and d and not r) as at_event_extraction, count(*) filter (not m and d and r) as at_temporal_or_spatial_matching from l group by 1, 2)
        select event_type, activity, labels, matched, detected, extracted, retrieved, round(tiou, 6) as tiou, round(mean_start_error, 6) as mean_start_error, round(median_start_error, 6) as median_start_error, round(mean_end_error, 6) as mean_end_error,
            round(median_end_error, 6) as median_end_error, at_perception, at_event_extraction, at_temporal_or_spatial_matching, matched as at_matched, coalesce(n, 0) as predictions, labels - matched as misses, coalesce(n, 0) - matched as false_positives,
            round(matched / nullif(n, 0), 6) as precision, round(matched / labels, 6) as recall, round(detected / labels, 6) as coverage, round(extracted / nullif(detected, 0), 6) as success from g left join p using (event_type)""",
    "search_ranks": """select o_orderkey as label, o_custkey % 100 as event_id, case when r <= 3 then r end as rank from orders left join (select l_orderkey, l_suppkey, min(l_linenumber) as r from lineitem group by 1, 2) on l_orderkey = o_orderkey and l_suppkey = o_custkey % 100""",
    "track_summaries": f"""with {SAMPLES}, g as (select *, t - lag(t) over (partition by video_id, track order by t) > 24 as gap from samples) select video_id, track, count(*) as samples, count(*) filter (gap) as gaps, count(*) >= 3 as persistent,
        round(min(t), 6) as start, round(max(t), 6) as "end", round(max(t) - min(t), 6) as duration, round(avg(x1) filter (x1 > 20), 6) as confidence from g group by 1, 2""",
}
