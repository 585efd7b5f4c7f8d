"""Matching, metrics, linking, merging and contact queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import geometry as G
from trackloom.operators import contact as C
from trackloom.operators import linking as L
from trackloom.operators import matching as M
from trackloom.operators import motion
from trackloom.operators.search import top
from trackloom.plans.durable import counted
from trackloom.queries.tracks import _SEG, GAP
from trackloom.sources.tables import ORDER_INTERVALS, SAMPLES, order_intervals, samples, table


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Even orders as predictions, odd ones as labels, of the same customer and status."""
    orders = order_intervals(spark, sf_dir).select("o_custkey", "o_orderstatus", "o_orderkey", "start", "end")
    return orders.where("o_orderkey % 2 = 0").withColumnRenamed("o_orderkey", "prediction"), orders.where("o_orderkey % 2 = 1").withColumnRenamed("o_orderkey", "label")


def eligible_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.eligible(*_sides(spark, sf_dir), ["o_custkey", "o_orderstatus"], 0.1, 2.0)
    return found.select("o_custkey", "o_orderstatus", "prediction", "label", F.round("tiou", 4).alias("tiou"), F.round("start_error", 6).alias("start_error"), F.round("end_error", 6).alias("end_error"))


def one_to_one_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = M.eligible(*_sides(spark, sf_dir), ["o_custkey", "o_orderstatus"], 0.1, 2.0)
    return M.one_to_one(pairs).select("prediction", "label", F.round("weight", 6).alias("weight"))


def one_to_one_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs and weight of the one-to-one matches of each customer and status of whom at most four labels
    may match: several assignments may be as good, their sums are not."""
    pairs, _ = counted(M.eligible(*_sides(spark, sf_dir), ["o_custkey", "o_orderstatus"], 0.1, 2.0))
    few = pairs.groupBy("o_custkey", "o_orderstatus").agg(F.count_distinct("label").alias("n")).where("n <= 4").drop("n")
    found = M.one_to_one(pairs.join(few, ["o_custkey", "o_orderstatus"]))
    return found.groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("pairs"), F.round(F.sum("weight"), 6).alias("weight"))


def frame_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as boxes of their order's frame, odd lines against even ones: the sum of 1 + IoU of each
    frame's best matches."""
    li = table(spark, sf_dir, "lineitem")
    first = li.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("at")).groupBy("l_orderkey", "l_linenumber")
    li = first.agg(*[F.min_by(c, "at").alias(c) for c in ("l_returnflag", "l_partkey", "l_suppkey")])  # of repeated lines the first
    x, y = F.col("l_partkey") % 20, F.col("l_suppkey") % 10
    boxes = li.select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("k"), F.when(F.col("l_returnflag") == "N", "person").otherwise("car").alias("class"),
                      x.cast("double").alias("x1"), y.cast("double").alias("y1"), (x + 15).cast("double").alias("x2"), (y + 12).cast("double").alias("y2"))
    same = lambda a, b: a == b
    found = M.match_references(boxes.where("k % 2 = 1").withColumnRenamed("k", "left"), boxes.where("k % 2 = 0").withColumnRenamed("k", "right"), ["frame"], 0.3, same)
    return found.groupBy("frame").agg(F.round(F.sum(1 + F.col("iou")), 6).alias("weight"))


def match_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics where a prediction matches the label of the next order key and equal status."""
    p, t = _sides(spark, sf_dir)
    pairs = p.join(t.select("o_orderstatus", "label", F.col("start").alias("c"), F.col("end").alias("d")), (F.col("prediction") + 1 == F.col("label")) & (p["o_orderstatus"] == t["o_orderstatus"])).drop(t["o_orderstatus"])
    a, b, c, d = (F.col(x) for x in ("start", "end", "c", "d"))
    one, two = G.endpoint_errors(a, b, c, d)
    matches = pairs.select("o_orderstatus", "o_custkey", G.temporal_iou(a, b, c, d).alias("tiou"), one.alias("start_error"), two.alias("end_error"))
    part = lambda df: df.withColumn("half", F.col("o_custkey") % 2)
    out = M.detection_metrics(part(p), part(t), part(matches), ["o_orderstatus", "half"])
    return out.select("o_orderstatus", "half", "tp", "fp", "fn", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "false_discovery", "tiou", "start_error", "end_error")])


def nearest_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, t = _sides(spark, sf_dir)
    found = M.nearest_miss(p.withColumnRenamed("prediction", "id"), t.withColumnRenamed("label", "id"), ["o_custkey", "o_orderstatus"])
    return found.withColumn("error", F.round("error", 6))


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand ranked by price for a query part, relevant if of the same size."""
    part = table(spark, sf_dir, "part")
    asked = part.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), "p_brand", F.col("p_size").alias("size"))
    items = part.select(F.col("p_partkey").alias("item"), "p_brand", "p_retailprice", "p_size")
    best = top(items, "p_brand", 5, F.desc("p_retailprice"), F.col("item"))  # the same for all queries of a brand
    found = best.join(asked, "p_brand")
    counts = items.groupBy("p_brand", F.col("p_size").alias("size")).agg(F.count("*").alias("n"))
    out = M.retrieval_metrics(found.select("query_id", "item", "rank"), found.where("p_size = size").select("query_id", "item"), asked, asked.join(counts, ["p_brand", "size"]).select("query_id", "n"))
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in ("p_at_1", "p_at_5", "r_at_5", "reciprocal_rank", "ap_at_5")])


def paired_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("event_type in ('view', 'click')").select(
        "user_id", F.when(F.col("event_type") == "view", "manual").otherwise("assisted").alias("mode"), F.col("value").alias("seconds"), (F.col("value") * 2 + 1).alias("total"))
    out = M.paired_reduction(events, ["user_id"], "mode", ["seconds", "total"])
    return out.select("measure", "pairs", *[F.round(c, 6).alias(c) for c in ("manual", "assisted", "reduction")])


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("kind"), (F.col("l_linestatus") == "F").alias("matched"), F.col("l_tax").alias("tiou"), (F.col("l_quantity") / 50).alias("best"), (F.col("l_discount") * 10).alias("all"))
    out = M.threshold_sweep(line, [0.35, 0.4, 0.45, 0.5, 0.55, 0.6], ["best", "all"])
    return out.select("mode", "threshold", "kind", "selected", "true", *[F.round(c, 6).alias(c) for c in ("tiou", "precision", "recall")])


def greedy_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order, by price, take the first free supplier among three."""
    s = F.col("l_suppkey")
    hits = table(spark, sf_dir, "lineitem").select("l_orderkey", F.round(-F.col("l_extendedprice") * 100).cast("long").alias("rank"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("hit"), F.array(s % 5, s % 3, s % 2).alias("candidates"))
    return M.greedy(hits, ["l_orderkey"], ["rank", "hit"])


def suppressed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = samples(spark, sf_dir).select("object_type", F.floor("t").alias("frame"), F.col("track").alias("id"), (F.col("x1") / 500).alias("confidence"), F.lit(0.0).alias("x1"), "y1", F.lit(20.0).alias("x2"), "y2")
    return L.suppressed(boxes, ["object_type", "frame"], 0.6).select("object_type", "frame", "id", F.round("confidence", 6).alias("confidence"))


def object_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.object_tracks(_boxes(spark, sf_dir), 1.1).select("video_id", "kind", "id", "track", "ambiguous")


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = samples(spark, sf_dir)
    return found.select("video_id", F.col("object_type").alias("kind"), (F.col("t") * 3600e6).cast("long").alias("id"), "t", (F.col("x1") % 1).alias("confidence"), *["x1", "y1", "x2", "y2"])


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.when(F.col("object_type") == "bag", "truck").otherwise("car")
    return motion.valid_tracks(samples(spark, sf_dir), GAP).drop("track").withColumnRenamed("key", "track").withColumn("object_type", kinds)


def gap_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.gap_candidates(L.track_ends(_tracks(spark, sf_dir), ["video_id", "track"], 8.0), 30.0)
    return found.select("video_id", "a", "b", F.round("gap", 6).alias("gap"), "rejected", "score")


def merged_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _tracks(spark, sf_dir)
    found = L.leading_candidates(L.track_ends(own, ["video_id", "track"], 8.0), 30.0, 0.5)
    merges = L.safe_merges(found, own, 0.5, 0.01, 1.0, 30.0)
    return L.merged_tracks(own.select("track").distinct(), merges)


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 8).alias("video_id"), F.col("user_id").alias("person"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 3600e6).alias("t"),
        F.lit("left").alias("hand"), F.when(F.col("event_type").isin("view", "click", "error"), 0.5 + F.col("value") / 1000).otherwise(0.2).alias("probability"),
        F.col("value").alias("x1"), F.lit(0.0).alias("y1"), (F.col("value") + 10).alias("x2"), F.lit(10.0).alias("y2"))


def manipulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.manipulations(_observations(spark, sf_dir), max_gap=10.0, persist=2.0, near=20.0, sure=6.0)
    return found.select("video_id", "person", "kind", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), F.col("n"), F.round("confidence", 4).alias("confidence"))


def manipulations_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.manipulations(_observations(spark, sf_dir), max_gap=10.0, persist=2.0, near=20.0, sure=6.0)
    return C.without_overlaps(found.drop("run"), ["video_id", "person", "kind"]).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"))


QUERIES = {"eligible_pairs": eligible_pairs, "one_to_one_matches": one_to_one_matches, "one_to_one_totals": one_to_one_totals, "frame_matches": frame_matches, "match_metrics": match_metrics, "nearest_misses": nearest_misses, "retrieval_metrics": retrieval_metrics,
           "paired_reduction": paired_reduction, "threshold_sweep": threshold_sweep, "greedy_labels": greedy_labels, "suppressed_boxes": suppressed_boxes, "object_tracks": object_tracks,
           "gap_candidates": gap_candidates, "merged_tracks": merged_tracks, "manipulations": manipulations, "manipulations_apart": manipulations_apart}

_P = f"""{ORDER_INTERVALS}, p as (select * from order_intervals where o_orderkey % 2 = 0), l as (select * from order_intervals where o_orderkey % 2 = 1)"""
_TIOU = """case when greatest(p."end", l."end") - least(p.start, l.start) > 0 then greatest(0, least(p."end", l."end") - greatest(p.start, l.start)) / (greatest(p."end", l."end") - least(p.start, l.start)) when greatest(p."end", l."end") = least(p.start, l.start) then (p.start = l.start)::int else 0 end"""
_ENDS = f"""{_SEG}, trk as (select video_id, key as track, case when object_type = 'bag' then 'truck' else 'car' end as kind, t, x1, y1, x2, y2,
        row_number() over (partition by video_id, key order by t) as i, row_number() over (partition by video_id, key order by t desc) as j, n from valid),
    h as (select video_id, track, arg_min(kind, t) as kind, arg_min(s, s.t) as f, arg_max(s, s.t) as e, arg_max(s, s.t) filter (i <= 3) as h3, arg_max(s, s.t) filter (i <= 2) as h2, arg_min(s, s.t) filter (j <= 3) as t3, arg_min(s, s.t) filter (j <= 2) as t2 from trk s group by 1, 2),
    m as (select video_id, track, kind, f, e, case when h3.t - f.t > 8 then h2 else h3 end as hb, case when e.t - t3.t > 8 then t2 else t3 end as ta from h),
    ends as (select *, ((hb.x1 + hb.x2) / 2 - (f.x1 + f.x2) / 2) / greatest(0.01, hb.t - f.t) as vxh, ((hb.y1 + hb.y2) / 2 - (f.y1 + f.y2) / 2) / greatest(0.01, hb.t - f.t) as vyh,
        ((e.x1 + e.x2) / 2 - (ta.x1 + ta.x2) / 2) / greatest(0.01, e.t - ta.t) as vxt, ((e.y1 + e.y2) / 2 - (ta.y1 + ta.y2) / 2) / greatest(0.01, e.t - ta.t) as vyt from m),
    pr as (select a.video_id, a.track as a, b.track as b, b.f.t - a.e.t as gap, a.kind as ka, b.kind as kb, (a.e.x1 + a.e.x2) / 2 as ax, (a.e.y1 + a.e.y2) / 2 as ay, (b.f.x1 + b.f.x2) / 2 as bx, (b.f.y1 + b.f.y2) / 2 as by_,
        a.vxt as vxa, a.vyt as vya, b.vxh as vxb, b.vyh as vyb, 40.0::double as scale from ends a join ends b on a.video_id = b.video_id and b.f.t - a.e.t > 0 and b.f.t - a.e.t <= 30),
    q as (select *, sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) / scale as far, sqrt(pow(bx - ax - vxa * gap, 2) + pow(by_ - ay - vya * gap, 2)) / scale as ma, sqrt(pow(bx - vxb * gap - ax, 2) + pow(by_ - vyb * gap - ay, 2)) / scale as mb,
        sqrt(vxa * vxa + vya * vya) as va, sqrt(vxb * vxb + vyb * vyb) as vb from pr),
    r as (select *, case when va > 2 and vb > 2 then (vxa * vxb + vya * vyb) / (va * vb) else 1 end as cosine from q)"""
_RUN = """o as (select user_id % 8 as video_id, user_id as person, event_id as id, epoch_us(ts)::double / 3600e6::double as t, case when event_type in ('view', 'click', 'error') then 0.5::double + value / 1000 else 0.2::double end as p, value as x from events),
    h as (select *, p >= 0.45 as o, lag(p >= 0.45) over w as lo, lag(t) over w as lt from o window w as (partition by video_id, person order by t, id)),
    g as (select * from (select *, sum(case when not coalesce(lo, false) or t - lt > 10 then 1 else 0 end) over (partition by video_id, person order by t, id) as run from h) where o),
    v as (select *, (x - lag(x) over w) / greatest(0.001, t - lag(t) over w) as vx, greatest(0.001, t - lag(t) over w) as dt from g window w as (partition by video_id, person, run order by t, id)),
    u as (select *, abs(vx - lag(vx) over (partition by video_id, person, run order by t, id)) / dt as turn from v),
    runs as (select video_id, person, run, min(t) as start, max(t) as "end", count(*) as n, avg(p) as mp, coalesce(avg(abs(vx)), 0) as ms, greatest(0, 1 - coalesce(avg(turn), 0) / 800) as st from u group by 1, 2, 3 having count(*) >= 2 and max(t) - min(t) >= 2),
    a as (select r.*, coalesce(bool_or(r.start - o.t > 0 and r.start - o.t <= 20), false) as sb, coalesce(bool_or(r.start - o.t > 0 and r.start - o.t <= 20 and o.p < 0.45), false) as fb, coalesce(bool_or(o.t - r."end" > 0 and o.t - r."end" <= 20 and o.p < 0.45), false) as fa
        from runs r join o using (video_id, person) group by all),
    manip as (select video_id, person, 'pickup' as kind, start, "end", n, least(1.0, 0.7::double * mp + 0.3::double * st) as confidence from a where (fb or not sb) and (st >= 0.5 and ms < 800 or "end" - start >= 6)
        union all select video_id, person, 'placement', start, "end", n, 0.8::double * mp from a where fa)"""

_SCORE = """case when rej then 0 else round(0.35::double * exp(-least(far, ma, mb)) + 0.25::double * 3 / 3 + 0.20::double * greatest(0, 1 - gap / 30 * 0.5) + 0.10::double * case when va > 2 and vb > 2 then greatest(0, (cosine + 1) / 2) else 1 end
          + 0.10::double * case when ka = kb then 1.0 else 0.75 end, 4) end"""
ORACLES = {
    "greedy_labels": """with l as (select l_orderkey, list([{'rank': round(-l_extendedprice * 100)::bigint, 'hit': l_partkey * 10 + l_linenumber, 'c': [l_suppkey % 5, l_suppkey % 3, l_suppkey % 2], 'label': null::bigint}] order by round(-l_extendedprice * 100)::bigint, l_partkey * 10 + l_linenumber, l_suppkey % 5, l_suppkey % 3, l_suppkey % 2) as h from lineitem group by 1),
        f as (select l_orderkey, list_reduce(list_prepend([{'rank': -1::bigint, 'hit': -1::bigint, 'c': []::bigint[], 'label': null::bigint}], h), lambda a, x: list_concat(a, [{'rank': x[1].rank, 'hit': x[1].hit, 'c': x[1].c, 'label': list_filter(x[1].c, lambda v: not coalesce(list_contains(list_transform(a, lambda k: k.label), v), false))[1]}])) as o from l)
        select l_orderkey, u.hit as hit, u.label as label from (select l_orderkey, unnest(o[2:]) as u from f)""",
    "suppressed_boxes": f"""with {SAMPLES}, b as (select object_type, floor(t)::bigint as frame, list([{{'id': track, 'c': x1 / 500, 'y1': y1, 'y2': y2}}] order by x1 desc, track, y1) as l from samples group by 1, 2),
        k as (select object_type, frame, list_reduce(l, lambda a, x: case when list_bool_or(list_transform(a, lambda o: 20 * greatest(0, least(o.y2, x[1].y2) - greatest(o.y1, x[1].y1)) / greatest(1, 20 * (o.y2 - o.y1) + 20 * (x[1].y2 - x[1].y1) - 20 * greatest(0, least(o.y2, x[1].y2) - greatest(o.y1, x[1].y1))) >= 0.6)) then a else list_concat(a, x) end) as kept from b)
        select object_type, frame, u.id as id, round(u.c, 6) as confidence from (select object_type, frame, unnest(kept) as u from k)""",
    "merged_tracks": f"""with recursive {_ENDS}, sc as (select *, {_SCORE} as score from (select *, far / greatest(0.01, gap) > 2.5 or (va > 4 and vb > 4 and cosine < -0.3) as rej from r)),
        rk as (select *, row_number() over wa as ra, score - coalesce(lead(score) over wa, -1) as na, row_number() over wb as rb, score - coalesce(lead(score) over wb, -1) as nb from sc where not rej and score >= 0.5
            window wa as (partition by video_id, a order by score desc, b), wb as (partition by video_id, b order by score desc, a)),
        ok as (select k.*, x.e.t as t0, y.f.t as t1 from rk k join ends x on x.track = a and x.video_id = k.video_id join ends y on y.track = b and y.video_id = k.video_id where ra = 1 and rb = 1 and na >= 0.01 and nb >= 0.01),
        mg as (select a, b from ok where not exists (select 1 from valid s where s.video_id = ok.video_id and s.key <> a and s.key <> b and s.t > t0 and s.t < t1 and sqrt(pow((s.x1 + s.x2) / 2 - (ax + bx) / 2, 2) + pow((s.y1 + s.y2) / 2 - (ay + by_) / 2, 2)) <= greatest(sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) / 2, 1))),
        both_ as (select a as x, b as y from mg union all select b, a from mg), reach(x, y) as (select distinct key, key from valid union select r.x, m.y from reach r join both_ m on m.x = r.y)
        select x as track, min(y) as chain from reach group by 1""",
    "eligible_pairs": f"""with {_P} select p.o_custkey, p.o_orderstatus, p.o_orderkey as prediction, l.o_orderkey as label, round({_TIOU}, 4) as tiou, round(abs(p.start - l.start), 6) as start_error, round(abs(p."end" - l."end"), 6) as end_error
        from p join l on p.o_custkey = l.o_custkey and p.o_orderstatus = l.o_orderstatus where {_TIOU} >= 0.1 or (abs(p.start - l.start) <= 2 and abs(p."end" - l."end") <= 2)""",
    "one_to_one_totals": f"""with recursive {_P}, e as (select p.o_custkey, p.o_orderstatus, p.o_orderkey as prediction, l.o_orderkey as label, {_TIOU} + 0.001::double / (1 + abs(p.start - l.start) + abs(p."end" - l."end")) as weight
          from p join l on p.o_custkey = l.o_custkey and p.o_orderstatus = l.o_orderstatus where {_TIOU} >= 0.1 or (abs(p.start - l.start) <= 2 and abs(p."end" - l."end") <= 2)),
        b as (select o_custkey, o_orderstatus, count(distinct label) as n from e group by all having n <= 4),
        o as (select e.*, dense_rank() over (partition by o_custkey, o_orderstatus order by label) as k, n from e join b using (o_custkey, o_orderstatus)),
        s as (select o_custkey, o_orderstatus, n, 1 as k, []::bigint[] as used, 0::bigint as pairs, 0::double as weight from b
              union all select s.o_custkey, s.o_orderstatus, s.n, s.k + 1, case when c.prediction is null then used else list_append(used, c.prediction) end, pairs + (c.prediction is not null)::bigint, s.weight + coalesce(c.weight, 0)
              from s join (select o_custkey, o_orderstatus, k, prediction, weight from o union all select distinct o_custkey, o_orderstatus, k, null::bigint, 0::double from o) c
                on c.o_custkey = s.o_custkey and c.o_orderstatus = s.o_orderstatus and c.k = s.k where c.prediction is null or not list_contains(used, c.prediction))
        select o_custkey, o_orderstatus, pairs, round(weight, 6) as weight from s where k = n + 1 qualify row_number() over (partition by o_custkey, o_orderstatus order by pairs desc, s.weight desc) = 1""",
    "frame_matches": """with recursive bx as (select l_orderkey as frame, l_linenumber as k, any_value(l_returnflag = 'N') as cl, any_value(l_partkey % 20)::double as x, any_value(l_suppkey % 10)::double as y from lineitem group by all),
        i as (select p.frame, p.k as a, q.k as b, greatest(0, 15 - abs(p.x - q.x)) * greatest(0, 12 - abs(p.y - q.y)) as shared from bx p join bx q on p.frame = q.frame and p.k % 2 = 1 and q.k % 2 = 0 and p.cl = q.cl),
        e as (select frame, a, b, 1 + shared / (360 - shared) as w from i where shared / (360 - shared) >= 0.3),
        s as (select distinct frame, 1 as k, []::int[] as used, 0::double as weight from e
              union all select s.frame, s.k + 2, case when c.b is null then used else list_append(used, c.b::int) end, s.weight + c.w
              from s join (select frame, a, b, w from e union all select distinct frame, unnest([1, 3, 5, 7]), null, 0 from e) c on c.frame = s.frame and c.a = s.k where c.b is null or not list_contains(used, c.b::int))
        select frame, round(max(weight), 6) as weight from s where k = 9 group by 1""",
    "match_metrics": f"""with {_P}, mt as (select p.o_orderstatus, p.o_custkey % 2 as half, {_TIOU} as tiou, abs(p.start - l.start) as se, abs(p."end" - l."end") as ee from p join l on p.o_orderkey + 1 = l.o_orderkey and p.o_orderstatus = l.o_orderstatus),
        r as (select o_orderstatus, o_custkey % 2 as half, 1 as p, 0 as l, 0 as m, null::double as tiou, null::double as se, null::double as ee from p union all select o_orderstatus, o_custkey % 2, 0, 1, 0, null, null, null from l union all select o_orderstatus, half, 0, 0, 1, tiou, se, ee from mt)
        select o_orderstatus, half, sum(m)::bigint as tp, (sum(p) - sum(m))::bigint as fp, (sum(l) - sum(m))::bigint as fn, round(sum(m) / nullif(sum(p), 0), 6) as precision, round(sum(m) / nullif(sum(l), 0), 6) as recall,
          round((sum(p) - sum(m)) / nullif(sum(p), 0), 6) as false_discovery, round(avg(tiou), 6) as tiou, round(avg(se), 6) as start_error, round(avg(ee), 6) as end_error from r group by grouping sets ((o_orderstatus), (half), ())""",
    "nearest_misses": f"""with {_P}, x as (select p.o_custkey, p.o_orderstatus, p.o_orderkey as id, abs(p.start - l.start) + abs(p."end" - l."end") as error, l.o_orderkey as other, row_number() over (partition by p.o_orderkey order by abs(p.start - l.start) + abs(p."end" - l."end"), l.o_orderkey) as rn
        from p left join l on p.o_custkey = l.o_custkey and p.o_orderstatus = l.o_orderstatus) select o_custkey, o_orderstatus, id, round(error, 6) as error, other from x where rn = 1""",
    "retrieval_metrics": """with q as (select p_partkey as query_id, p_brand, p_size from part where p_partkey % 100 = 0), b as (select query_id, p_partkey as item, part.p_size = q.p_size as rel, row_number() over (partition by query_id order by p_retailprice desc, p_partkey) as rank from part join q using (p_brand)),
        n as (select query_id, count(*) filter (rel) as n from b group by 1), h as (select *, rel::int as hit, sum(rel::int) over (partition by query_id order by rank) / rank as pr from b where rank <= 5)
        select query_id, round(max(hit) filter (rank = 1), 6)::double as p_at_1, round(sum(hit) / 5, 6) as p_at_5, round(sum(hit) / max(n), 6) as r_at_5, round(coalesce(1 / min(rank) filter (hit = 1), 0), 6) as reciprocal_rank, round(sum(hit * pr) / max(n), 6) as ap_at_5
        from h join n using (query_id) group by 1""",
    "paired_reduction": """with w as (select user_id, avg(value) filter (event_type = 'view') as m, avg(value) filter (event_type = 'click') as a, avg(value * 2 + 1) filter (event_type = 'view') as m2, avg(value * 2 + 1) filter (event_type = 'click') as a2 from events group by 1)
        select 'seconds' as measure, count(*) as pairs, round(avg(m), 6) as manual, round(avg(a), 6) as assisted, round(avg(1 - a / m), 6) as reduction from w where m is not null and a is not null
        union all select 'total', count(*), round(avg(m2), 6), round(avg(a2), 6), round(avg(1 - a2 / m2), 6) from w where m2 is not null and a2 is not null""",
    "threshold_sweep": """with c as (select l_returnflag as kind, l_linestatus = 'F' as matched, l_tax as tiou, unnest([{'mode': 'best', 'v': l_quantity / 50}, {'mode': 'all', 'v': l_discount * 10}]) as s from lineitem)
        select s.mode as mode, t.threshold, kind, count(*) filter (s.v >= threshold) as selected, count(*) filter (s.v >= threshold and matched) as "true", round(avg(tiou) filter (s.v >= threshold and matched), 6) as tiou,
          round(count(*) filter (s.v >= threshold and matched) / nullif(count(*) filter (s.v >= threshold), 0), 6) as precision, round(count(*) filter (s.v >= threshold and matched) / nullif(count(*) filter (matched), 0), 6) as recall
        from c, (select unnest([0.35, 0.4, 0.45, 0.5, 0.55, 0.6])::double as threshold) t group by 1, 2, 3""",
    "gap_candidates": f"""with {_ENDS} select video_id, a, b, round(gap, 6) as gap, rej as rejected, {_SCORE} as score from (select *, far / greatest(0.01, gap) > 2.5 or (va > 4 and vb > 4 and cosine < -0.3) as rej from r)""",
    "manipulations": f"""with {_RUN} select video_id, person, kind, round(start, 6) as start, round("end", 6) as "end", n, round(confidence, 4) as confidence from manip""",
    "manipulations_apart": f"""with {_RUN} select kind, count(*) as n, round(sum(confidence), 4) as confidence from manip group by 1""",
}
