"""Track segments, motion events, interval and as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators import intervals as I  # noqa: E741
from trackloom.operators import motion as M
from trackloom.operators import runs as R
from trackloom.sources.tables import ORDER_INTERVALS, SAMPLES, order_intervals, samples, table

GAP = 24.0
_SEG = f"""{SAMPLES},
    cut as (select *, sum(case when gap > {GAP} then 1 else 0 end) over (partition by video_id, track order by t) as segment
            from (select *, t - lag(t) over (partition by video_id, track order by t) as gap from samples)),
    keyed as (select * exclude (gap), case when max(segment) over (partition by video_id, track) > 0
                then track::varchar || '@' || segment::int::varchar else track::varchar end as key from cut),
    valid as (select * from (select *, count(*) over (partition by video_id, key) as n from keyed) where n >= 3)"""


def _edges(source: str, scale: str = "first") -> str:
    unit = "first_value(y2 - y1) over w" if scale == "first" else "median(y2 - y1) over (partition by video_id, key)"
    return f"""edges as (select *, row_number() over w - 1 as i,
        sqrt(pow((lead(x1) over w + lead(x2) over w) / 2 - (x1 + x2) / 2, 2) + pow((lead(y1) over w + lead(y2) over w) / 2 - (y1 + y2) / 2, 2)) / greatest(1.0, scale)
          / greatest(0.01, lead(t) over w - t) as speed, lead(t) over w as next_t
      from (select *, greatest(1.0, {unit}) as scale from {source} window w as (partition by video_id, key order by t))
      window w as (partition by video_id, key order by t))"""


_SMOOTH = """smooth as (select *, case when speed is not null then median(speed) over (partition by video_id, key order by t rows between 1 preceding and 1 following) end as smooth from edges)"""


def _runs(source: str, state: str, keys: str, kind: str = "edge") -> str:
    keep = "where s is not null" if kind == "edge" else ""
    return f"""runs as (select {keys}, any_value(s) as state, min(t) as start, max(coalesce(nt, t)) as "end", count(*) as n from (
        select *, sum(case when s is not distinct from ls and rn > 1 then 0 else 1 end) over (partition by {keys} order by t) as run from (
          select *, lag(s) over (partition by {keys} order by t) as ls, lead(t) over (partition by {keys} order by t) as nt, row_number() over (partition by {keys} order by t) as rn
          from (select *, {state} as s from {source}))) {keep} group by {keys}, run)"""


def track_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = R.segments(samples(spark, sf_dir), GAP)
    return cut.groupBy("video_id", "track", "segment", "key").agg(F.count("*").alias("n"), F.round(F.min("t"), 6).alias("start"), F.round(F.max("t"), 6).alias("end"))


def track_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = R.smoothed(R.edges(M.valid_tracks(samples(spark, sf_dir), GAP)))
    return moved.select("video_id", "key", F.col("i").cast("long"), F.round("t", 6).alias("t"), F.round("speed", 6).alias("speed"), F.round("smooth", 6).alias("smooth"))


def track_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.stationary(M.valid_tracks(samples(spark, sf_dir), GAP))
    return found.select("video_id", "key", "kind", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), F.round("verified_until", 6).alias("verified_until"), "prior_motion")


def track_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.started_moving(M.valid_tracks(samples(spark, sf_dir), GAP))
    return found.select("video_id", "key", "kind", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), F.round("verified_until", 6).alias("verified_until"))


_RUNS = f"""{_SEG}, {_edges("valid")}, {_runs("edges", "speed >= 0.08", "video_id, key")},
    kinds as (select video_id, key, arg_min(object_type, t) as object_type from valid group by 1, 2),
    seq as (select runs.*, object_type, lag(state) over w as bs, lag(start) over w as b0, lag("end") over w as b1
            from runs join kinds using (video_id, key) window w as (partition by video_id, key order by start))"""
_VEHICLES = "('bicycle', 'bus', 'car', 'motorcycle', 'truck', 'vehicle')"


def vehicle_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.vehicle_transitions(M.valid_tracks(samples(spark, sf_dir), GAP), within=40.0, still_for=4.0, drop=0.05, displaced=0.1, unit=0.5)
    return found.select("video_id", "key", "kind", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), F.round("verified_until", 6).alias("verified_until"))


def state_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = M.state_trace(M.valid_tracks(samples(spark, sf_dir), GAP), unknown_gap=20.0, change=0.02)
    return trace.select("video_id", "key", F.round("t", 6).alias("t"), F.round("smooth", 6).alias("smooth"), F.round("acceleration", 6).alias("acceleration"), "state")


def state_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = M.state_trace(M.valid_tracks(samples(spark, sf_dir), GAP), unknown_gap=20.0, change=0.02)
    low = 473364.0
    held = M.state_durations(trace, F.lit(low), F.lit(low + 240.0))
    return held.select("video_id", "key", "state", F.round("seconds", 5).alias("seconds"))


_TRACE = f"""{_SEG}, {_edges("valid", "median")}, {_SMOOTH},
    trace as (select video_id, key, t, next_t - t as dt, smooth, acceleration,
        case when next_t - t > 20.0 then 'UNKNOWN' when smooth <= 0.12 then 'STATIONARY' when acceleration >= 0.02 then 'ACCELERATING' when acceleration <= -0.02 then 'DECELERATING' else 'MOVING' end as state
      from (select *, (smooth - lag(smooth) over w) / greatest(0.01, t - lag(t) over w) as acceleration from smooth where speed is not null window w as (partition by video_id, key order by t)))"""


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A zone in each of five videos, wider for later regions."""
    k = F.col("r_regionkey")
    rect = F.array(F.lit(0.0), F.lit(0.0), 0.1 + k * 0.05, F.lit(1.0))
    return table(spark, sf_dir, "region").select(F.concat(F.lit("V"), k.cast("string")).alias("video_id"), F.col("r_name").alias("zone"), rect.alias("rect"))


def zone_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.zone_events(M.valid_tracks(samples(spark, sf_dir), GAP), zones(spark, sf_dir), 500.0, 300.0)
    return found.select("video_id", "key", "zone", "kind", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


def track_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.ends(samples(spark, sf_dir), F.lit(474060.0), F.lit(0.1))
    return found.select("video_id", "track", "kind", F.round("t", 6).alias("t"))


def gap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.gap_summary(samples(spark, sf_dir), 12.0)
    return found.withColumn("duration", F.round("duration", 6))


def longest_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.longest_hits(samples(spark, sf_dir), ["video_id", "track"], "t", F.col("x1") > 30)


def motion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.motion_summary(samples(spark, sf_dir), GAP)
    return found.select("video_id", "track", F.col("gaps").cast("long").alias("gaps"), *[F.round(c, 5).alias(c) for c in ("displacement", "median_speed", "max_acceleration", "min_acceleration", "still_seconds", "longest_stretch")])


_MOTION = f"""{SAMPLES}, cut as (select *, sum(case when gap > {GAP} then 1 else 0 end) over (partition by video_id, track order by t) as seg
            from (select *, t - lag(t) over (partition by video_id, track order by t) as gap from samples)),
    keyed as (select *, track::varchar || '@' || seg::varchar as key from cut), {_edges("keyed", "median")},
    moved as (select *, next_t as nt, lead(t) over (partition by video_id, track order by t) - t as dt,
              (speed - lag(speed) over (partition by video_id, key order by t)) / greatest(0.01, t - lag(t) over (partition by video_id, key order by t)) as acc from edges),
    longest as (select video_id, track, max(d) as longest_stretch from (select video_id, track, key, max(t) - min(t) as d from moved group by all) group by all)"""


def order_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = order_intervals(spark, sf_dir)
    left = found.select("o_custkey", F.col("o_orderkey").alias("id1"), F.col("start").alias("start1"), F.col("end").alias("end1"))
    right = found.select("o_custkey", F.col("o_orderkey").alias("id2"), F.col("start").alias("start2"), F.col("end").alias("end2"))
    return I.interval_join(left, right, "overlaps", 0, 60.0, ["o_custkey"]).where("id1 < id2").select("o_custkey", "id1", "id2")


def _followed(operator: str, window: float):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = order_intervals(spark, sf_dir)
        left = found.select("o_custkey", F.col("o_orderkey").alias("id1"), F.col("start").alias("start1"), F.col("end").alias("end1"))
        right = found.select("o_custkey", F.col("o_orderkey").alias("id2"), F.col("start").alias("start2"), F.col("end").alias("end2"))
        return I.interval_join(left, right, operator, window, 60.0, ["o_custkey"]).where("id1 <> id2").select("o_custkey", "id1", "id2")

    return query


def _order_pairs(test: str, pair: str = "<>") -> str:
    return f"""with {ORDER_INTERVALS} select x.o_custkey, x.o_orderkey as id1, y.o_orderkey as id2 from order_intervals x join order_intervals y
        on x.o_custkey = y.o_custkey and x.o_orderkey {pair} y.o_orderkey and {test} where x.start <= x."end" and y.start <= y."end" """


def purchase_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    left = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), F.col("t").alias("t1"))
    right = events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click"), F.col("t").alias("t2"))
    return I.asof_nearest(left, right, ["user_id"], 3600.0).select("user_id", "purchase", "click", F.round(F.col("t2") - F.col("t1"), 3).alias("apart"))


def nearest_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    left, right = (events.where(F.col("event_type") == kind).select("user_id", F.col("t").alias(name)) for kind, name in (("purchase", "t1"), ("view", "t2")))
    return I.global_nearest(left, right, ["user_id"]).select("user_id", F.round("gap", 3).alias("gap"), F.round("t1", 3).alias("t1"), F.round("t2", 3).alias("t2"))


def merged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.merged(order_intervals(spark, sf_dir), ["o_custkey"])


def covered_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86_400e6
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (day + 3).alias("after"), (day + 3 + F.col("o_orderkey") % 200 - 10).alias("before"))
    return I.covers(order_intervals(spark, sf_dir), asked, ["o_custkey"])


def before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = order_intervals(spark, sf_dir)
    points = orders.select("o_custkey", F.col("start").alias("t"))
    events = orders.select("o_custkey", F.col("o_orderkey").alias("id"), "start", "end")
    return I.before_after(points, events, ["o_custkey"], 365.0)


QUERIES = {
    "track_segments": track_segments, "track_speeds": track_speeds, "track_stops": track_stops, "track_starts": track_starts, "vehicle_stops": vehicle_stops,
    "state_trace": state_trace, "state_durations": state_durations, "zone_events": zone_events, "track_ends": track_ends, "gap_summary": gap_summary,
    "longest_hits": longest_hits, "motion_summary": motion_summary, "order_overlaps": order_overlaps, "orders_during": _followed("during", 0), "orders_after": _followed("after", 90.0),
    "orders_before_unbounded": _followed("before", -1), "orders_near": _followed("near", 30.0), "purchase_clicks": purchase_clicks, "nearest_pair": nearest_pair,
    "merged_orders": merged_orders, "covered_ranges": covered_ranges, "before_after": before_after,
}

ORACLES = {
    "track_segments": f"with {_SEG} select video_id, track, segment::int as segment, key, count(*) as n, round(min(t), 6) as start, round(max(t), 6) as \"end\" from keyed group by 1, 2, 3, 4",
    "track_speeds": f"with {_SEG}, {_edges('valid')}, {_SMOOTH} select video_id, key, i, round(t, 6) as t, round(speed, 6) as speed, round(smooth, 6) as smooth from smooth",
    "track_stops": f"""with {_RUNS} select video_id, key, case when m and object_type not in {_VEHICLES} then case when object_type = 'person' then 'stopped' else 'became_stationary' end else 'stationary' end as kind,
        round(start, 6) as start, round(case when m then least("end", start + 2) else "end" end, 6) as "end", round("end", 6) as verified_until, m as prior_motion
        from (select *, coalesce(bs and b1 = start and b1 - b0 >= 1, false) as m from seq) where not state and "end" - start >= 2""",
    "track_starts": f"""with {_RUNS} select video_id, key, 'started_moving' as kind, round(start, 6) as start, round(least("end", start + 1), 6) as "end", round("end", 6) as verified_until
        from seq where state and object_type not in {_VEHICLES} and "end" - start >= 1 and not bs and b1 = start and b1 - b0 >= 2""",
    "vehicle_stops": f"""with {_SEG}, long as (select * exclude (n) from valid where n >= 7), {_edges('long', 'median')}, {_SMOOTH},
        moved as (select video_id, key, i, t, scale, smooth, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy, lead(smooth) over w as ns, lead(t, 2) over w as t2,
                  (lead(x1, 2) over w + lead(x2, 2) over w) / 2 as cx2, (lead(y1, 2) over w + lead(y2, 2) over w) / 2 as cy2 from smooth window w as (partition by video_id, key order by t)),
        {_runs('moved', 'smooth <= 0.12 * 0.5', 'video_id, key')},
        still as (select r.video_id, r.key, r.start, r."end", f.smooth as fs, f.cx as fx, f.cy as fy, l.cx as lx, l.cy as ly from runs r
                  join moved f on f.video_id = r.video_id and f.key = r.key and f.t = r.start join moved l on l.video_id = r.video_id and l.key = r.key and l.t = r."end" where r.state and r."end" - r.start >= 4),
        stops as (select s.video_id, s.key, s.start, s."end", fs, fx, fy, count(*) as n, arg_max(m, {{'s': m.smooth, 'b': -m.t}}) as p from still s join moved m on m.video_id = s.video_id and m.key = s.key
                  and m.smooth >= 0.28 * 0.5 and m.t < s.start and s.start - m.t <= 40 group by all),
        starts as (select s.video_id, s.key, s.start, s."end", lx, ly, arg_min(m, m.t) as p from still s join moved m on m.video_id = s.video_id and m.key = s.key
                  and m.smooth >= 0.28 * 0.5 and m.ns >= 0.28 * 0.5 and m.t >= s."end" and m.t - s."end" <= 40 group by all)
        select video_id, key, 'stopped' as kind, round(p.t, 6) as start, round(start, 6) as "end", round("end", 6) as verified_until from stops
        where n >= 2 and p.smooth - fs >= 0.05 * 0.5 and sqrt(pow(fx - p.cx, 2) + pow(fy - p.cy, 2)) / p.scale >= 0.1
        union all select video_id, key, 'started_moving', round("end", 6), round(p.t2, 6), round(p.t2, 6) from starts where sqrt(pow(p.cx2 - lx, 2) + pow(p.cy2 - ly, 2)) / p.scale >= 0.1""",
    "state_trace": f"with {_TRACE} select video_id, key, round(t, 6) as t, round(smooth, 6) as smooth, round(acceleration, 6) as acceleration, state from trace",
    "state_durations": f"with {_TRACE} select video_id, key, state, round(sum(greatest(0.0, least(t + dt, 473604.0) - greatest(t, 473364.0))), 5) as seconds from trace group by 1, 2, 3",
    "zone_events": f"""with {_SEG}, zoned as (select v.*, r_name as zone, (x1 + x2) / 2 / 500.0 >= 0 and (x1 + x2) / 2 / 500.0 <= 0.1::double + r_regionkey * 0.05::double and y2 / 300.0 between 0 and 1 as inside
            from valid v join region on video_id = 'V' || r_regionkey::varchar),
        stepped as (select *, lag(inside) over (partition by video_id, key, zone order by t) as was from zoned), {_runs('zoned', 'inside', 'video_id, key, zone', 'sample')}
        select video_id, key, zone, case when inside then 'entered_zone' else 'exited_zone' end as kind, round(t, 6) as start, round(t, 6) as "end" from stepped where was is not null and was <> inside
        union all select video_id, key, zone, 'remained_in_zone', round(start, 6), round("end", 6) from runs where state and "end" - start >= 3""",
    "track_ends": f"""with {SAMPLES}, seen as (select video_id, track, min(t) as a, max(t) as b from samples group by 1, 2)
        select video_id, track, 'appeared' as kind, round(a, 6) as t from seen union all select video_id, track, 'disappeared', round(b, 6) from seen where b < 474060.0::double - 2 / 0.1::double""",
    "gap_summary": f"""with {SAMPLES} select video_id, track, count(*) as n, round(max(t) - min(t), 6) as duration, count(*) filter (gap > 12) as gaps, count(*) >= 2 as persistent
        from (select *, t - lag(t) over (partition by video_id, track order by t) as gap from samples) group by 1, 2""",
    "longest_hits": f"""with {SAMPLES}, {_runs('samples', 'x1 > 30', 'video_id, track', 'sample')} select video_id, track, coalesce(max(n) filter (state), 0) as longest from runs group by 1, 2""",
    "motion_summary": f"""with {_MOTION} select video_id, track, max(gaps)::bigint as gaps, round(max(sqrt(pow((b.x1 + b.x2) / 2 - (a.x1 + a.x2) / 2, 2) + pow((b.y1 + b.y2) / 2 - (a.y1 + a.y2) / 2, 2)) / h), 5) as displacement, round(max(ms), 5) as median_speed,
        round(max(ma), 5) as max_acceleration, round(max(mi), 5) as min_acceleration, round(max(st), 5) as still_seconds, round(max(longest_stretch), 5) as longest_stretch from (
          select video_id, track, arg_min(m, m.t) as a, arg_max(m, m.t) as b, greatest(1.0, median(y2 - y1)) as h, median(speed) as ms, max(acc) as ma, min(acc) as mi,
                 coalesce(sum(dt) filter (speed <= 0.12), 0) as st, max(seg) as gaps from moved m group by 1, 2) join longest using (video_id, track) group by 1, 2""",
    "order_overlaps": _order_pairs('greatest(x.start, y.start) <= least(x."end", y."end")', "<"),
    "orders_during": _order_pairs('y.start <= x.start and x."end" <= y."end"'),
    "orders_after": _order_pairs('x.start - y."end" between 0 and 90'),
    "orders_before_unbounded": _order_pairs('y.start - x."end" >= 0'),
    "orders_near": _order_pairs('greatest(0, y.start - x."end", x.start - y."end") <= 30'),
    "purchase_clicks": """with e as (select *, epoch_us(ts)::double / 1e6::double as t from events) select user_id, purchase, click, round(d, 3) as apart from (
        select p.user_id, p.event_id as purchase, c.event_id as click, c.t - p.t as d, row_number() over (partition by p.event_id order by abs(c.t - p.t), c.t) as rn
        from e p join e c on p.user_id = c.user_id and p.event_type = 'purchase' and c.event_type = 'click' and abs(c.t - p.t) <= 3600) where rn = 1""",
    "nearest_pair": """with e as (select *, epoch_us(ts)::double / 1e6::double as t from events) select user_id, round(gap, 3) as gap, round(a, 3) as t1, round(b, 3) as t2 from (
        select p.user_id, abs(p.t - v.t) as gap, p.t as a, v.t as b, row_number() over (partition by p.user_id order by abs(p.t - v.t), p.t, v.t) as rn
        from e p join e v on p.user_id = v.user_id and p.event_type = 'purchase' and v.event_type = 'view') where rn = 1""",
    "merged_orders": f"""with {ORDER_INTERVALS}, m as (select *, case when start <= max("end") over (partition by o_custkey order by start, "end" rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from order_intervals)
        select o_custkey, min(start) as start, max("end") as "end" from (select *, sum(new) over (partition by o_custkey order by start, "end" rows unbounded preceding) as island from m) group by o_custkey, island""",
    "covered_ranges": f"""with {ORDER_INTERVALS}, m as (select *, case when start <= max("end") over (partition by o_custkey order by start, "end" rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from order_intervals),
        u as (select o_custkey, min(start) as s, max("end") as e from (select *, sum(new) over (partition by o_custkey order by start, "end" rows unbounded preceding) as island from m) group by o_custkey, island),
        q as (select o_orderkey as id, epoch_us(o_orderdate)::double / 86400e6::double + 3 as a, epoch_us(o_orderdate)::double / 86400e6::double + 3 + o_orderkey % 200 - 10 as b from orders)
        select id, case when b < a then false when a = b then exists (select 1 from order_intervals) else exists (select 1 from u where u.s <= q.a and u.e >= q.b) end as covered from q""",
    "before_after": f"""with {ORDER_INTERVALS} select x.o_custkey, x.o_orderkey as id, x.start, x."end", max(y.start) filter (y.start < x.start) as last_before, min(y.start) filter (y.start > x."end") as first_after,
        count(*) filter (y.start > x."end" and y.start <= x."end" + 365) as n_after from order_intervals x join order_intervals y on x.o_custkey = y.o_custkey group by 1, 2, 3, 4""",
}
