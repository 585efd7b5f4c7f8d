"""Summary queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators import reports as R
from trackloom.operators.runs import gap_summary
from trackloom.sources.annotations import flat_report
from trackloom.sources.tables import ORDER_INTERVALS, SAMPLES, order_intervals, samples, table


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("investigation"), F.col("o_orderstatus").alias("category"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("start"), F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("title"))
    return R.report_lines(orders)


def track_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.track_totals(gap_summary(samples(spark, sf_dir), 12.0))
    return out.withColumn("median_duration", F.round("median_duration", 5))


def control_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda c: F.datediff(F.col(c), F.lit("1992-01-01").cast("timestamp_ntz")).cast("double")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("video_id"), F.col("o_orderkey").alias("id"), day("o_orderdate").alias("start"), (day("o_orderdate") + 60).alias("end"), "o_orderstatus")
    windows, labels, rest = (orders.where(F.col("o_orderstatus") == s) for s in ("F", "O", "P"))
    free = R.outside_windows(windows, labels)
    return R.inside_windows(rest, free).select("video_id", "id")


def merge_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    merges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") * 3).alias("b")).distinct()
    actors = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("track"), (F.col("p_size") % 3).alias("actor"))
    return R.merge_correctness(merges, actors).groupBy("verdict").agg(F.count("*").alias("n"))


def best_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("case_id"), F.col("l_returnflag").alias("config"), F.col("l_discount").alias("iou"), F.col("l_extendedprice").alias("confidence"))
    best = R.best_by_configuration(hits)
    return best.join(R.memberships(hits, "case_id", "config"), "case_id")


def case_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "lineitem").select("l_shipdate", "l_linestatus", (F.col("l_quantity") > 10).alias("detected"), (F.col("l_discount") > 0.02).alias("tracked"), (F.col("l_tax") > 0.03).alias("matched"))
    return R.funnel(cases, ["detected", "tracked", "matched"], ["l_linestatus"])


def failure_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = R.failure_stage({"detected": "not detected", "tracked": "not tracked", "matched": "not matched"})
    cases = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") > 10).alias("detected"), (F.col("l_discount") > 0.02).alias("tracked"), (F.col("l_tax") > 0.03).alias("matched"))
    return cases.groupBy("l_returnflag", stage.alias("stage")).agg(F.count("*").alias("n"))


def diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("kind"), (F.col("l_linestatus") == "O").alias("matched"), F.col("l_quantity").alias("start_error"), F.lit(0.0).alias("end_error"), F.col("l_discount").alias("coverage"))
    out = R.diagnosis(rows)
    return out.select("kind", "labels", "matched", *[F.round(c, 6).alias(c) for c in ("recall", "start_error", "median_start_error", "coverage", "success")])


def dataset_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("state"), F.when(F.col("o_orderstatus") == "F", "visible").otherwise("hidden").alias("visibility"), F.col("o_custkey").alias("object_id"), (F.col("o_totalprice") > 1000).alias("certain"))
    return R.dataset_status(rows)


def reappearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400e6).alias("place"), F.col("event_type").alias("class"))
    return R.reappearances(rows.groupBy("user_id", "place").agg(F.min("class").alias("class")), ["user_id"])


def contact_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, c = table(spark, sf_dir, "lineitem"), F.col
    limit = R.contact_limit(c("l_partkey") % 5, c("l_suppkey") % 4, c("l_orderkey") % 6, c("l_linenumber") - 1, c("l_linestatus") == "O", c("l_quantity") < 20)
    return li.select("l_returnflag", limit.alias("limit")).groupBy("l_returnflag", "limit").agg(F.count("*").alias("n"))


def manipulation_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, c = table(spark, sf_dir, "lineitem"), F.col
    stage = R.manipulation_failure(c("l_partkey") % 5 == 0, c("l_suppkey") % 4 > 0, c("l_orderkey") % 3 > 0, c("l_linestatus"), c("l_linenumber") > 2, c("l_quantity") > 20, c("l_discount") > 0.03, c("l_returnflag"))
    return li.select(stage.alias("stage")).groupBy("stage").agg(F.count("*").alias("n"))


def vehicle_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as labels with made-up tracks, two candidates each."""
    li, c = table(spark, sf_dir, "lineitem"), F.col
    start, end = (c("l_orderkey") % 50).cast("double"), (c("l_orderkey") % 50 + 3).cast("double")
    number = lambda x: x.cast("double")
    m = F.struct((c("l_partkey") % 20).alias("sample_count"), number(c("l_suppkey") % 9).alias("track_duration"), (c("l_quantity") / 10).cast("double").alias("longest_gap"), number(c("l_partkey") % 60).alias("track_start"), number(c("l_partkey") % 60 + 8).alias("track_end"),
                 number(c("l_linenumber") % 3).alias("stationary_before"), number(c("l_linenumber") % 4).alias("stationary_after"), F.when(c("l_partkey") % 3 > 0, c("l_discount") * 5).alias("speed_before"), (c("l_tax") * 5).alias("speed_after"),
                 (c("l_tax") * 4).alias("speed_event_first_half"), F.when(c("l_suppkey") % 2 > 0, c("l_discount") * 4).alias("speed_event_second_half"))
    candidate = lambda kind, at: F.struct(F.lit(kind).alias("kind"), number(at).alias("start"), number(at + 2).alias("end"))
    candidates = F.concat(F.when(c("l_partkey") % 4 == 0, F.array(candidate("stopped", c("l_partkey") % 50))).otherwise(F.array().cast("array<struct<kind:string,start:double,end:double>>")),
                          F.when(c("l_suppkey") % 3 == 0, F.array(candidate("started_moving", c("l_suppkey") % 50))).otherwise(F.array().cast("array<struct<kind:string,start:double,end:double>>")))
    reason = R.vehicle_failure(m, c("l_returnflag") == "N", candidates, start, end, c("l_linestatus") == "O")
    return li.select("l_returnflag", reason.alias("reason")).groupBy("l_returnflag", "reason").agg(F.count("*").alias("n"))


def review_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against the next order key: matches, false positives and misses, flat as for CSV."""
    orders = order_intervals(spark, sf_dir).select("o_custkey", "o_orderkey", "start", "end")
    p = orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("prediction"), "o_custkey", "start", "end", F.array("o_custkey").alias("supporting_tracks"))
    q = orders.where("o_orderkey % 3 = 1").select(F.col("o_orderkey").alias("label"), "o_custkey", "start", "end")
    both = p.select("prediction").join(q.select("label"), F.col("prediction") + 1 == F.col("label"), "full")
    kind = F.when(F.col("label").isNull(), "false_positive").when(F.col("prediction").isNull(), "false_negative").otherwise("match")
    pairs = both.select("prediction", "label", kind.alias("kind"), F.when(F.col("prediction") % 2 == 0, 0.5).alias("spatial"))
    reasons = spark.createDataFrame([("false_positive", "no label"), ("false_negative", "no prediction")], "kind string, reason string")
    rows = flat_report(R.review_records(p, q, pairs, reasons))
    return rows.select("kind", "reason", "prediction_prediction", "prediction_o_custkey", "ground_truth_label", "ground_truth_o_custkey", *[F.round(c, 6).alias(c) for c in ("temporal_iou", "start_error", "end_error", "spatial_iou")])


QUERIES = {f.__name__: f for f in (contact_limits, manipulation_failures, vehicle_failures, review_records, report_lines, track_totals, control_windows, merge_verdicts, best_hits, case_funnel, failure_stages, diagnosis, dataset_status, reappearances)}

_CASES = "(select *, l_quantity > 10 as d, l_discount > 0.02::double as t, l_tax > 0.03::double as m from lineitem)"
ORACLES = {
    "contact_limits": """select l_returnflag, case when l_partkey % 5 = 0 then 'A_PERSON_DETECTION_ABSENT' when l_suppkey % 4 = 0 then 'B_HAND_VISIBILITY_LIMIT' when l_orderkey % 6 = 0 then 'C_CONTACT_VISIBILITY_LIMIT' when l_linenumber = 1 then 'D_TEMPORAL_SPARSITY_2FPS'
        when l_linestatus <> 'O' then 'E_FALSE_PROGRESSION_REJECTED' when l_quantity < 20 then 'F_SUB_40PX_RESOLUTION_AMBIGUOUS' else 'G_SUCCESSFUL_CONTACT_DETECTION' end as "limit", count(*) as n from lineitem group by all""",
    "manipulation_failures": """select case when l_partkey % 5 = 0 then 'MATCHED' when l_suppkey % 4 = 0 then 'DETECTION_ABSENCE' when l_orderkey % 3 = 0 then 'UNSUPPORTED_CLASS_' || l_linestatus when l_linenumber <= 2 then 'TRACKLET_INSTABILITY' when l_quantity <= 20 then 'ASSOCIATION_FAILURE'
        when not l_discount > 0.03::double then 'INTERACTION_RULE_' || l_returnflag else 'TEMPORAL_WINDOW_MISMATCH' end as stage, count(*) as n from lineitem group by all""",
    "vehicle_failures": """with v as (select *, l_returnflag = 'N' as starts, (l_orderkey % 50)::double as s, (l_orderkey % 50 + 3)::double as e, case when l_returnflag = 'N' then l_suppkey % 3 = 0 else l_partkey % 4 = 0 end as any_c, (case when l_returnflag = 'N' then l_suppkey else l_partkey end % 50)::double as ca from lineitem)
        select l_returnflag, case when l_linestatus = 'O' then 'MATCHED' when any_c and ca <= e + 2 and ca + 2 >= s - 2 then 'EVENT_BOUNDARY_OR_SPATIAL_MISMATCH' when any_c then 'TEMPORAL_WINDOW_MISMATCH' when l_partkey % 20 < 7 or l_suppkey % 9 < 3 then 'INSUFFICIENT_TRACK_DURATION' when l_quantity / 10 > 1.5 then 'DETECTION_GAP'
          when starts and (l_partkey % 60 > s + 1 or l_linenumber % 3 < 1) then 'NO_STATIONARY_PRECEDING_START' when starts and greatest(case when l_suppkey % 2 > 0 then l_discount * 4 else 0 end, l_tax * 5) < 0.28::double then 'NO_SUSTAINED_MOVEMENT' when starts then 'RULE_ABSTENTION'
          when l_partkey % 60 + 8 < e - 1 or l_linenumber % 4 < 1 then 'NO_STATIONARY_AFTER_STOP' when greatest(case when l_partkey % 3 > 0 then l_discount * 5 else 0 end, l_tax * 4) < 0.28::double then 'MOVEMENT_TOO_SLOW_OR_UNOBSERVED' else 'RULE_ABSTENTION' end as reason, count(*) as n from v group by all""",
    "review_records": f"""with {ORDER_INTERVALS}, p as (select * from order_intervals where o_orderkey % 3 = 0), q as (select * from order_intervals where o_orderkey % 3 = 1)
        select case when q.o_orderkey is null then 'false_positive' when p.o_orderkey is null then 'false_negative' else 'match' end as kind, case when q.o_orderkey is null then 'no label' when p.o_orderkey is null then 'no prediction' end as reason, p.o_orderkey as prediction_prediction, p.o_custkey as prediction_o_custkey,
          q.o_orderkey as ground_truth_label, q.o_custkey as ground_truth_o_custkey, round(case when p.start is null or q.start is null then null when greatest(p."end", q."end") - least(p.start, q.start) > 0 then greatest(0, least(p."end", q."end") - greatest(p.start, q.start)) / (greatest(p."end", q."end") - least(p.start, q.start))
            when greatest(p."end", q."end") = least(p.start, q.start) then (p.start = q.start)::int else 0 end, 6) as temporal_iou, round(abs(p.start - q.start), 6) as start_error, round(abs(p."end" - q."end"), 6) as end_error, case when p.o_orderkey is not null and q.o_orderkey is not null then case when p.o_orderkey % 2 = 0 then 0.5 else 0.0 end end::double as spatial_iou
        from p full join q on p.o_orderkey + 1 = q.o_orderkey""",
    "report_lines": """select o_custkey as investigation, o_orderstatus as category, count(*) as n, string_agg(strftime(o_orderdate, '%Y-%m-%d') || ' | ' || o_orderpriority, chr(10) order by o_orderdate, o_orderkey) as report from orders group by 1, 2""",
    "track_totals": f"""with {SAMPLES}, g as (select video_id, track, max(t) - min(t) as d, count(*) filter (gap > 12) as gaps, count(*) >= 2 as p from (select *, t - lag(t) over (partition by video_id, track order by t) as gap from samples) group by 1, 2)
        select video_id, count(*) as tracks, count(*) filter (not p) as tentative, count(*) filter (p) as persistent, round(median(d), 5) as median_duration, sum(gaps)::bigint as gaps from g group by rollup (video_id)""",
    "control_windows": """with o as (select o_custkey as v, o_orderkey as id, date_diff('day', date '1992-01-01', o_orderdate::date)::double as s, o_orderstatus as st from orders), w as (select * from o where st = 'F' and not exists (select 1 from o x where x.st = 'O' and x.v = o.v and o.s < x.s + 60 and x.s < o.s + 60))
        select v as video_id, id from o where st = 'P' and exists (select 1 from w where w.v = o.v and o.s >= w.s and o.s <= w.s + 60)""",
    "merge_verdicts": """with m as (select distinct l_partkey as a, l_suppkey * 3 as b from lineitem), p as (select p_partkey as k, p_size % 3 as actor from part where p_size > 10)
        select case when x.actor is null or y.actor is null then 'UNANNOTATED' when x.actor = y.actor then 'CORRECT' else 'INCORRECT' end as verdict, count(*) as n from m left join p x on x.k = a left join p y on y.k = b group by 1""",
    "best_hits": """select l_partkey as case_id, (max({'i': l_discount, 'c': l_extendedprice, 'f': l_returnflag})).f as config, max(l_discount) as iou, (max({'i': l_discount, 'c': l_extendedprice, 'f': l_returnflag})).c as confidence, count(distinct l_returnflag) as configs,
        string_agg(distinct l_returnflag, ';' order by l_returnflag) as strategies from lineitem group by 1""",
    "case_funnel": f"select l_linestatus, count(*) as cases, count(*) filter (d) as detected, count(*) filter (d and t) as tracked, count(*) filter (d and t and m) as matched from {_CASES} group by 1",
    "failure_stages": f"select l_returnflag, case when not d then 'not detected' when not t then 'not tracked' when not m then 'not matched' else 'success' end as stage, count(*) as n from {_CASES} group by 1, 2",
    "diagnosis": """select l_returnflag as kind, count(*) as labels, count(*) filter (l_linestatus = 'O') as matched, round(count(*) filter (l_linestatus = 'O') / count(*), 6) as recall, round(avg(l_quantity) filter (l_linestatus = 'O'), 6) as start_error, round(median(l_quantity) filter (l_linestatus = 'O'), 6) as median_start_error,
        round(avg(l_discount), 6) as coverage, round(count(*) filter (l_linestatus = 'O' and l_discount > 0) / count(*) filter (l_discount > 0), 6) as success from lineitem group by 1""",
    "dataset_status": "select o_orderpriority as state, count(*) as frames, count(*) filter (o_orderstatus = 'F') as visible, count(*) filter (not o_totalprice > 1000) as uncertain, count(distinct o_custkey) as objects from orders group by 1",
    "reappearances": """with d as (select user_id, floor(epoch_us(ts)::double / 86400e6::double)::bigint as place, min(event_type) as k from events group by 1, 2), g as (select *, place - lag(place) over (partition by user_id order by place) > 1 as gap from d)
        select user_id, count(*) filter (gap) as reappearances, count(distinct k) > 1 as class_changes from g group by 1""",
}
