"""Loading checks, resume and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions import geometry as G
from trackloom.operators.evidence import failed_rules
from trackloom.operators.intervals import merged
from trackloom.sources import annotations as A
from trackloom.sources.tables import SAMPLES, samples, table
from trackloom.streaming.tracks import track_segments


def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.repeated(table(spark, sf_dir, "customer"), ("c_name", "c_nationkey")).select("rule", "key", F.col("detail").cast("long").alias("n"))


def row_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    rules = {"quantity": F.col("l_quantity") <= 45, "price": F.col("l_extendedprice") / F.col("l_quantity") >= 1000, "discount": F.col("l_discount") < 0.09, "line": F.col("l_linenumber").between(1, 6)}
    broken = failed_rules(line, rules).where(F.size("errors") > 0)
    return broken.groupBy(F.array_join("errors", ",").alias("errors")).agg(F.count("*").alias("n"), F.round(F.sum("l_tax"), 4).alias("tax"))


def label_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey")
    labels = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 700).cast("string").alias("query_id"), F.concat(F.lit("q"), F.col("o_custkey").cast("string")).alias("query"),
        F.when(i % 50 > 0, F.lit("V1")).alias("video_id"), F.lit("stopped").alias("event_type"), (i % 90).cast("double").alias("start_seconds"), F.lit(2.0).alias("end_seconds"),
        (i % 40 - 1).cast("double").alias("tolerance_seconds"), (F.col("o_custkey") % 9 == 0).alias("negative"))
    return A.label_errors(labels).groupBy("rule").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


def pending_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video_id"), "o_orderstatus")
    done = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("video_id")).distinct()
    return A.pending(planned, done).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("video_id").alias("ids"))


def activity_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [*A.ACTIVITY_EVENTS, "person_reads_document"]
    pick = F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % len(names) + 1).cast("int"))
    return A.mapped(table(spark, sf_dir, "events").select(pick.alias("label"))).groupBy("label", "event", "status").agg(F.count("*").alias("n"))


def sample_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("n"))
    fps = F.lit(30.0)
    return part.select("p_partkey", F.array_join(G.sample_grid(F.lit(0), F.col("n"), fps, F.lit(4.0)).cast("array<string>"), ",").alias("grid"), G.expected_samples(F.col("n"), fps, F.lit(4.0)).cast("long").alias("expected"),
                       G.source_frame(F.col("n") / 7, fps, F.col("n") * 3).cast("long").alias("frame"))


def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of each sample's box with a fixed one, in all three forms."""
    fixed = tuple(F.lit(v) for v in (10.0, 10.0, 40.0, 50.0))
    rows = samples(spark, sf_dir)
    forms = [F.round(G.iou(G.box(), fixed, k), 6).alias(k) for k in ("union_floor", "area_zero", "area_one")]
    return rows.select("track", F.round("t", 6).alias("t"), *forms, F.round(G.distance(G.box(), fixed, F.lit(40.0)), 6).alias("distance"))


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour names by medians over the lines of each order, taken as pixels."""
    line = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.percentile(F.col("l_suppkey") % 180, 0.5).alias("h"), F.percentile(F.col("l_quantity") * 5, 0.5).alias("s"), F.percentile(F.col("l_extendedprice") % 256, 0.5).alias("v"), F.count("*").alias("n"))
    return line.select("l_partkey", G.colour_name(F.col("h"), F.col("s"), F.col("v"), F.col("n") + 10).alias("colour"), F.col("n"))


def histogram_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """12 by 4 bins of hue and saturation for each supplier's lines, unit length: one row a filled bin."""
    h, s = F.floor((F.col("l_partkey") % 180) / 15).cast("long"), F.floor(F.least(F.col("l_quantity") * 5, F.lit(255)) / 64).cast("long")
    bins = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", (h * 4 + s).alias("bin")).agg(F.count("*").alias("n"))
    norm = bins.groupBy("l_suppkey").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return bins.join(norm, "l_suppkey").select("l_suppkey", "bin", F.round(F.col("n") / F.greatest(F.lit(1e-9), F.col("norm")), 6).alias("value"))


def set_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    b = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    one = lambda df, name: df.agg(F.lit(name).alias("side"), F.count("*").alias("n"), F.sum("id").alias("total"))
    return one(a.subtract(b), "left").unionByName(one(b.subtract(a), "right")).unionByName(one(a.intersect(b), "both"))


def session_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("track"), (F.col("user_id") % 8).alias("video_id"), F.col("ts").cast("timestamp").alias("ts"))
    return track_segments(events, 6 * 3600, 0).select("video_id", "track", "n", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"))


def error_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each kind of error: status, priority and nation of the customer."""
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    w = W.partitionBy("o_orderstatus", "o_orderpriority", "c_nationkey").orderBy("o_orderdate", "o_orderkey")
    return both.withColumn("place", F.row_number().over(w)).where("place = 1").select("o_orderstatus", "o_orderpriority", "c_nationkey", "o_orderkey")


def configuration_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by part size and return flag as columns, with the best line of each."""
    both = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    out = both.groupBy("p_size").pivot("l_returnflag", ["A", "N", "R"]).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("l_extendedprice"), 2).alias("best"))
    return out


def merged_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 86_400e6
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", day.alias("start"), (day + F.col("l_quantity") / 10).alias("end"))
    return merged(rows, ["l_suppkey"]).groupBy("l_suppkey").agg(F.count("*").alias("pieces"), F.round(F.sum(F.col("end") - F.col("start")), 4).alias("days"))


QUERIES = {f.__name__: f for f in (repeated_keys, row_errors, label_errors, pending_orders, activity_mapping, sample_grids, box_overlaps, colours, histogram_vectors, set_differences, session_segments, error_sample, configuration_pivot, merged_shipments)}

_AREA = "((x2 - x1) * (y2 - y1))"
_SH = "(greatest(0.0, least(x2, 40.0) - greatest(x1, 10.0)) * greatest(0.0, least(y2, 50.0) - greatest(y1, 10.0)))"
ORACLES = {
    "repeated_keys": "select 'repeated c_name' as rule, c_name as key, count(*) as n from customer group by 2 having count(*) > 1 union all select 'repeated c_nationkey', c_nationkey::varchar, count(*) from customer group by 2 having count(*) > 1",
    "row_errors": """with e as (select array_to_string(list_filter([case when not l_quantity <= 45 then 'quantity' end, case when not l_extendedprice / l_quantity >= 1000 then 'price' end, case when not l_discount < 0.09::double then 'discount' end, case when not l_linenumber between 1 and 6 then 'line' end], lambda x: x is not null), ',') as errors, l_tax from lineitem)
        select errors, count(*) as n, round(sum(l_tax), 4) as tax from e where errors <> '' group by 1""",
    "label_errors": """with l as (select (o_custkey % 700)::varchar as q, 'q' || o_custkey as t, case when o_orderkey % 50 > 0 then 'V1' end as v, o_orderkey % 90 as s, o_orderkey % 40 - 1 as tol, o_custkey % 9 = 0 as neg from orders),
        o as (select q, count(distinct t) as texts, bool_or(neg) as neg, count(*) as n from l group by 1),
        r as (select 'one text' as rule, q as key from o where texts > 1 union all select 'one negative row', q from o where neg and n > 1 union all select 'video and type', q from l where not neg and v is null union all select 'order', q from l where 2 < s union all select 'tolerance', q from l where tol < 0
          union all select 'enough queries', count(*)::varchar from o having count(*) < 30) select rule, count(*) as n, count(distinct key) as keys from r group by 1""",
    "pending_orders": "select o_orderstatus, count(*) as n, sum(o_orderkey)::bigint as ids from orders where o_orderkey not in (select l_orderkey from lineitem where l_linestatus = 'F') group by 1",
    "activity_mapping": "with m as (select unnest([{" + "}, {".join(f"'i': {i}, 'label': '{k}', 'event': '{v[0]}', 'status': '{v[1]}'" for i, (k, v) in enumerate(A.ACTIVITY_EVENTS.items())) + f"}}, {{'i': {len(A.ACTIVITY_EVENTS)}, 'label': 'person_reads_document', 'event': null, 'status': 'UNSUPPORTED'}}]) as m) select m.label as label, m.event as event, m.status as status, count(*) as n from events join m on m.i = event_id % {len(A.ACTIVITY_EVENTS) + 1} group by 1, 2, 3",
    "sample_grids": """select p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(range(0, ceil((p_size + 1) * 4.0 / 30.0)::bigint + 2), lambda i: round_even(i * 30.0 / 4.0, 0)::int), lambda f: f between 0 and p_size))), ',') as grid, ceil(p_size / 8.0)::bigint as expected,
        least(p_size * 3 - 1, greatest(0, round_even(p_size / 7 * 30.0::double, 0)::int))::bigint as frame from part""",
    "box_overlaps": f"""with {SAMPLES} select track, round(t, 6) as t, round({_SH} / greatest(1.0, {_AREA} + 1200.0 - {_SH}), 6) as union_floor, round({_SH} / (greatest(0.0, {_AREA}) + 1200.0 - {_SH}), 6) as area_zero, round({_SH} / (greatest(1.0, {_AREA}) + 1200.0 - {_SH}), 6) as area_one,
        round(sqrt(pow(25.0 - (x1 + x2) / 2, 2) + pow(30.0 - (y1 + y2) / 2, 2)) / 40.0, 6) as distance from samples""",
    "colours": """with m as (select l_partkey, median(l_suppkey % 180) as h, median(l_quantity * 5) as s, median(l_extendedprice % 256) as v, count(*) as n from lineitem group by 1)
        select l_partkey, case when n + 10 < 30 then 'unknown' when v < 45 then 'black' when s < 35 then case when v > 190 then 'white' else 'gray' end when h < 12 or h > 170 then 'red' when h < 35 then 'yellow' when h < 85 then 'green' when h < 130 then 'blue' else 'purple' end as colour, n from m""",
    "histogram_vectors": """with b as (select l_suppkey, (floor((l_partkey % 180) / 15) * 4 + floor(least(l_quantity * 5, 255) / 64))::bigint as bin, count(*) as n from lineitem group by 1, 2), m as (select l_suppkey, sqrt(sum(n * n)) as norm from b group by 1) select l_suppkey, bin, round(n / greatest(1e-9, norm), 6) as value from b join m using (l_suppkey)""",
    "set_differences": """with a as (select distinct o_custkey as id from orders), b as (select c_custkey as id from customer where c_acctbal > 0) select 'left' as side, count(*) as n, sum(id)::bigint as total from (select id from a except select id from b) union all select 'right', count(*), sum(id)::bigint from (select id from b except select id from a)
        union all select 'both', count(*), sum(id)::bigint from (select id from a intersect select id from b)""",
    "session_segments": """with c as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 6 hour then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts) as seg from c)
        select user_id % 8 as video_id, user_id as track, count(*) as n, epoch_us(min(ts)) as start, epoch_us(max(ts)) as "end" from s group by user_id, seg""",
    "error_sample": """select o_orderstatus, o_orderpriority, c_nationkey, o_orderkey from (select *, row_number() over (partition by o_orderstatus, o_orderpriority, c_nationkey order by o_orderdate, o_orderkey) as place from orders join customer on o_custkey = c_custkey) where place = 1""",
    "configuration_pivot": """select p_size, """ + ", ".join(f"nullif(count(*) filter (l_returnflag = '{f}'), 0) as \"{f}_n\", round(max(l_extendedprice) filter (l_returnflag = '{f}'), 2) as \"{f}_best\"" for f in "ANR") + " from lineitem join part on l_partkey = p_partkey group by 1",
    "merged_shipments": """with r as (select l_suppkey, epoch_us(l_shipdate)::double / 86400e6::double as a, epoch_us(l_shipdate)::double / 86400e6::double + l_quantity / 10 as b from lineitem), m as (select *, case when a <= max(b) over (partition by l_suppkey order by a, b rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from r),
        u as (select l_suppkey, min(a) as a, max(b) as b from (select *, sum(new) over (partition by l_suppkey order by a, b rows unbounded preceding) as i from m) group by l_suppkey, i) select l_suppkey, count(*) as pieces, round(sum(b - a), 4) as days from u group by 1""",
}
