"""Star joins, timelines, integrity, graphs, associations and vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.geometry import dot
from trackloom.operators import evidence as E
from trackloom.operators.search import top
from trackloom.plans.durable import stored
from trackloom.sources.tables import table


def serialised_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    orders = t("orders")
    events = orders.select(F.col("o_orderkey").alias("event_id"), F.col("o_orderkey").alias("evidence_id"), (F.col("o_custkey") % 25).alias("camera_id"), "o_orderpriority")
    first = t("lineitem").groupBy("l_orderkey").agg(F.max("l_suppkey").alias("primary_id"))
    evidence = first.select(F.col("l_orderkey").alias("evidence_id"), (F.col("l_orderkey") % 100).alias("video_id"), "primary_id")
    videos = t("supplier").select(F.col("s_suppkey").alias("video_id"), "s_name")
    cameras = t("nation").select(F.col("n_nationkey").alias("camera_id"), F.col("n_regionkey").alias("location_id"), "n_name")
    locations = t("region").select(F.col("r_regionkey").alias("location_id"), "r_name")
    members = t("lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("entity_id")).distinct()
    out = E.serialised(events, evidence, videos, cameras, locations, members)
    return out.select("event_id", "s_name", "n_name", "r_name", "o_orderpriority", F.array_join(F.col("entities").cast("array<string>"), ",").alias("entities"))


def entity_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("start"), "event_type")
    members = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("entity_id"))
    return E.timeline(events, members).select("entity_id", "event_id", "event_type", "place", F.round("since", 3).alias("since"))


def chain_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders, part = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "part"))
    line = stored(line.groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_suppkey", "l_partkey", "l_quantity", "l_discount")]))  # read as events, evidence and members
    ident, n, t0 = F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.col("l_linenumber"), F.col("l_quantity") / 25
    clock = lambda t, late: F.timestamp_micros(F.col("l_partkey") * 1_000_000 + F.round(t * 1e6).cast("long") + F.when(late, 1).otherwise(0))
    t1 = t0 + F.col("l_discount")
    events = line.select(ident.alias("event_id"), ident.alias("evidence_id"), (F.col("l_suppkey") % 10).alias("camera_id"), clock(t0, n == 7).alias("start_ts"), clock(t1, n == 6).alias("end_ts"))
    f0, f1, method = F.col("l_quantity").cast("long"), (F.col("l_quantity") + n).cast("long"), F.when(n == 4, "").otherwise("m")
    signed = E.signature(f1, f0, method, F.sha2(F.col("l_partkey").cast("string"), 256), F.col("l_partkey"))
    evidence = line.where("l_quantity > 2").select(
        ident.alias("ev_id"), F.col("l_orderkey").alias("ev_observation"), F.col("l_partkey").alias("ev_video"), f0.alias("ev_f0"), f1.alias("ev_f1"), t0.alias("ev_t0"), t1.alias("ev_t1"),
        method.alias("ev_method"), F.when(n == 5, "x").otherwise(signed).alias("ev_sha256"))
    customer = F.col("o_custkey")
    observations = orders.select(F.col("o_orderkey").alias("ob_id"), (customer % 200).alias("ob_video"), customer.alias("ob_track"), customer.alias("ob_entity"))
    c = F.col("c_custkey")
    tracks = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(c.alias("tr_id"), (c % 200).alias("tr_video"), F.when(c % 3 == 0, c + 1).otherwise(c).alias("tr_entity"))
    p = F.col("p_partkey")
    videos = part.select(p.alias("vi_id"), F.col("p_size").cast("long").alias("vi_frames"), (p % 10).alias("vi_camera"), F.lit(25.0).alias("vi_fps"), (F.col("p_size") / 25).alias("vi_duration"), F.timestamp_micros(p * 1_000_000).alias("vi_start"), F.sha2(p.cast("string"), 256).alias("vi_sha256"))
    members = line.select(ident.alias("event_id"), (F.col("l_partkey") % 150).alias("entity_id"))
    found = E.integrity(events, evidence, observations, tracks, videos, members)
    return found.select("event_id", F.size("errors").cast("long").alias("n_errors"), F.array_join("errors", ",").alias("errors"))


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    made = E.signature(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_returnflag"), F.sha2(F.col("l_linestatus"), 256), F.col("l_partkey"))
    return line.select("l_orderkey", "l_linenumber", made.alias("signature"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    unit = F.transform(v, lambda x: x / F.sqrt(dot(v, v)))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("model"), unit.alias("vector"))


def vector_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    asked = vectors.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return E.vector_search(asked, vectors, 0.0, 10).select("query_id", "vec_id", F.round("cosine", 6).alias("cosine"), "rank")


def appearance_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the observations whose vectors are like every hundredth vector: orders as events and evidence,
    their customers' numbers as observations."""
    vectors = _vectors(spark, sf_dir).withColumn("observation_id", F.col("vec_id") % 400)
    asked = vectors.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id").drop("observation_id")
    orders = table(spark, sf_dir, "orders")
    evidence = orders.select(F.col("o_orderkey").alias("evidence_id"), F.col("o_custkey").alias("observation_id"))
    found = orders.select(F.col("o_orderkey").alias("event_id"), F.col("o_orderkey").alias("evidence_id"), F.col("o_orderdate").alias("start"))
    return E.appearance_search(asked, vectors, evidence, found, 0.1, 30)


def associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    things = _vectors(spark, sf_dir).select(
        i.alias("id"), (i % 5).alias("camera"), F.col("model").alias("kind"), F.element_at(F.array(*map(F.lit, ("red", "blue", "unknown"))), (i % 3 + 1).cast("int")).alias("colour"),
        (i * 13 % 1000).cast("double").alias("start"), (i * 13 % 1000 + 20).cast("double").alias("end"), "vector")
    links = table(spark, sf_dir, "region").alias("a").join(table(spark, sf_dir, "region").alias("b"), F.col("a.r_regionkey") < F.col("b.r_regionkey")).select(
        F.col("a.r_regionkey").alias("camera"), F.col("b.r_regionkey").alias("other"), F.lit(10.0).alias("min_s"), F.lit(400.0).alias("max_s"))
    out = E.associations(things.where("id % 100 = 0"), things, links, keep=0.0)
    return out.select("source", "candidate", "compatible", F.round("cosine", 6).alias("cosine"), F.round("score", 6).alias("score"), "label")


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    node = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    nodes = {"region": t("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("label")), "nation": t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label")),
             "customer": t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"))}
    edges = {"located_at": t("nation").select(node("nation", "n_nationkey").alias("source"), node("region", "n_regionkey").alias("target")),
             "belongs_to": t("customer").select(node("customer", "c_custkey").alias("source"), node("nation", "c_nationkey").alias("target")),
             "observed_at": t("orders").select(node("order", "o_orderkey").alias("source"), node("customer", "o_custkey").alias("target"))}
    n, e = E.graph(nodes, edges)
    return e.join(n.select(F.col("id").alias("target"), F.col("kind").alias("target_kind"), "label"), "target", "left").select("source", "target", "relation", "target_kind", "label")


def _case_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as entities, orders as events (each its own evidence), nations as cameras, regions as locations."""
    t, text = lambda n: table(spark, sf_dir, n), lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    entities = t("customer").select(text("c", "c_custkey").alias("id"), F.col("c_mktsegment").alias("object_type"), text("n", "c_nationkey").alias("camera_id"))
    orders = t("orders")
    events = orders.select(text("o", "o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("event_type"), F.lit("INFERRED").alias("category"), F.concat(F.lit("n"), F.col("o_custkey") % 25).alias("camera_id"), text("v", "o_orderkey").alias("evidence_id"), F.col("o_orderdate").alias("start"))
    members = orders.select(text("o", "o_orderkey").alias("event_id"), F.explode(F.array(text("c", "o_custkey"), F.concat(F.lit("c"), F.col("o_orderkey") % 97))).alias("entity_id")).distinct()
    relations = orders.where("o_orderkey % 5 = 0").select(text("c", "o_custkey").alias("source_id"), F.concat(F.lit("c"), F.col("o_orderkey") % 97).alias("target_id"), F.lit("met").alias("relation"), F.lit("CORRELATED").alias("category"), F.concat(F.lit("v"), F.col("o_orderkey") % 1000).alias("evidence_id"))
    return E.evidence_graph(entities, events, members, t("nation").select(text("n", "n_nationkey").alias("id"), F.col("n_name").alias("name"), text("r", "n_regionkey").alias("location_id")), t("region").select(text("r", "r_regionkey").alias("id"), F.col("r_name").alias("name")), relations)


def case_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges with the kind and label of both ends."""
    nodes, edges = _case_graph(spark, sf_dir)
    end = lambda side: nodes.select(F.col("id").alias(side), F.col("kind").alias(f"{side}_kind"), F.col("label").alias(f"{side}_label"))
    return edges.join(end("source"), "source", "left").join(end("target"), "target", "left")


def case_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shown around every tenth customer, and their direct edges counted."""
    nodes, edges = _case_graph(spark, sf_dir)
    around, direct = E.neighbourhood(nodes, edges, table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id")))
    return around.unionByName(direct.groupBy("id").agg(F.count("*").alias("n")).select("id", F.lit("direct").alias("event"), F.col("n").cast("string").alias("other")))


def two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("entity_id"))
    return E.neighbours(members)


def touching_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"))
    return E.touching(edges, table(spark, sf_dir, "part").where("p_size = 7").select(F.col("p_partkey").alias("id")))


def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.agg(F.count_distinct("user_id").alias("tracks"), F.count("*").alias("events"), F.count_distinct("event_type").alias("kinds"), F.round(F.sum(F.when(F.col("event_type") == "view", F.col("value"))), 2).alias("viewed"))


def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    return top(events, "event_type", 6, F.desc("t"), F.col("event_id")).select("event_type", "event_id", "t", "rank")


QUERIES = {"serialised_orders": serialised_orders, "entity_timeline": entity_timeline, "chain_integrity": chain_integrity, "signatures": signatures, "vector_top": vector_top, "appearance_top": appearance_top, "associations": associations,
           "graph_edges": graph_edges, "case_graph": case_graph, "case_neighbourhood": case_neighbourhood, "two_hops": two_hops, "touching_edges": touching_edges, "overview": overview, "latest_events": latest_events}

_UNIT = "v as (select vec_id, label::varchar as model, list_transform(embedding::double[], lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[]))) as vector from embeddings)"
_CASE = """ev as (select *, row_number() over (order by o_orderdate, 'o' || o_orderkey) <= 200 as shown from orders),
    nodes as (select 'c' || c_custkey as id, 'c' || c_custkey as label, c_mktsegment as kind from customer union all select 'n' || n_nationkey, n_name, 'camera' from nation union all select 'r' || r_regionkey, r_name, 'location' from region union all select 'o' || o_orderkey, o_orderpriority, 'event' from ev where shown),
    edges as (select 'n' || n_nationkey as source, 'r' || n_regionkey as target, 'located_at' as label, 'OBSERVED' as category, null as evidence_id, null as event_id from nation
      union all select 'c' || c_custkey, 'n' || c_nationkey, 'observed_at', 'OBSERVED', null, null from customer
      union all select distinct e, 'o' || o_orderkey, o_orderstatus, 'INFERRED', 'v' || o_orderkey, null from (select *, unnest(['c' || o_custkey, 'c' || (o_orderkey % 97)]) as e from ev where shown)
      union all select 'c' || r.o_custkey, 'c' || (r.o_orderkey % 97), 'met', 'CORRELATED', 'v' || (r.o_orderkey % 1000), 'o' || e.o_orderkey from orders r left join orders e on e.o_orderkey = r.o_orderkey % 1000 where r.o_orderkey % 5 = 0)"""
ORACLES = {
    "case_graph": f"with {_CASE} select e.*, a.kind as source_kind, a.label as source_label, b.kind as target_kind, b.label as target_label from edges e left join nodes a on a.id = e.source left join nodes b on b.id = e.target",
    "case_neighbourhood": f"""with {_CASE}, me as (select 'c' || c_custkey as id from customer where c_custkey % 10 = 0), i as (select distinct source, target from edges join nodes on id = target and kind = 'event'),
        own as (select me.id, target as event from me join i on source = id), ar as (select own.id, event, source as other from own join i on target = event and source <> own.id join nodes n on n.id = source)
        select distinct * from ar union all select id, event, null from own where not exists (select 1 from ar where ar.id = own.id and ar.event = own.event)
        union all select me.id, 'direct', count(*)::varchar from me join edges on event_id is not null and (source = me.id or target = me.id) group by 1""",
    "serialised_orders": """with m as (select l_orderkey, l_suppkey, min(l_linenumber) as ln from lineitem group by all), p as (select l_orderkey, max(l_suppkey) as prim from lineitem group by 1)
        select o_orderkey as event_id, s_name, n_name, r_name, o_orderpriority, coalesce(string_agg(m.l_suppkey::varchar, ',' order by m.l_suppkey <> prim, m.l_suppkey), '') as entities
        from orders left join p on p.l_orderkey = o_orderkey left join m on m.l_orderkey = o_orderkey left join supplier on s_suppkey = p.l_orderkey % 100 left join nation on n_nationkey = o_custkey % 25 left join region on r_regionkey = n_regionkey group by 1, 2, 3, 4, 5""",
    "entity_timeline": """select user_id as entity_id, event_id, event_type, row_number() over w as place, round(epoch_us(ts)::double / 1e6::double - lag(epoch_us(ts)::double / 1e6::double) over w, 3) as since from events window w as (partition by user_id order by ts, event_id)""",
    "chain_integrity": """with c as (select l_orderkey * 10 + l_linenumber as event_id, l_suppkey % 10 as camera_id, l_quantity > 2 as has, o.*, c_custkey, c_custkey % 200 as tv, p_partkey, p_size, p_partkey % 10 as pc, l_partkey, l_quantity as q, l_linenumber as ln, l_discount as d, o_custkey % 200 as ov
          from (select l_orderkey, l_linenumber, min(l_suppkey) as l_suppkey, min(l_partkey) as l_partkey, min(l_quantity) as l_quantity, min(l_discount) as l_discount from lineitem group by 1, 2) left join orders o on o_orderkey = l_orderkey and l_quantity > 2 left join customer on c_custkey = o_custkey and c_acctbal > 0 left join part on p_partkey = l_partkey and l_quantity > 2),
        ob as (select o_custkey % 200 as v, o_custkey as e, count(*) as n, count(*) filter (c_custkey is null or c_custkey % 3 = 0) as bad from orders left join customer on c_custkey = o_custkey and c_acctbal > 0 group by 1, 2),
        f as (select event_id, list_filter([case when not has then 'evidence' end, case when not has or o_orderkey is null then 'observation' end, case when c_custkey is null then 'track' end, case when p_partkey is null then 'video' end,
          case when not (has and ln <> 4) then 'method' end, case when not (has and p_partkey is not null and ln <> 5) then 'signature' end,
          case when not coalesce(has and ov = l_partkey, false) then 'same_video' end, case when not coalesce(has and tv = l_partkey, false) then 'track_video' end, case when not has then 'frames_ordered' end,
          case when not coalesce(has and q >= 0 and (q + ln)::bigint < p_size, false) then 'frames_inside' end, case when not coalesce(has and q / 25::double + d <= p_size / 25::double, false) then 'times_inside' end,
          case when not coalesce(has and p_partkey is not null and abs(q::bigint / 25.0::double - q / 25::double) <= 1 / 25.0::double + 1e-6::double, false) then 'start_agrees' end,
          case when not coalesce(has and p_partkey is not null and abs((q + ln)::bigint / 25.0::double - (q / 25::double + d)) <= 1 / 25.0::double + 1e-6::double, false) then 'end_agrees' end,
          case when not (has and p_partkey is not null and ln <> 7) then 'start_clock' end, case when not (has and p_partkey is not null and ln <> 6) then 'end_clock' end,
          case when not coalesce(camera_id = pc, false) then 'camera' end, case when not (has and coalesce(n, 0) > 0) then 'participants' end, case when not coalesce(has and n > 0 and bad = 0, false) then 'participants_agree' end], lambda x: x is not null) as e
          from c left join ob on ob.v = l_partkey and ob.e = l_partkey % 150)
        select event_id, len(e) as n_errors, array_to_string(e, ',') as errors from f""",
    "signatures": """select l_orderkey, l_linenumber, sha256('{"frame_end": ' || l_orderkey || ', "frame_start": ' || l_linenumber || ', "method": "' || l_returnflag || '", "source_sha256": "' || sha256(l_linestatus) || '", "video": "' || l_partkey || '"}') as signature from lineitem""",
    "appearance_top": f"""with {_UNIT}, f as (select o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) as event_id from orders group by 1),
        s as (select q.vec_id as query_id, v.vec_id, event_id, list_dot_product(q.vector, v.vector) as c from v q join v using (model) join f on o_custkey = v.vec_id % 400 where q.vec_id % 100 = 0),
        r as (select *, round(c, 4) as score, count(*) over (partition by query_id) as total, row_number() over (partition by query_id order by round(c, 4) desc, vec_id) as rank from s where c >= 0.1)
        select query_id, event_id, score, rank, total from r where rank <= 30""",
    "vector_top": f"""with {_UNIT}, s as (select q.vec_id as query_id, v.vec_id, list_dot_product(q.vector, v.vector) as cosine from v q join v using (model) where q.vec_id % 100 = 0)
        select query_id, vec_id, round(cosine, 6) as cosine, rank from (select *, row_number() over (partition by query_id order by cosine desc, vec_id) as rank from s where cosine >= 0) where rank <= 10""",
    "associations": f"""with {_UNIT}, t as (select vec_id as id, vec_id % 5 as camera, model, list_value('red', 'blue', 'unknown')[(vec_id % 3 + 1)::int] as colour, (vec_id * 13 % 1000)::double as a, (vec_id * 13 % 1000 + 20)::double as b, vector from v),
        p as (select s.id as source, e.id as candidate, coalesce(s.camera < e.camera and greatest(e.a - s.b, s.a - e.b) between 10 and 400, false) as compatible, greatest(0, list_dot_product(s.vector, e.vector)) as cosine,
              s.colour = e.colour and s.colour <> 'unknown' as same from t s join t e on s.model = e.model and s.camera <> e.camera and s.id % 100 = 0),
        r as (select *, 0.5::double * cosine + 0.2::double * same::int + 0.3::double * compatible::int as score, not compatible or cosine < 0 as rejected from p),
        k as (select *, max(score) filter (not rejected) over (partition by source) as best, row_number() over (partition by source order by rejected, -score, candidate) as place from r),
        z as (select *, max(score) filter (place = 2 and not rejected) over (partition by source) as second from k)
        select source, candidate, compatible, round(cosine, 6) as cosine, round(score, 6) as score, case when rejected then 'rejected' when coalesce(best - second < 0.08::double and best - score < 0.08::double, false) or score < 0.7 then 'ambiguous' else 'medium' end as label from z""",
    "graph_edges": """with n as (select 'region:' || r_regionkey as id, 'region' as kind, r_name as label from region union all select 'nation:' || n_nationkey, 'nation', n_name from nation union all select 'customer:' || c_custkey, 'customer', c_name from customer),
        e as (select 'nation:' || n_nationkey as source, 'region:' || n_regionkey as target, 'located_at' as relation from nation union all select 'customer:' || c_custkey, 'nation:' || c_nationkey, 'belongs_to' from customer
          union all select 'order:' || o_orderkey, 'customer:' || o_custkey, 'observed_at' from orders) select source, target, relation, kind as target_kind, label from e left join n on n.id = e.target""",
    "two_hops": """with m as (select distinct l_orderkey, l_suppkey from lineitem) select x.l_suppkey as a, y.l_suppkey as b, count(distinct x.l_orderkey) as shared from m x join m y on x.l_orderkey = y.l_orderkey and x.l_suppkey < y.l_suppkey group by 1, 2""",
    "touching_edges": """select distinct l_orderkey as source, l_partkey as target from lineitem where l_orderkey in (select p_partkey from part where p_size = 7) or l_partkey in (select p_partkey from part where p_size = 7)""",
    "overview": """select count(distinct user_id) as tracks, count(*) as events, count(distinct event_type) as kinds, round(sum(value) filter (event_type = 'view'), 2) as viewed from events""",
    "latest_events": """select event_type, event_id, epoch_us(ts) as t, rank from (select *, row_number() over (partition by event_type order by ts desc, event_id) as rank from events) where rank <= 6""",
}
