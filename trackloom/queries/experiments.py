"""Evaluation reports, sweeps, listings, new rows from candidates, and checks of reviewed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators import catalogue as C
from trackloom.operators import experiments as X
from trackloom.operators import matching as M
from trackloom.operators import reports as R
from trackloom.operators.evidence import failed_rules
from trackloom.operators.search import top
from trackloom.queries.diagnostics import framed
from trackloom.sources import annotations as A
from trackloom.sources import reviews as V
from trackloom.sources.tables import ORDER_INTERVALS, SAMPLES, order_intervals, samples, table


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c not in keys else F.col(c) for c, t in df.dtypes])


def grid_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types asked of every nation: the parts by price, relevant if of even size."""
    part = table(spark, sf_dir, "part")
    queries = part.select(F.col("p_brand").alias("query")).distinct().withColumn("status", F.when(F.col("query").rlike("[13]$"), "DIRECT").otherwise("APPROXIMATE"))
    cameras = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("camera_id"))
    grid = X.query_grid(queries, cameras)
    found = grid.join(part, (F.col("query") == F.col("p_brand")) & (F.col("p_partkey") % 5 == F.col("camera_id"))).select("query_id", F.col("p_partkey").alias("item"), "p_retailprice", "p_size")
    results = top(found, "query_id", 5, F.desc("p_retailprice"), F.col("item")).select("query_id", "item", "rank")
    per = M.retrieval_metrics(results, found.where("p_size % 7 = 0").select("query_id", "item"), grid)
    return _rounded(X.grid_metrics(per, grid))


def independent_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer's even keys as hits in order of price, its odd ones as labels."""
    orders = order_intervals(spark, sf_dir).withColumn("entity", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") % 4))
    hits = orders.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("event_id"), F.lit("v").alias("video_id"), F.col("o_orderstatus").alias("event_type"), "start", "end", F.array(F.lit(0), F.lit(1)).alias("entities"), "o_totalprice")
    results = top(hits, "query_id", 5, F.desc("o_totalprice"), F.col("event_id"))
    labels = orders.where("o_orderkey % 2 = 1").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("label"), F.lit("v").alias("video_id"), F.col("o_orderstatus").alias("event_type"), F.col("start").alias("label_start"), F.col("end").alias("label_end"), F.lit(300.0).alias("tolerance"), F.col("entity").cast("int").alias("entity"))
    near = X.label_hits(results, labels)
    best = near.groupBy("query_id", "event_id", "rank").agg(F.min(F.struct("label", "start_error", "end_error", "tiou")).alias("m"))
    once = best.groupBy("query_id", "m.label").agg(F.min(F.struct("rank", "m")).alias("m")).select("query_id", "m.rank", "m.m.start_error", "m.m.end_error", "m.m.tiou")
    told = labels.select("query_id", (F.col("query_id") % 10 == 0).alias("negative"))
    return _rounded(X.independent_metrics(once.where("query_id % 10 <> 0"), told, results.join(told.select("query_id").distinct(), "query_id").select("query_id")))


def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.histogram(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


def probe_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    actors = line.select(F.col("l_returnflag").alias("activity"), F.when(F.col("l_linenumber") % 2 == 0, "person").otherwise("object").alias("role"), (F.col("l_quantity") > 10).alias("covered"),
                         (F.col("l_discount") > 0.05).alias("supported"), F.col("l_linenumber").cast("long").alias("sampled"), F.col("l_quantity").alias("longest"), F.col("l_extendedprice").alias("area"))
    return _rounded(X.probe_summary(actors))


def visibility_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("visibility"), (F.col("o_totalprice") > 100000).alias("detected"), (F.col("o_custkey") % 3 == 0).alias("tracked"))
    return X.visibility_counts(cases, ["detected", "tracked"])


def box_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    frames = line.select((F.col("l_suppkey") % 5).alias("camera_id"), (F.col("l_suppkey") % 5 < 3).alias("complete"), F.col("l_linenumber").cast("long").alias("raw"), F.ceil(F.col("l_linenumber") / 2).alias("kept"),
                         F.floor(F.col("l_linenumber") / 3).alias("matched"), (F.col("l_partkey") % 4).alias("visible"))
    return _rounded(X.box_report(frames))


def _cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = order_intervals(spark, sf_dir)
    candidates = orders.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("video_id"), F.col("o_orderkey").alias("candidate"), F.col("o_orderstatus").alias("kind"), "start", "end", (F.col("o_orderkey") % 100 / 100).alias("score"))
    cases = orders.where("o_orderkey % 2 = 1").select(F.col("o_custkey").alias("video_id"), F.col("o_orderkey").alias("case_id"), F.col("o_orderstatus").alias("kind"), F.col("start").alias("case_start"), F.col("end").alias("case_end"))
    return candidates, cases


def case_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, cases = _cases(spark, sf_dir)
    return _rounded(X.case_windows(candidates, cases, candidates.where("candidate % 6 = 0"), [0.35, 0.45, 0.6], 30.0), "threshold")


def strata_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    candidates = line.select((F.col("l_linestatus") == "F").alias("matched"), (F.col("l_suppkey") % 9 == 0).alias("control"), (F.col("l_quantity") < 20).alias("small"), (F.col("l_tax") * 50).alias("start_error"),
                             (F.col("l_discount") * 30).alias("end_error"), (F.col("l_quantity") / 50).alias("best"), (F.col("l_discount") * 10).alias("all"))
    return _rounded(X.strata_sweep(candidates, [0.35, 0.45, 0.55], ["best", "all"], 100), "threshold")


def contact_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), (F.col("o_custkey") % 2 == 0).alias("person"), (F.col("o_custkey") % 4 == 0).alias("hand"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey") % 8 == 0).alias("contact"))
    runs = table(spark, sf_dir, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("case_id"), (F.col("l_quantity") > 45).alias("persistent"))
    return X.contact_funnel(orders, runs, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("window"), (F.col("n_nationkey") % 4).alias("alarms")))


def gap_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    candidates = line.select(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"), (F.col("l_quantity") / 16).alias("gap"), (F.col("l_discount") * 10).alias("score"))
    verdicts = line.where("l_partkey % 4 > 0").select(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"), F.element_at(F.array(*map(F.lit, ("CORRECT", "INCORRECT", "UNANNOTATED"))), (F.col("l_partkey") % 4).cast("int")).alias("verdict"))
    verdicts = verdicts.groupBy("a", "b").agg(F.min("verdict").alias("verdict"))
    return X.gap_sweep(candidates, verdicts, [0.0, 0.5, 1.0, 1.5, 2.0, 3.0])


def rule_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    predictions = line.select((F.col("l_linenumber") % 4).alias("method"), F.col("l_returnflag").alias("event_type"))
    matches = line.where("l_quantity > 40").select((F.col("l_linenumber") % 4).alias("method"), F.col("l_returnflag").alias("event_type"), F.col("l_discount").alias("tiou"))
    return _rounded(X.rule_comparison(predictions, orders.select(F.when(F.col("o_orderstatus") == "O", "R").otherwise("N").alias("event_type")), matches))


def configuration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("config"), F.col("l_suppkey").alias("actor"), F.col("l_discount").alias("confidence"))
    return _rounded(X.configuration_summary(hits))


def diverse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_orderkey", "l_quantity")
    return X.diverse(line, ["l_returnflag", "l_linestatus", "l_linenumber"], ["l_orderkey", "l_quantity"])


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each track's samples of a video as one stored observation."""
    rows = framed(spark, sf_dir)
    box = F.struct("frame", "t", F.array("x1", "y1", "x2", "y2").alias("box"))
    return rows.groupBy("video_id", "track").agg(F.array_sort(F.collect_list(box)).alias("boxes")).select((F.col("track") + 1000).alias("observation_id"), "video_id", F.col("track").alias("entity_id"), F.col("track").alias("track_id"), "boxes")


def stored_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = framed(spark, sf_dir).groupBy(F.col("track").alias("entity_id")).agg(F.min("object_type").alias("object_type"))
    return _rounded(C.stored_tracks(_observations(spark, sf_dir), entities, classes=["person", "bag"]).drop("entity_id"))


def evidence_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _observations(spark, sf_dir)
    first = F.get("boxes", F.lit(0)).getField("frame")
    evidence = seen.select(F.col("track_id").alias("evidence_id"), "video_id", F.when(F.col("track_id") % 4 > 0, F.col("observation_id")).alias("observation_id"), first.alias("frame_start"), (first + 5).alias("frame_end"))
    events = seen.where("track_id % 5 > 0").select((F.col("track_id") * 10).alias("event_id"), F.col("track_id").alias("evidence_id"))
    members = events.select("event_id", F.explode(F.array(F.col("evidence_id"), F.col("evidence_id") + 3)).alias("entity_id"))
    out = C.evidence_detail(evidence, seen, events, members)
    theirs = F.transform(F.coalesce("supporting_tracks", F.array().cast(out.schema["supporting_tracks"].dataType)), lambda s: F.concat_ws(":", s.getField("track_id").cast("string"), F.size(s.getField("boxes")).cast("string")))
    return out.select("evidence_id", "event_id", "track_id", F.size("source_boxes").cast("long").alias("boxes"), F.array_join(theirs, ",").alias("supporting"))


def candidate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = framed(spark, sf_dir).groupBy("video_id", "track").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.min("object_type").alias("object_type"))
    keys = F.when(F.col("track") % 2 == 0, F.array(F.col("track"), F.col("track") + 3)).otherwise(F.array("track"))
    candidates = rows.select("video_id", F.when(F.col("track") % 2 == 0, "approached_object").otherwise("stopped").alias("kind"), keys.alias("keys"), F.col("a").alias("start"), F.col("b").alias("end"), F.lit("INFERRED").alias("category"), F.lit("rules").alias("method"))
    entities = rows.where("track % 5 > 0").select("video_id", F.col("track").alias("key"), F.col("track").alias("entity_id"), "object_type", (F.col("track") + 1000).alias("observation_id"))
    videos = rows.select("video_id").distinct().select("video_id", F.lit("CAM-01").alias("camera_id"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("recording_start"), F.lit(2.0).alias("fps"), F.lit(10_000_000).alias("frame_count"), F.lit("aa").alias("sha256"))
    events, evidence, edges = C.candidate_rows(candidates, entities, videos)
    joined = events.join(evidence, "evidence_id").join(edges.select("evidence_id", "source_id", "target_id"), "evidence_id", "left")
    return joined.select("title", "event_type", "video_id", "observation_id", "frame_start", "frame_end", "sha256", "source_id", "target_id", F.size("entities").cast("long").alias("n"))


def missing_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    events = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderkey").alias("evidence_id"), F.col("o_orderstatus").alias("kind"))
    members = line.select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("entity_id")).distinct()
    return C.missing_edges(events, members, events.where("event_id % 3 = 0").select("evidence_id"))


def missing_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("investigation"), (F.col("l_partkey") % 500).alias("event_id"))
    return C.missing_only(line, line.where("event_id % 2 = 0"), ["investigation", "event_id"])


def near_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user within three days of its first one, of two types."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("investigation"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("start_s"), F.col("event_type").alias("category"))
    selected = rows.where("investigation % 4 > 0").groupBy("investigation").agg(F.min("start_s").alias("start_s"))
    return C.near_in_time(rows, selected, 259200.0, ["click", "purchase"]).select("investigation", "event_id", "category")


def investigation_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    events = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_totalprice").alias("start_s"))
    out = C.findings(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("investigation"), "p_brand"), line.select(F.col("l_partkey").alias("investigation"), F.col("l_orderkey").alias("event_id")), events)
    return out.select("investigation", "p_brand", F.array_join(F.transform("findings", lambda x: x.getField("event_id").cast("string")), ",").alias("findings"))


def newest_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.newest(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey"), "c_acctbal", 10, "c_custkey", ("c_nationkey",))


def result_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"))
    k = F.col("l_orderkey")
    results = line.select(k.alias("query_id"), (k * 10 + F.col("l_linenumber")).alias("event_id"), F.when(k % 2 == 0, "R").alias("event"), F.when(k % 3 == 0, k % 5).alias("camera"), F.when(k % 7 > 0, F.array(F.lit("x"))).alias("explanations"), F.when(k % 11 > 0, F.lit(1)).alias("signals"))
    events = line.where("l_linenumber < 5").select((k * 10 + F.col("l_linenumber")).alias("event_id"), F.col("f").alias("kind"), (k % 4).alias("camera_id"))
    broken = events.where("event_id % 13 > 0").select("event_id", F.when(F.col("event_id") % 4 == 0, F.array(F.lit("track"))).otherwise(F.array().cast("array<string>")).alias("errors"))
    return C.result_integrity(results, events, broken).select("query_id", "event_id", F.array_join("errors", ",").alias("errors"))


def largest_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).withColumn("x2", F.col("x2") + F.floor(F.col("x1")) % 5)
    return _rounded(C.largest_crops(rows).select("video_id", "track", "t", "area"))


def scene_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("video_id"), F.col("event_id").alias("frame"), F.col("value").alias("difference"))
    return C.scenes(frames, 70.0).select("video_id", "frame", "scene")


def timing_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    rows = line.select(F.col("l_orderkey").alias("task"), F.col("l_suppkey").alias("participant"), F.lit(1).alias("trial"), F.col("l_returnflag").alias("mode"), F.col("l_discount").alias("first_relevant_seconds"), F.col("l_tax").alias("correct_seconds"), (F.col("l_quantity") / 1000).alias("total_seconds"))
    return V.timing_errors(rows).select("task", "participant", "mode", F.array_join("errors", ",").alias("errors"))


def _clips(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as videos, line items as clips."""
    videos = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("video_id"), (F.col("p_partkey") % 9).alias("camera_id"), F.col("p_brand").alias("local_path"), F.sha2("p_brand", 256).alias("sha256"), F.lit(640).alias("width"), F.lit(480).alias("height"), F.lit(30.0).alias("fps"), (F.col("p_size") * 20).cast("int").alias("frame_count"))
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("video_id"), F.min("l_quantity").cast("int").alias("q"))
    first = F.col("q") * 15
    step = F.when(F.col("l_linenumber") == 6, 14).otherwise(15)
    clips = line.join(videos, "video_id").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("clip_id"), "video_id", (F.col("camera_id") + (F.col("l_linenumber") == 7).cast("int")).alias("camera_id"), F.col("local_path").alias("source_video"), F.col("sha256").alias("source_sha256"),
        "width", "height", "fps", F.lit(2.0).alias("sample_fps"), F.sequence(first, first + step * 4, step).alias("frame_indices"), (first / 30.0).alias("start_seconds"), F.when(F.col("l_linenumber") == 5, 3.0).otherwise(2.5).alias("duration_seconds"))
    return clips, videos


def clip_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.clip_errors(*_clips(spark, sf_dir)).select("clip_id", F.array_join("errors", ",").alias("errors"))


def frame_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reviewed frames of one object each."""
    e = table(spark, sf_dir, "events")
    clips = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("clip_id"), F.lit("v").alias("video_id"), F.lit("c").alias("camera_id"), F.lit("s").alias("source_sha256"), F.lit(30.0).alias("fps"), F.lit(100).alias("width"), F.lit(90).alias("height"), F.sequence(F.lit(0), F.col("p_size").cast("int")).alias("frame_indices"))
    k, v = F.col("event_id"), F.col("value")
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    box = F.when(k % 5 > 0, F.array(v, v / 2, v + 10, v / 2 + 10))
    one = F.struct(F.when(k % 6 == 0, F.concat(F.lit("UNRESOLVED-"), k)).otherwise(F.concat(F.lit("O"), k)).alias("object_id"), pick("person", "bag", "dog").alias("class_label"), F.when(k % 20 == 3, "partial").otherwise(pick("visible", "occluded", "not_visible", "partially_visible")).alias("visibility"), pick("none", "heavy", "partial", "uncertain", "none").alias("occlusion"), pick("high", "uncertain").alias("identity_confidence"), box.alias("bbox_xyxy"), F.lit("").alias("annotator_note"), F.lit(None).cast("string").alias("reidentification_note"))
    records = e.select(
        F.lit("1").alias("dataset_version"), (F.col("user_id") + 1).alias("clip_id"), F.lit("v").alias("video_id"), F.when(k % 9 == 0, "d").otherwise("c").alias("camera_id"), F.lit("s").alias("source_sha256"), (k % 40).cast("int").alias("frame_index"),
        (k % 40 / 30.0 + F.when(k % 8 == 0, 0.1).otherwise(0.0)).alias("timestamp_seconds"), pick("complete", "partial", "done").alias("review_state"), F.lit("").alias("review_note"), F.when(k % 4 > 0, F.array(one)).otherwise(F.array().cast(f"array<{V.ANNOTATION}>")).alias("annotations"), k.alias("k"))
    found = V.frame_errors(records, clips, "1")
    return found.select(F.explode_outer(F.transform("errors", lambda x: F.regexp_replace(x, "^.*: ", ""))).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def runtime_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    p = F.col("p_partkey")
    videos = part.select(p.alias("video_id"), F.col("p_brand").alias("sha256"), F.lit(30.0).alias("fps"), (F.col("p_size") * 7).cast("int").alias("frame_count"))
    runs = part.where("p_partkey % 6 > 0").select(p.alias("video_id"), F.when(p % 4 == 0, "x").otherwise(F.col("p_brand")).alias("source_sha256"), F.ceil(F.col("p_size") * 7 / (F.when(p % 5 == 0, 14).otherwise(15))).cast("int").alias("sampled_frames"), F.lit("m").alias("model_sha256"), F.when(p % 7 == 0, 960).otherwise(640).alias("imgsz"), F.lit(0.25).alias("confidence"))
    return V.runtime_videos(runs, videos, {"sample_fps": 2.0, "model_sha256": "m", "imgsz": 640, "confidence": 0.25}).select("video_id", F.array_join("errors", ",").alias("errors"))


def case_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    phrases = part.where("p_partkey <= 10").select(F.col("p_partkey").alias("place"), F.substring("p_name", 1, 5).alias("phrase"), F.col("p_brand").alias("category"), F.lit("partial").alias("visibility"), F.lit("none").alias("occlusion"))
    cases = part.select(F.col("p_partkey").alias("case_id"), F.col("p_name").alias("review"), F.col("p_size").cast("double").alias("width"))
    return V.case_metadata(cases, phrases, part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("case_id"), F.lit(1).alias("detected")), 20.0)


def ingest_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = F.col("p_partkey"), F.col("p_size")
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (p % len(names) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(
        p.alias("video_id"), pick("a.mp4", "b.MOV", "c.webm", "d").alias("filename"), pick("2024-01-01T00:00:00Z", "2024-01-01T00:00:00", "2024-01-01T00:00:00+05:30").alias("recording_start"), (n - 2.0).alias("fps"),
        (n * 5000).cast("int").alias("frame_count"), (n * 120).cast("int").alias("width"), F.lit(2160).alias("height"), F.when(p % 5 > 0, "C").otherwise(" ").alias("camera_id"), F.repeat(F.lit("l"), n * 4).alias("location"))
    return failed_rules(rows, A.ingest_rules()).select("video_id", F.array_join("errors", ",").alias("errors"))


def clip_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("video_id"), F.concat(F.lit("C"), F.col("s_suppkey")).alias("camera_id"), F.element_at(F.array(F.lit(30.0), F.lit(24.0), F.lit(25.0)), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("fps"))
    starts = table(spark, sf_dir, "nation").select(F.concat(F.lit("C"), F.col("n_nationkey")).alias("camera_id"), (F.col("n_regionkey") * 30).alias("start_seconds"))
    return A.sample_plan(starts, videos).select("clip_id", F.size("frames").cast("long").alias("n"), F.array_min("frames").alias("first"), F.array_max("frames").alias("last"))


def identity_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.min("l_returnflag").alias("class"), F.min(F.col("l_partkey") % 2).alias("video_id"))
    return R.reappearances(frames.withColumnRenamed("l_orderkey", "place"), ["l_suppkey"])


QUERIES = {f.__name__: f for f in (
    grid_metrics, independent_metrics, histograms, probe_summary, visibility_counts, box_report, case_windows, strata_sweep, contact_funnel, gap_sweep, rule_comparison, configuration_summary, diverse_errors,
    stored_tracks, evidence_details, candidate_events, missing_edges, missing_findings, near_events, investigation_findings, newest_customers, result_integrity, largest_crops, scene_numbers, timing_errors,
    clip_errors, frame_errors, runtime_errors, case_metadata, ingest_errors, clip_plan, identity_reuse)}

_FR = f"""{SAMPLES}, fr as (select 'V' || (track % 3)::varchar as video_id, track, floor(t / 24)::int as frame, min(t) as t, arg_min(object_type, t) as object_type, arg_min(x1, t) as x1, arg_min(y1, t) as y1, arg_min(x2, t) as x2, arg_min(y2, t) as y2 from samples group by 1, 2, 3)"""
_CASE = f"""{ORDER_INTERVALS}, c as (select *, o_orderkey % 100 / 100.0::double as score from order_intervals where o_orderkey % 2 = 0), th as (select unnest([0.35, 0.45, 0.6])::double as threshold),
    pk as (select * from c, th where score >= threshold),
    b as (select threshold, k.o_orderkey as case_id, pk.o_orderkey as candidate, abs(pk.start - k.start) as late, case when greatest(pk."end", k."end") > least(pk.start, k.start) then greatest(0, least(pk."end", k."end") - greatest(pk.start, k.start)) / (greatest(pk."end", k."end") - least(pk.start, k.start)) else 0 end as tiou,
        greatest(pk.start, k.start) <= least(pk."end", k."end") or abs(pk.start - k.start) <= 30 as m from pk join order_intervals k on k.o_orderkey % 2 = 1 and k.o_custkey = pk.o_custkey and k.o_orderstatus = pk.o_orderstatus),
    pc as (select threshold, count(*) as matched, avg(best) as tiou from (select threshold, case_id, max(tiou) as best from b where m group by 1, 2) group by 1),
    ls as (select threshold, count(*) filter (l <= 1) as within_1, count(*) filter (l <= 2) as within_2, count(*) filter (l <= 3) as within_3 from (select threshold, candidate, min(late) as l from b group by 1, 2) group by 1),
    al as (select threshold, count(*) as selected, count(*) filter (o_orderkey % 6 = 0) as alarms from pk group by 1)"""
_RULES = lambda pairs: "concat_ws(',', " + ", ".join(f"case when not coalesce({test}, false) then '{name}' end" for name, test in pairs) + ")"

ORACLES = {
    "grid_metrics": """with g as (select p_brand as query, r_regionkey as cam, case when regexp_matches(p_brand, '[13]$') then 'DIRECT' else 'APPROXIMATE' end as status from (select distinct p_brand from part), region),
        f as (select query, cam, status, p_partkey, p_size % 7 = 0 as rel, row_number() over (partition by query, cam order by p_retailprice desc, p_partkey) as rank from g left join part on p_brand = query and p_partkey % 5 = cam),
        h as (select *, sum(rel::int) over (partition by query, cam order by rank) / rank as pr from f), q as (select query, cam, status, count(*) filter (rel) as n, count(p_partkey) as returned, coalesce(max(rel::int) filter (rank = 1), 0) as p1,
          coalesce(sum(rel::int) filter (rank <= 5), 0) as h5, min(rank) filter (rel and rank <= 5) as first, coalesce(sum(pr) filter (rel and rank <= 5), 0) as ap from h group by 1, 2, 3)
        select status, count(*) as queries, count(*) filter (n > 0) as positive, round(avg(p1) filter (n > 0), 6) as p_at_1, round(avg(h5 / 5) filter (n > 0), 6) as p_at_5, round(avg(h5 / n) filter (n > 0), 6) as r_at_5,
          round(avg(coalesce(1 / first, 0)) filter (n > 0), 6) as reciprocal_rank, round(avg(ap / n) filter (n > 0), 6) as ap_at_5, round(avg((returned > 0)::int) filter (n = 0), 6) as false_positive_rate from q group by 1""",
    "independent_metrics": f"""with {ORDER_INTERVALS}, r as (select * from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from order_intervals where o_orderkey % 2 = 0) where rank <= 5),
        l as (select *, case when o_orderkey % 3 = 0 then o_custkey % 4 end as entity from order_intervals where o_orderkey % 2 = 1),
        n as (select r.o_custkey as q, r.o_orderkey as e, r.rank, l.o_orderkey as label, abs(r.start - l.start) as se, abs(r."end" - l."end") as ee,
            case when greatest(r."end", l."end") > least(r.start, l.start) then greatest(0, least(r."end", l."end") - greatest(r.start, l.start)) / (greatest(r."end", l."end") - least(r.start, l.start)) else (r.start = l.start)::int end as tiou
            from r join l on r.o_custkey = l.o_custkey and r.o_orderstatus = l.o_orderstatus where abs(r.start - l.start) <= 300 and abs(r."end" - l."end") <= 300 and (entity is null or entity in (0, 1))),
        b as (select * from n qualify row_number() over (partition by q, e order by label) = 1), o as (select * from b where q % 10 <> 0 qualify row_number() over (partition by q, label order by rank) = 1),
        h as (select q, count(*) as h, min(rank) as first from o group by 1), g as (select o_custkey as q, count(*) as returned from r group by 1),
        p as (select o_custkey as q, count(*) as n, o_custkey % 10 = 0 as neg, any_value(h) as h, any_value(first) as first, any_value(returned) as returned from l left join h on h.q = o_custkey left join g on g.q = o_custkey group by 1)
        select count(*) filter (not neg) as positive, count(*) filter (neg) as negative, round(avg(coalesce((first = 1)::int, 0)) filter (not neg), 6) as p_at_1, round(avg(coalesce(h / 5, 0)) filter (not neg), 6) as p_at_5, round(avg(coalesce(h / n, 0)) filter (not neg), 6) as r_at_5,
          round(avg(coalesce(1 / first, 0)) filter (not neg), 6) as mrr, round(avg(coalesce((returned > 0)::int, 0)) filter (neg), 6) as false_positive_rate, (select round(avg(tiou), 6) from o) as tiou, (select round(avg(se), 6) from o) as start_error, (select round(avg(ee), 6) from o) as end_error from p""",
    "histograms": """select 'o_orderstatus' as "column", o_orderstatus as value, count(*) as n from orders group by 2 union all select 'o_orderpriority', o_orderpriority, count(*) from orders group by 2""",
    "probe_summary": """select l_returnflag as activity, count(*) as actors, count(*) filter (l_quantity > 10) as covered, count(*) filter (l_discount > 0.05::double) as supported, sum(l_linenumber)::bigint as sampled, round(avg(l_quantity), 6) as longest, round(median(l_extendedprice), 6) as area,
        count(*) filter (l_quantity > 10 and l_linenumber % 2 = 0) as covered_person, count(*) filter (l_quantity > 10 and l_linenumber % 2 = 1) as covered_object from lineitem group by 1""",
    "visibility_counts": """select o_orderpriority as visibility, count(*) as cases, count(*) filter (o_totalprice > 100000) as detected, count(*) filter (o_custkey % 3 = 0) as tracked from orders group by rollup (o_orderpriority)""",
    "box_report": """with f as (select l_suppkey % 5 as camera_id, l_suppkey % 5 < 3 as complete, l_linenumber as raw, ceil(l_linenumber / 2.0)::bigint as kept, floor(l_linenumber / 3.0)::bigint as matched, l_partkey % 4 as visible from lineitem),
        g as (select camera_id, bool_and(complete) as complete, sum(raw)::bigint as raw, sum(kept)::bigint as kept, sum(matched)::bigint as matched, sum(visible)::bigint as visible from f group by rollup (camera_id))
        select camera_id, complete, raw, kept, raw - kept as suppressed, matched, case when complete then round(matched / nullif(kept, 0), 6) end as precision, case when complete then round(matched / nullif(visible, 0), 6) end as recall from g""",
    "case_windows": f"""with {_CASE} select threshold, selected, coalesce(matched, 0) as matched, round(tiou, 6) as tiou, coalesce(within_1, 0) as within_1, coalesce(within_2, 0) as within_2, coalesce(within_3, 0) as within_3, alarms, round(coalesce(matched, 0) / nullif(coalesce(matched, 0) + alarms, 0), 6) as precision
        from al left join pc using (threshold) left join ls using (threshold)""",
    "strata_sweep": """with c as (select l_linestatus = 'F' as m, l_suppkey % 9 = 0 as ctl, l_quantity < 20 as small, greatest(l_tax * 50, l_discount * 30) as e, unnest([{'mode': 'best', 'v': l_quantity / 50}, {'mode': 'all', 'v': l_discount * 10}]) as s from lineitem),
        r as (select s.mode as mode, threshold, m, ctl, small, e, s.v >= threshold as on_ from c, (select unnest([0.35, 0.45, 0.55])::double as threshold))
        select mode, threshold, count(*) filter (on_ and not ctl) as selected, count(*) filter (on_ and m) as matched, count(*) filter (on_ and m and small) as small, count(*) filter (on_ and m and not small) as large, count(*) filter (on_ and m and e <= 1) as within_1,
          count(*) filter (on_ and m and e <= 2) as within_2, count(*) filter (on_ and m and e <= 3) as within_3, round(1 - count(*) filter (on_ and ctl) / 100.0::double, 6) as rejection from r group by 1, 2""",
    "contact_funnel": """with r as (select l_orderkey, bool_or(l_quantity > 45) as run, count(*) as n from lineitem where l_quantity > 30 group by 1)
        select count(*) as cases, count(*) filter (o_custkey % 2 = 0) as person, count(*) filter (o_custkey % 4 = 0) as hand, count(*) filter (o_custkey % 3 > 0 and o_custkey % 8 = 0) as contact, count(*) filter (run) as run, sum(n)::bigint as candidates,
          (select count(*) from nation) as windows, (select sum(n_nationkey % 4)::bigint from nation) as alarms from orders left join r on l_orderkey = o_orderkey""",
    "gap_sweep": """with v as (select l_orderkey, l_linenumber, min(list_value('CORRECT', 'INCORRECT', 'UNANNOTATED')[(l_partkey % 4)::int]) as verdict from lineitem where l_partkey % 4 > 0 group by 1, 2)
        select longest, count(*) filter (l_quantity / 16 <= longest) as merges, count(*) filter (l_quantity / 16 <= longest and verdict = 'CORRECT') as correct, count(*) filter (l_quantity / 16 <= longest and verdict = 'INCORRECT') as incorrect, count(*) filter (l_quantity / 16 <= longest and verdict = 'UNANNOTATED') as unannotated
        from lineitem left join v using (l_orderkey, l_linenumber), (select unnest([0, 0.5, 1, 1.5, 2, 3])::double as longest) where l_discount * 10 >= 0.65::double group by 1""",
    "rule_comparison": """with p as (select l_linenumber % 4 as method, l_returnflag as event_type, count(*) as predictions, count(*) filter (l_quantity > 40) as matched, avg(l_discount) filter (l_quantity > 40) as tiou from lineitem group by grouping sets ((1, 2), (1))),
        l as (select case when o_orderstatus = 'O' then 'R' else 'N' end as event_type, count(*) as labels from orders group by rollup (1))
        select method, p.event_type, predictions, matched, round(tiou, 6) as tiou, coalesce(labels, 0) as labels, round(matched / predictions, 6) as precision, round(matched / nullif(coalesce(labels, 0), 0), 6) as recall from p left join l on p.event_type is not distinct from l.event_type""",
    "configuration_summary": """with a as (select l_linenumber as config, l_suppkey, count(*) as n from lineitem group by 1, 2), b as (select config, count(*) as actors, count(*) filter (n >= 2) as twice from a group by 1)
        select config, any_value(actors) as actors, any_value(twice) as twice, round(avg(l_discount), 6) as mean, round(median(l_discount), 6) as median from lineitem join b on config = l_linenumber group by 1""",
    "diverse_errors": """select l_returnflag, l_linestatus, l_linenumber, l_orderkey, l_quantity from (select *, row_number() over (partition by l_returnflag, l_linestatus, l_linenumber order by l_orderkey, l_quantity) as r from lineitem) where r = 1 order by 1, 2, 3 limit 12""",
    "stored_tracks": f"""with {_FR}, k as (select track, min(object_type) as object_type from fr group by 1) select video_id, fr.track, k.object_type, frame, round(t, 6) as t, round(x1, 6) as x1, round(y1, 6) as y1, round(x2, 6) as x2, round(y2, 6) as y2 from fr join k on k.track = fr.track where k.object_type in ('person', 'bag')""",
    "evidence_details": f"""with {_FR}, o as (select video_id, track, min(frame) as f from fr group by 1, 2), n as (select o.video_id, o.track as e, f.track, count(*) filter (f.frame between o.f and o.f + 5) as n from o join fr f using (video_id) group by 1, 2, 3)
        select o.track as evidence_id, case when o.track % 5 > 0 then o.track * 10 end as event_id, case when o.track % 4 > 0 then o.track end as track_id, case when o.track % 4 > 0 then (select n from n where e = o.track and n.track = o.track) else 0 end as boxes,
          coalesce((select string_agg(n.track || ':' || n.n, ',' order by n.track) from n where e = o.track and n.track in (o.track, o.track + 3) and o.track % 5 > 0), '') as supporting from o""",
    "candidate_events": f"""with {_FR}, s as (select video_id, track, min(t) as a, max(t) as b, min(object_type) as k from fr group by 1, 2),
        c as (select s.video_id, s.track, s.k, s.a, s.b, o.track as other, o.k as ok from s left join s o on o.track = s.track + 3 and o.video_id = s.video_id and o.track % 5 > 0 where s.track % 5 > 0 and (s.track % 2 = 1 or o.track is not null)),
        e as (select *, round_even(a * 2, 0)::bigint as f0, round_even(b * 2, 0)::bigint as f1 from c), cap as (select *, least(9999999, f0) as g0, least(9999999, f1) as g1 from e)
        select case when track % 2 = 0 then upper(k[1]) || k[2:] || ' And ' || upper(ok[1]) || ok[2:] || ' Approached Object' else upper(k[1]) || k[2:] || ' Stopped' end as title, case when track % 2 = 0 then 'approached_object' else 'stopped' end as event_type, video_id, track + 1000 as observation_id, g0 as frame_start, g1 as frame_end,
          sha256('{{"frame_end": ' || g1 || ', "frame_start": ' || g0 || ', "method": "rules", "source_sha256": "aa", "video": "' || video_id || '"}}') as sha256, case when track % 2 = 0 then track end as source_id, case when track % 2 = 0 then other end as target_id, case when track % 2 = 0 then 2 else 1 end as n from cap""",
    "missing_edges": """select min(l_suppkey) as source_id, max(l_suppkey) as target_id, o_orderkey as evidence_id, any_value(o_orderstatus) as relation from orders join lineitem on l_orderkey = o_orderkey where o_orderkey % 3 <> 0 group by o_orderkey having count(distinct l_suppkey) = 2""",
    "missing_findings": """select distinct l_suppkey % 10 as investigation, l_partkey % 500 as event_id from lineitem where l_partkey % 500 % 2 = 1""",
    "near_events": """with s as (select user_id, min(epoch_us(ts)) as a from events where user_id % 4 > 0 group by 1) select events.user_id as investigation, event_id, event_type as category from events left join s using (user_id) where event_type in ('click', 'purchase') and (a is null or abs(epoch_us(ts) - a) <= 259200000000)""",
    "investigation_findings": """select p_partkey as investigation, p_brand, (select string_agg(o_orderkey::varchar, ',' order by o_totalprice, o_orderkey) from (select distinct l_orderkey from lineitem where l_partkey = p_partkey) join orders on o_orderkey = l_orderkey) as findings from part""",
    "newest_customers": """select c_custkey, c_name, c_acctbal from customer order by c_acctbal desc, c_custkey limit 10""",
    "result_integrity": f"""with l as (select l_orderkey as k, l_orderkey * 10 + l_linenumber as id, l_linenumber < 5 as known, min(l_returnflag) as f from lineitem group by 1, 2, 3)
        select k as query_id, id as event_id, {_RULES([("unknown event", "known"), ("kind", "k % 2 <> 0 or (known and f = 'R')"), ("camera", "k % 3 <> 0 or (known and k % 5 = k % 4)"), ("evidence", "known and id % 13 > 0 and id % 4 <> 0"), ("explanations", "k % 7 > 0"), ("signals", "k % 11 > 0")])} as errors from l""",
    "largest_crops": f"""with {SAMPLES}, a as (select *, (x2 + floor(x1) % 5 - x1) * (y2 - y1) as area from samples) select video_id, track, round(t, 6) as t, round(area, 6) as area from a qualify row_number() over (partition by video_id, track order by area desc, t) = 1""",
    "scene_numbers": """select user_id % 4 as video_id, event_id as frame, sum((value > 70)::int) over (partition by user_id % 4 order by event_id)::int as scene from events""",
    "timing_errors": f"""select l_orderkey as task, l_suppkey as participant, l_returnflag as mode, {_RULES([("positive", "l_discount > 0"), ("first before correct", "l_discount <= l_tax"), ("correct before total", "l_tax <= l_quantity / 1000"), ("once", "count(*) over (partition by l_orderkey, l_suppkey, l_returnflag) = 1")])} as errors from lineitem""",
    "clip_errors": f"""with l as (select l_orderkey, l_linenumber, min(l_partkey) as v, min(l_quantity)::int as q from lineitem group by 1, 2), c as (select l_orderkey * 10 + l_linenumber as clip_id, l_linenumber as ln, v, q * 15 as f, case when l_linenumber = 6 then 14 else 15 end as st, p_size from l join part on p_partkey = v),
        u as (select clip_id, v, unnest(range(f, f + st * 4 + 1, st)) as frame from c), d as (select distinct clip_id from u qualify count(*) over (partition by v, frame) > 1)
        select clip_id, {_RULES([("camera", "ln <> 7"), ("consecutive", "st = 15"), ("in range", "f + st * 4 < p_size * 20"), ("duration", "ln <> 5"), ("apart", "clip_id not in (select clip_id from d)")])} as errors from c""",
    "frame_errors": """with r as (select event_id as k, value as v, user_id, p_size, p_partkey is not null as clip from events left join part on p_partkey = user_id + 1),
        a as (select *, k % 4 > 0 as has, list_value('person', 'bag', 'dog')[(k % 3 + 1)::int] as cl, case when k % 20 = 3 then 'partial' else list_value('visible', 'occluded', 'not_visible', 'partially_visible')[(k % 4 + 1)::int] end as vi, list_value('none', 'heavy', 'partial', 'uncertain', 'none')[(k % 5 + 1)::int] as oc, list_value('high', 'uncertain')[(k % 2 + 1)::int] as ic from r),
        e as (select unnest(case when len(f) = 0 then [null] else f end) as rule from (select list_filter([case when not clip then 'clip' end, case when not coalesce(k % 40 <= p_size, false) then 'frame' end, case when not (clip and k % 9 > 0) then 'source' end, case when not (clip and k % 8 > 0) then 'timestamp' end,
          case when k % 3 = 2 then 'state' end, case when k % 3 = 0 and not has then 'empty is confirmed' end, case when has and cl = 'dog' then 'class' end, case when has and vi not in ('visible', 'partially_visible', 'occluded', 'not_visible', 'uncertain') then 'visibility' end,
          case when has and not (case when vi = 'not_visible' then k % 5 = 0 else coalesce(clip and k % 5 > 0 and v >= 0 and v + 10 <= 100 and v / 2 + 10 <= 90, false) end) then 'box' end, case when has and vi = 'visible' and oc not in ('none', 'uncertain') then 'visible, not occluded' end,
          case when has and vi = 'occluded' and oc not in ('heavy', 'partial') then 'occluded, and how' end, case when has and k % 6 = 0 and ic <> 'uncertain' then 'unresolved is uncertain' end], lambda x: x is not null) as f from a))
        select rule, count(*) as n from e group by 1""",
    "runtime_errors": f"""with p as (select *, p_partkey % 6 > 0 as there from part) select p_partkey as video_id, {_RULES([("present", "there"), ("source", "there and p_partkey % 4 > 0"), ("samples", "there and ceil(p_size * 7 / (case when p_partkey % 5 = 0 then 14.0 else 15.0 end)) = ceil(p_size * 7 / 15.0)"), ("model_sha256", "there"), ("imgsz", "there and p_partkey % 7 > 0"), ("confidence", "there")])} as errors from p""",
    "case_metadata": """select p.p_partkey as case_id, coalesce(arg_min(f.p_brand, f.p_partkey), 'UNKNOWN') as category, case when count(f.p_partkey) > 0 then 'partial' else 'UNKNOWN' end as visibility, case when count(f.p_partkey) > 0 then 'none' else 'UNKNOWN' end as occlusion, p.p_size < 20 as small, case when p.p_partkey % 2 = 0 then 1 end as detected
        from part p left join part f on f.p_partkey <= 10 and contains(p.p_name, f.p_name[1:5]) group by p.p_partkey, p.p_size""",
    "ingest_errors": f"""select p_partkey as video_id, {_RULES([("extension", "p_partkey % 4 in (0, 1)"), ("start with offset", "p_partkey % 3 <> 1"), ("frames", "p_size > 2"), ("duration", "p_size * 5000 / nullif(p_size - 2.0, 0) <= 7200"), ("size", "p_size * 120 * 2160 <= 3840 * 2160"), ("camera", "p_partkey % 5 > 0"), ("location", "p_size * 4 <= 160")])} as errors from part""",
    "clip_plan": """with c as (select s_suppkey as v, list_value(30.0, 24.0, 25.0)[(s_suppkey % 3 + 1)::int]::double as fps, n_regionkey * 30 as s from nation join supplier on s_suppkey = n_nationkey), d as (select *, round_even(fps / 2, 0)::int as st from c)
        select 'C' || v || '-' || lpad(s::varchar, 4, '0') as clip_id, len(range((s * fps)::int, (s * fps + 5 * fps)::int, st)) as n, (s * fps)::int as first, (s * fps)::int + (len(range((s * fps)::int, (s * fps + 5 * fps)::int, st)) - 1)::int * st as last from d where abs(fps / st - 2) < 1e-6""",
    "identity_reuse": """with f as (select l_suppkey, l_orderkey, min(l_returnflag) as c, min(l_partkey % 2) as v, l_orderkey - lag(l_orderkey) over (partition by l_suppkey order by l_orderkey) > 1 as g from lineitem group by 1, 2)
        select l_suppkey, count(*) filter (g) as reappearances, count(distinct c) > 1 as class_changes, count(distinct v) > 1 as id_reused from f group by 1""",
}
