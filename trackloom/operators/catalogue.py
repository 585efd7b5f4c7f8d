"""Stored tables joined for reading: tracks, evidence detail, listings, investigations; new rows from candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions import geometry as G
from trackloom.operators.evidence import signature


def stored_tracks(observations: DataFrame, entities: DataFrame, videos: DataFrame | None = None, classes: list[str] | None = None) -> DataFrame:
    """Samples of stored observations, a row a box: ``observations(video_id, track_id, entity_id, boxes
    array<struct<frame, t, box>>)``, ``entities(entity_id, object_type)``; of some classes only if given,
    with the columns of ``videos(video_id, ...)`` if given."""
    told = entities if classes is None else entities.where(F.col("object_type").isin(*classes))
    rows = observations.join(told.select("entity_id", "object_type"), "entity_id").select("video_id", F.col("track_id").alias("track"), "entity_id", "object_type", F.inline("boxes"))
    rows = rows.select("video_id", "track", "entity_id", "object_type", "frame", "t", *[F.col("box")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])
    return rows if videos is None else rows.join(videos, "video_id")


def boxes_between(boxes: Column, first: Column, last: Column) -> Column:
    """The boxes of an array whose frame is in a range, both ends included."""
    return F.filter(boxes, lambda b: b.getField("frame").between(first, last))


def near_in_time(events: DataFrame, selected: DataFrame, seconds: float, categories: list[str] | None = None) -> DataFrame:
    """Events within ``seconds`` of the selected one of their investigation (null: all of them), of some
    categories if given: ``events(investigation, event_id, start_s, category)``, ``selected(investigation,
    start_s)``, one a row each."""
    at = selected.select("investigation", F.col("start_s").alias("__at"))
    rows = events if categories is None else events.where(F.col("category").isin(*categories))
    joined = rows.join(at, "investigation", "left")
    return joined.where(F.col("__at").isNull() | (F.abs(F.col("start_s") - F.col("__at")) <= seconds)).drop("__at")


def evidence_detail(evidence: DataFrame, observations: DataFrame, events: DataFrame, members: DataFrame) -> DataFrame:
    """Each evidence row with its observation's boxes in its frames, its first event, and the tracks of the
    event's entities in the same video with their boxes in those frames.

    ``evidence(evidence_id, video_id, observation_id, frame_start, frame_end)``, ``observations(
    observation_id, video_id, entity_id, track_id, boxes)``, ``events(event_id, evidence_id)``,
    ``members(event_id, entity_id)``. An event's participants are few, so its tracks are one array.
    """
    first, last = F.col("frame_start"), F.col("frame_end")
    own = observations.select("observation_id", "track_id", F.col("boxes").alias("__boxes"))
    event = events.groupBy("evidence_id").agg(F.min("event_id").alias("event_id"))
    base = evidence.join(own, "observation_id", "left").join(event, "evidence_id", "left").withColumn("source_boxes", F.coalesce(boxes_between(F.col("__boxes"), first, last), F.array().cast(observations.schema["boxes"].dataType))).drop("__boxes")
    theirs = observations.select("video_id", "entity_id", F.col("track_id").alias("their_track"), F.col("boxes").alias("their_boxes"))
    found = base.select("evidence_id", "event_id", "video_id", "frame_start", "frame_end").join(members, "event_id").join(theirs, ["video_id", "entity_id"])
    track = F.struct("entity_id", F.col("their_track").alias("track_id"), boxes_between(F.col("their_boxes"), first, last).alias("boxes"))
    lists = found.groupBy("evidence_id").agg(F.array_sort(F.collect_list(track)).alias("supporting_tracks"))
    return base.join(lists, "evidence_id", "left")


def newest(df: DataFrame, order: str, n: int | None = None, key: str = "id", hidden: tuple[str, ...] = ()) -> DataFrame:
    """A listing, newest first (then by id), without hidden columns; ``n`` rows if given."""
    rows = df.drop(*hidden).orderBy(F.desc(order), key)
    return rows if n is None else rows.limit(n)


def findings(investigations: DataFrame, links: DataFrame, events: DataFrame) -> DataFrame:
    """Each investigation with its findings as an array in order of start: ``investigations(investigation,
    ...)``, ``links(investigation, event_id)``, ``events(event_id, start_s, ...)``."""
    told = links.dropDuplicates(["investigation", "event_id"]).join(events, "event_id")
    own = F.struct("start_s", "event_id", *[c for c in events.columns if c not in ("event_id", "start_s")])
    return investigations.join(told.groupBy("investigation").agg(F.array_sort(F.collect_list(own)).alias("findings")), "investigation", "left")


def missing_only(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key isn't there yet, each key once: what an idempotent insert appends."""
    return new.dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti")


def missing_edges(events: DataFrame, members: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges for events of exactly two entities that have none: ``source_id < target_id, evidence_id,
    relation``. ``events(event_id, evidence_id, kind)``, ``edges(evidence_id, ...)``."""
    pair = members.groupBy("event_id").agg(F.count("*").alias("n"), F.min("entity_id").alias("source_id"), F.max("entity_id").alias("target_id")).where("n = 2")
    rows = events.join(edges.select("evidence_id").distinct(), "evidence_id", "left_anti").join(pair, "event_id")
    return rows.select("source_id", "target_id", "evidence_id", F.col("kind").alias("relation"))


def candidate_rows(candidates: DataFrame, track_entities: DataFrame, videos: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, evidence, relationships) of candidates whose tracks all have an entity.

    ``candidates(video_id, kind, keys array, start, end, category, method)``, ``track_entities(video_id, key,
    entity_id, object_type, observation_id)``, ``videos(video_id, camera_id, recording_start timestamp, fps,
    frame_count, sha256)``. Ids are digests of the content, so reruns agree. Two participants make
    an edge.
    """
    ident = F.substring(F.sha2(F.concat_ws("|", "video_id", "kind", F.concat_ws(",", "keys"), F.col("start").cast("string"), F.col("end").cast("string")), 256), 1, 16)
    told = candidates.withColumn("event_id", ident).select("*", F.posexplode("keys").alias("place", "key"))
    joined = told.join(track_entities, ["video_id", "key"]).groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("place", "entity_id", "object_type", "observation_id"))).alias("who"))
    rows = candidates.withColumn("event_id", ident).join(joined, "event_id").where(F.size("keys") == F.size("who")).join(videos, "video_id")
    frame = lambda c: G.source_frame(F.col(c), F.col("fps"), F.col("frame_count"))
    rows = rows.withColumn("frame_start", frame("start")).withColumn("frame_end", frame("end")).withColumn("evidence_id", F.concat(F.lit("EVD-"), "event_id"))
    rows = rows.withColumn("signature", signature(F.col("frame_end"), F.col("frame_start"), F.col("method"), F.col("sha256"), F.col("video_id")))
    names = F.array_join(F.transform("who", lambda x: x.getField("object_type")), " and ")
    entities = F.transform("who", lambda x: x.getField("entity_id"))
    clock = lambda c: G.absolute_time(F.col("recording_start"), F.col(c))
    events = rows.select("event_id", "evidence_id", "camera_id", F.col("kind").alias("event_type"), F.initcap(F.concat_ws(" ", names, F.replace("kind", F.lit("_"), F.lit(" ")))).alias("title"),
                         clock("start").alias("start_ts"), clock("end").alias("end_ts"), "category", entities.alias("entities"))
    evidence = rows.select("evidence_id", "video_id", F.col("who")[0].getField("observation_id").alias("observation_id"), "frame_start", "frame_end", F.col("start").alias("timestamp_start"),
                           F.col("end").alias("timestamp_end"), F.col("signature").alias("sha256"), "method")
    two = rows.where(F.size("who") == 2)
    edges = two.select(F.concat(F.lit("REL-"), "event_id").alias("id"), entities[0].alias("source_id"), entities[1].alias("target_id"), "evidence_id", F.col("kind").alias("relation"), "category", "method",
                       F.array("start", "end").alias("source_interval"))
    return events, evidence, edges


def all_candidates(*kinds: DataFrame) -> DataFrame:
    """The union of derived event kinds without exact repeats, in a fixed order of columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kinds).distinct()


def result_integrity(results: DataFrame, events: DataFrame, broken: DataFrame) -> DataFrame:
    """Every search hit with the names of what is wrong with it: kind, camera, evidence chain, missing
    explanations or signals. ``results(query_id, event_id, explanations, signals)`` with the query's
    ``event`` and ``camera`` (null: any); ``events(event_id, kind, camera_id)``; ``broken(event_id,
    errors)`` as ``evidence.integrity`` gives it."""
    joined = results.join(events.select("event_id", F.col("kind").alias("__kind"), F.col("camera_id").alias("__camera")), "event_id", "left").join(broken.select("event_id", F.col("errors").alias("__errors")), "event_id", "left")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    errors = F.array_compact(F.array(
        F.when(F.col("__kind").isNull(), F.lit("unknown event")), F.when(F.col("event").isNotNull() & no(F.col("__kind") == F.col("event")), F.lit("kind")),
        F.when(F.col("camera").isNotNull() & no(F.col("__camera") == F.col("camera")), F.lit("camera")), F.when(F.coalesce(F.size("__errors"), F.lit(1)) > 0, F.lit("evidence")),
        F.when(no(F.size("explanations") > 0), F.lit("explanations")), F.when(F.col("signals").isNull(), F.lit("signals"))))
    return joined.select("query_id", "event_id", errors.alias("errors"))


def largest_crops(samples: DataFrame, keys: list[str] = ["video_id", "track"]) -> DataFrame:
    """The sample with the largest box of each track, the earliest of equals."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    row = F.struct(area.alias("area"), (-F.col("t")).alias("__t"), "x1", "y1", "x2", "y2")
    return samples.groupBy(*keys).agg(F.max(row).alias("m")).select(*keys, (-F.col("m.__t")).alias("t"), "m.area", "m.x1", "m.y1", "m.x2", "m.y2")


def scenes(frames: DataFrame, limit: float = 70.0) -> DataFrame:
    """Numbers the scenes of a video by its cuts: ``frames(video_id, frame, difference)`` with the mean
    difference to the frame before (null at the first)."""
    w = W.partitionBy("video_id").orderBy("frame").rowsBetween(W.unboundedPreceding, 0)
    return frames.withColumn("scene", F.sum(F.when(F.col("difference") > limit, 1).otherwise(0)).over(w).cast("int"))
