"""Manifests, activity labels, actor types, geometry, label tables and reports: read, check, write.

Readers declare their schemas. Checks return every violation as a row ``(rule, key, detail)`` or split
rows into valid and quarantined ones; nothing stops at the first error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.operators.evidence import split_valid
from trackloom.plans.published import publish

VIDEO = "video_id string, filename string, local_path string, camera_id string, recording_start string, fps double, frame_count int, duration double, width int, height int, sha256 string, annotation_path string"
#: A camera's dataset names each of these once.
UNIQUE = ("video_id", "filename", "local_path", "camera_id", "annotation_path")
ACTIVITIES = "id2 int, act2 map<string,double>, timespan array<struct<tsr0: array<int>>>, actors array<struct<id1: int, timespan: array<struct<tsr0: array<int>>>>>, video_id string"
TYPES = "id1 int, cset3 map<string,double>, video_id string"
GEOMETRY = "id0 int, id1 int, ts0 int, g0 string, video_id string"
LABELS = "query_id string, query string, camera_id string, video_id string, event_type string, start_seconds double, end_seconds double, tolerance_seconds double, entity_id string, negative boolean, case string"

# Which events an activity label stands for, and how directly.
ACTIVITY_EVENTS = {
    "person_picks_up_object": ("picked_up", "DIRECT"),
    "person_puts_down_object": ("placed_object", "DIRECT"),
    "vehicle_starts": ("started_moving", "DIRECT"),
    "vehicle_stops": ("stopped", "DIRECT"),
    "person_enters_scene_through_structure": ("appeared", "APPROXIMATE"),
    "person_exits_scene_through_structure": ("disappeared", "APPROXIMATE"),
}


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Videos of a JSON manifest ``{"videos": [...]}``, one row each."""
    return spark.read.schema(f"videos array<struct<{VIDEO}>>").json(path, multiLine=True).select(F.inline("videos"))


def repeated(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``(rule, key, detail)`` for each value that comes twice in one of the columns."""
    parts = [df.groupBy(F.col(c).cast("string").alias("key")).count().where("count > 1").select(F.lit(f"repeated {c}").alias("rule"), "key", F.col("count").cast("string").alias("detail")) for c in columns]
    return reduce(DataFrame.unionByName, parts)


def manifest_errors(videos: DataFrame) -> DataFrame:
    """Repeated identifiers, and one row if there is no video at all."""
    none = videos.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("empty").alias("rule"), F.lit(None).cast("string").alias("key"), F.lit("0").alias("detail"))
    return repeated(videos, UNIQUE).unionByName(none)


def metadata_errors(videos: DataFrame, measured: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Recorded against measured metadata (numbers by relative tolerance) and file hashes; videos that
    weren't measured are errors too."""
    m = measured.select("video_id", *[F.col(c).alias(f"m_{c}") for c in ("fps", "frame_count", "duration", "width", "height", "sha256")])
    both = videos.join(m, "video_id", "left")
    differs = lambda c: F.abs(F.col(c) - F.col(f"m_{c}")) > tolerance * F.greatest(F.abs(F.col(c)), F.abs(F.col(f"m_{c}")))
    rules = {"not measured": F.col("m_sha256").isNull(), **{f"{c} differs": F.coalesce(differs(c), F.lit(False)) for c in ("fps", "frame_count", "duration", "width", "height")},
             "sha256 differs": F.coalesce(F.col("sha256") != F.col("m_sha256"), F.lit(False))}
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return both.select(F.explode(broken).alias("rule"), F.col("video_id").alias("key"), F.lit(None).cast("string").alias("detail"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every file under a path, read by the executors."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def actor_types(types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``video_id, actor, type``; quarantined rows): an id once in a video, with exactly one class."""
    counted = types.withColumn("__n", F.count("*").over(W.partitionBy("video_id", "id1")))
    good, bad = split_valid(counted, {"unique": F.col("__n") == 1, "one class": F.size("cset3") == 1})
    return good.select("video_id", F.col("id1").alias("actor"), F.map_keys("cset3")[0].alias("type")), bad.drop("__n")


def geometry(rows: DataFrame, videos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``video_id, actor, frame, box``; quarantined rows): four finite numbers with x2 > x1 and y2 >
    y1, a frame of the video, ids and (actor, frame) once."""
    box = F.transform(F.split(F.trim("g0"), r"\s+"), lambda x: x.try_cast("double"))
    w = lambda *keys: F.count("*").over(W.partitionBy("video_id", *keys))
    parsed = rows.join(videos.select("video_id", "frame_count"), "video_id", "left").withColumn("box", box).withColumn("__a", w("id0")).withColumn("__b", w("id1", "ts0"))
    finite = F.forall("box", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rules = {"four finite numbers": (F.size("box") == 4) & finite, "area": (F.col("box")[2] > F.col("box")[0]) & (F.col("box")[3] > F.col("box")[1]),
             "frame of the video": (F.col("ts0") >= 0) & (F.col("ts0") < F.col("frame_count")), "unique id": F.col("__a") == 1, "unique actor and frame": F.col("__b") == 1}
    good, bad = split_valid(parsed, rules)
    return good.select("video_id", F.col("id1").alias("actor"), F.col("ts0").alias("frame"), "box"), bad.drop("__a", "__b")


def activities(rows: DataFrame, types: DataFrame, videos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Activity labels, one row for each span: ``video_id, activity, span, label, start_frame,
    end_frame, start_seconds, end_seconds, actor, object``; and the quarantined activities.

    An activity's id is unique, it has one label, spans in order, inside the video and apart (touching
    counts as overlap), known and different actors whose spans lie inside its own. Frames count from
    0, both ends included; the end second is that of the frame after. The first person is the actor,
    the first other thing the object.
    """
    spans = F.transform("timespan", lambda s: s.getField("tsr0"))
    own = rows.join(videos.select("video_id", "frame_count", "fps"), "video_id", "left").withColumn("__s", spans)
    own = own.withColumn("__n", F.count("*").over(W.partitionBy("video_id", "id2")))
    actor = own.select("video_id", "id2", "__s", F.posexplode("actors").alias("place", "a")).select(
        "video_id", "id2", "__s", "place", F.col("a.id1").alias("actor"), F.transform("a.timespan", lambda s: s.getField("tsr0")).alias("__t"))
    inside = F.forall("__t", lambda t: F.exists("__s", lambda s: (s[0] <= t[0]) & (t[1] <= s[1])))
    kinds = actor.join(types.withColumnRenamed("type", "kind"), ["video_id", "actor"], "left").groupBy("video_id", "id2").agg(
        F.bool_and(F.col("kind").isNotNull()).alias("__known"), F.bool_and(inside).alias("__inside"), (F.count("*") == F.count_distinct("actor")).alias("__different"),
        F.min(F.when(F.col("kind") == "person", F.struct("place", "actor"))).getField("actor").alias("person"), F.min(F.when(F.col("kind") != "person", F.struct("place", "actor"))).getField("actor").alias("object"))
    checked = own.join(kinds, ["video_id", "id2"], "left")
    apart = F.forall(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("__s") - 1)), lambda i: F.coalesce(F.get("__s", i)[0] > F.get("__s", i - 1)[1], F.lit(True)))
    rules = {
        "unique": F.col("__n") == 1, "one label": F.size("act2") == 1, "has spans": F.size("__s") > 0, "spans in range": F.forall("__s", lambda s: (s[0] >= 0) & (s[0] <= s[1]) & (s[1] < F.col("frame_count"))),
        "spans apart": apart, "has actors": F.size("actors") > 0, "known actors": F.col("__known"), "different actors": F.col("__different"), "actors inside": F.col("__inside"),
    }
    good, bad = split_valid(checked, rules)
    out = good.select("video_id", F.col("id2").alias("activity"), F.map_keys("act2")[0].alias("label"), "fps", F.coalesce("person", "object").alias("actor"), "object", F.posexplode("__s").alias("span", "s"))
    return out.select("video_id", "activity", "span", "label", F.col("s")[0].alias("start_frame"), F.col("s")[1].alias("end_frame"), (F.col("s")[0] / F.col("fps")).alias("start_seconds"),
                      ((F.col("s")[1] + 1) / F.col("fps")).alias("end_seconds"), "actor", "object"), bad.select("video_id", "id2", "errors")


def mapped(labels: DataFrame, column: str = "label") -> DataFrame:
    """Adds ``event`` and ``status`` of an activity label; unknown ones are UNSUPPORTED."""
    spark = labels.sparkSession
    known = spark.createDataFrame([(k, *v) for k, v in ACTIVITY_EVENTS.items()], f"{column} string, event string, status string")
    return labels.join(F.broadcast(known), column, "left").withColumn("status", F.coalesce("status", F.lit("UNSUPPORTED")))


def label_errors(labels: DataFrame, least_queries: int = 30, allow_small: bool = False) -> DataFrame:
    """Violations in a table of search labels: too few queries, two texts of one query, negative
    queries with several rows, positive rows without a video or type, reversed intervals, negative
    tolerances."""
    one = labels.groupBy("query_id").agg(F.count_distinct("query").alias("texts"), F.bool_or("negative").alias("negative"), F.count("*").alias("n"))
    told = lambda df, rule: df.select(F.lit(rule).alias("rule"), F.col("query_id").cast("string").alias("key"))
    positive = labels.where("not coalesce(negative, false)")
    parts = [
        told(one.where("texts > 1"), "one text"), told(one.where("negative and n > 1"), "one negative row"), told(positive.where("video_id is null or event_type is null"), "video and type"),
        told(labels.where("end_seconds < start_seconds"), "order"), told(labels.where("tolerance_seconds < 0"), "tolerance"),
    ]
    if not allow_small:
        parts.append(one.agg(F.count("*").alias("n")).where(F.col("n") < least_queries).select(F.lit("enough queries").alias("rule"), F.col("n").cast("string").alias("key")))
    return reduce(DataFrame.unionByName, parts)


def ingest_rules() -> dict[str, Column]:
    """Conditions on a row of the staging table of videos: known extension, start with an offset, frames,
    two hours, as many pixels as 4K has, a camera that is named and short names."""
    c = F.col
    return {
        "extension": F.lower(F.regexp_extract("filename", r"\.([A-Za-z0-9]+)$", 1)).isin("mp4", "mov", "avi", "mkv"), "start with offset": c("recording_start").rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})$"),
        "frames": (c("fps") > 0) & (c("fps") < float("inf")) & (c("frame_count") > 0), "duration": F.try_divide("frame_count", "fps") <= 7200, "size": c("width") * c("height") <= 3840 * 2160,
        "camera": (F.length(F.trim("camera_id")) > 0) & (F.length("camera_id") <= 80), "location": F.length("location") <= 160,
    }


def pending(planned: DataFrame, completed: DataFrame, key: str = "video_id") -> DataFrame:
    """Planned units that aren't completed yet."""
    return planned.join(completed.select(key), key, "left_anti")


def fingerprint(config: DataFrame, ignore: tuple[str, ...] = ("git_revision", "git_dirty")) -> DataFrame:
    """SHA-256 of each configuration row's JSON with columns in order of name, without some fields."""
    names = sorted(c for c in config.columns if c not in ignore)
    return config.withColumn("fingerprint", F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256))


def sample_plan(starts: DataFrame, videos: DataFrame, seconds: int = 5, sample_fps: float = 2.0) -> DataFrame:
    """Clips at fixed start seconds of each camera with their sample frames: ``clip_id, video_id, camera_id,
    start_seconds, duration_seconds, fps, sample_fps, frames``. Cameras whose frame rate is no multiple
    of ``sample_fps`` have no grid and are left out."""
    step = F.rint(F.col("fps") / sample_fps).cast("int")
    first = F.rint(F.col("start_seconds") * F.col("fps")).cast("int")
    rows = starts.join(videos, "camera_id").where(F.abs(F.col("fps") / step - sample_fps) <= 1e-6)
    ident = F.concat_ws("-", "camera_id", F.lpad(F.col("start_seconds").cast("int").cast("string"), 4, "0"))
    return rows.select(ident.alias("clip_id"), "video_id", "camera_id", "start_seconds", F.lit(seconds).alias("duration_seconds"), "fps", F.lit(sample_fps).alias("sample_fps"),
                       F.sequence(first, first + (seconds * F.rint("fps")).cast("int") - 1, step).alias("frames"))


def write_snapshot(df: DataFrame, path: str, keys: list[str]) -> None:
    """JSON lines in key order as a new version under ``path``, all or nothing: until the last file is there,
    ``published`` reads the snapshot before."""
    publish(df.repartitionByRange(*keys).sortWithinPartitions(*keys), path, "json")


def flat_report(rows: DataFrame) -> DataFrame:
    """Struct columns as ``name_field`` columns, for CSV."""
    out = []
    for f in rows.schema.fields:
        out += [F.col(f"{f.name}.{g}").alias(f"{f.name}_{g}") for g in f.dataType.names] if f.dataType.typeName() == "struct" else [F.col(f.name)]
    return rows.select(*out)
