"""Reviewed frames, clips, detection caches, label tables and timing rows: read and check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.operators.evidence import failed_rules, split_valid
from trackloom.plans.published import add_once, publish
from trackloom.sources.annotations import LABELS

ANNOTATION = "struct<object_id: string, class_label: string, visibility: string, occlusion: string, identity_confidence: string, bbox_xyxy: array<double>, annotator_note: string, reidentification_note: string>"
FRAME = f"dataset_version string, clip_id string, video_id string, camera_id string, source_sha256 string, frame_index int, timestamp_seconds double, review_state string, review_note string, annotations array<{ANNOTATION}>"
# What a reviewed frame may say.
CLASSES = ("person", "vehicle", "bag", "bottle", "cup", "phone", "other_visible_object", "unknown_object")
VISIBILITIES, OCCLUSIONS = ("visible", "partially_visible", "occluded", "not_visible", "uncertain"), ("none", "partial", "heavy", "uncertain")
CONFIDENCES, STATES, EMPTY = ("high", "medium", "uncertain"), ("partial", "complete"), "EMPTY_SCENE_CONFIRMED"
RUN = "video_id string, source_sha256 string, sampled_frames int, model_sha256 string, imgsz int, confidence double"


def read_frames(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Frame annotations from JSON lines: (frames, those whose clip and frame come more than once)."""
    rows = spark.read.schema(FRAME).json(path)
    n = F.count("*").over(W.partitionBy("clip_id", "frame_index"))
    told = rows.withColumn("__n", n)
    return told.where("__n = 1").drop("__n"), told.where("__n > 1").drop("__n")


def read_label_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Search labels from CSV: (labels, rows that hold what can't be read, as text, with those columns in
    ``unreadable``). A missing column of the header is an error that names it; empty fields are null."""
    text = spark.read.option("header", True).csv(path)
    columns = [x.split() for x in LABELS.split(", ")]
    if missing := [name for name, _ in columns if name not in text.columns]:
        raise ValueError(f"the label table lacks {', '.join(missing)}")
    value = {name: F.expr(f"try_cast(nullif(trim(`{name}`), '') as {kind})") for name, kind in columns}
    lost = F.array_compact(F.array(*[F.when((F.length(F.trim(F.col(name))) > 0) & v.isNull(), F.lit(name)) for name, v in value.items()]))
    told = text.withColumn("unreadable", lost)
    return told.where(F.size("unreadable") == 0).select(*[v.alias(name) for name, v in value.items()]), told.where(F.size("unreadable") > 0)


def runtime_videos(runs: DataFrame, videos: DataFrame, config: dict) -> DataFrame:
    """Every planned video with what is wrong with its cached detections: none, another source, another
    model, image size or confidence, or not as many sampled frames as its grid has. ``runs``: ``RUN``,
    ``videos(video_id, sha256, fps, frame_count)``, ``config``: sample_fps, model_sha256, imgsz, confidence."""
    step = F.greatest(F.lit(1), F.rint(F.col("fps") / float(config["sample_fps"])).cast("int"))
    joined = videos.join(runs, "video_id", "left").withColumn("expected", F.ceil(F.col("frame_count") / step).cast("int"))
    rules = {"present": F.col("source_sha256").isNotNull(), "source": F.col("source_sha256") == F.col("sha256"), "samples": F.col("sampled_frames") == F.col("expected")}
    rules |= {name: F.col(name) == F.lit(config[name]) for name in ("model_sha256", "imgsz", "confidence")}
    return failed_rules(joined, rules).select("video_id", "errors")


def clip_errors(clips: DataFrame, videos: DataFrame, version: str | None = None) -> DataFrame:
    """Every clip with the rules it breaks: unique id, source fields equal to the manifest's, a whole-number
    sampling step, consecutive frames of that step, inside the recording, clock and duration that
    agree, no frame shared with another clip of the video.

    ``clips(clip_id, video_id, camera_id, source_video, source_sha256, width, height, fps, sample_fps,
    frame_indices, start_seconds, duration_seconds)``, ``videos`` as the manifest has them."""
    source = videos.select("video_id", *[F.col(a).alias(f"__{a}") for a in ("camera_id", "local_path", "sha256", "width", "height", "fps", "frame_count")])
    frames = clips.select("clip_id", "video_id", F.explode(F.array_distinct("frame_indices")).alias("frame"))
    twice = frames.groupBy("video_id", "frame").agg(F.collect_set("clip_id").alias("of")).where(F.size("of") > 1)
    shared = twice.select(F.explode("of").alias("clip_id")).distinct().withColumn("__shared", F.lit(True))
    rows = clips.join(source, "video_id", "left").join(shared, "clip_id", "left").withColumn("__n", F.count("*").over(W.partitionBy("clip_id")))
    c, n = F.col, F.size("frame_indices")
    step = c("__fps") / c("sample_fps")
    first, last = F.get("frame_indices", F.lit(0)), F.get("frame_indices", n - 1)
    rules = {
        "unique": c("__n") == 1, "camera": c("camera_id") == c("__camera_id"), "source": (c("source_video") == c("__local_path")) & (c("source_sha256") == c("__sha256")),
        "size": (c("width") == c("__width")) & (c("height") == c("__height")), "fps": c("fps") == c("__fps"), "rate": c("sample_fps") > 0, "grid": (F.abs(step - F.rint(step)) <= 1e-6) & (n > 0),
        "consecutive": F.forall(F.transform("frame_indices", lambda f, i: f == first + i * F.rint(step).cast("int")), lambda x: x), "in range": (first >= 0) & (last < c("__frame_count")),
        "clock": c("start_seconds") == first / c("__fps"), "duration": c("duration_seconds") == n / c("sample_fps"), "apart": c("__shared").isNull(),
    }
    if version is not None:
        rules["version"] = c("dataset_version") == version
    return failed_rules(rows, rules).select("clip_id", "video_id", "errors")


def frame_records(clips: DataFrame, frames: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """Empty records for the chosen frames of clips: (records, choices outside their clip).
    ``frames(clip_id, frame_index)``; ``timestamp_seconds`` is the frame over the clip's fps."""
    told = frames.join(clips, "clip_id", "left")
    good, bad = split_valid(told, {"inside": F.array_contains("frame_indices", F.col("frame_index"))})
    return good.select(
        F.lit(version).alias("dataset_version"), "clip_id", "video_id", "camera_id", "source_sha256", "frame_index", (F.col("frame_index") / F.col("fps")).alias("timestamp_seconds"),
        F.lit("partial").alias("review_state"), F.lit("").alias("review_note"), F.array().cast(f"array<{ANNOTATION}>").alias("annotations")), bad.select("clip_id", "frame_index")


def _annotation_rules(a: Column, width: Column, height: Column) -> dict[str, Column]:
    f = a.getField
    box, seen = f("bbox_xyxy"), f("visibility") != "not_visible"
    corner = lambda i: F.get(box, F.lit(i))
    inside = (F.size(box) == 4) & (corner(0) >= 0) & (corner(0) < corner(2)) & (corner(2) <= width) & (corner(1) >= 0) & (corner(1) < corner(3)) & (corner(3) <= height)
    return {
        "object id": F.length(F.trim(f("object_id"))) > 0, "class": f("class_label").isin(*CLASSES), "visibility": f("visibility").isin(*VISIBILITIES), "occlusion": f("occlusion").isin(*OCCLUSIONS),
        "identity confidence": f("identity_confidence").isin(*CONFIDENCES), "box": F.when(seen, F.coalesce(inside, F.lit(False))).otherwise(box.isNull()),
        "visible, not occluded": (f("visibility") != "visible") | f("occlusion").isin("none", "uncertain"), "occluded, and how": (f("visibility") != "occluded") | f("occlusion").isin("heavy", "partial"),
        "unresolved is uncertain": ~f("object_id").startswith("UNRESOLVED-") | (f("identity_confidence") == "uncertain"),
    }


def frame_errors(records: DataFrame, clips: DataFrame, version: str) -> DataFrame:
    """Every reviewed frame with the rules it breaks: those of the frame, and ``object: rule`` for its
    annotations. ``records``: ``FRAME``; ``clips(clip_id, video_id, camera_id, source_sha256, fps, width,
    height, frame_indices)``."""
    clip = clips.select("clip_id", *[F.col(c).alias(f"__{c}") for c in ("video_id", "camera_id", "source_sha256", "fps", "width", "height", "frame_indices")])
    c, n = F.col, F.size("annotations")
    rules = {
        "clip": c("__fps").isNotNull(), "frame": F.array_contains("__frame_indices", c("frame_index")), "version": c("dataset_version") == version,
        "source": (c("video_id") == c("__video_id")) & (c("camera_id") == c("__camera_id")) & (c("source_sha256") == c("__source_sha256")),
        "timestamp": F.abs(c("timestamp_seconds") - c("frame_index") / c("__fps")) <= 1e-6, "state": c("review_state").isin(*STATES), "note": c("review_note").isNotNull(), "annotations": n >= 0,
        "empty is confirmed": (c("review_state") != "complete") | (n > 0) | (c("review_note") == EMPTY), "objects differ": F.size(F.array_distinct(F.transform("annotations", lambda a: a.getField("object_id")))) == n,
    }
    rows = failed_rules(records.join(clip, "clip_id", "left"), rules)
    broken = lambda a: F.array_compact(F.array(*[F.when(~F.coalesce(r, F.lit(False)), F.concat_ws(": ", F.coalesce(a.getField("object_id"), F.lit("?")), F.lit(name))) for name, r in _annotation_rules(a, c("__width"), c("__height")).items()]))
    of = F.coalesce(F.flatten(F.transform("annotations", broken)), F.array().cast("array<string>"))
    return rows.select("clip_id", "frame_index", F.concat("errors", of).alias("errors"))


def timing_errors(rows: DataFrame) -> DataFrame:
    """Timing rows with the rules they break: ``0 < first relevant <= correct <= total``, one row of a task,
    participant, trial and mode. ``rows(task, participant, trial, mode, first_relevant_seconds,
    correct_seconds, total_seconds)``."""
    c = F.col
    told = rows.withColumn("__n", F.count("*").over(W.partitionBy("task", "participant", "trial", "mode")))
    rules = {"positive": c("first_relevant_seconds") > 0, "first before correct": c("first_relevant_seconds") <= c("correct_seconds"), "correct before total": c("correct_seconds") <= c("total_seconds"), "once": c("__n") == 1}
    return failed_rules(told, rules).drop("__n")


def append_timings(rows: DataFrame, path: str, batch: str) -> DataFrame:
    """Add the rows that break no rule as the batch of that name, once however often it is run; returns the
    others."""
    checked = timing_errors(rows)
    add_once(checked.where(F.size("errors") == 0).drop("errors"), path, batch)
    return checked.where(F.size("errors") > 0)


def case_metadata(cases: DataFrame, phrases: DataFrame, diagnostics: DataFrame, small: float = 40.0) -> DataFrame:
    """Review texts as metadata: the values of the first phrase that a text holds, ``small`` for boxes
    narrower than so many pixels, and the case's diagnostics.

    ``cases(case_id, review, width)``; ``phrases(place, phrase, category, visibility, occlusion)``: a
    short authored list, tried in order of ``place``; ``diagnostics(case_id, ...)``."""
    told = cases.join(F.broadcast(phrases), F.contains("review", "phrase"), "left")  # authored by hand, some ten rows
    first = F.min(F.when(F.col("phrase").isNotNull(), F.struct("place", "category", "visibility", "occlusion"))).alias("m")
    rows = told.groupBy("case_id", "review", "width").agg(first)
    return rows.select("case_id", *[F.coalesce(f"m.{c}", F.lit("UNKNOWN")).alias(c) for c in ("category", "visibility", "occlusion")], (F.col("width") < small).alias("small")).join(diagnostics, "case_id", "left")


def write_report(traces: DataFrame, path: str) -> DataFrame:
    """Publish traces and their reasons by run under ``path``; a failed write leaves those before in force."""
    publish(traces, f"{path}/trace", "json")
    counts = traces.groupBy("run", "reason").agg(F.count("*").alias("n"))
    publish(counts, f"{path}/reasons", "json")
    return counts


def union_csv(parts: list[DataFrame], path: str) -> None:
    """Rows of several reports as one CSV whose columns are the union of theirs."""
    reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).write.mode("overwrite").option("header", True).csv(path)
