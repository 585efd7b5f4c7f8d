"""Summaries over events, tracks, cases and configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions import geometry as G

from trackloom.operators.intervals import sums_before


def report_lines(events: DataFrame, category: str = "category", start: str = "start", line: Column | None = None) -> DataFrame:
    """An investigation's findings by category, in order of start, as one text a category. An
    investigation's findings are few; the array is one category of one investigation."""
    text = line if line is not None else F.concat_ws(" | ", F.col(start).cast("string"), F.col("title"))
    rows = events.groupBy("investigation", category).agg(F.array_sort(F.collect_list(F.struct(start, "event_id", text.alias("line")))).alias("l"))
    return rows.select("investigation", category, F.size("l").cast("long").alias("n"), F.array_join(F.transform("l", lambda x: x.getField("line")), "\n").alias("report"))


def track_totals(tracks: DataFrame, key: str = "video_id") -> DataFrame:
    """Tracks, tentative and persistent ones, median duration and gaps by video, and for all videos
    (null key). ``tracks(key, duration, gaps, persistent)``."""
    return tracks.rollup(key).agg(
        F.count("*").alias("tracks"), F.count_if(~F.col("persistent")).alias("tentative"), F.count_if("persistent").alias("persistent"),
        F.percentile("duration", 0.5).alias("median_duration"), F.sum("gaps").alias("gaps"))


def _held(rows: DataFrame, spans: DataFrame, key: str, low: str, high: str, late: bool) -> DataFrame:
    """``rows`` with how many spans begin before their ``high`` less those that are over by their ``low``:
    the spans that they meet."""
    numbered = rows.withColumn("__row", F.struct(*rows.columns))
    edges = F.array(F.struct(F.lit("high").alias("what"), F.col(high).alias("t")), F.struct(F.lit("low").alias("what"), F.col(low).alias("t")))
    marks = numbered.select(key, "__row", F.explode(edges).alias("m")).select(key, "__row", "m.what", "m.t", ((F.col("m.what") == "high") == F.lit(late)).alias("late"))
    points = spans.select(key, F.col("start").alias("t"), F.lit(1).alias("begun"), F.lit(0).alias("over")).unionByName(spans.select(key, F.col("end").alias("t"), F.lit(0).alias("begun"), F.lit(1).alias("over")))
    sums = sums_before(points, marks, [key], ["begun", "over"]).groupBy(key, "__row").agg(
        (F.max(F.when(F.col("what") == "high", F.col("begun"))) - F.max(F.when(F.col("what") == "low", F.col("over")))).alias("__met"))
    return sums.select("__row.*", "__met")


def outside_windows(windows: DataFrame, labels: DataFrame, key: str = "video_id") -> DataFrame:
    """Control windows that overlap no label (touching is allowed); equal windows come once."""
    return _held(windows, labels, key, "start", "end", False).where("__met = 0").drop("__met")


def inside_windows(candidates: DataFrame, windows: DataFrame, key: str = "video_id") -> DataFrame:
    """Candidates that start inside one of the windows, both ends included; equal ones come once."""
    return _held(candidates, windows, key, "start", "start", True).where("__met > 0").drop("__met")


def merge_correctness(merges: DataFrame, actors: DataFrame) -> DataFrame:
    """CORRECT, INCORRECT or UNANNOTATED for each merge ``(a, b)`` by the tracks' actors ``(track, actor)``."""
    one, two = actors.select(F.col("track").alias("a"), F.col("actor").alias("__one")), actors.select(F.col("track").alias("b"), F.col("actor").alias("__two"))
    both = merges.join(one, "a", "left").join(two, "b", "left")
    verdict = F.when(F.col("__one").isNull() | F.col("__two").isNull(), "UNANNOTATED").when(F.col("__one") == F.col("__two"), "CORRECT").otherwise("INCORRECT")
    return both.withColumn("verdict", verdict).drop("__one", "__two")


def best_by_configuration(hits: DataFrame, case: str = "case_id") -> DataFrame:
    """Each case's best hit over configurations (IoU, then confidence, then name) and in how many
    configurations it was hit. ``hits(case, config, iou, confidence)``."""
    order = F.struct("iou", "confidence", "config")
    return hits.groupBy(case).agg(F.max(order).alias("m"), F.count_distinct("config").alias("configs")).select(case, "m.config", "m.iou", "m.confidence", "configs")


def memberships(rows: DataFrame, case: str, strategy: str) -> DataFrame:
    """Names of the strategies that hit a case, in order, joined by semicolons."""
    return rows.groupBy(case).agg(F.array_join(F.array_sort(F.collect_set(strategy)), ";").alias("strategies"))


def funnel(cases: DataFrame, stages: list[str], by: list[str] = ()) -> DataFrame:
    """How many cases reach each stage; a case that misses one counts for none after it."""
    reached, out = F.lit(True), []
    for stage in stages:
        reached = reached & F.coalesce(F.col(stage), F.lit(False))
        out.append(F.count_if(reached).alias(stage))
    grouped = cases.groupBy(*by) if by else cases.groupBy()
    return grouped.agg(F.count("*").alias("cases"), *out)


def failure_stage(stages: dict[str, str]) -> Column:
    """The label of the first stage column that is not true; ``success`` if all are."""
    return F.coalesce(*[F.when(~F.coalesce(F.col(c), F.lit(False)), F.lit(label)) for c, label in stages.items()], F.lit("success"))


def contact_limit(persons: Column, hands: Column, contacts: Column, persistent: Column, matched: Column, small: Column) -> Column:
    """What limits a contact case: the first count that is 0, then no match, then a box under 40 pixels."""
    return (
        F.when(persons == 0, "A_PERSON_DETECTION_ABSENT").when(hands == 0, "B_HAND_VISIBILITY_LIMIT").when(contacts == 0, "C_CONTACT_VISIBILITY_LIMIT").when(persistent == 0, "D_TEMPORAL_SPARSITY_2FPS")
        .when(~matched, "E_FALSE_PROGRESSION_REJECTED").when(small, "F_SUB_40PX_RESOLUTION_AMBIGUOUS").otherwise("G_SUCCESSFUL_CONTACT_DETECTION"))


def manipulation_failure(matched: Column, detected: Column, portable: Column, best_class: Column, tracklet: Column, person: Column, inferred: Column, reason: Column) -> Column:
    """The stage at which a manipulation case was lost; names the class or the rule that lost it."""
    return (
        F.when(matched, "MATCHED").when(~detected, "DETECTION_ABSENCE").when(~portable, F.concat(F.lit("UNSUPPORTED_CLASS_"), F.upper(best_class))).when(~tracklet, "TRACKLET_INSTABILITY")
        .when(~person, "ASSOCIATION_FAILURE").when(~inferred, F.concat(F.lit("INTERACTION_RULE_"), F.upper(reason))).otherwise("TEMPORAL_WINDOW_MISMATCH"))


def vehicle_failure(m: Column, starts: Column, candidates: Column, start: Column, end: Column, matched: Column) -> Column:
    """Why a vehicle's start or stop was not found.

    ``m``: struct of its track's ``sample_count, track_duration, longest_gap, track_start, track_end,
    stationary_before, stationary_after, speed_before, speed_after, speed_event_first_half,
    speed_event_second_half``; ``starts``: whether the label is a start, else a stop; ``candidates``: array of
    ``struct<kind, start, end>``; ``start``, ``end`` of the label."""
    f = m.getField
    same = F.filter(candidates, lambda c: c.getField("kind") == F.when(starts, "started_moving").otherwise("stopped"))
    near = F.exists(same, lambda c: (c.getField("start") <= end + 2) & (c.getField("end") >= start - 2))
    fastest = lambda a, b: F.greatest(F.coalesce(f(a), F.lit(0.0)), F.coalesce(f(b), F.lit(0.0)))
    start_lost = F.when((f("track_start") > start + 1) | (f("stationary_before") < 1), "NO_STATIONARY_PRECEDING_START").when(fastest("speed_event_second_half", "speed_after") < 0.28, "NO_SUSTAINED_MOVEMENT")
    stop_lost = F.when((f("track_end") < end - 1) | (f("stationary_after") < 1), "NO_STATIONARY_AFTER_STOP").when(fastest("speed_before", "speed_event_first_half") < 0.28, "MOVEMENT_TOO_SLOW_OR_UNOBSERVED")
    return (
        F.when(matched, "MATCHED").when(near, "EVENT_BOUNDARY_OR_SPATIAL_MISMATCH").when(F.size(same) > 0, "TEMPORAL_WINDOW_MISMATCH")
        .when((f("sample_count") < 7) | (f("track_duration") < 3), "INSUFFICIENT_TRACK_DURATION").when(f("longest_gap") > 1.5, "DETECTION_GAP")
        .otherwise(F.coalesce(F.when(starts, start_lost).otherwise(stop_lost), F.lit("RULE_ABSTENTION"))))


#: Columns of predictions that no public report shows.
HEAVY = ("supporting_tracks", "spatial_scores")


def public(predictions: DataFrame) -> DataFrame:
    """Predictions without their heavy columns."""
    return predictions.drop(*HEAVY)


def review_records(predictions: DataFrame, labels: DataFrame, pairs: DataFrame, reasons: DataFrame) -> DataFrame:
    """Predictions and labels side by side for review: ``kind, prediction, ground_truth, reason, temporal_iou,
    start_error, end_error, spatial_iou``, the first two as structs of the public columns.

    ``predictions(prediction, start, end, ...)``, ``labels(label, start, end, ...)``; ``pairs(prediction,
    label, kind, spatial)``: either id may be null (a false positive or a miss; errors are then null too);
    ``reasons(kind, reason)``. For CSV see ``flat_report``, which names columns ``prediction_x`` and
    ``ground_truth_x``."""
    shown = public(predictions)
    one = shown.select(F.col("prediction").alias("__p"), F.struct(*shown.columns).alias("prediction"))
    two = labels.select(F.col("label").alias("__l"), F.struct(*labels.columns).alias("ground_truth"))
    rows = pairs.withColumnsRenamed({"prediction": "__p", "label": "__l"}).join(one, "__p", "left").join(two, "__l", "left").join(reasons, "kind", "left")
    a, b, c, d = (F.col(f"{s}.{e}") for s in ("prediction", "ground_truth") for e in ("start", "end"))
    both = F.col("__p").isNotNull() & F.col("__l").isNotNull()
    start_error, end_error = G.endpoint_errors(a, b, c, d)
    return rows.select("kind", "prediction", "ground_truth", "reason", F.when(both, G.temporal_iou(a, b, c, d)).alias("temporal_iou"), F.when(both, start_error).alias("start_error"),
                       F.when(both, end_error).alias("end_error"), F.when(both, F.coalesce("spatial", F.lit(0.0))).alias("spatial_iou"))


def diagnosis(labels: DataFrame, by: str = "kind") -> DataFrame:
    """By type: labels, matches, recall, mean and median errors, mean coverage, and success among the
    covered. ``labels(kind, matched, start_error, end_error, coverage)``."""
    hit = F.coalesce(F.col("matched"), F.lit(False))
    covered = F.col("coverage") > 0
    return labels.groupBy(by).agg(
        F.count("*").alias("labels"), F.count_if(hit).alias("matched"), F.try_divide(F.count_if(hit), F.count("*")).alias("recall"), F.avg(F.when(hit, F.col("start_error"))).alias("start_error"),
        F.percentile(F.when(hit, F.col("start_error")), 0.5).alias("median_start_error"), F.avg("coverage").alias("coverage"), F.try_divide(F.count_if(hit & covered), F.count_if(covered)).alias("success"))


def dataset_status(frames: DataFrame) -> DataFrame:
    """Frames by review state with visible, uncertain and distinct objects. ``frames(state, visibility,
    object_id, certain)``."""
    return frames.groupBy("state").agg(
        F.count("*").alias("frames"), F.count_if(F.col("visibility") == "visible").alias("visible"), F.count_if(~F.col("certain")).alias("uncertain"), F.count_distinct("object_id").alias("objects"))


def reappearances(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Objects whose grid places skip (seen, unseen, seen again), whose class changes, or whose id names
    objects of several videos. ``frames(keys, place, class, video_id)``, ``keys`` without the video."""
    w = W.partitionBy(*keys).orderBy("place")
    return frames.withColumn("__gap", F.col("place") - F.lag("place").over(w) > 1).groupBy(*keys).agg(
        F.count_if("__gap").alias("reappearances"), (F.count_distinct("class") > 1).alias("class_changes"),
        *([(F.count_distinct("video_id") > 1).alias("id_reused")] if "video_id" in frames.columns and "video_id" not in keys else []))
