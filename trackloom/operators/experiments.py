"""Evaluation reports: grids of queries, sweeps over thresholds and gaps, rules and configurations compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions import geometry as G

_RATIOS = ("tiou", "start_error", "end_error")


def query_grid(queries: DataFrame, cameras: DataFrame) -> DataFrame:
    """Every authored query for every camera: ``queries(query, ...)``, ``cameras(camera_id)``, both short
    lists that a person wrote. ``query_id`` is a digest."""
    ident = F.xxhash64("query", "camera_id")
    return queries.crossJoin(cameras.select("camera_id")).withColumn("query_id", ident).withColumn("camera", F.col("camera_id"))


def grid_metrics(per_query: DataFrame, grid: DataFrame, status: str = "status") -> DataFrame:
    """Means of retrieval metrics over the grid by mapping status: queries, those with relevant events, each
    metric's mean, share of queries without any that returned something."""
    told = grid.select("query_id", status).join(per_query, "query_id")
    return told.groupBy(status).agg(
        F.count("*").alias("queries"), F.count("p_at_1").alias("positive"), *[F.avg(c).alias(c) for c in ("p_at_1", "p_at_5", "r_at_5", "reciprocal_rank", "ap_at_5")],
        F.avg(F.col("false_positive").cast("double")).alias("false_positive_rate"))


def label_hits(results: DataFrame, labels: DataFrame) -> DataFrame:
    """Hits that could be a label: equal query, video and type, both endpoints within the label's tolerance,
    the label's entity among the hit's if it names one; with errors and temporal IoU.

    ``results(query_id, event_id, rank, video_id, event_type, start, end, entities)``, ``labels(query_id,
    label, video_id, event_type, label_start, label_end, tolerance, entity)``. ``matching.greedy`` then
    gives each hit in order of rank the first label that is free."""
    both = results.join(labels, ["query_id", "video_id", "event_type"])
    a, b, c, d = (F.col(x) for x in ("start", "end", "label_start", "label_end"))
    one, two = G.endpoint_errors(a, b, c, d)
    near = (one <= F.col("tolerance")) & (two <= F.col("tolerance")) & (F.col("entity").isNull() | F.array_contains("entities", F.col("entity")))
    return both.where(near).select("query_id", "event_id", "rank", "label", one.alias("start_error"), two.alias("end_error"), G.temporal_iou(a, b, c, d).alias("tiou"))


def independent_metrics(matches: DataFrame, labels: DataFrame, results: DataFrame) -> DataFrame:
    """P@1, P@5, R@5 and reciprocal rank over queries with labels, the share of negative queries with
    hits, and mean localisation errors: ``matches(query_id, rank, start_error, end_error, tiou)`` one a
    matched label, ``labels(query_id, negative)`` one a label, ``results(query_id)`` one a hit."""
    of = labels.groupBy("query_id").agg(F.bool_or("negative").alias("negative"), F.count("*").alias("n"))
    hit = matches.groupBy("query_id").agg(F.count_if(F.col("rank") <= 5).alias("h"), F.min("rank").alias("first"))
    got = results.groupBy("query_id").agg(F.count("*").alias("returned"))
    rows = of.join(hit, "query_id", "left").join(got, "query_id", "left")
    positive = ~F.col("negative")
    mean = lambda c, test=positive: F.avg(F.when(test, F.coalesce(c.cast("double"), F.lit(0.0))))
    out = rows.agg(
        F.count_if(positive).alias("positive"), F.count_if("negative").alias("negative"), mean(F.col("first") == 1).alias("p_at_1"), mean(F.col("h") / 5).alias("p_at_5"),
        mean(F.col("h") / F.col("n")).alias("r_at_5"), mean(1 / F.col("first")).alias("mrr"), mean(F.col("returned") > 0, F.col("negative")).alias("false_positive_rate"))
    return out.crossJoin(matches.agg(*[F.avg(c).alias(c) for c in _RATIOS]))  # one row each


def histogram(rows: DataFrame, *columns: str) -> DataFrame:
    """How many rows there are of each value, for each column apart: ``column, value, n``."""
    told = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x"))
    return told.groupBy("x.column", "x.value").agg(F.count("*").alias("n"))


def probe_summary(actors: DataFrame) -> DataFrame:
    """By activity, with one column for each role's share: actors, covered, supported, sampled frames, mean
    longest run, median box area. ``actors(activity, role, covered, supported, sampled, longest, area)``."""
    return actors.groupBy("activity").agg(
        F.count("*").alias("actors"), F.count_if("covered").alias("covered"), F.count_if("supported").alias("supported"), F.sum("sampled").alias("sampled"), F.avg("longest").alias("longest"),
        F.percentile("area", 0.5).alias("area"), F.count_if(F.col("covered") & (F.col("role") == "person")).alias("covered_person"), F.count_if(F.col("covered") & (F.col("role") == "object")).alias("covered_object"))


def visibility_counts(cases: DataFrame, flags: list[str], by: str = "visibility") -> DataFrame:
    """Cases by stratum, and how many have each flag; a total in the row without a stratum."""
    return cases.rollup(by).agg(F.count("*").alias("cases"), *[F.count_if(F.coalesce(F.col(f), F.lit(False))).alias(f) for f in flags])


def box_report(frames: DataFrame, by: str = "camera_id") -> DataFrame:
    """Boxes by camera and in all: raw, kept after suppression, suppressed, matched; precision and recall
    only where every frame's review is complete, else null. ``frames(camera_id, complete, raw, kept, matched,
    visible)``."""
    sums = [F.sum(c).alias(c) for c in ("raw", "kept", "matched", "visible")]
    out = frames.rollup(by).agg(F.bool_and("complete").alias("complete"), *sums)
    only = lambda c: F.when(F.col("complete"), c)
    return out.select(by, "complete", "raw", "kept", (F.col("raw") - F.col("kept")).alias("suppressed"), "matched", only(F.try_divide("matched", "kept")).alias("precision"), only(F.try_divide("matched", "visible")).alias("recall"))


def case_windows(candidates: DataFrame, cases: DataFrame, controls: DataFrame, thresholds: list[float], near: float = 2.0) -> DataFrame:
    """A sweep over cases' windows: per threshold selected candidates, cases with any match (overlap, or start
    within ``near`` seconds), mean of their best temporal IoU, candidates within 1, 2 and 3 seconds of
    a case's start, false alarms in control windows, and precision over both.

    ``candidates(video_id, candidate, kind, start, end, score)``, ``cases(video_id, case_id, kind, case_start,
    case_end)``, ``controls(candidate)``: candidates inside control windows.
    """
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    picked = candidates.select("*", grid).where(F.col("score") >= F.col("threshold"))
    both = picked.join(cases, ["video_id", "kind"])
    a, b, c, d = (F.col(x) for x in ("start", "end", "case_start", "case_end"))
    late = F.abs(a - c)
    both = both.select("threshold", "case_id", "candidate", late.alias("late"), G.temporal_iou(a, b, c, d, same_start=False).alias("tiou"), ((F.greatest(a, c) <= F.least(b, d)) | (late <= near)).alias("match"))
    per_case = both.where("match").groupBy("threshold", "case_id").agg(F.max("tiou").alias("best")).groupBy("threshold").agg(F.count("*").alias("matched"), F.avg("best").alias("tiou"))
    least = both.groupBy("threshold", "candidate").agg(F.min("late").alias("late")).groupBy("threshold").agg(*[F.count_if(F.col("late") <= s).alias(f"within_{s}") for s in (1, 2, 3)])
    alarms = picked.join(controls.select("candidate").distinct(), "candidate").groupBy("threshold").agg(F.count("*").alias("alarms"))
    total = picked.groupBy("threshold").agg(F.count("*").alias("selected"))
    out = total.join(per_case, "threshold", "left").join(least, "threshold", "left").join(alarms, "threshold", "left").fillna(0, ["matched", "within_1", "within_2", "within_3", "alarms"])
    return out.withColumn("precision", F.try_divide("matched", F.col("matched") + F.col("alarms")))


def strata_sweep(candidates: DataFrame, thresholds: list[float], modes: list[str], controls: int) -> DataFrame:
    """For each mode and threshold: selected, matched, matches whose object is small or large, matches
    within 1, 2 and 3 seconds at either end, and the share of ``controls`` control candidates rejected.
    ``candidates(matched, control, small, start_error, end_error, <modes>)``."""
    melted = candidates.select("matched", "control", "small", "start_error", "end_error", F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("value")) for m in modes])).alias("s"))
    rows = melted.select("*", "s.mode", "s.value", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    on = F.coalesce(F.col("value") >= F.col("threshold"), F.lit(False))
    hit = on & F.coalesce(F.col("matched"), F.lit(False))
    ends = F.greatest("start_error", "end_error")
    return rows.groupBy("mode", "threshold").agg(
        F.count_if(on & ~F.col("control")).alias("selected"), F.count_if(hit).alias("matched"), F.count_if(hit & F.col("small")).alias("small"), F.count_if(hit & ~F.col("small")).alias("large"),
        *[F.count_if(hit & (ends <= s)).alias(f"within_{s}") for s in (1, 2, 3)], (1 - F.count_if(on & F.col("control")) / F.lit(float(max(controls, 1)))).alias("rejection"))


def contact_funnel(cases: DataFrame, runs: DataFrame, controls: DataFrame) -> DataFrame:
    """Totals of a contact experiment: cases with a person, a hand, contact, a persistent run; candidates; false
    alarms in control windows. ``cases(case_id, person, hand, contact)``, ``runs(case_id, persistent)``,
    ``controls(window, alarms)``."""
    run = runs.groupBy("case_id").agg(F.bool_or("persistent").alias("run"), F.count("*").alias("candidates"))
    rows = cases.join(run, "case_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    out = rows.agg(F.count("*").alias("cases"), *[F.count_if(yes(c)).alias(c) for c in ("person", "hand", "contact", "run")], F.coalesce(F.sum("candidates"), F.lit(0)).alias("candidates"))
    return out.crossJoin(controls.agg(F.count("*").alias("windows"), F.coalesce(F.sum("alarms"), F.lit(0)).alias("alarms")))  # one row each


def gap_sweep(candidates: DataFrame, verdicts: DataFrame, gaps: list[float], least: float = 0.65) -> DataFrame:
    """Merges by the longest gap allowed: how many, and how many of them are correct, incorrect and
    unannotated. ``candidates(a, b, gap, score)``, ``verdicts(a, b, verdict)``."""
    rows = candidates.where(F.col("score") >= least).join(verdicts, ["a", "b"], "left").select("gap", "verdict", F.explode(F.array(*[F.lit(float(g)) for g in gaps])).alias("longest"))
    on = F.col("gap") <= F.col("longest")
    return rows.groupBy("longest").agg(F.count_if(on).alias("merges"), *[F.count_if(on & (F.col("verdict") == v)).alias(v.lower()) for v in ("CORRECT", "INCORRECT", "UNANNOTATED")])


def rule_comparison(predictions: DataFrame, labels: DataFrame, matches: DataFrame) -> DataFrame:
    """Formulations of a rule on the same tracks, by type and in all (null type): predictions, matches,
    precision, recall, mean temporal IoU. ``predictions(method, event_type)``, ``labels(event_type)``,
    ``matches(method, event_type, tiou)``."""
    made = predictions.rollup("method", "event_type").agg(F.count("*").alias("predictions")).where("method is not null")
    hit = matches.rollup("method", "event_type").agg(F.count("*").alias("matched"), F.avg("tiou").alias("tiou")).where("method is not null")
    known = labels.rollup("event_type").agg(F.count("*").alias("labels"))
    same = lambda a, b, *cs: [a[c].eqNullSafe(b[c]) for c in cs]
    out = made.join(hit, same(made, hit, "method", "event_type"), "left").drop(hit["method"]).drop(hit["event_type"])
    out = out.join(known, same(out, known, "event_type"), "left").drop(known["event_type"]).fillna(0, ["matched", "labels"])
    return out.withColumn("precision", F.try_divide("matched", "predictions")).withColumn("recall", F.try_divide("matched", "labels"))


def configuration_summary(hits: DataFrame) -> DataFrame:
    """By configuration: actors hit, actors hit twice or more, mean and median confidence of hits.
    ``hits(config, actor, confidence)``, one a hit."""
    per = hits.groupBy("config", "actor").agg(F.count("*").alias("n")).groupBy("config").agg(F.count("*").alias("actors"), F.count_if(F.col("n") >= 2).alias("twice"))
    return per.join(hits.groupBy("config").agg(F.avg("confidence").alias("mean"), F.percentile("confidence", 0.5).alias("median")), "config")


def diverse(errors: DataFrame, by: list[str], order: list[str], most: int = 12) -> DataFrame:
    """The first error of each combination of ``by`` in the given order, ``most`` at most: a sample to look at."""
    first = errors.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("__r = 1").drop("__r")
    return first.orderBy(*by).limit(most)


def share(part: Column, whole: Column) -> Column:
    """A ratio, null without a denominator."""
    return F.try_divide(part, whole)
