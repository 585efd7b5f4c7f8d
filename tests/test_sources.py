"""Readers with quarantine, tables that are published whole, and rules of reviewed frames."""

import json

import pytest
from pyspark.sql import functions as F

from trackloom.operators import matching as M
from trackloom.plans.published import add_once, added, publish, published
from trackloom.sources import annotations as A
from trackloom.sources import reviews as V


def test_versions_and_a_failed_write(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    publish(spark.range(3), path)
    assert published(spark, path).count() == 3
    broken = spark.range(5).select((F.col("id") / F.when(F.col("id") == 4, F.raise_error(F.lit("no"))).otherwise(1)).alias("id"))
    with pytest.raises(Exception, match="no"):
        publish(broken, path)
    assert published(spark, path).count() == 3
    publish(spark.range(7), path)
    assert published(spark, path).count() == 7


def test_batches_are_added_once(spark, tmp_path):
    path = str(tmp_path / "batches of rows")
    assert added(spark, path, "id long").count() == 0
    assert add_once(spark.range(3), path, "monday") and not add_once(spark.range(3), path, "monday") and add_once(spark.range(2), path, "tuesday")
    assert added(spark, path, "id long").count() == 5


def test_two_runs_at_a_time_add_one_batch(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "t")
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda _: add_once(spark.range(3), path, "one"), range(4)))
    assert sum(done) == 1 and added(spark, path, "id long").count() == 3


def test_snapshot_is_in_key_order(spark, tmp_path):
    path = str(tmp_path / "s")
    A.write_snapshot(spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k int, v string"), path, ["k"])
    assert [r.k for r in published(spark, path, "k int, v string").collect()] == [1, 2, 3]


def test_label_csv_keeps_what_it_cannot_read(spark, tmp_path):
    names = [x.split()[0] for x in A.LABELS.split(", ")]
    good = {"query_id": "q1", "query": "a person", "camera_id": "C", "video_id": "V", "event_type": "stopped", "start_seconds": "1.5", "end_seconds": "2", "tolerance_seconds": "1", "negative": "false"}
    bad = good | {"query_id": "q2", "negative": "yes?", "start_seconds": "soon"}
    with open(tmp_path / "l.csv", "w") as f:
        f.write(",".join(names) + "\n" + "".join(",".join(r.get(n, "") for n in names) + "\n" for r in (good, bad)))
    rows, lost = V.read_label_csv(spark, str(tmp_path / "l.csv"))
    assert [r.query_id for r in rows.collect()] == ["q1"] and rows.first().start_seconds == 1.5
    told = lost.first()
    assert told.query_id == "q2" and set(told.unreadable) == {"negative", "start_seconds"} and told.negative == "yes?"
    with open(tmp_path / "m.csv", "w") as f:
        f.write("query_id\nq1\n")
    with pytest.raises(ValueError, match="video_id"):
        V.read_label_csv(spark, str(tmp_path / "m.csv"))


def frame(**changes):
    one = {"object_id": "O1", "class_label": "bag", "visibility": "visible", "occlusion": "none", "identity_confidence": "high", "bbox_xyxy": [1.0, 2.0, 10.0, 20.0]} | changes.pop("annotation", {})
    return {"dataset_version": "1.0", "clip_id": "c", "video_id": "v", "camera_id": "k", "source_sha256": "s", "frame_index": 15, "timestamp_seconds": 0.5, "review_state": "partial", "review_note": "", "annotations": [one]} | changes


@pytest.mark.parametrize("row,rule", [
    (frame(), None), (frame(annotation={"visibility": "partially_visible", "occlusion": "partial"}), None), (frame(annotation={"visibility": "partial"}), "O1: visibility"),
    (frame(annotation={"visibility": "not_visible", "bbox_xyxy": None}), None), (frame(annotation={"visibility": "not_visible"}), "O1: box"), (frame(annotation={"bbox_xyxy": None}), "O1: box"),
    (frame(annotation={"occlusion": "heavy"}), "O1: visible, not occluded"), (frame(annotation={"visibility": "occluded"}), "O1: occluded, and how"), (frame(annotation={"bbox_xyxy": [1.0, 2.0, 101.0, 20.0]}), "O1: box"),
    (frame(annotation={"object_id": "UNRESOLVED-1"}), "UNRESOLVED-1: unresolved is uncertain"), (frame(review_state="complete", annotations=[]), "empty is confirmed"),
    (frame(review_state="complete", annotations=[], review_note="EMPTY_SCENE_CONFIRMED"), None), (frame(timestamp_seconds=0.6), "timestamp"), (frame(frame_index=16), "frame"), (frame(dataset_version="2"), "version")])
def test_rules_of_reviewed_frames(spark, tmp_path, row, rule):
    with open(tmp_path / "f.jsonl", "w") as f:
        f.write(json.dumps(row) + "\n")
    clips = spark.createDataFrame([("c", "v", "k", "s", 30.0, 100, 90, [0, 15, 30])], "clip_id string, video_id string, camera_id string, source_sha256 string, fps double, width int, height int, frame_indices array<int>")
    rows, twice = V.read_frames(spark, str(tmp_path / "f.jsonl"))
    errors = V.frame_errors(rows, clips, "1.0").first().errors
    assert twice.isEmpty() and (errors == [] if rule is None else rule in errors)


def test_frames_that_come_twice(spark, tmp_path):
    with open(tmp_path / "f.jsonl", "w") as f:
        f.write("\n".join(json.dumps(frame(frame_index=i)) for i in (0, 15, 15)))
    rows, twice = V.read_frames(spark, str(tmp_path / "f.jsonl"))
    assert rows.count() == 1 and twice.count() == 2


def test_empty_records_of_clips(spark):
    clips = spark.createDataFrame([("c", "v", "k", "s", 30.0, [0, 15])], "clip_id string, video_id string, camera_id string, source_sha256 string, fps double, frame_indices array<int>")
    good, bad = V.frame_records(clips, spark.createDataFrame([("c", 15), ("c", 16), ("x", 0)], "clip_id string, frame_index int"), "1.0")
    assert [(r.frame_index, r.timestamp_seconds, r.annotations) for r in good.collect()] == [(15, 0.5, [])] and bad.count() == 2


def test_timings_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("t", "p", 1, "manual", 1.0, 2.0, 3.0), ("t", "p", 1, "assisted", 3.0, 2.0, 3.0)], "task string, participant string, trial int, mode string, first_relevant_seconds double, correct_seconds double, total_seconds double")
    for _ in range(2):
        assert V.append_timings(rows, str(tmp_path / "t"), "b1").count() == 1
    assert added(spark, str(tmp_path / "t"), rows.schema).count() == 1
    traces = spark.createDataFrame([("r", "a"), ("r", "a"), ("r", None)], "run string, reason string")
    assert V.write_report(traces, str(tmp_path / "r")).count() == 2 and published(spark, str(tmp_path / "r" / "trace")).count() == 3


def test_reversed_intervals_match_as_the_rule_says(spark):
    """By brute force over starts and ends of which some are reversed or without length."""
    import itertools
    import random

    r = random.Random(4)
    sides = [[(k, float(r.randint(0, 6)), float(r.randint(0, 6))) for k in range(25)] for _ in range(2)]

    def rule(a, b, c, d):
        union = max(b, d) - min(a, c)
        iou = max(0.0, min(b, d) - max(a, c)) / union if union else float(a == c)
        return iou >= 0.1 or (abs(a - c) <= 1 and abs(b - d) <= 1)

    want = sorted((i, j) for (i, a, b), (j, c, d) in itertools.product(*sides) if rule(a, b, c, d))
    p, q = (spark.createDataFrame([("k", *x) for x in side], f"key string, {name} long, start double, end double") for side, name in zip(sides, ("prediction", "label")))
    assert sorted((x.prediction, x.label) for x in M.eligible(p, q, ["key"], 0.1, 1.0, 2.0).collect()) == want
