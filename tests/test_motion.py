"""Hand-made tracks with known events."""

import pytest
from pyspark.sql import functions as F

from trackloom.operators import motion as M
from trackloom.operators import runs as R

SCHEMA = "video_id string, track string, object_type string, t double, x1 double, y1 double, x2 double, y2 double"


def track(spark, name, kind, points, high=10.0):
    return spark.createDataFrame([("V", name, kind, float(t), float(x), 0.0, float(x) + 5, high) for t, x in points], SCHEMA)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_gap_splits_a_track(spark):
    cut = R.segments(track(spark, "a", "car", [(0, 0), (1, 0), (5, 0), (6, 0)]), 1.5)
    assert rows(cut.groupBy("key").count(), "key", "count") == [("a@0", 2), ("a@1", 2)]
    assert rows(R.segments(track(spark, "a", "car", [(0, 0), (1.5, 0)]), 1.5), "key") == [("a",), ("a",)]


def test_person_stops_and_starts(spark):
    points = [(i * 0.5, 10 * i) for i in range(5)] + [(2 + i * 0.5, 40) for i in range(1, 7)] + [(5 + i * 0.5, 40 + 10 * i) for i in range(1, 5)]
    tracks = M.valid_tracks(track(spark, "p", "person", points))
    assert rows(M.stationary(tracks), "kind", "start", "end", "verified_until", "prior_motion") == [("stopped", 2.0, 4.0, 5.0, True)]
    assert rows(M.started_moving(tracks), "kind", "start", "end") == [("started_moving", 5.0, 6.0)]


@pytest.mark.parametrize("kind,expected", [("bag", "became_stationary"), ("car", "stationary")])
def test_other_things_become_stationary(spark, kind, expected):
    points = [(i * 0.5, 10 * i) for i in range(5)] + [(2 + i * 0.5, 40) for i in range(1, 7)]
    assert rows(M.stationary(M.valid_tracks(track(spark, "x", kind, points))), "kind") == [(expected,)]


def test_vehicle_stop_and_parked_jitter(spark):
    moving = [(i * 0.5, 4 * i) for i in range(8)] + [(3.5 + i * 0.5, 28) for i in range(1, 9)]
    found = rows(M.vehicle_transitions(M.valid_tracks(track(spark, "c", "car", moving))), "kind", "end")
    assert [k for k, _ in found] == ["stopped"] and 3.0 <= found[0][1] <= 4.5
    parked = [(i * 0.5, 0.2 * (i % 2)) for i in range(20)]
    assert rows(M.vehicle_transitions(M.valid_tracks(track(spark, "c", "car", parked))), "kind") == []


def test_vehicle_start(spark):
    points = [(i * 0.5, 0) for i in range(8)] + [(3.5 + i * 0.5, 4 * i) for i in range(1, 9)]
    found = rows(M.vehicle_transitions(M.valid_tracks(track(spark, "c", "car", points))), "kind", "start")
    assert [k for k, _ in found] == ["started_moving"] and 3.0 <= found[0][1] <= 4.0


@pytest.mark.parametrize("rule", ["velocity_transition", "change_point", "multi_window"])
def test_alternative_rules_find_the_stop(spark, rule):
    points = [(i * 0.5, 4 * i) for i in range(8)] + [(3.5 + i * 0.5, 28) for i in range(1, 9)]
    found = rows(M.alternative_transitions(M.valid_tracks(track(spark, "c", "car", points)), rule), "kind", "rule")
    assert found == [("stopped", rule)]


def test_zones(spark):
    tracks = M.valid_tracks(track(spark, "p", "person", [(i, 10 * i) for i in range(10)]))
    zones = spark.createDataFrame([("V", "door", [0.3, 0.0, 0.7, 1.0]), ("V", "bad", [0.7, 0.0, 0.3, 1.0])], "video_id string, zone string, rect array<double>")
    assert rows(M.zone_events(tracks, zones, 100.0, 10.0), "zone", "kind", "start", "end") == [("door", "entered_zone", 3.0, 3.0), ("door", "exited_zone", 7.0, 7.0), ("door", "remained_in_zone", 3.0, 7.0)]


def test_runs_of_samples_and_edges(spark):
    df = spark.createDataFrame([("k", float(i), s) for i, s in enumerate([True, True, False, True])], "k string, t double, s boolean")
    assert rows(R.runs(df, F.col("s"), ["k"], kind="sample").where("state"), "start", "end") == [(0.0, 2.0), (3.0, 3.0)]
    assert rows(R.longest_hits(df, ["k"], "t", F.col("s")), "longest") == [(2,)]


def test_empty(spark):
    empty = track(spark, "a", "car", [(0, 0)]).limit(0)
    for df in (M.stationary(M.valid_tracks(empty)), M.vehicle_transitions(M.valid_tracks(empty)), M.state_trace(M.valid_tracks(empty))):
        assert df.count() == 0
