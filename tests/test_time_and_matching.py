"""Interval predicates, as-of joins, assignment, linking, contact, sources and streams."""

import itertools
import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trackloom.functions import geometry as G
from trackloom.functions import tagging as T
from trackloom.operators import contact as C
from trackloom.operators import intervals as I  # noqa: E741
from trackloom.operators import linking as L
from trackloom.operators import matching as M
from trackloom.sources import annotations as A
from trackloom.streaming import tracks as S


def test_interval_join_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    left = [(i, float(a), float(a + d)) for i, (a, d) in enumerate(zip(rng.integers(0, 50, 40), rng.integers(0, 9, 40)))]
    one = spark.createDataFrame(left, "id1 long, start1 double, end1 double")
    two = spark.createDataFrame(left, "id2 long, start2 double, end2 double")

    def holds(a, b, c, d, op, w):
        gap = {"before": c - b, "followed_by": c - b, "after": a - d}.get(op)
        if gap is not None:
            return 0 <= gap <= w
        return {"during": c <= a and b <= d, "overlaps": max(a, c) <= min(b, d), "near": max(0, c - b, a - d) <= w, "within": max(0, c - b, a - d) <= w}[op]

    for op in I.OPERATORS:
        got = sorted((r.id1, r.id2) for r in I.interval_join(one, two, op, 5, 4.0).collect())
        assert got == sorted((i, j) for i, a, b in left for j, c, d in left if holds(a, b, c, d, op, 5)), op
    with pytest.raises(ValueError):
        I.interval_join(one, two, "near", -2, 4.0)
    with pytest.raises(ValueError):
        I.interval_join(one, two, "beside", 1, 4.0)


def test_asof_ties_take_the_earlier(spark):
    left = spark.createDataFrame([(1, 10.0), (2, 20.0)], "k long, t1 double").withColumn("g", F.lit(0))
    right = spark.createDataFrame([(9.9, "a"), (10.1, "b"), (25.0, "c")], "t2 double, name string").withColumn("g", F.lit(0))
    assert [(r.k, r.name) for r in I.asof_nearest(left, right, ["g"], 0.3).collect()] == [(1, "a")]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10_000), st.booleans())
def test_assignment_is_the_best(rows, columns, seed, most):
    rng = np.random.default_rng(seed)
    w = np.round(rng.random((rows, columns)), int(rng.integers(1, 8))) - (0.2 if seed % 3 == 0 else 0)
    w[rng.random(w.shape) < 0.5] = -np.inf
    left, right = np.nonzero(np.isfinite(w))
    weight = w[left, right]
    if seed % 4 == 0 and len(left):  # a pair twice, the other time lighter
        left, right, weight = np.append(left, left[0]), np.append(right, right[0]), np.append(weight, weight[0] - 0.1)
    chosen = M.assign(left, right, weight, most)
    got = list(zip(left[chosen], right[chosen]))
    assert len({a for a, _ in got}) == len({b for _, b in got}) == len(got)
    best = (0, 0.0) if not most else (0, -9e9)
    for k in range(min(rows, columns), -1, -1):
        for r in itertools.combinations(range(rows), k):
            for c in itertools.permutations(range(columns), k):
                total = sum(w[i, j] for i, j in zip(r, c))
                if np.isfinite(total):
                    best = max(best, (k if most else 0, total))
    assert (len(got) == best[0] or not most) and abs(weight[chosen].sum() - best[1]) < 1e-9


def test_a_large_component_takes_memory_of_its_pairs():
    """Each left vertex has neighbours close by, as intervals do; all are connected."""
    import tracemalloc

    rng = np.random.default_rng(1)
    left = np.repeat(np.arange(50_000), 4)
    right = np.clip(left + rng.integers(-3, 4, len(left)), 0, 49_999)
    weight = rng.random(len(left))
    tracemalloc.start()
    chosen = M.assign(left, right, weight)
    assert tracemalloc.get_traced_memory()[1] < 2e8
    tracemalloc.stop()
    assert len(np.unique(left[chosen])) == len(np.unique(right[chosen])) == chosen.sum() > 45_000


def frames(spark, seed):
    rng = np.random.default_rng(seed)

    def side(name, classes):
        rows = []
        for f in range(8):
            for k in range(int(rng.integers(0, 6))):
                x, y = float(rng.integers(0, 12)), float(rng.integers(0, 12))
                rows.append((f % 2, f, k, str(rng.choice(classes)), x, y, x + float(rng.integers(4, 12)), y + float(rng.integers(4, 12))))
        return rows, spark.createDataFrame(rows, f"clip int, frame int, {name} int, class string, x1 double, y1 double, x2 double, y2 double")

    return side("left", ["person", "bag", "unknown_object"]), side("right", ["person", "backpack", "car"])


@pytest.mark.parametrize("least", [0.5, 0.3, 0.1])
def test_boxes_of_a_frame_match_by_the_greatest_sum(spark, least):
    (a, left), (b, right) = frames(spark, int(least * 10))
    fits = {"person": {"person"}, "bag": {"backpack", "handbag", "suitcase"}}
    ok = lambda x, y: y != "person" if x == "unknown_object" else y in fits[x]

    def iou(p, q):
        w, h = min(p[6], q[6]) - max(p[4], q[4]), min(p[7], q[7]) - max(p[5], q[5])
        shared = max(0, w) * max(0, h)
        return shared / ((p[6] - p[4]) * (p[7] - p[5]) + (q[6] - q[4]) * (q[7] - q[5]) - shared)

    want = {}
    for f in range(8):
        p, q = [x for x in a if x[1] == f], [x for x in b if x[1] == f]
        w = [[1 + iou(x, y) if ok(x[3], y[3]) and iou(x, y) >= least else None for y in q] for x in p]
        want[f] = max(
            sum(w[i][j] for i, j in zip(r, c)) for k in range(min(len(p), len(q)) + 1) for r in itertools.combinations(range(len(p)), k)
            for c in itertools.permutations(range(len(q)), k) if all(w[i][j] is not None for i, j in zip(r, c)))
    got, seen = dict.fromkeys(range(8), 0.0), set()
    for r in M.match_annotations(left.withColumn("visibility", F.lit("visible")), right, ["clip", "frame"], least).collect():
        assert not {(0, r.frame, r.left), (1, r.frame, r.right)} & seen
        seen |= {(0, r.frame, r.left), (1, r.frame, r.right)}
        got[r.frame] += 1 + r.iou
    assert all(abs(got[f] - want[f]) < 1e-9 for f in want)


def test_fewer_pairs_may_weigh_more(spark):
    """Three pairs of weight 2 outweigh four of 1.31; matching of predictions takes the four."""
    pairs = spark.createDataFrame([(k, k, 2.0) for k in range(3)] + [(k, k + 1, 1.31) for k in range(3)] + [(3, 0, 1.31)], "prediction long, label long, weight double")
    assert M.one_to_one(pairs, most=False).count() == 3 and M.one_to_one(pairs).count() == 4


def test_one_to_one_prefers_more_pairs(spark):
    pairs = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.5), (2, 1, 0.5), (3, 3, 0.2)], "prediction long, label long, weight double")
    assert sorted((r.prediction, r.label) for r in M.one_to_one(pairs).collect()) == [(1, 2), (2, 1), (3, 3)]


def test_greedy_takes_the_first_free(spark):
    hits = spark.createDataFrame([(1, 1, [7]), (1, 2, [7, 8]), (1, 3, [7])], "q long, rank long, candidates array<long>")
    assert sorted((r.rank, r.label) for r in M.greedy(hits, ["q"], ["rank"]).collect() if r.label) == [(1, 7), (2, 8)]


DET = "video_id string, kind string, id long, t double, x1 double, y1 double, x2 double, y2 double"


def test_object_tracks_link_split_and_abstain(spark):
    box = lambda i, t, x: ("V", "bag", i, t, x, 0.0, x + 10, 10.0)
    near = L.object_tracks(spark.createDataFrame([box(1, 0.0, 0.0), box(2, 1.0, 1.0), box(3, 2.5, 1.0)], DET))
    found = {r.id: r.track for r in near.collect()}
    assert found[1] == found[2] != found[3]
    crossing = L.object_tracks(spark.createDataFrame([box(1, 0.0, 0.0), box(2, 0.0, 4.0), box(3, 0.5, 2.0)], DET))
    found = {r.id: (r.track, r.ambiguous) for r in crossing.collect()}
    assert found[3][1] and found[3][0] not in (found[1][0], found[2][0])


def test_suppression_is_idempotent(spark):
    df = spark.createDataFrame([("f", 1, 0.9, 0.0, 0.0, 10.0, 10.0), ("f", 2, 0.8, 1.0, 0.0, 11.0, 10.0), ("f", 3, 0.7, 30.0, 0.0, 40.0, 10.0)], "frame string, id long, confidence double, x1 double, y1 double, x2 double, y2 double")
    once = L.suppressed(df, ["frame"])
    assert sorted(r.id for r in once.collect()) == [1, 3] == sorted(r.id for r in L.suppressed(once, ["frame"]).collect())


def test_contact_runs_and_manipulations(spark):
    obs = [("V", 1, i, 0.5 * i, "left", p, 0.0, 0.0, 4.0, 4.0) for i, p in enumerate([0.1, 0.6, 0.6, 0.6, 0.1, 0.6])]
    df = spark.createDataFrame(obs, "video_id string, person long, id long, t double, hand string, probability double, x1 double, y1 double, x2 double, y2 double")
    assert [(r.start, r.end, r.n) for r in C.contact_runs(df).collect()] == [(0.5, 1.5, 3)]
    assert sorted(r.kind for r in C.manipulations(df).collect()) == ["pickup", "placement"]


@pytest.mark.parametrize("text,field,value", [
    ("red car entered after 6 pm", "event", "entered_zone"), ("red car entered after 6 pm", "after", 1080), ("red car entered after 6 pm", "colour", "red"), ("red car entered", "entity", "car"),
    ("any vehicle stopped", "entity", "vehicle"), ("camera 3 person", "camera", "CAM-03"), ("between 6 and 7 pm", "after", 1080), ("between 6 and 7 pm", "before", 1140),
    ("stationary for two minutes", "min_duration", 120), ("within 30 seconds before", "relation", "before"), ("vehicle reversed", "unsupported", "reversed"), ("people near the car park", "location", "parking"),
    ("after 25:00", "after", None), ("followed by this event", "relation", "followed_by"),
])
def test_tags(spark, text, field, value):
    row = spark.createDataFrame([(text,)], "q string").select(T.tags(F.col("q"))[field].alias("x")).first()
    assert row.x == value


def test_clock_window_wraps_midnight(spark):
    df = spark.createDataFrame([(m,) for m in (10, 700, 1400)], "m int")
    assert [r.m for r in df.where(T.clock_matches(F.col("m"), F.lit(1380), F.lit(60))).collect()] == [10, 1400]


def test_geometry_forms(spark):
    one, two = tuple(map(F.lit, (0.0, 0.0, 0.5, 0.5))), tuple(map(F.lit, (0.0, 0.0, 0.5, 0.5)))
    row = spark.range(1).select(G.iou(one, two).alias("a"), G.iou(one, two, "area_zero").alias("b"), G.temporal_iou(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("c"), G.source_frame(F.lit(2.5), F.lit(1.0), F.lit(10)).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == (0.25, 1.0, 1.0, 2)


def test_manifest_and_labels(spark, tmp_path):
    video = dict(video_id="V", filename="f.avi", local_path="p", camera_id="C", recording_start="2018", fps=25.0, frame_count=100, duration=4.0, width=10, height=10, sha256="x", annotation_path="a")
    (tmp_path / "m.json").write_text(json.dumps({"videos": [video, video | {"video_id": "W"}]}))
    videos = A.read_manifest(spark, str(tmp_path / "m.json"))
    assert videos.count() == 2 and {r.rule for r in A.manifest_errors(videos).collect()} == {f"repeated {c}" for c in A.UNIQUE[1:]}
    types, bad = A.actor_types(spark.createDataFrame([(1, {"person": 1.0}, "V"), (2, {"bag": 1.0}, "V"), (3, {"a": 1.0, "b": 0.0}, "V")], A.TYPES))
    assert bad.count() == 1
    rows = [
        (71, {"person_puts_down_object": 1.0}, [([10, 20],)], [(1, [([10, 20],)]), (2, [([12, 20],)])], "V"),
        (72, {"x": 1.0}, [([10, 20],), ([20, 30],)], [(1, [([10, 20],)])], "V"), (73, {"x": 1.0}, [([10, 20],)], [(9, [([10, 20],)])], "V"),
    ]
    good, errors = A.activities(spark.createDataFrame(rows, A.ACTIVITIES), types, videos.where("video_id = 'V'"))
    row = good.first()
    assert (row.activity, row.actor, row.object, row.start_seconds, row.end_seconds) == (71, 1, 2, 0.4, 0.84)
    assert {r.id2: r.errors for r in errors.collect()} == {72: ["spans apart"], 73: ["known actors"]}
    boxes = [(1, 1, 5, "0 0 2 2", "V"), (2, 1, 5, "0 0 2 2", "V"), (3, 2, 500, "0 0 2 2", "V"), (4, 2, 6, "2 0 0 2", "V"), (5, 2, 7, "0 0 2 2", "V")]
    kept, broken = A.geometry(spark.createDataFrame(boxes, A.GEOMETRY), videos.where("video_id = 'V'"))
    assert [r.frame for r in kept.collect()] == [7] and broken.count() == 4
    assert A.mapped(good).first().status == "DIRECT"


def test_stream_segments_equal_batch(spark, tmp_path):
    rows = [("V", 1, f"2024-01-01 00:00:{s:02d}") for s in (0, 1, 2, 10, 11)] + [("V", 2, "2024-01-01 00:00:05"), ("V", 9, "2024-01-01 01:00:00")]
    df = spark.createDataFrame(rows, "video_id string, track long, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    batch = {(r.track, r.n) for r in S.track_segments(df, 3, 1).collect()}
    stream = S.track_segments(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 3, 1)
    query = stream.writeStream.format("memory").queryName("segments").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert batch == {(1, 3), (1, 2), (2, 1), (9, 1)}
    assert {(r.track, r.n) for r in spark.table("segments").collect()} == batch - {(9, 1)}  # still open


def test_stream_zone_alerts(spark, tmp_path):
    rows = [("V", 1, f"2024-01-01 00:00:0{s}", inside) for s, inside in ((0, False), (1, True), (2, True), (3, False))]
    df = spark.createDataFrame(rows, "video_id string, track long, ts string, inside boolean").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    alerts = S.zone_alerts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    query = alerts.writeStream.format("memory").queryName("alerts").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.kind for r in spark.table("alerts").collect()) == ["entered_zone", "exited_zone"]


def test_one_to_one_hands_python_many_components_at_a_time(spark):
    """Three hundred components of three pairs each, by no group of pandas rows for each of them."""
    pairs = spark.createDataFrame([x for i in range(0, 600, 2) for x in ((i, i, 0.5), (i, i + 1, 0.9), (i + 1, i, 0.1))], "prediction long, label long, weight double")
    found = M.one_to_one(pairs)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    assert {(r.prediction, r.label) for r in found.collect()} == {x for i in range(0, 600, 2) for x in ((i, i + 1), (i + 1, i))}
    assert M.one_to_one(pairs.where("weight > 0.2"), most=False).count() == 300
