"""Persons and objects on hand-made tracks."""

from trackloom.operators import interactions as N
from trackloom.operators import pairs as P
from trackloom.operators.motion import valid_tracks

SCHEMA = "video_id string, track string, object_type string, t double, x1 double, y1 double, x2 double, y2 double"


def scene(spark, **tracks):
    rows = []
    for name, (kind, points) in tracks.items():
        high = 20.0 if kind == "person" else 8.0
        rows += [("V", name, kind, float(t), float(x), 0.0, float(x) + 6, high) for t, x in points]
    return valid_tracks(spark.createDataFrame(rows, SCHEMA))


def test_picked_up(spark):
    bag = [(i * 0.5, 100) for i in range(9)] + [(4 + i * 0.5, 100 + 8 * i) for i in range(1, 7)]
    walker = [(i * 0.5, 60 + 5 * i) for i in range(9)] + [(4 + i * 0.5, 100 + 8 * i) for i in range(1, 7)]
    found = N.handled(scene(spark, bag=("bag", bag), p=("person", walker))).collect()
    assert [(r.kind, r.person, r.object, r.start) for r in found] == [("picked_up", "p", "bag", 4.0)]


def test_placed_then_unattended(spark):
    carried = [(i * 0.5, 8 * i) for i in range(7)]
    bag = carried + [(3 + i * 0.5, 48) for i in range(1, 25)]
    walker = carried + [(3 + i * 0.5, 48) for i in range(1, 3)] + [(4 + i * 0.5, 48 + 25 * i) for i in range(1, 23)]
    tracks = scene(spark, bag=("bag", bag), p=("person", walker))
    assert [(r.kind, r.person, r.start) for r in N.handled(tracks).collect()] == [("placed_object", "p", 3.0)]
    alone = N.unattended(tracks, 5.0).collect()
    assert [(r.object, r.person, r.end) for r in alone] == [("bag", "p", 15.0)]
    watcher = [(i * 0.5, 50) for i in range(31)]
    assert N.unattended(scene(spark, bag=("bag", bag), p=("person", walker), q=("person", watcher)), 5.0).count() == 0


def test_approach_and_departure(spark):
    still = [(i * 0.5, 100) for i in range(20)]
    walker = [(i * 0.5, 10 * i) for i in range(20)]
    found = P.approaches(P.aligned_pairs(scene(spark, car=("car", still), p=("person", walker))))
    assert sorted(r.kind for r in found.collect()) == ["approached_vehicle", "moved_away"]
