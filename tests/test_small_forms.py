"""Small functions against the plain rule: person regions, continuity, distinct events, chains, warnings."""

import pytest
from pyspark.sql import functions as F

from trackloom.functions import geometry as G
from trackloom.functions import tagging as T
from trackloom.operators import catalogue, diagnostics, evidence, linking, motion
from trackloom.sources import reviews as V


def region(box, width, height, strategy, factor):
    x1, y1, x2, y2 = box
    pw, ph, cx, cy = max(1, x2 - x1), max(1, y2 - y1), (x1 + x2) / 2, (y1 + y2) / 2
    r = {"full_person": box, "upper_body": (x1, y1, x2, int(y1 + 0.65 * ph)), "expanded": (int(cx - pw * factor / 2), int(cy - ph * factor / 2), int(cx + pw * factor / 2), int(cy + ph * factor / 2)),
         "interaction_region": (int(cx - pw * 1.3 / 2), int(y1 + 0.30 * ph), int(cx + pw * 1.3 / 2), int(y1 + 0.85 * ph))}[strategy]
    return max(0, r[0]), max(0, r[1]), min(width, r[2]), min(height, r[3])


@pytest.mark.parametrize("strategy", ["full_person", "upper_body", "expanded", "interaction_region"])
def test_person_regions(spark, strategy):
    boxes = [(10, 20, 51, 140), (0, 0, 5, 9), (-4, 3, 30, 60), (600, 400, 700, 500), (33, 33, 33, 33), (7, 5, 8, 100)]
    df = spark.createDataFrame(boxes, "x1 int, y1 int, x2 int, y2 int")
    got = df.select(*[c.alias(f"c{k}") for k, c in enumerate(G.region_in_frame(G.person_region(G.box(), strategy), F.lit(640), F.lit(480)))]).collect()
    assert [tuple(r) for r in got] == [region(b, 640, 480, strategy, 1.25) for b in boxes]


def test_unknown_region(spark):
    with pytest.raises(ValueError):
        G.person_region(G.box(), "half")


def test_continuity_of_targets(spark):
    frames = spark.createDataFrame([("c", "O1", "bag", "visible")] * 3 + [("c", "O1", "bag", "not_visible"), ("c", "O2", "cup", "occluded"), ("c", "P", "person", "visible")], "clip string, object string, class string, visibility string")
    changes = spark.createDataFrame([("c", "O1", 3, 2, 1, 1)], "clip string, object string, matched int, tracks int, changes int, unlinked int")
    report = diagnostics.continuity(frames, changes, ["clip", "object"])
    assert sorted(map(tuple, report.collect())) == [("c", "O1", 3, 3, 2, 1, 1), ("c", "O2", 1, 0, 0, 0, 0)]
    assert tuple(diagnostics.continuity_totals(report).first()) == (2, 1, 1)


def test_events_without_repeats(spark):
    rows = [("stopped", ["a"], 5.0, 6.0, {"z": "1", "y": "2"}, "m"), ("stopped", ["a"], 5.0, 6.0, {"y": "2", "z": "1"}, "m"), ("stopped", ["a"], 5.0, 6.0, {}, "m"), ("moved", ["b"], 1.0, 2.0, {}, "m"), ("moved", ["a"], 1.0, 2.0, {}, "n"), ("moved", ["a"], 1.0, 2.0, {}, "m")]
    got = motion.distinct_events(spark.createDataFrame(rows, "kind string, keys array<string>, start double, end double, attributes map<string,string>, method string")).collect()
    assert [(r.kind, r["keys"], r.start, len(r.attributes), r.method) for r in got][:2] == [("moved", ["a"], 1.0, 0, "m"), ("moved", ["b"], 1.0, 0, "m")] and len(got) == 4


def test_candidates_of_several_kinds(spark):
    a, b = spark.createDataFrame([(1, "x"), (1, "x")], "t int, kind string"), spark.createDataFrame([("y", 2, 3)], "kind string, t int, more int")
    assert sorted((r.t, r.kind, r.more) for r in catalogue.all_candidates(a, b).collect()) == [(1, "x", None), (2, "y", 3)]


def test_details_of_chains(spark):
    tracks = spark.createDataFrame([("a", 0.0), ("b", 5.0), ("c", 9.0), ("d", 1.0)], "track string, start double")
    merges = spark.createDataFrame([("b", "c", 1.0, 0.8), ("a", "b", 2.0, 0.9)], "a string, b string, gap double, score double")
    got = {r.chain: (r.tracks, r.n, r.merges and [(m.a, m.b) for m in r.merges]) for r in linking.chain_details(linking.merged_tracks(tracks, merges), merges).collect()}
    assert got == {"a": (["a", "b", "c"], 3, [("a", "b"), ("b", "c")]), "d": (["d"], 1, None)}


def test_union_of_reports(spark, tmp_path):
    V.union_csv([spark.createDataFrame([(1, "a")], "x int, y string"), spark.createDataFrame([(2, 0.5)], "x int, z double")], str(tmp_path / "r"))
    got = spark.read.option("header", True).csv(str(tmp_path / "r"))
    assert got.columns == ["x", "y", "z"] and sorted(map(tuple, got.collect())) == [("1", "a", None), ("2", None, "0.5")]


def test_relationships_of_an_entity(spark):
    edges = spark.createDataFrame([("e1", "e2", "met", "OBSERVED"), ("e3", "e1", "saw", "INFERRED"), ("e2", "e3", "met", "OBSERVED")], "source string, target string, label string, category string")
    found = spark.createDataFrame([("e1", "e9", 0.8, "medium"), ("e1", "e8", 0.1, "rejected"), ("e2", "e9", 0.5, "ambiguous")], "source string, candidate string, score double, label string")
    got = evidence.relationships_of(edges, found, spark.createDataFrame([("e1",)], "id string")).collect()
    assert sorted((r.other, r.relation, r.category, r.score) for r in got) == [("e2", "met", "OBSERVED", None), ("e3", "saw", "INFERRED", None), ("e9", "association", "MEDIUM", 0.8)]


def test_warnings_of_queries(spark):
    texts = ["something odd", "red car after 25:00", "a person at camera 3", "vehicle reversed"]
    df = T.tagged(spark.createDataFrame([(t,) for t in texts], "text string"))
    told = df.select("text", T.warnings({k: F.col(f"tags.{k}") for k in df.schema["tags"].dataType.names}, F.col("text")).alias("w")).collect()
    said = {r.text: r.w for r in told}
    assert said["something odd"] == ["No structured constraint; ranked by text alone."] and said["a person at camera 3"] == []
    assert said["red car after 25:00"] == ["Invalid clock time; use HH:MM or 6 PM."] and said["vehicle reversed"][0].startswith("No detector")
