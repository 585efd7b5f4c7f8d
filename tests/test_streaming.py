"""Stateful streams over files that arrive one after the other."""

import pytest
from pyspark.sql import functions as F

from trackloom.streaming import tracks as S


def run(spark, tmp_path, batches, schema, op, name):
    """Rows of ``op`` over a stream of one file a batch; batches end in a row far ahead that moves the watermark."""
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_millis(F.lit(1_700_000_000_000) + (F.col("s") * 1000).cast("long"))).drop("s")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if not i:
            source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
            query = op(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
        query.processAllAvailable()
    query.stop()
    return spark.table(name).collect()


CONTACT = "video_id string, person long, s double, probability double"


def test_contact_runs_end_with_a_free_hand_a_gap_or_the_watermark(spark, tmp_path):
    first = [("v", 1, t, 0.9) for t in (0.0, 0.5, 1.0)] + [("v", 1, 1.5, 0.1)] + [("v", 2, t, 0.8) for t in (0.0, 0.5)] + [("v", 2, 3.0, 0.8)]
    second = [("v", 2, 3.4, 0.8), ("v", 2, 3.9, 0.6)]
    rows = run(spark, tmp_path, [first, second, [("v", 9, 100.0, 0.1)], [("v", 9, 101.0, 0.1)]], CONTACT, lambda df: S.contact_candidates(df, late_seconds=2.0), "contacts")
    got = sorted((r.person, r.n, round((r.end - r.start).total_seconds(), 3), round(r.mean_probability, 4)) for r in rows)
    assert got == [(1, 3, 1.0, 0.9), (2, 2, 0.5, 0.8), (2, 3, 0.9, pytest.approx(0.7333))]


BOXES = "video_id string, kind string, id long, s double, x1 double, y1 double, x2 double, y2 double"


def test_links_go_on_over_batches_and_stop_after_a_gap(spark, tmp_path):
    box = lambda i, t, x: ("v", "cup", i, t, float(x), 0.0, x + 10.0, 10.0)
    batches = [[box(1, 0.0, 0), box(2, 0.0, 50)], [box(3, 0.5, 2), box(4, 0.5, 3), box(5, 0.5, 52)], [box(6, 5.0, 2)]]
    rows = run(spark, tmp_path, batches, BOXES, S.linked_boxes, "links")
    assert {r.id: r.track for r in rows} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 2, 6: 6}
