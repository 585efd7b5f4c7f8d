"""Joins with hot keys and connected components against plain forms."""

import random
from collections import Counter

from pyspark.sql import functions as F

from trackloom.plans.components import components
from trackloom.plans.durable import counted
from trackloom.plans.hot_keys import attach


def test_attach_salts_hot_keys(spark):
    rows = spark.range(6000).select((F.col("id") % 3000).alias("k"), F.col("id").alias("v")).unionByName(spark.range(5000).select(F.lit(7).cast("long").alias("k"), (F.col("id") + 10_000).alias("v")))
    summary = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("least")).where("k <> 8")
    plain = Counter(map(tuple, rows.join(summary, "k").collect()))
    assert Counter(map(tuple, attach(rows, summary, ["k"], "n", 11_000).collect())) == plain
    left = attach(rows, summary, ["k"], "n", 11_000, "left")
    assert left.count() == 11_000 and left.where("k = 8 and n is null").count() == 2
    plan = attach(rows, summary, ["k"], "n", 11_000)._jdf.queryExecution().toString()
    assert "__salt" in plan


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 200 + (i + 1) % 12) for i in range(12)] + [(rng.randint(300, 360), rng.randint(300, 360)) for _ in range(40)] + [(5, 5)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: label[x] for x in linked}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_counted(spark):
    df, n = counted(spark.range(1234))
    assert n == 1234 == df.count() and df.rdd.getNumPartitions() == 1
