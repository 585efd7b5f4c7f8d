"""Personal data: positions and overlaps against brute force, trees against Spark's own, added spans."""

import random
import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from trackloom.llm import pii

SCHEMA = "doc_id long, text string, base_ip string, taken int, email string, start int"


def found(spark, texts):
    """Base and added values by kind for each text."""
    rows = pii.find(spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in enumerate(texts)], SCHEMA)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        for column in r.asDict():
            if column.startswith(("base", "added")):
                assert all((r.text or "")[s.start : s.end] == s.value for s in r[column])
    return {r.doc_id: {c: [s.value for s in r[c]] for c in r.asDict() if c.startswith(("base", "added"))} for r in rows}


def test_positions_of_many_matches(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab é日1 ") for _ in range(n)) for n in (0, 1, 30, 4000, 20_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", pii.matches(F.col("text"), "[ab1]+").alias("m"))
    for r in df.collect():
        assert [(s.start, s.end, s.value) for s in r.m] == [(m.start(), m.end(), m[0]) for m in re.finditer("[ab1]+", texts[r.id])]


def test_spans_apart(spark):
    rng = random.Random(3)
    span = lambda: (lambda a: (a, a + rng.randint(1, 6), "v"))(rng.randint(0, 1500))
    rows = [(i, [span() for _ in range(n)], [span() for _ in range(m)]) for i, (n, m) in enumerate([(0, 5), (5, 0), (20, 20), (400, 300), (900, 20)])]
    df = spark.createDataFrame(rows, "id long, a array<struct<start:int,end:int,value:string>>, b array<struct<start:int,end:int,value:string>>")
    for r in df.select("*", pii._apart(F.col("a"), F.col("b")).alias("left")).collect():
        assert sorted(map(tuple, r.left)) == sorted(tuple(s) for s in r.a if not any(s.start < o.end and o.start < s.end for o in r.b))


def test_column_trees_are_the_models(spark):
    columns = pii.features(F.col("kind"), F.col("value"), F.col("before"), F.col("after"))
    table = pii.examples(spark, 600).select("label", F.struct(*[c.alias(k) for k, c in columns.items()]).alias("x")).cache()
    names = list(columns)
    flat = VectorAssembler(inputCols=names, outputCol="features").transform(table.select("label", "x", "x.*"))
    model = GBTClassifier(labelCol="label", maxIter=5, maxDepth=3, stepSize=0.3, seed=7).fit(flat)
    trees = pii.read_trees(model.toDebugString, model.treeWeights, names)
    for r in model.transform(flat).select("probability", pii.probability(trees, F.col("x")).alias("p")).collect():
        assert abs(r.probability[1] - r.p) < 1e-9


def test_added_spans(spark):
    texts = [
        "pay 7536784127813050 4845168114407329 now", "ring +1 (826) 555-4081 190.137.223.204 or not", "mail anna [at] example [dot] org today", "call (555) 123-4567 please",
        "on 2024-05-06 and 12.05.1999 at noon", "version 1.2.3 and order 12345678", "look at thence. Of all", "7536784127813051 4845168114407320",
    ]
    got = found(spark, texts)
    assert got[0]["base_card"] == [] and set(got[0]["added_card"]) <= {"7536784127813050", "4845168114407329"} and got[0]["added_card"]
    assert got[1]["base_phone"] == [] and got[1]["added_phone"] == ["+1 (826) 555-4081"] and got[1]["base_ip"] == ["190.137.223.204"]
    assert got[2]["added_email"] == ["anna [at] example [dot] org"] and got[3]["added_phone"] == ["(555) 123-4567"]
    for i in (4, 5, 6, 7):
        assert not any(got[i][f"added_{k}"] for k in pii.KINDS), (texts[i], got[i])


def test_odd_rows(spark):
    """Null ids and texts, repeated rows, clashing columns, a very long table of numbers, no rows."""
    long = "\n".join(f"{i} a{i}@b.org 10.0.{i % 256}.{i % 99} +1 (555) 555-{i:04d}" for i in range(3000))
    rows = [(None, "x@y.z", "x", 1, "y", 2)] * 3 + [(1, None, None, None, None, None), (2, "", "x", 1, "y", 2), (3, long, "x", 1, "y", 2)]
    out = pii.find(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, len(r.base_email)) for r in out) == [(False, 1, 0), (False, 2, 0), (False, 3, 3000), (True, 0, 1), (True, 0, 1), (True, 0, 1)]
    last = next(r for r in out if r.doc_id == 3)
    assert len(last.base_ip) == 3000 and all(long[s.start : s.end] == s.value for k in pii.KINDS for s in [*last[f"base_{k}"], *last[f"added_{k}"]])
    every = sorted((s.start, s.end) for k in pii.KINDS for s in last[f"added_{k}"])
    assert all(a[1] <= b[0] for a, b in zip(every, every[1:]))
    assert pii.find(spark.createDataFrame([], SCHEMA)).collect() == []
