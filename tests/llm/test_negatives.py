"""Hard negatives against a plain reading of the contract, with odd rows and many ties."""

import math
import random

import pytest

from trackloom.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>, row string, scores string, key int"


def brute(rows, every, n_pos, n_neg, low, high):
    rows = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for ai, ay, av in rows:
        if ai % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(av, v)), i, y) for i, y, v in rows if i != ai and len(v) == len(av))
        for best, positive, _ in [s for s in scored if s[2] == ay][:n_pos]:
            fitting = [s for s in scored if s[2] != ay and low * -best <= 100 * -s[0] <= high * -best][:n_neg]
            out += [(ai, positive, k + 1, i, -best, -s) for k, (s, i, _) in enumerate(fitting)]
    return sorted(out)


@pytest.mark.parametrize("seed,tile", [(1, 4096), (2, 7), (3, 40)])
def test_equals_brute_force(spark, monkeypatch, seed, tile):
    monkeypatch.setattr(negatives, "TILE", tile)
    monkeypatch.setattr(negatives, "ANCHOR_TILE", max(2, tile // 5))
    r = random.Random(seed)
    rows = [(i, r.choice([0, 0, 0, 1, 2]), [r.choice([-1.0, -0.3, 0.1, 0.5, 1.0, 2.5]) for _ in range(4)]) for i in range(-20, 160)]
    rows += [(i, 1, [0.5, 0.5, 0.5, 0.5]) for i in range(200, 260)]  # equal vectors
    rows += [rows[40], rows[40], rows[30], rows[30]]  # repeated rows, an anchor among them
    rows += [(300, 0, None), (301, None, [1.0] * 4), (None, 0, [1.0] * 4), (310, 1, [1.0, None, 1.0, 1.0]), (320, 1, [1.0, float("nan"), 1.0, 1.0]), (330, 1, [float("inf"), 1.0, 1.0, 1.0])]
    rows += [(400, 0, [1.0, 2.0]), (401, 0, [2.0, 1.0]), (402, 1, [1.0, 1.75]), (500, 0, []), (501, 0, []), (502, 1, [])]  # other widths
    docs = spark.createDataFrame([(*x, "r", "s", 3) for x in rows], SCHEMA).repartition(5)
    got = sorted(map(tuple, negatives.hard_negatives(docs, every=10, positives=3, negatives=4, low=0.8, high=1.0).collect()))
    assert got == brute(rows, 10, 3, 4, 80, 100)


def test_empty_and_without_anchors(spark):
    docs = spark.createDataFrame([(1, 0, [1.0], "r", "s", 3), (2, 1, [1.0], "r", "s", 3)], SCHEMA)
    assert negatives.hard_negatives(docs.limit(0)).collect() == [] == negatives.hard_negatives(docs).collect()
    with pytest.raises(ValueError, match="window"):
        negatives.hard_negatives(docs, high=1.5)


def test_scores_too_large_are_an_error(spark):
    docs = spark.createDataFrame([(0, 0, [1e30], "r", "s", 3), (2, 0, [1e30], "r", "s", 3)], SCHEMA)
    with pytest.raises(Exception, match="don't fit a long"):
        negatives.hard_negatives(docs).collect()


def test_large_scores_are_exact(spark):
    rows = [(0, 0, [3000001.0, 7.0]), (1, 0, [3000001.0, 3.0]), (2, 1, [3000001.0, 2.0]), (3, 1, [3000001.0, 2.5])]
    docs = spark.createDataFrame([(*x, "r", "s", 3) for x in rows], SCHEMA)
    assert sorted(map(tuple, negatives.hard_negatives(docs).collect())) == brute(rows, 100, 5, 5, 80, 100)
