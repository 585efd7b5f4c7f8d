"""The pipeline's stages against brute force where doc_ids are null or repeated."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from trackloom.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    made = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * 2 + str(rng.randrange(40)) for _ in range(60)) for _ in range(12)]
    rows = [(i + 10, t) for i, t in enumerate(made)]
    # Row 50 is twice there: once near document 10 and once near nothing. Null ids: near copies of a
    # named document, near copies of each other, and near nothing. -3 comes before its near copy 12.
    rows += [(50, made[0] + " tail"), (50, "quite another text " * 3), (None, made[1] + " tail"), (None, "no id one two three four five six seven eight nine ten " * 2)]
    rows += [(None, "no id one two three four five six seven eight nine ten " * 2 + "more"), (-3, made[2] + " tail"), (None, "alone and without any id at all"), (60, made[3] + " x"), (60, made[3] + " y"), (60, made[4] + " z")]
    rows += [(None, None), (None, None), (70, ""), (None, "the same row"), (None, "the same row"), (80, "the same named row"), (80, "the same named row")]
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}" if k < 22 else "s1", len(t or "")) for k, (i, t) in enumerate(rows)], SCHEMA)


def test_near_stage(spark, docs):
    rows, k = docs.collect(), corpus_pipeline.SHINGLE
    sets = []
    for r in rows:
        w = words(r.text)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    label = list(range(len(rows)))
    for _ in rows:
        for a in label[:]:
            for b in range(len(rows)):
                both = len(sets[a] & sets[b])
                if both and 100 * both >= corpus_pipeline.PERCENT * len(sets[a] | sets[b]):
                    old, new = max(label[a], label[b]), min(label[a], label[b])
                    label = [new if x == old else x for x in label]
    group = {r: label[i] for i, r in enumerate(rows)}
    out = corpus_pipeline.one_of_near(spark, docs.repartition(3), "").collect()
    assert Counter(group[r] for r in out if words(r.text)) == Counter({g: 1 for i, g in enumerate(label) if sets[i]})
    assert Counter(r for r in out if not words(r.text)) == Counter(r for r in rows if not words(r.text))
    for r in out:
        named = [q.doc_id for q in rows if group[q] == group[r] and q.doc_id is not None]
        assert r.doc_id == (min(named) if named else None)


def test_mixing_stage(spark, docs):
    expected = Counter()
    for r in mixing.mix(docs, corpus_pipeline.WEIGHTS, corpus_pipeline.MAX_REPEATS).collect():
        expected[r.doc_id, r["size"]] += r.copies
    out = corpus_pipeline.mixed(spark, docs.repartition(3), "").collect()
    assert Counter((r.doc_id, len(words(r.text))) for r in out) == +expected
    assert any(r.doc_id is None for r in out) and set(out) <= set(docs.collect())


def test_equal_texts_stage(spark, docs):
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    out = corpus_pipeline.one_of_equals(spark, docs, "").collect()
    assert Counter(normal(r.text) for r in out) == Counter({normal(r.text) for r in docs.collect()})
