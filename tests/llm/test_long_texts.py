"""Long texts in pieces give what the whole gives; large buckets are compared in slices."""

import random

import numpy as np

from trackloom.llm import minhash, words


def test_hashes_of_a_long_text(monkeypatch):
    text = " ".join(random.Random(1).choice(["a", "bb", "é", "x" * 300, "\n"]) for _ in range(2000)).encode()
    data, offsets = np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)])
    whole = words.word_hashes(data, offsets)
    monkeypatch.setattr(words, "BLOCK_BYTES", 64)
    cut = words.word_hashes(data, offsets)
    assert (cut[0] == whole[0]).all() and (cut[1] == whole[1]).all()


def test_signature_by_runs(monkeypatch):
    element = np.random.default_rng(2).integers(0, 2**63, 5000).astype(np.uint64)
    whole = minhash._signature(np.zeros(5000, dtype=np.int64), element, 1, 160)
    monkeypatch.setattr(minhash, "ELEMENTS", 700)
    assert (minhash._signature(np.zeros(5000, dtype=np.int64), element, 1, 160) == whole).all()


def test_slices_of_a_bucket_lose_no_link(spark, monkeypatch):
    """Two families that share buckets: every link is found whatever the slices are."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(120)] = f"v{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(minhash.near_duplicates(docs, 2, 90).collect())
    monkeypatch.setattr(minhash, "SLICE", 3)
    assert sorted(minhash.near_duplicates(docs, 2, 90).collect()) == plain
    assert len({r.component_id for r in plain}) > 3
