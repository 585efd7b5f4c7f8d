"""Exact duplicates of long texts, whose chunks are rows of their own, and which rows stay."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np

from trackloom.llm import exact_dedup


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def expected(rows):
    ids = defaultdict(list)
    for i, t in rows:
        ids[normal(t)].append(i)
    out = []
    for i, t in rows:
        own = [x for x in ids[normal(t)] if x is not None]
        keep = min(own) if own else None
        out.append((i, keep, len(ids[normal(t)]), i == keep, hashlib.sha256(normal(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_long_and_short_texts_alike(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "CHUNK_CHARS", 50)
    monkeypatch.setattr(exact_dedup, "PER_SALT", 3)
    rng = random.Random(5)
    base = ["".join(rng.choice("ab é日\n\t ") for _ in range(rng.randint(0, 400))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t.replace(" ", "  \n")) for i, t in enumerate(base)]
    rows += [(200 + i, base[3]) for i in range(20)] + [(7, base[7])] * 3 + [(None, base[9])] * 2 + [(None, "only without an id")] * 2 + [(7, "another text of id 7"), (300, None), (301, ""), (302, " \n ")]
    docs = spark.createDataFrame([(i, t, "x", 1, None) for i, t in rows], "doc_id long, text string, raw string, chunk int, known string")
    got = exact_dedup.exact_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got), key=repr) == expected(rows)


def test_fingerprint_of_chunks_is_that_of_the_whole(spark, monkeypatch):
    text = "".join(random.Random(6).choice("abc é") for _ in range(1000)).replace("  ", " ")
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    whole = exact_dedup.fingerprints(docs).collect()
    monkeypatch.setattr(exact_dedup, "CHUNK_CHARS", 64)
    assert exact_dedup.fingerprints(docs).collect() == whole
    raw = normal(text).encode()
    n, (high, low) = exact_dedup.combine(exact_dedup.chunk_hashes(np.frombuffer(raw, dtype=np.uint8)))
    assert (whole[0].n_bytes, whole[0].fingerprint) == (n, high << 31 | low)


def test_empty_table(spark):
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_texts_of_several_chunks(spark):
    """Characters of several bytes across the borders of chunks; texts that differ in their last byte."""
    base = "é中 x" * 60_000
    texts = [(1, base + "a"), (2, base + "b"), (3, base.replace(" ", "\t\n") + "a"), (4, base + "b"), (5, "short"), (6, None)]
    docs = spark.createDataFrame([(i, t, "k") for i, t in texts], "doc_id long, text string, chunk string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(docs).collect()}
    assert got == {1: (1, 2), 3: (1, 2), 2: (2, 2), 4: (2, 2), 5: (5, 1), 6: (6, 1)}
    one = exact_dedup.fingerprints(docs).where("doc_id = 1").first()
    n, (high, low) = exact_dedup.combine(exact_dedup.chunk_hashes(np.frombuffer((base + "a").encode(), dtype=np.uint8)))
    assert (one.n_bytes, one.fingerprint) == (n, high << 31 | low)
