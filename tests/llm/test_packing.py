"""Packing: ids as the tokenizer gives them for whole texts, cuts against brute force, and whole results."""

import json
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trackloom.llm import packing, queries

PATH, SF = public_tokenizers.path("word_bpe_49k.json"), "/root/testdata/sf0.001"


def padded(n, length):
    return 0 if n & (n - 1) == 0 else length - n


def flat(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)])


def coded(words, texts):
    return words.ids(words.text_rows(*flat(texts))[0]).tolist()


def price(stops, penalty, length):
    return sum(padded(b - a, length) + penalty[b] + packing.SEQUENCE for a, b in zip([0, *stops], stops))


def test_cuts_are_the_cheapest():
    r = random.Random(5)
    for _ in range(300):
        length = r.choice([8, 16, 24])
        ends = sorted(r.sample(range(1, 60), r.randint(3, 12)))
        ends = [e for k, e in enumerate(ends) if e - ([0] + ends)[k] <= length]
        ends = [e for k, e in enumerate(ends) if e - ([0] + ends)[k] <= length]
        if any(b - a > length for a, b in zip([0, *ends], ends)) or not ends:
            continue
        penalty = {e: r.choice([0, 2, 9]) for e in ends}
        best = {0: 0.0}
        for e in ends:
            best[e] = min(best[s] + padded(e - s, length) + penalty[e] + packing.SEQUENCE for s in [0, *ends] if s < e and e - s <= length)
        got = packing.cuts(np.array(ends), np.array([penalty[e] for e in ends]), length).tolist()
        assert got[-1] == ends[-1] and all(b - a <= length for a, b in zip([0, *got], got))
        assert price(got, penalty, length) == best[ends[-1]]


def test_ids_are_those_of_whole_texts():
    t, r = Tokenizer.from_file(PATH), random.Random(3)
    words = packing._Ids(open(PATH, encoding="utf-8").read(), 1)
    assert words.splits
    signs = "aAbZz09éÉßİıΣς'’.,;:!?-_\t\n\r \x0b\x0c\x1c\x85\xa0 ́̈中文😀ﬁ"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += ["it's I'LL don't!", "<|endoftext|> in a text, a<|startoftext|>b.", "x" * 5000, "...", "A.B.C. 3.14, 1,000", "Ab'S. ab's."]
    for text in texts:
        assert coded(words, [text]) == [*t.encode(text, add_special_tokens=False).ids, 1], text
    assert coded(words, texts) == [i for text in texts for i in [*t.encode(text, add_special_tokens=False).ids, 1]]


def test_sentences_and_lines_end():
    words = packing._Ids(open(PATH, encoding="utf-8").read(), 1)
    rows, final = words.text_rows(*flat(["One two. three?! \"four.\" five\nsix é. seven", "x"]))
    assert [k for k, f in enumerate(final.tolist()) if f] == [2, 4, 6, 7, 10, 12, 14] and (rows == 0).nonzero()[0].tolist() == [12, 14]


def test_tokens_outlive_forgetting(monkeypatch):
    monkeypatch.setattr(packing, "PARTS", 40)
    t, words = Tokenizer.from_file(PATH), packing._Ids(open(PATH, encoding="utf-8").read(), 1)
    for k in range(60):
        text = f"word{k} Some, text {k * 7}. and? again"
        assert coded(words, [text]) == [*t.encode(text, add_special_tokens=False).ids, 1]


def test_long_text_in_runs(monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_BYTES", 50)
    t, words = Tokenizer.from_file(PATH), packing._Ids(open(PATH, encoding="utf-8").read(), 1)
    text = "Some words, and some. " * 30 + "x" * 300 + " end.\nlines\n" * 20
    assert coded(words, [text]) == [*t.encode(text, add_special_tokens=False).ids, 1]


def checked(pieces, texts, length):
    """Every token of every document once, sequences without gaps, padding's share."""
    t = Tokenizer.from_file(PATH)
    found, seqs = defaultdict(list), defaultdict(list)
    for p in pieces:
        found[p.doc_id].append(p)
        seqs[p.sequence_id].append(p)
        assert p.length * 4 == len(p.ids) > 0
    assert set(found) == set(texts)
    for i, own in found.items():
        own.sort(key=lambda p: p.start)
        ids = [*t.encode(texts[i] or "", add_special_tokens=False).ids, 1]
        assert [p.start for p in own] == np.cumsum([0, *[p.length for p in own]])[:-1].tolist()
        assert np.concatenate([np.frombuffer(p.ids, "<u4") for p in own]).tolist() == ids and {p.doc_tokens for p in own} == {len(ids)}
    sizes = []
    for own in seqs.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0, *[p.length for p in own]])[:-1].tolist()
        sizes.append(sum(p.length for p in own))
    assert max(sizes) <= length
    return sum(padded(n, length) for n in sizes) / sum(sizes)


def test_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    pieces = packing.pack(docs, PATH, 1).collect()
    assert checked(pieces, texts, 2048) < 0.01
    crc = {(p.doc_id, p.start): (p.length, zlib.crc32(p.ids), p.doc_tokens) for p in pieces}
    assert {(r.doc_id, r.start): (r.length, r.ids_crc32, r.doc_tokens) for r in queries.op11_packing(spark, SF).collect()} == crc


@pytest.mark.parametrize("stretch", [100, 1 << 20])
def test_odd_rows(spark, monkeypatch, stretch):
    # Workers import the module anew: stretches are set in this process by running the task's function here.
    monkeypatch.setattr(packing, "STRETCH", stretch)
    monkeypatch.setattr(packing, "BLOCK_BYTES", 300)
    monkeypatch.setattr(packing.TaskContext, "get", classmethod(lambda c: type("T", (), {"partitionId": lambda s: 3})()))
    import pyarrow as pa

    texts = {1: None, 2: "", 3: " \n\t\n", 4: "one two. three " * 400, 5: "x" * 9000, 6: "nopunctuation at all " * 300, 7: "same", 8: "same", 9: "Ünï. cödé! " * 50}
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(list(texts), pa.int64()), "text": pa.array(list(texts.values()), pa.string())})
    work = packing._pack(open(PATH, encoding="utf-8").read(), 1, 256)
    rows = [type("P", (), r)() for b in work(iter([batch, batch.slice(0, 0)])) for r in b.to_pylist()]
    assert checked(rows, texts, 256) < 0.05


def test_nulls_repeats_empty_and_sequences(spark):
    schema = "doc_id long, text string, length string, ids int, start string, sequence_id string"
    docs = spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in [(None, "some words."), (None, "some words."), (7, "twice"), (7, "twice"), (8, None), (9, "long " * 5000)]], schema).coalesce(1)
    pieces = packing.pack(docs, PATH, 1, 64)
    got = pieces.collect()
    assert sorted((str(p.doc_id) for p in got if p.start == 0)) == ["7", "7", "8", "9", "None", "None"]
    whole = packing.sequences(pieces, 0, 64).collect()
    assert all(len(s.ids) == 4 * (s.tokens if s.tokens & (s.tokens - 1) == 0 else 64) for s in whole) and sum(s.tokens for s in whole) == sum(p.length for p in got)
    first = min(got, key=lambda p: (p.sequence_id, p.offset))
    assert next(s.ids for s in whole if s.sequence_id == first.sequence_id).startswith(bytes(first.ids))
    assert packing.pack(docs.limit(0), PATH, 1).collect() == [] and packing.sequences(packing.pack(docs.limit(0), PATH, 1), 0).collect() == []


def test_tokenizer_that_does_not_split(spark, tmp_path):
    """Without lower-casing or marks of their own, words are encoded whole."""
    content = json.load(open(PATH, encoding="utf-8"))
    content["normalizer"] = None
    with open(os.path.join(tmp_path, "t.json"), "w") as f:
        json.dump(content, f)
    t = Tokenizer.from_file(os.path.join(tmp_path, "t.json"))
    words = packing._Ids(open(os.path.join(tmp_path, "t.json"), encoding="utf-8").read(), 1)
    text = "Some Words, HERE. and there!"
    assert not words.splits and coded(words, [text]) == [*t.encode(text, add_special_tokens=False).ids, 1]
