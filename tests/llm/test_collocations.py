"""Collocations against a plain reading of the contract, tries against dictionaries, and odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from trackloom.llm import collocations
from trackloom.llm.collocations import Trie

SCHEMA = "doc_id long, text string, lang string, n long, phrase string, a int, symbol int, word string, total int"


def brute(rows, least, longest, top):
    total, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        held = {p: a for p, a in own.items() if len(p) >= 2 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        scored = []
        for p, a in held.items():
            if any(len(q) > len(p) and b >= a and inside(p, q) for q, b in held.items()):
                continue
            score, _, l, r = min((1000 * a * total[lang] // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, n + 1, p.decode(), -a, l, r, total[lang], -s) for n, (s, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def texts(seed, n):
    r = random.Random(seed)
    words = ["New", "york", "the", "of", "city", "ß", "Äpfel", "a-b", "x\x0by", "it's", "end"]
    out = []
    for _ in range(n):
        t = "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", " ;", "\x0c"]) for _ in range(r.randint(0, 60)))
        out.append((t + "Strong green tea house. " * r.choice([0, 0, 1, 3]), r.choice(["en", "en", "en", "fr", None])))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(k, t, lang, 1, "p", 2, 3, "w", 4) for k, (t, lang) in enumerate(rows)], SCHEMA)


def as_rows(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize("seed,least,longest,top,shard", [(1, 5, 5, 2000, 1 << 20), (2, 3, 5, 7, 1 << 20), (3, 8, 3, 2000, 1 << 20), (4, 4, 5, 2000, 6), (5, 2, 2, 50, 1 << 20)])
def test_equals_brute_force(spark, monkeypatch, seed, least, longest, top, shard):
    monkeypatch.setattr(collocations, "SHARD", shard)  # several tries and dictionaries
    monkeypatch.setattr(collocations, "RANKED", 40)
    rows = texts(seed, 120)
    rows += [rows[3]] * 4 + [(None, "en"), ("", None), (" \n\t.", "fr"), ("aa aa aa aa aa aa aa aa", "de")]
    assert as_rows(collocations.collocations(frame(spark, rows).repartition(5), least, longest, top)) == brute(rows, least, longest, top)


def test_long_text_in_runs(spark):
    """A text of several blocks, with pieces across them and a word longer than a block."""
    text = "strong green tea house and " * 200_000 + "y" * 2_500_000 + " strong green tea. " + "tea house, " * 9
    rows = [(text, "en"), ("tea house and strong", None)]
    got = as_rows(collocations.collocations(frame(spark, rows), 100, 5, 50))
    assert got == brute(rows, 100, 5, 50)


def test_empty(spark):
    assert collocations.collocations(frame(spark, [("a b", "en")]).limit(0)).collect() == []
    assert collocations.collocations(frame(spark, [("a b. a", "en"), (None, None)])).collect() == []


def test_runs_keep_pieces():
    data = np.frombuffer(b"aa bb. cc dd ee, ff gg", dtype=np.uint8)
    old = collocations.BLOCK_BYTES
    collocations.BLOCK_BYTES = 6
    try:
        words = [(bytes(raw[s:e]), bool(f if k else goes)) for raw, bounds, goes in collocations._runs(data, np.array([0, len(data)])) for _, _, fs, ss, es in [collocations._scanned(raw, bounds)] for k, (f, s, e) in enumerate(zip(fs, ss, es))]
    finally:
        collocations.BLOCK_BYTES = old
    assert words == [(b"aa", False), (b"bb", True), (b"cc", False), (b"dd", True), (b"ee", True), (b"ff", False), (b"gg", True)]


@pytest.mark.parametrize("seed", range(12))
def test_trie_holds_its_phrases(seed, monkeypatch):
    if seed % 3 == 0:
        monkeypatch.setattr(collocations, "SHARD", 2)  # its own numbering of words
    r = np.random.default_rng(seed)
    k, vocabulary = int(r.integers(1, 5)), int(r.integers(1, 60))
    phrases = np.unique(r.integers(0, vocabulary, (int(r.integers(1, 400)), k)), axis=0).astype(np.int32)
    phrases = phrases[r.permutation(len(phrases))]
    numbers = r.permutation(10_000)[: len(phrases)]
    trie, known = Trie(phrases, numbers), {tuple(p): n for p, n in zip(phrases.tolist(), numbers.tolist())}
    stream = r.integers(-1, vocabulary + 3, 3000).astype(np.int32)
    got = trie.numbers(stream, k).tolist()
    assert got == [known.get(tuple(stream[i : i + k].tolist()), -1) if i + k <= len(stream) else -1 for i in range(len(stream))]
