"""Every text operator on small fixtures: brute force, nulls, empty and long texts, ties, repeats."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

import corpus_pipeline
from tests.compare import assert_same, duck
from trackloom.llm import bpe, exact_dedup, lm_score, minhash, mixing, pii, quality, queries, sharding, token_counts, toxicity

SF = "/root/testdata/sf0.001"
RANKS, PATTERN = queries.RANKS, public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, source string, kept string, n_words int"
WORDS = [f"w{i}" for i in range(60)]


def texts(n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, nulls in every column, empty and long texts, repeated rows, clashing names."""
    made = texts(60, 1)
    rows = [(i, t, f"s{i % 3}", "x", 1) for i, t in enumerate(made)]
    rows += [(100 + i, made[i] + " tail", "s0", "x", 1) for i in range(20)] + [(200 + i, made[7], "s0", None, None) for i in range(15)]
    rows += [(300, None, "s1", "x", 1), (301, "", None, "x", 1), (302, " \t\n ", "s1", "x", 1), (303, "one", "s1", "x", 1), (304, "One", None, "x", 1), (None, "no id at all", "s2", "x", 1)]
    rows += [(305, " ".join(WORDS * 400), "s2", "x", 1), (5, made[5], "s2", "x", 1), (306, made[3].replace(" ", "  \n"), "s2", "x", 1)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), duck(SF).sql(queries.ORACLES[name]).df())


@pytest.mark.parametrize("k,percent", [(3, 85), (2, 60)])
def test_near_duplicates(spark, docs, rows, k, percent):
    sets = {}
    for r in rows:
        w = words(ascii_lower(r.text))
        sets[r.doc_id] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    label = {i: i for i in sets if i is not None}
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    got = minhash.near_duplicates(docs, k, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == label.get(r.doc_id) and r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id is None or r.doc_id == label[r.doc_id])
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_exact_duplicates(spark, docs, rows, monkeypatch):
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[normal(r.text)].append(r.doc_id)
    expected = Counter((r.doc_id, min((i for i in groups[normal(r.text)] if i is not None), default=None), len(groups[normal(r.text)]), hashlib.sha256(normal(r.text).encode()).hexdigest()) for r in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_duplicates(docs).collect()) == expected
    left = exact_dedup.one_of_each(docs)
    assert left.columns == docs.columns and Counter(normal(r.text) for r in left.collect()) == Counter(groups.keys())
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0


def test_fingerprint_parts_combine():
    data = exact_dedup.np.frombuffer(random.Random(2).randbytes(300_000), dtype="uint8")
    whole = exact_dedup.combine(exact_dedup.chunk_hashes(data))
    parts = [exact_dedup.combine(exact_dedup.chunk_hashes(data[a:b])) for a, b in ((0, 7), (7, 200_001), (200_001, 300_000))]
    assert exact_dedup.combine(parts) == whole != exact_dedup.combine(parts[::-1])


def test_equal_fingerprints_of_different_texts_stay_apart(spark, monkeypatch):
    one = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "aa")], "doc_id long, text string")
    real = exact_dedup.fingerprints
    monkeypatch.setattr(exact_dedup, "fingerprints", lambda d: real(d).withColumn("fingerprint", F.lit(7).cast("long")))
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.exact_duplicates(one).collect()} == {(1, 1), (2, 2), (3, 1)}


def test_bpe(spark, docs, rows):
    ranks = bpe.Merges(bpe.read_ranks(RANKS)).rank
    reference = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    odd = ["".join(rng.choice("abcdeth  \n\t\x1c\x85\xa0é´½0123'slrevm.,!-_日ⅷ　") for _ in range(rng.randint(0, 50))) for _ in range(300)] + ["a" * 5000, "=-" * 3000]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    got = bpe.encode(more, RANKS, PATTERN, decoded=True).collect()
    text = {r.doc_id: r.text or "" for r in more.collect()}
    for r in got:
        assert r.ids == reference.encode_ordinary(text[r.doc_id]) and bytes(r.decoded).decode() == text[r.doc_id]
    assert bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS).count() == len(rows)
    assert bpe.encode(empty(spark), RANKS, PATTERN).count() == 0


def test_sharding(spark, docs, rows):
    got = sharding.shards(docs, 4).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 4
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy").otherwise(F.repeat(F.lit("x"), (F.col("id") % 50).cast("int"))).alias("text"))
    sizes = [r.b for r in sharding.shards(many, 16).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 16 and max(sizes) < 1.05 * sum(sizes) / 16 and min(sizes) > 0.95 * sum(sizes) / 16
    assert sharding.shards(empty(spark)).count() == 0


@pytest.mark.parametrize("order", [2, 3])
def test_language_model(spark, docs, rows, order, monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(lm_score, "PART_BYTES", 10_000)
    texts_ = [words(ascii_lower(r.text)) for r in rows]
    grams = [[Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for w in texts_] for k in range(order + 1)]
    counts = [sum(own, Counter()) for own in grams]
    total = sum(counts[1].values())
    expected = []
    for at, (r, w) in enumerate(zip(rows, texts_)):
        rest = lambda g: counts[len(g)][g] - grams[len(g)][at][g]  # noqa: B023, E731
        s, seen = 0.0, 0
        for i in range(len(w)):
            top = min(i + 1, order)
            for k in range(top, 0, -1):
                g = tuple(w[i - k + 1 : i + 1])
                if k == 1 or rest(g) >= 1:
                    s += (top - k) * math.log(0.4) + math.log((max(rest(g), 1) / total) if k == 1 else rest(g) / rest(g[:-1]))
                    seen += k == top and rest(g) >= 1
                    break
        expected.append((r.doc_id or -1, len(w), seen, round(s, 4), round(s / len(w), 4) if w else None, round(seen / len(w), 4) if w else None))
    got = [(r.doc_id or -1, r.n_words, r.n_seen, round(r.log_score, 4), *[None if x is None else round(x, 4) for x in (r.mean_log_score, r.seen_share)])
           for r in lm_score.backoff_scores(docs, order).collect()]
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert lm_score.backoff_scores(empty(spark)).count() == 0


def test_token_counts(spark, docs, rows):
    scores = token_counts.zipf_scores(bpe.read_ranks(RANKS))
    reference = Tokenizer(models.Unigram(list(scores.items()), unk_id=0, byte_fallback=False))
    split = bpe.splitter(PATTERN)
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in token_counts.token_counts(docs, RANKS, PATTERN).collect()}
    for r in rows:
        pieces = split(r.text or "")
        assert got[r.doc_id] == (len(pieces), sum(len(reference.encode(p.encode().decode("latin-1")).ids) for p in pieces))
    assert token_counts.token_counts(empty(spark), RANKS, PATTERN).count() == 0


def test_quality(spark):
    rng = random.Random(4)
    made = ["".join(rng.choice("aab b\n #é ") for _ in range(rng.randint(0, 200))) for _ in range(150)] + ["", None, "a b c d e f g h i j " * 30]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")).collect()}
    for i, t in enumerate(made):
        w, lines, seen = words(t), (t or "").split("\n"), set()
        repeated, dup = set(), 0
        at = defaultdict(list)
        for j in range(len(w) - 4):
            at[tuple(w[j : j + 5])].append(j)
        for v in at.values():
            if len(v) > 1:
                repeated |= {x for j in v for x in range(j, j + 5)}
        for line in lines:
            if words(line):
                dup += line in seen
                seen.add(line)
        longest = [max((next((k for k in range(len(w)) if j + k >= len(w) or m + k >= len(w) or w[j + k] != w[m + k]), len(w)) for m in range(len(w)) if m != j), default=0) for j in range(len(w))] if len(w) < 90 else None
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(repeated))
        assert r.base_failed == (len(w) < 10 or 100 * len(repeated) > 20 * len(w)) and (not r.kept or not r.base_failed)
        if longest is not None:
            assert r.longest_repeat == max(longest, default=0) and r.n_covered == len({x for j, n in enumerate(longest) if n >= 10 for x in range(j, j + n)})
    assert quality.quality_rules(empty(spark)).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(t):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_personal_data(spark):
    rng = random.Random(5)
    made = ["".join(rng.choice("0123456789" * 2 + ".+-() a@b_%.\né") for _ in range(rng.randint(0, 100))) for _ in range(300)]
    made += ["", None, "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "a@" * 500, "1 2 3 4 " * 500, "9" * 3000, "x" * 2000 + "@y.z", "call (988) 555-2485 now", "look at home. The end", "due 2024-03-05, page 12"]
    found = pii.find(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string"))
    kinds = {k: F.col(f"base_{k}") for k in pii.KINDS}
    got = {r.doc_id: r for r in found.select("doc_id", pii.listed(kinds).alias("b"), *[F.size(f"added_{k}").alias(k) for k in pii.KINDS]).collect()}
    for i, t in enumerate(made):
        assert got[i].b == base(t), t
    n = len(made)
    assert got[n - 3].phone == 1 and all(got[i][k] == 0 for i in (n - 2, n - 1) for k in pii.KINDS)
    hidden = {r.doc_id: r.text for r in pii.redact(found).collect()}
    assert "555" not in hidden[n - 3] and hidden[n - 2] == made[n - 2]
    assert pii.find(empty(spark)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    clean = [f"c{i}" for i in range(300)]
    made = []
    for i in range(1200):
        w = [rng.choice(clean) for _ in range(40)]
        if i % 5 == 0:
            w[rng.randrange(40)] = rng.choice(["idiot", "scum.", "vexogara", "vexogino"])
        made.append((i, " ".join(w), int(i % 5 == 0), "clash"))
    docs = spark.createDataFrame(made, "doc_id long, text string, label int, toxicity string")
    labels = docs.where("doc_id < 800").select("doc_id", F.col("label").alias("toxic"))
    out = {r.doc_id: r.rejected for r in toxicity.toxicity(docs, labels).collect()}
    held = [(y, out[i]) for i, _, y, _ in made if i >= 800]
    assert sum(r for y, r in held if y) >= 0.9 * sum(y for y, _ in held) and sum(r for y, r in held if not y) <= 2
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "c1 idiot"), (1, "c1")], "doc_id long, text string")
    assert [r.rejected for r in toxicity.toxicity(odd, labels.limit(0)).collect()] == [False] * 4
    assert toxicity.toxicity(empty(spark), labels).count() == 0


def test_mixing(spark, docs, rows):
    got = mixing.mix(docs).collect()
    total = sum(len(words(r.text)) for r in rows)
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r["size"] for r in got)
    assert abs(sum(r.taken for r in got) - total) <= 4
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(empty(spark)).count() == 0


def test_mixing_splits_into_buckets(spark, docs, monkeypatch):
    whole = sorted((str(r.doc_id), r.taken) for r in mixing.mix(docs.where("doc_id <> 5")).collect())
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 5)
    assert sorted((str(r.doc_id), r.taken) for r in mixing.mix(docs.where("doc_id <> 5")).collect()) == whole


def test_pipeline(spark):
    out = spark.read.parquet(f"{SF}/documents.parquet")
    before = None
    for name, stage in corpus_pipeline.STAGES:
        columns, before = out.columns, out.count()
        out = stage(spark, out, SF).cache()
        if name != "byte_bpe":
            assert out.columns == columns
        if name in ("toxicity", "exact_dedup", "minhash_near_dedup"):
            assert 0 < out.count() <= before and out.select("doc_id").distinct().count() == out.count()
    assert out.count() == before
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r.decoded == source[r.doc_id] for r in out.collect())
