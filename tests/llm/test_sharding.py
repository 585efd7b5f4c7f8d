"""Sharding: the law on every kind of row, groups of equal rows, and what is written."""

import zlib
from collections import Counter, defaultdict

import numpy as np

from trackloom.llm import queries, sharding

SCHEMA = "doc_id long, text string, source string, shard string, slot int, row int, size string"


def size_of(text):
    return len((text or "").encode()) + 1


def check(got, texts, n):
    """Sizes, checksums, one law, gapless slots, near equal bytes as far as single records allow."""
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, size_of(t), zlib.crc32((t or "").encode())) for i, t in texts)
    slots, load = defaultdict(list), Counter()
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < n
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return [load[s] for s in range(n)]


def test_equal_rows_and_null_ids_are_spread(spark):
    texts = [(7, "the same text again")] * 4000 + [(None, "a text without an id")] * 3000 + [(i, f"text {i}") for i in range(500)]
    docs = spark.createDataFrame([(i, t, None, "x", 1, 2, "y") for i, t in texts], SCHEMA)
    load = check(sharding.shards(docs, 16).collect(), texts, 16)
    assert max(load) - min(load) <= 0.02 * np.mean(load)


def test_equal_rows_without_ids_in_many_partitions_end(spark):
    """Nothing but the rows' numbers tells these apart."""
    texts = [(None, "one text for all")] * 1200
    docs = spark.createDataFrame([(i, t, None, "x", 1, 2, "y") for i, t in texts], SCHEMA).repartition(19)
    load = check(sharding.shards(docs, 16).collect(), texts, 16)
    assert max(load) - min(load) <= size_of(texts[0][1])


def test_one_huge_record_beside_many_small_ones(spark):
    texts = [(0, "x" * 300_000)] + [(i, "y" * (i % 50)) for i in range(1, 3000)]
    docs = spark.createDataFrame([(i, t, None, "x", 1, 2, "y") for i, t in texts], SCHEMA)
    load = sorted(check(sharding.shards(docs, 4).collect(), texts, 4))
    assert load[-1] <= 300_001 + 1200 and load[2] - load[0] <= 0.01 * load[0]


def test_empty_table_and_one_row(spark):
    assert sharding.shards(spark.createDataFrame([], SCHEMA)).collect() == []
    one = spark.createDataFrame([(None, None, None, None, None, None, None)], SCHEMA)
    check(sharding.shards(one, 3).collect(), [(None, None)], 3)


def test_query_over_the_documents(spark):
    sf = "/root/testdata/sf0.01"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op3_sharding(spark, sf).collect()
    load = check(got, texts, 16)
    assert max(load) - min(load) <= 0.01 * np.mean(load)
    again = queries.op3_sharding(spark, sf).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_deal_is_even_for_many_shards():
    sizes = np.random.default_rng(1).integers(1, 1000, 20_000).astype(float)
    load = np.bincount(sharding.deal(sizes, 100), weights=sizes, minlength=100)
    assert load.max() - load.min() <= 0.002 * load.mean()


def test_files_hold_every_row_in_slot_order(spark, tmp_path):
    texts = [(None, "no id")] * 5 + [(1, "one"), (1, "another text of one id")] + [(2, "twice")] * 2 + [(i, f"text {i % 9}") for i in range(3, 60)]
    docs = spark.createDataFrame([(i, t, None, "x", k, 2, "y") for k, (i, t) in enumerate(texts)], SCHEMA)
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.columns == [*docs.columns, "__shard"]
    assert Counter(map(tuple, back.drop("__shard").collect())) == Counter(map(tuple, docs.collect()))
