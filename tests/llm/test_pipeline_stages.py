"""The pipeline's toxicity and encoding stages, and the whole of it on the smallest and on empty tables."""

from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from trackloom.llm import bpe, toxicity
from trackloom.plans.durable import FILES_A_CORE

SF, SCHEMA = "/root/testdata/sf0.001", "doc_id long, text string, lang string, source string, n_chars long"


def test_toxicity_stage_drops_what_the_chain_rejects(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    odd = spark.createDataFrame([(None, None, "en", None, 0), (-1, "", "en", "s", 0), (-2, " \n", "en", "s", 2)], SCHEMA)
    both = docs.unionByName(odd)
    scored = {r.doc_id: r.toxicity.rejected for r in toxicity.score(both, toxicity.train(both, labels)).collect()}
    out = corpus_pipeline.without_toxic(spark, both, SF).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, rejected in scored.items() if not rejected)
    assert {None, -1, -2} <= {r.doc_id for r in out} and any(scored.values())


def test_encoding_stage_equals_the_library(spark):
    rows = [(1, "plain words"), (None, None), (2, ""), (3, "Ünï cödé 😀 " * 50), (3, "x" * 100_000), (4, " \n\t ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Merges(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))).rank, special_tokens={})
    want = Counter((i, tuple(own.encode_ordinary(t or "")), t or "") for i, t in rows)
    got = corpus_pipeline.encoded(spark, docs, "").collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == want and all(r.n_tokens == len(r.ids) for r in got)


def test_run_applies_the_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, docs.collect()))


@pytest.mark.parametrize("labelled", [False, True])
def test_no_documents(spark, tmp_path, labelled):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    (labels if labelled else labels.limit(0)).write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"] and out.count() == 0


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_return_few_partitions(spark, name):
    """Each partition is written as a file, however many the input and the shuffles have; no row goes with it."""
    most = FILES_A_CORE * spark.sparkContext.defaultParallelism
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    stage, set_before = dict(corpus_pipeline.STAGES)[name], {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    want = Counter(map(str, stage(spark, docs, SF).collect()))
    try:
        for k, v in zip(set_before, (str(most + 4), "false"), strict=True):
            spark.conf.set(k, v)
        got = stage(spark, docs.repartition(most + 4), SF)
        assert Counter(map(str, got.collect())) == want and got.rdd.getNumPartitions() <= most
    finally:
        for k, v in set_before.items():
            spark.conf.set(k, v)
