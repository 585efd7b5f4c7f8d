"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read again.

Toxic documents go; of equal texts one stays; of near duplicates one stays; sources are mixed to
their target weights (documents taken more than once are repeated, those not taken go); and what
is left is encoded by a byte-level BPE and decoded again.

Documents are rows, not ids: a null doc_id takes part in every stage, and rows that repeat a doc_id
are judged each by its own text. Joins back to the documents are on ``row_key``. A stage returns its
rows in few partitions, as each is written as a file.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.llm import bpe, exact_dedup, minhash, mixing, toxicity
from trackloom.plans.durable import in_few_files, shared_folder

#: Similarity of near duplicates in percent, and the words of a shingle.
PERCENT, SHINGLE = 80, 5
WEIGHTS, MAX_REPEATS = [5, 2, 1], 3
#: Bytes of a batch of texts that is handed to Python, at most; the JVM and Python each hold one for every task.
BATCH_BYTES = 8 << 20


def bounded(spark: SparkSession) -> None:
    """Lowers the session's batches for Python to ``BATCH_BYTES`` where they may be larger."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    allowed = spark.conf.get(name).rstrip("b")  # "-1" or less: no limit
    if not 0 < int(allowed) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def row_key(docs: DataFrame) -> Column:
    """25 bytes that name a row of ``docs``: they order by doc_id, null last, and end in a digest of
    all columns, so only rows that are equal throughout share them."""
    parts = [F.concat(F.coalesce(F.length(v).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(v, F.lit(""))) for v in (F.col(c).cast("string") for c in docs.columns)]
    number = F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(2**63))))  # as unsigned, negative ids are first
    ordered = F.coalesce(F.concat(F.lit("00"), F.lpad(number, 16, "0")), F.lit("01" + "0" * 16))
    return F.unhex(F.concat(ordered, F.md5(F.concat(*parts))))


def _numbered() -> Column:
    """Counts rows of one key from 1; they are equal, so any order will do."""
    return F.row_number().over(W.partitionBy("__row").orderBy("__row"))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the rows that the classifier chain rejects. Null and empty texts, and rows of a table
    without toxic labels, stay; equal texts are judged alike; a text is judged by all of it, however long."""
    bounded(spark)
    chain = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return in_few_files(toxicity.score(docs, chain, "__toxicity").where("not __toxicity.rejected").drop("__toxicity"))


def one_of_equals(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with one row for each text, after spaces are normalised: that of the least doc_id, null last.
    Null counts as empty. Long texts are compared chunk by chunk."""
    bounded(spark)
    return in_few_files(exact_dedup.one_of_each(docs))


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with one row for each group of near duplicates, the first by ``row_key``. Texts
    without words are linked with nothing and stay."""
    bounded(spark)
    named = docs.withColumn("__row", row_key(docs))
    gone = minhash.near_duplicates(named.select(F.col("__row").alias("doc_id"), "text"), SHINGLE, PERCENT).where("not kept").select(F.col("doc_id").alias("__row"))
    left = named.join(gone.hint("shuffle_hash"), "__row", "left_anti").withColumn("__n", _numbered())
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return in_few_files(left.where((F.col("__n") == 1) | ~worded).select(*docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs``, each row as often as the mix starts to take it. Texts without words are not taken; equal rows
    follow one another."""
    bounded(spark)
    named = docs.withColumn("__row", row_key(docs))
    # Equal rows follow one another in the mix: the first of them may be taken once more than the rest.
    taken = mixing.mix(named, WEIGHTS, MAX_REPEATS, row="__row").groupBy("__row").agg(
        F.min("copies").alias("__least"), (F.sum("copies") - F.count("*") * F.min("copies")).alias("__more")).where("__least + __more > 0")
    joined = named.join(taken.hint("shuffle_hash"), "__row").withColumn("__n", _numbered())
    joined = joined.withColumn("__copies", (F.col("__least") + (F.col("__n") <= F.col("__more")).cast("long")).cast("int")).where("__copies > 0")
    return in_few_files(joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded``: token ids and the text that they decode to, one row for each of
    ``docs``. Null and empty texts have no ids and decode to nothing; a text is held whole by its task."""
    bounded(spark)
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return in_few_files(coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.decode("decoded", "UTF-8").alias("decoded")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("exact_dedup", one_of_equals),
    ("minhash_near_dedup", one_of_near),
    ("mixing", mixed),
    ("byte_bpe", encoded),
]

#: A trained classifier and a tokenizer can't be expressed in SQL; tests compare the deduplicating and
#: mixing stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared checkpoint folder."""
    at, docs = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs
