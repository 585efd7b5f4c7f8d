"""Exact duplicates: composable polynomial fingerprints, then comparison of the texts chunk by chunk.

A text is cut into chunks; every chunk is hashed by a polynomial modulo several primes. Chunk hashes
combine by length-shifted arithmetic, ``h(ab) = h(a) * base**len(b) + h(b)``. Texts of one chunk are
hashed where they are read; the chunks of longer ones are rows of their own, hashed in tasks of
their own and combined by an aggregate. Texts with equal fingerprint and length are candidates only:
their chunks are then compared, character by character, with those of one of them, a chunk a row,
spread over tasks where a group is large. Every text is hashed once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.plans.durable import durable
from trackloom.plans.hot_keys import attach

#: Primes below 2**31 and a base for each: a byte's product fits 39 bits, a chunk's sum 56.
PRIMES = np.array([2147483647, 2147483629], dtype=np.int64)
BASES = np.array([911382323, 972663749], dtype=np.int64)
#: Bytes hashed as one row of the matrix product.
HASH_BYTES = 1 << 16
#: Characters of a text from which on its chunks are hashed apart, and bytes of a chunk that is a row of its own
#: when long texts are hashed and when texts are compared.
CHUNK_CHARS, CHUNK_BYTES = 1 << 16, 1 << 16
#: Bytes of chunks that are handed on at a time.
CUT_BYTES = 4 << 20
#: Texts compared with one representative in one task's group.
PER_SALT = 500
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def _powers(n: int) -> np.ndarray:
    out = np.ones((n, len(PRIMES)), dtype=np.int64)
    for c in range(len(PRIMES)):
        for i in range(1, n):
            out[i, c] = int(out[i - 1, c]) * int(BASES[c]) % int(PRIMES[c])
    return out


_DESCENDING: list[np.ndarray] = []


def chunk_hashes(data: np.ndarray, size: int = HASH_BYTES) -> list[tuple[int, tuple[int, ...]]]:
    """(length, hash modulo each prime) of each run of ``size`` bytes; the last may be shorter."""
    if not _DESCENDING:
        _DESCENDING.append(_powers(HASH_BYTES)[::-1].copy())
    weights = _DESCENDING[0]
    full = len(data) // size
    out: list[tuple[int, tuple[int, ...]]] = []
    if full:
        rows = data[: full * size].reshape(full, size).astype(np.int64) + 1
        out += [(size, tuple(map(int, h))) for h in (rows @ weights[-size:]) % PRIMES]
    if len(data) > full * size:
        rest = data[full * size :].astype(np.int64) + 1
        out.append((len(rest), tuple(map(int, (rest @ weights[-len(rest) :]) % PRIMES))))
    return out


def combine(parts: list[tuple[int, tuple[int, ...]]]) -> tuple[int, tuple[int, ...]]:
    """(length, hash) of the texts of ``parts`` one after the other."""
    length, value = 0, [0] * len(PRIMES)
    for n, h in parts:
        value = [(v * pow(int(b), n, int(p)) + x) % int(p) for v, b, p, x in zip(value, BASES, PRIMES, h, strict=True)]
        length += n
    return length, tuple(value)


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[], [], []]
        for text in batch.column("text"):
            raw = SPACE.sub(" ", text.as_py()).encode()
            n, (high, low) = combine(chunk_hashes(np.frombuffer(raw, dtype=np.uint8)))
            for column, value in zip(columns, (n, high << 31 | low, hashlib.sha256(raw).hexdigest()), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("raw"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())],
            names=["doc_id", "raw", "n_bytes", "fingerprint", "text_sha256"])


def _piece(pieces: pa.Table) -> pa.Table:
    """Length, hash and shift (``base**length``) of one chunk, modulo each prime."""
    n, (high, low) = combine(chunk_hashes(np.frombuffer(pieces.column("piece")[0].as_py(), dtype=np.uint8)))
    made = {"n": n, "high": high, "low": low} | {f"shift_{name}": pow(int(b), n, int(p)) for name, b, p in zip(("high", "low"), BASES, PRIMES, strict=True)}
    return pa.table({c: pieces.column(c) for c in ("doc_id", "raw", "text_sha256", "number", "chunk")} | {c: pa.array([v], pa.int64()) for c, v in made.items()})


def _texts(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` (null is empty) and ``raw``, a hash of the text as it is."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("raw"))


def _normal(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of the bytes of ``normal``, each with its number in the text and the text's other columns."""
    for batch in batches:
        others = [name for name in batch.schema.names if name != "normal"]
        texts, of, number, pieces, size = batch.column("normal"), [], [], [], 0

        def made() -> pa.RecordBatch:
            taken = batch.select(others).take(pa.array(of, pa.int64()))  # noqa: B023
            return pa.RecordBatch.from_arrays([*taken.columns, pa.array(number, pa.int32()), pa.array(pieces, pa.binary())], names=[*others, "chunk", "piece"])  # noqa: B023

        for row in range(batch.num_rows):
            data = memoryview(texts[row].as_buffer())
            for k, at in enumerate(range(0, max(1, len(data)), CHUNK_BYTES)):
                of.append(row), number.append(k), pieces.append(bytes(data[at : at + CHUNK_BYTES]))
                size += len(pieces[-1])
                if size >= CUT_BYTES:
                    yield made()
                    of, number, pieces, size = [], [], [], 0
        if of:
            yield made()


def _chunks(df: DataFrame) -> DataFrame:
    """One row for each chunk of ``normal``; an empty text has one empty chunk. A text is cut in one pass, by
    bytes."""
    others = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "normal")
    return df.mapInArrow(_cut, f"{others}, chunk int, piece binary")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, raw, n_bytes, fingerprint, text_sha256)`` for each row of ``docs``; ``raw`` is a
    64-bit hash of the text before spaces are normalised."""
    rows = _texts(docs)
    short = rows.where(F.length("text") <= CHUNK_CHARS).mapInArrow(_short, "doc_id long, raw long, n_bytes long, fingerprint long, text_sha256 string")
    long = rows.where(F.length("text") > CHUNK_CHARS).select("doc_id", "raw", F.monotonically_increasing_id().alias("number"), _normal(F.col("text")).alias("normal"))
    pieces = _chunks(long.withColumn("text_sha256", F.sha2("normal", 256)))
    row = ["doc_id", "raw", "text_sha256", "number"]  # the number sets equal rows apart
    hashed = pieces.groupBy(*row, "chunk").applyInArrow(_piece, "doc_id long, raw long, text_sha256 string, number long, chunk int, n long, high long, low long, shift_high long, shift_low long")
    long = hashed.groupBy(*row).agg(F.array_sort(F.collect_list(F.struct("chunk", "n", "high", "low", "shift_high", "shift_low"))).alias("parts"))

    def combined(which: str, prime: int) -> Column:
        return F.aggregate("parts", F.lit(0).cast("long"), lambda acc, x: (acc * x.getField(f"shift_{which}") + x.getField(which)) % F.lit(prime))

    n_bytes = F.aggregate("parts", F.lit(0).cast("long"), lambda acc, x: acc + x.getField("n"))
    value = F.shiftleft(combined("high", int(PRIMES[0])), 31).bitwiseOR(combined("low", int(PRIMES[1])))
    long = long.select("doc_id", "raw", n_bytes.alias("n_bytes"), value.alias("fingerprint"), "text_sha256")
    return short.unionByName(long)


def unequal(docs: DataFrame, small: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """Rows ``(n_bytes, fingerprint, text_sha256)`` whose text differs from that of their group's
    row with the smallest doc_id, though length and fingerprint agree.

    ``small``: ``fingerprints`` of ``docs``; ``groups(n_bytes, fingerprint, n, first_id)``: candidates,
    with ``n > 1`` rows each. Only candidates' texts are normalised again.
    """
    key, row = ["n_bytes", "fingerprint"], ["known", "id", "raw"]
    named = [F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id")]
    wanted = attach(small, groups, key, "n", total, spread=F.xxhash64("doc_id", "raw")).select(*named, "raw", *key, "text_sha256", "first_id", "n")
    wanted = durable(wanted.groupBy(*row).agg(*[F.first(c).alias(c) for c in (*key, "text_sha256", "first_id", "n")], F.count("*").alias("alike")))
    texts = _texts(docs).select(*named, "raw", "text", F.monotonically_increasing_id().alias("number"))
    found = attach(texts, wanted, row, "alike", total, spread=F.xxhash64("number"))
    salts = F.ceil(F.col("n") / PER_SALT).cast("int")
    found = durable(found.select(
        *key, "text_sha256", _normal(F.col("text")).alias("normal"), salts.alias("salts"), F.pmod(F.xxhash64("number"), salts).cast("int").alias("salt"),
        F.expr("first_id <=> if(known, id, null)").alias("first")))
    firsts = found.where("first").dropDuplicates(key).select(*key, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "normal")
    right = _chunks(firsts).withColumnRenamed("piece", "wanted")
    same = _chunks(found.drop("salts", "first")).join(right, [*key, "salt", "chunk"], "left")
    return same.where("not (piece <=> wanted)").select(*key, "text_sha256").distinct()


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Groups of equal texts of ``docs(doc_id, text, ...)`` after each run of spaces, tabs, line
    breaks (``[\\x20\\x09-\\x0D]+``) became one space.

    Returns one row for each input row: ``doc_id, keep_id, group_size, kept, text_sha256``. Null
    texts count as empty. ``keep_id`` is the group's smallest doc_id; null ids are ignored for it
    unless a group has no other, then it is null and its rows are all kept. Rows that repeat the
    smallest doc_id with the same text are one document and all marked kept; ``one_of_each`` leaves
    one row. Without rows the result is empty. Other columns are not read.
    """
    key = ["n_bytes", "fingerprint"]
    small = durable(fingerprints(docs))
    total = small.count()
    groups = durable(small.groupBy(*key).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1"))
    split = durable(unequal(docs, small, groups, total)) if not groups.isEmpty() else groups.select(*key, F.lit("").alias("text_sha256")).limit(0)
    if not split.isEmpty():  # a collision: those texts are told apart by their digests
        small = small.join(split.withColumn("other", F.col("text_sha256")), [*key, "text_sha256"], "left").fillna("", ["other"])
    else:
        small = small.withColumn("other", F.lit(""))
    key.append("other")
    classes = small.groupBy(*key).agg(F.count("*").alias("group_size"), F.min("doc_id").alias("keep_id"))
    out = attach(small, classes, key, "group_size", total)
    return out.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each text, that of the smallest doc_id; all columns stay. Of the rows
    that repeat both the kept doc_id and its text one stays, as of a group without any doc_id."""
    kept = durable(exact_duplicates(docs).where("kept").groupBy("doc_id", "text_sha256").count())
    keyed = docs.withColumn("__sha", F.sha2(_normal(F.coalesce(F.col("text").cast("string"), F.lit(""))), 256))
    of = kept.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__of")).hint("shuffle_hash")
    picked = keyed.join(of, keyed["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__of")), "left_semi")
    if not kept.where("count > 1").isEmpty():
        picked = picked.dropDuplicates(["doc_id", "__sha"])
    return picked.drop("__sha")
