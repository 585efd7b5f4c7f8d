"""Stupid-backoff language model scores of all documents under the corpus's own n-gram counts.

The relational plan: n-grams of the documents are counted in tables partitioned by hash, the counts
are joined to the documents' n-grams, and log-scores are summed per document. A row for each n-gram
would shuffle many times the corpus, so rows are packed. Documents are gathered in chunks of about
``CHUNK_BYTES``, each task's rows in the order in which it reads them; a chunk's distinct n-grams are
cut by hash into parts and sent, sorted and compressed, to the tasks that own those parts. There all
chunks' counts meet and are summed (each n-gram comes at most once from a chunk, however frequent),
and the totals return to the chunks in the same order. Chunks and parts grow in number with the
corpus, not in size; no table is broadcast. A chunk sends no row to a part of which it has no
n-gram, so rows never outnumber n-grams: where parts do, the plan becomes the plain one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.words import blocks, mix, runs, word_hashes

#: Text in a chunk, and of the corpus for each part of the count tables.
CHUNK_BYTES = PART_BYTES = 8 << 20


def _shrink(values: np.ndarray) -> bytes:
    """Bytes of an array, those of equal weight together, compressed."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _grow(packed: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(dtype)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a batch that go to one chunk become one row. Chunks are numbered within the task, so
    rows that are alike are dealt over as many chunks as any others."""
    context = TaskContext.get()
    chunk, filled = (context.partitionId() if context else 0) << 32, 0
    for batch in batches:
        for first, end, data, offsets in blocks(batch.column("text")):
            if filled and filled + len(data) > CHUNK_BYTES:
                chunk, filled = chunk + 1, 0
            filled += len(data)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk], pa.int64()),
                    pa.array([batch.column("doc_id").slice(first, end - first).to_pylist()], pa.list_(pa.int64())),
                    pa.array([np.diff(offsets)], pa.list_(pa.int64())),
                    pa.array([zstandard.ZstdCompressor(level=3).compress(data.tobytes())], pa.binary()),
                ],
                names=["chunk", "ids", "lengths", "texts"],
            )


def _words(packed: pa.Table) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids of a chunk; the text index and the hash of each word."""
    ids, docs, hashes = [], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
    for row_ids, lengths, texts in zip(packed.column("ids"), packed.column("lengths"), packed.column("texts"), strict=True):
        data = pa.py_buffer(zstandard.ZstdDecompressor().decompress(texts.as_py()))
        offsets = np.concatenate([[0], np.cumsum(lengths.as_py(), dtype=np.int64)]).astype(np.int64)
        column = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), data])
        for first, _, raw, at in blocks(column):
            of, found = word_hashes(raw, at, lower=True)
            docs.append(of + len(ids) + first)
            hashes.append(found)
        ids += row_ids.as_py()
    return ids, np.concatenate(docs), np.concatenate(hashes)


def _grams(doc: np.ndarray, h: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length up to ``order``: word positions that end an n-gram of it, and its hash."""
    place = np.arange(len(h)) - np.searchsorted(doc, doc)
    out, gram = [], np.zeros(len(h), dtype=np.uint64)
    for n in range(1, order + 1):
        # The hash of the n words up to each position, from that of the n-1 up to the one before.
        before = np.zeros(len(h), dtype=np.uint64)
        before[1:] = gram[:-1]
        gram = mix(before * np.uint64(31) + h + np.uint64(n))
        ends = np.flatnonzero(place >= n - 1)
        out.append((ends, gram[ends]))
    return out


def _bounds(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Where each part begins among sorted hashes: a part is an equal range of them."""
    edges = np.array([(p << 64) // parts for p in range(parts)], dtype=np.uint64)
    return np.append(np.searchsorted(hashes, edges), len(hashes))


def _own(doc: np.ndarray, grams: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """For each n-gram of ``grams``, in their order: its place among the chunk's distinct ones by
    hash, and how often its own text holds it."""
    every, of = np.concatenate([g for _, g in grams]), np.concatenate([doc[ends] for ends, _ in grams])
    order = np.argsort(every, kind="stable")  # texts ascend within an n-gram
    ranked, of = every[order], of[order]
    new = np.ones(len(every), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    apart = new.copy()
    apart[1:] |= of[1:] != of[:-1]
    start = np.flatnonzero(apart)
    place, own = np.empty(len(every), dtype=np.int64), np.empty(len(every), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    own[order] = np.repeat(np.diff(np.append(start, len(every))), np.diff(np.append(start, len(every))))
    return place, own


def backoff_scores(docs: DataFrame, order: int = 3, alpha: float = 0.4) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_words, n_seen, log_score, mean_log_score, seen_share)``,
    one row for each row.

    Words are lower-cased (A-Z) runs of non-space bytes. The model of a row is the whole corpus
    without that row. A word's score is ``c(n-gram) / c(context)`` for the longest n-gram up to
    ``order`` words that the other rows hold, times ``alpha`` for each word the n-gram is short of
    what the position allows; a single word's context is all words of the corpus, and one that no
    other row holds counts as held once. ``log_score`` sums natural logarithms; ``n_seen`` counts
    words scored without backing off; the last two columns are those by word, null without words.

    Null texts count as empty: no words, score 0. Null and repeated doc_ids are passed through;
    a repeated row is another row, so its text is seen. Without rows the result is empty. A task
    holds a chunk, and a text larger than one is a chunk of its own. Other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sums = docs.agg(F.sum(F.octet_length(text)), F.sum(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"))).first()
    parts, words_in_all = 1 + (sums[0] or 0) // PART_BYTES, sums[1] or 0
    packed = docs.select(F.col("doc_id").cast("long"), text.alias("text")).mapInArrow(_pack, "chunk long, ids array<long>, lengths array<long>, texts binary")

    def count(key: tuple, packed: pa.Table) -> pa.Table:
        _, doc, h = _words(packed)
        found, times = np.unique(np.concatenate([g for _, g in _grams(doc, h, order)]), return_counts=True)
        at = _bounds(found, parts)
        rows = [(p, found[at[p] : at[p + 1]], times[at[p] : at[p + 1]]) for p in np.flatnonzero(np.diff(at)).tolist()]
        return pa.table({
            "part": pa.array([p for p, _, _ in rows], pa.int64()), "chunk": pa.array([key[0].as_py()] * len(rows), pa.int64()),
            "grams": pa.array([_shrink(np.diff(g, prepend=np.uint64(0))) for _, g, _ in rows], pa.binary()),
            "times": pa.array([_shrink(t.astype(np.uint32)) for _, _, t in rows], pa.binary())})

    def add(key: tuple, sent: pa.Table) -> pa.Table:
        grams = [np.cumsum(_grow(g.as_py(), np.uint64), dtype=np.uint64) for g in sent.column("grams")]
        times = [_grow(t.as_py(), np.uint32) for t in sent.column("times")]
        every, place = np.unique(np.concatenate(grams), return_inverse=True)
        summed = np.bincount(place, weights=np.concatenate(times), minlength=len(every)).astype(np.uint64)
        cuts = np.cumsum([len(g) for g in grams])[:-1]
        return pa.table({"chunk": sent.column("chunk"), "part": sent.column("part"), "totals": pa.array([_shrink(summed[p]) for p in np.split(place, cuts)], pa.binary())})

    counted = packed.groupBy("chunk").applyInArrow(count, "part long, chunk long, grams binary, times binary")
    totals = counted.groupBy("part").applyInArrow(add, "chunk long, part long, totals binary")

    def score(key: tuple, packed: pa.Table, replies: pa.Table) -> pa.Table:
        ids, doc, h = _words(packed)
        grams, n = _grams(doc, h, order), len(h)
        del h
        place, own = _own(doc, grams)
        replies = replies.sort_by("part")
        corpus = np.concatenate([np.zeros(0, dtype=np.uint64), *[_grow(t.as_py(), np.uint64) for t in replies.column("totals")]]).astype(np.int64)
        logs, seen, context = np.zeros(n), np.zeros(n, dtype=bool), np.full(n, float(words_in_all))
        first = 0
        for length, (ends, hashes) in enumerate(grams, 1):
            part = slice(first, first + len(hashes))
            first += len(hashes)
            times = (corpus[place[part]] - own[part]).astype(np.float64)
            held = times >= 1
            with np.errstate(divide="ignore", invalid="ignore"):
                straight = np.log((np.maximum(times, 1.0) if length == 1 else times) / context[ends])
            logs[ends] = np.where(held | (length == 1), straight, logs[ends] + np.log(alpha))
            seen[ends] = held
            context = np.full(n, np.nan)  # the n-gram that ends before a position
            context[ends[ends < n - 1] + 1] = times[ends < n - 1]
        sums = np.bincount(doc, weights=logs, minlength=len(ids))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(np.diff(runs(doc, len(ids))).astype(np.int64)),
                         "n_seen": pa.array(np.bincount(doc, weights=seen, minlength=len(ids)).astype(np.int64)), "log_score": pa.array(sums)})

    scored = packed.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(score, "doc_id long, n_words long, n_seen long, log_score double")
    return scored.select("*", F.try_divide("log_score", "n_words").alias("mean_log_score"), F.try_divide("n_seen", "n_words").alias("seen_share"))
