"""Quality rules on whole texts, with repetition found by suffix arrays over words.

A suffix array of each text's words is built by prefix doubling, vectorised over a block of texts:
ranks of runs of 1, 2, 4, ... words, where only suffixes that still tie are sorted again. Adjacent
suffixes' longest common prefixes come from the stored ranks. Where the common prefix of a suffix
with a neighbour is l, its first l words are a repeated substring, maximal to the right; spans of
such substrings are united. The rules limit the covered share of the words and the longest repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.words import blocks, mix, runs, words_of

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_A_WORD = re.compile(rb"[^\x20\x09-\x0D]")


def repeat_lengths(word: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word the length of the longest run from there that its text holds at another
    place too (overlaps count); 0 if the word itself is unique in the text.

    ``word``: 64-bit word hashes, grouped by ``doc``.
    """
    n = len(word)
    out = np.zeros(n, dtype=np.int64)
    if not n:
        return out
    key = mix(word ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    new = np.ones(n, dtype=bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # where the group begins
    stop = np.searchsorted(doc, doc, side="right")  # end of each word's text
    levels, length = [rank], 1
    tied = ~(new & np.append(new[1:], True))
    live = order[tied]  # in suffix order; groups are consecutive
    place = np.flatnonzero(tied)
    while len(live):
        ahead = live + length
        after = np.where(ahead < stop[live], rank[np.minimum(ahead, n - 1)] + 1, 0)
        resort = np.lexsort((after, rank[live]))
        live, after = live[resort], after[resort]
        order[place] = live
        base = rank[live]
        new = np.ones(len(live), dtype=bool)
        # A text's end differs from every other end, so suffixes that stop there never tie.
        new[1:] = (base[1:] != base[:-1]) | (after[1:] != after[:-1]) | (after[1:] == 0)
        rank = rank.copy()
        rank[live] = np.maximum.accumulate(np.where(new, place, 0))
        levels.append(rank)
        length *= 2
        tied = ~(new & np.append(new[1:], True))
        live, place = live[tied], place[tied]
    first = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    a, b = order[first], order[first + 1]
    common = np.zeros(len(a), dtype=np.int64)
    for t in range(len(levels) - 1, -1, -1):
        ia, ib = a + common, b + common
        inside = (ia < stop[a]) & (ib < stop[b])
        same = inside & (levels[t][np.minimum(ia, n - 1)] == levels[t][np.minimum(ib, n - 1)])
        common[same] += 1 << t
    np.maximum.at(out, a, common)
    np.maximum.at(out, b, common)
    return out


def covered(length: np.ndarray, least: int, reach: int | None = None) -> np.ndarray:
    """Words inside the union of the spans ``[i, i + length[i])`` with ``length[i] >= least``;
    ``reach``: spans of that many words only."""
    start = np.flatnonzero(length >= least)
    mark = np.zeros(len(length) + 1, dtype=np.int64)
    np.add.at(mark, start, 1)
    np.add.at(mark, start + (length[start] if reach is None else reach), -1)
    return np.cumsum(mark[:-1]) > 0


def _measure(window: int, least: int):
    schema = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_covered longest_repeat".split()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in blocks(batch.column("text")):
                n = end - first
                words = words_of(data, offsets)
                at = runs(words.doc, n)
                length = repeat_lengths(words.hashes(), words.doc)

                def by_doc(values: np.ndarray, at: np.ndarray = at) -> np.ndarray:
                    return np.diff(np.concatenate([[0], np.cumsum(values)])[at])

                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
                longest = np.zeros(n, dtype=np.int64)
                np.maximum.at(longest, words.doc, length)
                raw, lines = data.tobytes(), []
                for i in range(n):
                    held = [x for x in raw[offsets[i] : offsets[i + 1]].split(b"\n") if _A_WORD.search(x)]
                    lines.append(len(held) - len(set(held)))
                columns = [np.diff(at), by_doc(chars[words.end] - chars[words.start]), np.diff(symbols[offsets]), np.array(lines),
                           by_doc(covered(length, window, window)), by_doc(covered(length, least)), longest]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, n), *[pa.array(c.astype(np.int64)) for c in columns]], names=["doc_id", *schema])

    return work, "doc_id long, " + ", ".join(f"{c} long" for c in schema)


def quality_rules(docs: DataFrame, window: int = 5, least: int = 10, max_covered_percent: int = 20, max_repeat: int = 100) -> DataFrame:
    """Measures and verdicts of ``docs(doc_id, text, ...)``, one row for each input row.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered,
    longest_repeat, base_failed, kept``. ``n_repeat_words``: words in runs of ``window`` words that
    the text holds twice or more. ``n_covered``: words in the union of all repeated runs of at least
    ``least`` words; ``longest_repeat``: the longest repeated run. ``base_failed``: under ten words,
    or over a fifth of them in repeated windows. ``kept``: not ``base_failed``, at most
    ``max_covered_percent`` of the words covered and no repeat longer than ``max_repeat`` words.

    Null texts count as empty (all zero, failed). Null and repeated doc_ids are passed through;
    other columns are not read.
    """
    work, schema = _measure(window, least)
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, schema)
    failed = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    fine = F.expr(f"100 * n_covered <= {int(max_covered_percent)} * n_words and longest_repeat <= {int(max_repeat)}")
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fine)
