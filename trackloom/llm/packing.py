"""Packing into sequences by dynamic programming over the order of the texts.

Each partition's texts are encoded one after another into a run of token ids. A cut may be made at
the end of a document for nothing, at the end of a sentence for a small penalty, and elsewhere for a
larger one where no boundary is near. A window costs its padding, the penalty of the cut that ends it
and one token for being a sequence; padding is what is missing to the full length, or nothing where
the length is a power of two. The cheapest cuts follow from left to right: the best start among the
last ``length`` tokens comes from a monotone queue of (cost so far + position), since padding falls
as evenly as the window grows; the few starts at the distance of a power of two are looked up besides.

A run is solved in stretches. The last windows of a stretch are taken back and go on with the next
one, so only the end of a partition can leave a window unfilled.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.words import BLOCK_BYTES, Words, blocks, words_of

#: Penalties in tokens: of a cut at the end of a sentence, of any other cut inside a document, of a sequence.
SENTENCE, INSIDE, SEQUENCE = 8, 64, 1
#: Where no boundary comes for so many tokens, a text may be cut at every so many of them.
NO_BOUNDARY, EVERY = 128, 32
#: Tokens of a stretch, and windows that are taken back at its end.
STRETCH, TAKEN_BACK = 1 << 20, 4
#: Parts of words whose ids a task remembers before it starts anew. It forgets them at its end, as workers
#: live on into other stages.
PARTS = 600_000
#: What may follow the last letter or digit of a word as a part of its own.
_TAIL = ".,;:!?*%$#&)\""
#: Marks that end a sentence, and what may close after them.
_ENDS, _CLOSERS = frozenset(".!?。！？"), "\"')]”’»"
#: Words of small letters that are the same in every normal form of one code point a letter, and the characters
#: that byte-level vocabularies write for the two UTF-8 bytes of those that have two: bytes below 0xA1 and
#: 0xAD, which no character shows, follow one another from U+0100.
_SIMPLE = re.compile("[a-zß-öø-ÿ]+").fullmatch
_WRITTEN = {c: "".join(chr(256 + b - 94 if b <= 0xA0 else 323 if b == 0xAD else b) for b in chr(c).encode()) for c in range(0xDF, 0x100)}

_IS_TAIL, _ALNUM = (np.zeros(256, dtype=bool) for _ in range(2))
_IS_TAIL[[*_TAIL.encode()]] = True
_ALNUM[[*b"0123456789", *range(65, 91), *range(97, 123)]] = True


def cuts(ends: np.ndarray, penalties: np.ndarray, length: int) -> np.ndarray:
    """The cheapest cuts of a run of tokens that starts at 0. ``ends`` ascend strictly, at most ``length``
    apart; the last one is the end of the run. Returns where windows end."""
    at = [0, *ends.tolist()]
    where = np.asarray(at)
    near: list[tuple[int, int]] = []  # (cut, start) at the distance of a power of two
    for k in range(length.bit_length()):
        start = np.searchsorted(where, where - (1 << k))
        found = np.flatnonzero((where[start] == where - (1 << k)) & (where >= 1 << k))
        near += zip(found.tolist(), start[found].tolist(), strict=True)
    near.sort()
    near.append((len(at), 0))
    turn = 0
    penalty = [0.0, *(np.asarray(penalties, dtype=np.float64) + SEQUENCE).tolist()]
    cost, came = [0.0] * len(at), [0] * len(at)
    queue, head = [0], 0  # starts whose cost + position ascends; later ones only where they are cheaper
    key = [0.0] * len(at)
    for j in range(1, len(at)):
        here = at[j]
        while at[queue[head]] < here - length:
            head += 1
        start = queue[head]
        best = key[start] + length - here
        while near[turn][0] == j:
            i = near[turn][1]
            if cost[i] < best:  # at equal cost the queue's start gives the longer window
                best, start = cost[i], i
            turn += 1
        cost[j], came[j] = best + penalty[j], start
        key[j] = cost[j] + here
        while len(queue) > head and key[queue[-1]] > key[j]:
            queue.pop()
        queue.append(j)
    out, j = [], len(at) - 1
    while j:
        out.append(at[j])
        j = came[j]
    return np.array(out[::-1], dtype=np.int64)


def boundaries(counts: np.ndarray, sentence: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a run of documents may be cut, by the tokens of its words and whether a sentence or a document
    ends with each: positions from the run's start and their penalties."""
    total = np.cumsum(counts)
    at = np.unique(total[sentence | document])
    at = at[at > 0]
    whole = np.zeros(len(at), dtype=bool)
    whole[np.searchsorted(at, total[document])] = True
    before = np.concatenate([[0], at[:-1]])
    wide = np.flatnonzero(at - before > NO_BOUNDARY)
    extra = np.concatenate([np.zeros(0, dtype=np.int64), *(np.arange(before[k] + EVERY, at[k], EVERY) for k in wide)])
    ends = np.concatenate([at, extra])
    penalty = np.concatenate([np.where(whole, 0, SENTENCE), np.full(len(extra), INSIDE)])
    order = np.argsort(ends, kind="stable")
    return ends[order], penalty[order]


def _grown(x: np.ndarray, n: int) -> np.ndarray:
    """``x`` with room for ``n`` numbers."""
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n - len(x), len(x)), dtype=x.dtype)])


def segments(data: np.ndarray, offsets: np.ndarray, splits: bool) -> tuple[Words, np.ndarray, np.ndarray]:
    """The parts of all words as ``Words``, whether a line ends before the next one, and of each text where
    its parts end. With ``splits``, marks after the last letter or digit of a word are a part of their own,
    if that is in ASCII or a small letter of two bytes that begin with 0xC3."""
    words = words_of(data, offsets)
    start, end, n = words.start, words.end, len(words.start)
    lines = np.concatenate([[0], np.cumsum(data == 10, dtype=np.int32)])
    broken = np.zeros(n, dtype=bool)
    broken[:-1] = lines[start[1:]] > lines[end[:-1]]
    stops = np.searchsorted(words.doc, np.arange(len(offsets) - 1), side="right")
    if not splits or not n:
        return words, broken, stops
    last = np.maximum.accumulate(np.where(_IS_TAIL[data], -1, np.arange(len(data))))[end - 1]  # the last byte that is no mark
    letter = data[np.maximum(last, 0)]
    known = _ALNUM[letter] | (data[np.maximum(last - 1, 0)] == 0xC3) & (last > start) & (letter >= 0x9F) & (letter != 0xB7)
    split = (last >= start) & (last < end - 1) & known
    at = np.arange(n) + np.cumsum(split) - split  # where each word's first part goes
    firsts, lasts, breaks, doc = (np.zeros(n + int(split.sum()), dtype=x.dtype) for x in (start, end, broken, words.doc))
    firsts[at], lasts[at], doc[at] = start, np.where(split, last + 1, end), words.doc
    firsts[at[split] + 1], lasts[at[split] + 1], doc[at[split] + 1] = last[split] + 1, end[split], words.doc[split]
    breaks[at + split] = broken
    return Words(data, offsets, doc, firsts, lasts), breaks, np.searchsorted(doc, np.arange(len(offsets) - 1), side="right")


def _long(data: np.ndarray) -> Iterator[np.ndarray]:
    """A text in runs of about a block, cut after white space."""
    at = 0
    while at < len(data):
        end = min(len(data), at + BLOCK_BYTES)
        while end < len(data) and data[end - 1] != 32 and not 9 <= data[end - 1] <= 13:
            ahead = data[end : end + BLOCK_BYTES]
            gaps = np.flatnonzero((ahead == 32) | ((ahead >= 9) & (ahead <= 13)))
            end += int(gaps[0]) + 1 if len(gaps) else len(ahead)
        yield data[at:end]
        at = end


class _Ids:
    """Token ids of words by their parts, known by 64-bit hashes. The tokenizer never joins what white space
    parts, so a text's ids are those of its words in turn. A word is a stem and the marks after it, if a
    trial shows that the tokenizer lower-cases A-Z and splits there; else it is one part."""

    def __init__(self, content: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_str(content), end_id
        special = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special]
        self.between = special[0] if special else None  # parts words that are encoded in one go
        plain = lambda w: self.tokenizer.encode(w, add_special_tokens=False).ids
        lower, split = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        capitals = "".join(map(chr, range(65, 91)))
        self.splits = lower is not None and split is not None and lower.normalize_str(capitals) == capitals.lower() and all(
            len(split.pre_tokenize_str(x + c)) == 2 and plain(x + c) == plain(x) + plain(c) for x in "az09éß" for c in _TAIL) and not any(
            c in t.content for t in self.tokenizer.get_added_tokens_decoder().values() for c in _TAIL)
        self.bare, self.closes = self._bare(content) if self.splits else (None, None)
        self.forget()

    def _bare(self, content: str):
        """The model alone for words of small Latin letters, which need no normalising and are never split; and
        which of its tokens end a word. Nothing where its tokens don't show that, or a trial fails."""
        from tokenizers import Tokenizer

        settings = json.loads(content)
        suffix = settings["model"].get("end_of_word_suffix")
        if not suffix:
            return None, None
        bare = Tokenizer.from_str(json.dumps(settings | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "CharDelimiterSplit", "delimiter": " "}}))
        closes = np.zeros(1 + max(bare.get_vocab().values()), dtype=bool)
        closes[[i for token, i in bare.get_vocab().items() if token.endswith(suffix)]] = True
        letters = [*filter(_SIMPLE, map(chr, range(256)))]
        for trial in [[x + y for x in letters for y in letters], ["".join(letters[k:] + letters[:k]) * 3 for k in range(len(letters))]]:
            ids = np.array(bare.encode_batch_fast([" ".join(trial).translate(_WRITTEN)], add_special_tokens=False)[0].ids)
            if [x.tolist() for x in np.split(ids, np.flatnonzero(closes[ids])[:-1] + 1)] != [x.ids for x in self.tokenizer.encode_batch_fast(trial, add_special_tokens=False)]:
                return None, None
        return bare, closes

    def forget(self) -> None:
        """Part 0 is the end of a document."""
        self.known, self.row = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.pool, self.used, self.size = np.full(1, self.end_id, dtype="<u4"), 1, 1
        self.first, self.count, self.final = np.array([0]), np.array([1]), np.array([False])

    def _coded_bare(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.bare.encode_batch_fast([" ".join(words).translate(_WRITTEN)], add_special_tokens=False)[0].ids if words else [], dtype="<u4")
        return ids, np.diff(np.concatenate([[0], np.flatnonzero(self.closes[ids]) + 1])) if words else np.zeros(0, dtype=np.int64)

    def _coded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``words`` and how many each has."""
        if not words:
            return np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
        if self.between is None or any(self.between[0] in w for w in words):
            each = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            return np.array([i for x in each for i in x], dtype="<u4"), np.array([len(x) for x in each])
        ids = np.array(self.tokenizer.encode_batch_fast([self.between[0].join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        borders = ids == self.between[1]
        return ids[~borders], np.diff(np.flatnonzero(np.concatenate([[True], borders, [True]]))) - 1

    def _learn(self, parts: list[str]) -> np.ndarray:
        """Places for new parts."""
        plain = [w.lower() if self.splits and w.isascii() else w for w in parts]
        simple, others = [], []
        for k, w in enumerate(plain):
            (simple if self.bare is not None and _SIMPLE(w) else others).append(k)
        simple.sort(key=plain.__getitem__), others.sort(key=plain.__getitem__)  # like words after one another are faster
        order = simple + others
        ids, count = (np.concatenate(x) for x in zip(self._coded_bare([plain[k] for k in simple]), self._coded([plain[k] for k in others]), strict=True))
        at, n = self.size, len(parts)
        self.first, self.count, self.final = (_grown(x, at + n) for x in (self.first, self.count, self.final))
        self.first[at : at + n], self.count[at : at + n] = self.used + np.cumsum(count) - count, count
        self.final[at : at + n] = [parts[k].rstrip(_CLOSERS)[-1:] in _ENDS for k in order]
        self.pool = _grown(self.pool, self.used + len(ids))
        self.pool[self.used : self.used + len(ids)] = ids
        self.used, self.size = self.used + len(ids), at + n
        places = np.empty(n, dtype=np.int64)
        places[order] = np.arange(at, at + n)
        return places

    def rows(self, parts: Words) -> np.ndarray:
        """The place of each part in ``first``, ``count`` and ``final``."""
        hashes, first, back = np.unique(parts.hashes(), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, hashes), max(0, len(self.known) - 1))
        held = self.known[at] == hashes if len(self.known) else np.zeros(len(hashes), dtype=bool)
        row = np.zeros(len(hashes), dtype=np.int64)
        row[held] = self.row[at[held]] if len(self.known) else 0
        new = np.flatnonzero(~held)
        if len(new):
            raw = parts.data.tobytes()
            row[new] = self._learn([raw[a:b].decode() for a, b in zip(parts.start[first[new]].tolist(), parts.end[first[new]].tolist(), strict=True)])
            known = np.concatenate([self.known, hashes[new]])
            order = np.argsort(known, kind="stable")  # two sorted runs
            self.known, self.row = known[order], np.concatenate([self.row, row[new]])[order]
        return row[back]

    def text_rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts of texts in turn, each text with part 0 at its end, and after which of them a sentence or a
        line ends."""
        if self.size > PARTS:
            self.forget()
        if len(offsets) > 2 or len(data) <= 2 * BLOCK_BYTES:
            parts, broken, stops = segments(data, offsets, self.splits)
            rows = self.rows(parts)
            final = self.final[rows] | broken
        else:
            rows, final = [], []
            for run in _long(data):
                parts, broken, _ = segments(run, np.array([0, len(run)]), self.splits)
                rows.append(self.rows(parts))
                final.append(self.final[rows[-1]] | broken)
            rows, final = np.concatenate(rows), np.concatenate(final)
            stops = np.array([len(rows)])
        return np.insert(rows, stops, 0), np.insert(final, stops, True)

    def ids(self, rows: np.ndarray) -> np.ndarray:
        count = self.count[rows]
        return self.pool[np.repeat(self.first[rows] - (np.cumsum(count) - count), count) + np.arange(count.sum())]


@lru_cache(maxsize=1)
def _ids(content: str, end_id: int) -> _Ids:
    return _Ids(content, end_id)


class _Run:
    """The open end of a partition's run of tokens: what has not been given to a sequence yet."""

    def __init__(self, length: int, partition: int):
        self.length, self.sequence, self.size = length, partition << 33, 0
        self.doc_ids: list[int | None] = []
        self.first = self.tokens = self.ends = self.penalties = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype="<u4")

    def add(self, doc_ids: list[int | None], words: _Ids, rows: np.ndarray, final: np.ndarray) -> None:
        """Documents by their parts; each ends with part 0."""
        count, document = words.count[rows], rows == 0
        ends, penalties = boundaries(count, final, document)
        stop = np.cumsum(count)[document]
        first = np.concatenate([[0], stop[:-1]])
        self.doc_ids += doc_ids
        self.first, self.tokens = np.concatenate([self.first, first + self.size]), np.concatenate([self.tokens, stop - first])
        self.ends, self.penalties = np.concatenate([self.ends, ends + self.size]), np.concatenate([self.penalties, penalties])
        self.ids = np.concatenate([self.ids, words.ids(rows)])
        self.size = len(self.ids)

    def give(self, last: bool) -> pa.RecordBatch | None:
        """Solves the run; gives the pieces of all its windows, or of all but the last few."""
        stops = cuts(self.ends, self.penalties, self.length) if self.size else np.zeros(0, dtype=np.int64)
        stops = stops if last else stops[: max(0, len(stops) - TAKEN_BACK)]
        if not len(stops):
            return None
        given, first = int(stops[-1]), self.first  # negative where a document has begun in an earlier stretch
        begins = np.concatenate([[0], stops[:-1]])
        start = np.union1d(begins, first[(first > 0) & (first < given)])  # a piece begins with a window or a document
        stop = np.concatenate([start[1:], [given]])
        doc, window = np.searchsorted(first, start, side="right") - 1, np.searchsorted(begins, start, side="right") - 1
        offsets = np.concatenate([start, [given]]).astype(np.int32) * 4
        pieces = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(self.ids[:given].tobytes())])
        batch = pa.RecordBatch.from_pydict({
            "doc_id": pa.array([self.doc_ids[k] for k in doc.tolist()], pa.int64()), "start": start - first[doc], "length": stop - start, "doc_tokens": self.tokens[doc],
            "sequence_id": self.sequence + window, "offset": start - begins[window], "ids": pieces})
        self.sequence += len(stops)
        kept, later = first + self.tokens > given, self.ends > given
        self.doc_ids = [self.doc_ids[k] for k in np.flatnonzero(kept).tolist()]
        self.first, self.tokens = first[kept] - given, self.tokens[kept]
        self.ends, self.penalties = self.ends[later] - given, self.penalties[later]
        self.ids = self.ids[given:]
        self.size = len(self.ids)
        return batch


def _pack(content: str, end_id: int, length: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, run = _ids(content, end_id), _Run(length, TaskContext.get().partitionId())
        try:
            for batch in batches:
                doc_ids = batch.column("doc_id").to_pylist()
                for first, end, data, offsets in blocks(batch.column("text")):
                    run.add(doc_ids[first:end], words, *words.text_rows(data, offsets))
                    if run.size >= STRETCH and (out := run.give(False)) is not None:
                        yield out
            if (out := run.give(True)) is not None:
                yield out
        finally:
            words.forget()

    return work


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = 2048) -> DataFrame:
    """Pieces of ``docs(doc_id, text, ...)`` in sequences of at most ``length`` tokens.

    A document's tokens are the ids of its text under the tokenizer file, without special tokens added,
    and ``end_id``. Returns for each piece ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``:
    ``length`` tokens from ``start`` of the document's lie from ``offset`` on in the sequence; ``ids`` are
    those as little-endian unsigned 32-bit numbers. Every token is in one piece; pieces fill a sequence
    from 0 without gaps, in the order in which documents are read.

    The file must be that of a tokenizer which never joins what white space parts (``\\x20``,
    ``\\x09-\\x0D``); it is read on the driver and sent along. Null and empty texts have the end id alone.
    Null and repeated doc_ids are passed through, each row being a document of its own. Documents longer
    than a sequence are cut; one is held whole by its task. Without rows the result is empty.
    Other columns are not read. A rerun over the same files gives the same sequences.
    """
    with open(tokenizer, encoding="utf-8") as f:
        content = f.read()
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_pack(content, end_id, length), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def sequences(pieces: DataFrame, pad_id: int, length: int = 2048) -> DataFrame:
    """``sequence_id, tokens, ids``: whole sequences of ``pack``'s pieces, padded with ``pad_id`` to ``length``
    unless their ``tokens`` are a power of two. A sequence has no more than ``length`` pieces."""
    joined = pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("found"))
    ids = F.aggregate("found", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x.ids))
    missing = F.when(F.bit_count("tokens") == 1, 0).otherwise(length - F.col("tokens")).cast("int")
    pad = F.unhex(F.repeat(F.lit(np.array([pad_id], dtype="<u4").tobytes().hex()), missing))
    return joined.select("sequence_id", "tokens", F.concat(ids, pad).alias("ids"))
