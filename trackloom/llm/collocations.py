"""Phrase collocations: Apriori levels over streams of word numbers, tries advanced in lockstep.

Words are counted by language; frequent ones get numbers, and texts become streams of numbers in
which everything that no frequent phrase can hold (rare words, ends of pieces and of texts) is a gap.
At each level the frequent phrases of k-1 words form double-array tries, small enough to be broadcast.
All positions of a block start at the root and advance together, one word a step; where a state
accepts, the position holds that phrase. Two neighbouring positions that both hold one are an
occurrence of an Apriori-safe candidate of k words, known by its pair of states; pairs are counted in
blocks, and the shards' counts are summed. A phrase carries the counts of its first and of its last
1, 2, ... words, so that cuts are scored from its own row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.llm.words import _LOWER, BLOCK_BYTES, blocks, mix, words_of
from trackloom.plans.durable import counted, durable

#: Phrases (or words) of one trie (or dictionary): what is broadcast at a time is below 40 MB.
SHARD = 1 << 19
#: Numbers in a row of the stream, and pairs that a task gathers before it hands their counts on.
STREAM, PAIRS = 1 << 20, 1 << 21
#: Rows of one task in the first round of ranking.
RANKED = 1_000_000

_BLANK, _BORDER = (np.zeros(256, dtype=bool) for _ in range(2))
_BORDER[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANK[[0x20, 0x09]] = True
_GAP = _BLANK | _BORDER


def _scanned(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: its text, its hash, whether it follows the word before in the same piece, and its bytes
    in the lower-cased ``data``."""
    words = words_of(data, offsets, True, _GAP)
    borders = np.concatenate([[0], np.cumsum(_BORDER[data], dtype=np.int64)])
    follows = np.zeros(len(words.doc), dtype=bool)
    if len(words.doc):
        follows[1:] = (words.doc[1:] == words.doc[:-1]) & (borders[words.start[1:]] == borders[words.end[:-1]])
    return words.doc, words.hashes(), follows, words.start, words.end


def _runs(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Cuts a text longer than a block between words, so that its arrays are bounded; yields bytes, offsets
    and whether the last piece of the run before goes on."""
    if len(offsets) > 2 or len(data) <= 2 * BLOCK_BYTES:
        yield data, offsets, False
        return
    at, goes_on = 0, False
    while at < len(data):
        end = min(len(data), at + BLOCK_BYTES)
        while end < len(data) and not _GAP[data[at:end]].any():  # one word longer than a block
            end = min(len(data), end + BLOCK_BYTES)
        if end < len(data):
            end = at + int(np.flatnonzero(_GAP[data[at:end]])[-1]) + 1
        yield data[at:end], np.array([0, end - at]), goes_on
        held = np.flatnonzero(_BORDER[data[at:end]])
        inside = np.flatnonzero(~_GAP[data[at:end]])
        if len(inside):
            goes_on = not len(held) or held[-1] < inside[-1]
        elif len(held):
            goes_on = False
        at = end


def _symbols(hashes: np.ndarray, langs: np.ndarray, seed: int) -> np.ndarray:
    """A word's hash in its language."""
    return mix(hashes + langs + np.uint64(seed)).view(np.int64)


def _lang_hashes(names: list[str]) -> np.ndarray:
    """A 64-bit number for each language, the same in every process."""
    return np.array([int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest()) for name in names], dtype=np.uint64)


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[str], int, int, np.ndarray, np.ndarray]]:
    """Blocks of a batch: languages of its texts as codes, their names, first row, end row, bytes, offsets."""
    coded = batch.column("lang").dictionary_encode()
    names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    for first, end, data, offsets in blocks(batch.column("text")):
        yield codes[first:end], names, first, end, data, offsets


def _sliced(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Strings of parts of ``data``."""
    length = end - start
    offsets = np.concatenate([[0], np.cumsum(length)])
    taken = data[np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(taken.tobytes())])


def _word_counts(seed: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, names, _, _, data, offsets in _batches(batch):
                salt = _lang_hashes(names)
                for raw, bounds, _ in _runs(data, offsets):
                    doc, hashes, _, start, end = _scanned(raw, bounds)
                    symbols, first, n = np.unique(_symbols(hashes, salt[codes[doc]], seed), return_index=True, return_counts=True)
                    yield pa.RecordBatch.from_pydict({
                        "lang": pa.DictionaryArray.from_arrays(pa.array(codes[doc[first]]), pa.array(names, pa.string())).cast(pa.string()), "symbol": symbols,
                        "word": _sliced(_LOWER[raw], start[first], end[first]).cast(pa.string()), "n": n.astype(np.int64)})

    return work


def _encoded(shards: list[Broadcast], seed: int):
    """Streams of the numbers of frequent words, -1 between what no phrase can span."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for codes, names, _, _, data, offsets in _batches(batch):
                salt = _lang_hashes(names)
                for raw, bounds, goes_on in _runs(data, offsets):
                    doc, hashes, follows, _, _ = _scanned(raw, bounds)
                    if not len(doc):
                        continue
                    symbols, back = np.unique(_symbols(hashes, salt[codes[doc]], seed), return_inverse=True)
                    number = np.full(len(symbols), -1, dtype=np.int32)
                    for shard in shards:
                        known, numbers = shard.value
                        at = np.minimum(np.searchsorted(known, symbols), len(known) - 1)
                        number = np.where(known[at] == symbols, numbers[at], number)
                        if len(shards) > 1:
                            del shard._value  # it is read from its file again
                    if size >= STREAM and not goes_on:
                        yield from _rows(held)
                        held, size = [], 0
                    follows[0] = goes_on
                    stream = np.full(2 * len(doc), -2, dtype=np.int32)  # -2: nothing here
                    stream[::2][~follows] = -1
                    stream[1::2] = number[back]
                    stream = stream[stream != -2]
                    gap = stream < 0
                    stream = stream[~(gap & np.concatenate([[False], gap[:-1]]))]  # one gap does for several
                    held.append(stream)
                    size += len(stream)
        if held:
            yield from _rows(held)

    return work


def _rows(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_pydict({"stream": pa.array([np.concatenate(held).astype("<i4").tobytes()], pa.binary())})


class Trie:
    """A double-array trie of equally long sequences of word numbers: from state ``s`` byte ``c`` leads to
    ``base[s] + c`` if ``check`` has ``s`` there. State 0 is the root. A word is a fixed number of bytes, as
    children that lie no more than 256 places apart fit close together."""

    def __init__(self, phrases: np.ndarray, numbers: np.ndarray):
        order = np.lexsort(phrases.T[::-1])
        phrases, numbers = phrases[order].astype(np.int64), numbers[order]
        self.bytes = max(1, (int(phrases.max(initial=0)).bit_length() + 7) // 8)
        self.base, self.check = np.zeros(1, dtype=np.int32), np.full(1, -2, dtype=np.int32)
        self.free, self.top, self.tried = 1, 1, 1  # no free place before, none taken from here on, tries begin here
        state = np.zeros(len(phrases), dtype=np.int64)
        new = np.zeros(len(phrases), dtype=bool)
        new[:1] = True
        for word in phrases.T:
            for byte in self._bytes(word):
                new[1:] |= byte[1:] != byte[:-1]
                child = np.flatnonzero(new)  # the first phrase of each new state
                state = self._placed(state[child], byte[child])[np.cumsum(new) - 1]
        self.base, self.check = self.base[: self.top], self.check[: self.top]
        self.number = np.full(self.top, -1, dtype=np.int64)
        self.number[state] = numbers

    def _bytes(self, word: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(self.bytes - 1, -1, -1):
            yield (word >> (8 * k)) & 255

    def _room(self, n: int) -> None:
        if n > len(self.check):
            more = max(n - len(self.check), len(self.check))
            self.base = np.concatenate([self.base, np.zeros(more, dtype=np.int32)])
            self.check = np.concatenate([self.check, np.full(more, -1, dtype=np.int32)])

    def _placed(self, parent: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """States for children of ``parent`` (grouped) by ``byte``."""
        first = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]])) if len(parent) else np.zeros(0, dtype=np.int64)
        count = np.diff(np.concatenate([first, [len(parent)]]))
        out = np.zeros(len(parent), dtype=np.int64)
        for k in np.flatnonzero(count > 1)[np.argsort(-count[count > 1], kind="stable")].tolist():
            own = slice(first[k], first[k] + count[k])
            base = self._fitting(byte[own])
            out[own] = base + byte[own]
            self.base[parent[first[k]]] = base
            self.check[out[own]] = parent[first[k]]
            self.top = max(self.top, int(out[own.stop - 1]) + 1)
        single = first[count == 1]  # an only child may take any free place
        self._room(self.top + len(single))
        places = (np.flatnonzero(self.check[self.free : self.top + len(single)] == -1) + self.free)[: len(single)]
        out[single] = places
        self.base[parent[single]] = places - byte[single]
        self.check[places] = parent[single]
        self.top = max(self.top, int(places.max(initial=0)) + 1)
        holes = np.flatnonzero(self.check[self.free : self.top] == -1)
        self.free = int(holes[0]) + self.free if len(holes) else self.top
        self.tried = max(self.tried, self.free)
        return out

    def _fitting(self, bytes_: np.ndarray) -> int:
        """The first of some tried bases at which all bytes find free places, else one behind all places that
        are taken."""
        low = int(bytes_[0])
        bases = self.tried - low + np.arange(128)
        self._room(max(int(bases[-1]), self.top) + 257)
        free = (self.check[bases[:, None] + bytes_] == -1).all(axis=1)
        if free.any():
            return int(bases[np.argmax(free)])
        self.tried = min(self.tried + 32, self.top)
        return self.top - low

    def numbers(self, stream: np.ndarray, words: int) -> np.ndarray:
        """The number of the phrase of ``words`` words that begins at each position, or -1."""
        out = np.full(len(stream), -1, dtype=np.int64)
        at = np.flatnonzero(stream[: max(0, len(stream) - words + 1)] >= 0)
        state = np.zeros(len(at), dtype=np.int64)
        for step in range(words):
            word = stream[at + step]
            keep = (word >= 0) & (word >> (8 * self.bytes) == 0)
            at, state, word = at[keep], state[keep], word[keep]
            for k in range(self.bytes - 1, -1, -1):
                after = self.base[state] + ((word >> (8 * k)) & 255)
                keep = (after >= 0) & (after < len(self.check))
                keep[keep] = self.check[after[keep]] == state[keep]
                at, state, word = at[keep], after[keep].astype(np.int64), word[keep]
        out[at] = self.number[state]
        return out


def _pair_counts(shards: list[Broadcast], words: int):
    """Counts of neighbouring positions that both hold a phrase of ``words`` words; for one word, the
    numbers in the stream are the phrases."""

    def summed(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        pairs, n = np.unique(np.concatenate(held), return_counts=True)
        return pairs, n

    def batch(pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"a": pairs >> 32, "b": pairs & 0xFFFFFFFF, "n": n.astype(np.int64)})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for rows in batches:
            for raw in rows.column("stream"):
                stream = np.frombuffer(raw.as_buffer(), dtype="<i4")
                if words == 1:
                    number = stream.astype(np.int64)
                else:
                    number = np.full(len(stream), -1, dtype=np.int64)
                    for shard in shards:
                        number = np.maximum(number, shard.value.numbers(stream, words))
                        if len(shards) > 1:
                            del shard._value
                at = np.flatnonzero((number[:-1] >= 0) & (number[1:] >= 0))
                held.append(number[at] << 32 | number[at + 1])
                size += len(at)
                if size >= PAIRS:
                    yield batch(*summed(held))
                    held, size = [], 0
        if held:
            yield batch(*summed(held))

    return work


def _numbered(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` written, with ``number`` from 0 without gaps, and its number of rows."""
    rows, total = counted(df)
    rows = rows.withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33)
    sizes = {r.p: r.n for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row for each partition
    starts, at = [], 0
    for p in range(max(sizes, default=-1) + 1):
        starts.append(at)
        at += sizes.get(p, 0)
    start = F.element_at(F.array(*[F.lit(x).cast("long") for x in starts]), (part + 1).cast("int")) if starts else F.lit(0)
    return durable(rows.withColumn("number", start + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at")), total


def _shards(phrases: DataFrame, total: int, built) -> list[Broadcast]:
    """Broadcasts of ``built(rows)`` for parts of at most some ``SHARD`` rows; one is on the driver at a time."""
    n, out = 1 + total // SHARD, []
    for k in range(n):
        part = phrases.where(F.pmod(F.xxhash64("number"), F.lit(n)) == k).toArrow()
        if part.num_rows:
            out.append(phrases.sparkSession.sparkContext.broadcast(built(part)))
    return out


def _dictionary(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    symbols, numbers = rows.column("symbol").to_numpy(), rows.column("number").to_numpy()
    order = np.argsort(symbols)
    return symbols[order], numbers[order].astype(np.int32)


def _trie(rows: pa.Table) -> Trie:
    flat = rows.column("words").combine_chunks()
    return Trie(flat.flatten().to_numpy().reshape(rows.num_rows, -1), rows.column("number").to_numpy())


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5) -> tuple[DataFrame, list[DataFrame]]:
    """``totals(lang, total)`` of word occurrences, and a table for each length from 1 word to ``longest`` of the
    phrases that occur at least ``least`` times in a language: ``number, lang, phrase, last, words, n, heads,
    tails``, where ``heads[k]`` counts the first k + 1 words and ``tails[k]`` the last."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    seed = 0
    while True:
        each = rows.mapInArrow(_word_counts(seed), "lang string, symbol long, word string, n long")
        every = durable(each.groupBy("lang", "symbol", "word").agg(F.sum("n").alias("n")))
        found, n_words = _numbered(every.where(F.col("n") >= least))
        twins = found.select("symbol", F.col("lang").alias("__lang"), F.col("word").alias("__word"))
        if every.join(twins, "symbol").where("lang <> __lang or word <> __word").isEmpty():
            break
        seed += 1  # a frequent word shares its 64 bits with another: hash anew
    totals = every.groupBy("lang").agg(F.sum("n").alias("total"))
    levels = [found.select("number", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array(F.col("number").cast("int")).alias("words"), "n", F.array("n").alias("heads"), F.array("n").alias("tails"))]
    shards = _shards(found.select("symbol", "number"), n_words, _dictionary)
    streams = durable(rows.mapInArrow(_encoded(shards, seed), "stream binary"))
    for shard in shards:
        shard.unpersist()
    size = n_words
    for words in range(1, longest):
        shards = _shards(levels[-1].select("words", "number"), size, _trie) if words > 1 else []
        pairs = streams.mapInArrow(_pair_counts(shards, words), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        left, right = levels[-1].select(F.col("number").alias("a"), "lang", "phrase", "words", "heads"), levels[-1].select(F.col("number").alias("b"), "last", "tails", F.element_at("words", -1).alias("word"))
        longer = pairs.join(left, "a").join(right, "b").select(
            "a", "b", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", F.concat("words", F.array("word")).alias("words"), "n",
            F.concat("heads", F.array("n")).alias("heads"), F.concat("tails", F.array("n")).alias("tails"))
        level, size = _numbered(longer)
        levels.append(level)
        for shard in shards:
            shard.unpersist()
        if not size:
            break
    return totals, levels


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """The best phrases of each language of ``docs(text, lang, ...)``.

    Texts are lower-cased (A-Z) and split at ``[.,;:!?\\x0A-\\x0D]`` into pieces, those into words
    ``[^\\x20\\x09]+``; phrases lie within pieces. Candidates are phrases of 2 to ``longest`` words with
    ``a >= least`` occurrences, overlaps included, in a language. Cut after its first k words into parts with
    ``l`` and ``r`` occurrences, a candidate scores ``floor(1000 * a * n / (l * r))`` for ``n`` words in all;
    the least score counts, of equal ones the smallest k. Candidates inside a longer one that occurs as often
    are dropped. Returns ``lang, rank, phrase, a, l, r, n, score``: the first ``top`` of each language by
    score, then a (both descending), then phrase in byte order.

    A null language is ``und``; null and empty texts have no words. Repeated rows count each time. Without
    candidates the result is empty. Long texts are worked on in runs; a task holds four bytes for each word
    of a piece. Other columns are not read. A count and a total fit a long; products are decimals
    of 38 digits, and an error beyond.
    """
    totals, levels = frequent_phrases(docs, least, longest)
    few = totals.count() <= 1000
    kept = []
    for k in range(1, len(levels)):
        own = levels[k]
        if k + 1 < len(levels):  # as often inside a longer one: n is that of one of its two parts
            ends = levels[k + 1].select(F.col("a").alias("number"), F.col("n").alias("outer")).union(levels[k + 1].select("b", "n")).groupBy("number").agg(F.max("outer").alias("outer"))
            own = own.join(ends, "number", "left").where("outer is null or outer < n")
        kept.append(own.select("lang", "phrase", F.col("n").alias("a"), "heads", "tails", F.size("words").alias("k")))
    if not kept:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    every = kept[0]
    for own in kept[1:]:
        every = every.union(own)
    every = every.join(F.broadcast(totals) if few else totals, "lang")
    cut = F.expr("""array_min(transform(sequence(1, k - 1), j -> struct(
        (cast(1000 as decimal(4, 0)) * cast(a as decimal(19, 0)) * cast(total as decimal(19, 0))) div (cast(heads[j - 1] as decimal(19, 0)) * cast(tails[k - j - 1] as decimal(19, 0))) as score,
        j as j, heads[j - 1] as l, tails[k - j - 1] as r)))""")
    scored, n = counted(every.withColumn("cut", cut).select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("total").alias("n"), F.col("cut.score").cast("long").alias("score")))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(1 + n // RANKED)))
    first = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
