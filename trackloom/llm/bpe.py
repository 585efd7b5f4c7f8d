"""Byte-level BPE: encoding by longest matches with backtracking, and decoding.

A text is split by the vocabulary's pattern; each match is encoded separately. Its bytes, mapped
to Latin-1 characters, are searched once by an Aho-Corasick automaton of all tokens, which gives the
longest token at every position. Encoding starts from longest matches and backs off to the next
shorter token where the pair with the token before could not have come out of the merges. That
question depends on the two tokens alone, so its answers are memoised. The result is that of
applying the merges by rank, in linear time.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens whose ids, and pairs of tokens whose compatibility a task remembers: so many since the last
#: time that the table was full, and as many from before, if they were asked for again (some 60 MB in
#: all). A task forgets them at its end, as workers live on into other stages.
REMEMBERED, PAIRS = 120_000, 100_000
#: Bytes of token ids in a batch that is handed back.
BATCH_BYTES = 2 << 20

# Letters, numbers and white space below U+0100, for texts without other characters: the standard
# library's matcher is faster, but has no classes for letters and numbers.
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = "\\t-\\r \x85\xa0"
#: White space by Unicode's property, which excludes the control characters U+001C to U+001F.
_WIDE_S = "\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def splitter(pattern: str):
    """A function that splits a text by ``pattern`` whose classes are ``\\p{L}``,
    ``\\p{N}``, ``\\s``, ``\\S`` and ``[^\\s\\p{L}\\p{N}]``."""

    def written(letters: str, numbers: str, space: str) -> str:
        classes = {r"\p{L}": letters, r"\p{N}": numbers, r"\s": space}
        others = {r"[^\s\p{L}\p{N}]": f"[^{space}{letters}{numbers}]", r"\S": f"[^{space}]"}
        others |= {k: f"[{v}]" for k, v in classes.items()}
        return re.sub("|".join(map(re.escape, others)), lambda m: others[m[0]], pattern)

    narrow = re.compile(written(_L, _N, _S)).findall
    wide = regex.compile(written("\\p{L}", "\\p{N}", _WIDE_S)).findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return wide(text)
        return narrow(text)

    return split


def read_ranks(path: str) -> bytes:
    """The content of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return f.read()


class Merges:
    """Tables of one vocabulary, and the ids of byte strings under it."""

    def __init__(self, content: bytes):
        self.rank = {base64.b64decode(token): int(n) for token, n in (line.split() for line in content.splitlines() if line)}
        self.token = {n: token for token, n in self.rank.items()}
        self.automaton = ahocorasick.Automaton()
        self.shorter: dict[int, int] = {}
        for token, n in self.rank.items():
            self.automaton.add_word(token.decode("latin-1"), (n, len(token)))
            self.shorter[n] = next((self.rank[token[:i]] for i in range(len(token) - 1, 0, -1) if token[:i] in self.rank), -1)
        self.automaton.make_automaton()
        self.halves: dict[int, tuple[int, int]] = {}
        self.pair: dict[tuple[int, int], int] = {}
        for n in sorted(self.token):
            token = self.token[n]
            self.halves[n] = (n, n)
            for i in range(1, len(token)):
                left, right = self.rank.get(token[:i], n), self.rank.get(token[i:], n)
                if left < n and right < n and self._survive(left, right):
                    self.halves[n] = (left, right)
                    self.pair[left, right] = n
                    break
        self._known: dict[int, bool] = {}
        self._older: dict[int, bool] = {}

    def forget(self) -> None:
        self._known, self._older = {}, {}

    def _survive(self, a: int, b: int) -> bool:
        """Whether merging by rank leaves the border between tokens ``a`` and ``b`` alone.

        Takes the merges at the border back, latest first. A merge across the border counts if it
        comes before the one taken back last; of equal merges the left one comes first.
        """
        limit = 1 << 62
        while True:
            if self.pair.get((a, b), limit) < limit:
                return False
            right_of_a, left_of_b = self.halves[a][1], self.halves[b][0]
            if (a > b or left_of_b == b) and right_of_a != a:
                a, limit = right_of_a, a
            elif left_of_b != b:
                b, limit = left_of_b, b + 1
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self._known.get(key)
        if known is None:
            if len(self._known) >= PAIRS:
                self._known, self._older = {}, self._known
            known = self._older.get(key)
            self._known[key] = known = self._survive(a, b) if known is None else known
        return known

    def ids(self, piece: bytes) -> list[int]:
        """Token ids of ``piece``, as merging by rank gives them."""
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [-1] * n
        for end, (token, length) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - length + 1] = token  # ends ascend, so the last is the longest
        length_of, shorter, compatible = self.token, self.shorter, self.compatible
        open_at = bytearray(b"\x01" * (n + 1))
        out: list[int] = []
        at, token = 0, longest[0] if n else -1
        while token >= 0:
            last = out[-1] if out else -1
            end = at + len(length_of[token])
            if open_at[end] and (last < 0 or compatible(last, token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            elif shorter[token] >= 0:
                token = shorter[token]
            else:  # no token fits here after the last one: take that back
                open_at[at] = 0
                token = out.pop()
                at -= len(length_of[token])
        return out


class _Remembered(dict):
    """Pre-token -> its ids as packed 32-bit integers. What is asked for again outlives one change of
    tables, so frequent pre-tokens stay."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges, self.older = merges, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            packed = np.array(self.merges.ids(piece.encode()), dtype=np.int32).tobytes()
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed

    def forget(self) -> None:
        self.clear()
        self.older = {}
        self.merges.forget()


@lru_cache(maxsize=2)
def _vocabulary(content: bytes, pattern: str):
    merges = Merges(content)
    return splitter(pattern), _Remembered(merges), [merges.token.get(i, b"") for i in range(max(merges.token) + 1)]


def _encode(content: bytes, pattern: str, decode: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, packed, token = _vocabulary(content, pattern)
        try:
            for batch in batches:
                rows, texts = 0, batch.column("text")
                while rows < len(texts):
                    ids, back, size, first = [], [], 0, rows
                    while rows < len(texts) and size < BATCH_BYTES:
                        ids.append(b"".join(map(packed.__getitem__, split(texts[rows].as_py() or ""))))
                        if decode:
                            back.append(b"".join(map(token.__getitem__, np.frombuffer(ids[-1], dtype=np.int32).tolist())))
                        size += len(ids[-1])
                        rows += 1
                    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))
                    columns = {"doc_id": batch.column("doc_id").slice(first, rows - first), "ids": lists}
                    if decode:
                        columns["decoded"] = pa.array(back, pa.binary())
                    yield pa.RecordBatch.from_pydict(columns)
        finally:
            packed.forget()

    return work


def encode(docs: DataFrame, ranks: str, pattern: str, decoded: bool = False) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, ids)``, one row for each input row.

    ``ranks``: path of a rank file, read on the driver and sent along (a vocabulary's size, not the
    data's). Null texts count as empty and have no ids. Null and repeated doc_ids are passed
    through. Other columns are not read. With ``decoded``, the ids are also decoded again, into
    the binary column ``decoded``.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_encode(read_ranks(ranks), pattern, decoded), "doc_id long, ids array<int>" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """``(doc_id, ids)`` -> ``(doc_id, decoded)`` with the bytes the ids stand for; null for null."""
    content = read_ranks(ranks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _vocabulary(content, r"\s")[2]
        for batch in batches:
            back = [None if x is None else b"".join(map(token.__getitem__, x)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "decoded": pa.array(back, pa.binary())})

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, decoded binary")
