"""Token counts under a unigram vocabulary, with the work shared along a trie of pre-tokens.

The best segmentation of a pre-token maximises the sum of its pieces' log-probabilities. Its
forward scores at a position depend only on the characters before it, so pre-tokens that begin alike
share them. The distinct pre-tokens of a batch form a trie, which is walked in depth-first (sorted)
order with the scores of the current path on a stack: each shared prefix is scored once, and a
pre-token's count is stored at its terminal node. Counts are remembered between batches.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.bpe import read_ranks, splitter

#: Pre-tokens whose counts a task remembers; beyond that it forgets all and goes on. Longer ones are counted
#: each time, and a task forgets them at its end, as workers live on into other stages.
REMEMBERED, LONGEST = 400_000, 64


def zipf_scores(content: bytes) -> dict[str, float]:
    """Pieces (bytes as Latin-1) of a rank file with log-probabilities by Zipf's law of the rank:
    the public rank files hold no probabilities, and tokenizers are not trained here."""
    ranked = [(base64.b64decode(token), int(n)) for token, n in (line.split() for line in content.splitlines() if line)]
    total = math.log(sum(1 / (n + 1) for _, n in ranked))
    return {token.decode("latin-1"): -math.log(n + 1) - total for token, n in ranked}


class Pieces:
    """A trie of the vocabulary: node -> {character: node}; the score of the piece ending there."""

    def __init__(self, scores: dict[str, float]):
        self.child: list[dict[str, int]] = [{}]
        self.score: list[float | None] = [None]
        for piece, score in scores.items():
            node = 0
            for c in piece:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.score.append(None)
                node = self.child[node][c]
            self.score[node] = score

    def count(self, words: list[str]) -> list[int]:
        """Pieces in the best segmentation of each of ``words``, which are sorted and distinct.

        Every single byte is a piece, so there is one. Of equal scores, fewer pieces win.
        """
        child, score = self.child, self.score
        best, pieces, alive = [0.0], [0], [[]]  # by depth of the path in the words' trie
        before, out = "", []
        for word in words:
            shared = len(commonprefix((before, word)))
            del best[shared + 1 :], pieces[shared + 1 :], alive[shared + 1 :]
            for i in range(shared, len(word)):
                c, top, fewest, on = word[i], -math.inf, 0, []
                for start, node in (*alive[i], (i, 0)):
                    nxt = child[node].get(c)
                    if nxt is None:
                        continue
                    on.append((start, nxt))
                    own = score[nxt]
                    if own is not None:
                        total, n = best[start] + own, pieces[start] + 1
                        if total > top or total == top and n < fewest:
                            top, fewest = total, n
                best.append(top)
                pieces.append(fewest)
                alive.append(on)
            out.append(pieces[len(word)])
            before = word
        return out


@lru_cache(maxsize=2)
def _prepared(content: bytes, pattern: str):
    return splitter(pattern), Pieces(zipf_scores(content)), {}


def token_counts(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_pretokens, n_tokens)``, one row for each input row.

    Texts are split by ``pattern``; each match is segmented separately, by its UTF-8 bytes. Null
    texts count as empty. Null and repeated doc_ids are passed through; other columns are not read. A text
    is held whole by its task, with its matches. Without rows the result is empty.
    """
    content = read_ranks(ranks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, pieces, known = _prepared(content, pattern)
        try:
            for batch in batches:
                texts, at = batch.column("text"), 0
                while at < len(texts):
                    found, size, first = [], 0, at
                    while at < len(texts) and size < 4 << 20:
                        text = texts[at].as_py() or ""
                        found.append(split(text))
                        size += len(text)
                        at += 1
                    new = {x for words in found for x in words if x not in known}
                    local = known
                    if len(known) + len(new) > REMEMBERED:
                        known.clear()
                        new = {x for words in found for x in words}
                    order = sorted((x.encode().decode("latin-1"), x) for x in new)
                    local.update(zip((x for _, x in order), pieces.count([x for x, _ in order]), strict=True))
                    counts = [sum(map(local.__getitem__, words)) for words in found]
                    for x in new:
                        if len(x) > LONGEST:
                            del known[x]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": batch.column("doc_id").slice(first, at - first),
                        "n_pretokens": pa.array([len(x) for x in found], pa.int64()), "n_tokens": pa.array(counts, pa.int64())})
        finally:
            known.clear()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(work, "doc_id long, n_pretokens long, n_tokens long")
