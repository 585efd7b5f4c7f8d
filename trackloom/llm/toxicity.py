"""Toxicity by a classifier chain of linear models over words and word beginnings.

Categories are predicted one after the other; each model sees the probabilities of those before.
While training, these are out-of-fold predictions, so a later model learns from probabilities as
uncertain as it will meet. Models are logistic regressions on the presence of words and of word
beginnings (which carry over to inflected forms), trained on the driver over a bounded sample of
labelled rows and features; scoring is one pass over the documents without any shuffle.

The labels have one category, ``toxic``. Three more are made from it and from the sample's *markers*,
whole words that are chosen as features and of whose rows at least ``MARKER`` are toxic: ``explicit``
(toxic with a marker), ``severe`` (toxic with three or more of them) and ``veiled`` (toxic without).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.words import blocks, words_of
from trackloom.plans.durable import counted, durable

#: Bounds of the training sample: labelled rows of either kind, picked by a hash of their doc_id.
MOST_TOXIC, MOST_CLEAN = 3000, 5000
#: Features that the models use: at most so many, those of highest chi-square among what so many rows
#: hold. The chance that any of the features tested is chosen though it tells nothing is SIGNIFICANCE.
FEATURES, LEAST_ROWS, SIGNIFICANCE = 600, 3, 0.05
#: Bytes of a word's beginning.
BEGINNINGS = (4, 5)
FOLDS = 3
CATEGORIES = ("explicit", "severe", "veiled", "toxic")
#: Least share of toxic rows among those that hold a marker.
MARKER = 0.9


def _features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(text index, 64-bit feature) of words, then of word beginnings, repeats included."""
    words = words_of(data, offsets, lower=True)
    # A closing mark is not part of the word.
    last = words.data[words.end - 1] if len(words.end) else words.end
    words.end = words.end - (np.isin(last, np.frombuffer(b".,;:!?", dtype=np.uint8)) & (words.end - words.start > 1))
    found, doc = [], []
    for k in BEGINNINGS:
        begin = words.hashes(k)
        found.append(begin[begin != 0])
        doc.append(words.doc[begin != 0])
    return [(words.doc, words.hashes()), (np.concatenate(doc), np.concatenate(found))]


def _both(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate(x) for x in zip(*_features(data, offsets), strict=True))


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in blocks(batch.column("text")):
            out = {c: batch.column(c).slice(first, end - first) for c in ("doc_id", "toxic")}
            for name, (doc, feature) in zip(("words", "beginnings"), _features(data, offsets), strict=True):
                out[name] = pa.array([np.unique(feature[doc == i]).view(np.int64) for i in range(end - first)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(out)


def _least_chi(chance: float) -> float:
    """The chi-square value, one degree of freedom, that is passed by ``chance`` only."""
    low, high = 0.0, 1000.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if math.erfc(math.sqrt(middle / 2)) > chance else (low, middle)
    return high


@dataclass
class Chain:
    """``features``: sorted hashes; ``weights``: one row for each category over features, earlier
    categories and a constant; ``threshold``: of the last category's probability."""

    features: np.ndarray
    weights: list[np.ndarray]
    threshold: float

    def probabilities(self, doc: np.ndarray, feature: np.ndarray, n_docs: int) -> np.ndarray:
        out = np.zeros((n_docs, len(CATEGORIES)))
        if not len(self.features):
            return out
        at = np.minimum(np.searchsorted(self.features, feature), len(self.features) - 1)
        hit = self.features[at] == feature
        pair = np.unique(doc[hit] * len(self.features) + at[hit])
        row, column = pair // len(self.features), pair % len(self.features)
        for c, w in enumerate(self.weights):
            total = np.bincount(row, weights=w[column], minlength=n_docs) + out[:, :c] @ w[len(self.features) : -1] + w[-1]
            out[:, c] = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return out


def _fit(row: np.ndarray, column: np.ndarray, n: int, width: int, extra: np.ndarray, y: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Logistic regression by diagonally scaled gradient steps over the rows in ``keep``."""
    use = keep[row]
    row, column, k = row[use], column[use], extra.shape[1]
    w, seen = np.zeros(width + k + 1), np.full(width + k + 1, 1e-8)
    weight = keep / max(keep.sum(), 1)
    for _ in range(120):
        z = np.bincount(row, weights=w[column], minlength=n) + extra @ w[width:-1] + w[-1]
        gap = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        slope = np.concatenate([np.bincount(column, weights=gap[row], minlength=width), extra.T @ gap, [gap.sum()]]) + 1e-5 * w
        seen += slope**2
        w -= 0.5 * slope / np.sqrt(seen)
    return w


def train(docs: DataFrame, labels: DataFrame) -> Chain:
    """Fit the chain on at most ``MOST_TOXIC + MOST_CLEAN`` rows of ``labels(doc_id, toxic)`` whose
    ``docs`` text is there. Unlabelled, null and contradictory rows are left out.

    Features are counted and chosen by Spark over all of the sample; the driver gets the chosen ones
    alone, at most ``FEATURES`` for each row of the sample, however long its texts are."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("m")).where("toxic = m")
    by = F.xxhash64("doc_id")
    picked = [known.where(F.col("toxic") == kind).orderBy(by, "doc_id").limit(most) for kind, most in ((1, MOST_TOXIC), (0, MOST_CLEAN))]
    sample = picked[0].unionByName(picked[1]).select("doc_id", "toxic")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null").join(F.broadcast(sample), "doc_id")  # bounded above
    rows = durable(texts.select("doc_id", F.col("toxic").cast("int"), "text").mapInArrow(_collect, "doc_id long, toxic int, words array<long>, beginnings array<long>"))
    n, n_toxic = rows.agg(F.count("*"), F.sum("toxic")).first()
    nothing = Chain(np.zeros(0, dtype=np.uint64), [], 1.0)
    if not n or n_toxic in (0, n):
        return nothing
    share = n_toxic / n
    held = rows.select("toxic", F.explode("words").alias("feature"), F.lit(True).alias("whole")).unionByName(
        rows.select("toxic", F.explode("beginnings").alias("feature"), F.lit(False).alias("whole")))
    held = held.groupBy("feature", "whole").agg(F.count("*").alias("has"), F.sum("toxic").alias("bad")).where(F.col("has") >= LEAST_ROWS)
    held, tested = counted(held.withColumn("chi", F.pow(F.col("bad") - F.col("has") * share, 2) / (F.col("has") * (share * (1 - share)))))
    chosen = held.where(F.col("chi") >= _least_chi(SIGNIFICANCE / max(tested, 1))).orderBy(F.desc("chi"), "feature").limit(FEATURES).toPandas()
    features = np.unique(chosen.feature.to_numpy(np.int64).view(np.uint64))
    markers = np.unique(chosen.feature[chosen.whole & (chosen.bad >= MARKER * chosen.has)].to_numpy(np.int64))
    if not len(features):
        return nothing
    signed = np.sort(features.view(np.int64))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [np.asarray(x.values) for x in batch.column("words")]
            marks = [int(np.isin(w, markers).sum()) for w in words]
            lists = [np.intersect1d(np.concatenate([w, np.asarray(b.values)]), signed) for w, b in zip(words, batch.column("beginnings"), strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "marks": pa.array(marks, pa.int64()), "features": pa.array(lists, pa.list_(pa.int64()))})

    got = rows.mapInArrow(narrow, "doc_id long, toxic int, marks long, features array<long>").toArrow().sort_by("doc_id")
    toxic = np.array(got.column("toxic").to_pylist(), dtype=float)
    marks = np.array(got.column("marks").to_pylist())
    lists = got.column("features").combine_chunks()
    row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
    column, width = np.searchsorted(features, lists.values.to_numpy().view(np.uint64)), len(features)
    target = np.stack([toxic * (marks >= 1), toxic * (marks >= 3), toxic * (marks == 0), toxic], axis=1)
    fold = (np.array(got.column("doc_id").to_pylist(), dtype=np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(FOLDS)
    apart, weights = np.zeros((n, len(CATEGORIES))), []
    for c in range(len(CATEGORIES)):
        extra = apart[:, :c].copy()
        for f in range(FOLDS):
            w = _fit(row, column, n, width, extra, target[:, c], fold != f)
            z = np.bincount(row, weights=w[column], minlength=n) + extra @ w[width:-1] + w[-1]
            apart[fold == f, c] = (1 / (1 + np.exp(-np.clip(z, -30, 30))))[fold == f]
        weights.append(_fit(row, column, n, width, extra, target[:, c], np.ones(n, dtype=bool)))
    # The threshold that separates best out of fold, a clean row lost counting as three toxic ones.
    grid = np.linspace(0.05, 0.95, 91)
    gain = np.array([((apart[:, -1] >= t) & (toxic == 1)).mean() - 3 * ((apart[:, -1] >= t) & (toxic == 0)).mean() for t in grid])
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return Chain(features, weights, float(grid[best[len(best) // 2]]))


def score(docs: DataFrame, chain: Chain, into: str = "toxicity") -> DataFrame:
    """``docs`` with a struct column ``into`` of the categories' probabilities and ``rejected``.

    All columns of ``docs`` pass through; one of the same name as ``into`` is replaced. Null and
    empty texts hold no feature: they get what the constants say and are never rejected.
    """
    kept = [c for c in docs.columns if c != into]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != into)
    inner = [*CATEGORIES, "rejected"]
    struct = "struct<" + ", ".join(f"{c}: double" for c in CATEGORIES) + ", rejected: boolean>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in blocks(batch.column("text")):
                n = end - first
                p = chain.probabilities(*_both(data, offsets), n)
                rejected = (p[:, -1] >= chain.threshold) & (np.diff(offsets) > 0) if chain.weights else np.zeros(n, dtype=bool)
                made = pa.StructArray.from_arrays([*[pa.array(p[:, c]) for c in range(len(CATEGORIES))], pa.array(rejected)], names=inner)
                part = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], made], names=[*kept, into])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(work, f"{schema}, `{into}` {struct}")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on ``labels(doc_id, toxic)`` and score every row of ``docs(doc_id, text, ...)``.

    Returns ``doc_id``, a probability for each category and ``rejected``, one row for each input
    row. Without both kinds of label nothing is rejected. Null and repeated doc_ids are scored
    like others.
    """
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", *[F.col(f"toxicity.{c}").alias(f"p_{c}") for c in CATEGORIES], "toxicity.rejected")
