"""Hard-negative mining: scores of anchors against all rows, a secondary sort, and open windows.

Rows and anchors are dealt into tiles; each pair of tiles is one product of two small matrices in a
task. A first turn keeps the best positives of each anchor and tile, from which the positives
follow. A second turn keeps, of each tile, the first negatives inside each positive's window: no
other row of the tile can be among the first of all. What is left is packed into binary keys whose
byte order is (anchor, score descending, positives first, id). ``repartitionAndSortWithinPartitions``
brings an anchor's keys together in that order, and an iterator streams over them: a positive opens
a window, a negative goes to every open window that it fits. It holds one anchor's positives, never
its rows.

Tiles of anchors times tiles of rows is a stated query set against all rows, in blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.plans.durable import counted

#: Rows and anchors in a tile. A task holds one tile of each and their scores, some 70 MB.
TILE, ANCHOR_TILE = 4096, 1024
#: Bits that are flipped so that big-endian bytes order as signed numbers.
_SIGN = np.uint64(1 << 63)
#: Layout of a key: anchor id, anchor row, score, kind, id of the other row.
_KEY = ">QQQBQ"


def usable(vectors: DataFrame) -> DataFrame:
    """``row, vec_id, label, vector``: rows whose id, label and vector are known and whose components
    are all finite. ``row`` numbers them; it is stable once the rows are written."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>").alias("vector"))
    return rows.where("vec_id is not null and label is not null and vector is not null").where(~bad).withColumn("row", F.monotonically_increasing_id())


def _matrix(table: pa.Table, scale: float) -> np.ndarray:
    """The vectors as floor(scale * x), one a line."""
    flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.floor(scale * flat).reshape(table.num_rows, -1)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; an error where a long can't hold them."""
    bound = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if bound < 2**53:  # every partial sum is a whole number that a double holds
        return (a @ b.T).astype(np.int64)
    if bound >= 2**62:
        raise ValueError("inner products of these vectors don't fit a long")
    return a.astype(np.int64) @ b.astype(np.int64).T


def _flipped(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64).view(np.uint64) ^ _SIGN


def _packed(anchor_id: np.ndarray, anchor: np.ndarray, score: np.ndarray, kind: int, other: np.ndarray) -> pa.Array:
    """Binary keys: anchor's id and row, score descending, kind, id of the other row."""
    out = np.empty(len(anchor), dtype=[("i", ">u8"), ("a", ">u8"), ("s", ">u8"), ("k", "u1"), ("o", ">u8")])
    out["i"], out["a"], out["s"], out["k"], out["o"] = _flipped(anchor_id), anchor, _flipped(~score.astype(np.int64)), kind, _flipped(other)
    return pa.array([x.tobytes() for x in out], pa.binary())


def _lowest(score: int, low: Fraction) -> int:
    """The least whole score that is at least ``low`` of ``score``."""
    return -((-low.numerator * score) // low.denominator)


def _tile(first: bool, positives: int, negatives: int, low: Fraction, high: Fraction, scale: float):
    """Works on one tile of rows and one of anchors. The first turn gives each anchor's best rows of its
    own label; the second the first rows of other labels inside each window."""

    def work(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return pa.table({"key": pa.array([], pa.binary())} if not first else {"anchor": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "id": pa.array([], pa.int64())})
        rows = rows.sort_by("vec_id")
        labels = pa.chunked_array([*rows.column("label").chunks, *anchors.column("label").chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
        ids, own = rows.column("vec_id").to_numpy(), labels[: rows.num_rows]
        anchor, anchor_id = anchors.column("row").to_numpy(), anchors.column("vec_id").to_numpy()
        score = _scores(_matrix(anchors, scale), _matrix(rows, scale))
        out = []
        for k in range(anchors.num_rows):
            same = own == labels[rows.num_rows + k]
            picked = np.flatnonzero((same if first else ~same) & (ids != anchor_id[k]))
            picked = picked[np.argsort(-score[k, picked], kind="stable")]  # ties stay in id order
            if first:
                picked = picked[:positives]
            else:
                falling, chosen = -score[k, picked], []
                for s in anchors.column("scores")[k].as_py():
                    at = np.searchsorted(falling, -(high.numerator * s // high.denominator))
                    end = np.searchsorted(falling, -_lowest(s, low), side="right")
                    chosen.append(np.arange(at, min(end, at + negatives)))
                picked = picked[np.unique(np.concatenate(chosen))] if chosen else picked[:0]
            out.append((np.full(len(picked), k), picked))
        k, picked = (np.concatenate(x) for x in zip(*out, strict=True))
        if first:
            return pa.table({"anchor": anchor[k], "score": score[k, picked], "id": ids[picked]})
        return pa.table({"key": _packed(anchor_id[k], anchor[k], score[k, picked], 1, ids[picked])})

    return work


def _windows(positives: int, negatives: int, low: Fraction, high: Fraction):
    """Streams over sorted keys; a window is (positive's id, its score, negatives given so far)."""

    def work(keys: Iterator[tuple[bytes, None]]) -> Iterator[tuple[int, int, int, int, int, int]]:
        before, open_ = None, []
        for key, _ in keys:
            anchor_id, anchor, falling, kind, other = struct.unpack(_KEY, key)
            if (anchor_id, anchor) != before:
                before, open_ = (anchor_id, anchor), []
            score, other = ~(falling - 2**63), other - 2**63
            if kind == 0:
                open_.append([other, score, 0])
                continue
            for window in open_:
                positive, best, n = window
                if n < negatives and low * best <= score <= high * best:
                    window[2] += 1
                    yield anchor_id - 2**63, positive, n + 1, other, best, score

    return work


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: float = 0.8, high: float = 1.0, scale: float = 256.0) -> DataFrame:
    """Hard negatives of each anchor and positive among ``vectors(vec_id, label, embedding, ...)``.

    Anchors are the rows whose ``vec_id`` is divisible by ``every``. A score is the inner product of
    vectors scaled to whole numbers, ``floor(scale * x)``; higher ones come first, then smaller ids.
    An anchor's positives are its first rows of the same label, its negatives for a positive the first
    rows of other labels that score between ``low`` and ``high`` (at most 1) times as much. Returns
    ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``, ``rank`` from 1.

    Rows without id, label or vector, or with a null or non-finite component, take no part. A row is
    compared with rows of as many components only; empty vectors score 0. Rows that share the anchor's
    id are neither its positives nor its negatives; other repeated rows are rows like others, and a
    repeated anchor is mined each time. Scores that a long can't hold are an error. Other columns
    are not read; without rows or anchors the result is empty.
    """
    if high > 1:
        raise ValueError("a negative's score can't be above the positive's: a window opens at its positive")
    low_, high_ = Fraction(str(low)), Fraction(str(high))
    spark = vectors.sparkSession
    rows, n_rows = counted(usable(vectors))
    is_anchor = F.col("vec_id") % every == 0
    n_anchors = rows.where(is_anchor).count()
    row_tiles, anchor_tiles = 1 + n_rows // TILE, 1 + n_anchors // ANCHOR_TILE
    width, spread = F.size("vector").alias("width"), F.xxhash64("row")
    tile, near = F.pmod(spread, F.lit(row_tiles)).alias("tile"), F.pmod(spread, F.lit(anchor_tiles)).alias("near")
    dealt = rows.select("row", "vec_id", "label", "vector", width, tile, F.explode(F.sequence(F.lit(0), F.lit(anchor_tiles - 1))).alias("near"))

    def turn(anchors: DataFrame, first: bool) -> DataFrame:
        copies = anchors.select("*", width, near, F.explode(F.sequence(F.lit(0), F.lit(row_tiles - 1))).alias("tile"))
        work, kind = _tile(first, positives, negatives, low_, high_, scale), "anchor long, score long, id long" if first else "key binary"
        by = [F.col("width"), F.col("tile").cast("long"), F.col("near").cast("long")]
        return dealt.groupBy(*by).cogroup(copies.groupBy(*by)).applyInArrow(work, kind)

    best = W.partitionBy("anchor").orderBy(F.desc("score"), "id")
    chosen, _ = counted(turn(rows.where(is_anchor), True).withColumn("n", F.row_number().over(best)).where(F.col("n") <= positives))
    scores = chosen.groupBy(F.col("anchor").alias("row")).agg(F.collect_list("score").alias("scores"), F.collect_list(F.struct("score", "id")).alias("found"))
    anchors, _ = counted(rows.where(is_anchor).join(scores, "row"))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"key": _packed(*(b.column(c).to_numpy() for c in ("vec_id", "row", "score")), 0, b.column("id").to_numpy())})

    openers = anchors.select("vec_id", "row", F.inline("found")).mapInArrow(opened, "key binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = openers.union(turn(anchors.drop("found"), False)).rdd.map(lambda r: (bytes(r.key), None))
    ordered = keys.repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:16]))
    found = ordered.mapPartitions(_windows(positives, negatives, low_, high_))
    return spark.createDataFrame(found, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
