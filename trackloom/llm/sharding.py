"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, range partition.

Records are ordered by a key: the 64-bit hash of the text, then the number of the row, so equal texts
lie together and even rows that are equal throughout can be told apart. A
sample with a chance in proportion to size gives boundaries at quantiles of the bytes, many fine
ranges to a shard. The bytes of every fine range are then counted exactly. A range that turns out
overfull (a group of equal texts, or an unlucky sample) is subdivided by further boundaries among
its own records, until none is. Fine ranges are dealt to shards in key order where the running total
of bytes passes the shards' quantiles; then single ranges move from the fullest shard to the
emptiest as long as that brings the two closer.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.plans.durable import durable

#: Fine ranges that the first boundaries aim at: so many to a shard, and so many at least. Their number
#: doesn't grow with the records. The driver holds a few numbers for each; a task sorts one fine range,
#: some 40 bytes for each record whatever its text, and spills.
FINE, RANGES = 128, 2048
#: Sampled keys for each fine range.
SAMPLES = 16
#: A range with more than so many times its share of bytes, its largest record aside, is subdivided.
OVERFULL = 1.5
#: Shards may differ by this share of their mean without ranges being moved.
EVEN = 0.001


def keyed(docs: DataFrame, carried: bool = False) -> DataFrame:
    """``doc_id, size, text_crc32, group_key, tie``: size is UTF-8 bytes plus 1; ``tie`` orders
    records of equal text. It is the row's number, so no two rows share it; it is stable only once the
    rows are written. ``carried``: all columns of ``docs`` too, as the struct ``row``."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("group_key"),
        F.monotonically_increasing_id().alias("tie"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carried else []))


def _sample(rows: DataFrame, wanted: int, total: int, salt: int) -> pd.DataFrame:
    """About ``wanted`` keys, each drawn with a chance in proportion to its size; ``weight`` is the
    size each stands for."""
    chance = F.least(F.lit(1.0), F.col("size") * (wanted / max(total, 1)))
    draw = F.pmod(F.xxhash64(F.lit(salt), "group_key", "tie"), F.lit(1 << 40)) / float(1 << 40)
    drawn = rows.where(draw < chance).select("group_key", "tie", (F.col("size") / chance).alias("weight"))
    return drawn.toPandas().sort_values(["group_key", "tie"], kind="stable", ignore_index=True)


def _quantiles(sample: pd.DataFrame, step: float) -> list[tuple[int, int]]:
    """Keys at every ``step`` of the sampled weight."""
    passed = np.floor(np.cumsum(sample.weight.to_numpy()) / step)
    at = np.flatnonzero(np.diff(np.concatenate([[0.0], passed])) > 0)
    return list(zip(sample.group_key.to_numpy()[at].tolist(), sample.tie.to_numpy()[at].tolist(), strict=True))


def _ranged(rows: DataFrame, splitters: list[tuple[int, int]]) -> DataFrame:
    """Adds ``range``: how many splitters are at or below the record's key."""
    if not splitters:
        return rows.withColumn("range", F.lit(0))
    high = np.array([s[0] for s in splitters], dtype=np.int64)
    low = np.array([s[1] for s in splitters], dtype=np.int64)

    @F.pandas_udf("int")
    def place(group_key: pd.Series, tie: pd.Series) -> pd.Series:
        k, t = group_key.to_numpy(np.int64), tie.to_numpy(np.int64)
        left, right = np.searchsorted(high, k, "left"), np.searchsorted(high, k, "right")
        while (open_ := left < right).any():  # several splitters inside one group of equal texts
            mid = (left + right) // 2
            below = open_ & (low[np.minimum(mid, len(low) - 1)] <= t)
            left, right = np.where(below, mid + 1, left), np.where(open_ & ~below, mid, right)
        return pd.Series(left.astype(np.int32))

    return rows.withColumn("range", place("group_key", "tie"))


def deal(sizes: np.ndarray, n_shards: int) -> np.ndarray:
    """The shard of each range: in order where the running total passes the shards' quantiles, then
    ranges move from the fullest shard to the emptiest while that evens the two out."""
    total = sizes.sum()
    shard = np.minimum(n_shards - 1, ((np.cumsum(sizes) - sizes / 2) * n_shards / max(total, 1)).astype(np.int64))
    load = np.bincount(shard, weights=sizes, minlength=n_shards)
    order, cuts = np.argsort(shard, kind="stable"), np.searchsorted(np.sort(shard), np.arange(1, n_shards))
    own = [x.tolist() for x in np.split(order, cuts)]
    full, empty = [(-x, s) for s, x in enumerate(load)], [(x, s) for s, x in enumerate(load)]
    heapq.heapify(full), heapq.heapify(empty)
    while full:
        if -full[0][0] != load[full[0][1]]:  # stands for an earlier load
            heapq.heappop(full)
            continue
        while empty[0][0] != load[empty[0][1]]:
            heapq.heappop(empty)
        most, least = full[0][1], empty[0][1]
        gap = load[most] - load[least]
        if gap <= EVEN * total / n_shards:
            break
        fitting = [r for r in own[most] if sizes[r] < gap]
        if not fitting:  # one large record holds this shard up
            heapq.heappop(full)
            continue
        moved = min(fitting, key=lambda r: (abs(2 * sizes[r] - gap), r))
        own[most].remove(moved), own[least].append(moved)
        shard[moved] = least
        for s, change in ((most, -sizes[moved]), (least, sizes[moved])):
            load[s] += change
            heapq.heappush(full, (-load[s], s)), heapq.heappush(empty, (load[s], s))
    return shard


def _placed(rows: DataFrame, n_shards: int) -> DataFrame:
    """Adds ``shard`` and ``slot`` to written rows of ``keyed``."""
    spark = rows.sparkSession
    total = rows.agg(F.sum("size")).first()[0] or 0
    fine = max(n_shards * FINE, RANGES)
    share = total / fine if total else 1.0
    splitters = sorted(set(_quantiles(_sample(rows, fine * SAMPLES, total, 0), share)))
    turn = 0
    while True:
        found = _ranged(rows, splitters)
        stats = found.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("size").alias("largest")).toPandas().sort_values("range")
        over = stats[stats.bytes - stats.largest > OVERFULL * share]
        if over.empty:
            break
        # Another draw, and a denser one where earlier draws split nothing. No two records share a key, so at
        # the latest a draw of all of a range's records splits it.
        turn += 1
        inside = found.join(F.broadcast(spark.createDataFrame([(int(r),) for r in over.range], "range int")), "range", "left_semi")
        drawn = _sample(inside, int(over.bytes.sum() / share + 1) * SAMPLES * turn, int(over.bytes.sum()), turn)
        splitters = sorted(set(splitters) | set(_quantiles(drawn, share / 2)))
    dealt = stats.assign(shard=deal(stats.bytes.to_numpy(np.float64), n_shards))
    dealt["ahead"] = dealt.groupby("shard").n.cumsum() - dealt.n
    table = spark.createDataFrame(list(dealt[["range", "shard", "ahead"]].astype(int).itertuples(index=False, name=None)), "range int, shard int, ahead long")
    inside = W.partitionBy("range").orderBy("group_key", "tie", "doc_id", "size")
    placed = found.join(F.broadcast(table), "range")  # a row for each fine range
    return placed.withColumn("slot", F.col("ahead") + F.row_number().over(inside) - 1)


def shards(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """A shard and a slot for each row of ``docs(doc_id, text, ...)``, bytes near equal by shard.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``: ``law`` is ``bytes``,
    ``slot`` counts from 0 without gaps in key order inside a shard, ``grown_shard`` is null, as this
    law moves records when shards are added. Equal texts share a shard unless a boundary falls
    among them. Null texts have size 1. Null and repeated doc_ids, and rows that are equal
    throughout, are each placed like others. Without rows the result is empty. Shards are as even as
    single records allow: one record larger than a shard's share makes that shard larger. Other
    columns are not read.
    """
    placed = _placed(durable(keyed(docs)), n_shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 16) -> None:
    """Write ``docs`` as Parquet, a folder a shard, rows in slot order inside each file. Every row
    is written once, whatever its doc_id; the rows pass through the checkpoint folder, as their
    numbers must not change."""
    placed = _placed(durable(keyed(docs, carried=True)), n_shards).select("row", F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    ordered = placed.repartitionByRange("__shard", "__slot").sortWithinPartitions("__shard", "__slot")
    ordered.select("row.*", F.col("__shard").alias("__shard")).write.partitionBy("__shard").parquet(path)
