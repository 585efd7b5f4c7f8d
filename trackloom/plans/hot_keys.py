"""Equi joins between many rows and one summary row per key, when some keys are hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: No more than this many keys can each hold more than a ``1 / HOT_KEYS`` share of the rows.
HOT_KEYS = 500


def attach(rows: DataFrame, summary: DataFrame, keys: list[str], count: str, total: int, how: str = "inner", spread: Column | None = None) -> DataFrame:
    """Join ``summary`` (unique on ``keys``, ``count`` = rows of the key) to ``rows``, in one pass.

    Keys holding more than ``total / HOT_KEYS`` rows number at most ``HOT_KEYS``, whatever the size
    of the input, so the list of them can be broadcast. Their rows are dealt over as many salts as
    they exceed that share, their summary row being repeated for each; other keys have one salt.
    ``keys`` must not be null in ``rows``. ``how`` is ``inner`` or ``left``; ``total`` is the number
    of rows; ``spread`` is the hash that picks a row's salt, by default over all its columns.
    The largest count is looked up at once; without a hot key the join is a plain one.
    """
    limit = max(1000, total // HOT_KEYS)
    if (summary.agg(F.max(count)).first()[0] or 0) <= limit:
        return rows.join(summary.hint("shuffle_hash"), keys, how)
    salts = F.greatest(F.lit(1), F.ceil(F.col(count) / limit)).cast("int")
    hot = summary.where(F.col(count) > limit).select(*keys, salts.alias("__salts"))
    spread = F.xxhash64(*rows.columns) if spread is None else spread
    dealt = rows.withColumn("__spread", spread).join(F.broadcast(hot), keys, "left")
    dealt = dealt.withColumn("__salt", F.coalesce(F.expr("pmod(__spread, __salts)"), F.lit(0)).cast("int")).drop("__spread", "__salts")
    copies = summary.withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return dealt.join(copies.hint("shuffle_hash"), [*keys, "__salt"], how).drop("__salt")
