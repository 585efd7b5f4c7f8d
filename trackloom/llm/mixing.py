"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

A document's size is its number of words. Sources share the words of the whole by their weights; a
target stops at ``max_repeats`` times what its source holds, and the excess goes to the others by
weight. A source is repeated in complete epochs as often as its target allows; what is left is a
fractional selection: documents by ascending exponential key ``-ln(u) / quality`` until the budget
is used up. ``u`` comes from a hash of the document, so reruns agree.

The running sum over a source is taken in two steps. Keys are cut into buckets, more for larger
sources; words are summed by bucket; only inside a bucket are rows sorted. So a source that holds a
third of all rows is spread like the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.plans.durable import durable

#: Rows in a bucket of a source's keys, about.
BUCKET_ROWS = 2000
#: Classes of quality by whose sizes keys are spread over a source's buckets.
QUALITIES = 64
#: Characters that speak against running prose, for the quality weight.
NOISE = "0123456789#*$%&|<>{}[]=_\\/@"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Between 0.1 and 1: the share of characters outside ``NOISE``; 0.1 without text."""
    n = F.length(text)
    clean = F.length(F.translate(text, NOISE, ""))
    return F.coalesce(F.when(n > 0, 0.1 + 0.9 * clean / n), F.lit(0.1))


def targets(sizes: DataFrame, weights: list[float], max_repeats: int = 3) -> DataFrame:
    """``sizes(source, source_size)`` -> plus ``target``. ``weights`` are dealt to the sources in
    code point order, null last, again and again.

    A source's target is ``min(max_repeats * source_size, level * weight)``: filled in the order of
    cap over weight, those before the level stand at their caps.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, [float(w) for w in weights])), ((F.row_number().over(order) - 1) % len(weights)) + 1)
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(max_repeats))
    fill = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, onward = fill.rowsBetween(W.unboundedPreceding, -1), fill.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = ranked.withColumn("level", left / F.sum("weight").over(onward))
    # The first source whose cap reaches the level sets it for all that follow.
    level = level.withColumn("level", F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(whole).getField("level"))
    return level.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def bucketed(docs: DataFrame, weights: list[float], max_repeats: int, row: str | None = None) -> DataFrame:
    """Rows of ``docs`` with their size and key, what their source's plan is, and the ``bucket`` of the key."""
    told = [row] if row else []
    draw = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))), F.lit("mix")), 256), 1, 12), 16, 10)
    uniform = (draw.cast("double") + 0.5) / float(16**12)
    rows = docs.select(*told, "doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), quality_weight(F.col("text")).alias("quality"), (-F.log(uniform)).alias("drawn"))
    rows = durable(rows.select(*told, "doc_id", "source", "size", "quality", (F.col("drawn") / F.col("quality")).alias("rank_key")))
    classes = rows.groupBy("source", F.floor(F.col("quality") * QUALITIES).alias("class")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"), F.avg("quality").alias("of"))
    sizes = classes.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("rows").alias("n"), F.array_sort(F.collect_list(F.struct("of", "rows"))).alias("classes"))
    sized = targets(sizes.select("source", "source_size"), list(weights), max_repeats)
    plan = sized.join(sizes.select(F.col("source").alias("s"), "n", "classes"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    plan = durable(plan.withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET_ROWS)).cast("long")))
    # A key is exponential with its row's quality as rate, so the share of a source's keys below k is this sum over
    # its classes of quality. It grows with the key and spreads a source's rows evenly, whatever they are like.
    named = rows.join(plan.select(F.col("source").alias("s"), "source_size", "target", "epochs", "budget", "buckets", "n", "classes"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    below = F.aggregate("classes", F.lit(0.0), lambda acc, c: acc + c.getField("rows") * (1 - F.exp(-c.getField("of") * F.col("rank_key")))) / F.col("n")
    named = named.withColumn("bucket", F.least(F.floor(below * F.col("buckets")), F.col("buckets") - 1)).drop("classes", "n")
    return named


def mix(docs: DataFrame, weights: list[float] = (5, 2, 1), max_repeats: int = 3, row: str | None = None) -> DataFrame:
    """How many words of each row of ``docs(doc_id, text, source, ...)`` the mix takes.

    Returns ``doc_id, size, source_size, target, taken, copies``: ``taken`` counts repeats,
    ``copies`` is the number of (started) repeats. The document at the end of the budget is taken
    in part. Null texts have size 0 and are never taken; null sources are a source of their own.
    Rows that repeat doc_id and text have the same key and follow one another; rows without a doc_id
    draw by their text. Without rows the result is empty. The list of sources is sorted in one task. ``row`` names a column that tells rows apart and is returned too, so copies
    can be given to rows whose doc_id is null or repeated. Other columns are not read.
    """
    told = [row] if row else []
    named = bucketed(docs, weights, max_repeats, row)
    sums = named.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    ahead = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    placed = named.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    inside = W.partitionBy("source", "bucket").orderBy("rank_key", "doc_id", "size", *told).rowsBetween(W.unboundedPreceding, -1)
    start = F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - start))
    taken = F.col("epochs") * F.col("size") + part
    return placed.select(*told, "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), (F.col("epochs") + (part > 0).cast("long")).alias("copies"))
