"""One-to-one matching of predictions with labels, and metrics on the matches."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions import geometry as G
from trackloom.operators.diagnostics import label_compatible
from trackloom.operators.intervals import interval_join
from trackloom.plans.components import components
from trackloom.plans.durable import counted


def eligible(predictions: DataFrame, labels: DataFrame, keys: list[str], least_iou: float = 0.1, tolerance: float = 2.0, width: float = 60.0) -> DataFrame:
    """Pairs that may match: equal ``keys`` (camera, video, type), and temporal IoU of ``least_iou`` (more
    than 0) or both endpoints within ``tolerance`` seconds. ``predictions(prediction, start, end)``,
    ``labels(label, start, end)``; adds ``tiou``, ``start_error``, ``end_error``, ``weight``. Such pairs
    overlap or are ``tolerance`` apart, so they meet in time buckets of ``width``. A reversed interval
    shares no time with another, so its pairs start within ``tolerance`` and meet by their starts."""
    if least_iou <= 0:
        raise ValueError("least_iou is more than 0: else every pair of a key may match")
    p = predictions.select(*keys, "prediction", F.col("start").alias("a"), F.col("end").alias("b"), F.col("start").alias("start1"))
    q = labels.select(*keys, "label", F.col("start").alias("c"), F.col("end").alias("d"), F.col("start").alias("start2"))
    met = lambda x, y, end1, end2: interval_join(x.withColumn("end1", F.col(end1)), y.withColumn("end2", F.col(end2)), "near", tolerance, width, keys)
    pairs = met(p, q, "b", "d").unionByName(met(p.where("a > b"), q, "a", "c")).unionByName(met(p.where("a <= b"), q.where("c > d"), "a", "c")).drop("start1", "end1", "start2", "end2")
    a, b, c, d = (F.col(x) for x in "abcd")
    one, two = G.endpoint_errors(a, b, c, d)
    pairs = pairs.withColumn("tiou", G.temporal_iou(a, b, c, d)).withColumn("start_error", one).withColumn("end_error", two)
    near = (F.col("start_error") <= tolerance) & (F.col("end_error") <= tolerance)
    weight = F.col("tiou") + 0.001 / (1 + F.col("start_error") + F.col("end_error"))
    return pairs.where((F.col("tiou") >= least_iou) | near).withColumn("weight", weight).drop("a", "b", "c", "d")


def assign(left: np.ndarray, right: np.ndarray, weight: np.ndarray, most: bool = True) -> np.ndarray:
    """Which edges of a bipartite graph form the best one-to-one assignment: as many as possible, then the
    greatest sum of weights; without ``most`` the greatest sum alone.

    ``left``, ``right``: vertices from 0, ``weight`` of each edge. Left vertices join one at a time by the
    cheapest path that alternates between open and chosen edges and ends at a free right vertex, or at a left
    one that stays alone; prices keep all costs at least 0, so a heap finds it and stops there. Memory
    is that of the edges."""
    n, m = (int(x.max()) + 1 if len(x) else 0 for x in (left, right))
    best = np.lexsort((-weight, right, left))  # of repeated edges the heaviest
    best = best[np.concatenate([[True], (np.diff(left[best]) != 0) | (np.diff(right[best]) != 0)])] if len(best) else best
    if not most:
        best = best[weight[best] > 0]
    first = np.searchsorted(left[best], np.arange(n + 1)).tolist()
    bonus = 2.0 * (float(np.abs(weight).sum()) + 1.0) if most else 0.0
    cost, to = (-(bonus + weight[best])).tolist(), right[best].tolist()
    start = left[best].tolist()
    price_left = [min([0.0, *cost[first[i] : first[i + 1]]]) for i in range(n)]  # a left vertex alone costs 0
    price_right, chosen, held = [0.0] * m, [-1] * m, [-1] * n  # a right vertex's edge, a left one's right vertex
    for vertex in range(n):
        least, came, settled, heap = {}, {}, [], []
        end, alone, length, i, at = -1, -1, float("inf"), vertex, 0.0
        while True:
            if at - price_left[i] < length:
                length, end, alone = at - price_left[i], -1, i
            for e in range(first[i], first[i + 1]):
                far = at + max(0.0, cost[e] - price_left[i] - price_right[to[e]])
                if far < length and far < least.get(to[e], float("inf")):
                    least[to[e]], came[to[e]] = far, e
                    heapq.heappush(heap, (far, to[e]))
            while heap and heap[0][0] > least[heap[0][1]]:
                heapq.heappop(heap)
            if not heap or heap[0][0] >= length:
                break
            at, j = heapq.heappop(heap)
            if chosen[j] < 0:
                length, end = at, j
                break
            settled.append((j, at))
            least[j] = -1.0  # done
            i = start[chosen[j]]
        price_left[vertex] += length
        for j, far in settled:
            price_right[j] -= length - far
            price_left[start[chosen[j]]] += length - far
        if end < 0:  # ``alone`` gives up what it held
            end, held[alone] = held[alone], -1
        while end >= 0:
            chosen[end] = came[end]
            i = start[came[end]]
            held[i], end = end, held[i]
    out = np.zeros(len(weight), dtype=bool)
    out[best[[e for e in chosen if e >= 0]]] = True
    return out


def one_to_one(pairs: DataFrame, left: str = "prediction", right: str = "label", weight: str = "weight", most: bool = True) -> DataFrame:
    """A one-to-one subset of ``pairs``: most pairs first, then greatest total weight; without ``most`` the
    greatest total weight alone.

    Connected components of the pairs are independent, so each is solved alone, in memory of the order of
    its pairs; a pair that is its own component needs no solving. Only components with a choice reach
    Python, many at a time. Ids of one side are of one type and not null; of repeated pairs one is chosen.
    """
    pairs, _ = counted(pairs)  # read for the components and again for what they hold
    name = F.concat(F.lit("p"), F.col(left).cast("string")).alias("u")
    labels = components(pairs.select(name, F.concat(F.lit("q"), F.col(right).cast("string")).alias("v"))).withColumnRenamed("id", "u")
    listed = pairs.select(name, F.struct(*pairs.columns).alias("__pair")).join(labels, "u").groupBy("component").agg(F.collect_list("__pair").alias("__pairs"))

    @F.pandas_udf("array<int>")
    def solve(lefts: pd.Series, rights: pd.Series, weights: pd.Series) -> pd.Series:
        number = lambda ids: np.unique(ids, return_inverse=True)[1]
        return pd.Series([np.flatnonzero(assign(number(a), number(b), np.asarray(w, np.float64), most)) for a, b, w in zip(lefts, rights, weights, strict=True)])

    alone = listed.where(F.size("__pairs") == 1).select(F.inline("__pairs"))
    chosen = solve(*[F.col(f"__pairs.{c}") for c in (left, right, weight)])
    solved = listed.where(F.size("__pairs") > 1).withColumn("__chosen", chosen).select(F.inline(F.transform("__chosen", lambda i: F.get("__pairs", i))))
    return (alone if most else alone.where(F.col(weight) > 0)).unionByName(solved)


def match_boxes(left: DataFrame, right: DataFrame, keys: list[str], least_iou: float, compatible: Callable[[Column, Column], Column] | None = None, kind: str = "union_floor") -> DataFrame:
    """One-to-one matches of the boxes of each frame: ``keys, left, right, iou``, by the greatest sum of
    ``1 + iou`` over pairs of at least ``least_iou`` whose classes agree.

    ``left(keys, left, class, x1..y2)``, ``right(keys, right, class, x1..y2)``; ``keys`` name a frame;
    ``compatible`` tells from both classes whether a pair may match (``None``: any). Boxes that are null
    match nothing. A frame's pairs are one array, and Python takes many frames at a time; a pair that is alone in
    its frame needs no solving."""
    box = ("x1", "y1", "x2", "y2")
    other = right.select(*keys, "right", F.col("class").alias("__class"), *[F.col(c).alias(f"r_{c}") for c in box])
    pairs = left.select(*keys, "left", "class", *box).join(other, keys)
    if compatible is not None:
        pairs = pairs.where(compatible(F.col("class"), F.col("__class")))
    pairs = pairs.withColumn("iou", G.iou(G.box(), G.box("r_"), kind)).where(F.col("iou") >= least_iou).select(*keys, "left", "right", "iou")

    listed = pairs.groupBy(*keys).agg(F.collect_list(F.struct("left", "right", "iou")).alias("__pairs"))
    schema = listed.select(*keys, F.col("__pairs").alias("__chosen")).schema

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[keys].assign(__chosen=[_best_pairs(rows) for rows in batch["__pairs"]])

    alone = listed.where(F.size("__pairs") == 1)
    chosen = listed.where(F.size("__pairs") > 1).mapInPandas(solve, schema)
    of = lambda df, c: df.select(*keys, F.inline(c))
    return of(alone.where(F.element_at("__pairs", 1)["iou"] > -1), "__pairs").unionByName(of(chosen, "__chosen"))


def _best_pairs(rows: list) -> list:
    """The pairs of one frame that form the best assignment."""
    number = lambda c: np.unique([x[c] for x in rows], return_inverse=True)[1]
    chosen = assign(number("left"), number("right"), np.array([1.0 + x["iou"] for x in rows]), False)
    return [x for x, own in zip(rows, chosen, strict=True) if own]


def match_annotations(annotations: DataFrame, detections: DataFrame, keys: list[str], least_iou: float = 0.5) -> DataFrame:
    """Reviewed boxes against detections, frame by frame: those that are visible and have a box, classes by
    ``label_compatible``. ``annotations(keys, left, class, visibility, x1..y2)``."""
    return match_boxes(annotations.where("visibility <> 'not_visible' and x1 is not null"), detections, keys, least_iou, label_compatible)


def match_references(detections: DataFrame, references: DataFrame, keys: list[str], least_iou: float = 0.3, compatible: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Detections against reference actors, frame by frame, so that none claims two actors."""
    return match_boxes(detections, references, keys, least_iou, compatible)


def greedy(hits: DataFrame, keys: list[str], order: list[str], candidates: str = "candidates") -> DataFrame:
    """Each hit, in rank order inside its group, takes the first label of its array ``candidates``
    that no earlier hit took; ``label`` is null without one."""
    listed = hits.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, candidates))).alias("h"))
    start = F.struct(F.array().cast("array<long>").alias("used"), F.array().cast(f"array<struct<{order[-1]}:long,label:long>>").alias("out"))

    def step(acc: Column, h: Column) -> Column:
        free = F.element_at(F.concat(F.filter(h.getField(candidates), lambda c: ~F.array_contains(acc.getField("used"), c)), F.array(F.lit(None).cast("long"))), 1)
        used = F.when(free.isNull(), acc.getField("used")).otherwise(F.concat(acc.getField("used"), F.array(free)))
        return F.struct(used.alias("used"), F.concat(acc.getField("out"), F.array(F.struct(h.getField(order[-1]).alias(order[-1]), free.alias("label")))).alias("out"))

    return listed.select(*keys, F.inline(F.aggregate("h", start, step, lambda acc: acc.getField("out"))))


def detection_metrics(predictions: DataFrame, labels: DataFrame, matches: DataFrame, by: list[str]) -> DataFrame:
    """True and false positives, misses, precision, recall, false discovery rate and the matches' mean
    temporal IoU and endpoint errors for each column of ``by`` apart and in all (grouping sets).
    Ratios without a denominator are null. ``by`` columns are in all three tables."""
    rows = (
        predictions.select(*by, F.lit(1).alias("p"), F.lit(0).alias("l"), F.lit(0).alias("m"), *[F.lit(None).cast("double").alias(c) for c in ("tiou", "start_error", "end_error")])
        .unionByName(labels.select(*by, F.lit(0).alias("p"), F.lit(1).alias("l"), F.lit(0).alias("m")), allowMissingColumns=True)
        .unionByName(matches.select(*by, F.lit(0).alias("p"), F.lit(0).alias("l"), F.lit(1).alias("m"), "tiou", "start_error", "end_error"), allowMissingColumns=True))
    sets = [[F.col(c)] for c in by] + [[]]
    out = rows.groupingSets(sets, *by).agg(
        F.sum("m").alias("tp"), (F.sum("p") - F.sum("m")).alias("fp"), (F.sum("l") - F.sum("m")).alias("fn"), F.sum("p").alias("predictions"), F.sum("l").alias("labels"),
        *[F.avg(c).alias(c) for c in ("tiou", "start_error", "end_error")])
    ratio = lambda a, b: F.try_divide(a, b)
    return out.withColumn("precision", ratio(F.col("tp"), F.col("predictions"))).withColumn("recall", ratio(F.col("tp"), F.col("labels"))).withColumn("false_discovery", ratio(F.col("fp"), F.col("predictions")))


def retrieval_metrics(results: DataFrame, relevant: DataFrame, queries: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """P@1, P@5 (of five, always), R@5, reciprocal rank and AP@5 for each query with relevant items,
    ``false_positive`` for each without. ``results(query_id, item, rank)``, ``relevant(query_id,
    item)``, ``queries(query_id)``. With ``counts(query_id, n)``, of queries with relevant items,
    ``relevant`` need only hold those among the results."""
    n = relevant.distinct().groupBy("query_id").agg(F.count("*").alias("n")) if counts is None else counts
    hit = results.join(relevant.distinct().withColumn("hit", F.lit(1)), ["query_id", "item"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    w = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    hit = hit.withColumn("precision", F.sum("hit").over(w) / F.col("rank"))
    five = F.col("rank") <= 5
    per = hit.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("hit"))).alias("p1"), F.sum(F.when(five, F.col("hit"))).alias("h5"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(five, F.col("hit") * F.col("precision"))).alias("ap"), F.count("*").alias("returned"))
    out = queries.select("query_id").join(n, "query_id", "left").join(per, "query_id", "left")
    some = F.col("n").isNotNull()
    zero = lambda c: F.when(some, F.coalesce(c, F.lit(0)).cast("double"))
    return out.select(
        "query_id", zero(F.col("p1")).alias("p_at_1"), (zero(F.col("h5")) / 5).alias("p_at_5"), (zero(F.col("h5")) / F.col("n")).alias("r_at_5"),
        zero(1 / F.col("first")).alias("reciprocal_rank"), (zero(F.col("ap")) / F.col("n")).alias("ap_at_5"), F.when(~some, F.coalesce(F.col("returned") > 0, F.lit(False))).alias("false_positive"))


def mean_metrics(per_query: DataFrame) -> DataFrame:
    """Means over queries; null where no query counts."""
    return per_query.agg(*[F.avg(c).alias(c) for c in ("p_at_1", "p_at_5", "r_at_5", "reciprocal_rank", "ap_at_5")], F.avg(F.col("false_positive").cast("double")).alias("false_positive_rate"))


#: By how much the search for a nearest row widens at a time, and how often before it spans everything.
WIDER, ROUNDS = 8, 3


def nearest_miss(unmatched: DataFrame, others: DataFrame, keys: list[str], by_end: bool = True) -> DataFrame:
    """For each unmatched row the other side's row with the least start (plus end) error; equal errors
    take the lowest id. ``id, start, end`` on both sides; ``error`` and ``other`` are null where a key has no
    other row or a row no times.

    The sum of both errors is the greater of the differences in (start + end) and in (start - end), so it is
    at most r only between neighbouring cells of a grid of width r. Rows whose best lies within r are
    done; the rest try a wider grid. Rows at equal times count once, so no round makes all pairs of a key."""
    at = [F.col("start") + F.col("end"), F.col("start") - F.col("end")] if by_end else [F.col("start")]
    axes = [f"__x{k}" for k in range(len(at))]
    placed = lambda df, *rest: df.select(*keys, *rest, *[x.cast("double").alias(a) for x, a in zip(at, axes, strict=True)]).where(" and ".join(f"{a} is not null" for a in axes))
    points, _ = counted(placed(others, "id").groupBy(*keys, *axes).agg(F.min("id").alias("other")))
    left, n_left = counted(placed(unmatched, "id"))
    ends = points.select(*axes).union(left.select(*axes)).agg(*[f(a) for a in axes for f in (F.min, F.max)]).first()
    extent = max([1e-9, *(high - low for low, high in zip(ends[::2], ends[1::2], strict=True) if low is not None)])
    cells = [f"__c{k}" for k in range(len(axes))]
    parts = []
    for k in range(ROUNDS, -1, -1):
        width = extent * (1 + 1e-9) / WIDER**k
        cell = lambda a: F.floor(F.col(a) / width).cast("long")  # noqa: E731, B023
        near = left
        for a, c in zip(axes, cells, strict=True):
            near = near.withColumn(c, F.explode(F.sequence(cell(a) - 1, cell(a) + 1)))
        grid = points.select(*keys, "other", *[F.col(a).alias(f"{a}o") for a in axes], *[cell(a).alias(c) for a, c in zip(axes, cells, strict=True)])
        error = F.greatest(*[F.abs(F.col(a) - F.col(f"{a}o")) for a in axes], F.lit(0.0))
        best = near.join(grid, [*keys, *cells]).groupBy(*keys, "id").agg(F.min(F.struct(error.alias("error"), "other")).alias("m")).where(F.col("m.error") <= width)
        done, _ = counted(best.select(*keys, "id", "m.error", "m.other"))
        parts.append(done)
        left, n_left = counted(left.join(done.select(*keys, "id"), [*keys, "id"], "left_anti"))
        if not n_left:
            break
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return unmatched.select(*keys, "id").join(found, [*keys, "id"], "left")


def paired_reduction(rows: DataFrame, keys: list[str], mode: str, measures: list[str], manual: str = "manual", assisted: str = "assisted") -> DataFrame:
    """Means of both modes over complete pairs, and the mean of ``1 - assisted / manual``, for each
    measure; rows of a key and mode are averaged first."""
    wide = rows.groupBy(*keys).pivot(mode, [manual, assisted]).agg(*[F.avg(m).alias(m) for m in measures])
    name = (lambda m, k: f"{m}_{k}" if len(measures) > 1 else m)
    out = []
    for k in measures:
        a, b = F.col(name(manual, k)), F.col(name(assisted, k))
        pair = wide.where(a.isNotNull() & b.isNotNull())
        out.append(pair.agg(F.lit(k).alias("measure"), F.count("*").alias("pairs"), F.avg(a).alias("manual"), F.avg(b).alias("assisted"), F.avg(F.when(a != 0, 1 - b / a)).alias("reduction")))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def paired_study(rows: DataFrame, keys: list[str], mode: str, measures: list[str], manual: str = "manual", assisted: str = "assisted") -> DataFrame:
    """``paired_reduction`` of recordings that come once for each key and mode, with ``unpaired``, the recordings
    outside complete pairs. A recording that comes twice is an error that names its key."""
    n = rows.groupBy(*keys, mode).agg(F.count("*").alias("n"), *[F.first(m).alias(m) for m in measures])
    told = F.concat(F.lit("recorded more than once: "), F.concat_ws(", ", *[F.col(c).cast("string") for c in (*keys, mode)]))
    once = n.withColumn("n", F.when(F.col("n") == 1, 1).otherwise(F.raise_error(told).cast("int")))
    pairs = once.groupBy(*keys).agg(F.count_if(F.col(mode).isin(manual, assisted)).alias("p"), F.sum("n").alias("n"))
    unpaired = pairs.agg(F.coalesce(F.sum(F.col("n") - F.when(F.col("p") == 2, 2).otherwise(0)), F.lit(0)).alias("unpaired"))
    return paired_reduction(once, keys, mode, measures, manual, assisted).crossJoin(F.broadcast(unpaired))  # one row


def threshold_sweep(candidates: DataFrame, thresholds: list[float], modes: list[str], kind: str = "kind") -> DataFrame:
    """For every mode (a score column) and threshold: selected, matched, precision, recall of all
    matches, mean temporal IoU. ``candidates(kind, matched boolean, tiou, <modes>)``."""
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    melted = candidates.select(kind, "matched", "tiou", F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("value")) for m in modes])).alias("s"))
    rows = melted.select(kind, "matched", "tiou", "s.mode", "s.value", grid).withColumn("on", F.col("value") >= F.col("threshold"))
    both = F.col("on") & F.col("matched")
    out = rows.groupBy("mode", "threshold", kind).agg(F.count_if("on").alias("selected"), F.count_if(both).alias("true"), F.count_if("matched").alias("all"), F.avg(F.when(both, F.col("tiou"))).alias("tiou"))
    return out.withColumn("precision", F.try_divide("true", "selected")).withColumn("recall", F.try_divide("true", "all")).drop("all")

