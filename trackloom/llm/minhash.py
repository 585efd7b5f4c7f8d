"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, components.

A document's set is its distinct word shingles. Signatures follow SuperMinHash (Ertl, 2017): each
element deals one random rank to every signature slot, the ranks of one element being correlated
through a random permutation, so signatures vary less than with independent hashes; an element
stops early once no slot can fall further. Work is vectorised over a block of documents and walks
the permutations step by step, which gives the same minima as element by element.

Equal sets are collapsed by a 128-bit digest before anything is compared, so copies cost one row.
Bands of the signatures give buckets. Each bucket first compares its members with one centre;
where that leaves a bucket in several components, every remaining pair across components is
compared. Counts of shingles by class bound what two sets can have in common; pairs that they rule
out are never fetched. So groups of near copies cost rows in proportion to their size, yet no candidate link is lost.
Links are confirmed on the full sets; a hot centre's comparisons are spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.words import blocks, mix, runs, word_hashes
from trackloom.plans.components import components
from trackloom.plans.durable import counted, durable
from trackloom.plans.hot_keys import attach

#: Bands and slots per band: a pair at similarity 0.85 escapes all 32 bands with chance 7e-9, at
#: 0.8 with 3e-6.
BANDS, ROWS = 32, 5
#: Elements whose permutations are held at a time, one byte a slot.
ELEMENTS = 100_000
#: Classes of shingles (by their hash) that are counted for each set: the counts bound from above what
#: two sets have in common.
CLASSES = 128
#: Documents whose ids are broadcast to pick texts for comparison; more are picked by a shuffle.
FEW = 100_000
#: Comparisons with one centre that share a task's group.
PER_SALT = 200
#: Members of a bucket in a slice; pairs of slices of a larger bucket are compared in tasks of their own.
SLICE = 500
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document index, 64-bit shingle hash), distinct and sorted. Fewer than ``k`` words give one
    shingle of them all; no words, none."""
    doc, h = word_hashes(data, offsets, lower=True)
    n_docs = len(offsets) - 1
    at = runs(doc, n_docs)
    count = np.diff(at)
    whole = np.ones(len(h), dtype=bool)
    total = np.zeros(len(h), dtype=np.uint64)
    for i in range(k):
        n = max(len(h) - i, 0)
        total[:n] = mix(total[:n] * np.uint64(31) + h[i:] + np.uint64(i + 1))
        total[n:] = mix(total[n:] * np.uint64(31) + np.uint64(7))
        whole[n:] = False
        if i:
            whole[:n] &= doc[i:] == doc[:n]
    total, sdoc = total[whole], doc[whole]
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        one = np.zeros(len(few), dtype=np.uint64)
        for i in range(k - 1):
            has = count[few] > i
            one[has] = mix(one[has] * np.uint64(37) + h[at[few[has]] + i] + np.uint64(i + 101))
        total, sdoc = np.concatenate([total, one]), np.concatenate([sdoc, few])
    order = np.argsort(total)
    small = np.uint16 if n_docs < 65536 else np.int64  # numpy sorts 16-bit keys by radix
    order = order[np.argsort(sdoc[order].astype(small), kind="stable")]
    total, sdoc = total[order], sdoc[order]
    new = np.ones(len(total), dtype=bool)
    new[1:] = (total[1:] != total[:-1]) | (sdoc[1:] != sdoc[:-1])
    return sdoc[new], total[new]


def digests(doc: np.ndarray, element: np.ndarray, n_docs: int) -> list[bytes | None]:
    """16 bytes for each document's set, from two sums that order doesn't touch; null if empty."""
    at = runs(doc, n_docs)
    sums = []
    for salt in (0x1234567, 0x89ABCDEF01):
        acc = np.zeros(len(element) + 1, dtype=np.uint64)
        np.cumsum(mix(element ^ np.uint64(salt)), out=acc[1:])
        sums.append(mix(acc[at[1:]] - acc[at[:-1]] + np.diff(at).astype(np.uint64)))
    both = np.stack(sums, axis=1)
    raw, full = both.tobytes(), np.diff(at) > 0
    return [raw[16 * i : 16 * i + 16] if full[i] else None for i in range(n_docs)]


def super_minhash(doc: np.ndarray, element: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Signatures, one row of ``m`` doubles for each document (infinite for an empty set).

    ``element``: distinct 64-bit hashes, grouped by ``doc``. Two sets agree in a slot with a
    probability that equals their Jaccard similarity.
    """
    out = np.full((n_docs, m), np.inf)
    flat = out.reshape(-1)
    live_doc, seed = doc, element
    deal = np.broadcast_to(np.arange(m, dtype=np.uint8), (len(seed), m)).copy()
    for j in range(m):
        if not len(seed):
            break
        random = mix(seed + np.uint64((j + 1) * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
        rank = (random >> np.uint64(32)).astype(np.float64) * 2.0**-32
        k = j + (((random & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
        row = np.arange(len(seed))
        slot = deal[row, k]
        deal[row, k] = deal[:, j]
        np.minimum.at(flat, live_doc * m + slot, rank + j)
        unfilled = out.max(axis=1) >= j + 1
        keep = unfilled[live_doc]
        if not keep.all():
            live_doc, seed, deal = live_doc[keep], seed[keep], deal[keep]
    return out


def _signature(doc: np.ndarray, element: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """``super_minhash``; the elements of one long text are taken in runs, whose minima are those of all."""
    if n_docs > 1 or len(element) <= ELEMENTS:
        return super_minhash(doc, element, n_docs, m)
    out = np.full((1, m), np.inf)
    for i in range(0, len(element), ELEMENTS):
        np.minimum(out, super_minhash(doc[i : i + ELEMENTS], element[i : i + ELEMENTS], 1, m), out=out)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each document and band."""
    raw = signature[:, : bands * rows].copy().view(np.uint64).reshape(len(signature), bands, rows)
    key = np.zeros(raw.shape[:2], dtype=np.uint64)
    for i in range(rows):
        key = mix(key * np.uint64(31) + raw[:, :, i])
    return key.view(np.int64)


def _sign(k: int, bands: int, rows: int, id_type: pa.DataType):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in blocks(batch.column("text")):
                doc, element = shingle_sets(data, offsets, k)
                n = end - first
                at = runs(doc, n)
                keys = np.empty((n, bands), dtype=np.int64)
                counts = np.bincount(doc * CLASSES + (element >> np.uint64(57)).astype(np.int64), minlength=n * CLASSES).reshape(n, CLASSES)
                held = np.minimum(counts, 32767).astype(np.int16)
                i = 0
                while i < n:  # runs of documents with few enough elements, or one
                    j = min(n, max(i + 1, int(np.searchsorted(at, at[i] + ELEMENTS, side="right")) - 1))
                    part = slice(at[i], at[j])
                    keys[i:j] = band_keys(_signature(doc[part] - i, element[part], j - i, bands * rows), bands, rows)
                    i = j
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, n).cast(id_type),
                        pa.array(np.diff(at)),
                        pa.array(digests(doc, element, n), pa.binary()),
                        pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * bands, pa.array(keys.reshape(-1))),
                        pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * CLASSES, pa.array(held.reshape(-1))),
                        pa.array(np.diff(at) - held.sum(axis=1)),
                    ],
                    names=["doc_id", "n_shingles", "set_id", "bands", "classes", "uncounted"],
                )

    return work


def _id_types(docs: DataFrame) -> tuple[str, pa.DataType]:
    """A binary doc_id stays what it is, others are 64-bit numbers."""
    return ("binary", pa.binary()) if docs.schema["doc_id"].dataType.typeName() == "binary" else ("long", pa.int64())


def signatures(docs: DataFrame, k: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_shingles, set_id, bands, classes, uncounted)``, one row per
    document; ``classes`` counts its shingles by class, ``uncounted`` those over a count's range."""
    named, id_type = _id_types(docs)
    return docs.select("doc_id", "text").mapInArrow(_sign(k, bands, rows, id_type), f"doc_id {named}, n_shingles long, set_id binary, bands array<long>, classes array<short>, uncounted long")


def _compare(k: int, id_type: pa.DataType):
    schema = pa.schema([("member", id_type), ("centre", id_type), ("member_set", pa.binary()), ("centre_set", pa.binary()), ("common", pa.int64()), ("either", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, centre, own = None, None, None
        for batch in batches:
            rows = {c: batch.column(c).to_pylist() for c in ("doc_id", "set_id", "centre_set", "salt", "member")}
            out: list[tuple] = []
            for first, end, data, offsets in blocks(batch.column("text")):
                doc, element = shingle_sets(data, offsets, k)
                at, ids = runs(doc, end - first), digests(doc, element, end - first)
                for i in range(end - first):
                    r = first + i
                    if ids[i] != rows["set_id"][r]:
                        continue  # another text under the same id
                    if group != (now := (rows["centre_set"][r], rows["salt"][r])):
                        group, centre = now, None
                    values = element[at[i] : at[i + 1]]
                    if not rows["member"][r]:
                        centre, own = values.copy(), rows["doc_id"][r]
                    elif centre is not None:
                        place = np.minimum(np.searchsorted(centre, values), len(centre) - 1)
                        common = int((centre[place] == values).sum())
                        out.append((rows["doc_id"][r], own, rows["set_id"][r], now[0], common, len(values) + len(centre) - common))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], schema[c].type) for c in range(6)], schema=schema)

    return work


def verify(docs: DataFrame, pairs: DataFrame, total: int, k: int) -> DataFrame:
    """Intersection and union of the full sets of ``pairs(member, member_set, centre, centre_set)``.

    A group is a centre with at most ``PER_SALT`` members or so; its rows stream through one task
    with the centre first, and only the centre's set is held.
    """
    degree, _ = counted(pairs.groupBy("centre_set").agg(F.count("*").alias("n")))
    salted = attach(pairs, degree, ["centre_set"], "n", total).withColumn("salts", F.ceil(F.col("n") / PER_SALT).cast("int"))
    members = salted.select(
        F.col("member").alias("doc_id"), F.col("member_set").alias("set_id"), "centre_set",
        F.expr("pmod(xxhash64(member_set), salts)").cast("int").alias("salt"), F.lit(True).alias("member"))
    centres = salted.groupBy("centre", "centre_set", "salts").agg(F.lit(1)).select(
        F.col("centre").alias("doc_id"), F.col("centre_set").alias("set_id"), "centre_set",
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("member"))
    named, id_type = _id_types(docs)
    wanted, n = counted(members.unionByName(centres))
    ids, texts = wanted.select("doc_id").distinct(), docs.select("doc_id", "text")
    if n <= FEW:
        texts = texts.join(F.broadcast(ids), "doc_id", "left_semi")
    return (
        texts.join(wanted.hint("shuffle_hash"), "doc_id")
        .repartition("centre_set", "salt").sortWithinPartitions("centre_set", "salt", "member")
        .mapInArrow(_compare(k, id_type), f"member {named}, centre {named}, member_set binary, centre_set binary, common long, either long")
        .distinct()
    )


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Near-duplicate groups of ``docs(doc_id, text, ...)``.

    Words are lower-cased (A-Z) runs of non-space bytes; two documents are linked if ``100 *
    intersection >= percent * union`` of their sets of ``k``-word shingles. Returns one row for
    each input row: ``doc_id, n_shingles, component_id, kept``. ``component_id`` is the smallest
    doc_id reachable over links, ``kept`` marks the row whose id that is.

    Null or empty texts have an empty set and are linked with nothing. A null doc_id can't be
    named as a group's member: such rows get a null component and are kept. Rows that repeat a
    doc_id are signed each by its own text, but links are between ids: all rows that carry the
    component's id are kept. Where each row counts, null and repeated ids included, pass a binary
    key of the row as ``doc_id`` (``corpus_pipeline.row_key``); keys order as unsigned bytes.
    Other columns of ``docs`` are not read.
    """
    signed = durable(signatures(docs, k, bands, rows))
    named = signed.where("doc_id is not null and set_id is not null")
    alike = [F.first(c).alias(c) for c in ("bands", "classes", "uncounted")]
    sets = durable(named.groupBy("set_id").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("size"), F.count("*").alias("copies"), *alike))
    total = sets.count() * bands
    spread = sets.select("set_id", F.posexplode("bands").alias("band", "key"))
    shared, _ = counted(spread.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"))
    members, _ = counted(attach(spread, shared, ["band", "key"], "n", total))
    members, _ = counted(_with_centres(members, total))
    pairs, n_pairs = counted(_may_link(members.where("set_id <> centre_set").select(F.col("set_id").alias("set1"), F.col("centre_set").alias("set2")).distinct(), sets, int(percent)))
    linked = F.expr(f"100 * common >= {int(percent)} * either")
    links = verify(docs, pairs, n_pairs, k).where(linked).select(F.col("member").alias("u"), F.col("centre").alias("v"))
    labels, _ = counted(components(links))
    rest, n_rest = counted(_open_pairs(members, sets, labels, int(percent)))
    if n_rest:
        more, n_more = counted(verify(docs, rest, n_rest, k).where(linked).select(F.col("member").alias("id"), F.col("centre").alias("to")))
        if n_more:
            labels = _joined(labels, more)
    return _labelled(signed, sets, labels)


def _with_centres(members: DataFrame, total: int) -> DataFrame:
    """Adds each bucket's centre: the member that shares most bucket places with others, which in a
    group of edited copies is the text they stem from, or what is nearest to it."""
    central = members.groupBy("set_id").agg(F.sum("n").alias("c"))
    found = members.join(central, "set_id").groupBy("band", "key").agg(F.max(F.struct("c", F.xxhash64("set_id").alias("h"), "set_id")).alias("m"), F.count("*").alias("n"))
    return attach(members.drop("n"), counted(found.select("band", "key", "n", F.col("m.set_id").alias("centre_set")))[0], ["band", "key"], "n", total)


def _possible(percent: int) -> str:
    """SQL: sizes and class counts of two sets allow a link. What two sets have in common is at most
    the sum over classes of the smaller count."""
    common = "(aggregate(zip_with(classes1, classes2, (x, y) -> int(least(x, y))), 0, (a, x) -> a + x) + least(uncounted1, uncounted2))"
    return f"100 * least(size1, size2) >= {percent} * greatest(size1, size2) and {100 + percent} * {common} >= {percent} * (size1 + size2)"


def _may_link(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs(set1, set2)`` those that the class counts leave open, as ``verify`` takes them."""
    told = ["id", "size", "classes", "uncounted"]
    side = lambda i: sets.select(F.col("set_id").alias(f"set{i}"), *[F.col(c).alias(f"{c}{i}") for c in told])
    pairs, total = counted(pairs)
    degree = pairs.groupBy("set2").agg(F.count("*").alias("n"))
    both = attach(pairs, counted(side(2).join(degree, "set2"))[0], ["set2"], "n", total).join(side(1), "set1")
    return both.where(_possible(percent)).select(F.col("id1").alias("member"), F.col("set1").alias("member_set"), F.col("id2").alias("centre"), F.col("set2").alias("centre_set"))


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after further ``links(id, to)``: the components that they connect become one."""
    left = links.join(labels.withColumnRenamed("component", "u"), "id", "left").withColumn("u", F.coalesce("u", "id"))
    both = left.join(labels.toDF("to", "v"), "to", "left").withColumn("v", F.coalesce("v", "to"))
    merged = counted(components(both.select("u", "v")))[0].toDF("component", "least")
    alone = links.select("id").union(links.select("to")).distinct().join(labels, "id", "left_anti").withColumn("component", F.col("id"))
    named = labels.select("id", "component").union(alone)
    return named.join(merged, "component", "left").select("id", F.coalesce("least", "component").alias("component"))


def _open_pairs(members: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of one bucket that lie in different components after the comparisons with centres,
    one end outside the centre's own, each pair in the first bucket that it shares; without those
    that the class counts rule out."""
    told = sets.join(labels.withColumnRenamed("component", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    labelled = members.where("n > 2").join(told.select("set_id", "id", "label"), "set_id")
    mixed = labelled.groupBy("band", "key").agg(
        F.min("label").alias("a"), F.max("label").alias("b"), F.max(F.expr("if(set_id = centre_set, label, null)")).alias("main"), F.first("n").alias("n"))
    mixed, _ = counted(mixed.where("a <> b").select("band", "key", "main", "n"))
    own = ["id", "set_id", "size", "label", "classes", "uncounted", "bands"]
    labelled, total = counted(labelled.where("set_id <> centre_set").select("set_id", "id", "label", "band", "key"))
    found, _ = counted(attach(labelled, mixed, ["band", "key"], "n", max(total, 1)))
    found, _ = counted(found.join(sets.select("set_id", "size", "classes", "uncounted", "bands"), "set_id"))
    # Slices of a bucket: each left slice meets each right one under a key of its own.
    slices = F.ceil(F.col("n") / SLICE).cast("int")
    sliced = found.withColumn("slice", F.pmod(F.xxhash64("set_id"), slices).cast("int")).withColumn("every", F.sequence(F.lit(0), slices - 1))
    left = sliced.where("label <> main").select("band", "key", "main", F.col("slice").alias("i"), F.explode("every").alias("j"), *[F.col(c).alias(f"{c}1") for c in own])
    right = sliced.select("band", "key", F.explode("every").alias("i"), F.col("slice").alias("j"), *[F.col(c).alias(f"{c}2") for c in own])
    # Of two outside the centre's component each pair comes once.
    near = left.join(right, ["band", "key", "i", "j"]).where(
        "label1 <> label2 and (label2 = main or set_id1 < set_id2)"
        " and not exists(arrays_zip(slice(bands1, 1, band), slice(bands2, 1, band)), x -> x['0'] = x['1'])"
        f" and {_possible(percent)}")
    return near.select(F.col("id1").alias("member"), F.col("set_id1").alias("member_set"), F.col("id2").alias("centre"), F.col("set_id2").alias("centre_set"))


def _labelled(signed: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    placed = sets.join(labels, "id", "left").select("set_id", "copies", F.coalesce("component", "id").alias("component_id"))
    grouped = signed.where("doc_id is not null and set_id is not null").select("doc_id", "n_shingles", "set_id")
    grouped = attach(grouped, placed, ["set_id"], "copies", signed.count()).select("doc_id", "n_shingles", "component_id")
    alone = signed.where("doc_id is null or set_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return grouped.unionByName(alone).withColumn("kept", F.coalesce(F.expr("doc_id = component_id"), F.lit(True)))
