"""Events with their evidence: star joins, timelines, chain integrity, graphs, associations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions.geometry import dot
from trackloom.operators.search import top


def serialised(events: DataFrame, evidence: DataFrame, videos: DataFrame, cameras: DataFrame, locations: DataFrame, members: DataFrame) -> DataFrame:
    """One row for each event with its evidence, video, camera and location, and its entities as an
    array: the primary one first, then by id. ``events(event_id, evidence_id, camera_id, ...)``,
    ``evidence(evidence_id, video_id, primary_id, ...)``, ``members(event_id, entity_id)``. An event
    stays where one of its other rows is missing; their columns are null then."""
    star = events.join(evidence, "evidence_id", "left").join(videos, "video_id", "left").join(cameras, "camera_id", "left").join(locations, "location_id", "left")
    ranked = members.join(star.select("event_id", "primary_id"), "event_id")
    first = F.struct((~F.col("entity_id").eqNullSafe(F.col("primary_id"))).alias("other"), "entity_id")
    lists = ranked.groupBy("event_id").agg(F.array_sort(F.collect_list(first)).alias("e")).select("event_id", F.transform("e", lambda x: x.getField("entity_id")).alias("entities"))
    return star.join(lists, "event_id", "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<long>")))


def timeline(events: DataFrame, members: DataFrame, entity: str = "entity_id", start: str = "start") -> DataFrame:
    """Each entity's events in order, with the seconds since the one before."""
    w = W.partitionBy(entity).orderBy(start, "event_id")
    joined = members.join(events, "event_id")
    return joined.withColumn("place", F.row_number().over(w).cast("long")).withColumn("since", F.col(start) - F.lag(start).over(w))


def signature(frame_end: Column, frame_start: Column, method: Column, source: Column, video: Column) -> Column:
    """SHA-256 of the provenance as JSON with sorted keys and Python's separators."""
    text = F.concat(
        F.lit('{"frame_end": '), frame_end.cast("string"), F.lit(', "frame_start": '), frame_start.cast("string"), F.lit(', "method": "'), method,
        F.lit('", "source_sha256": "'), source, F.lit('", "video": "'), video.cast("string"), F.lit('"}'))
    return F.sha2(text, 256)


def failed_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds ``errors``: names of the rules (true = holds) that a row breaks; null counts as broken."""
    return df.withColumn("errors", F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])))


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all rules, rows that don't with ``errors``)."""
    checked = failed_rules(df, rules)
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def _clock(t: str) -> Column:
    """Microseconds of a video's second."""
    return F.unix_micros("vi_start") + F.round(F.col(t) * 1e6).cast("long")


def _digest(sha256: Column) -> Column:
    """The 32 bytes of a SHA-256 in lower-case hex; null for any other string, which no signature equals."""
    return F.when(sha256.rlike("^[0-9a-f]{64}\\z"), F.unhex(sha256))


def chain_rules(fps: Column) -> dict[str, Column]:
    """Conditions on an event joined (left) with its evidence, observation, track, video and participants:
    columns ``event_id, start_ts, end_ts, evidence_id, ev_*, ob_*, tr_*, vi_*, refs``."""
    c = F.col
    near = lambda frame, t: F.abs(frame / fps - t) <= 1 / fps + 1e-6
    return {
        "evidence": c("ev_id").isNotNull(), "observation": c("ob_id").isNotNull(), "track": c("tr_id").isNotNull(), "video": c("vi_id").isNotNull(), "method": F.length("ev_method") > 0,
        "signature": c("ev_sha256") == signature(c("ev_f1"), c("ev_f0"), c("ev_method"), c("vi_sha256"), c("ev_video")),
        "same_video": c("ob_video") == c("ev_video"), "track_video": c("tr_video") == c("ev_video"), "frames_ordered": c("ev_f0") <= c("ev_f1"),
        "frames_inside": (c("ev_f0") >= 0) & (c("ev_f1") < c("vi_frames")), "times_inside": (c("ev_t0") >= 0) & (c("ev_t0") <= c("ev_t1")) & (c("ev_t1") <= c("vi_duration")),
        "start_agrees": near(c("ev_f0"), c("ev_t0")), "end_agrees": near(c("ev_f1"), c("ev_t1")), "start_clock": F.unix_micros("start_ts") == _clock("ev_t0"), "end_clock": F.unix_micros("end_ts") == _clock("ev_t1"),
        "camera": c("camera_id") == c("vi_camera"), "participants": c("refs") > 0, "participants_agree": c("disagree") == 0,
    }


def integrity(events: DataFrame, evidence: DataFrame, observations: DataFrame, tracks: DataFrame, videos: DataFrame, members: DataFrame) -> DataFrame:
    """Every event with the names of the chain conditions it breaks.

    ``events(event_id, evidence_id, camera_id, start_ts, end_ts)``, ``evidence(ev_id, ev_video, ev_observation,
    ev_f0, ev_f1, ev_t0, ev_t1, ev_sha256, ev_method)``, ``observations(ob_id, ob_track, ob_video, ob_entity)``,
    ``tracks(tr_id, tr_video, tr_entity)``, ``videos(vi_id, vi_camera, vi_fps, vi_frames, vi_duration, vi_start,
    vi_sha256)``, ``members(event_id, entity_id)``. Participants are observed in the evidence's video, on
    tracks of their own."""
    # What depends on evidence, video, observation and track alone is judged where they meet, so hashes go through one join.
    rules = chain_rules(F.col("vi_fps"))
    own = evidence.withColumn("__sha", _digest(F.col("ev_sha256"))).drop("ev_sha256").join(videos, F.col("ev_video") == F.col("vi_id"), "left")
    rules["signature"] = F.col("__sha") == _digest(signature(F.col("ev_f1"), F.col("ev_f0"), F.col("ev_method"), F.col("vi_sha256"), F.col("ev_video")))
    by_video, by_track = ("video", "method", "signature", "frames_ordered", "frames_inside", "times_inside", "start_agrees", "end_agrees"), ("observation", "track", "same_video", "track_video")
    judged = lambda names: [F.coalesce(rules[n], F.lit(False)).alias(f"__{n}") for n in names]
    own = own.select("ev_id", "ev_video", "ev_observation", "vi_camera", _clock("ev_t0").alias("__start"), _clock("ev_t1").alias("__end"), *judged(by_video))
    watched = observations.drop("ob_entity").join(tracks.drop("tr_entity"), F.col("ob_track") == F.col("tr_id"), "left")
    own = own.join(watched, F.col("ev_observation") == F.col("ob_id"), "left").select("ev_id", "vi_camera", "__start", "__end", *[f"__{n}" for n in by_video], *judged(by_track))
    chain = events.join(own, F.col("evidence_id") == F.col("ev_id"), "left")
    rules |= {n: F.col(f"__{n}") for n in (*by_video, *by_track)}
    rules |= {"start_clock": F.unix_micros("start_ts") == F.col("__start"), "end_clock": F.unix_micros("end_ts") == F.col("__end")}
    own = tracks.select(F.col("tr_id").alias("__track"), F.col("tr_entity").alias("__entity"))
    seen = observations.select(F.col("ob_entity").alias("entity_id"), F.col("ob_video").alias("__video"), F.col("ob_track").alias("__track")).join(own, "__track", "left")
    disagree = ~F.col("__entity").eqNullSafe(F.col("entity_id"))
    seen = seen.groupBy("entity_id", "__video").agg(F.count("*").alias("__n"), F.count_if(disagree).alias("__bad"))  # observations don't meet events one by one
    theirs = events.join(evidence, F.col("evidence_id") == F.col("ev_id")).select("event_id", F.col("ev_video").alias("__video")).join(members, "event_id").join(seen, ["entity_id", "__video"])
    refs = theirs.groupBy("event_id").agg(F.sum("__n").alias("refs"), F.sum("__bad").alias("disagree"))
    return failed_rules(chain.join(refs, "event_id", "left"), rules).select("event_id", "errors")


#: Rows of a stated query set in a tile, and of the rows that they meet.
ASKED, HELD = 1_000, 20_000


def tiled(asked: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """All pairs of ``asked`` with ``held`` of equal ``keys``, tile by tile: both are dealt into tiles by their
    rows' hashes, and each copy of a tile meets one tile of the other side, so neither a large query set nor a
    frequent key fills a task. Other columns have different names on both sides."""
    a, h = 1 + asked.count() // ASKED, 1 + held.count() // HELD
    deal = lambda df, n: F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("__asked", deal(asked, a)).withColumn("__held", every(h))
    right = held.withColumn("__held", deal(held, h)).withColumn("__asked", every(a))
    return right.join(left.hint("shuffle_hash"), [*keys, "__asked", "__held"]).drop("__asked", "__held")


def associations(sources: DataFrame, entities: DataFrame, links: DataFrame, keep: float = 0.4, medium: float = 0.7, margin: float = 0.08) -> DataFrame:
    """Candidates in other cameras for each of a stated set of ``sources``, which meet entities in tiles.

    Both tables: ``id, camera, kind, colour, start, end, vector`` (unit length). Kind must be equal.
    ``links(camera, other, min_s, max_s)``: how long the way between cameras takes. ``score = 0.5 *
    max(0, cosine) + 0.2 * same known colour + 0.3 * compatible``. Rejected if the time between them
    fits no link or the cosine is below ``keep``; medium from ``medium`` on, else ambiguous; where the
    first two that aren't rejected differ by less than ``margin``, all so close to the first are
    ambiguous.
    """
    named = lambda df, side: df.select("kind", *[F.col(c).alias(f"{side}_{c}") for c in ("id", "camera", "colour", "start", "end", "vector")])
    s, e = ({c: F.col(f"{side}_{c}") for c in ("id", "camera", "colour", "start", "end", "vector")} for side in "se")
    pairs = tiled(named(sources, "s"), named(entities, "e"), ["kind"]).where(s["camera"] != e["camera"])
    gap = F.greatest(e["start"] - s["end"], s["start"] - e["end"])
    pairs = pairs.join(links.alias("l"), (F.col("l.camera") == s["camera"]) & (F.col("l.other") == e["camera"]), "left")
    fits = F.coalesce((gap >= F.col("l.min_s")) & (gap <= F.col("l.max_s")), F.lit(False))
    like = F.greatest(F.lit(0.0), dot(s["vector"], e["vector"]))
    same = F.coalesce((s["colour"] == e["colour"]) & (s["colour"] != "unknown"), F.lit(False))
    score = 0.5 * like + 0.2 * same.cast("double") + 0.3 * fits.cast("double")
    found = pairs.select(s["id"].alias("source"), e["id"].alias("candidate"), gap.alias("gap"), fits.alias("compatible"), like.alias("cosine"), score.alias("score"))
    found = found.withColumn("rejected", ~F.col("compatible") | (F.col("cosine") < keep))
    w = W.partitionBy("source")
    order = w.orderBy(F.when(F.col("rejected"), None).otherwise(-F.col("score")).asc_nulls_last(), "candidate")
    found = found.withColumn("best", F.max(F.when(~F.col("rejected"), F.col("score"))).over(w)).withColumn("place", F.row_number().over(order))
    found = found.withColumn("second", F.max(F.when((F.col("place") == 2) & ~F.col("rejected"), F.col("score"))).over(w))
    close = F.coalesce((F.col("best") - F.col("second") < margin) & (F.col("best") - F.col("score") < margin), F.lit(False))
    label = F.when(F.col("rejected"), "rejected").when(close | (F.col("score") < medium), "ambiguous").otherwise("medium")
    return found.select("source", "candidate", "gap", "compatible", "cosine", "score", label.alias("label"))


def vector_search(queries: DataFrame, vectors: DataFrame, least: float = 0.45, limit: int = 30) -> DataFrame:
    """The nearest vectors of each of a stated set of queries, by cosine of unit vectors of the same model; both
    meet in tiles. ``queries(query_id, model, vector)``, ``vectors(vec_id, model, vector)``."""
    return top(_alike(queries, vectors, least), "query_id", limit, F.desc("cosine"), F.col("vec_id"))


def _alike(queries: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    pairs = tiled(queries.select("query_id", "model", F.col("vector").alias("asked")), vectors.select("vec_id", "model", "vector"), ["model"])
    return pairs.withColumn("cosine", dot(F.col("vector"), F.col("asked"))).where(F.col("cosine") >= least).select("query_id", "vec_id", "cosine")


def appearance_search(queries: DataFrame, vectors: DataFrame, evidence: DataFrame, events: DataFrame, least: float = 0.45, limit: int = 30) -> DataFrame:
    """Events that look like each of a stated set of queries: ``query_id, event_id, score, rank, total``.

    A vector of at least ``least`` cosine stands for the first event by start (then id) of its observation;
    vectors without one are left out. ``score`` is rounded to 4 places and ranks, then vec_id; ``total`` counts
    before the ``limit``. ``vectors(vec_id, model, vector, observation_id)``, ``evidence(evidence_id,
    observation_id)``, ``events(event_id, evidence_id, start)``."""
    first = events.join(evidence, "evidence_id").groupBy("observation_id").agg(F.min(F.struct("start", "event_id")).alias("e")).select("observation_id", "e.event_id")
    shown = vectors.join(first, "observation_id")
    scored = _alike(queries, shown, least).join(shown.select("vec_id", "event_id"), "vec_id").withColumn("score", F.round("cosine", 4))
    totals = scored.groupBy("query_id").agg(F.count("*").alias("total"))
    best = top(scored, "query_id", limit, F.desc("score"), F.col("vec_id"))
    return best.join(totals, "query_id").select("query_id", "event_id", "score", "rank", "total")


def graph(nodes: dict[str, DataFrame], edges: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(id, kind, label)`` and edges ``(source, target, relation)`` from tables of ``(id,
    label)`` by kind and ``(source, target)`` by relation; ids become ``kind:id`` beforehand."""
    n = [df.select(F.concat(F.lit(kind + ":"), F.col("id").cast("string")).alias("id"), F.lit(kind).alias("kind"), "label") for kind, df in nodes.items()]
    e = [df.select("source", "target", F.lit(name).alias("relation")) for name, df in edges.items()]
    both = [n[0], e[0]]
    for i, more in enumerate((n[1:], e[1:])):
        for df in more:
            both[i] = both[i].unionByName(df)
    return both[0], both[1]


def evidence_graph(entities: DataFrame, events: DataFrame, members: DataFrame, cameras: DataFrame, locations: DataFrame, relationships: DataFrame, first: int | None = 200, event_id: object = None) -> tuple[DataFrame, DataFrame]:
    """The graph of recorded evidence: nodes ``id, label, kind, category, camera_id`` and edges ``source, target,
    label, category, evidence_id, event_id``.

    Nodes are all entities, cameras and locations, and the ``first`` events by start (``None``: all) or the one
    named. Edges: cameras located at their location, entities observed at their camera, entities of the shown
    events, and stored relationships with the event of their evidence (of several, the last by id) — all, or
    those of the named event's evidence. ``entities(id, object_type, camera_id)``, ``events(id, title,
    event_type, category, camera_id, evidence_id, start)``, ``members(event_id, entity_id)``, ``cameras(id,
    name, location_id)``, ``locations(id, name)``, ``relationships(source_id, target_id, relation, category,
    evidence_id)``; ids are strings."""
    shown = events.where(F.col("id") == F.lit(event_id)) if event_id is not None else events
    if event_id is None and first is not None:
        shown = shown.orderBy("start", "id").limit(first)
    seen, none = F.lit("OBSERVED"), F.lit(None).cast("string")
    nodes = (
        entities.select("id", F.col("id").alias("label"), F.col("object_type").alias("kind"), seen.alias("category"), "camera_id")
        .union(cameras.select("id", "name", F.lit("camera"), seen, "id")).union(locations.select("id", "name", F.lit("location"), seen, F.lit("")))
        .union(shown.select("id", "title", F.lit("event"), "category", "camera_id")))
    told = relationships
    if event_id is not None:
        told = told.join(shown.select("evidence_id").distinct(), "evidence_id", "left_semi")
    of = events.groupBy("evidence_id").agg(F.max("id").alias("event_id"))
    edges = (
        cameras.select(F.col("id").alias("source"), F.col("location_id").alias("target"), F.lit("located_at").alias("label"), seen.alias("category"), none.alias("evidence_id"), none.alias("event_id"))
        .union(entities.select("id", "camera_id", F.lit("observed_at"), seen, none, none))
        .union(members.join(shown.withColumnRenamed("id", "event_id"), "event_id").select("entity_id", "event_id", "event_type", "category", "evidence_id", none))
        .union(told.join(of, "evidence_id", "left").select("source_id", "target_id", "relation", "category", "evidence_id", "event_id")))
    return nodes, edges


def neighbourhood(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is shown around each of ``ids(id)`` of an ``evidence_graph``: ``id, event, other``, its events and the
    other ends of edges into them (null where an event has no other), and its direct edges, those with an
    event, as ``id`` and the columns of ``edges``."""
    events = nodes.where("kind = 'event'").select(F.col("id").alias("event"))
    into = edges.select("source", F.col("target").alias("event")).join(events, "event", "left_semi").distinct()
    own = into.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").withColumnRenamed("source", "id")
    known = into.join(nodes.select(F.col("id").alias("source")).distinct(), "source", "left_semi").withColumnRenamed("source", "other")
    around = own.join(known, "event").where("other <> id").select("id", "event", "other")
    alone = own.join(around.select("id", "event").distinct(), ["id", "event"], "left_anti").select("id", "event", F.lit(None).cast("string").alias("other"))
    both = F.explode(F.array_distinct(F.array("source", "target"))).alias("id")
    direct = edges.where("event_id is not null").select(both, *edges.columns).join(ids, "id", "left_semi")
    return around.union(alone), direct


def relationships_of(edges: DataFrame, associated: DataFrame, ids: DataFrame) -> DataFrame:
    """Stored relationships with an end in ``ids(id)`` and the associations found for them: ``id, other, relation,
    category, score``. ``edges(source, target, label, category)``; ``associated`` as ``associations`` gives it."""
    end = F.explode(F.array_distinct(F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("other")), F.struct(F.col("target").alias("id"), F.col("source").alias("other"))))).alias("e")
    stored = edges.select(end, "label", "category").select("e.id", "e.other", F.col("label").alias("relation"), "category", F.lit(None).cast("double").alias("score"))
    found = associated.where("label <> 'rejected'").select(F.col("source").cast("string").alias("id"), F.col("candidate").cast("string").alias("other"), F.lit("association").alias("relation"), F.upper("label").alias("category"), "score")
    return stored.unionByName(found).join(ids, "id", "left_semi")


def neighbours(members: DataFrame, entity: str = "entity_id", event: str = "event_id") -> DataFrame:
    """Pairs of entities that share an event, with how many they share (each pair once)."""
    once = members.select(event, entity).distinct()
    a, b = once.select(F.col(event), F.col(entity).alias("a")), once.select(F.col(event), F.col(entity).alias("b"))
    return a.join(b, event).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end in ``ids(id)``."""
    hit = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").unionByName(edges.join(ids.withColumnRenamed("id", "target"), "target", "left_semi"))
    return hit.distinct()
