"""Structured Streaming forms of the track operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def track_segments(boxes: DataFrame, gap_seconds: int, late_seconds: int, keys: list[str] = ["video_id", "track"]) -> DataFrame:
    """Segments of each track on a stream of boxes with a timestamp ``ts``: rows at most
    ``gap_seconds`` apart belong together. Rows behind the watermark are dropped. Works on a batch
    table too."""
    # A session reaches from its first row to a gap after its last; rows one gap apart stay together.
    window = F.session_window("ts", f"{int(gap_seconds)} seconds 1 microsecond")
    return boxes.withWatermark("ts", f"{int(late_seconds)} seconds").groupBy(*keys, window.alias("w")).agg(
        F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("end")).drop("w")


def zone_alerts(samples: DataFrame, inside: str = "inside", keys: list[str] = ["video_id", "track"], keep_minutes: int = 60) -> DataFrame:
    """``entered_zone`` and ``exited_zone`` on a stream of samples ``(keys, ts, inside)``: one flag of
    state a track, forgotten after ``keep_minutes`` without a sample. Rows of a trigger are taken in
    order of time."""
    schema = ", ".join(f"`{k}` {samples.schema[k].dataType.simpleString()}" for k in keys) + ", kind string, ts timestamp"

    def work(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values("ts")
        was = state.get[0] if state.exists else None
        out = []
        for ts, now in zip(rows["ts"], rows[inside], strict=True):
            if was is not None and bool(now) != was:
                out.append((*key, "entered_zone" if now else "exited_zone", ts))
            was = bool(now)
        state.update((was,))
        state.setTimeoutDuration(keep_minutes * 60_000)
        yield pd.DataFrame(out, columns=[*keys, "kind", "ts"])

    return samples.select(*keys, "ts", inside).groupBy(*keys).applyInPandasWithState(work, schema, "was boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def contact_candidates(observations: DataFrame, threshold: float = 0.45, max_gap: float = 0.6, persist: float = 0.5, late_seconds: float = 5.0, keys: list[str] = ["video_id", "person"]) -> DataFrame:
    """Finished contact runs of ``persist`` seconds on a stream ``(keys, ts, probability)``: the open run
    (start, end, rows, summed probability) is the state, one of each person. A run ends with an
    observation below the threshold, after a gap, or when the watermark has passed its end by the gap;
    then the person's state is forgotten. Rows behind the watermark are dropped."""
    schema = ", ".join(f"`{k}` {observations.schema[k].dataType.simpleString()}" for k in keys) + ", start timestamp, end timestamp, n long, mean_probability double"
    columns = [*keys, "start", "end", "n", "mean_probability"]

    def finished(key: tuple, start: int, end: int, n: int, total: float) -> list[tuple]:
        return [(*key, pd.Timestamp(start, unit="us"), pd.Timestamp(end, unit="us"), n, total / n)] if n >= 2 and (end - start) / 1e6 >= persist else []

    def work(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, end, n, total = state.get if state.exists else (0, 0, 0, 0.0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame(finished(key, start, end, n, total), columns=columns)
            return
        out = []
        rows = pd.concat(list(parts)).sort_values("ts")
        for ts, p in zip(rows["ts"], rows["probability"], strict=True):
            now = ts.value // 1000
            if n and (p < threshold or (now - end) / 1e6 > max_gap):
                out += finished(key, start, end, n, total)
                n = 0
            if p >= threshold:
                start, total = (start, total + p) if n else (now, p)
                end, n = now, n + 1
        if n:
            state.update((start, end, n, total))
            state.setTimeoutTimestamp(max(int(end / 1000 + max_gap * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=columns)

    timed = observations.select(*keys, "ts", "probability").withWatermark("ts", f"{late_seconds} seconds")
    return timed.groupBy(*keys).applyInPandasWithState(work, schema, "start long, end long, n long, total double", "append", GroupStateTimeout.EventTimeTimeout)


def linked_boxes(detections: DataFrame, max_gap: float = 1.1, reach: float = 1.0, late_seconds: float = 5.0, keys: list[str] = ["video_id", "kind"]) -> DataFrame:
    """Boxes of a stream ``(keys, id, ts, x1, y1, x2, y2)`` with their ``track``, the id of its first box: box by
    box in order of time and id, the nearest open track of the class (``reach`` heights away at most) that
    no box of the same time has taken, else a new one.

    The state of a video and class is the last box of each track still open: those of the last ``max_gap``
    seconds. It is forgotten when the watermark has passed them; rows behind it are dropped."""
    schema = ", ".join(f"`{k}` {detections.schema[k].dataType.simpleString()}" for k in keys) + ", id long, ts timestamp, track long"

    def work(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ends = dict(zip(state.get[0], zip(*state.get[1:], strict=True), strict=True)) if state.exists else {}  # track -> (time, middle x, middle y, height)
        rows = pd.concat(list(parts)).sort_values(["ts", "id"])
        out, now = [], 0
        for r in rows.itertuples():
            now = r.ts.value // 1000
            ends = {k: e for k, e in ends.items() if (now - e[0]) / 1e6 <= max_gap}
            x, y, high = (r.x1 + r.x2) / 2, (r.y1 + r.y2) / 2, r.y2 - r.y1
            near = min(((((x - e[1]) ** 2 + (y - e[2]) ** 2) ** 0.5 / max(1.0, high, e[3]), k) for k, e in ends.items() if e[0] < now), default=(reach + 1, None))
            track = near[1] if near[0] <= reach else r.id
            ends[track] = (now, x, y, high)
            out.append((*key, r.id, r.ts, track))
        columns = list(zip(*ends.values(), strict=True))
        state.update((list(ends), *[list(c) for c in columns]))
        state.setTimeoutTimestamp(max(int(now / 1000 + max_gap * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[*keys, "id", "ts", "track"])

    timed = detections.select(*keys, "id", "ts", "x1", "y1", "x2", "y2").withWatermark("ts", f"{late_seconds} seconds")
    held = "track array<long>, at array<long>, x array<double>, y array<double>, high array<double>"
    return timed.groupBy(*keys).applyInPandasWithState(work, schema, held, "append", GroupStateTimeout.EventTimeTimeout)
