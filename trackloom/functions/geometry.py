"""Column functions on boxes ``(x1, y1, x2, y2)`` and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    """The four coordinate columns, e.g. ``p_x1 ... p_y2`` for the prefix ``p_``."""
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def box_of(array: Column) -> Box:
    """Coordinates of an ``array<double>`` box."""
    return tuple(array[i] for i in range(4))


def centre(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def width(b: Box) -> Column:
    return F.greatest(F.lit(1.0), b[2] - b[0])


def height(b: Box) -> Column:
    return F.greatest(F.lit(1.0), b[3] - b[1])


def aspect(b: Box) -> Column:
    return width(b) / height(b)


def _shared(a: Box, b: Box) -> Column:
    wide = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    return wide * F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def iou(a: Box, b: Box, kind: str = "union_floor") -> Column:
    """Intersection over union. ``union_floor``: the union is at least 1. ``area_zero``: areas are at
    least 0, and 0 over no union. ``area_one``: areas are at least 1, the union has no floor."""
    shared = _shared(a, b)
    one, two = ((x[2] - x[0]) * (x[3] - x[1]) for x in (a, b))
    if kind == "union_floor":
        return shared / F.greatest(F.lit(1.0), one + two - shared)
    low = F.lit(0.0 if kind == "area_zero" else 1.0)
    union = F.greatest(low, one) + F.greatest(low, two) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def distance(a: Box, b: Box, scale: Column) -> Column:
    """Between the centres, in units of ``scale`` (at least 1)."""
    (ax, ay), (bx, by) = centre(a), centre(b)
    return F.hypot(bx - ax, by - ay) / F.greatest(F.lit(1.0), scale)


def speed(before: Box, after: Box, scale: Column, seconds: Column) -> Column:
    """Normalised speed of the centre; a step takes at least a hundredth of a second."""
    return distance(before, after, scale) / F.greatest(F.lit(0.01), seconds)


def temporal_iou(a: Column, b: Column, c: Column, d: Column, same_start: bool = True) -> Column:
    """Overlap over union of ``[a, b]`` and ``[c, d]``. Without a union, 1 for equal starts, else 0
    (always 0 if not ``same_start``)."""
    union = F.greatest(b, d) - F.least(a, c)
    shared = F.greatest(F.lit(0.0), F.least(b, d) - F.greatest(a, c))
    empty = F.when(a == c, F.lit(1.0)).otherwise(F.lit(0.0)) if same_start else F.lit(0.0)
    return F.when(union > 0, shared / union).when(union == 0, empty).otherwise(F.lit(0.0))  # less than 0: both are reversed


def endpoint_errors(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    return F.abs(a - c), F.abs(b - d)


def absolute_time(recording_start: Column, seconds: Column) -> Column:
    return recording_start + F.make_dt_interval(secs=seconds)


def source_frame(seconds: Column, fps: Column, frame_count: Column) -> Column:
    """Nearest frame, half to even, inside the recording."""
    return F.least(frame_count - 1, F.greatest(F.lit(0), F.rint(seconds * fps).cast("int")))


def sample_grid(first: Column, last: Column, fps: Column, target: Column) -> Column:
    """Frames ``rint(n * fps / target)`` between two frames, both included."""
    n = F.ceil((last + 1) * target / fps).cast("int") + 1
    frames = F.transform(F.sequence(F.lit(0), n), lambda i: F.rint(i * fps / target).cast("int"))
    return F.array_distinct(F.filter(frames, lambda f: (f >= first) & (f <= last)))


def expected_samples(frame_count: Column, fps: Column, target: Column) -> Column:
    """How many frames every ``rint(fps / target)`` frames there are."""
    step = F.greatest(F.lit(1), F.rint(fps / target).cast("int"))
    return F.ceil(frame_count / step).cast("int")


def person_region(b: Box, strategy: str, factor: float = 1.25) -> tuple[Column, Column, Column, Column]:
    """Part of a person's box to look into, in whole pixels: ``full_person``, ``upper_body`` (65 % of the height),
    ``expanded`` (about its centre by ``factor``) or ``interaction_region`` (1.3 widths, 30 to 85 % of the
    height). Widths and heights are at least 1; numbers are cut towards 0."""
    x1, y1, x2, y2 = b
    w, h = F.greatest(F.lit(1), x2 - x1), F.greatest(F.lit(1), y2 - y1)
    cx, cy = (x1 + x2) / 2, (y1 + y2) / 2
    if strategy == "full_person":
        region = b
    elif strategy == "upper_body":
        region = x1, y1, x2, y1 + 0.65 * h
    elif strategy == "expanded":
        region = cx - w * factor / 2, cy - h * factor / 2, cx + w * factor / 2, cy + h * factor / 2
    elif strategy == "interaction_region":
        region = cx - w * 1.3 / 2, y1 + 0.3 * h, cx + w * 1.3 / 2, y1 + 0.85 * h
    else:
        raise ValueError(f"unknown strategy {strategy}")
    return tuple(c.cast("int") for c in region)


def region_in_frame(b: Box, frame_width: Column, frame_height: Column) -> tuple[Column, Column, Column, Column]:
    """A person's region cut at the frame: its lower corner not below 0, its upper one not beyond the frame."""
    low = lambda v: F.greatest(F.lit(0), v.cast("int"))
    return low(b[0]), low(b[1]), F.least(frame_width.cast("int"), b[2].cast("int")), F.least(frame_height.cast("int"), b[3].cast("int"))


def inside_frame(b: Box, frame_width: Column, frame_height: Column) -> tuple[Column, Column, Column, Column]:
    """Whole pixels inside the frame."""
    def cut(v: Column, top: Column) -> Column:
        return F.least(top.cast("int"), F.greatest(F.lit(0), v.cast("int")))

    return cut(b[0], frame_width), cut(b[1], frame_height), cut(b[2], frame_width), cut(b[3], frame_height)


def foot_in_zone(b: Box, frame_width: Column, frame_height: Column, rect: Column) -> Column:
    """Whether the middle of the lower edge lies in a rectangle of shares of the frame."""
    x, y = (b[0] + b[2]) / 2 / frame_width, b[3] / frame_height
    return (rect[0] <= x) & (x <= rect[2]) & (rect[1] <= y) & (y <= rect[3])


def valid_zone(rect: Column) -> Column:
    return (F.size(rect) == 4) & (rect[0] >= 0) & (rect[0] < rect[2]) & (rect[2] <= 1) & (rect[1] >= 0) & (rect[1] < rect[3]) & (rect[3] <= 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """At least 0; null without length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, F.greatest(F.lit(0.0), dot(a, b) / norm))


def weighted_mean(signals: dict[str, Column], weights: dict[str, float]) -> Column:
    """Mean of the signals that aren't null; null means not evaluated, not zero."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, signal in signals.items():
        w = max(0.0, weights[name])
        total = total + F.coalesce(w * signal, F.lit(0.0))
        weight = weight + F.when(signal.isNotNull(), F.lit(w)).otherwise(F.lit(0.0))
    return total / F.greatest(F.lit(1e-9), weight)


def colour_name(h: Column, s: Column, v: Column, n: Column) -> Column:
    """Name of a colour by the medians of hue (0-180), saturation and value (0-256) of ``n`` pixels."""
    hue = F.when((h < 12) | (h > 170), "red").when(h < 35, "yellow").when(h < 85, "green").when(h < 130, "blue").otherwise("purple")
    plain = F.when(v > 190, "white").otherwise("gray")
    return F.when(n < 30, "unknown").when(v < 45, "black").when(s < 35, plain).otherwise(hue)
