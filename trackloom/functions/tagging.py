"""Query texts to structured constraints, as column expressions over a whole table of texts."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names and patterns that searches understand, in the order in which they are tried.
COLOURS = ("red", "blue", "green", "yellow", "white", "black", "gray", "purple")
ENTITIES = ("person", "car", "truck", "bus", "bicycle", "motorcycle", "bag")
EVENT_PATTERNS = (
    ("exited_zone", r"exit(?:ed|ing)? (?:a |the )?zone"),
    ("appeared", r"enter(?:ed|ing)? (?:a |the )?scene"),
    ("started_moving", r"start(?:ed|s)?(?: moving)?|began moving"),
    ("stationary", r"stationary|parked"),
    ("approached_object", r"approach(?:ed|ing)? (?:an? |the )?(?:object|bag|backpack|suitcase)"),
    ("approached_person", r"approach(?:ed|ing)? (?:an? |the |another )?(?:person|people)"),
    ("moved_away", r"mov(?:ed|ing|e) away"),
    ("placed_object", r"left (?:an? |the )?(?:object|bag|backpack|suitcase)|placed|put down|drop(?:ped)?|abandon"),
    ("picked_up", r"pick(?:ed)? up|collected|retrieved (?:the )?bag"),
    ("unattended", r"unattended"),
    ("approached_vehicle", r"approach(?:ed|ing)? (?:a |the )?(?:vehicle|car)|interacted with (?:a |the )?(?:car|vehicle)"),
    ("entered_zone", r"enter(?:ed|ing)?|crossed (?:the )?(?:zone|boundary)"),
    ("exited", r"exit(?:ed|ing)?|depart(?:ed|ure)?|left (?:the )?(?:scene|entrance|parking)|drove away"),
    ("stopped", r"stop(?:ped)?"),
    ("carried", r"carrying|carried|with (?:a )?backpack"),
)
UNSUPPORTED = (
    ("talks_to_person", r"talk(?:ed|s|ing)? to|conversation|convers(?:ed|ing)"),
    ("phone_use", r"(?:us(?:e|ed|ing)|talk(?:ed|s|ing)? on|text(?:ed|s|ing)? on) (?:a |the )?(?:phone|telephone)"),
    ("turned_left", r"turn(?:ed|s|ing)? left"),
    ("turned_right", r"turn(?:ed|s|ing)? right"),
    ("reversed", r"revers(?:e|ed|es|ing)"),
    ("rides_bicycle", r"rid(?:e|es|ing) (?:a |the )?(?:bicycle|bike)"),
)
SYNONYMS = (
    (r"\bpeople\b|\bman\b|\bwoman\b", "person"),
    (r"\bvehicles?\b", "car"),
    (r"\bbackpacks?\b|\bsuitcase\b", "bag"),
    (r"\bwearing\b|\bshirt\b|\bclothing\b", ""),
    (r"\bentry\b|\bgate\b", "entrance"),
)
# Places by their aliases, phrases, and how clock times and counts are written.
LOCATIONS = (("east entrance", ("east entrance", "east gate")), ("west plaza", ("west plaza", "plaza")), ("parking", ("parking", "car park")))
#: Phrases that relate to a selected event: relation and window in seconds; later ones win.
PHRASES = (
    ("immediately before", "before", 300), ("immediately after", "after", 300), ("during this event", "during", 0), ("near this event", "near", 120),
    ("followed by this event", "followed_by", 300),
)
CLOCK = r"\d{1,2}(?::\d{2})?\s*(?:am|pm)?"
COUNT = r"\d+|one|two|three|five"


def ascii_words(pattern: str) -> str:
    """Word borders by ASCII letters, digits and underscores, whatever the engine's rule is."""
    out, inside = "", False
    for piece in pattern.split(r"\b"):
        out += ("(?![0-9A-Za-z_])" if out and not piece[:1].isalnum() and piece[:1] != "(" else "(?<![0-9A-Za-z_])") + piece if inside else piece
        inside = True
    return out


def stems(pattern: str) -> list[str]:
    """Literals of which a text holds one wherever it matches ``pattern``: how its alternatives begin.
    Empty where one doesn't begin with three plain letters."""
    found, depth, start = [], 0, 0
    for i, c in enumerate(pattern + "|"):
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 0:
            plain = re.match(r"(?:\\b)?([a-z ]*)([?*]?)", pattern[start:i])
            literal = plain[1][:-1] if plain[2] else plain[1]
            if len(literal) < 3:
                return []
            found.append(literal)
            start = i + 1
    return found


def holds_any(text: Column, words: list[str]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(w)) for w in words])


def matches(text: Column, pattern: str) -> Column:
    """A plain search for the pattern's stems comes first: most long texts hold none."""
    found, begin = text.rlike(ascii_words(pattern)), stems(pattern)
    return F.when(holds_any(text, begin), found).otherwise(F.lit(False)) if begin else found


def first_match(text: Column, patterns) -> Column:
    """The name of the first pattern in the list that the text holds."""
    return F.coalesce(*[F.when(matches(text, pattern), F.lit(name)) for name, pattern in patterns])


def normalise(text: Column) -> Column:
    """Lower case, synonyms replaced, and the names of all events that are mentioned appended."""
    out = F.lower(text)
    for pattern, word in SYNONYMS:
        out = F.regexp_replace(out, ascii_words(pattern), word)
    return out


def normalised(df: DataFrame, text: str, into: str) -> DataFrame:
    """``df`` with ``normalise`` of a lower-cased column. Each synonym is a step of its own that leaves
    texts without its words alone."""
    out = df.withColumn(into, F.col(text))
    for pattern, word in SYNONYMS:
        step = F.regexp_replace(F.col(into), ascii_words(pattern), word)
        out = out.withColumn(into, F.when(holds_any(F.col(into), begin), step).otherwise(F.col(into)) if (begin := stems(pattern)) else step)
    return out


def with_event_names(normal: Column) -> Column:
    """A normalised text with the names of all events that it mentions appended, in the list's order.
    No name makes another event's pattern match, so all are tried on the text alone; give it as a
    column of its own, not as an expression, as every pattern reads it."""
    return F.concat_ws(" ", normal, *[F.when(matches(normal, pattern), F.lit(name.replace("_", " "))) for name, pattern in EVENT_PATTERNS])


def clock_minutes(text: Column) -> Column:
    """Minutes since midnight of ``6 PM``, ``18:30`` and the like; null if invalid."""
    t = F.lower(F.trim(text))
    part = lambda i: F.regexp_extract(t, r"^(\d{1,2})(?::(\d{2}))?\s*(am|pm)?$", i)
    h, m, half = part(1).try_cast("int"), F.coalesce(part(2).try_cast("int"), F.lit(0)), part(3)
    fine = h.isNotNull() & (m <= 59) & F.when(half != "", h.between(1, 12)).otherwise(h <= 23)
    hour = F.when(half == "", h).otherwise(h % 12 + F.when(half == "pm", 12).otherwise(0))
    return F.when(fine, hour * 60 + m)


def _count(text: Column) -> Column:
    names = F.when(text == "one", 1).when(text == "two", 2).when(text == "three", 3).when(text == "five", 5)
    return F.coalesce(names, text.try_cast("int"))


def _duration(q: Column, pattern: str, number: int, unit: int) -> Column:
    n, u = F.regexp_extract(q, ascii_words(pattern), number), F.regexp_extract(q, ascii_words(pattern), unit)
    return F.when(u != "", _count(n) * F.when(u == "minute", 60).otherwise(1))


def _clock_after(q: Column, word: str) -> Column:
    return F.regexp_extract(q, ascii_words(rf"\b{word}\s+({CLOCK})\b"), 1)


def tagged(df: DataFrame, text: str = "text", into: str = "tags") -> DataFrame:
    """``df`` with a struct column of its texts' ``tags``. The lower-cased and the normalised text are
    columns of their own on the way, so long texts are rewritten once, not once for each pattern."""
    ready = normalised(df.withColumn("__q", F.lower(F.coalesce(F.col(text), F.lit("")))), "__q", "__normal")
    return ready.withColumn(into, F.struct(*[c.alias(k) for k, c in tags(F.col("__q"), F.col("__normal")).items()])).drop("__q", "__normal")


def tags(text: Column, normal: Column | None = None) -> dict[str, Column]:
    """Constraints in a query text by name; null where it names none. ``normal``: the normalised text,
    if ``text`` is in lower case already (see ``tagged``)."""
    q = F.lower(F.coalesce(text, F.lit(""))) if normal is None else text
    normal = normalise(q) if normal is None else normal
    entity = first_match(normal, [(e, rf"\b{e}s?\b") for e in ENTITIES])
    camera = F.regexp_extract(q, r"(?:camera|cam)[ _-]*0?(\d+)", 1)
    location = F.coalesce(*[F.when(F.coalesce(*[F.when(q.contains(a), F.lit(True)) for a in aliases], F.lit(False)), F.lit(name)) for name, aliases in reversed(LOCATIONS)])
    between = rf"between\s+({CLOCK})\s+and\s+({CLOCK})"
    first, second = F.regexp_extract(q, between, 1), F.regexp_extract(q, between, 2)
    half = F.regexp_extract(second, "(am|pm)", 1)
    first = F.when((half != "") & ~first.rlike("am|pm"), F.concat(first, half)).otherwise(first)
    within = rf"within\s+({COUNT})\s*(second|minute).*?\b(before|after)\b"
    relation, window = F.regexp_extract(q, ascii_words(within), 3), _duration(q, within, 1, 2)
    relation, window = F.when(relation != "", relation), F.when(relation != "", window)
    for phrase, name, seconds in PHRASES[:4]:
        relation, window = F.when(q.contains(phrase), F.lit(name)).otherwise(relation), F.when(q.contains(phrase), F.lit(seconds)).otherwise(window)
    both = q.contains("overlap") & q.contains("this event")
    relation, window = F.when(both, F.lit("overlaps")).otherwise(relation), F.when(both, F.lit(0)).otherwise(window)
    phrase, name, seconds = PHRASES[4]
    relation, window = F.when(q.contains(phrase), F.lit(name)).otherwise(relation), F.when(q.contains(phrase), F.lit(seconds)).otherwise(window)
    clock = lambda word, other: F.when(second != "", clock_minutes(other)).otherwise(clock_minutes(_clock_after(q, word)))
    vehicle = (F.coalesce(entity, F.lit("")) != "person") & matches(q, r"\bvehicles?\b")
    return {
        "entity": F.when(vehicle, F.lit("vehicle")).otherwise(entity),
        "colour": first_match(q, [(c, rf"\b{c}\b") for c in COLOURS]), "event": first_match(q, EVENT_PATTERNS),
        "camera": F.when(camera != "", F.concat(F.lit("CAM-"), F.when(F.length(F.ltrim(camera, F.lit("0"))) < 2, F.lpad(F.ltrim(camera, F.lit("0")), 2, "0")).otherwise(F.ltrim(camera, F.lit("0"))))),
        "location": location, "after": clock("after", first), "before": clock("before", second),
        "min_duration": _duration(q, rf"(?:more than|over|at least|for)\s+({COUNT})\s*(second|minute)", 1, 2),
        "relation": relation, "window": window, "unsupported": first_match(q, UNSUPPORTED),
    }


def warnings(tagged: dict[str, Column], text: Column) -> Column:
    """What a user is told about a query, as an array of texts."""
    q = F.lower(text)
    bad = (_clock_after(q, "after") != "") & clock_minutes(_clock_after(q, "after")).isNull() | (_clock_after(q, "before") != "") & clock_minutes(_clock_after(q, "before")).isNull()
    nothing = F.coalesce(*[tagged[k].cast("string") for k in ("entity", "colour", "event", "camera", "location", "after", "before")]).isNull()
    return F.array_compact(F.array(
        F.when(tagged["unsupported"].isNotNull(), F.lit("No detector for this activity; nothing can match.")),
        F.when(bad, F.lit("Invalid clock time; use HH:MM or 6 PM.")), F.when(nothing, F.lit("No structured constraint; ranked by text alone."))))


#: Kinds of events and types of objects that a wanted one includes besides itself.
INCLUDED_KINDS = {"stationary": ("stationary", "stopped", "became_stationary"), "exited": ("exited", "disappeared")}
INCLUDED_TYPES = {"vehicle": ("vehicle", "car", "truck", "bus", "motorcycle"), "bag": ("bag", "backpack", "suitcase")}


def _included(wanted: Column, table: dict[str, tuple[str, ...]]) -> Column:
    out = F.array(wanted)
    for name, values in table.items():
        out = F.when(wanted == name, F.array(*map(F.lit, values))).otherwise(out)
    return out


def event_kinds(wanted: Column) -> Column:
    """Array of the kinds that satisfy a wanted one."""
    return _included(wanted, INCLUDED_KINDS)


def entity_types(wanted: Column) -> Column:
    """Array of the object types that satisfy a wanted one."""
    return _included(wanted, INCLUDED_TYPES)


def event_matches(kind: Column, wanted: Column) -> Column:
    """Equal kinds, or one that the wanted kind includes."""
    return F.array_contains(event_kinds(wanted), kind)


def entity_matches(kinds: Column, wanted: Column) -> Column:
    """Whether an array of object types holds the wanted one or one that it includes."""
    return F.arrays_overlap(kinds, entity_types(wanted))


def clock_matches(minute: Column, after: Column, before: Column) -> Column:
    """Minutes of the day inside a window that may pass midnight; null bounds are open."""
    wraps = after.isNotNull() & before.isNotNull() & (after > before)
    return F.when(wraps, (minute >= after) | (minute <= before)).otherwise((after.isNull() | (minute >= after)) & (before.isNull() | (minute <= before)))
