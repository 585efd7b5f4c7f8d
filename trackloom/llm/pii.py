"""Personal data: spans proposed by patterns and selected by gradient-boosted trees.

Everything here is DataFrame and SQL functions: spans live in arrays beside their document, so no
row is exploded and nothing is shuffled. *Base* spans follow four fixed patterns with their checks
and always stay. *Generators* then propose overlapping spans with high recall, several patterns a
kind: numbers written in other ways, numbers inside a longer match that failed its check, addresses
spelled out. Boosted trees score each proposal by its format and context; those that reach their
kind's threshold, calibrated on held-out rows, and overlap no base span and no likelier proposal are
added.

The trees are trained once a process on labelled spans composed by Spark from templates (no table
has labels for spans): ``EXAMPLES`` rows, a fixed number. They are then written as column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The base patterns in equivalent forms that never step back over a long run of characters: a
#: match begins where the last one ended or where its first class begins, quantifiers don't yield.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"(?: ?(?:\(at\)|\[at\]|\{at\}|<at>) ?| at | ?@ ?)", r"(?: ?(?:\(dot\)|\[dot\]|\{dot\}) ?| dot |\.)"
#: Proposals: what might be personal data of a kind. Matches of one pattern don't overlap, those of
#: different ones do.
PROPOSED = {
    "email": [rf"(?i)(?<![\w.%+-])[\w.%+-]++{_AT}[a-z0-9-]++(?:{_DOT}[a-z0-9-]++)++"],
    "ip": [r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])", r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){3,7}+[0-9A-Fa-f]{1,4}(?![\w:])"],
    "card": [
        r"(?<![0-9])[0-9]{16,19}(?![0-9])", r"(?<![0-9])[0-9]{4}([ ./-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
        r"(?<![0-9])[0-9]{4}[ ./-]?[0-9]{6}[ ./-]?[0-9]{5}(?![0-9])"],
    "phone": [
        r"\+[0-9]{1,3}[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])", r"\+[0-9]{1,3}(?:[ ./-][0-9]{2,4}){3}(?![0-9])",
        r"(?<![\w.-])\(?[0-9]{3}\)?[ ./-][0-9]{3}[ .-][0-9]{4}(?![0-9])", r"(?<![\w+.-])(?:00[0-9]{2}[ ./-])?\(?0?[0-9]{2,4}\)?[ /-][0-9]{3,4}[ -][0-9]{3,5}(?![0-9])"],
}
#: Cheap tests that a text can hold a span of the kind at all.
MAYBE = {"email": r"(?i)@|\bat[ )\]}>]", "ip": r"[0-9]\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]", "card": "[0-9]", "phone": "[0-9]"}
#: Further tests, before the generators are run.
LIKELY = {"email": r"(?i) ?@ ?|[(\[{<]at[)\]}>]| at [a-z0-9-]++(?: ?[(\[{]dot| dot |\.[a-z0-9])", "ip": MAYBE["ip"], "card": r"[0-9]{4}[ ./-]?[0-9]{4}", "phone": r"[0-9]{2}[) ./-]{1,2}[0-9]{3}"}
#: Positions are summed by blocks of so many matches.
BLOCK = 256
#: Characters of context on either side.
CONTEXT = 24
EXAMPLES, TREES, DEPTH = 4000, 20, 3
#: Precision that each kind's threshold must reach on held-out rows.
PRECISION = 0.98
_SPAN = "array<struct<start:int,end:int,value:string>>"
_FAR = 2**31 - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, combine: Callable[[Column, Column], Column], start: int) -> Column:
    """The running sum, maximum or the like of an array of integers. An array that is built value by
    value is copied each time, so it is built by blocks, and the blocks' totals likewise."""
    zero = lambda: F.array(F.lit(start))

    def fold(items: Column) -> Column:  # with the start in front
        return F.aggregate(items, zero(), lambda acc, x: F.concat(acc, F.array(combine(F.element_at(acc, -1), x))))

    def joined(inner: Column) -> Column:
        ahead = fold(F.transform(inner, lambda x: F.element_at(x, -1)))
        return let(ahead, lambda t: F.flatten(F.transform(inner, lambda x, i: F.transform(F.slice(x, F.lit(2), F.size(x) - 1), lambda v: combine(F.get(t, i), v)))))

    def whole(items: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: fold(F.slice(items, b * BLOCK + 1, F.lit(BLOCK))))
        return F.when(F.size(items) > 0, let(blocks, joined)).otherwise(F.array().cast("array<int>"))

    return let(values, whole)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, end exclusive, value) in code points."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(values: Column) -> Column:
        steps = F.zip_with(values, F.slice(gaps, F.lit(1), F.size(values)), lambda m, g: F.length(g) + F.length(m))
        span = lambda m, end: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("value"))
        return F.zip_with(values, running(steps, lambda a, b: a + b, 0), span)

    return let(found, placed)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""
    each = F.transform(F.split(F.reverse(number), ""), lambda d: d.try_cast("int"))
    summed = F.transform(F.filter(each, lambda d: d.isNotNull()), lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d)))
    return F.aggregate(summed, F.lit(0), lambda a, d: a + d) % 10 == 0


def _octets(value: Column) -> Column:
    """Whether every dotted part is at most 255, however long it is written."""
    return F.forall(F.split(value, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int") <= 255, F.lit(False)))


def _valid(kind: str, value: Column) -> Column:
    n = F.length(digits(value))
    return {"email": F.lit(True), "ip": _octets(value), "card": n.between(16, 19) & luhn(digits(value)), "phone": n.between(8, 15)}[kind]


def base_spans(text: Column, kind: str) -> Column:
    """The kind's base matches that pass its check; failing ones are dropped without a retry."""
    found = F.filter(matches(text, BASE[kind]), lambda s: _valid(kind, s.getField("value")))
    return F.when(F.contains(text, F.lit("@")) if kind == "email" else text.rlike(MAYBE[kind]), found).otherwise(F.array().cast(_SPAN))


_HINTS = {
    "about_phone": r"(?i)(tel|phone|call|mobile|cell|fax|whatsapp|sms)\W*\w{0,6}\W*$", "about_card": r"(?i)(card|visa|credit|payment|mastercard|amex|debit)\W*\w{0,8}\W*$",
    "about_mail": r"(?i)(mail|contact|write|reach)\W*\w{0,6}\W*$", "about_host": r"(?i)(ip|host|server|address|login|from)\W*\w{0,6}\W*$",
    "about_other": r"(?i)(version|v|order|isbn|ref|no|nr|id|date|page|invoice|build|part|serial|#)\W*$",
}


def features(kind: Column, value: Column, before: Column, after: Column) -> dict[str, Column]:
    """Numbers about a proposed span's format and context."""
    number, groups = digits(value), F.filter(F.split(value, "[^0-9]+"), lambda g: g != "")
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    sizes = F.transform(groups, lambda g: F.length(g))
    return {
        "kind": F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("double"),
        "n_digits": F.length(number).cast("double"), "n_chars": F.length(value).cast("double"), "n_groups": F.size(groups).cast("double"),
        "longest_group": F.coalesce(F.array_max(sizes), F.lit(0)).cast("double"), "shortest_group": F.coalesce(F.array_min(sizes), F.lit(0)).cast("double"),
        "n_letters": F.length(F.regexp_replace(value, "[^A-Za-z]", "")).cast("double"), "n_dots": F.length(F.regexp_replace(value, "[^.]", "")).cast("double"),
        "n_colons": F.length(F.regexp_replace(value, "[^:]", "")).cast("double"), "n_slashes": F.length(F.regexp_replace(value, "[^/]", "")).cast("double"),
        "bracket": flag(value.rlike(r"[(\[{]")), "passes_luhn": flag(luhn(number)), "octets": flag(_octets(F.split(value, ":")[0])),
        "dateish": flag(value.rlike(r"^(19|20)[0-9]{2}\D|\D(19|20)[0-9]{2}$|^[0-3]?[0-9][./-][0-3]?[0-9][./-]")),
        "spelled": flag(value.rlike(r"(?i)[(\[{<]at|[(\[{<]dot| at .* dot ")), "ends_in_tld": flag(value.rlike(r"(?i)[. )\]](com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$")),
        "sentence": flag(value.rlike(r"\. ")), "leading_zero": flag(value.rlike(r"^\(?0")), "touches_word": flag(before.rlike(r"[\p{L}=_]$") | after.rlike(r"^[\p{L}=_]")),
        "digit_before": flag(before.rlike(r"[0-9][ ./-]?$")), "digit_after": flag(after.rlike(r"^[ ./-]?[0-9]")), "code_before": flag(before.rlike(r"\+[0-9]{1,3}[ ./-]?$")),
        "starts_plus": flag(value.startswith("+")), **{name: flag(before.rlike(pattern)) for name, pattern in _HINTS.items()},
    }


def examples(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """``n`` labelled spans from templates: ``kind, value, before, after, label, held_out``. Spans of
    either label stand after hints, in prose and beside other numbers; parts of a longer number, dates,
    versions, and numbers that fail their check are what must not be selected."""
    rows = spark.range(0, n, 1, 4)
    draw = lambda salt, m: F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(m))
    number = lambda salt, width: F.lpad(draw(salt, 10**width).cast("string"), width, "0")
    pick = lambda salt, *options: F.element_at(F.array(*[o if isinstance(o, Column) else F.lit(o) for o in options]), (draw(salt, len(options)) + 1).cast("int"))
    word = lambda salt, m: F.expr(
        f"substring(translate(sha2(concat('{salt}', cast(id as string)), 256), '0123456789', 'ghijklmnop'), 1, 2 + cast(pmod(xxhash64(id, '{salt}n'), {m}) as int))")
    part = lambda salt: pick(salt, "anna", "j.smith", "info42", "kontakt", "marie", "dev")
    at, dot, tld = pick("at", " at ", " [at] ", "(at)", " (at) "), pick("dot", " dot ", " [dot] ", "(dot)", "."), pick("tld", "com", "org", "net", "de", "fr")
    stem = F.substring(F.concat(pick("iin", "4", "51", "37", "6011", "2", "98", "7"), number("s1", 8), number("s2", 8)), 1, 15)
    check = F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(stem, d.cast("string"))), luhn), 1)
    wrong = F.concat(stem, F.pmod(F.substring(check, 16, 1).cast("int") + 1 + draw("w", 8), F.lit(10)).cast("int").cast("string"))
    fours = lambda c, s: F.concat(F.substring(c, 1, 4), s, F.substring(c, 5, 4), s, F.substring(c, 9, 4), s, F.substring(c, 13, 4))
    gap, split = pick("gap", "", "", " ", ".", "/", "-"), pick("t", " ", "-", ".")
    octet = lambda salt: draw(salt, 256).cast("string")
    hextet = lambda salt: F.lower(F.hex(draw(salt, 65536)))
    ten = F.concat(number("p", 3), split, number("q", 3), split, number("r", 4))
    bracketed = F.concat(F.lit("("), number("p", 3), F.lit(") "), number("q", 3), F.lit("-"), number("r", 4))
    country = F.concat(F.lit("+"), pick("cc", "1", "44", "49", "33", "34"))
    date = F.concat(pick("century", "19", "20"), number("p", 2), split, number("q", 2), split, number("r", 2))
    beside = pick("beside", F.concat(number("b1", 8), number("b2", 8)), F.concat_ws(".", octet("e"), octet("f"), octet("g"), octet("h")), F.concat(country, F.lit(" ("), number("b3", 3), F.lit(") "), number("b4", 3), F.lit("-"), number("b5", 4)))
    # Kind, label, value; what stands right before it where that is not drawn.
    options = [
        ("email", 1, F.concat(part("u"), at, word("h", 10), dot, tld), None), ("email", 1, F.concat(word("u", 9), at, word("h", 10), pick("dot", " dot ", " [dot] ", "(dot)"), tld), None),
        ("email", 0, F.concat(word("a", 9), F.lit(" at "), word("b", 9), F.lit("."), F.initcap(word("c", 9))), None), ("email", 0, F.concat(word("a", 7), F.lit(" at "), word("b", 7), F.lit("."), word("c", 7)), None),
        ("ip", 1, F.concat_ws(".", octet("i"), octet("j"), octet("k"), octet("l")), None), ("ip", 1, F.concat_ws(":", *[hextet(f"x{i}") for i in range(8)]), None),
        ("ip", 0, F.concat_ws(".", draw("i", 900).cast("string"), (draw("j", 600) + 256).cast("string"), draw("k", 900).cast("string"), draw("l", 900).cast("string")), None),
        ("ip", 0, F.concat_ws(":", number("h", 2), number("m", 2), number("n", 2), number("o", 2)), None), ("ip", 0, F.concat_ws(".", draw("i", 9).cast("string"), draw("j", 20).cast("string"), draw("k", 9).cast("string"), draw("l", 9).cast("string")), F.lit("version ")),
        ("card", 1, fours(check, gap), None), ("card", 1, fours(check, F.lit("")), None), ("card", 0, fours(wrong, gap), None), ("card", 0, fours(wrong, F.lit("")), None),
        ("card", 0, F.concat(date, F.lit(" "), number("h", 6), number("m", 5)), None), ("card", 0, F.concat(number("y", 9), number("m", 8)), None),
        ("phone", 1, F.concat(country, F.lit(" "), bracketed), None), ("phone", 1, bracketed, None), ("phone", 1, ten, None), ("phone", 1, F.concat(country, F.lit(" "), ten), None),
        ("phone", 1, F.concat(F.lit("0"), number("p", 3), pick("s", " ", "/", "-"), number("q", 3), pick("v", " ", "-"), number("r", 4)), None),
        ("phone", 0, bracketed, F.concat(country, F.lit(" "))), ("phone", 0, ten, F.concat(country, F.lit(" "))), ("phone", 0, ten, F.concat(number("b", 4), split)),
        ("phone", 0, F.concat(number("p", 4), F.lit(" "), number("q", 4), F.lit(" "), number("r", 4)), F.concat(number("b", 4), F.lit(" "))), ("phone", 0, date, None),
        ("phone", 0, F.concat_ws(".", number("i", 3), number("j", 3), number("k", 4)), F.concat(number("b", 2), F.lit("."))),
    ]
    made = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(float(y)).alias("label"), v.alias("value"), (F.lit(None).cast("string") if b is None else b).alias("lead")) for k, y, v, b in options])
    which = F.element_at(made, (F.col("id") % len(options) + 1).cast("int"))
    hint = F.create_map(*[F.lit(x) for k, h in (("email", "mail me: "), ("ip", "server "), ("card", "credit card "), ("phone", "call ")) for x in (k, h)])[F.col("kind")]
    told = F.when(F.col("label") == 1, hint).otherwise(pick("other", "version ", "order no. ", "the ", "and ", "ref "))
    prose = pick("plain", "and ", "the ", "in ", "of ", "ernd. ")
    before = F.when(draw("hint", 3) == 0, told).when(draw("hint", 3) == 1, F.concat(prose, beside, F.lit(" "))).otherwise(prose)
    after = F.when(draw("more", 4) == 0, F.concat(F.lit(" "), beside)).otherwise(pick("after", " and", ". The", " in", ",", " ernd"))
    return rows.select("id", which.alias("w")).select("id", "w.*").select("kind", "value", "label", F.coalesce(F.col("lead"), before).alias("before"), after.alias("after"), (draw("held", 4) == 0).alias("held_out"))


def read_trees(printed: str, weights: list[float], names: list[str]) -> list[tuple]:
    """Boosted trees, as Spark prints them: (weight, node); a node is a number or a tuple (feature,
    bound, node up to it, node above it)."""
    trees = []
    for tree, weight in zip(re.split(r"\n\s*Tree \d+[^\n]*\n", printed)[1:], weights, strict=True):
        lines = iter([x.strip() for x in tree.strip().split("\n")])

        def node(lines=lines) -> float | tuple:
            line = next(lines)
            if value := re.match(r"Predict: (\S+)", line):
                return float(value[1])
            index, bound = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
            low = node()
            next(lines)  # Else
            return names[int(index)], float(bound), low, node()

        trees.append((float(weight), node()))
    return trees


def probability(trees: list[tuple], x: Column) -> Column:
    """The boosted trees' probability for a struct column of features."""

    def value(node: float | tuple) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        name, bound, low, high = node
        return F.when(x.getField(name) <= bound, value(low)).otherwise(value(high))

    total = F.lit(0.0)
    for weight, node in trees:
        total = total + F.lit(weight) * value(node)
    return 1 / (1 + F.exp(-2 * total))


_TRAINED: dict[tuple, tuple[list[tuple], dict[str, float]]] = {}


def train(spark: SparkSession) -> tuple[list[tuple], dict[str, float]]:
    """The trees, and a threshold for each kind: the least at which the held-out rows at or above it
    reach ``PRECISION``. The examples don't depend on any table, so one fit serves a process."""
    if (key := (EXAMPLES, TREES, DEPTH, PRECISION)) in _TRAINED:
        return _TRAINED[key]
    columns = features(F.col("kind"), F.col("value"), F.col("before"), F.col("after"))
    names = list(columns)
    table = examples(spark).select("label", "held_out", F.col("kind").alias("name"), F.struct(*[c.alias(k) for k, c in columns.items()]).alias("x"))
    flat = table.where("not held_out").select("label", "x.*")
    booster = GBTClassifier(labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7)
    fitted = booster.fit(VectorAssembler(inputCols=names, outputCol="features").transform(flat))
    trees = read_trees(fitted.toDebugString, fitted.treeWeights, names)
    scored = table.where("held_out").select("name", "label", probability(trees, F.col("x")).alias("p")).collect()
    bounds = {}
    for kind in KINDS:
        own = sorted(((r.p, r.label) for r in scored if r.name == kind), reverse=True)
        bounds[kind], right = 1.1, 0.0
        for i, (p, label) in enumerate(own):
            right += label
            if right / (i + 1) >= PRECISION and p >= 0.5 and (i + 1 == len(own) or own[i + 1][0] < p):
                bounds[kind] = p
    _TRAINED[key] = trees, bounds
    return _TRAINED[key]


def _apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others: all are sorted by start, then the farthest end
    before a span and the next start after it tell."""
    tagged = lambda side, own: F.transform(side, lambda s: F.struct(s.getField("start").alias("start"), s.getField("end").alias("end"), F.lit(own).alias("own"), s.getField("value").alias("value")))

    def kept(every: Column) -> Column:
        other = lambda field, none: F.transform(every, lambda s: F.when(s.getField("own"), F.lit(none)).otherwise(s.getField(field)))
        reach = running(other("end", 0), lambda a, b: F.greatest(a, b), 0)
        following = F.reverse(running(F.reverse(other("start", _FAR)), lambda a, b: F.least(a, b), _FAR))
        fine = F.zip_with(F.zip_with(every, reach, lambda s, r: F.struct(s.alias("s"), r.alias("r"))), following, lambda x, n: F.when(
            x.getField("s").getField("own") & (x.getField("r") <= x.getField("s").getField("start")) & (n >= x.getField("s").getField("end")), x.getField("s")))
        return F.transform(F.filter(fine, lambda s: s.isNotNull()), lambda s: F.struct(s.getField("start").alias("start"), s.getField("end").alias("end"), s.getField("value").alias("value")))

    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(let(F.array_sort(F.concat(tagged(spans, True), tagged(others, False))), kept))


def _proposed(text: Column, kind: str) -> Column:
    """All proposals of a kind, those of different patterns may overlap."""
    none = F.array().cast(_SPAN)
    found = [F.when(text.rlike(pattern), matches(text, pattern)).otherwise(none) for pattern in PROPOSED[kind]]
    return F.when(text.rlike(LIKELY[kind]), F.array_distinct(F.concat(*found)) if len(found) > 1 else found[0]).otherwise(none)


def _scored(text: Column, kind: str, spans: Column, trees: list[tuple], bound: float) -> Column:
    """The spans that reach the kind's bound, with ``kind`` and probability ``p``."""

    def described(s: Column) -> Column:
        start, end = s.getField("start"), s.getField("end")
        before = F.substr(text, F.greatest(start - CONTEXT + 1, F.lit(1)), F.least(start, F.lit(CONTEXT)))
        found = features(F.lit(kind), s.getField("value"), before, F.substr(text, end + 1, F.lit(CONTEXT)))
        return F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), s.getField("value").alias("value"), F.struct(*[c.alias(n) for n, c in found.items()]).alias("x"))

    chance = F.transform(F.transform(spans, described), lambda s: F.struct(*[s.getField(c).alias(c) for c in ("start", "end", "kind", "value")], probability(trees, s.getField("x")).alias("p")))
    return F.filter(chance, lambda s: s.getField("p") >= bound)


def _likeliest(spans: Column) -> Column:
    """From left to right, of spans that overlap the likelier stays, of equal ones the longer."""
    least = lambda s: F.struct(s.getField("p"), s.getField("end") - s.getField("start"))

    def add(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        return (
            F.when((F.size(acc) == 0) | (s.getField("start") >= last.getField("end")), F.concat(acc, F.array(s)))
            .when(least(s) > least(last), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(s))).otherwise(acc)
        )

    return F.when(F.size(spans) < 2, spans).otherwise(F.aggregate(F.array_sort(spans), F.filter(spans, lambda s: F.lit(False)), add))


def find(docs: DataFrame) -> DataFrame:
    """Personal data in ``docs(doc_id, text, ...)``: one row for each input row.

    Returns ``doc_id``, the text, and for each kind the array columns ``base_<kind>`` and
    ``added_<kind>`` of (start, end exclusive, value) in code points. Added spans overlap neither a
    base span nor one another. Null texts count as empty and hold nothing; null and repeated doc_ids
    are passed through, other columns are not read. Without rows the result is empty.
    """
    trees, bounds = train(docs.sparkSession)
    text = F.col("text")
    out = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = out.select("*", *[base_spans(text, kind).alias(f"base_{kind}") for kind in KINDS], *[_proposed(text, kind).alias(f"__{kind}") for kind in KINDS])
    out = out.withColumn("__taken", F.concat(*[F.col(f"base_{kind}") for kind in KINDS]))
    apart = [F.when(F.size(f"__{kind}") == 0, F.col(f"__{kind}")).otherwise(_apart(F.col(f"__{kind}"), F.col("__taken"))).alias(f"__{kind}") for kind in KINDS]
    out = out.select("doc_id", "text", *[f"base_{kind}" for kind in KINDS], *apart)
    out = out.withColumn("__chosen", F.concat(*[_scored(text, kind, F.col(f"__{kind}"), trees, bounds[kind]) for kind in KINDS]))
    out = out.withColumn("__chosen", _likeliest(F.col("__chosen")))
    plain = lambda s: F.struct(*[s.getField(c).alias(c) for c in ("start", "end", "value")])
    of = lambda kind: F.transform(F.filter("__chosen", lambda s: s.getField("kind") == kind), plain)
    return out.select("doc_id", "text", *[f"base_{kind}" for kind in KINDS], *[of(kind).alias(f"added_{kind}") for kind in KINDS])


def listed(columns: dict[str, Column]) -> Column:
    """``kind:start:end`` of the spans of each kind by start, joined by commas."""


    def named(kind: str, spans: Column) -> Column:
        ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s.getField("start").alias("start"), s.getField("end").alias("end"))))
        return F.transform(ordered, lambda s: F.concat_ws(":", F.lit(kind), s.getField("start").cast("string"), s.getField("end").cast("string")))

    return F.array_join(F.concat(*[named(kind, spans) for kind, spans in columns.items()]), ",")


def redact(found: DataFrame, mark: str = "[{kind}]") -> DataFrame:
    """``find``'s rows with every base and added span of ``text`` replaced by its kind's mark."""


    def marked(kind: str) -> Column:
        what = F.lit(mark.format(kind=kind)).alias("mark")
        return F.transform(F.concat(f"base_{kind}", f"added_{kind}"), lambda s: F.struct(s.getField("start").alias("start"), s.getField("end").alias("end"), what))

    spans = F.array_sort(F.concat(*map(marked, KINDS)))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(acc: Column, s: Column) -> Column:  # base spans of two kinds may overlap
        start = F.greatest(acc.getField("at"), s.getField("start"))
        piece = F.concat(acc.getField("out"), F.substr(F.col("text"), acc.getField("at") + 1, start - acc.getField("at")), s.getField("mark"))
        return F.struct(F.greatest(acc.getField("at"), s.getField("end")).alias("at"), piece.alias("out"))

    done = F.aggregate(spans, begin, cut, lambda acc: F.concat(acc.getField("out"), F.substr(F.col("text"), acc.getField("at") + 1, F.length("text"))))
    return found.select("doc_id", done.alias("text"))
