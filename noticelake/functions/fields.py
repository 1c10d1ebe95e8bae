"""Labelled fields of a notice's text, as column expressions.

The text is split at its labels; what follows a label, up to the next one, is the label's value. Labels
that only look like one (prose, other periods) are taken back: their text belongs to the value before.
Contradictions leave nothing, and a year is never guessed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from . import timing as M
from .text import let, normalize

#: Every label begins with a letter or a round, so the many patterns are not tried at other signs.
LABEL = r"(?iu)(?<![가-힣A-Za-z0-9])(?=[가-힣A-Za-z]|\d+차)(?:" + "|".join(P.LABELS.values()) + r")(?=\s|[:：]|$)[ \t]*[:：]?[ \t]*"
PROSE_FIELDS = ["organizer", "benefits", "summary", "event", "eligibility"]
_ENTRIES = "array<struct<kind:string,label:string,value:string>>"


def _kind(label: Column) -> Column:
    return F.coalesce(*[F.when(label.rlike(rf"(?iu)^(?:{pattern})[ \t]*[:：]?[ \t]*$"), F.lit(kind)) for kind, pattern in P.LABELS.items()])


def compact(text: Column, limit: int) -> Column:
    plain = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^[ \t\n:：•·○■□●-]+|[ \t\n:：•·○■□●-]+$", "")
    return let(plain, lambda x: F.when(F.length(x) > limit, F.concat(F.left(x, F.lit(limit)), F.lit("…"))).otherwise(x))


def _is_label(kind: Column, label: Column, before: Column, after: Column) -> Column:
    """Whether a match is a heading or a labelled value, by the line before it and the text after it."""
    first_line = F.substring_index(after, "\n", 1)
    dated = first_line.rlike(M.TOKEN) | first_line.rlike("^[~～∼]")
    bare = F.regexp_replace(label, r"[ \t]*[:：]?[ \t]*$", "").rlike(rf"^(?:{P.BARE_REGISTRATION})$")
    prose = ((before != "") & ~label.rlike("[:：]")) | after.rlike(P.NOT_FIELD)
    return F.when(kind == "registration", ~before.rlike(P.NOT_REGISTRATION) & (~bare | dated)).when(kind.isin(PROSE_FIELDS), ~prose).otherwise(F.lit(True))


def _value(kind: Column, label: Column, raw: Column) -> Column:
    """A field's value: one paragraph, without bullets and sections that follow, on one line."""
    out = F.trim(F.regexp_replace(raw, r"^\s+|\s+$", ""))
    for end in (r"\n\s*\n", P.NEXT_BULLET):
        out = F.regexp_replace(out, f"(?s)(?:{end}).*$", "")
    sectioned = lambda x: F.regexp_replace(x, f"(?s)(?:{P.NEXT_SECTION}).*$", "")
    cut = let(out, lambda x: compact(F.when(kind.isin("organizer", "benefits", "eligibility", "summary"), sectioned(x)).otherwise(x), 400))
    return let(cut, lambda x: F.when((kind == "benefits") & label.rlike(r"^총\s*상금") & (x != ""), F.concat(F.lit("총상금 "), x)).otherwise(x))


def entries(text: Column) -> Column:
    """array<struct<kind, label, value>> of a text's labelled fields, in order."""
    return plain_entries(normalize(F.coalesce(text, F.lit(""))))


def plain_entries(text: Column) -> Column:
    """`entries` of a normalised text. Its labels are found in one pass, which sets them off by signs that no text holds."""
    plain = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "\u0001\u0002", ""), r"[\[【]([^\]\n】]{1,40})[\]】]", " $1 ")
    part = lambda x, which: F.substring_index(x, "\u0002", which)

    def cut(pieces: Column) -> Column:
        after = F.slice(pieces, F.lit(2), F.size(pieces))
        return F.struct(F.transform(after, lambda x: part(x, 1)).alias("labels"), F.concat(F.slice(pieces, 1, 1), F.transform(after, lambda x: part(x, -1))).alias("gaps"))

    return let(let(let(F.split(F.regexp_replace(plain, LABEL, "\u0001$0\u0002"), "\u0001", -1), cut), _joined), _cleaned)


def _joined(cut: Column) -> Column:
    """Labels with the text after them; what is no label is taken back into the value before."""
    labels, gaps = cut["labels"], cut["gaps"]

    def part(i: Column) -> Column:
        begun = (i == 0) | gaps[i].contains("\n")
        before = F.when(begun, F.substring_index(gaps[i], "\n", -1)).otherwise(F.concat(labels[F.greatest(i - 1, F.lit(0))], gaps[i]))
        before = F.regexp_replace(before, r"^[ \t•·○■□●*\-0-9.)]+|[ \t•·○■□●*\-0-9.)]+$", "")
        return F.struct(_kind(labels[i]).alias("kind"), labels[i].alias("label"), before.alias("before"), gaps[i + 1].alias("after"))

    def fold(state: Column, x: Column) -> Column:
        new = F.concat(state, F.array(F.struct(x["kind"].alias("kind"), x["label"].alias("label"), x["after"].alias("value"))))
        last = F.try_element_at(state, F.lit(-1))
        longer = F.struct(last["kind"].alias("kind"), last["label"].alias("label"), F.concat(last["value"], x["label"], x["after"]).alias("value"))
        glued = F.when(F.size(state) > 0, F.concat(F.slice(state, F.lit(1), F.greatest(F.size(state) - 1, F.lit(0))), F.array(longer))).otherwise(state)
        return F.when(_is_label(x["kind"], x["label"], x["before"], x["after"]), new).otherwise(glued)

    parts = F.when(F.size(labels) > 0, F.transform(F.sequence(F.lit(0), F.size(labels) - 1), part))
    return F.coalesce(F.aggregate(parts, F.array().cast(_ENTRIES), fold), F.array().cast(_ENTRIES))


def _cleaned(found: Column) -> Column:
    """The fields with their values cut and cleaned; `stop` labels and empty values go."""
    named = F.transform(F.filter(found, lambda e: e["kind"] != "stop"), lambda e: F.struct(e["kind"].alias("kind"), F.regexp_replace(e["label"], r"[ \t]*[:：]?[ \t]*$", "").alias("label"), _value(e["kind"], e["label"], e["value"]).alias("value")))
    return F.filter(named, lambda e: e["value"].rlike("[가-힣A-Za-z0-9]") & ~((e["kind"] == "registration") & e["value"].rlike(f"^(?:{P.BARE_SCHEDULE})$")))


def values_of(found: Column, kind: str) -> Column:
    """The distinct values of one kind, in order."""
    return F.array_distinct(F.transform(F.filter(found, lambda e: e["kind"] == kind), lambda e: e["value"]))


def registration(found: Column, year: Column) -> Column:
    """struct(starts, ends): the registration window that the entries state; null dates where they contradict each other or leave something open."""
    stated = F.array_distinct(F.filter(found, lambda e: e["kind"] == "registration"))

    def read(e: Column) -> Column:
        ranged = e["value"].rlike(f"(?iu){P.RANGE}")
        opens, closes = e["label"].rlike(f"(?iu){P.START_LABEL}") & ~ranged, e["label"].rlike(f"(?iu){P.END_LABEL}") & ~ranged
        until = (e["value"].rlike(P.UNTIL) & ~ranged) | e["value"].rlike("^[~～∼]")
        side = F.when(opens, "start").when(closes | until, "end").otherwise("open")

        def told(days: Column) -> Column:
            pair = (F.size(days) == 2) & days[0].isNotNull() & (days[0] <= days[1])
            single = (F.size(days) == 1) & days[0].isNotNull()
            how = F.when(F.coalesce(pair, F.lit(False)), "period").when(single, side).otherwise("open")
            return F.struct(how.alias("how"), F.try_element_at(days, F.lit(1)).alias("a"), F.try_element_at(days, F.lit(2)).alias("b"))

        return let(M.plain_date_tokens(e["value"], year), told)

    def sides(parts: Column) -> Column:
        of = lambda how: F.array_distinct(F.filter(parts, lambda x: x["how"] == how))
        return F.struct(of("period").alias("periods"), of("start").alias("starts"), of("end").alias("ends"), F.exists(parts, lambda x: x["how"] == "open").alias("loose"))

    def decide(x: Column) -> Column:
        first = lambda name: F.try_element_at(x[name], F.lit(1))
        start, end, period = first("starts")["a"], first("ends")["a"], first("periods")
        agrees = F.coalesce(start == period["a"], F.lit(True)) & F.coalesce(end == period["b"], F.lit(True)) & F.coalesce(start <= end, F.lit(True))
        plain = (F.size(x["periods"]) <= 1) & (F.size(x["starts"]) <= 1) & (F.size(x["ends"]) <= 1) & ~x["loose"] & agrees
        return F.struct(F.when(plain, F.coalesce(period["a"], start)).alias("starts"), F.when(plain, F.coalesce(period["b"], end)).alias("ends"))

    return let(let(F.transform(stated, read), sides), decide)


def registration_clocks(found: Column, year: Column) -> Column:
    """struct(starts, ends, ambiguous): the clocks beside the registration dates; two different ones for one end leave both empty."""

    def read(e: Column) -> Column:
        closes, opens = e["label"].rlike(f"(?iu){P.END_LABEL}"), e["label"].rlike(f"(?iu){P.START_LABEL}")

        def told(x: Column) -> Column:
            two = (F.size(x["days"]) == 2) & (F.size(x["gaps"]) == 3) & ~F.exists(x["days"], lambda d: d.isNull())
            one = (F.size(x["days"]) == 1) & (F.size(x["gaps"]) == 2)
            return F.struct(F.when(two | (one & opens & ~closes), x["first"]).alias("a"), F.when(two, x["second"]).when(one & closes, x["first"]).alias("b"))

        def clocks(x: Column) -> Column:
            return F.struct(x["days"].alias("days"), x["gaps"].alias("gaps"), M.clock_of(F.try_element_at(x["gaps"], F.lit(2))).alias("first"), M.clock_of(F.try_element_at(x["gaps"], F.lit(3))).alias("second"))

        return let(let(F.struct(M.plain_date_tokens(e["value"], year).alias("days"), F.split(e["value"], M.TOKEN, -1).alias("gaps")), clocks), told)

    def sides(parts: Column) -> Column:
        of = lambda name: F.array_distinct(F.array_compact(F.transform(parts, lambda x: x[name])))
        return F.struct(of("a").alias("starts"), of("b").alias("ends"))

    def decide(x: Column) -> Column:
        ambiguous = (F.size(x["starts"]) > 1) | (F.size(x["ends"]) > 1)
        only = lambda name: F.when(~ambiguous, F.try_element_at(x[name], F.lit(1))).alias(name)
        return F.struct(only("starts"), only("ends"), ambiguous.alias("ambiguous"))

    return let(let(F.transform(F.filter(found, lambda e: e["kind"] == "registration"), read), sides), decide)


def title_registration(title: Column) -> Column:
    """struct(starts, ends, evidence): the window that a title with its own year states after a word of recruiting; null where it states none."""
    day = r"\d{1,2}\s*[./월]\s*\d{1,2}\s*(?:일|\.)?(?:\s*\([월화수목금토일]\))?"

    def parts(plain: Column) -> Column:
        tail = F.regexp_extract(plain, rf"(?s)^.*(?:{P.RECRUITING})(.*)$", 1)
        return F.struct(M.only_year(plain).alias("year"), tail.alias("tail"), F.trim(F.regexp_substr(tail, F.lit(rf"(?:{day})?\s*[~～∼]\s*(?:{day})"))).alias("evidence"))

    def window(x: Column) -> Column:
        own = registration(F.array(F.struct(F.lit("registration").alias("kind"), F.lit("접수기간").alias("label"), F.coalesce(x["evidence"], F.lit("")).alias("value"))), x["year"])
        usable = x["year"].isNotNull() & x["evidence"].isNotNull() & ~x["tail"].rlike(P.OTHER_PERIOD)
        return let(own, lambda w: F.when(usable & w["ends"].isNotNull(), F.struct(w["starts"].alias("starts"), w["ends"].alias("ends"), x["evidence"].alias("evidence"))))

    return let(let(normalize(F.coalesce(title, F.lit(""))), parts), window)


def milestones(text: Column, title: Column) -> Column:
    """array<struct<kind, label, day, clock, evidence>>: labelled milestones of one date each, at most twelve; a label alone takes its date from the next line."""
    return plain_milestones(normalize(F.coalesce(text, F.lit(""))), title)


def plain_milestones(text: Column, title: Column) -> Column:
    """`milestones` of a normalised text."""
    label = lambda line: F.regexp_substr(line, F.lit(P.MILESTONE))
    year = M.only_year(F.coalesce(title, F.lit("")))

    def paired(lines: Column) -> Column:
        after = F.slice(F.concat(lines, F.array(F.lit(""))), F.lit(2), F.size(lines))
        return F.filter(F.zip_with(lines, after, lambda line, then: F.struct(line.alias("line"), then.alias("after"))), lambda x: x["line"].rlike(P.MILESTONE))

    def bodied(x: Column) -> Column:
        body = F.substr(x["line"], F.regexp_instr(x["line"], F.lit(P.MILESTONE)) + F.length(label(x["line"])))
        return F.struct(x["line"].alias("line"), label(x["line"]).alias("label"), F.when(body.rlike(r"\d"), body).otherwise(F.concat_ws(" ", body, x["after"])).alias("body"))

    def read(x: Column) -> Column:
        days = F.array_distinct(F.array_compact(M.plain_date_tokens(x["body"], year)))
        day = let(days, lambda d: F.when(F.size(d) == 1, d[0].cast("string")))
        clock = F.regexp_substr(x["body"], F.lit(r"(?<!\d)(?:[01]?\d|2[0-3]):[0-5]\d(?!\d)"))
        return F.struct(F.when(x["label"].contains("제출"), "submission").otherwise("event").alias("kind"), x["label"].alias("label"), day.alias("day"), clock.alias("clock"), F.left(x["line"], F.lit(350)).alias("evidence"))

    found = F.transform(F.transform(let(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r]"), paired), bodied), read)
    return F.slice(F.array_distinct(F.filter(found, lambda x: x["day"].isNotNull())), 1, 12)
