"""Requests to change the state: a closed world of kinds and fields, as a table of rules that a payload may break."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import timing as M
from . import urls as U

#: The fields of each kind of request, the kinds of errors that can be reported, and how long texts may be.
FIELDS = {
    "add_notice": ["url", "title", "summary", "organizer", "eligibility", "deadline", "registration_start", "deadline_time", "evidence_url", "checked_at"],
    "correct_notice": ["url", "title", "exclude", "deadline", "registration_start", "deadline_time", "evidence_url", "checked_at", "reason"],
    "report": ["url", "id", "category", "description"],
}
CATEGORIES = ["date", "title", "irrelevant", "duplicate", "broken_link", "other"]
LIMITS = {"title": 240, "summary": 500, "organizer": 200, "eligibility": 350, "reason": 300, "description": 800, "id": 120}
CHANGED = ["title", "exclude", "deadline", "registration_start", "deadline_time"]
NAMES = list(dict.fromkeys(name for names in FIELDS.values() for name in names))
DAYS = ["checked_at", "registration_start", "deadline"]
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"


def broken_rules(kind: Column, payload: Column, today: Column) -> Column:
    """The names of the rules that a payload (JSON text) of a request of a kind breaks, in order; empty for a valid request.

    payload: no object; kind: unknown; fields: unknown ones; then the rules of single fields by name, order (start after deadline), clock_alone (a clock without a deadline), future (checked
    later than `today`), nothing (a correction of nothing).
    """
    is_object = lambda tree: F.coalesce(F.schema_of_variant(tree).startswith("OBJECT"), F.lit(False))
    field = lambda name, value: F.struct(F.schema_of_variant(value).alias("kind"), F.try_variant_get(value, "$", "string").alias("text"))
    texts = lambda fields: {n: F.when(F.element_at(fields, n)["kind"] == "STRING", F.element_at(fields, n)["text"]) for n in NAMES}

    def read(fields: Column) -> Column:
        """What the rules look at: keys, the kind and text of every known field, and days."""
        found = texts(fields)
        kinds = [F.element_at(fields, n)["kind"].alias(n) for n in NAMES]
        days = [M.valid_day(found[n]).alias(n) for n in DAYS]
        return F.struct(F.map_keys(fields).alias("keys"), F.struct(*kinds).alias("kinds"), F.struct(*[x.alias(n) for n, x in found.items()]).alias("texts"), F.struct(*days).alias("days"))

    # each step is worked out once a payload: a list of one goes through it
    trees = F.array(F.try_parse_json(payload))
    fields = F.transform(trees, lambda tree: F.when(is_object(tree), F.transform_values(F.try_variant_get(tree, "$", "map<string,variant>"), field)))
    return F.flatten(F.transform(F.transform(fields, read), lambda parts: _broken(kind, parts, today)))


def _broken(kind: Column, parts: Column, today: Column) -> Column:
    """The rules that a payload breaks which has been read into its parts."""
    keys, days = parts["keys"], parts["days"]
    is_object = keys.isNotNull()
    kind_of = lambda name: parts["kinds"][name]
    text = lambda name: parts["texts"][name]
    has = lambda name: F.coalesce(F.array_contains(keys, name), F.lit(False))
    add, correct, report = (is_object & (kind == x) for x in ("add_notice", "correct_notice", "report"))
    edits = add | correct
    known = F.coalesce(kind.isin(*FIELDS), F.lit(False))

    def spoken(name: str) -> Column:
        """A text that is there, says something, and is neither too long nor holds control signs."""
        x = text(name)
        return F.coalesce((F.length(x) <= LIMITS[name]) & ~x.rlike(CONTROL) & (F.trim(x) != ""), F.lit(False))

    day = lambda name: days[name].isNotNull()
    free = lambda name: has(name) & (kind_of(name) != "VOID") & ~day(name)
    unknown = F.lit(False)
    for of, names in FIELDS.items():
        unknown = unknown | ((kind == of) & (F.size(F.array_except(keys, F.array(*[F.lit(n) for n in names]))) > 0))
    clock = text("deadline_time")
    given_clock = has("deadline_time") & (kind_of("deadline_time") != "VOID") & (F.coalesce(clock, F.lit("?")) != "")
    rules = {
        "payload": ~is_object, "kind": is_object & ~known, "fields": is_object & unknown,
        "url": is_object & known & ~U.public_url(F.coalesce(text("url"), F.lit(""))),
        "category": report & ~F.coalesce(text("category").isin(*CATEGORIES), F.lit(False)), "description": report & ~spoken("description"), "id": report & has("id") & ~F.coalesce((F.length(text("id")) <= LIMITS["id"]) & ~text("id").rlike(CONTROL), F.lit(False)),
        "evidence_url": edits & ~U.public_url(F.coalesce(text("evidence_url"), F.lit(""))), "checked_at": edits & ~day("checked_at"), "future": edits & day("checked_at") & (days["checked_at"] > today),
        "title": (add | (correct & has("title"))) & ~spoken("title"), "summary": add & ~spoken("summary"), "organizer": edits & has("organizer") & ~spoken("organizer"), "eligibility": edits & has("eligibility") & ~spoken("eligibility"),
        "reason": correct & ~spoken("reason"), "exclude": correct & has("exclude") & (kind_of("exclude") != "BOOLEAN"),
        "registration_start": edits & free("registration_start"), "deadline": edits & free("deadline"), "order": edits & (days["registration_start"] > days["deadline"]),
        "deadline_time": edits & given_clock & ~F.coalesce(clock.rlike(r"^(?:[01]\d|2[0-3]):[0-5]\d$"), F.lit(False)), "clock_alone": edits & given_clock & ~day("deadline"),
        "nothing": correct & ~F.greatest(*[has(n) for n in CHANGED]),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()]))
