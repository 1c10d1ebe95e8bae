"""What may be shown of a run: steps of a reading, the last collection and the last notification. Everything else stays private."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: How many steps of a reading are shown, and which of their values; which values of a collection; the states of a notification and its stamps.
STEPS, STEP_KEYS = 8, ("stage", "outcome", "code", "text_length", "elapsed_ms")
COLLECTION_KEYS = ("version", "fingerprint", "commit", "run_url", "run_id", "status", "attempted_at", "finished_at", "enabled_sources", "ok_sources")
CLAIM_STATES, CLAIM_STAMPS = ("reserved", "accepted", "scheduled", "failed"), ("at", "accepted_at", "failed_at")
STAMP = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2})(:\d{2})?(\.\d{3}|\.\d{6})?(Z|[+-]\d{2}:\d{2})$"


def public_trace(trace: Column) -> Column:
    """The first steps of a trace (array of maps of texts) with the values that may be shown; null steps are left out, and a null trace has none."""
    shown = F.transform(F.filter(F.slice(trace, 1, STEPS), lambda s: s.isNotNull()), lambda s: F.map_filter(s, lambda k, _: k.isin(*STEP_KEYS)))
    return F.coalesce(shown, F.array().cast("array<map<string,string>>"))


def zoned_stamp(text: Column) -> Column:
    """An ISO instant with an offset, written in full; null for one without an offset and for what is none."""
    day, clock, second, fraction, zone = (F.regexp_extract(text, STAMP, i) for i in range(1, 6))
    whole = F.concat(day, F.lit("T"), clock, F.when(second == "", ":00").otherwise(second))
    parts = F.when(fraction.rlike("^[.]0*$") | (fraction == ""), "").otherwise(F.rpad(fraction, 7, "0"))
    near = F.abs(F.left(F.substring(zone, 2, 5), F.lit(2)).cast("int")) < 24
    valid = text.rlike(STAMP) & F.try_to_timestamp(whole, F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull() & ((zone == "Z") | (near & (F.right(zone, F.lit(2)).cast("int") < 60)))
    return F.when(valid, F.concat(whole, parts, F.when(zone == "Z", "+00:00").otherwise(zone)))


def public_collection(collection: Column, updated_at: Column) -> Column:
    """The values of a collection (map of texts) that may be shown. Without a stated attempt it is the time of the last update, and the state tells whether there was one."""
    shown = F.coalesce(F.map_filter(collection, lambda k, _: k.isin(*COLLECTION_KEYS)), F.create_map().cast("map<string,string>"))
    told = F.coalesce(updated_at, F.lit("")) != ""
    defaults = F.create_map(F.lit("attempted_at"), updated_at, F.lit("status"), F.when(told, "legacy").otherwise("not_started"))
    return let(shown, lambda known: F.map_concat(known, F.map_filter(defaults, lambda k, _: ~F.map_contains_key(known, k))))


def public_notification(claims: Column) -> Column:
    """status, and of the last day its day and stamps, of claims (map of day to map of texts); a state that is not known is `unknown`, and without a day nothing was attempted."""
    last = F.array_max(F.filter(F.map_keys(claims), lambda d: d.rlike(r"^\d{4}-\d{2}-\d{2}$")))

    def told(day: Column) -> Column:
        claim = F.try_element_at(claims, day)
        state = F.try_element_at(claim, F.lit("status"))
        stamps = F.map_from_arrays(F.array(*map(F.lit, CLAIM_STAMPS)), F.array(*[zoned_stamp(F.try_element_at(claim, F.lit(s))) for s in CLAIM_STAMPS]))
        head = F.create_map(F.lit("status"), F.when(state.isin(*CLAIM_STATES), state).otherwise("unknown"), F.lit("day"), day)
        return F.when(day.isNull(), F.create_map(F.lit("status"), F.lit("not_attempted"))).otherwise(F.map_concat(head, F.map_filter(stamps, lambda _, v: v.isNotNull())))

    return let(last, told)
