"""Date and time expressions. `now` is always an argument; what is contradictory or invalid is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import let, normalize


def valid_day(text: Column) -> Column:
    """A strict yyyy-MM-dd date, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def clock_minutes(text: Column) -> Column:
    """Minutes of HH:MM; 24:00 is legal and anything else past 23:59 is null."""
    hour, minute = (F.regexp_extract(text, r"^(\d{2}):(\d{2})$", i) for i in (1, 2))
    return F.when(text.rlike(r"^([01]\d|2[0-3]):[0-5]\d$|^24:00$"), hour.cast("int") * 60 + minute.cast("int"))


def exact_instant(day: Column, clock: Column, ambiguous: Column) -> Column:
    """The instant of a day and clock; null where either is missing or ambiguous. 24:00 is the next midnight."""
    minutes = clock_minutes(clock)
    return F.when(~F.coalesce(ambiguous, F.lit(False)) & minutes.isNotNull(), F.timestamp_add("MINUTE", minutes, day.cast("timestamp_ntz")))


def status_at(now: Column, deadline: Column, ends: Column, opened: Column, platform: Column, last_seen: Column, starts: Column | None = None, ambiguous: Column | None = None) -> Column:
    """closed, upcoming, active or unknown at an instant.

    `ends` and `starts` are the exact instants of the deadline and the opening where their clocks are known.
    Ambiguous dates count as none. A platform that says open is believed if the notice was seen in the last three days.
    """
    today = now.cast("date")
    clear = ~F.coalesce(ambiguous, F.lit(False)) if ambiguous is not None else F.lit(True)
    deadline, ends, opened = (F.when(clear, x) for x in (deadline, ends, opened))
    starts = F.when(clear, starts) if starts is not None else F.lit(None).cast("timestamp_ntz")
    return (
        F.when(platform == "closed", "closed")
        .when(F.coalesce(ends <= now, deadline < today), "closed")
        .when(opened.isNotNull() & F.coalesce(starts > now, opened > today), "upcoming")
        .when(deadline.isNotNull(), "active")
        .when((platform == "open") & last_seen.between(F.date_sub(today, 3), today), "active")
        .otherwise("unknown")
    )


def _iso_day(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def _full_day(token: Column) -> Column:
    return _iso_day(*[F.regexp_extract(token, r"^(\d+)\D+(\d+)\D+(\d+)", i) for i in (1, 2, 3)])


def extract_dates(text: Column) -> Column:
    """All valid dates with a year of a text, in order; invalid ones are dropped."""
    found = F.regexp_extract_all(text, F.lit(P.FULL_DATE), F.lit(0))
    return F.filter(F.transform(found, _full_day), lambda x: x.isNotNull())


TOKEN = f"{P.FULL_DATE}|{P.SHORT_DATE}"


def years_of(text: Column) -> Column:
    """The distinct years that stand alone in a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<!\d)(20\d{2})(?!\d)"), F.lit(1)))


def only_year(text: Column) -> Column:
    return let(years_of(text), lambda years: F.when(F.size(years) == 1, years[0]))


def date_tokens(text: Column, year: Column) -> Column:
    """The dates of a text in order, null where one is impossible. Dates without a year take the only year of the other dates, else `year`; with neither they are no dates."""
    return plain_date_tokens(normalize(text), year)


def plain_date_tokens(text: Column, year: Column) -> Column:
    """date_tokens of a text that is normalised already."""
    full = lambda x: x.rlike(r"^20\d{2}\s*[.\-/년]")
    short = lambda x, i: F.regexp_extract(x, r"^(\d+)\D+(\d+)", i)

    def dated(tokens: Column) -> Column:
        years = F.array_distinct(F.transform(F.filter(tokens, full), lambda x: F.left(x, F.lit(4))))
        own = let(years, lambda y: F.when(F.size(y) == 1, y[0]).otherwise(year.cast("string")))
        return let(own, lambda y: F.transform(F.filter(tokens, lambda x: full(x) | y.isNotNull()), lambda x: F.when(full(x), _full_day(x)).otherwise(_iso_day(y, short(x, 1), short(x, 2)))))

    return let(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), dated)


def date_range(days: Column) -> Column:
    """struct(starts, ends) of exactly two valid dates in order, else null."""
    pair = (F.size(days) == 2) & days[0].isNotNull() & (days[0] <= days[1])
    return F.when(pair, F.struct(days[0].alias("starts"), days[1].alias("ends")))


def clock_of(text: Column) -> Column:
    """The first clock of a text as HH:MM; halves of the day are resolved, impossible clocks are null."""
    pattern = r"(?iu)(?:(오전|오후|AM|PM)\s*)?(?<!\d)(\d{1,2})\s*(?::\s*(\d{2})|시\s*(?:(\d{1,2})\s*분)?)(?!\d)"

    def parts(found: Column) -> Column:
        part = lambda i: F.regexp_extract(found, pattern, i)
        minute = F.coalesce(F.nullif(part(3), F.lit("")), F.nullif(part(4), F.lit("")), F.lit("0")).cast("int")
        return F.struct(F.lower(part(1)).alias("half"), part(2).cast("int").alias("hour"), minute.alias("minute"))

    def turned(x: Column) -> Column:
        hour = F.when(x["half"] == "", x["hour"]).when(x["hour"].between(1, 12), x["hour"] % 12 + F.when(x["half"].isin("오후", "pm"), 12).otherwise(0))
        return F.struct(hour.alias("hour"), x["minute"].alias("minute"))

    def shown(x: Column) -> Column:
        valid = (x["minute"] <= 59) & ((x["hour"] < 24) | ((x["hour"] == 24) & (x["minute"] == 0)))
        return F.when(valid, F.concat(F.lpad(x["hour"].cast("string"), 2, "0"), F.lit(":"), F.lpad(x["minute"].cast("string"), 2, "0")))

    return let(let(let(F.regexp_substr(text, F.lit(pattern)), parts), turned), shown)


ZONE = "Asia/Seoul"
#: How long before its clock a daily run may start, and the clock of days whose message is switched off.
LEAD_MINUTES, NOON = 25, "12:00"


def instant(text: Column) -> Column:
    """The instant of an ISO text with an offset or Z; null for texts without one, whose place on the clock of the world is not known."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})$"), F.regexp_replace(F.regexp_replace(text, r"^(.{16})(?=\s*[Z+-])", "$1:00"), r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp"))


def zoned_instant(day: Column, clock: Column, zone: Column, ambiguous: Column) -> Column:
    """The instant of a day (yyyy-MM-dd) and a clock (HH:MM[:SS], or 24:00) in a named zone of the tz database; without a zone in Korea's.

    Null where a part is missing, impossible or ambiguous, or the zone is unknown or a bare offset. A clock that a zone skips in spring counts as the same time by the offset before; of a clock
    that a zone has twice in autumn the first counts.
    """
    date = valid_day(day)
    midnight = clock.rlike(r"^24:00(:00)?$")
    plain = F.when(midnight, F.date_add(date, 1)).otherwise(date).cast("string")
    time = F.when(midnight, "00:00:00").when(F.length(clock) == 5, F.concat(clock, F.lit(":00"))).otherwise(clock)
    named = F.coalesce(zone, F.lit(ZONE))
    usable = date.isNotNull() & ~F.coalesce(ambiguous, F.lit(False)) & clock.rlike(r"^(([01]\d|2[0-3]):[0-5]\d(:[0-5]\d)?|24:00(:00)?)$") & named.rlike(r"^(UTC|GMT|[A-Za-z_]+(/[A-Za-z0-9_+-]+)+)$")
    return F.when(usable, F.concat_ws(" ", plain, time, named).try_cast("timestamp"))


def due(now: Column, clock: Column, enabled: Column, claimed: Column) -> Column:
    """struct(run, day, target, reason): whether the daily run of the day of `now` (an instant) is due in Korea.

    It is from 25 minutes before the clock on, once a day; where messages are switched off the data are still read, at noon.
    """
    local = F.to_timestamp_ntz(F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(ZONE), F.convert_timezone(F.current_timezone(), F.lit("UTC"), now.cast("timestamp_ntz"))), "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    at = F.when(F.coalesce(enabled, F.lit(True)), F.coalesce(clock, F.lit(NOON))).otherwise(F.lit(NOON))

    def told(x: Column) -> Column:
        target = F.timestamp_add("MINUTE", clock_minutes(at), x.cast("date").cast("timestamp_ntz"))
        open_ = x >= F.timestamp_add("MINUTE", F.lit(-LEAD_MINUTES), target)
        taken = F.coalesce(claimed, F.lit(False))
        reason = F.when(taken, "already_attempted").when(open_, "due").otherwise("before_window")
        return F.struct((open_ & ~taken).alias("run"), x.cast("date").alias("day"), F.when(~taken, target).alias("target"), reason.alias("reason"))

    return let(local, told)
