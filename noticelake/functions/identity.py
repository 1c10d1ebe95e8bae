"""What tells the real event behind a notice: official ids, scopes and comparable titles, as column expressions, and the input of guarded grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P
from . import text as X
from . import timing as M
from . import urls as U
from .text import let

LINKED = "linked:"


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)


def platform_event(url: Column) -> Column:
    """platform:kind:number of an address of a platform that numbers its events, else ''."""

    def told(plain: Column) -> Column:
        found = F.lit("")
        for name, (hosts, pattern) in P.PLATFORM_EVENTS.items():
            kind, number = (F.regexp_extract(_path(plain), pattern, i) for i in (1, 2))
            found = F.when(_host(plain).isin(*hosts) & (number != ""), F.concat_ws(":", F.lit(name), F.nullif(kind, F.lit("")), number)).otherwise(found)
        return found

    return let(U.canonical_url(F.coalesce(url, F.lit(""))), told)


def official_key(url: Column, application: Column, website: Column, date_source: Column) -> Column:
    """The notice's own platform id, else the only platform id that it links to; several give none. Without one, the first linked address of a single event, as `linked:<address>`."""
    links = F.array(*[U.canonical_url(F.coalesce(x, F.lit(""))) for x in (application, website, date_source)])

    def chosen(x: Column) -> Column:
        known = F.array_distinct(F.filter(F.transform(x["links"], platform_event), lambda k: k != ""))
        own_page = lambda v: (v != "") & ~_host(v).rlike("|".join(h.replace(".", r"\.") for h in P.BOARD_HOSTS)) & _path(v).rlike(f"(?i){P.EVENT_ADDRESS}")
        linked = F.try_element_at(F.filter(F.slice(x["links"], 1, 2), own_page), F.lit(1))
        several = lambda k: F.when(F.size(k) == 1, k[0]).when(F.size(k) > 1, "").otherwise(F.coalesce(F.concat(F.lit(LINKED), linked), F.lit("")))
        return F.when(x["own"] != "", x["own"]).otherwise(let(known, several))

    return let(F.struct(platform_event(url).alias("own"), links.alias("links")), chosen)


def scope(title: Column, starts: Column, ends: Column) -> Column:
    """struct(years, scope): the years that a title names, else those of its valid dates, and the rounds, audiences and tracks that it names."""
    found = lambda pattern, i="i": F.array_sort(F.regexp_extract_all(title, F.lit(f"(?{i}u){pattern}"), F.lit(0)))
    dated = F.array_distinct(F.array_compact(F.array(*[F.when(M.valid_day(x).isNotNull(), F.left(x, F.lit(4))) for x in (starts, ends)])))
    years = let(M.years_of(title), lambda named: F.array_sort(F.when(F.size(named) > 0, named).otherwise(dated)))
    # letters count as they are written in audiences and tracks
    return F.struct(years.alias("years"), F.array_join(F.concat(found(P.ROUNDS), found(P.AUDIENCES, ""), found(P.NAMED_TRACKS, "")), "\u0001").alias("scope"))


def comparable_title(title: Column, organizer: Column, starts: Column, ends: Column, years: Column) -> Column:
    """title|organizer|start|end without blanks and signs; empty where one of them says too little or no year is known."""
    plain = lambda x: F.lower(F.regexp_replace(x, r"(?U)[\s\W_]+", ""))
    bare = F.regexp_replace(F.regexp_replace(title, P.TITLE_BADGE, ""), P.TITLE_NOTE, "")
    parts = F.struct(plain(bare).alias("title"), plain(F.coalesce(organizer, F.lit(""))).alias("by"))
    enough = lambda x: (F.length(x["title"]) >= 12) & (F.length(x["by"]) >= 2) & (F.size(years) > 0) & M.valid_day(starts).isNotNull() & M.valid_day(ends).isNotNull()
    return let(parts, lambda x: F.when(enough(x), F.concat_ws("|", x["title"], x["by"], starts, ends)).otherwise(""))


def identified(items: DataFrame) -> DataFrame:
    """(id, first_seen, scope, years, keys, official) of items(id, first_seen, title, url, application_url, website_url, date_source_url, organizer, registration_start, deadline): what `grouped` takes.

    Titles are preferred ones, dates are texts. Absent values are null.
    """
    plain = X.preferred_title(F.col("title"))
    told = items.select(
        "id", "first_seen", scope(plain, F.col("registration_start"), F.col("deadline")).alias("told"), plain.alias("plain"), "organizer", "registration_start", "deadline",
        official_key(F.col("url"), F.col("application_url"), F.col("website_url"), F.col("date_source_url")).alias("key"),
    )
    title = comparable_title(F.col("plain"), F.col("organizer"), F.col("registration_start"), F.col("deadline"), F.col("told.years"))
    keys = F.array_compact(F.array(F.nullif("key", F.lit("")), F.concat(F.lit("title:"), F.nullif(title, F.lit("")))))
    return told.select("id", "first_seen", "told.scope", "told.years", keys.alias("keys"), F.when((F.col("key") != "") & ~F.col("key").startswith(LINKED), F.col("key")).alias("official"))
