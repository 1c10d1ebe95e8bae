"""The policy of a state: which sources count, which notices are duplicates, and which are about the topic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U

#: The main site that is collected only on demand, and the mode of a source by its kind.
MAIN_SOURCE, MAIN_HOSTS = "inha", ["www.inha.ac.kr", "inha.ac.kr"]
PLATFORM_MODES = {"campuspick": "ai_platform", "dacon": "candidate_platform", "aifactory": "candidate_platform"}


def effective_sources(sources: DataFrame, strict: bool = True, with_main: bool = False) -> DataFrame:
    """sources(id, url, kind, enabled, mode) as they count at run time: the main site is off unless asked for, and a strict run sets modes by kind."""
    host = F.lower(F.regexp_extract("url", r"^https?://([^/?#:]+)", 1))
    off = (F.col("id") == MAIN_SOURCE) & host.isin(MAIN_HOSTS) & F.lit(not with_main)
    by_kind = F.coalesce(*[F.when(F.col("kind") == kind, mode) for kind, mode in PLATFORM_MODES.items()], F.lit("candidate"))
    changed = {"enabled": F.coalesce("enabled", F.lit(True)) & ~F.coalesce(off, F.lit(False))}
    return sources.withColumns(changed | ({"mode": by_kind} if strict else {}))


def primaries(items: DataFrame) -> DataFrame:
    """items(id, url, first_seen) with address and duplicate_of: of one canonical address the row that carries it, then the oldest, is primary."""
    addressed = items.withColumn("address", U.canonical_url(F.col("url")))
    order = F.struct(F.col("url") != F.col("address"), F.col("first_seen").isNull(), "first_seen", "id")
    first = addressed.where("address <> ''").groupBy("address").agg(F.min_by("id", order).alias("primary"))
    return addressed.join(first, "address", "left").withColumn("duplicate_of", F.when(F.col("primary") != F.col("id"), F.col("primary"))).drop("primary")


def applied(items: DataFrame, sources: DataFrame, strict: bool = True) -> DataFrame:
    """items with the policy applied: title, sane fields, address, duplicate_of, relevance and evidence.

    items(id, source, url, first_seen, detail_title, listing_title, title, organizer, benefits, schedule, summary, body, checked); sources(id, enabled).
    Notices of sources that are switched off are excluded; without the strict policy all others are included.
    """
    off = sources.where("not enabled").select(F.col("id").alias("source"), F.lit(True).alias("off")).distinct()
    title = X.preferred_title(F.col("detail_title"), F.col("listing_title"), F.col("title"))
    rows = primaries(items).join(off, "source", "left").withColumns({"title": title, "organizer": X.sane_organizer(F.col("organizer")), "benefits": X.sane_benefits(F.col("benefits")), "schedule": X.sane_schedule(F.col("schedule"))})
    told = X.classify(F.col("title"), F.col("summary"), F.col("body"), F.col("checked")) if strict else F.struct(F.lit("included").alias("status"), F.lit("").alias("evidence"))
    rows = rows.withColumn("told", told)
    return rows.withColumns({"relevance": F.when(F.col("off"), "excluded").otherwise(F.col("told.status")), "evidence": F.when(F.col("off"), "").otherwise(F.col("told.evidence"))}).drop("told", "off")


def visible(items: DataFrame) -> DataFrame:
    """The notices that the policy shows: included, and no duplicate."""
    return items.where((F.col("relevance") == "included") & F.col("duplicate_of").isNull())
