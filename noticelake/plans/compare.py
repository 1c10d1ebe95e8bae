"""Comparison of an observation with the last snapshot before it, and alerts on falling quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INCOMPLETE = ["partial", "error", "pending"]


def base_snapshot(days: DataFrame, today: Column) -> DataFrame:
    """The latest of days(day, at) before today, as one row (base_day, base_at); no row without one."""
    return days.where(F.col("day") < today).groupBy().agg(F.max(F.struct("day", "at")).alias("of")).where("of is not null").select(F.col("of.day").alias("base_day"), F.col("of.at").alias("base_at"))


def status_of_day(days: DataFrame, sources: DataFrame, before: DataFrame, today: Column, observed: Column) -> DataFrame:
    """One row (status, base_day, base_at, partial) for today.

    status: stale (nothing observed today), baseline (no earlier snapshot), unobserved (no source answered), comparable (the base is yesterday) or gap.
    days(day, at) are the snapshots; sources(source, status) and before(source, status) what each source did now and then. `partial`: some source was incomplete on either side.
    """
    now = sources.where("status <> 'disabled'").alias("n").join(before.select(F.col("source").alias("of"), F.col("status").alias("old")).alias("b"), F.col("n.source") == F.col("of"), "left")
    answers = now.groupBy().agg(
        F.coalesce(F.some(F.col("n.status").isin("ok", "partial")), F.lit(False)).alias("answered"),
        F.coalesce(F.some(F.col("n.status").isin(INCOMPLETE) | F.coalesce(F.col("old").isin(INCOMPLETE), F.lit(False))), F.lit(False)).alias("partial"),
    )
    one = answers.join(base_snapshot(days, today), F.lit(True), "left")  # one row beside at most one
    status = (
        F.when(observed.cast("date") != today, "stale").when(F.col("base_day").isNull(), "baseline").when(observed.isNull() | ~F.col("answered"), "unobserved")
        .when(F.date_diff(today, "base_day") == 1, "comparable").otherwise("gap")
    )
    return one.select(status.alias("status"), "base_day", "base_at", "partial")


def classes_of_day(items: DataFrame, base_ids: DataFrame, before: DataFrame, changes: DataFrame, base_at: Column, observed: Column, aliases: DataFrame | None = None) -> DataFrame:
    """(id, source, kind) of every item that is new, initial, unverified or updated since the base snapshot.

    items(id, source) are today's; base_ids(id) those of the base, by their names of then; before(source, status) the sources that were initialised
    at the base; changes(id, kind, at) the log, read between base and observation; aliases(old_id, id) the names of now. An item that the base
    lacks is initial where it was imported or its source is younger than the base, unverified where the source was not complete then, else new.
    """
    known = base_ids.select("id").distinct()
    if aliases is not None:
        known = known.join(aliases.select(F.col("old_id").alias("id"), F.col("id").alias("to")), "id", "left").select(F.coalesce("to", "id").alias("id")).distinct()
    recent = changes.where((F.col("at") > base_at) & (F.col("at") <= observed))
    log = recent.groupBy("id").agg(F.some(F.col("kind") == "initial").alias("imported"), F.some(F.col("kind") == "updated").alias("updated"))
    rows = items.select("id", "source").join(known.withColumn("old", F.lit(True)), "id", "left").join(log, "id", "left")
    rows = rows.join(before.select(F.col("source").alias("of"), F.col("status").alias("was")), F.col("source") == F.col("of"), "left")
    kind = (
        F.when(F.col("old"), F.when(F.col("updated"), "updated"))
        .when(F.coalesce(F.col("imported"), F.lit(False)) | F.col("of").isNull(), "initial").when(F.coalesce(F.col("was"), F.lit("")) != "ok", "unverified").otherwise("new")
    )
    return rows.select("id", "source", kind.alias("kind")).where("kind is not null")


def regressions(samples: DataFrame, statuses: DataFrame, at_least: int = 5, drop: int = 3, share: float = 0.3) -> DataFrame:
    """(day, source, common, previous_known, current_known, regressed, failed): each day of a source against the day before, on the notices of both.

    samples(day, source, notice, known) has one row a notice of a day; statuses(day, source, status). Days with fewer than `at_least` rows, or common
    notices, are not compared. A fall of at least `drop` known ones and of `share` of the common ones is a regression; a source that was ok and now
    errs has failed. Flat equi-joins on (source, day, notice) and partial counts: no notice list is ever gathered.
    """
    rows = samples.groupBy("source", "day", "notice").agg(F.max("known").alias("known"))
    sizes = rows.groupBy("source", "day").agg(F.count("*").alias("items"))
    before = rows.select("source", F.date_add("day", 1).alias("day"), "notice", F.col("known").alias("was"))
    both = rows.join(before, ["source", "day", "notice"]).groupBy("source", "day").agg(F.count("*").alias("common"), F.count_if("was").alias("previous_known"), F.count_if("known").alias("current_known"))
    old = sizes.select("source", F.date_add("day", 1).alias("day"), F.col("items").alias("old_items"))
    enough = both.join(sizes, ["source", "day"]).join(old, ["source", "day"]).where((F.col("items") >= at_least) & (F.col("old_items") >= at_least) & (F.col("common") >= at_least))
    now = statuses.select("source", "day", "status")
    then = statuses.select("source", F.date_add("day", 1).alias("day"), F.col("status").alias("old_status"))
    lost = F.col("previous_known") - F.col("current_known")
    told = enough.join(now, ["source", "day"], "left").join(then, ["source", "day"], "left")
    return told.select(
        "day", "source", "common", "previous_known", "current_known", ((lost >= drop) & (lost / F.col("common") >= share)).alias("regressed"),
        F.coalesce((F.col("old_status") == "ok") & (F.col("status") == "error"), F.lit(False)).alias("failed"),
    )
