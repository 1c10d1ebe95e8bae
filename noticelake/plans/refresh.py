"""Which details are read again: what is due, how urgent it is, and a budget shared out fairly among sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How many days a whole reading lasts; the code of what waits for another run.
LASTS, DEFERRED = 2, "budget_deferred"


def last_attempt(attempted: Column, checked: Column) -> Column:
    """The last try at a detail, as text; empty where there was none."""
    return F.coalesce(F.nullif(attempted, F.lit("")), checked, F.lit(""))


def due(version: Column, current: int, attempt: Column, starts: Column, ends: Column, today: Column) -> Column:
    """Whether a detail is to be read: another parser has read it, nobody has, or the last try was before today (two days ago where both dates are known)."""
    missing = (F.coalesce(starts, F.lit("")) == "") | (F.coalesce(ends, F.lit("")) == "")
    since = F.when(missing, today).otherwise(F.date_sub(today, LASTS)).cast("string")
    return ~version.eqNullSafe(F.lit(current)) | (attempt == "") | (F.left(attempt, F.lit(10)) < since)


def urgency(topic_known: Column, ends: Column, attempt: Column) -> Column:
    """0 for a known topic without a deadline, 1 for what nobody has tried, 2 for the rest."""
    return F.when(F.coalesce(topic_known, F.lit(False)) & (F.coalesce(ends, F.lit("")) == ""), 0).when(attempt == "", 1).otherwise(2)


def refresh_plan(items: DataFrame, sources: DataFrame, current: int, today: Column, budget: int) -> DataFrame:
    """id, source_id, urgency, due, taken and date_failure_code of the items that may be read.

    items: id, source_id, relevance_status, detail_attempted_at, detail_checked_at, date_parser_version, registration_start, deadline; ids are unique. sources: source_id, place, enabled; one row a source.
    Excluded items and those of unknown or disabled sources are left out. Sources take turns in the order of `place`, one item each, most urgent and longest untried first, until the budget is spent;
    what is due and not taken is deferred. A source gives at most `budget` items, which limits ranks before and after the exchange; only those are put in one order.
    """
    attempt = last_attempt(F.col("detail_attempted_at"), F.col("detail_checked_at"))
    open_sources = sources.where("enabled").select("source_id", "place")
    may = items.where(~F.coalesce(F.col("relevance_status") == "excluded", F.lit(False))).join(open_sources, "source_id").withColumn("attempt", attempt).select(
        "id", "source_id", "place", "attempt",
        urgency(F.col("relevance_status") == "included", F.col("deadline"), F.col("attempt")).alias("urgency"),
        due(F.col("date_parser_version"), current, F.col("attempt"), F.col("registration_start"), F.col("deadline"), today).alias("due"),
    )
    turn = F.row_number().over(Window.partitionBy("source_id").orderBy("urgency", "attempt", "id"))
    turns = may.where("due").withColumn("turn", turn).where(F.col("turn") <= budget)
    chosen = turns.orderBy("turn", "place", "source_id").limit(budget).select("id", F.lit(True).alias("taken"))
    found = may.join(chosen, "id", "left").withColumn("taken", F.coalesce("taken", F.lit(False)))
    return found.select("id", "source_id", "urgency", "due", "taken", F.when(F.col("due") & ~F.col("taken"), DEFERRED).alias("date_failure_code"))


def deferred(plan: DataFrame, sources: DataFrame) -> DataFrame:
    """source_id, taken and detail_deferred of every source, of those without items too."""
    counts = plan.groupBy("source_id").agg(F.count_if("taken").alias("taken"), F.count_if(F.col("due") & ~F.col("taken")).alias("detail_deferred"))
    return sources.select("source_id").join(counts, "source_id", "left").na.fill(0, ["taken", "detail_deferred"])
