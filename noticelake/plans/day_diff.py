"""Completeness-aware day-over-day diff of an observation log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshots(observed: DataFrame, weak: str) -> DataFrame:
    """(day, source, fresh, seen, status): first sightings and rows of every source and day; a source whose rows are mostly `weak` is partial."""
    first = observed.groupBy("notice", "source").agg(F.min("day").alias("day")).groupBy("day", "source").agg(F.count("*").alias("fresh"))
    rows = observed.groupBy("day", "source").agg(F.count("*").alias("seen"), F.count_if(F.expr(weak)).alias("weak"))
    status = F.when(F.col("weak") * 2 > F.col("seen"), "partial").otherwise("ok")
    return rows.join(first, ["day", "source"], "left").select("day", "source", F.coalesce("fresh", F.lit(0)).alias("fresh"), "seen", status.alias("status"))


def day_diff(observed: DataFrame, weak: str) -> DataFrame:
    """(day, source, comparison, new_count, unverified_count) for every day and source after the first day.

    comparison is `comparable` where the day before was observed and `gap` otherwise. First sightings are
    new where the source's previous day was complete, else unverified; a partial source never reports
    its zero as complete. The log is read once; both shuffles are on pre-aggregated rows.
    """
    by_source = Window.partitionBy("source").orderBy("day")
    rows = snapshots(observed, weak).withColumns({"previous": F.lag("day").over(by_source), "before": F.lag("status").over(by_source)})
    compared = rows.where("previous is not null").withColumn("comparison", F.when(F.date_diff("day", "previous") == 1, "comparable").otherwise("gap"))
    verified = F.col("before") == "ok"
    return compared.select("day", "source", "comparison", F.when(verified, F.col("fresh")).otherwise(0).cast("long").alias("new_count"), F.when(verified, 0).otherwise(F.col("fresh")).cast("long").alias("unverified_count"))
