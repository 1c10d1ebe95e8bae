"""Why a date is or is not known, and what a source's notices say about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import timing as M


def reason(item: DataFrame | None = None) -> Column:
    """One reason a notice, from the columns manual, needs_review, deadline, registration_start, registration_ambiguous, date_status, date_failure_code, detail_status and detail_attempted_at.

    A correction by hand comes first; a known date may be confirmed, half known, kept from a time before an error, or waiting for its next reading; an unknown one has the
    collector's own code, where it is a known one, or what its last reading tells.
    """
    col = F.col if item is None else item.__getitem__
    true = lambda name: F.coalesce(col(name), F.lit(False))
    code = F.nullif(col("date_failure_code"), F.lit(""))
    day = lambda name: M.valid_day(col(name)).isNotNull()
    known = F.coalesce(day("deadline"), F.lit(False)) & ~true("registration_ambiguous")
    failed = F.coalesce(col("detail_status") == "error", F.lit(False))
    return (
        F.when(true("manual"), F.when(true("needs_review"), "manual_review").otherwise("manual_date"))
        .when(known & (code == "budget_deferred"), "cached_date")
        .when(known & (failed | F.coalesce(code != "confirmed", F.lit(False))), "stale_evidence")
        .when(true("registration_ambiguous") | (col("date_status") == "conflict"), "date_conflict")
        .when(known, F.when(day("registration_start"), "confirmed").otherwise("partial_date"))
        .when(code.isNotNull(), F.when(code.isin(*P.REPORTED_REASONS) | code.startswith("http_"), code).otherwise("parser_error"))
        .when(F.coalesce(col("detail_attempted_at"), F.lit("")) == "", "not_requested")
        .when(failed, "network_error")
        .when(day("registration_start"), "partial_date")
        .otherwise("no_explicit_date")
    )


def report(items: DataFrame) -> DataFrame:
    """source_id, denominator, deadline_known, start_and_end_known, deadline_time_known, manual_count, deadline_coverage (percent with one decimal) and reasons (a map of counts) by source.

    items(source_id, deadline_time, registration_time_ambiguous and the columns of `reason`), of which only those that are shown should be given. One aggregation with partial sums: a row
    a source and reason, then a row a source.
    """
    known = F.coalesce(M.valid_day(F.col("deadline")).isNotNull(), F.lit(False)) & ~F.coalesce("registration_ambiguous", F.lit(False))
    timed = known & M.exact_instant(F.to_date("deadline"), F.col("deadline_time"), F.col("registration_time_ambiguous")).isNotNull()
    both = known & F.coalesce(M.valid_day(F.col("registration_start")).isNotNull(), F.lit(False))
    flags = {"deadline_known": known, "start_and_end_known": both, "deadline_time_known": timed, "manual_count": F.coalesce("manual", F.lit(False))}
    parts = items.withColumn("reason", reason()).groupBy("source_id", "reason").agg(F.count("*").alias("n"), *[F.sum(flag.cast("long")).alias(name) for name, flag in flags.items()])
    rows = parts.groupBy("source_id").agg(F.sum("n").alias("denominator"), *[F.sum(name).alias(name) for name in flags], F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reasons"))  # at most one entry a reason
    return rows.withColumn("deadline_coverage", F.round(100 * F.col("deadline_known") / F.col("denominator"), 1))
