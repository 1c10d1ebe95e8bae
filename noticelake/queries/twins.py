"""Streaming twins, drained over the event table and checked against batch SQL."""

from pyspark.sql import functions as F

from ..catalog import query
from ..operators.upsert import Rules
from ..streaming import twins as S
from ..tables import OBSERVATIONS_SQL


def _events(spark, d):
    rows = S.table_stream(spark, d, "events")
    return rows.select(F.concat(F.col("user_id"), F.lit(":"), F.col("event_type")).alias("notice"), F.col("ts").alias("seen_at"), "event_id")


@query(f"with {OBSERVATIONS_SQL} select notice, min(seen_at) as first_seen, count(*) as sightings from observations group by 1")
def stream_first_seen(spark, d):
    return S.latest(S.drained(S.first_seen(_events(spark, d)), "first-seen", "update"), "notice", ["first_seen", "sightings"])


@query("select cast(ts + interval 9 hours as date) as day, count(*) as n from events group by 1")
def stream_day_buckets(spark, d):
    return S.latest(S.drained(S.day_buckets(_events(spark, d), 9), "day-buckets", "update"), "day", ["n"])


@query("select event_id, hour(ts) >= 12 as late from events")
def stream_late_flag(spark, d):
    return S.drained(S.late_flag(_events(spark, d), 12), "late-flag").select("event_id", "late")


@query("select cast(ts as date) as day, min(event_id) as run from events where event_type = 'click' group by 1")
def stream_claims(spark, d):
    """One claim a day in a stream."""
    events = S.table_stream(spark, d, "events").where("event_type = 'click'").select(F.col("ts").cast("date").alias("day"), F.col("event_id").alias("run"))
    return S.claim_stream(events, "day", ["run"])


@query("select o_orderkey as id, o_custkey % 5 as source, o_orderpriority as title, case when o_custkey % 5 < 4 then 'new' else 'initial' end as change from orders")
def stream_merge(spark, d):
    """The change log of a stream that is merged into a state."""
    rows = S.table_stream(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).alias("source"), F.col("o_orderpriority").alias("title"))
    ready = spark.range(4).select(F.col("id").alias("source"))
    _, log = S.merge_stream(rows, Rules("id", "source", ["source", "title"], ["title"]), ready, F.lit("1998-08-01").cast("timestamp_ntz"))
    return log.select("id", "source", "title", "change")


@query("select count(distinct user_id || ':' || event_type) as notices from events")
def stream_expiry(spark, d):
    """Each notice once; its state goes when it was not seen for two weeks."""
    events = _events(spark, d).withColumn("seen_at", F.col("seen_at").cast("timestamp"))
    first = S.drained(S.within(events, "notice", "seen_at", 14), "expiry")
    return first.agg(F.count_distinct("notice").alias("notices"))
