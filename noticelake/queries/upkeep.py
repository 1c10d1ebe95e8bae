"""Corrections by hand, taken back and applied again, and the budget of refreshed details."""

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import patterns as P
from ..plans import corrections as C
from ..plans.refresh import deferred, refresh_plan
from ..tables import NOTICES_SQL, NOW, Tables, notices
from ..workspace import stored


def _items(t):
    """Notices as items: 25 addresses carry them all, odd ones were read lately."""
    texts = {"registration_start": F.col("opened").cast("string"), "deadline": F.col("deadline").cast("string"), "registration_start_time": F.lit(None).cast("string"), "deadline_time": F.col("deadline_time")}
    kept = [F.lit(False).alias(n) if n in C.FLAGS else F.lit("automatic" if n == "date_status" else None).cast("string").alias(n) for n in P.KEPT_BESIDE]
    checked = F.when(F.col("id") % 2 == 1, "1998-07-20").otherwise("1998-06-01").alias("detail_checked_at")
    url = F.concat(F.lit("https://x.org/n/"), F.col("owner_id") % 25).alias("url")
    return notices(t).select("id", url, checked, *[c.alias(n) for n, c in texts.items()], *kept, F.lit(None).cast(C.AUTOMATIC).alias("automatic"), F.lit(None).cast(C.MANUAL).alias("manual_correction"))


def _entries(t):
    """A correction for four of five nations: another deadline, a clock, no start, a deadline with its clock."""
    n, which = F.col("n_nationkey"), F.col("n_nationkey") % 5
    text = lambda value: F.lit(value).cast("string")
    pairs = lambda *x: F.create_map(*[F.lit(v) if i % 2 == 0 else text(v) for i, v in enumerate(x)])
    fields = F.when(which == 0, pairs("deadline", "2030-12-01")).when(which == 1, pairs("deadline_time", "18:00")).when(which == 2, pairs("registration_start", None)).otherwise(pairs("deadline", "2031-01-01", "deadline_time", "24:00"))
    return t.nation.where(which < 4).select(n.cast("int").alias("place"), F.concat(F.lit("https://X.org/n/"), n, F.lit("?utm_source=a")).alias("url"), F.lit("https://x.org/evidence").alias("evidence_url"), F.lit("1998-07-01").alias("checked_at"), F.lit(" as stated ").alias("reason"), fields.alias("fields"))


def _applied_twice(spark, d):
    """Applied, taken back, read again with other deadlines for every seventh notice, and applied once more."""
    t = Tables(spark, d)
    entries, empty = _entries(t), spark.createDataFrame([], C.TRACKING)
    first, tracking = C.corrected(_items(t), entries, empty, f"{NOW}T00:00:00+09:00")
    again = C.restored(stored(first, "items")).withColumn("deadline", F.when(F.col("id") % 7 == 0, F.date_add("deadline", 1).cast("string")).otherwise(F.col("deadline")))
    return C.corrected(again, entries, tracking, f"{NOW}T12:00:00+09:00")


_AGAIN = f"""{NOTICES_SQL}, i as (select id, (owner_id % 25) % 5 as which, id % 2 = 1 as lately, cast(opened as varchar) as starts, cast(deadline + case when id % 7 = 0 then 1 else 0 end as varchar) as ends, deadline_time as clock from notices)"""


@query(f"""with {_AGAIN} select id, case when which = 2 then null else starts end as registration_start, case which when 0 then '2030-12-01' when 3 then '2031-01-01' else ends end as deadline,
 case which when 0 then null when 1 then '18:00' when 3 then '24:00' else clock end as deadline_time, case when which < 4 then ends end as automatic_deadline, case when which < 4 then clock end as automatic_clock,
 case when which < 4 then id % 7 = 0 and lately end as needs_review, case when which < 4 then 'manual' else 'automatic' end as date_status, case when which < 4 then 'as stated' end as date_evidence from i""")
def corrections_applied(spark, d):
    """What notices say after corrections with evidence; a changed automatic reading asks for review."""
    items, _ = _applied_twice(spark, d)
    return items.select("id", "registration_start", "deadline", "deadline_time", F.col("automatic.deadline").alias("automatic_deadline"), F.col("automatic.deadline_time").alias("automatic_clock"), "manual_correction.needs_review", "date_status", "date_evidence")


@query(f"with {_AGAIN} select id, starts as registration_start, ends as deadline, clock as deadline_time, 'automatic' as date_status from i")
def corrections_restored(spark, d):
    """Corrections taken back: the last automatic reading."""
    items, _ = _applied_twice(spark, d)
    return C.restored(items).select("id", "registration_start", "deadline", "deadline_time", "date_status")


@query(f"with {NOTICES_SQL} select id || ':' as notice, '{NOW}T00:00:00+09:00' as first_applied_at from notices where (owner_id % 25) % 5 < 4")
def corrections_tracked(spark, d):
    """One row a corrected notice and entry, from its first application; applying again adds none."""
    _, tracking = _applied_twice(spark, d)
    return tracking.select(F.regexp_replace("key", ":[0-9a-f]{20}$", ":").alias("notice"), "first_applied_at")


_TRIED = """case when id % 7 = 0 then '' when id % 7 < 4 then cast(deadline - 20 as varchar) else '1998-07-31T09:00:00' end"""
_PLAN = f"""{NOTICES_SQL}, s as (select id, source_id, id % 11 = 0 as topic, {_TRIED} as attempt, deadline_time is null as missing, case when id % 13 = 0 then 4 else 5 end as version from notices where id % 6 <> 0 and source_id <> 3),
 u as (select id, source_id, attempt, case when topic and missing then 0 when attempt = '' then 1 else 2 end as urgency, version <> 5 or attempt = '' or left(attempt, 10) < case when missing then '{NOW}' else '1998-07-30' end as due from s),
 r as (select *, row_number() over (partition by source_id order by urgency, attempt, id) as turn from u where due), c as (select id from r order by turn, 4 - source_id limit 300),
 plan as (select id, source_id, urgency, due, id in (select id from c) as taken from u)"""


def _refreshed(spark, d):
    t = Tables(spark, d)
    tried = F.when(F.col("id") % 7 == 0, "").when(F.col("id") % 7 < 4, F.date_sub("deadline", 20).cast("string")).otherwise("1998-07-31T09:00:00")
    status = F.when(F.col("id") % 6 == 0, "excluded").when(F.col("id") % 11 == 0, "included").otherwise("pending")
    ends = F.when(F.col("deadline_time").isNotNull(), F.col("deadline").cast("string"))
    items = notices(t).select("id", "source_id", status.alias("relevance_status"), F.when(F.col("id") % 3 == 0, tried).alias("detail_attempted_at"), F.when(F.col("id") % 3 != 0, tried).alias("detail_checked_at"), F.when(F.col("id") % 13 == 0, 4).otherwise(5).alias("date_parser_version"), F.col("opened").cast("string").alias("registration_start"), ends.alias("deadline"))
    sources = t.region.select(F.col("r_regionkey").cast("long").alias("source_id"), (4 - F.col("r_regionkey")).alias("place"), (F.col("r_regionkey") != 3).alias("enabled"))
    return refresh_plan(items, sources, 5, F.lit(NOW).cast("date"), 300), sources


@query(f"with {_PLAN} select id, source_id, urgency, due, taken, case when due and not taken then 'budget_deferred' end as date_failure_code from plan")
def refresh_budget(spark, d):
    """Details to read again: parser, age by completeness, urgency, and turns of the sources."""
    return _refreshed(spark, d)[0]


@query(f"with {_PLAN} select cast(r_regionkey as bigint) as source_id, count(id) filter (where taken) as taken, count(id) filter (where due and not taken) as detail_deferred from region left join plan on r_regionkey = source_id group by 1")
def refresh_deferred(spark, d):
    """What each source gave and what it has to leave for another run."""
    return deferred(*_refreshed(spark, d))
