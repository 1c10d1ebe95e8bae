"""Dates, clocks, instants and status."""

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import timing as M
from ..tables import NOTICES_SQL, NOW, Tables, notices

_NOW = f"timestamp '{NOW} 00:00:00'"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


@query("""select o_orderkey, strftime(o_orderdate + interval 20 year, '%Y-%m-%d') || ',' || strftime(cast(o_orderdate + interval 20 year as date) + 9, '%Y-%m-%d') || case when o_orderkey % 3 = 0 then ',' || strftime(o_orderdate + interval 20 year, '%Y-%m-28') else '' end as days from orders""")
def extract_dates(spark, d):
    """Dates out of a labelled text, in several notations; an impossible date in between, and longer numbers, are none. The order dates lie twenty years later here."""
    day = F.add_months(F.col("o_orderdate").cast("date"), 240)
    more = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(", "), F.date_format(day, "yyyy년 M월"), F.lit(" 28일 마감"))).otherwise(F.concat(F.lit(" 1"), F.date_format(day, "yyyy-MM-dd"), F.lit(" 12026-01-01 2026-01-012")))
    text = F.concat(F.lit("접수기간: "), F.date_format(day, "yyyy. M. d."), F.lit(" ~ 2026-13-45, "), F.date_format(F.date_add(day, 9), "yyyy/MM/dd"), more)
    return Tables(spark, d).orders.select("o_orderkey", F.array_join(F.transform(M.extract_dates(text), lambda x: x.cast("string")), ",").alias("days"))


@query("select o_orderkey, cast(o_orderdate as date) as starts, cast(cast(o_orderdate as date) + 9 as date) as ends from orders where o_orderkey % 3 <> 0 and o_orderdate >= timestamp '2000-01-01'")
def date_range(spark, d):
    """Exactly two ordered dates make a range; reversed ones give nothing."""
    day = F.col("o_orderdate").cast("date")
    a, b = F.date_format(day, "yyyy-MM-dd"), F.date_format(F.date_add(day, 9), "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat_ws(" ~ ", b, a)).otherwise(F.concat_ws(" ~ ", a, b))
    found = M.extract_dates(text)
    rows = Tables(spark, d).orders.select("o_orderkey", found.alias("found")).where("size(found) = 2 and found[0] <= found[1]")
    return rows.select("o_orderkey", F.col("found")[0].alias("starts"), F.col("found")[1].alias("ends"))


@query(f"with {NOTICES_SQL} select id, cast(cast(left(deadline_time, 2) as int) * 60 + cast(right(deadline_time, 2) as int) as int) as minutes from notices")
def parse_clock(spark, d):
    return notices(Tables(spark, d)).select("id", M.clock_minutes(F.col("deadline_time")).alias("minutes"))


@query("select event_id, ts + interval 9 hours as local, cast(ts + interval 9 hours as date) as local_day from events")
def iso_to_kst(spark, d):
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    local = F.to_utc_timestamp(F.to_timestamp(iso), "UTC")
    rows = Tables(spark, d).events.select("event_id", F.timestamp_add("HOUR", F.lit(9), local.cast("timestamp_ntz")).alias("local"))
    return rows.withColumn("local_day", F.col("local").cast("date"))


@query("select o_orderkey, case when o_orderkey % 4 in (0, 3) then cast(o_orderdate as date) end as day from orders")
def valid_day(spark, d):
    good = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 4 == 1, "1998-02-31").when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "yyyy-M-d 'x'")).otherwise(good)
    return Tables(spark, d).orders.select("o_orderkey", M.valid_day(text).alias("day"))


@query(f"""with {NOTICES_SQL} select id, case when id % 5 = 0 then null when id % 24 = 0 and deadline_time is not null then cast(deadline as timestamp) + interval 1 day
 else cast(deadline as timestamp) + to_minutes(cast(left(deadline_time, 2) as int) * 60 + cast(right(deadline_time, 2) as int)) end as ends from notices""")
def exact_instant(spark, d):
    clock = F.when((F.col("id") % 24 == 0) & F.col("deadline_time").isNotNull(), "24:00").otherwise(F.col("deadline_time"))
    return notices(Tables(spark, d)).select("id", M.exact_instant(F.col("deadline"), clock, F.col("id") % 5 == 0).alias("ends"))


_ENDS = "case when deadline_time is not null then cast(deadline as timestamp) + to_minutes(cast(left(deadline_time, 2) as int) * 60 + cast(right(deadline_time, 2) as int)) end"
STATUS_SQL = f"""case when platform_status = 'closed' then 'closed' when coalesce({_ENDS} <= {_NOW}, deadline < date '{NOW}') then 'closed'
 when opened > date '{NOW}' then 'upcoming' when deadline is not null then 'active' else 'unknown' end"""


def with_status(rows):
    ends = M.exact_instant(F.col("deadline"), F.col("deadline_time"), F.lit(False))
    return rows.withColumn("status", M.status_at(_now(), F.col("deadline"), ends, F.col("opened"), F.col("platform_status"), F.lit(None).cast("date")))


@query(f"with {NOTICES_SQL} select id, {STATUS_SQL} as status from notices")
def status_at(spark, d):
    return with_status(notices(Tables(spark, d))).select("id", "status")


@query(f"with {NOTICES_SQL} select id, case {STATUS_SQL} when 'closed' then 'Closed' when 'upcoming' then 'Opens ' || strftime(opened, '%Y-%m-%d') when 'active' then 'D-' || cast(deadline - date '{NOW}' as varchar) else 'Unknown' end as label from notices")
def status_label(spark, d):
    days = F.date_diff("deadline", _now().cast("date"))
    label = F.when(F.col("status") == "closed", "Closed").when(F.col("status") == "upcoming", F.concat(F.lit("Opens "), F.date_format("opened", "yyyy-MM-dd"))).when(F.col("status") == "active", F.concat(F.lit("D-"), days)).otherwise("Unknown")
    return with_status(notices(Tables(spark, d))).select("id", label.alias("label"))


@query(f"with {NOTICES_SQL} select id, cast(deadline - date '{NOW}' as int) as days from notices")
def d_day(spark, d):
    return notices(Tables(spark, d)).select("id", F.date_diff("deadline", _now().cast("date")).alias("days"))


@query("""with runs as (select event_id, ts + interval 9 hours as local, cast(ts + interval 9 hours as date) as day, lpad(cast(event_id % 24 as varchar), 2, '0') || ':30' as clock, event_id % 4 <> 0 as enabled from events),
 claims as (select distinct cast(ts + interval 9 hours as date) as day from events where event_id % 400 = 0),
 told as (select event_id, r.day, local, c.day is not null as taken, cast(r.day as timestamp) + case when enabled then to_minutes((event_id % 24) * 60 + 30) else interval 12 hours end as target from runs r left join claims c on r.day = c.day)
 select event_id, day, local >= target - interval 25 minutes and not taken as run, case when taken then 'already_attempted' when local >= target - interval 25 minutes then 'due' else 'before_window' end as reason from told""")
def due_gate(spark, d):
    """Whether the daily run is due at each trigger: from 25 minutes before the day's clock in Korea, once a day."""
    events = Tables(spark, d).events
    local = F.timestamp_add("HOUR", F.lit(9), F.col("ts").cast("timestamp_ntz")).cast("date")
    claims = events.where("event_id % 400 = 0").select(local.alias("claim_day"), F.lit(True).alias("claimed")).distinct()
    clock = F.concat(F.lpad((F.col("event_id") % 24).cast("string"), 2, "0"), F.lit(":30"))
    runs = events.select("event_id", local.alias("claim_day"), F.col("ts").cast("timestamp").alias("now"), clock.alias("clock"), (F.col("event_id") % 4 != 0).alias("enabled")).join(claims, "claim_day", "left")
    told = runs.select("event_id", M.due(F.col("now"), F.col("clock"), F.col("enabled"), F.col("claimed")).alias("d"))
    return told.select("event_id", "d.day", "d.run", "d.reason")


@query("""select o_orderkey, case when o_orderkey % 6 = 4 then null else case when o_orderkey % 6 = 5 then cast(cast(o_orderdate as date) + 1 as timestamp) else cast(cast(o_orderdate as date) as timestamp) + to_minutes((o_orderkey % 24) * 60) end
 - case when o_orderkey % 6 in (0, 5) then interval 9 hours when o_orderkey % 6 = 1 then interval 0 hours when o_orderkey % 6 = 2 then interval 7 hours else interval 8 hours end end as at from orders""")
def zoned_instants(spark, d):
    """Instants of days and clocks in named zones without summer time, in UTC."""
    which, day = F.col("o_orderkey") % 6, F.col("o_orderdate").cast("date").cast("string")
    zone = F.when(which == 1, "UTC").when(which == 2, "Asia/Bangkok").when(which == 3, "Asia/Singapore").when(which == 4, "Mars/Base")
    clock = F.when(which == 5, "24:00").otherwise(F.concat(F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit(":00")))
    at = M.zoned_instant(day, clock, zone, F.lit(False))
    utc = F.to_timestamp_ntz(F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd HH:mm:ss"))
    return Tables(spark, d).orders.select("o_orderkey", utc.alias("at"))
