"""The change feed: snapshots, day diff, claims, briefings."""

from pyspark.sql import functions as F

from ..catalog import query
from ..operators.upsert import claimed
from ..plans import day_diff as plan
from ..plans.compare import classes_of_day, status_of_day
from ..tables import NOTICES_SQL, NOW, OBSERVATIONS_SQL, Tables, notices, observations

_WEAK = "value < 15"


@query(f"""with {OBSERVATIONS_SQL}, f as (select day, source, count(*) as fresh from (select notice, source, min(day) as day from observations group by 1, 2) group by 1, 2),
 r as (select day, source, count(*) as seen, case when count(*) filter (where {_WEAK}) * 2 > count(*) then 'partial' else 'ok' end as status from observations group by 1, 2),
 s as (select r.day, r.source, status, coalesce(fresh, 0) as fresh, lag(r.day) over w as previous, lag(status) over w as before from r left join f on r.day = f.day and r.source = f.source window w as (partition by r.source order by r.day))
 select day, source, case when day - previous = 1 then 'comparable' else 'gap' end as comparison, case when before = 'ok' then fresh else 0 end as new_count, case when before = 'ok' then 0 else fresh end as unverified_count from s where previous is not null""")
def day_diff(spark, d):
    return plan.day_diff(observations(Tables(spark, d)), _WEAK)


@query(f"with {OBSERVATIONS_SQL} select day, count(distinct notice) as ids, array_to_string(list_sort(list_distinct(list(source))), ',') as sources, max(seen_at) as last_seen from observations where day > date '2024-01-05' group by 1")
def snapshot_capture(spark, d):
    """One row a day, the last 25 days kept."""
    seen = observations(Tables(spark, d)).where("day > date '2024-01-05'")
    return seen.groupBy("day").agg(F.count_distinct("notice").alias("ids"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.max("seen_at").alias("last_seen"))


@query("select cast(ts as date) as day, min(event_id) as run from events where cast(ts as date) not in (select cast(ts as date) from events where event_type = 'signup' and value > 250) group by 1")
def claim_once(spark, d):
    """One claim a day, none where the day is claimed already."""
    rows = Tables(spark, d).events.withColumn("day", F.col("ts").cast("date"))
    return claimed(rows.where("event_type = 'signup' and value > 250").select("day"), rows.select("day", F.col("event_id").alias("run")), "day", ["run"])


@query(f"""with {OBSERVATIONS_SQL}, base as (select distinct case when notice like '%:view' then replace(notice, 'view', 'click') else notice end as id from observations where day < date '2024-01-10'),
 items as (select notice as id, min(source) as source from observations where day = date '2024-01-10' group by 1), log as (select notice as id, bool_or(value > 200) as imported, bool_or(value < 30) as updated from observations where seen_at > timestamp '2024-01-09 12:00:00' and seen_at <= timestamp '2024-01-10 18:00:00' group by 1),
 k as (select i.id, i.source, case when b.id is not null then case when l.updated then 'updated' end when coalesce(l.imported, false) or i.source = 'error' then 'initial' when i.source = 'signup' then 'unverified' else 'new' end as kind from items i left join base b on b.id = i.id left join log l on l.id = i.id)
 select * from k where kind is not null""")
def day_classes(spark, d):
    """New, initial, unverified and updated notices of one day against all days before: one source is younger than the base, one was incomplete, and ids have later names."""
    seen = observations(Tables(spark, d))
    base = seen.where("day < date '2024-01-10'").select(F.col("notice").alias("id"))
    items = seen.where("day = date '2024-01-10'").groupBy(F.col("notice").alias("id")).agg(F.min("source").alias("source"))
    before = seen.where("source <> 'error'").select("source").distinct().withColumn("status", F.when(F.col("source") == "signup", "partial").otherwise("ok"))
    kind = F.when(F.col("value") > 200, "initial").when(F.col("value") < 30, "updated").otherwise("other")
    changes = seen.select(F.col("notice").alias("id"), kind.alias("kind"), F.col("seen_at").alias("at"))
    aliases = base.where(F.col("id").endswith(":view")).distinct().select(F.col("id").alias("old_id"), F.regexp_replace("id", "view", "click").alias("id"))
    instant = lambda x: F.lit(x).cast("timestamp_ntz")
    return classes_of_day(items, base, before, changes, instant("2024-01-09 12:00:00"), instant("2024-01-10 18:00:00"), aliases)


@query(f"""with {OBSERVATIONS_SQL}, days as (select day, max(seen_at) as at from observations group by 1), s as (select day, source, count(*) as n from observations group by 1, 2),
 t as (select d.day, (select max(day) from days b where b.day < d.day) as base_day from days d where d.day <= date '2024-01-05')
 select day, case when base_day is null then 'baseline' when day - base_day = 1 then 'comparable' else 'gap' end as status, base_day,
 coalesce((select bool_or(n.n < 60 or coalesce(o.n < 60, false)) from s n left join s o on o.day = t.base_day and o.source = n.source where n.day = t.day), false) as partial from t""")
def day_status(spark, d):
    """How each of the first days compares with the day before; sources with few rows count as partial."""
    seen = observations(Tables(spark, d))
    days = seen.groupBy("day").agg(F.max("seen_at").alias("at"))
    sources = seen.groupBy("day", "source").agg(F.when(F.count("*") < 60, "partial").otherwise("ok").alias("status"))
    out = None
    for k in range(1, 6):  # five reports, each of its own day
        today = F.lit(f"2024-01-0{k}").cast("date")
        last = F.lit(f"2024-01-0{k} 18:00:00").cast("timestamp_ntz")
        now, then = sources.where(F.col("day") == today), sources.where(F.col("day") == F.date_sub(today, 1))
        row = status_of_day(days, now.select("source", "status"), then.select("source", "status"), today, last).select(today.alias("day"), "status", "base_day", "partial")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"with {NOTICES_SQL} select owner_id, min(deadline) as first_due, count(*) as due from notices where owner_id < 10 and deadline >= date '{NOW}' and id in (select l_orderkey from lineitem) group by 1")
def watch_due(spark, d):
    """Next dates of the watched, elapsed ones removed."""
    t = Tables(spark, d)
    known = t.lineitem.select(F.col("l_orderkey").alias("id")).distinct()
    rows = notices(t).where((F.col("owner_id") < 10) & (F.col("deadline") >= F.lit(NOW).cast("date"))).join(known, "id", "left_semi")
    return rows.groupBy("owner_id").agg(F.min("deadline").alias("first_due"), F.count("*").alias("due"))


@query(f"with {OBSERVATIONS_SQL}, c as (select day, count(*) as n from observations group by 1) select day, case when day = date '2024-01-30' then n end as shown, n as saved from c")
def stale_guard(spark, d):
    """Counts of another day than today are not shown, but kept."""
    counts = observations(Tables(spark, d)).groupBy("day").agg(F.count("*").alias("n"))
    return counts.select("day", F.when(F.col("day") == F.lit("2024-01-30").cast("date"), F.col("n")).alias("shown"), F.col("n").alias("saved"))


@query("select o_orderkey as number, arg_min(kind, ord) as kind from (select o_orderkey, o_orderpriority as kind, 0 as ord from orders union all select o_orderkey, 'again', 1 from orders where o_orderkey % 2 = 0) where o_orderkey not in (select l_orderkey from lineitem where l_quantity > 45) group by 1")
def idempotent_apply(spark, d):
    """Requests are applied once by number; those applied before are skipped."""
    t = Tables(spark, d)
    first = t.orders.select(F.col("o_orderkey").alias("number"), F.col("o_orderpriority").alias("kind"), F.lit(0).alias("ord"))
    again = t.orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("number"), F.lit("again").alias("kind"), F.lit(1).alias("ord"))
    applied = t.lineitem.where("l_quantity > 45").select(F.col("l_orderkey").alias("number")).distinct()
    return first.unionByName(again).join(applied, "number", "left_anti").groupBy("number").agg(F.min_by("kind", "ord").alias("kind"))
