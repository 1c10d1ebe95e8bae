"""Counts, reports and top-k summaries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..plans import digest
from ..tables import NOTICES_SQL, NOW, OBSERVATIONS_SQL, VERDICTS_SQL, Tables, notices, observations, verdicts
from .timing import STATUS_SQL, with_status


@query(f"with {OBSERVATIONS_SQL}, f as (select notice, source, min(day) as day from observations group by 1, 2) select day, source, count(*) as fresh from f group by 1, 2")
def new_by_source(spark, d):
    first = observations(Tables(spark, d)).groupBy("notice", "source").agg(F.min("day").alias("day"))
    return first.groupBy("day", "source").agg(F.count("*").alias("fresh"))


@query(f"with {VERDICTS_SQL} select source, count(*) as retained, count(*) filter (where verdict = 'excluded') as excluded, count(*) filter (where verdict = 'pending') as pending, count(*) filter (where n_chars > 1000) as complete from verdicts group by 1")
def source_rollup(spark, d):
    return verdicts(Tables(spark, d)).groupBy("source").agg(F.count("*").alias("retained"), F.count_if(F.col("verdict") == "excluded").alias("excluded"), F.count_if(F.col("verdict") == "pending").alias("pending"), F.count_if(F.col("n_chars") > 1000).alias("complete"))


@query(f"with {NOTICES_SQL} select r_regionkey as source, count(id) as denominator, count(deadline_time) as known, count(id) filter (where platform_status is not null) as confirmed, count(id) filter (where deadline_time is not null and price > 300000) as exact from region left join notices on r_regionkey = source_id and price > 100000 group by 1")
def quality_report(spark, d):
    """Coverage by source; sources without rows stay in the report. The ratio is given as its two integers."""
    t = Tables(spark, d)
    rows = notices(t).where("price > 100000")
    clock = F.col("deadline_time").isNotNull()
    counts = rows.groupBy("source_id").agg(F.count("*").alias("denominator"), F.count_if(clock).alias("known"), F.count_if(F.col("platform_status").isNotNull()).alias("confirmed"), F.count_if(clock & (F.col("price") > 300000)).alias("exact"))
    sources = t.region.select(F.col("r_regionkey").cast("long").alias("source_id"))  # counted first: one row a source meets one row a source
    return sources.join(counts, "source_id", "left").select(F.col("source_id").cast("int").alias("source"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("denominator", "known", "confirmed", "exact")])


@query(f"with {VERDICTS_SQL} select source, verdict as reason, count(*) as n from verdicts group by 1, 2")
def reason_histogram(spark, d):
    """Reasons of each source, built as a map and given in long form."""
    counts = verdicts(Tables(spark, d)).groupBy("source", "verdict").agg(F.count("*").alias("n"))
    maps = counts.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("verdict", "n"))).alias("reasons"))  # a handful of reasons
    return maps.select("source", F.explode("reasons").alias("reason", "n"))


@query(f"with {NOTICES_SQL} select count(*) as total, count(deadline_time) as known, count(*) filter (where platform_status = 'closed') as closed from notices")
def quality_totals(spark, d):
    return notices(Tables(spark, d)).agg(F.count("*").alias("total"), F.count("deadline_time").alias("known"), F.count_if(F.col("platform_status") == "closed").alias("closed"))


@query(f"with {OBSERVATIONS_SQL} select day, source, count(*) as items, count(*) filter (where value > 20) as known, count(distinct notice) as notices, min(notice) as first_notice, max(notice) as last_notice from observations group by 1, 2")
def quality_sample(spark, d):
    """What a day shows of each source; the notices themselves stay rows (see plans.compare.regressions)."""
    rows = observations(Tables(spark, d)).groupBy("day", "source")
    return rows.agg(F.count("*").alias("items"), F.count_if(F.col("value") > 20).alias("known"), F.count_distinct("notice").alias("notices"), F.min("notice").alias("first_notice"), F.max("notice").alias("last_notice"))


@query(f"""with {OBSERVATIONS_SQL}, s as (select day, source, count(*) as n from observations group by 1, 2)
 select day, case when bool_and(n >= 3) and count(*) = 5 then 'complete' when bool_or(n >= 3) then 'partial' else 'failed' end as status from s group by 1""")
def run_status(spark, d):
    per = observations(Tables(spark, d)).groupBy("day", "source").agg(F.count("*").alias("n"))
    ok = F.col("n") >= 3
    return per.groupBy("day").agg(F.when(F.every(ok) & (F.count("*") == 5), "complete").when(F.some(ok), "partial").otherwise("failed").alias("status"))


@query(f"""with {OBSERVATIONS_SQL}, f as (select notice, min(day) as first from observations group by 1), k as (select o.day, o.notice, max(case when f.first = o.day then 1 else 0 end) as fresh from observations o join f using (notice) group by 1, 2)
 select day, count(*) filter (where fresh = 1) as new, count(*) filter (where fresh = 0) as updated from k group by 1""")
def digest_counts(spark, d):
    """Distinct new and updated notices of each day; new suppresses updated."""
    seen = observations(Tables(spark, d)).select("notice", "day").distinct()
    first = seen.withColumn("first", F.min("day").over(Window.partitionBy("notice")))
    return first.groupBy("day").agg(F.count_if(F.col("day") == F.col("first")).alias("new"), F.count_if(F.col("day") != F.col("first")).alias("updated"))


@query("select count(*) as reposts from (select distinct l_orderkey, l_suppkey from lineitem where l_suppkey between 1 and 5)")
def repost_count(spark, d):
    return Tables(spark, d).lineitem.where("l_suppkey between 1 and 5").select("l_orderkey", "l_suppkey").distinct().agg(F.count("*").alias("reposts"))


@query("select l_orderkey as event, arg_max(l_partkey, (l_shipdate, l_linenumber, l_partkey)) as part, max(l_shipdate) as at_day from lineitem where l_discount > 0.03 group by 1")
def latest_extension(spark, d):
    return Tables(spark, d).lineitem.where("l_discount > 0.03").groupBy(F.col("l_orderkey").alias("event")).agg(F.max_by("l_partkey", F.struct("l_shipdate", "l_linenumber", "l_partkey")).alias("part"), F.max("l_shipdate").alias("at_day"))


@query("""with c as (select source, count(*) as n, row_number() over (order by count(*) desc, source) as r from documents group by 1)
 select case when r <= 5 then source else 'other' end as name, cast(sum(n) as bigint) as n, case when max(r) <= 5 then 1 else count(*) end as sources from c group by 1""")
def top5_plus_other(spark, d):
    counts = Tables(spark, d).documents.groupBy("source").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "source")))  # one row a source
    return ranked.groupBy(F.when(F.col("r") <= 5, F.col("source")).otherwise("other").alias("name")).agg(F.sum("n").alias("n"), F.count("*").alias("sources"))


@query("select user_id, string_agg(event_type, ',' order by first) as kinds from (select user_id, event_type, min(event_id) as first from events group by 1, 2) group by 1")
def ordered_distinct(spark, d):
    """Distinct values in the order of their first appearance."""
    first = Tables(spark, d).events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    ordered = F.array_sort(F.collect_list(F.struct("first", "event_type")))  # a handful of types
    return first.groupBy("user_id").agg(F.array_join(F.transform(ordered, lambda x: x["event_type"]), ",").alias("kinds"))


@query(f"""with {NOTICES_SQL}, s as (select *, {STATUS_SQL} as status from notices) select count(*) filter (where status <> 'closed') as open_now,
 count(*) filter (where status <> 'closed' and deadline between date '{NOW}' and date '{NOW}' + 7) as due, count(distinct source_id) as sources from s""")
def dashboard_counts(spark, d):
    now = F.lit(NOW).cast("date")
    is_open = F.col("status") != "closed"
    return with_status(notices(Tables(spark, d))).agg(F.count_if(is_open).alias("open_now"), F.count_if(is_open & F.col("deadline").between(now, F.date_add(now, 7))).alias("due"), F.count_distinct("source_id").alias("sources"))


@query("select p_brand, count(*) filter (where p_name like '%widget%' or p_name like '%ring%') as matching from part group by 1")
def field_new_count(spark, d):
    fields = F.split("p_name", " ")
    wanted = F.array(F.lit("widget"), F.lit("ring"))
    return Tables(spark, d).part.groupBy("p_brand").agg(F.count_if(F.arrays_overlap(fields, wanted)).alias("matching"))


@query("""with l as (select l_suppkey as who, 'Line ' || l_orderkey || '/' || l_linenumber || ' at ' || cast(l_extendedprice::decimal(12,2) as varchar) as line, l_orderkey, l_linenumber from lineitem)
 select who, left(string_agg(line, chr(10) order by l_orderkey, l_linenumber, line), 2600) as message from l group by 1""")
def digest_message(spark, d):
    """The message of each supplier: its lines in order, cut at 2,600 bytes."""
    line = F.concat(F.lit("Line "), F.col("l_orderkey"), F.lit("/"), F.col("l_linenumber"), F.lit(" at "), F.col("l_extendedprice").cast("decimal(12,2)").cast("string"))
    lines = Tables(spark, d).lineitem.select(F.col("l_suppkey").alias("who"), "l_orderkey", "l_linenumber", line.alias("line"))
    return digest.clipped(lines, ["who"], ["l_orderkey", "l_linenumber", "line"])
