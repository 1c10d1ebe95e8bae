"""Attachments, embedded data, milestones, exports and whitelists."""

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import fields as L
from ..sources import html as H
from ..sources.attachments import attachment_text
from ..tables import NOTICES_SQL, OBSERVATIONS_SQL, Tables, notices, observations


@query("select doc_id, case when doc_id % 5 = 0 then 'unsupported' when doc_id % 7 = 0 then 'no_text' else 'ok' end as status, case when doc_id % 5 = 0 or doc_id % 7 = 0 then 0 else length(text) end as chars from documents")
def attachment_status(spark, d):
    kind = F.when(F.col("doc_id") % 5 == 0, "pdf").otherwise("txt")
    content = F.when(F.col("doc_id") % 7 == 0, F.lit(" ")).otherwise(F.col("text")).cast("binary")
    rows = Tables(spark, d).documents.select("doc_id", attachment_text(content, kind).alias("a"))
    return rows.select("doc_id", "a.status", F.length("a.text").cast("long").alias("chars"))


@query(f"with {NOTICES_SQL} select id, 'submission' as kind, cast(deadline as varchar) as day from notices where deadline >= date '2000-01-01'")
def milestone_dates(spark, d):
    text = F.concat(F.lit("안내\n결과물 제출 마감: "), F.date_format("deadline", "yyyy. M. d."), F.lit(" 18:00\n시상식 일시: 미정"))
    rows = notices(Tables(spark, d)).select("id", F.explode(L.milestones(text, F.lit(""))).alias("m"))
    return rows.select("id", "m.kind", "m.day")


@query()
def ics_folded(spark, d):
    return Tables(spark, d).documents.select("doc_id", H.fold_line(F.concat(F.lit("DESCRIPTION:"), H.escape_ics(F.col("text")))).alias("line"))


@query("select event_id, array_to_string(list_transform(range(0, least(8, event_id % 11 + 1)), lambda x: 'step' || x), ',') as trace from events")
def trace_projection(spark, d):
    """The first eight steps, allowed keys only."""
    steps = F.transform(F.sequence(F.lit(0).cast("long"), F.col("event_id") % 11), lambda i: F.struct(F.concat(F.lit("step"), i).alias("stage"), F.lit("secret").alias("token")))
    kept = F.transform(F.slice(steps, 1, 8), lambda s: s["stage"])
    return Tables(spark, d).events.select("event_id", F.array_join(kept, ",").alias("trace"))


@query("select event_id, case when event_id % 3 = 0 then null else ts end as stamp, case when event_type in ('click', 'view') then event_type else 'unknown' end as status from events")
def ops_whitelist(spark, d):
    """Parseable stamps and known states only."""
    text = F.when(F.col("event_id") % 3 == 0, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return Tables(spark, d).events.select("event_id", F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")).cast("timestamp_ntz").alias("stamp"), F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).otherwise("unknown").alias("status"))


@query("select c_custkey, case when c_mktsegment in ('BUILDING', 'MACHINERY') then c_mktsegment else 'all' end as view_mode from customer")
def preference_defaults(spark, d):
    """Stored preferences outside the whitelist fall back to the default."""
    return Tables(spark, d).customer.select("c_custkey", F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.col("c_mktsegment")).otherwise("all").alias("view_mode"))


@query("""with m as (select l_orderkey as event, l_suppkey as member, l_linenumber as place from lineitem), r as (select s_suppkey, s_name from supplier where s_suppkey % 3 = 0)
 select event, arg_min(s_name, (place, member)) as record from m join r on member = s_suppkey group by 1""")
def planner_record(spark, d):
    """The first member of an event that has a record gives the event's record."""
    t = Tables(spark, d)
    records = t.supplier.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return t.lineitem.join(records, "l_suppkey").groupBy(F.col("l_orderkey").alias("event")).agg(F.min_by("s_name", F.struct("l_linenumber", "l_suppkey")).alias("record"))


@query(f"with {OBSERVATIONS_SQL}, c as (select day, source, count(*) as n from observations group by 1, 2) select day, string_agg(source || ' ' || n, '; ' order by source) as line from c group by 1")
def comparison_lines(spark, d):
    """One rendered line a day."""
    counts = observations(Tables(spark, d)).groupBy("day", "source").agg(F.count("*").alias("n"))
    parts = F.array_sort(F.collect_list(F.concat_ws(" ", "source", "n")))  # one entry a source
    return counts.groupBy("day").agg(F.array_join(parts, "; ").alias("line"))


@query("with l as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn) as r from conversations) select conv_id, count(*) as turns, max(case when r = 1 then length(text) end) as first_chars from l group by 1")
def conversation_heads(spark, d):
    """First turn and length of each conversation."""
    return Tables(spark, d).conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.min_by(F.length("text").cast("long"), "turn").alias("first_chars"))
