"""Projections, predicates and validation."""

from pyspark.sql import functions as F

from ..catalog import query
from ..functions.requests import broken_rules
from ..functions import urls as U
from ..tables import NOTICES_SQL, NOW, VERDICTS_SQL, Tables, notices, verdicts
from .timing import STATUS_SQL, with_status


@query(f"with {NOTICES_SQL} select id, source_id, title, deadline, status, opened <= date '{NOW}' and opened > date '{NOW}' - 1 as recent_new from (select *, {STATUS_SQL} as status from notices)")
def public_view(spark, d):
    """The published columns and the derived ones; everything else stays private."""
    now = F.lit(NOW).cast("date")
    rows = with_status(notices(Tables(spark, d)))
    return rows.select("id", "source_id", "title", "deadline", "status", ((F.col("opened") <= now) & (F.col("opened") > F.date_sub(now, 1))).alias("recent_new"))


@query(f"with {VERDICTS_SQL} select doc_id, lang from verdicts where verdict = 'included' and doc_id in (select min(doc_id) from documents group by text)")
def visible_notices(spark, d):
    """Included and no duplicate of an earlier text."""
    t = Tables(spark, d)
    first = t.documents.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return verdicts(t).where("verdict = 'included'").join(first, "doc_id", "left_semi").select("doc_id", "lang")


@query(f"with {VERDICTS_SQL} select doc_id, source from verdicts where verdict = 'pending'")
def review_queue(spark, d):
    return verdicts(Tables(spark, d)).where("verdict = 'pending'").select("doc_id", "source")


@query(f"""with {NOTICES_SQL} select id from notices n where exists (select 1 from lineitem where l_orderkey = n.id and l_quantity > 48)
 or not (opened < date '{NOW}' - 120 or (deadline_time is null and coalesce(platform_status = 'closed', false)))""")
def admission_filter(spark, d):
    """Known rows always pass; unseen ones only if recent and not closed without a date."""
    t = Tables(spark, d)
    known = t.lineitem.where("l_quantity > 48").select(F.col("l_orderkey").alias("id")).distinct().withColumn("known", F.lit(True))
    now = F.lit(NOW).cast("date")
    old = (F.col("opened") < F.date_sub(now, 120)) | (F.col("deadline_time").isNull() & F.coalesce(F.col("platform_status") == "closed", F.lit(False)))
    return notices(t).join(known, "id", "left").where(F.coalesce(F.col("known"), F.lit(False)) | ~old).select("id")


@query(f"""with {NOTICES_SQL} select id from notices where id not in (select l_orderkey from lineitem where l_linenumber = 7) and source_id <> 3
 and ((deadline_time is not null and deadline between date '{NOW}' - 7 and date '{NOW}') or (deadline_time is null and opened >= date '{NOW}' - 14))""")
def revisit_set(spark, d):
    """Not seen in this run, from a source that answered, and lately ended or lately seen without a date."""
    t = Tables(spark, d)
    now = F.lit(NOW).cast("date")
    seen = t.lineitem.where("l_linenumber = 7").select(F.col("l_orderkey").alias("id")).distinct()
    recent = F.when(F.col("deadline_time").isNotNull(), F.col("deadline").between(F.date_sub(now, 7), now)).otherwise(F.col("opened") >= F.date_sub(now, 14))
    return notices(t).where((F.col("source_id") != 3) & recent).join(seen, "id", "left_anti").select("id")


@query(f"""with {NOTICES_SQL} select id from (select *, {STATUS_SQL} as status from notices) where status <> 'closed' and source_id in (1, 2) and (priority = '1-URGENT' or priority = '2-HIGH') and contains(lower(title || ' ' || priority), 'r 1')""")
def facet_search(spark, d):
    rows = with_status(notices(Tables(spark, d)))
    text = F.lower(F.concat_ws(" ", "title", "priority"))
    return rows.where((F.col("status") != "closed") & F.col("source_id").isin(1, 2) & F.col("priority").isin("1-URGENT", "2-HIGH") & text.contains("r 1")).select("id")


@query("""select c_custkey, case when c_nationkey % 3 = 0 then true when c_nationkey % 3 = 1 then c_mktsegment in ('BUILDING', 'MACHINERY') else c_custkey % 2 = 0 end as matches from customer""")
def eligibility_match(spark, d):
    """Three-valued match: unknown passes unless the filter refuses it, and a list matches by membership."""
    facet = F.when(F.col("c_nationkey") % 3 == 0, F.array(F.lit("BUILDING"), F.lit("MACHINERY"), F.lit("ANY"))).when(F.col("c_nationkey") % 3 == 1, F.array("c_mktsegment")).otherwise(F.array(F.lit("unknown")))
    wanted = F.array(F.lit("BUILDING"), F.lit("MACHINERY"))
    refuses = F.col("c_custkey") % 2 == 1
    unknown = F.array_contains(facet, "unknown")
    return Tables(spark, d).customer.select("c_custkey", F.when(unknown, ~refuses).otherwise(F.arrays_overlap(facet, wanted)).alias("matches"))


@query(f"with {NOTICES_SQL} select id, deadline from (select *, {STATUS_SQL} as status from notices) where status <> 'closed' and deadline between date '{NOW}' and date '{NOW}' + 7")
def due_7d(spark, d):
    now = F.lit(NOW).cast("date")
    return with_status(notices(Tables(spark, d))).where((F.col("status") != "closed") & F.col("deadline").between(now, F.date_add(now, 7))).select("id", "deadline")


@query(f"""with {NOTICES_SQL} select id, concat_ws(',', case when id % 11 = 0 then 'kind' end, case when id % 7 = 0 and id % 11 <> 0 then 'fields' end, case when id % 5 = 0 and id % 11 <> 0 then 'url' end,
 case when id % 11 <> 0 and deadline > date '{NOW}' then 'future' end, case when id % 11 <> 0 and id % 13 = 0 then 'title' end, case when id % 11 <> 0 and id % 3 = 0 then 'order' end,
 case when id % 11 <> 0 and deadline_time is not null and id % 17 = 0 then 'deadline_time' end) as broken from notices where deadline is not null""")
def payload_quarantine(spark, d):
    """The rules of the closed world of requests that each payload breaks."""
    id_, day = F.col("id"), F.col("deadline").cast("string")
    fields = {
        "url": F.when(id_ % 5 == 0, F.concat(F.lit("https://board.internal/"), id_)).otherwise(F.concat(F.lit("https://x.org/"), id_)), "title": F.when(id_ % 13 == 0, "").otherwise(F.col("title")), "summary": F.lit("as stated"),
        "evidence_url": F.lit("https://x.org/e"), "checked_at": day, "registration_start": F.when(id_ % 3 == 0, F.date_add("deadline", 1).cast("string")).otherwise(F.col("opened").cast("string")), "deadline": day,
        "deadline_time": F.when(F.col("deadline_time").isNotNull() & (id_ % 17 == 0), "25:00").otherwise(F.col("deadline_time")), "memo": F.when(id_ % 7 == 0, "x"),
    }
    payload = F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]))
    kind = F.when(id_ % 11 == 0, "delete_notice").otherwise("add_notice")
    dealt = notices(Tables(spark, d)).where("deadline is not null").repartition("id")  # a file of one row group would be judged by one task
    rows = dealt.select("id", kind.alias("kind"), payload.alias("payload"))
    return rows.select("id", F.array_join(broken_rules(F.col("kind"), F.col("payload"), F.lit(NOW).cast("date")), ",").alias("broken"))


@query("select conv_id, turn, turn + 1 as number from conversations where role = 'user' and turn % 4 = 0")
def request_parse(spark, d):
    """Requests with the marker and exactly one JSON fence of bounded size."""
    fence = F.concat(F.lit("<!-- request -->\n```json\n{\"number\": "), F.col("turn") + 1, F.lit("}\n```"))
    body = F.when(F.col("turn") % 4 == 0, fence).otherwise(F.concat(fence, F.lit("\n"), fence))
    rows = Tables(spark, d).conversations.where("role = 'user'").select("conv_id", "turn", body.alias("body"))
    found = F.regexp_extract_all("body", F.lit(r"```json\s*([\s\S]*?)```"), F.lit(1))
    valid = rows.where(F.col("body").startswith("<!-- request -->") & (F.length("body") <= 16000)).withColumn("found", found).where("size(found) = 1")
    return valid.select("conv_id", "turn", F.from_json(F.col("found")[0], "number long")["number"].alias("number"))


@query("select page_id, url, left(sha256(url), 8) as tag from pages where url like 'https://%'")
def export_rows(spark, d):
    """The rows of the public export: guarded addresses only."""
    return Tables(spark, d).pages.where(U.public_url(F.col("url"))).select("page_id", "url", F.left(F.sha2("url", 256), F.lit(8)).alias("tag"))


@query(f"""with {NOTICES_SQL}, dated as (select * from notices where deadline between date '{NOW}' and date '{NOW}' + 30)
 select id, 'DTSTART;VALUE=DATE:' || strftime(deadline, '%Y%m%d') as line from dated union all select id, 'SUMMARY:' || title || '\\, ' || priority as line from dated""")
def ics_lines(spark, d):
    """Calendar lines of the open deadlines; commas in text are escaped."""
    now = F.lit(NOW).cast("date")
    rows = notices(Tables(spark, d)).where(F.col("deadline").between(now, F.date_add(now, 30)))
    text = F.replace(F.concat_ws(", ", "title", "priority"), F.lit(","), F.lit("\\,"))
    lines = F.array(F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format("deadline", "yyyyMMdd")), F.concat(F.lit("SUMMARY:"), text))
    return rows.select("id", F.explode(lines).alias("line"))


@query(f"with {NOTICES_SQL} select id, case when id % 2 = 0 then case when id % 3 <> 0 then deadline end else deadline end as deadline, id % 2 = 0 and id % 3 = 0 as conflict from notices")
def blend_conflict(spark, d):
    """Overview and schedule facts of one notice: a disagreement is a conflict and leaves no date."""
    schedule = F.when(F.col("id") % 2 == 0, F.when(F.col("id") % 3 == 0, F.date_add("deadline", 1)).otherwise(F.col("deadline")))
    conflict = F.coalesce(F.col("deadline") != schedule, F.lit(False))
    return notices(Tables(spark, d)).select("id", F.when(~conflict, F.coalesce(schedule, "deadline")).alias("deadline"), conflict.alias("conflict"))
