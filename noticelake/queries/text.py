"""Titles, evidence, tags, guards, JSON and collection algebra."""

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import canonical
from ..functions import text as X
from ..plans import diagnostics
from ..tables import Tables

_TITLE_OF = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
_COLLAPSED = "trim(regexp_replace({0}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"


def _titles(t):
    return t.pages.select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("raw_title"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("headline"))


@query(f"select page_id, {_TITLE_OF} as raw_title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) as headline from pages")
def html_title(spark, d):
    return _titles(Tables(spark, d)).select("page_id", "raw_title", "headline")


@query(f"select page_id, trim(regexp_replace(regexp_replace(regexp_replace('[NEW] ' || {_TITLE_OF} || ' | DACON', '^\\[NEW\\] *', ''), '[ ]+', ' ', 'g'), ' *\\| DACON$', '')) as title from pages")
def clean_title(spark, d):
    decorated = F.concat(F.lit("[NEW] "), F.col("raw_title"), F.lit(" | DACON"))
    return _titles(Tables(spark, d)).select("page_id", X.clean_title(decorated).alias("title"))


@query(f"select page_id, (page_id % 3 = 0) as generic from pages")
def generic_title(spark, d):
    title = F.when(F.col("page_id") % 3 == 0, F.lit("Notice | site")).otherwise(F.concat(F.lit("x"), F.col("raw_title")))
    return _titles(Tables(spark, d)).select("page_id", X.generic_title(title).alias("generic"))


@query("select page_id, case when page_id % 3 = 0 then 'Open call ' || page_id else 'Call ' || page_id end as title from pages")
def preferred_title(spark, d):
    first = F.when(F.col("page_id") % 3 == 0, F.lit("News")).otherwise(F.concat(F.lit("Call "), F.col("page_id")))
    second = F.concat(F.lit("[NEW] Open  call "), F.col("page_id"))
    return Tables(spark, d).pages.select("page_id", X.preferred_title(first, second).alias("title"))


@query("select doc_id, replace(regexp_replace(text, '[0-9]', '#', 'g'), '|', ' ') as text from (select doc_id, replace(text, chr(160), ' ') as text from documents)")
def normalize_text(spark, d):
    return _normalized(Tables(spark, d).documents)


@query("select doc_id, replace(regexp_replace(text, '[0-9]', '#', 'g'), '|', ' ') as text from (select doc_id, replace(text, chr(160), ' ') as text from documents)")
def normalize_text_all(spark, d):
    """normalize_text over every document."""
    return _normalized(Tables(spark, d).documents)


def _normalized(docs):
    spaced = F.regexp_replace("text", " ", "\u00a0")
    return docs.select("doc_id", F.replace(F.regexp_replace(X.normalize(spaced), "[0-9]", "#"), F.lit("|"), F.lit(" ")).alias("text"))


@query("with c as (select doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')) as p from documents) select doc_id, case when length(p) > 80 then rtrim(substr(p, 1, 79)) || '…' else p end as short from c")
def compact_text(spark, d):
    return Tables(spark, d).documents.select("doc_id", X.compact(F.regexp_replace("text", r"^[-•·*▶○□■]+\s*", ""), 80).alias("short"))


@query("select s_suppkey, case when s_suppkey % 4 = 0 then null else s_name end as organizer, case when s_suppkey % 5 = 0 then null else 'prize ' || s_suppkey end as benefits from supplier")
def sanitize(spark, d):
    rows = Tables(spark, d).supplier.select(
        "s_suppkey",
        F.when(F.col("s_suppkey") % 4 == 0, F.lit("측 책임을 부담")).otherwise(F.col("s_name")).alias("organizer"),
        F.when(F.col("s_suppkey") % 5 == 0, F.lit("환수 조건")).otherwise(F.concat(F.lit("prize "), F.col("s_suppkey"))).alias("benefits"),
    )
    return rows.select("s_suppkey", X.sane_organizer(F.col("organizer")).alias("organizer"), X.sane_benefits(F.col("benefits")).alias("benefits"))


@query()
def utf8_clip(spark, d):
    return Tables(spark, d).documents.select("doc_id", X.utf8_clip(F.col("text"), 101).alias("clipped"))


@query("select p_partkey, case when p_partkey % 3 = 0 then '''=' || p_name else p_name end as cell from part")
def csv_guard(spark, d):
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("="), F.col("p_name"))).otherwise(F.col("p_name"))
    return Tables(spark, d).part.select("p_partkey", X.csv_cell(name).alias("cell"))


@query("select doc_id, left(sha256(text), 16) as content_hash from documents")
def content_hash(spark, d):
    return Tables(spark, d).documents.select("doc_id", F.left(F.sha2("text", 256), F.lit(16)).alias("content_hash"))


@query("""select p_partkey, concat_ws(',', case when p_name like '%widget%' then 'data_analysis' end, case when p_name like '%ring%' then 'model_development' end,
 case when p_name not like '%widget%' and p_name not like '%ring%' then 'general_ai' end) as tags from part""")
def multi_label_tags(spark, d):
    wording = F.regexp_replace(F.regexp_replace("p_name", "widget", "data analysis"), "ring", "machine  learning")
    return Tables(spark, d).part.select("p_partkey", F.array_join(X.tags(wording), ",").alias("tags"))


@query("""select c_custkey, case when c_custkey % 3 = 0 then 'undergraduate,graduate,general' when c_custkey % 3 = 1 then 'undergraduate' else 'unknown' end as audience,
 case when c_custkey % 2 = 0 then 'online' else 'onsite' end as mode, case when c_custkey % 5 = 0 then 'free' else 'paid' end as cost from customer""")
def conditions_facets(spark, d):
    lines = F.concat_ws(
        "\n",
        F.when(F.col("c_custkey") % 3 == 0, "참가 대상: 누구나").when(F.col("c_custkey") % 3 == 1, "참가 대상: 대학생").otherwise("참가 대상: 대학생 제외"),
        F.when(F.col("c_custkey") % 2 == 0, "진행 방식: 온라인").otherwise("진행 방식: 현장"),
        F.when(F.col("c_custkey") % 5 == 0, "참가비: 무료").otherwise("참가비: 30,000원"),
    )
    found = Tables(spark, d).customer.select("c_custkey", X.facets(lines).alias("f"))
    return found.select("c_custkey", *[F.array_join(f"f.{name}.values", ",").alias(name) for name in ("audience", "mode", "cost")])


_LADDER_SQL = """ladder as (select *, case when manual then (case when needs_review then 'manual_review' else 'manual_date' end) when known and code = 'budget_deferred' then 'cached_date'
 when known and (coalesce(detail = 'error', false) or coalesce(code <> 'confirmed', false)) then 'stale_evidence' when ambiguous or status = 'conflict' then 'date_conflict'
 when known then (case when starts is not null then 'confirmed' else 'partial_date' end) when code is not null then (case when code in ('budget_deferred', 'confirmed', 'network_error', 'robots_disallowed') or code like 'http_%' then code else 'parser_error' end)
 when attempted is null then 'not_requested' when detail = 'error' then 'network_error' when starts is not null then 'partial_date' else 'no_explicit_date' end as reason from
 (select *, ends is not null and not ambiguous as known from (select o_orderkey, o_custkey % 7 as source, o_orderkey % 23 = 0 as manual, o_custkey % 3 = 0 as needs_review, o_orderkey % 19 = 0 as ambiguous,
 case when o_orderkey % 3 <> 0 then cast(cast(o_orderdate as date) as varchar) end as ends, case when o_custkey % 2 = 0 then cast(cast(o_orderdate as date) - 20 as varchar) end as starts, case when o_orderkey % 29 = 0 then 'conflict' end as status,
 case o_custkey % 11 when 0 then 'budget_deferred' when 1 then 'http_503' when 2 then 'confirmed' when 3 then 'odd' when 4 then 'robots_disallowed' when 5 then '' end as raw, nullif(case o_custkey % 11 when 0 then 'budget_deferred' when 1 then 'http_503' when 2 then 'confirmed' when 3 then 'odd' when 4 then 'robots_disallowed' when 5 then '' end, '') as code,
 case when o_orderkey % 5 = 0 then 'error' else 'ok' end as detail, case when o_orderkey % 13 <> 0 then '2026-01-01' end as attempted, case when o_orderstatus <> 'P' then '18:00' end as clock from orders)))"""


def _read_notices(spark, d):
    """Orders as notices in every state of reading."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    day = F.col("o_orderdate").cast("date")
    code = F.create_map(*[F.lit(x) for pair in ((0, "budget_deferred"), (1, "http_503"), (2, "confirmed"), (3, "odd"), (4, "robots_disallowed"), (5, "")) for x in pair])
    return Tables(spark, d).orders.select(
        "o_orderkey", (cust % 7).alias("source_id"), (key % 23 == 0).alias("manual"), (cust % 3 == 0).alias("needs_review"), (key % 19 == 0).alias("registration_ambiguous"), F.when(key % 3 != 0, day.cast("string")).alias("deadline"),
        F.when(cust % 2 == 0, F.date_sub(day, 20).cast("string")).alias("registration_start"), F.when(key % 29 == 0, "conflict").alias("date_status"), code[(cust % 11).cast("int")].alias("date_failure_code"),
        F.when(key % 5 == 0, "error").otherwise("ok").alias("detail_status"), F.when(key % 13 != 0, "2026-01-01").alias("detail_attempted_at"), F.when(F.col("o_orderstatus") != "P", "18:00").alias("deadline_time"), F.lit(False).alias("registration_time_ambiguous"),
    )


@query(f"with {_LADDER_SQL} select o_orderkey, reason from ladder")
def reason_code(spark, d):
    """Why the date of each notice is or is not known."""
    return _read_notices(spark, d).select("o_orderkey", diagnostics.reason().alias("reason"))


@query(f"""with {_LADDER_SQL}, counts as (select source, reason, count(*) as n from ladder group by 1, 2)
 select source as source_id, count(*) as denominator, cast(sum(known::int) as bigint) as deadline_known, cast(sum((known and starts is not null)::int) as bigint) as start_and_end_known, cast(sum((known and clock is not null)::int) as bigint) as deadline_time_known,
 cast(sum(manual::int) as bigint) as manual_count, round(100.0 * sum(known::int) / count(*), 1) as deadline_coverage, (select string_agg(reason || ':' || n, ',' order by reason) from counts c where c.source = l.source) as reasons from ladder l group by 1""")
def reason_report(spark, d):
    """What the notices of each source say about the reading of their dates."""
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("reasons")), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return diagnostics.report(_read_notices(spark, d)).withColumn("reasons", shown)


@query("""select c_custkey, left(sha256('{"address": {"nation": ' || c_nationkey || ', "street": "' || replace(replace(c_name, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"}, "balance": ' || cast(c_acctbal::decimal(12,2) as varchar) || ', "key": ' || c_custkey || ', "tags": ["' || c_mktsegment || '", null, "' || lower(c_mktsegment) || '"]}'), 20) as hash from customer""")
def canonical_hash(spark, d):
    """Content hash of a nested value, whatever the order of its fields."""
    value = F.struct(
        F.array("c_mktsegment", F.lit(None).cast("string"), F.lower("c_mktsegment")).alias("tags"), F.col("c_custkey").alias("key"), F.col("c_acctbal").cast("decimal(12,2)").alias("balance"),
        F.struct(F.col("c_name").alias("street"), F.col("c_nationkey").alias("nation")).alias("address"),
    )
    rows = Tables(spark, d).customer.select("c_custkey", value.alias("value"))
    return rows.select("c_custkey", canonical.content_hash(F.col("value"), rows.schema["value"].dataType).alias("hash"))


@query("""select l_orderkey, array_to_string(list_sort(list_distinct(list(l_suppkey))), ',') as suppliers, cast(len(list_intersect(list_distinct(list(l_suppkey)), list_distinct(list(l_partkey)))) as bigint) as shared,
 array_to_string(list_sort(list_distinct(list_concat(list(l_suppkey), list(l_linenumber)))), ',') as either from lineitem group by l_orderkey""")
def array_algebra(spark, d):
    sets = Tables(spark, d).lineitem.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("s"), F.collect_set("l_partkey").alias("p"), F.collect_set(F.col("l_linenumber").cast("long")).alias("n"))
    return sets.select("l_orderkey", F.array_join(F.array_sort("s"), ",").alias("suppliers"), F.size(F.array_intersect("s", "p")).cast("long").alias("shared"), F.array_join(F.array_sort(F.array_union("s", "n")), ",").alias("either"))


@query("select n_nationkey, 'name=' || n_name || ';region=' || coalesce(r_name, '') as kept from nation left join region on n_regionkey = r_regionkey")
def map_algebra(spark, d):
    t = Tables(spark, d)
    old = F.create_map(F.lit("name"), F.col("n_name"), F.lit("secret"), F.lit("x"))
    new = F.create_map(F.lit("region"), F.coalesce("r_name", F.lit("")))
    rows = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"), "left")  # five regions
    kept = F.map_filter(F.map_concat(old, new), lambda k, v: k.isin("name", "region"))
    entries = F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select("n_nationkey", F.array_join(entries, ";").alias("kept"))


@query("select event_id, cast(props->>'$.k' as bigint) as k from events")
def json_extract(spark, d):
    return Tables(spark, d).events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def scan_json_props(spark, d):
    return Tables(spark, d).events.select("event_id", F.from_json("props", "k bigint", {"mode": "FAILFAST"})["k"].alias("k"))


@query("select l_returnflag, cast(sum(case when l_tax > 0.04 then 1 else 0 end) as bigint) as n, count(*) as d, greatest(count(*) - 20000, 0) as rest from lineitem group by 1")
def ratio_round(spark, d):
    return Tables(spark, d).lineitem.groupBy("l_returnflag").agg(F.count_if(F.col("l_tax") > 0.04).alias("n"), F.count("*").alias("d")).withColumn("rest", F.greatest(F.col("d") - 20000, F.lit(0)))


@query("select doc_id, coalesce(substr(regexp_extract(text, '[^\\n]*All rights reserved[^\\n]*'), 1, 160), '') as evidence from documents")
def evidence_window(spark, d):
    return Tables(spark, d).documents.select("doc_id", X.evidence(F.regexp_replace("text", r"(?<=[.!?])[ \t]+", "\u2003"), "All rights reserved", "^문의").alias("evidence"))


@query("select page_id, case when url like '%//blog.%' then 'contest' when page_id % 3 = 0 then 'contest' when page_id % 3 = 1 then 'program' else 'other' end as kind from pages")
def kind_case(spark, d):
    title = F.when(F.col("page_id") % 3 == 0, "Data HACKATHON").when(F.col("page_id") % 3 == 1, "여름 캠프").otherwise("notes")
    return Tables(spark, d).pages.select("page_id", X.opportunity_kind(title, F.col("url").contains("//blog.")).alias("kind"))


@query("""select o_orderkey, case when o_orderkey % 4 = 0 then false when o_custkey % 3 = 0 then true when o_custkey % 3 = 1 then o_orderkey % 4 = 1 else o_orderkey % 4 in (1, 2) end as relevant from orders""")
def relevant_by_mode(spark, d):
    kind = F.col("o_orderkey") % 4
    title = F.when(kind == 0, "수상 결과 contest").when(kind == 1, "AI contest").when(kind == 2, "cooking contest").otherwise("menu")
    mode = F.when(F.col("o_custkey") % 3 == 0, "platform").when(F.col("o_custkey") % 3 == 1, "ai_contest").otherwise("contest")
    return Tables(spark, d).orders.select("o_orderkey", X.relevant(title, mode).alias("relevant"))


@query("""select p_partkey, case when p_partkey % 4 = 0 then 'excluded' when p_partkey % 4 = 1 then 'included' when p_partkey % 4 = 2 and p_size > 25 then 'included' else 'pending' end as verdict from part""")
def classify_tristate(spark, d):
    title = F.when(F.col("p_partkey") % 4 == 0, "수상 소식").when(F.col("p_partkey") % 4 == 1, "AI 모델 챌린지").otherwise(F.col("p_name"))
    summary = F.when((F.col("p_partkey") % 4 == 2) & (F.col("p_size") > 25), "공공 데이터 활용").otherwise("")
    return Tables(spark, d).part.select("p_partkey", X.classify(title, summary, F.lit(None).cast("string"), F.lit(False))["status"].alias("verdict"))
