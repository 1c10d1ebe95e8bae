"""Ranking, previous rows, orders with their rank, and set operations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import urls as U
from ..operators.budget import fair_budget as take_fairly
from ..operators.ranks import ranked
from ..operators.upsert import trimmed
from ..tables import NOTICES_SQL, NOW, OBSERVATIONS_SQL, Tables, notices, observations
from .timing import STATUS_SQL, with_status

@query("""with k as (select page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '[?&]utm_[a-z]+=[^&#]*', '', 'g') as address, contains(url, '?') as odd from pages)
 select page_id, arg_min(page_id, (odd, page_id)) over (partition by address) as primary_id, page_id <> arg_min(page_id, (odd, page_id)) over (partition by address) as duplicate from k""")
def dedupe_primary(spark, d):
    """Of the pages of one canonical address, the plain address, then the oldest id, is the primary; the others point to it."""
    rows = Tables(spark, d).pages.select("page_id", U.canonical_url(F.col("url")).alias("address"), F.col("url").contains("?").alias("odd"))
    first = rows.groupBy("address").agg(F.min_by("page_id", F.struct("odd", "page_id")).alias("primary_id"))
    return rows.join(first, "address").select("page_id", "primary_id", (F.col("page_id") != F.col("primary_id")).alias("duplicate"))


@query(f"with {NOTICES_SQL} select owner_id, id as winner from (select *, row_number() over (partition by owner_id order by priority = '1-URGENT' desc, deadline_time is not null desc, opened, id) as r from notices) where r = 1")
def rank_winner(spark, d):
    rank = F.struct(F.col("priority") != "1-URGENT", F.col("deadline_time").isNull(), "opened", "id")
    return notices(Tables(spark, d)).groupBy("owner_id").agg(F.min_by("id", rank).alias("winner"))


@query(f"with {OBSERVATIONS_SQL}, c as (select source, day, count(*) as n from observations group by 1, 2) select source, day, n, lag(day) over (partition by source order by day) as previous, lag(n) over (partition by source order by day) as before from c")
def lag_previous(spark, d):
    w = Window.partitionBy("source").orderBy("day")
    counts = observations(Tables(spark, d)).groupBy("source", "day").agg(F.count("*").alias("n"))
    return counts.select("source", "day", "n", F.lag("day").over(w).alias("previous"), F.lag("n").over(w).alias("before"))


@query("""with r as (select p_partkey, p_brand, row_number() over (partition by p_brand order by p_size > 25, p_retailprice, p_partkey) as turn from part),
 t as (select p_partkey from r order by turn, p_brand limit 60) select p_partkey, p_brand, turn, p_partkey in (select p_partkey from t) as taken from r""")
def fair_budget(spark, d):
    rows = Tables(spark, d).part.withColumn("late", F.col("p_size") > 25)
    return take_fairly(rows, "p_brand", [F.col("late"), F.col("p_retailprice")], 60, "p_partkey").select("p_partkey", "p_brand", F.col("turn"), "taken")


@query("select l_suppkey, l_orderkey, l_linenumber, r from (select *, row_number() over (partition by l_suppkey order by l_returnflag = 'N' desc, l_shipdate, l_orderkey, l_linenumber, l_partkey) as r from lineitem) where r <= 8")
def topn_per_group(spark, d):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc(F.col("l_returnflag") == "N"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    return Tables(spark, d).lineitem.withColumn("r", F.row_number().over(w)).where("r <= 8").select("l_suppkey", "l_orderkey", "l_linenumber", "r")


@query("""with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as n, unnest(string_split(text, chr(10))) as line from documents)
 select doc_id, cast(n as int) as n, length(line) as chars, length(lead(line) over (partition by doc_id order by n)) as next_chars from l""")
def lead_next_line(spark, d):
    return _next_lines(Tables(spark, d).documents)


@query("""with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as n, unnest(string_split(text, chr(10))) as line from documents)
 select doc_id, cast(n as int) as n, length(line) as chars, length(lead(line) over (partition by doc_id order by n)) as next_chars from l""")
def lead_next_line_all(spark, d):
    """lead_next_line over every document."""
    return _next_lines(Tables(spark, d).documents)


def _next_lines(docs):
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    after = F.length(F.lead("line").over(Window.partitionBy("doc_id").orderBy("at")))
    return lines.select("doc_id", (F.col("at") + 1).alias("n"), F.length("line").cast("long").alias("chars"), after.cast("long").alias("next_chars"))


@query(f"with {OBSERVATIONS_SQL} select distinct source, day from observations where day >= date '2024-01-28' - 14")
def retention_trim(spark, d):
    """Days that are at most fourteen days old at a given instant."""
    days = observations(Tables(spark, d)).select("source", F.col("day").cast("timestamp_ntz").alias("at")).distinct()
    return trimmed(days, "at", F.lit("2024-01-28 00:00:00").cast("timestamp_ntz"), 14).select("source", F.col("at").cast("date").alias("day"))


_TIER = "case when status = 'closed' then 2 when deadline_time is null then 1 else 0 end"


@query(f"with {NOTICES_SQL}, s as (select *, {STATUS_SQL} as status from notices) select id, {_TIER} as tier, row_number() over (partition by source_id order by {_TIER}, deadline desc, deadline_time is not null desc, deadline_time desc nulls last, title) as place from s")
def deadline_order(spark, d):
    """Rank of each source's notices: dated ones first (farthest first), then unknown, then closed."""
    rows = with_status(notices(Tables(spark, d)))
    tier = F.when(F.col("status") == "closed", 2).when(F.col("deadline_time").isNull(), 1).otherwise(0)
    order = [F.col("tier"), F.desc("deadline"), F.desc("clocked"), F.desc_nulls_last("deadline_time"), F.col("title")]
    rows = rows.select("id", "source_id", "deadline", "deadline_time", "title", tier.alias("tier"), F.col("deadline_time").isNotNull().alias("clocked"))
    return ranked(rows, "source_id", order, "place").select("id", "tier", "place")


@query(f"""with {NOTICES_SQL} select id, row_number() over (partition by owner_id order by deadline, id) as remaining, row_number() over (partition by owner_id order by deadline desc, id) as deadline_rank,
 row_number() over (partition by owner_id order by opened desc, title collate nocase, id) as newest from notices""")
def three_sort_modes(spark, d):
    rows = notices(Tables(spark, d)).select("id", "owner_id", "deadline", "opened", F.lower("title").alias("name"))
    for name, order in (("remaining", [F.col("deadline")]), ("deadline_rank", [F.desc("deadline")]), ("newest", [F.desc("opened"), F.col("name")])):
        rows = ranked(rows, "owner_id", [*order, F.col("id")], name)
    return rows.select("id", "remaining", "deadline_rank", "newest")


@query(f"with {NOTICES_SQL}, s as (select *, {STATUS_SQL} as status from notices) select id, deadline from s where status <> 'closed' order by deadline, id limit 100")
def top100_open(spark, d):
    return with_status(notices(Tables(spark, d))).where("status <> 'closed'").orderBy("deadline", "id").limit(100).select("id", "deadline")


@query(f"""with {NOTICES_SQL}, s as (select *, {STATUS_SQL} as status from notices) select * from (select 'pick' as part, id from s where status = 'active' order by price desc, id limit 4)
 union all select * from (select 'due', id from s where status <> 'closed' and deadline >= date '{NOW}' order by deadline, id limit 2)""")
def digest_topk(spark, d):
    rows = with_status(notices(Tables(spark, d)))
    picks = rows.where("status = 'active'").orderBy(F.desc("price"), "id").limit(4).select(F.lit("pick").alias("part"), "id")
    due = rows.where((F.col("status") != "closed") & (F.col("deadline") >= F.lit(NOW).cast("date"))).orderBy("deadline", "id").limit(2)
    return picks.unionByName(due.select(F.lit("due").alias("part"), "id"))


@query(f"with {NOTICES_SQL}, s as (select *, {STATUS_SQL} as status from notices) select id, deadline from s where status <> 'closed' and owner_id < 20 order by deadline, id limit 6")
def urgent_topk(spark, d):
    return with_status(notices(Tables(spark, d))).where("status <> 'closed' and owner_id < 20").orderBy("deadline", "id").limit(6).select("id", "deadline")


@query("select o_orderkey as id, 'listed' as how, o_orderpriority as note from orders where o_orderkey % 5 = 0 union all select o_orderkey, 'revisit', null from orders where o_orderkey % 5 = 1")
def union_revisit(spark, d):
    orders = Tables(spark, d).orders
    listed = orders.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("id"), F.lit("listed").alias("how"), F.col("o_orderpriority").alias("note"))
    revisit = orders.where("o_orderkey % 5 = 1").select(F.col("o_orderkey").alias("id"), F.lit("revisit").alias("how"))
    return listed.unionByName(revisit, allowMissingColumns=True)


def _days(spark, d, day):
    return observations(Tables(spark, d)).where(F.col("day") == day).select("notice")


@query(f"with {OBSERVATIONS_SQL} select notice from observations where day = date '2024-01-03' except select notice from observations where day = date '2024-01-02'")
def except_ids(spark, d):
    return _days(spark, d, "2024-01-03").subtract(_days(spark, d, "2024-01-02"))


@query(f"with {OBSERVATIONS_SQL} select notice from observations where day = date '2024-01-03' intersect select notice from observations where day = date '2024-01-02'")
def intersect_ids(spark, d):
    return _days(spark, d, "2024-01-03").intersect(_days(spark, d, "2024-01-02"))


@query(f"with {OBSERVATIONS_SQL} select notice from observations where day = date '2024-01-03' union select notice from observations where day = date '2024-01-02'")
def union_distinct(spark, d):
    return _days(spark, d, "2024-01-03").union(_days(spark, d, "2024-01-02")).distinct()


@query("select user_id, arg_max(event_type, event_id) filter (where event_type <> 'error') as kind from events group by 1")
def last_wins(spark, d):
    """The last row of a key wins, but a generic value never replaces a real one."""
    real = F.when(F.col("event_type") != "error", F.col("event_id"))
    return Tables(spark, d).events.groupBy("user_id").agg(F.max_by(F.when(real.isNotNull(), F.col("event_type")), real).alias("kind"))
