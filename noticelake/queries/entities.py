"""Entity resolution: guards, keys, groups and what a group shows."""

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import identity as I
from ..operators.grouping import grouped
from ..operators.registry import registered
from ..tables import NOTICES_SQL, Tables, notices


@query("""select o_orderkey, case when o_orderkey % 5 = 4 then cast(year(cast(o_orderdate as date) - 20) as varchar) || case when year(cast(o_orderdate as date) - 20) < year(o_orderdate) then ',' || year(o_orderdate) else '' end else '20' || lpad(cast(o_orderkey % 90 as varchar), 2, '0') end as years,
 case o_orderkey % 5 when 0 then 'Track A' when 1 then '2차' when 2 then '3차/부문 AI/학생 부문/학생 부문' when 3 then 'season 2' else '' end as scope from orders""")
def scope_guard(spark, d):
    """Years, rounds, seasons, tracks and audiences that a title names; without a year those of its dates. Dates before 2000 are dates here."""
    which = F.col("o_orderkey") % 5
    named = F.when(which == 0, "Challenge Track A").when(which == 1, "AI 교육 2차").when(which == 2, "학생 부문 AI 대회 3차").when(which == 3, "AI season 2").otherwise("AI 대회")
    title = F.when(which == 4, named).otherwise(F.concat_ws(" ", F.concat(F.lit("20"), F.lpad((F.col("o_orderkey") % 90).cast("string"), 2, "0")), named))
    day = F.col("o_orderdate").cast("date")
    found = Tables(spark, d).orders.select("o_orderkey", I.scope(title, F.date_sub(day, 20).cast("string"), day.cast("string")).alias("s"))
    return found.select("o_orderkey", F.array_join("s.years", ",").alias("years"), F.replace(F.col("s.scope"), F.lit("\u0001"), F.lit("/")).alias("scope"))


@query(f"with {NOTICES_SQL} select id, case when id % 7 = 0 or deadline is null then '' else 'challengeorder' || id || '|' || 'owner' || owner_id || '|' || opened || '|' || deadline end as key from notices")
def title_key(spark, d):
    """Normalised title, organiser and period; empty without enough of them."""
    rows = notices(Tables(spark, d))
    title = F.concat(F.lit("[행사] Challenge, "), F.col("title"), F.lit(" 개최"))
    organiser = F.when(F.col("id") % 7 == 0, "x").otherwise(F.concat(F.lit("owner-"), F.col("owner_id")))
    starts, ends = F.col("opened").cast("string"), F.col("deadline").cast("string")
    return rows.select("id", I.comparable_title(title, organiser, starts, ends, F.array(F.year("deadline").cast("string"))).alias("key"))


@query("""select l_orderkey as event, min(l_shipdate) as first_seen, max(l_shipdate) as last_seen, array_to_string(list_sort(list_distinct(list(l_suppkey))), ',') as sources,
 arg_min(l_partkey, (l_linenumber, l_partkey)) as winner from lineitem group by 1""")
def event_attrs(spark, d):
    return Tables(spark, d).lineitem.groupBy(F.col("l_orderkey").alias("event")).agg(F.min("l_shipdate").alias("first_seen"), F.max("l_shipdate").alias("last_seen"), F.array_join(F.array_sort(F.collect_set("l_suppkey")), ",").alias("sources"), F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("winner"))


@query("""select l_orderkey as event, count(distinct cast(l_shipdate as date)) > 1 as conflict,
 case when count(distinct cast(l_shipdate as date)) = 1 or max(case when l_returnflag = 'R' then 1 else 0 end) = 1 then min(cast(l_shipdate as date)) end as deadline from lineitem group by 1""")
def event_conflict(spark, d):
    """More than one date is a conflict; an official member decides, else there is no date."""
    day = F.col("l_shipdate").cast("date")
    found = Tables(spark, d).lineitem.groupBy(F.col("l_orderkey").alias("event")).agg(F.count_distinct(day).alias("dates"), F.some(F.col("l_returnflag") == "R").alias("official"), F.min(day).alias("day"))
    return found.select("event", (F.col("dates") > 1).alias("conflict"), F.when((F.col("dates") == 1) | F.col("official"), F.col("day")).alias("deadline"))


@query("""with e as (select l_suppkey as event, count(distinct l_orderkey) filter (where l_linenumber <= 2) as fresh, count(distinct l_orderkey) filter (where l_linenumber > 2) as base, max(l_shipdate) filter (where l_discount > 0.05) as extended from lineitem group by 1)
 select event, case when base = 0 then 'new' when fresh > 0 then 'updated' else 'old' end as kind, greatest(fresh - 1, 0) as reposts, extended from e""")
def event_diff(spark, d):
    fresh, base = (F.count_distinct(F.when(F.expr(c), F.col("l_orderkey"))) for c in ("l_linenumber <= 2", "l_linenumber > 2"))
    found = Tables(spark, d).lineitem.groupBy(F.col("l_suppkey").alias("event")).agg(fresh.alias("fresh"), base.alias("base"), F.max(F.when(F.col("l_discount") > 0.05, F.col("l_shipdate"))).alias("extended"))
    return found.select("event", F.when(F.col("base") == 0, "new").when(F.col("fresh") > 0, "updated").otherwise("old").alias("kind"), F.greatest(F.col("fresh") - 1, F.lit(0)).alias("reposts"), "extended")


@query(f"""with recursive {NOTICES_SQL}, n as (select id, opened, source_id % 2 as scope, year(deadline) as year, 'owner:' || owner_id || ':' || strftime(deadline, '%Y-%m') as k1, 'price:' || owner_id || ':' || cast(floor(price / 20000) as bigint) as k2 from notices),
 keyed as (select id, scope, year, k1 as key from n union all select id, scope, year, k2 from n), stars as (select id, min(id) over (partition by scope, year, key) as star from keyed),
 links as (select id as a, star as b from stars union select star, id from stars), reach(a, b) as (select id, id from n union select r.a, l.b from reach r join links l on r.b = l.a)
 select a as id, arg_min(b, (n.opened, b)) as grp, count(*) as members from reach join n on b = n.id group by 1""")
def event_groups(spark, d):
    """Guarded groups: notices share an owner and a month or an owner and a price class; track and year must agree."""
    keys = F.array(F.concat_ws(":", F.lit("owner"), "owner_id", F.date_format("deadline", "yyyy-MM")), F.concat_ws(":", F.lit("price"), "owner_id", F.floor(F.col("price") / 20000)))
    rows = notices(Tables(spark, d))
    return grouped(rows.select("id", F.col("opened").alias("first_seen"), (F.col("source_id") % 2).alias("scope"), F.array(F.year("deadline")).alias("years"), keys.alias("keys")))


@query("""with recursive n as (select l_orderkey as o, row_number() over (partition by l_orderkey order by l_shipdate, l_orderkey || '-' || l_linenumber) as i, l_orderkey || '-' || l_linenumber as id,
 case when l_linenumber % 3 = 0 then [] else list_distinct([year(l_shipdate) - l_linenumber % 4, year(l_shipdate) + l_suppkey % 2]) end as years, case when l_partkey % 5 = 0 then l_suppkey % 2 end as official from lineitem),
 b as (select o, list(id order by i) as ids, list(years order by i) as years, list(official order by i) as officials, count(*) as n from n group by 1),
 g(o, i, own) as (select o, 0, []::bigint[] from b union all
 select g.o, g.i + 1, list_append(own, coalesce(list_filter(range(1, g.i + 1), lambda c: own[c] = c and len(list_filter(range(1, g.i + 1), lambda j: own[j] = c and not
   ((len(b.years[j]) = 0 or len(b.years[g.i + 1]) = 0 or list_has_any(b.years[j], b.years[g.i + 1])) and coalesce(b.officials[j] = b.officials[g.i + 1], true)))) = 0)[1], g.i + 1)) from g join b on g.o = b.o where g.i < b.n)
 select unnest(ids) as id, unnest(list_transform(own, lambda c: ids[c])) as grp, unnest(list_transform(own, lambda c: len(list_filter(own, lambda x: x = c)))) as members from g join b on g.o = b.o where g.i = b.n""")
def event_groups_open(spark, d):
    """Guarded groups where notices name several years, or none, and some an official id: the lines of an order share a key."""
    ship = F.col("l_shipdate")
    named = F.array_distinct(F.array(F.year(ship) - F.col("l_linenumber") % 4, F.year(ship) + F.col("l_suppkey") % 2))
    years = F.when(F.col("l_linenumber") % 3 == 0, F.array().cast("array<int>")).otherwise(named.cast("array<int>"))
    official = F.when(F.col("l_partkey") % 5 == 0, F.col("l_suppkey") % 2)
    lines = Tables(spark, d).lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), ship.alias("first_seen"), F.lit("").alias("scope"), years.alias("years"), official.alias("official"), F.array(F.col("l_orderkey").cast("string")).alias("keys"))
    return grouped(lines)


@query("""with g as (select o_orderkey as id, cast(o_orderdate as date) as day, o_custkey % 997 as was, o_custkey % 997 % 100 as now from orders), first as (select was, 'evt_' || arg_min(id, (day, id)) as event from g group by 1),
 m as (select g.id, g.day, g.now, f.event from g join first f using (was)), live as (select now, arg_min(event, (day, id)) as event from m group by 1) select m.id, live.event from m join live using (now)""")
def registry_ids(spark, d):
    """Event ids after two groupings: what was registered first stays, and merged events lead on to it."""
    rows = Tables(spark, d).orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("first_seen"), (F.col("o_custkey") % 997).alias("was"), (F.col("o_custkey") % 997 % 100).alias("now"))
    empty = spark.createDataFrame([], "id long, event string"), spark.createDataFrame([], "old string, live string")
    registry, aliases = registered(rows.select("id", "first_seen", F.col("was").alias("grp")), *empty)
    registry, _ = registered(rows.select("id", "first_seen", F.col("now").alias("grp")), registry, aliases)
    return registry
