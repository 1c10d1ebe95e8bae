"""Joins: upsert, patches, anti and semi joins, as-of."""

from pyspark.sql import functions as F

from ..catalog import query
from ..operators.asof import asof
from ..operators.upsert import Rules, merge, upsert
from ..plans.compare import regressions
from ..tables import NOTICES_SQL, OBSERVATIONS_SQL, Tables, notices, observations


@query("""with old as (select o_orderkey as id, o_custkey % 5 as source, o_orderpriority as title, o_totalprice as price from orders where o_orderkey % 3 <> 0),
 new as (select o_orderkey as id, o_custkey % 5 as source, case when o_orderkey % 5 = 0 then null when o_orderkey % 5 = 1 then 'changed' else o_orderpriority end as title, o_totalprice as price from orders where o_orderkey % 4 <> 0)
 select coalesce(n.id, o.id) as id, coalesce(n.source, o.source) as source, coalesce(n.title, o.title) as title, coalesce(n.price, o.price) as price,
 case when n.id is null then null when o.id is null then case when coalesce(n.source, o.source) < 4 then 'new' else 'initial' end when coalesce(n.title, o.title) is distinct from o.title then 'updated' end as change
 from old o full join new n on o.id = n.id""")
def upsert_merge(spark, d):
    rows = Tables(spark, d).orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).alias("source"), F.col("o_orderpriority").alias("title"), F.col("o_totalprice").alias("price"))
    batch = rows.where("id % 4 <> 0").withColumn("title", F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 5 == 1, "changed").otherwise(F.col("title")))
    ready = rows.where("source < 4").select("source")
    return upsert(rows.where("id % 3 <> 0"), batch, "id", ["source", "title", "price"], ["title", "price"], ready, "source")


@query("select p.page_id, coalesce(o.page_id, p.page_id + 100000) as adopted from pages p left join (select min(page_id) as page_id, split_part(url, '?', 1) as u from pages where page_id % 2 = 0 group by 2) o on split_part(p.url, '?', 1) = o.u")
def adopt_ids(spark, d):
    """New records take the stored id of the same address."""
    pages = Tables(spark, d).pages.select("page_id", F.split("url", "\\?")[0].alias("u"))
    known = pages.where("page_id % 2 = 0").groupBy("u").agg(F.min("page_id").alias("known"))
    return pages.join(known, "u", "left").select("page_id", F.coalesce("known", F.col("page_id") + 100000).alias("adopted"))


_PATCHES = "patches as (select s_suppkey as key, -s_acctbal as balance from supplier where s_acctbal > 0)"


@query(f"with {_PATCHES} select c_custkey, coalesce(balance, c_acctbal) as balance, case when balance is not null then c_acctbal end as saved, coalesce(balance < -5000, false) as needs_review from customer left join patches on c_custkey = key")
def override_patch(spark, d):
    return _patched(spark, d)


def _patched(spark, d):
    t = Tables(spark, d)
    patches = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("key"), (-F.col("s_acctbal")).alias("balance"))
    rows = t.customer.join(patches, F.col("c_custkey") == F.col("key"), "left")
    return rows.select("c_custkey", F.coalesce("balance", "c_acctbal").alias("balance"), F.when(F.col("balance").isNotNull(), F.col("c_acctbal")).alias("saved"), F.coalesce(F.col("balance") < -5000, F.lit(False)).alias("needs_review"))


@query("select c_custkey, c_acctbal as balance from customer")
def override_restore(spark, d):
    """Taking a patch back gives the automatic value again."""
    return _patched(spark, d).select("c_custkey", F.coalesce("saved", "balance").alias("balance"))


@query("select s_suppkey as key, s_name as name from supplier where s_suppkey not in (select c_custkey from customer where c_acctbal < 0) union all select c_custkey, c_name from customer where c_acctbal < 0")
def manual_adds_anti(spark, d):
    """Entries by hand are added where the state does not know their key."""
    t = Tables(spark, d)
    state = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")).join(state, "key", "left_anti").unionByName(state)


@query("select p_partkey, coalesce(s_name, p_name) as name, s_suppkey is not null as manual from part left join supplier on p_partkey = s_suppkey and s_suppkey % 2 = 0")
def manual_patch(spark, d):
    t = Tables(spark, d)
    patches = t.supplier.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("p_partkey"), "s_name")
    return t.part.join(patches, "p_partkey", "left").select("p_partkey", F.coalesce("s_name", "p_name").alias("name"), F.col("s_name").isNotNull().alias("manual"))


@query(f"with {OBSERVATIONS_SQL}, alias as (select distinct notice as old_id, replace(notice, 'view', 'click') as id from observations where notice like '%view') select distinct notice from observations where day = date '2024-01-10' and notice not in (select coalesce(a.id, o.notice) from observations o left join alias a on o.notice = a.old_id where o.day < date '2024-01-10')")
def new_ids_anti(spark, d):
    """Current ids without the alias-resolved ids of the baseline."""
    seen = observations(Tables(spark, d))
    before = seen.where("day < date '2024-01-10'").select("notice").distinct()
    aliases = before.where(F.col("notice").endswith("view")).select(F.col("notice").alias("old_id"), F.regexp_replace("notice", "view", "click").alias("id"))
    resolved = before.join(aliases, F.col("notice") == F.col("old_id"), "left").select(F.coalesce("id", "notice").alias("notice"))
    return seen.where("day = date '2024-01-10'").select("notice").distinct().join(resolved, "notice", "left_anti")


@query(f"with {OBSERVATIONS_SQL} select event_id, notice from observations where seen_at > timestamp '2024-01-05' and seen_at <= timestamp '2024-01-06' and notice in (select notice from observations where day = date '2024-01-07')")
def changes_in_window(spark, d):
    """Changes in the half-open interval of notices that still exist."""
    seen = observations(Tables(spark, d))
    current = seen.where("day = date '2024-01-07'").select("notice").distinct()
    return seen.where("seen_at > timestamp_ntz '2024-01-05 00:00:00' and seen_at <= timestamp_ntz '2024-01-06 00:00:00'").join(current, "notice", "left_semi").select("event_id", "notice")


@query("""with s as (select user_id, ts, value from events where event_type = 'signup') select e.event_id, s.value as baseline from (select * from events where event_type = 'purchase') e
 asof left join s on e.user_id = s.user_id and e.ts > s.ts""")
def asof_snapshot(spark, d):
    """The latest snapshot strictly before each event."""
    events = Tables(spark, d).events
    left = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'signup'").select("user_id", "ts", F.col("value").alias("baseline"))
    return asof(left, right, "user_id", "ts", "baseline").select("event_id", "baseline")


_ORDER_SETS = "sets as (select o_orderkey as event, list(l_suppkey) as members from orders join lineitem on o_orderkey = l_orderkey group by 1)"


@query(f"with {_ORDER_SETS} select event, case when list_has_any(members, [1, 2, 3]) and not list_has_any(members, [4, 5, 6]) then 'new' when list_has_any(members, [1, 2, 3]) then 'repost' else 'old' end as kind from sets")
def event_new_vs_repost(spark, d):
    t = Tables(spark, d)
    sets = t.lineitem.groupBy(F.col("l_orderkey").alias("event")).agg(F.collect_set("l_suppkey").alias("members")).join(t.orders.select(F.col("o_orderkey").alias("event")), "event", "left_semi")
    fresh, base = (F.arrays_overlap("members", F.array(*[F.lit(x).cast("long") for x in ids])) for ids in ((1, 2, 3), (4, 5, 6)))
    return sets.select("event", F.when(fresh & ~base, "new").when(fresh, "repost").otherwise("old").alias("kind"))


@query("select l_suppkey as member, max(l_orderkey) as event from lineitem group by 1")
def member_explode_join(spark, d):
    """Members to their event; the later event wins."""
    return Tables(spark, d).lineitem.groupBy(F.col("l_suppkey").alias("member")).agg(F.max("l_orderkey").alias("event"))


@query(f"with {NOTICES_SQL} select a.id as a, b.id as b from notices a join notices b on a.owner_id = b.owner_id and a.deadline = b.deadline and a.id < b.id and a.source_id <> b.source_id")
def candidate_pairs(spark, d):
    """Pairs of one bucket that pass the guard."""
    n = notices(Tables(spark, d)).select("id", "owner_id", "deadline", "source_id")
    return n.alias("a").join(n.alias("b"), ["owner_id", "deadline"]).where("a.id < b.id and a.source_id <> b.source_id").select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


@query("""with firsts as (select l_suppkey as grp, list(distinct l_orderkey order by l_orderkey) as members from lineitem group by 1)
 select grp, coalesce((select min(m) from (select unnest(members) as m) where m % 10 = 0), list_min(members)) as event, len([x for x in members if x % 10 = 0]) > 0 as registered from firsts""")
def stable_event_ids(spark, d):
    """A group keeps the id of its first registered member, else takes its first member's."""
    rows = Tables(spark, d).lineitem.select(F.col("l_suppkey").alias("grp"), F.col("l_orderkey").alias("m")).distinct()
    found = rows.groupBy("grp").agg(F.min("m").alias("first"), F.min(F.when(F.col("m") % 10 == 0, F.col("m"))).alias("known"))
    return found.select("grp", F.coalesce("known", "first").alias("event"), F.col("known").isNotNull().alias("registered"))


@query("select distinct l_orderkey as event from lineitem where l_suppkey in (select s_suppkey from supplier where s_acctbal > 5000)")
def watchlist_semi(spark, d):
    t = Tables(spark, d)
    watched = t.supplier.where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    return t.lineitem.join(watched, "l_suppkey", "left_semi").select(F.col("l_orderkey").alias("event")).distinct()


@query("select distinct coalesce(n.n_regionkey + 1000, c.c_nationkey) as favourite from customer c left join nation n on c.c_nationkey = n.n_nationkey and n.n_nationkey % 2 = 0")
def favorite_alias(spark, d):
    t = Tables(spark, d)
    retired = t.nation.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_regionkey") + 1000).alias("live"))
    return t.customer.join(F.broadcast(retired), "c_nationkey", "left").select(F.coalesce("live", "c_nationkey").alias("favourite")).distinct()  # 25 nations


@query("select s_suppkey, coalesce(n_name, 'nation ' || s_nationkey) as nation, coalesce(r_name, 'unknown') as region from supplier left join nation on s_nationkey = n_nationkey and n_nationkey < 20 left join region on n_regionkey = r_regionkey")
def dim_lookup(spark, d):
    t = Tables(spark, d)
    dims = t.nation.where("n_nationkey < 20").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = t.supplier.join(F.broadcast(dims), F.col("s_nationkey") == F.col("n_nationkey"), "left")  # 25 nations
    return rows.select("s_suppkey", F.coalesce("n_name", F.concat(F.lit("nation "), F.col("s_nationkey"))).alias("nation"), F.coalesce("r_name", F.lit("unknown")).alias("region"))


_QUALITY = f"""{OBSERVATIONS_SQL}, n as (select day, source, notice, max(value > 20) as known from observations group by 1, 2, 3), z as (select day, source, count(*) as items from n group by 1, 2),
 c as (select a.day, a.source, count(*) as common, count(*) filter (where b.known) as previous_known, count(*) filter (where a.known) as current_known from n a join n b on a.source = b.source and a.notice = b.notice and a.day = b.day + 1 group by 1, 2),
 q as (select c.* from c join z on c.day = z.day and c.source = z.source join z y on c.day = y.day + 1 and c.source = y.source where z.items >= 5 and y.items >= 5 and common >= 5)"""


def _regressions(spark, d):
    seen = observations(Tables(spark, d))
    samples = seen.select("day", "source", "notice", (F.col("value") > 20).alias("known"))
    status = F.when(F.avg("value") < 23, "error").otherwise("ok")
    return regressions(samples, seen.groupBy("day", "source").agg(status.alias("status")))


@query(f"with {_QUALITY} select day, source, common, previous_known - current_known as lost from q")
def quality_regression(spark, d):
    """Yesterday against today on the common ids of each source."""
    return _regressions(spark, d).select("day", "source", "common", (F.col("previous_known") - F.col("current_known")).alias("lost"))


@query(f"""with {_QUALITY}, t as (select day, source, case when avg(value) < 23 then 'error' else 'ok' end as status from observations group by 1, 2)
 select q.day, q.source, previous_known - current_known >= 3 and (previous_known - current_known) / common >= 0.3 as regressed, coalesce(o.status = 'ok' and n.status = 'error', false) as failed
 from q left join t n on n.day = q.day and n.source = q.source left join t o on o.day + 1 = q.day and o.source = q.source""")
def quality_alerts(spark, d):
    """Alerts: a steep fall of known dates on the same notices, and a source that fails after it was well."""
    return _regressions(spark, d).select("day", "source", "regressed", "failed")


@query("""with old as (select o_orderkey as id, o_custkey % 5 as source, o_orderpriority as title, cast(o_orderdate as date) as due, lpad(cast(o_orderkey % 24 as varchar), 2, '0') || ':00' as due_clock from orders where o_orderkey % 3 <> 0),
 raw as (select o_orderkey as id, o_custkey % 5 as source, case when o_orderkey % 5 = 0 then null else o_orderpriority end as title, case when o_orderkey % 7 = 0 then cast(o_orderdate as date) + 3 when o_orderkey % 7 = 1 then null else cast(o_orderdate as date) end as due,
 case when o_orderkey % 2 = 0 then '23:59' end as due_clock, o_orderkey % 11 = 0 as ambiguous, 0 as nth from orders where o_orderkey % 4 <> 0),
 batch as (select * from raw union all select id, source, 'again', due, due_clock, ambiguous, 1 from raw where id % 13 = 0), new as (select * from batch qualify row_number() over (partition by id order by nth desc) = 1),
 m as (select coalesce(n.id, o.id) as id, coalesce(n.source, o.source) as source, coalesce(n.title, o.title) as title, case when n.id is null then o.due when n.ambiguous then null else coalesce(n.due, o.due) end as due,
 case when n.id is null then o.due_clock when n.ambiguous then null when n.due is not null and n.due is distinct from o.due then n.due_clock else coalesce(n.due_clock, o.due_clock) end as due_clock, o.id is not null as known, n.id is not null as seen, o.title as t, o.due as d, o.due_clock as c from old o full join new n on o.id = n.id),
 k as (select *, case when not seen then null when not known then case when source < 4 then 'new' else 'initial' end when title is distinct from t or due is distinct from d or due_clock is distinct from c then 'updated' end as change from m)
 select id, source, title, due, due_clock, change, case when change = 'updated' then d end as old_due, case when change = 'updated' then due end as new_due,
 case when known then timestamp '1998-01-01' else timestamp '1998-08-01' end as first_seen, case when seen then timestamp '1998-08-01' else timestamp '1998-01-01' end as last_seen, case when change is not null then timestamp '1998-08-01' else timestamp '1998-01-01' end as last_changed from k""")
def upsert_rules(spark, d):
    """A batch with repeated keys, missing values, new dates with and without clocks, and ambiguous rows, merged into the state."""
    order = F.col("o_orderdate").cast("date")
    rows = Tables(spark, d).orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).alias("source"), F.col("o_orderpriority").alias("title"), order.alias("due"), F.concat(F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit(":00")).alias("due_clock"))
    then = F.lit("1998-01-01").cast("timestamp_ntz")
    state = rows.where("id % 3 <> 0").select("*", *[then.alias(c) for c in ("first_seen", "last_seen", "last_changed")])
    batch = rows.where("id % 4 <> 0").withColumns({
        "title": F.when(F.col("id") % 5 != 0, F.col("title")), "due": F.when(F.col("id") % 7 == 0, F.date_add("due", 3)).when(F.col("id") % 7 != 1, F.col("due")),
        "due_clock": F.when(F.col("id") % 2 == 0, "23:59"), "ambiguous": F.col("id") % 11 == 0, "nth": F.lit(0),
    })
    batch = batch.unionByName(batch.where("id % 13 = 0").withColumns({"title": F.lit("again"), "nth": F.lit(1)}))
    rules = Rules("id", "source", ["source", "title", "due", "due_clock"], ["title", "due", "due_clock"], ["nth"], (("ambiguous", ["due", "due_clock"]),), (("due", "due_clock"),))
    return merge(state, batch, rules, rows.where("source < 4").select("source"), F.lit("1998-08-01").cast("timestamp_ntz")).drop("old_due_clock", "new_due_clock")
