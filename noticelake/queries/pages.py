"""Captured pages: links, listings, details, robots and registration windows."""

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import fields as L
from ..functions import text as X
from ..sources import html as H
from ..tables import NOTICES_SQL, Tables, notices


@query()
def pages_links(spark, d):
    """Same-host links of every page."""
    pages = H.spread(Tables(spark, d).pages)
    return pages.select("page_id", F.posexplode(H.page_links(F.col("url"), F.col("html"))).alias("place", "link")).select("page_id", "place", "link.url", "link.title")


def _canonical_sql(url: str, base: str) -> str:
    """Addresses of the pages' links, which are paths on the page's host without queries; the page's own scheme and host in lower case."""
    return f"lower(regexp_extract({base}, '^(https?://[^/?#]+)', 1)) || regexp_replace({url}, '#.*$', '')"


_ANCHORS_SQL = """anchors as (select page_id, url as base, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) as href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) as title, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">', 1), 1) as place from pages)"""


@query(f"""with {_ANCHORS_SQL}, kinds as (select *, case page_id % 3 when 0 then 'k2web' when 1 then 'mangboard' else 'dacon' end as kind, {_canonical_sql("href", "base")} as target from anchors where starts_with(href, '/')),
 good as (select page_id, kind, target, trim(regexp_replace(title, '\\s+', ' ', 'g')) as title, place from kinds where length(trim(title)) >= 4 and regexp_matches(target, case page_id % 3 when 0 then '/[a-m][^/]*$' when 1 then '/[^/]*e[^/]*$' else '/[^/]+$' end)),
 ranked as (select *, row_number() over (partition by page_id, target order by place desc) as nth from good)
 select page_id, target as url, left(sha256(target), 20) as id, title, kind = 'dacon' as platform, count(*) over (partition by page_id) as recognised from ranked where nth = 1""")
def listing_udtf(spark, d):
    """Notices that listings show, by a table of sources with a pattern of addresses each; here every page is a listing of its own source."""
    pages = Tables(spark, d).pages
    which = F.col("page_id") % 3
    kind = F.when(which == 0, "k2web").when(which == 1, "mangboard").otherwise("dacon")
    pattern = F.when(which == 0, "/[a-m][^/]*$").when(which == 1, "/[^/]*e[^/]*$").otherwise("/[^/]+$")
    sources = pages.select(F.col("page_id").cast("string").alias("id"), kind.alias("kind"), F.lit("platform").alias("mode"), "url", pattern.alias("link_pattern"))
    shown = H.listings(pages.select("page_id", F.col("page_id").cast("string").alias("source_id"), F.col("url").alias("page_url"), "html"), sources)
    return shown.select("page_id", "url", "id", "title", (F.col("page_id") % 3 == 2).alias("platform"), "recognised")


@query()
def detail_extract(spark, d):
    """What every page states of its notice; nested results as JSON."""
    found = H.details(Tables(spark, d).pages.select("page_id", "url", "html")).drop("url", "html")
    return found.withColumns({"milestones": F.to_json("milestones"), "facets": F.to_json("facets")})


@query("""select page_id, case page_id % 3 when 0 then not contains(url, '/en/') when 1 then true else false end as allowed from pages""")
def robots_gate(spark, d):
    """Three files of rules: one closed folder, no file, and everything closed but to another agent."""
    which = F.col("page_id") % 3
    robots = F.when(which == 0, "User-agent: *\nDisallow: /en/\n").when(which == 2, "User-agent: other\nAllow: /\n\nUser-agent: *\nDisallow: /\n")
    return Tables(spark, d).pages.select("page_id", H.robots_allowed(robots, F.col("url")).alias("allowed"))


@query(f"with {NOTICES_SQL} select id, case when id % 3 = 0 or deadline < date '2000-01-21' then null else cast(opened as varchar) end as starts, case when id % 3 = 0 or deadline < date '2000-01-21' then null else cast(deadline as varchar) end as ends from notices")
def registration_window(spark, d):
    """Labelled periods; two different ones contradict each other, and years before 2000 are no dates here."""
    rows = notices(Tables(spark, d)).where("deadline is not null")
    period = lambda shift: F.concat(F.lit("접수기간: "), F.date_format(F.date_add("opened", shift), "yyyy. M. d."), F.lit(" ~ "), F.date_format(F.date_add("deadline", shift), "yyyy. M. d."))
    text = F.when(F.col("id") % 3 == 0, F.concat_ws("\n", period(0), period(1))).when(F.col("deadline") < F.lit("2000-01-21").cast("date"), F.lit("접수기간: 9/1 ~ 10/31")).otherwise(period(0))
    found = rows.select("id", L.registration(L.entries(text), F.lit(None).cast("string")).alias("w"))
    return found.select("id", F.col("w.starts").cast("string").alias("starts"), F.col("w.ends").cast("string").alias("ends"))
