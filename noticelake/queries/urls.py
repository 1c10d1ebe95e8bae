"""URL identity and guards."""

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import identity as I
from ..functions import urls as U
from ..tables import Tables

_CANON = """regexp_replace(regexp_replace(split_part(url, '#', 1), '\\?utm_source=[a-z]+$', ''), '^(https?://[^/]+)$', '\\1/')"""


@query(f"select page_id, {_CANON} as canonical from pages")
def canonical_url(spark, d):
    return Tables(spark, d).pages.select("page_id", U.canonical_url(F.col("url")).alias("canonical"))


@query(f"select page_id, left(sha256({_CANON}), 20) as id from pages")
def url_hash_id(spark, d):
    return Tables(spark, d).pages.select("page_id", U.url_id(U.canonical_url(F.col("url"))).alias("id"))


@query("select page_id, url like 'https://%' as public from pages")
def public_url_guard(spark, d):
    return Tables(spark, d).pages.select("page_id", U.public_url(F.col("url")).alias("public"))


_KEY = "regexp_extract(url, '^https?://([^/?#]+)/([^/?#]+)/([^/?#]+)', {0})"


@query(f"select page_id, case when {_KEY.format(3)} <> '' then {_KEY.format(1)} || ':' || {_KEY.format(2)} || ':' || {_KEY.format(3)} else '' end as key from pages")
def platform_key(spark, d):
    return Tables(spark, d).pages.select("page_id", U.platform_key(F.col("url")).alias("key"))


@query("""select page_id, case page_id % 5 when 0 then 'dacon:official:' || page_id when 1 then '' when 2 then 'aifactory:' || page_id when 3 then 'linked:https://x.org/events/name' || page_id else '' end as key from pages""")
def official_key(spark, d):
    """Own platform id, else the only linked one, else the first linked address of a single event; several linked platforms give none."""
    which, number = F.col("page_id") % 5, F.col("page_id").cast("string")
    own = F.when(which == 0, F.concat(F.lit("https://dacon.io/competitions/official/"), number, F.lit("/overview/"))).otherwise(F.col("url"))
    application = F.when(which.isin(1, 2), F.concat(F.lit("https://aifactory.space/ko/competitions/"), number)).when(which == 3, F.lit("https://www.campuspick.com/contest/view"))
    website = F.when(which == 1, F.concat(F.lit("https://www.dacon.io/competitions/open/"), number)).when(which == 3, F.concat(F.lit("https://x.org/events/name"), number)).when(which == 4, F.lit("https://x.org/"))
    return Tables(spark, d).pages.select("page_id", I.official_key(own, application, website, F.lit(None).cast("string")).alias("key"))


@query("select page_id, false as blocked from pages where not regexp_matches(left(html, 12000), '(?i)access denied|captcha|verify you are human|too many requests')")
def scan_blocked_pages(spark, d):
    from ..functions.text import BLOCK_PAGE

    pages = Tables(spark, d).pages.withColumn("blocked", F.left("html", F.lit(12000)).rlike(BLOCK_PAGE))
    return pages.where("not blocked").select("page_id", "blocked")
