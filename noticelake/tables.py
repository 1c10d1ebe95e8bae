"""Loading tables, and the observation views that the queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The instant that stands for "now" in the queries; never the wall clock.
NOW = "1998-08-01"


class Tables:
    """Tables of one folder, read when they are first asked for: t.orders, t.pages, ..."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def notices(t: Tables) -> DataFrame:
    """Orders seen as notices with deadlines; status P stands for an unknown clock and an unstated status."""
    day = F.col("o_orderdate").cast("date")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_custkey") % 5).alias("source_id"),
        (F.col("o_custkey") % 97).alias("owner_id"),
        F.concat(F.lit("Order "), F.col("o_orderkey")).alias("title"),
        day.alias("deadline"),
        F.when(F.col("o_orderstatus") != "P", F.concat(two(F.col("o_orderkey") % 24), F.lit(":"), two(F.col("o_orderkey") % 60))).alias("deadline_time"),
        F.date_sub(day, 20).alias("opened"),
        F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "closed").alias("platform_status"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderpriority").alias("priority"),
    )


NOTICES_SQL = """notices as (select o_orderkey as id, o_custkey % 5 as source_id, o_custkey % 97 as owner_id, 'Order ' || o_orderkey as title,
 cast(o_orderdate as date) as deadline,
 case when o_orderstatus <> 'P' then lpad(cast(o_orderkey % 24 as varchar), 2, '0') || ':' || lpad(cast(o_orderkey % 60 as varchar), 2, '0') end as deadline_time,
 cast(cast(o_orderdate as date) - 20 as date) as opened, case o_orderstatus when 'O' then 'open' when 'F' then 'closed' end as platform_status,
 o_totalprice as price, o_orderpriority as priority from orders)"""


def observations(t: Tables) -> DataFrame:
    """Events seen as observations: notice (user, type), source (type), instant and day."""
    return t.events.select(
        F.concat(F.col("user_id"), F.lit(":"), F.col("event_type")).alias("notice"),
        F.col("event_type").alias("source"),
        F.col("ts").alias("seen_at"),
        F.col("ts").cast("date").alias("day"),
        "event_id",
        "value",
    )


OBSERVATIONS_SQL = """observations as (select user_id || ':' || event_type as notice, event_type as source, ts as seen_at, cast(ts as date) as day, event_id, value from events)"""

#: Documents with the verdict of their labels: included, excluded, or pending where there is none.
VERDICTS_SQL = """verdicts as (select d.doc_id, d.text, d.lang, d.source, d.n_chars, case l.quality when 1 then 'included' when 0 then 'excluded' else 'pending' end as verdict
 from documents d left join (select doc_id, max(quality) as quality from labels group by doc_id) l on d.doc_id = l.doc_id)"""


def verdicts(t: Tables) -> DataFrame:
    labels = t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    verdict = F.when(F.col("quality") == 1, "included").when(F.col("quality") == 0, "excluded").otherwise("pending")
    return t.documents.join(labels, "doc_id", "left").select("doc_id", "text", "lang", "source", "n_chars", verdict.alias("verdict"))
