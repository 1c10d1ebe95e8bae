"""Requests applied to a state once: validated before anything changes, and kept in a ledger of the same version as the state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import requests as R
from ..functions import urls as U
from ..sources.versions import read_version, write_version
from ..workspace import stored

#: Fixed value: how many notices may be added by hand.
MAX_ADDED = 300
ENTRIES, LEDGER = "kind string, url string, number long, payload string", "number long, kind string, status string"


def judged(requests: DataFrame, ledger: DataFrame, today: Column) -> DataFrame:
    """requests(number, kind, payload) with broken (rules) and status: already_applied, rejected, review_required (reports change nothing) or applied.

    A number counts once, in a batch, too: the first by kind and payload. Numbers below one and null ones are rejected.
    """
    told = requests.withColumn("broken", R.broken_rules(F.col("kind"), F.col("payload"), today))
    told = told.withColumn("broken", F.when(F.coalesce(F.col("number") > 0, F.lit(False)), F.col("broken")).otherwise(F.concat(F.array(F.lit("number")), "broken")))
    first = F.row_number().over(Window.partitionBy("number").orderBy(F.size("broken"), "kind", "payload"))
    known = ledger.where("status = 'applied'").select("number", F.lit(True).alias("known")).distinct()
    numbered = told.withColumn("nth", first).join(known, "number", "left")
    status = F.when(F.col("known") | ((F.col("nth") > 1) & (F.col("number") > 0)), "already_applied").when(F.size("broken") > 0, "rejected").when(F.col("kind") == "report", "review_required").otherwise("applied")
    return numbered.select("number", "kind", "payload", "broken", status.alias("status"))


def applied(entries: DataFrame, found: DataFrame) -> DataFrame:
    """entries(kind, url, number, payload), one a kind and address, after judged requests: the highest number of each counts, and fields that a correction leaves out keep their former values."""
    new = found.where("status = 'applied'").select("kind", U.canonical_url(F.get_json_object("payload", "$.url")).alias("url"), "number", "payload")
    fields = lambda payload: F.from_json(payload, "map<string,string>")
    rows = entries.select("kind", "url", "number", "payload").unionByName(new)
    # corrections add up field by field, in the order of their numbers; a notice that is added anew replaces the former
    each = rows.where("kind = 'correct_notice'").select("kind", "url", "number", F.explode(fields(F.col("payload"))).alias("field", "value"))
    fielded = each.groupBy("kind", "url", "field").agg(F.max_by("value", "number").alias("value"), F.max("number").alias("number"))
    corrected = fielded.groupBy("kind", "url").agg(F.max("number").alias("number"), F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value"))))).alias("payload"))  # one entry a field
    added = rows.where("kind = 'add_notice'").groupBy("kind", "url").agg(F.max_by("payload", "number").alias("payload"), F.max("number").alias("number"))
    return corrected.select("kind", "url", "number", "payload").unionByName(added.select("kind", "url", "number", "payload"))


def take_in(spark: SparkSession, folder: str, requests: DataFrame, today: Column) -> DataFrame:
    """Apply requests to the state in a folder and give what became of each; entries and ledger are one version.

    Where nothing is applied nothing is written. A batch that would bring more notices than may be added by hand is refused whole.
    """
    now = read_version(spark, folder) or {"entries": spark.createDataFrame([], ENTRIES), "ledger": spark.createDataFrame([], LEDGER)}
    found = stored(judged(requests, now["ledger"], today), "requests")
    if not found.where("status = 'applied'").limit(1).count():
        return found
    after = applied(now["entries"], found)
    if after.where("kind = 'add_notice'").count() > MAX_ADDED:
        raise ValueError(f"at most {MAX_ADDED} notices can be added by hand")
    ledger = now["ledger"].unionByName(found.where("status = 'applied'").select("number", "kind", "status"))
    write_version(folder, {"entries": after, "ledger": ledger})
    return found
