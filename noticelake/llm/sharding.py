"""Contiguous shards of near-equal bytes from global prefix sums.

Rows are ordered by (doc_id, text checksum, size). A range exchange of narrow rows gives ordered
partitions, the totals of the partitions are summed into offsets (one row a partition), and a
running sum inside each partition completes the global prefix. Shard k of n takes the rows whose
byte midpoint lies in the k-th n-th of all bytes, so shards are contiguous in that order and differ
from an equal split by at most one row at either end.

Texts never move in the plan: `shard_plan` works on ids and sizes, `assign_shards` joins them back.

Defined cases: a null text has size 1 and checksum 0; a null doc_id sorts first; equal rows are
numbered and keep one place each; a text longer than a shard's part has a shard's place to itself; an
empty table gives an empty result; other columns are carried whatever their names, but columns named
like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import stored
from .columns import Shield

RESULTS = ["size", "text_crc32", "shard", "slot"]
_KEY = ["id_key", "id_null", "text_crc32", "size", "copy"]


def _sized(docs: Shield) -> DataFrame:
    text = docs["text"].cast("string")
    return docs.frame.select(
        *docs.carried(), docs["doc_id"].alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )


def _placed(rows: DataFrame, n_shards: int) -> DataFrame:
    """rows(doc_id, text_crc32, size): one result row for each, with shard and slot."""
    spark = rows.sparkSession
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = stored(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "shard-order")

    totals = ordered.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(everything).alias("all_bytes"),
    )
    within = Window.partitionBy("part").orderBy(*order)
    running = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ordered.join(F.broadcast(offsets), "part").select(  # one row for each shuffle partition
        "doc_id", "text_crc32", "size",
        (F.col("bytes_before") + F.sum("size").over(running)).alias("bytes_through"),
        (F.col("rows_before") + F.row_number().over(within) - 1).alias("place"),
        "all_bytes",
    ).withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"((2 * bytes_through - size) * {n_shards}) div (2 * all_bytes)")).cast("int"))
    return placed.drop("bytes_through", "all_bytes")


def _slotted(placed: DataFrame) -> DataFrame:
    placed = stored(placed, "shard-places")
    first = placed.groupBy("shard").agg(F.min("place").alias("first_place"))
    return placed.join(F.broadcast(first), "shard").withColumn("slot", (F.col("place") - F.col("first_place")).cast("long")).drop("place", "first_place")  # one row a shard


def shard_plan(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of docs(doc_id, text)."""
    rows = _sized(Shield(docs)).select("doc_id", "text_crc32", "size")
    return _slotted(_placed(rows, n_shards)).select("doc_id", *RESULTS)


def assign_shards(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """docs with size, text_crc32, shard and slot added; each row of docs comes back once.

    Rows of one id and text are numbered on both sides and meet by number.
    """
    shield = Shield(docs)
    key = {"id_key": F.coalesce("doc_id", F.lit(0)), "id_null": F.col("doc_id").isNull()}  # plain keys: one exchange serves the numbering and the join
    same = Window.partitionBy("id_key", "id_null", "text_crc32", "size")
    others = F.xxhash64(F.lit(0), *[f"_{i}" for i, name in enumerate(shield.names) if name not in ("doc_id", "text")])
    rows = _sized(shield).withColumns(key).withColumn("copy", F.row_number().over(same.orderBy(others))).drop("doc_id")
    plan = _slotted(_placed(_sized(shield).select("doc_id", "text_crc32", "size"), n_shards))
    plan = plan.withColumns(key).withColumn("copy", F.row_number().over(same.orderBy("shard", "slot"))).drop("doc_id")
    return rows.join(plan, _KEY).select(*shield.restored(RESULTS), *RESULTS)
