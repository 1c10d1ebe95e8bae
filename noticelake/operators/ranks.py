"""Ranks inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import stored


def ranked(rows: DataFrame, by: str, order: list[Column], name: str) -> DataFrame:
    """rows with the place of each in the order of its group, as `name`.

    A range exchange by group and order spreads a large group over partitions, whose counts (one row a partition and group) become offsets;
    no group is sorted in one task. The order must tell all rows of a group apart.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = stored(rows.repartitionByRange(parts, F.col(by), *order).withColumn("rank_part", F.spark_partition_id()), "ranked")
    counts = laid.groupBy(by, "rank_part").agg(F.count("*").alias("rank_rows"))
    earlier = Window.partitionBy(by).orderBy("rank_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(by, "rank_part", F.coalesce(F.sum("rank_rows").over(earlier), F.lit(0)).alias("rank_before"))
    place = F.row_number().over(Window.partitionBy("rank_part", by).orderBy(*order))
    return laid.withColumn(name, place).join(offsets, [by, "rank_part"]).withColumn(name, (F.col(name) + F.col("rank_before")).cast("int")).select(*rows.columns, name)
