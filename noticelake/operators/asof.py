"""As-of lookups without a per-row search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: str, at: str, value: str, strict: bool = True) -> DataFrame:
    """left with `value` of the latest right row of the same key before (or at) its instant: one union, one sorted window."""
    marked = left.select(by, at, F.struct(*left.columns).alias("row"), F.lit(None).cast(right.schema[value].dataType).alias(value), F.lit(0 if strict else 1).alias("side"))
    facts = right.select(by, at, F.lit(None).cast(marked.schema["row"].dataType).alias("row"), value, F.lit(1 if strict else 0).alias("side"))
    order = Window.partitionBy(by).orderBy(at, "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = marked.unionByName(facts).withColumn(value, F.last(value, ignorenulls=True).over(order))
    return found.where("row is not null").select("row.*", value)
