"""Fair round-robin budgets over sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fair_budget(rows: DataFrame, source: str, order: list[Column], budget: int, key: str) -> DataFrame:
    """rows with `taken`: one of each source per round, sources in order, until the budget is spent.

    Only the first `budget` rows of each source can be taken, so the global order is over that bounded
    set: ranks inside sources are limited before the ordered limit, which keeps `budget` rows a task.
    """
    ranked = rows.withColumn("turn", F.row_number().over(Window.partitionBy(source).orderBy(*order, key)))
    chosen = ranked.where(F.col("turn") <= budget).orderBy("turn", source).limit(budget).select(key, F.lit(True).alias("taken"))
    return ranked.join(chosen, key, "left").withColumn("taken", F.coalesce("taken", F.lit(False)))
