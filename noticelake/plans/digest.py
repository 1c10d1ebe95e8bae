"""Messages of a bounded size in bytes, put together from lines of several kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT = 2600


def clipped(lines: DataFrame, by: list[str], order: list[str], limit: int = LIMIT) -> DataFrame:
    """(by, message): the lines of a message in order, joined by line breaks and cut at `limit` bytes of UTF-8, never inside a character.

    lines(by, order, line); order tells the lines of a message apart; null lines are left out. A line takes a byte at least, so only the first `limit` + 1 lines of a message can count, and no more than
    those are sorted or gathered for it, however many lines it has; running sums of bytes say where it ends.
    """
    turn = Window.partitionBy(*by).orderBy(*order)
    first = lines.where("line is not null").withColumn("nth", F.row_number().over(turn)).where(F.col("nth") <= limit + 1)
    size = F.octet_length("line") + 1
    placed = first.withColumn("before", F.sum(size).over(turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size)
    room = (F.lit(limit) - F.col("before")).cast("int")
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode("line", "UTF-8"), F.lit(1), room).cast("string")), "\\ufffd+$", "")
    kept = placed.where(room >= 0).select(*by, "nth", F.when(F.octet_length("line") > room, cut).otherwise(F.col("line")).alias("line"), (room == 0).alias("full"))
    # a message that ends with a line break has no room for a letter after it
    texts = F.array_sort(F.collect_list(F.struct("nth", "line", "full")))  # at most limit + 1 lines of limit bytes in all
    return kept.groupBy(*by).agg(texts.alias("lines")).select(*by, F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("message"))
