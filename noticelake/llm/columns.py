"""Names of columns: operators that carry a caller's columns work on a frame whose names are all their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Shield:
    """A frame with its columns renamed `_0`, `_1`, ..., so that no name an operator uses can clash with them."""

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        self.frame = docs.toDF(*[f"_{i}" for i in range(len(self.names))])

    def __getitem__(self, name: str) -> Column:
        return F.col(f"_{self.names.index(name)}")

    def carried(self) -> list[str]:
        return [f"_{i}" for i in range(len(self.names))]

    def restored(self, without: list[str] = ()) -> list[Column]:
        """The caller's columns under their own names, but for those that results replace."""
        return [F.col(f"_{i}").alias(name) for i, name in enumerate(self.names) if name not in without]
