"""Connected components of an edge table by alternating large-star and small-star steps.

Edges stay in Spark. First every partition of at most `PART_EDGES` edges is contracted to stars by a
union-find in its task; where that leaves several partitions, rounds of two aggregations by node with
map-side minima follow, written to the shared folder, until the edges no longer change. Every component
ends as a star around its smallest node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import stored

MAX_ROUNDS = 60
PART_EDGES = 400_000


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of one partition as stars around the smallest node of each of its components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = [x for x in parent if root(x) != x]
    yield pd.DataFrame({"a": np.array([root(x) for x in nodes], dtype=np.int64), "b": np.array(nodes, dtype=np.int64)})


def components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> (node, component) for every node that has an edge to another node."""
    pairs = stored(_ordered(edges.select("a", "b")), "component-edges")
    parts = -(-pairs.count() // PART_EDGES)
    pairs = stored(pairs.repartition(max(1, parts)).mapInPandas(_stars, "a long, b long"), "component-edges")
    known = None
    for _ in range(MAX_ROUNDS if parts > 1 else 0):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: every larger neighbour of a node moves to the smallest of the node and its neighbours
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = _ordered(large)  # a < b: b is the larger node
        # small star: a node and its smaller neighbours move to the smallest of them
        small = large.groupBy("b").agg(F.min("a").alias("low"))
        moved = large.join(small, "b").select("a", "b", "low")
        star = moved.select(F.col("low").alias("a"), "b").unionByName(moved.select(F.col("low").alias("a"), F.col("a").alias("b")))
        pairs = stored(_ordered(star), "component-edges")
        seen = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == known:
            break
        known = seen
    else:
        if parts > 1:
            raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return pairs.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(pairs.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
