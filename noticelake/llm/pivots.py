"""Near-duplicate vectors through a pivot-permutation index.

Vectors are compared inside their label. Each is described by its `PREFIX` nearest pivots, ordered by
distance; pivots are a bounded sample of the vectors of one label, and their number grows with the label
up to `MAX_PIVOTS`. The inverted list of a pivot holds the vectors that have it in their prefix. Pairs in
a list that share at least `SHARED` pivots are candidates, each looked at only in the list of the
smallest pivot they share, and verified by cosine in double precision. Lists are cut into blocks and
every pair of blocks is one task, so a long list is spread over many tasks; tasks return link counts
and a spanning forest, never all pairs. Beyond `MAX_PIVOTS` * `LIST_LENGTH` / `PREFIX` vectors of one
label lists grow with the label.

Vectors that are equal are one class: their copies count as links of each other without being paired.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and those
without a label, link with nothing; vectors of different length do not link; lengths as small or large
as doubles allow are compared by direction alike; ties of distance go to the pivot with the smaller
number; rows that share a vec_id count as separate vectors of one component; a null vec_id never links;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from ..workspace import stored

COSINE = 0.93
PREFIX, SHARED = 8, 3
MIN_PIVOTS, MAX_PIVOTS, LIST_LENGTH = 16, 1024, 256
LIST_BLOCK, SLICE, SALTS = 512, 4096, 16
SPACE = ["label", "dims"]


def unit_rows(vectors: list) -> np.ndarray:
    """Rows of length one; each is scaled by its largest component first, so that no square leaves the range of doubles."""
    rows = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _counted(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with the number of rows of their key. The join is salted, as one key may hold a large part of all rows."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias(name)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.col("class"), F.lit(SALTS)).cast("int")).join(sizes, [*keys, "salt"]).drop("salt")


def prefixes(classes: DataFrame) -> DataFrame:
    """(class, label, dims, copies, embedding, prefix): prefix holds the PREFIX nearest pivots of each vector, nearest first."""
    counted = _counted(classes.select("class", *SPACE, "copies", "embedding"), SPACE, "members")
    wanted = F.least(F.lit(MAX_PIVOTS), F.greatest(F.lit(MIN_PIVOTS), F.floor(F.col("members") * PREFIX / LIST_LENGTH)))
    sliced = stored(counted.select("*", wanted.alias("wanted"), F.ceil(F.col("members") / SLICE).alias("slices")).withColumn("slice", F.pmod(F.xxhash64("class", F.lit(1)), F.col("slices")).cast("int")), "vector-slices")
    # a cut of the hash leaves little more than the wanted pivots of each label, so that no label is ranked whole
    place = F.pmod(F.xxhash64("class", F.lit(2)), F.lit(1_000_003))
    near = sliced.withColumn("place", place).where(F.col("place") < 1_000_003 * (F.col("wanted") + 6 * F.sqrt("wanted") + 20) / F.col("members"))
    ranked = near.withColumn("pivot", F.row_number().over(Window.partitionBy(*SPACE).orderBy("place", "class")) - 1).where("pivot < wanted")
    pivots = ranked.select(*SPACE, "pivot", "embedding", F.explode(F.sequence(F.lit(0), (F.col("slices") - 1).cast("int"))).alias("slice"))

    def nearest(vectors: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors):
            return pd.DataFrame({name: [] for name in ("class", "label", "dims", "copies", "embedding", "prefix")})
        own = own.sort_values("pivot")
        order = np.argsort(-(unit_rows(vectors["embedding"].tolist()) @ unit_rows(own["embedding"].tolist()).T), axis=1, kind="stable")[:, :PREFIX]
        return vectors[["class", "label", "dims", "copies", "embedding"]].assign(prefix=list(order.astype(np.int32)))

    key = [*SPACE, "slice"]
    schema = f"class long, label {classes.schema['label'].dataType.simpleString()}, dims int, copies long, embedding array<double>, prefix array<int>"
    return stored(sliced.select("class", *key, "copies", "embedding").groupBy(*key).cogroup(pivots.groupBy(*key)).applyInPandas(nearest, schema), "vector-prefixes")


def _compare(pivot: int, left: pd.DataFrame, right: pd.DataFrame | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices of linked pairs (left, right), or inside left where right is None."""
    other = left if right is None else right
    a, b = np.stack(left["prefix"]), np.stack(other["prefix"])
    top = max(a.max(), b.max()) + 1
    hot_a, hot_b = (np.zeros((len(x), top), dtype=np.float32) for x in (a, b))
    np.put_along_axis(hot_a, a.astype(np.int64), 1, axis=1)
    np.put_along_axis(hot_b, b.astype(np.int64), 1, axis=1)
    need = min(SHARED, a.shape[1])
    candidate = hot_a @ hot_b.T >= need
    candidate &= hot_a[:, :pivot] @ hot_b[:, :pivot].T == 0  # the smallest shared pivot is this one
    candidate &= unit_rows(left["embedding"].tolist()) @ unit_rows(other["embedding"].tolist()).T >= COSINE
    if right is None:
        candidate &= np.tri(len(a), k=-1, dtype=bool).T
    return np.nonzero(candidate)


def _links_of(rows: pd.DataFrame) -> pd.DataFrame:
    """Link counts and a spanning forest of one pair of blocks of one list."""
    low, high, pivot = rows["low"].iloc[0], rows["high"].iloc[0], int(rows["pivot"].iloc[0])
    left = rows[rows["block"] == low].reset_index(drop=True)
    right = None if low == high else rows[rows["block"] == high].reset_index(drop=True)
    i, j = _compare(pivot, left, right) if len(left) and (right is None or len(right)) else (np.zeros(0, int),) * 2
    other = left if right is None else right
    a, b = left["class"].to_numpy()[i], other["class"].to_numpy()[j]
    counts = pd.concat([pd.DataFrame({"class": a, "links": other["copies"].to_numpy()[j]}), pd.DataFrame({"class": b, "links": left["copies"].to_numpy()[i]})]).groupby("class", as_index=False)["links"].sum()
    forest = _forest(zip(a.tolist(), b.tolist()))
    return pd.concat([counts.assign(a=None, b=None), pd.DataFrame(forest, columns=["a", "b"]).assign(**{"class": None, "links": None})])[["class", "links", "a", "b"]].astype("Int64")


def _forest(pairs) -> list[tuple[int, int]]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def near_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding, label)."""
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    usable = F.coalesce(
        F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0),
        F.lit(False),
    )
    rows = vectors.select("vec_id", F.when(usable, F.xxhash64("label", doubles)).alias("class"), F.when(usable, F.col("label")).alias("label"), F.when(usable, doubles).alias("embedding"))
    grouped = rows.where("class is not null").groupBy("class", "label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = stored(grouped.withColumn("dims", F.size("embedding")), "vector-classes")
    listed = prefixes(classes).withColumn("pivot", F.explode("prefix"))
    blocked = _counted(listed, [*SPACE, "pivot"], "length").withColumn("blocks", F.ceil(F.col("length") / LIST_BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    paired = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    tasks = paired.select(*SPACE, "pivot", "low", "high", "block", "class", "copies", "prefix", "embedding")
    found = stored(tasks.groupBy(*SPACE, "pivot", "low", "high").applyInPandas(_links_of, "class long, links long, a long, b long"), "vector-links")
    counts = found.where("class is not null").groupBy("class").agg(F.sum("links").alias("links"))
    # different vectors of one vec_id are one component
    shared = rows.where("class is not null").groupBy("vec_id").agg(F.min("class").alias("a"), F.max("class").alias("top")).where("a <> top").select("vec_id", "a")
    same = rows.where("class is not null").join(shared, "vec_id").select("a", F.col("class").alias("b"))
    joined = components(found.where("a is not null").select("a", "b").unionByName(same))
    placed = classes.select("class", "rep", "copies").join(counts, "class", "left").join(joined, F.col("class") == F.col("node"), "left").withColumn("component", F.coalesce("component", "class"))
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    merged = placed.join(least, "component").select("class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "component_id")
    result = rows.select("vec_id", "class").join(merged, "class", "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
