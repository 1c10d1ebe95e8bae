"""A Merkle manifest of a dataset, reduced in superblocks.

Every row is a leaf: the SHA-256 of its fields, taken by Spark where the row is read, so texts never move. A range exchange of narrow rows gives
every leaf its place among the leaves of its group. One step of the reduction puts the nodes of a group into buckets of fanout^levels by
their place; a bucket is one group of `applyInPandas`, which collapses its levels and leaves one root a bucket, the proof of each of its
nodes up to there, and the value to which a changed node folds. Bucket roots are reduced in the same way until each group has one node. Going back, a
node's proof is what its bucket gave, followed by the proof of its bucket; the same steps over the roots of the groups end in one root.

Buckets hold at most fanout^levels nodes whatever the group, so a group with all rows is spread like any other. The number of steps is
log(rows of the largest group) / (levels * log(fanout)).

Defined cases: a null field counts as `-`; rows with a null id come first in their group; equal ids are ordered by leaf and equal rows keep one leaf each;
null groups are a group of their own, before the others, which are ordered by their UTF-8 bytes; a group of one leaf has that leaf as its root, and the
only group's root is the root of all; a last node without a neighbour is hashed alone; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import discard, stored

FANOUT = 2
#: Levels that one step collapses: buckets of 256 nodes.
LEVELS = 8
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: What is added to a proof: siblings as hex text, and for each level how many siblings stand before and after the node.
_BUCKET = "tree string, place long, nodes long, root string, changed string, siblings array<string>, before array<int>, after array<int>, key long"


def framed(value: Column) -> Column:
    """A field as its UTF-8 byte count, a colon and its value; `-` where it is null."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[framed(f) for f in fields]), 256)


def _hash(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _collapse(fanout: int, levels: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """One bucket: its nodes by place -> for each node the bucket's root, what a changed node folds to, and its siblings by level."""

    def bucket(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place", kind="stable")
        nodes, current, total = rows["digest"].tolist(), rows["changed"].tolist(), int(rows["nodes"].iloc[0])
        at, n = np.arange(len(nodes)), len(nodes)
        siblings, before, after = [[] for _ in range(n)], [[] for _ in range(n)], [[] for _ in range(n)]
        for _ in range(levels):
            if total == 1:
                break
            runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
            for i, place in enumerate(at.tolist()):
                run, mine = runs[place // fanout], place % fanout
                left, right = run[:mine], run[mine + 1 :]
                siblings[i] += left + right
                before[i].append(len(left))
                after[i].append(len(right))
                current[i] = _hash([*left, current[i], *right])
            nodes, at, total = [_hash(run) for run in runs], at // fanout, -(-total // fanout)
        return pd.DataFrame({"tree": rows["tree"], "place": int(key[1]), "nodes": rows["nodes"], "root": nodes[0], "changed": current, "siblings": siblings, "before": before, "after": after, "key": rows["key"]})

    return bucket


def _folded(value: Column, siblings: Column, before: Column, after: Column) -> Column:
    """What a node becomes on its way up, from its siblings by level."""
    start = F.struct(value.alias("node"), F.lit(1).alias("at"))
    part = lambda at, n: F.array_join(F.slice(siblings, at, n), "")

    def step(acc: Column, counts: Column) -> Column:
        left = part(acc["at"], counts["before"])
        right = part(acc["at"] + counts["before"], counts["after"])
        return F.struct(F.sha2(F.concat(left, acc["node"], right), 256).alias("node"), (acc["at"] + counts["before"] + counts["after"]).alias("at"))

    return F.aggregate(F.arrays_zip(before.alias("before"), after.alias("after")), start, step)["node"]


def _placed(leaves: DataFrame, read: list[DataFrame]) -> DataFrame:
    """leaves(tree, order, leaf, ...) with place, from 0, of each in its tree and nodes, how many the tree has.

    The number of a row as it was read ends the order, so that equal rows are spread over partitions too.
    """
    spark = leaves.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("tree").asc_nulls_first(), F.col("order").asc_nulls_first(), F.col("leaf"), F.col("read_as")]
    numbered = leaves.withColumn("read_as", F.monotonically_increasing_id())
    laid = stored(numbered.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "merkle-order")
    read.append(laid)
    null = F.col("tree").isNull().alias("null_tree")
    named = laid.withColumns({"null_tree": null, "tree_key": F.coalesce("tree", F.lit(""))})
    counts = named.groupBy("null_tree", "tree_key", "part").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("null_tree", "tree_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy("null_tree", "tree_key")
    offsets = counts.select("null_tree", "tree_key", "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"), F.sum("rows").over(all_rows).alias("nodes"))
    place = F.row_number().over(Window.partitionBy("part", "null_tree", "tree_key").orderBy(*order[1:]))
    placed = named.withColumn("nth", place).join(offsets, ["null_tree", "tree_key", "part"])
    return placed.withColumn("place", (F.col("nth") - 1 + F.col("rows_before")).cast("long")).drop("nth", "rows_before", "part", "read_as")


def _proved(nodes: DataFrame, fanout: int, levels: int, read: list[DataFrame]) -> DataFrame:
    """nodes(tree, place, nodes, digest, changed, key) -> (tree, key, root, folded, siblings, before, after) of each: its tree's root and its whole proof.

    `tree` tells groups apart and is never null here; `key` names a node of the first step. Tables behind the result are added to `read`.
    """
    largest = nodes.agg(F.max("nodes")).first()[0]
    if largest is None:
        empty = "tree string, key long, root string, folded string, siblings array<string>, before array<int>, after array<int>"
        return nodes.sparkSession.createDataFrame([], empty)
    wide = fanout**levels
    bucket = F.expr(f"place div {wide}").cast("long").alias("bucket")
    # tree is a column of the group: buckets of one place belong to different trees
    done = stored(nodes.groupBy("tree", bucket).applyInPandas(_collapse(fanout, levels), _BUCKET), "merkle-buckets")
    read.append(done)
    if largest <= wide:
        return done.select("tree", "key", "root", F.col("changed").alias("folded"), "siblings", "before", "after")
    roots = done.groupBy("tree", "place").agg(F.max("root").alias("digest"), F.expr(f"(max(nodes) + {wide - 1}) div {wide}").cast("long").alias("nodes"))
    above = _proved(roots.select("tree", "place", "nodes", "digest", F.col("digest").alias("changed"), F.col("place").alias("key")), fanout, levels, read)
    above = above.select("tree", F.col("key").alias("place"), F.col("root").alias("top"), *[F.col(n).alias(f"up_{n}") for n in ("siblings", "before", "after")])
    whole = done.join(above, ["tree", "place"])
    return whole.select(
        "tree", "key", F.col("top").alias("root"), _folded(F.col("changed"), F.col("up_siblings"), F.col("up_before"), F.col("up_after")).alias("folded"),
        *[F.concat(n, f"up_{n}").alias(n) for n in ("siblings", "before", "after")],
    )


def manifest(leaves: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """leaves(tree string, order, leaf string[, changed string]) with subroot, root, siblings, before, after and folded added.

    `siblings` are the digests that prove a leaf, level by level from the leaf to its group's root and on to the root, left to right in each level;
    `before` and `after` tell for each level how many of them stand on either side. `folded` is the root that `changed` (the leaf, where there is no such
    column or it is null) gives with them.
    """
    if "changed" not in leaves.columns:
        leaves = leaves.withColumn("changed", F.lit(None).cast("string"))
    named = leaves.withColumn("changed", F.coalesce("changed", "leaf"))
    read: list[DataFrame] = []
    placed = stored(_placed(named, read).withColumn("key", F.monotonically_increasing_id()), "merkle-places")
    tree = F.when(F.col("null_tree"), "-").otherwise(F.concat(F.lit(":"), "tree_key")).alias("tree")
    own = _proved(placed.select(tree, "place", "nodes", F.col("leaf").alias("digest"), "changed", "key"), fanout, levels, read)
    own = stored(own.withColumnsRenamed({"root": "subroot", "folded": "sub_folded"}), "merkle-proofs")
    discard(*read)
    # the roots of the groups are the leaves of one more tree, in the order of their names: `-`, then `:` and the name
    roots = own.groupBy("tree").agg(F.max("subroot").alias("leaf")).select(F.lit("").alias("tree"), F.col("tree").alias("order"), "leaf")
    ranked = stored(_placed(roots, []).withColumn("key", F.monotonically_increasing_id()), "merkle-groups")
    upper = _proved(ranked.select("tree", "place", "nodes", F.col("leaf").alias("digest"), F.col("leaf").alias("changed"), "key"), fanout, levels, [])
    upper = upper.join(ranked.select("key", F.col("order").alias("group")), "key").select(F.col("group").alias("tree"), "root", *[F.col(n).alias(f"up_{n}") for n in ("siblings", "before", "after")])
    proofs = own.join(upper, "tree").select(
        "key", "subroot", "root", _folded(F.col("sub_folded"), F.col("up_siblings"), F.col("up_before"), F.col("up_after")).alias("folded"),
        *[F.concat(n, f"up_{n}").alias(n) for n in ("siblings", "before", "after")],
    )
    return placed.join(proofs, "key").select(*leaves.columns, "subroot", "root", "siblings", "before", "after", "folded")


def document_leaves(docs: DataFrame, changed: list[Column] | None = None) -> DataFrame:
    """Leaves of docs(doc_id, source, lang, n_chars, text), grouped by lang in the order of doc_id; `changed` are the fields of what is held against the manifest."""
    leaf = leaf_of([F.col(f) for f in FIELDS])
    out = {"leaf": leaf, "changed": leaf_of(changed) if changed else leaf}
    return docs.select(F.col("lang").cast("string").alias("tree"), F.col("doc_id").alias("order"), *[c.alias(n) for n, c in out.items()])


def verified(docs: DataFrame, tampered: Column) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row; where `tampered` holds, 1 is added to n_chars before a row is verified."""
    n_chars = F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    fields = [n_chars if f == "n_chars" else F.col(f) for f in FIELDS]
    found = manifest(document_leaves(docs, fields))
    return found.select(
        F.col("order").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256"),
        F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )
