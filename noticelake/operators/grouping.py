"""Guarded grouping: notices of one real event.

Notices that share a key are merged, oldest first, unless some pair of the two groups disagrees: other rounds or tracks (scope), lists of years without a common
year, or two official ids. Whether a pair was merged decides what may be merged later, so the order is part of the rule: buckets of a key in the order in
which keys first appear, notices of a bucket by (first_seen, id), each against the groups before it. A notice that is not yet with a group of the bucket
joins the first that agrees with it; the groups of a bucket disagree with each other, so it joins no second one.

That is one decision after the other, but few notices take part in any. They are first contracted where the rule leaves no choice:

* keys that one notice has alone merge nothing;
* notices of one scope, list of years, official id and set of keys always end together: the younger meets what the older has met;
* notices with one year and an official id (or where everything that keys connect has at most one official id) always end together if they share a
  key: whatever has joined one of them has that year and id, or leaves them open.

Most keys need none of that: where all notices of a key have that key alone, and they are no more than `HOT`, the key is a component of its own. These are sorted in one
exchange and decided as they stream by; notices with equal facts go the same way, so a key costs its different facts. Only the rest takes part in the contraction.

What remains of it is a table of classes by key, decided by component of keys, some `DEAL` rows of whole components at a time. The size of a component follows the different facts and key sets of a component,
not its notices: a key of a million equal notices is one row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workspace import discard, stored
from .graph import components

#: The order of notices. Notices of one instant and id are told apart by all that is known of them, so that the result doesn't depend on how rows arrive.
_BIRTH = ["unseen", "first_seen", "id", "tie"]
#: Rows of components that one group of `applyInPandas` takes; a larger component is a group of its own size.
DEAL = 20_000
#: Notices of a key that are held in memory together, rows of a sorted partition, and cells in which keys are counted together.
HOT, PART_ROWS, CELLS = 50_000, 1_000_000, 1 << 20


def _linked(tokens: DataFrame, by: list[str]) -> DataFrame:
    """(node, component) of nodes(node, ...) that have all columns `by` in common, directly or through others."""
    first = tokens.groupBy(*by).agg(F.min("node").alias("a"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    return components(tokens.join(first, by).select("a", F.col("node").alias("b")))


def _agree(a: tuple[set, str | None], b: tuple[set, str | None]) -> bool:
    """Whether all pairs of two groups agree, from their different lists of years and official id."""
    if a[1] is not None and b[1] is not None and a[1] != b[1]:
        return False
    return all(x & y for x in a[0] for y in b[0])


def _decide(rows: pd.DataFrame) -> pd.DataFrame:
    """Groups of whole components from rows(component, node, years, official, key, order of the bucket, order inside it)."""
    rows = rows.sort_values(["component", "key_unseen", "key_first_seen", "key_id", "key_pos", "key", *_BIRTH], kind="stable")
    into: dict[int, int] = {}
    facts: dict[int, tuple[set, str | None]] = {}
    for node, years, official in zip(rows["node"], rows["years"], rows["official"]):
        into[node] = node
        facts[node] = {frozenset(years)} if len(years) else set(), official if isinstance(official, str) else None

    def root(x: int) -> int:
        while into[x] != x:
            into[x] = into[into[x]]
            x = into[x]
        return x

    bucket, groups = None, []
    for token, node in zip(zip(rows["component"], rows["key"]), rows["node"]):
        if token != bucket:
            bucket, groups = token, []
        mine = root(node)
        groups = [root(g) for g in groups]
        if mine in groups:
            continue
        for i, other in enumerate(groups):
            if _agree(facts[mine], facts[other]):
                into[mine] = other
                facts[other] = facts[other][0] | facts[mine][0], facts[other][1] if facts[other][1] is not None else facts[mine][1]
                break
        else:
            groups.append(mine)
    nodes = list(into)
    return pd.DataFrame({"node": nodes, "cluster": [root(x) for x in nodes]}, dtype="int64")


class _Facts:
    """Facts of notices (years and official id, as JSON) by number, and which of them agree."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.parsed: list[tuple[frozenset, str | None]] = []
        self.known: dict[tuple[int, int], bool] = {}

    def number(self, text: str) -> int:
        if text not in self.numbers:
            found = json.loads(text)
            self.numbers[text] = len(self.parsed)
            self.parsed.append((frozenset(found["years"]), found.get("official")))
        return self.numbers[text]

    def agree(self, a: int, b: int) -> bool:
        if (a, b) not in self.known:
            (x, p), (y, q) = self.parsed[a], self.parsed[b]
            self.known[a, b] = (not x or not y or bool(x & y)) and (p is None or q is None or p == q)
        return self.known[a, b]


def _groups(codes: list[int], starts: list[int], facts: _Facts) -> tuple[np.ndarray, np.ndarray]:
    """For every row the place of the first row of its group, and the size of the group; rows of a key are in order, keys begin at `starts`."""
    leader = np.arange(len(codes))
    for low, high in zip(starts, [*starts[1:], len(codes)]):
        if high - low == 1:
            continue
        groups: list[tuple[int, list[int]]] = []
        joined: dict[int, int] = {}  # what has the facts of a notice before it joins the same group: groups before that disagree with it still
        for i in range(low, high):
            code = codes[i]
            if code not in joined:
                for first, held in groups:
                    if all(facts.agree(code, other) for other in held):
                        held.append(code)
                        joined[code] = first
                        break
                else:
                    groups.append((i, [code]))
                    joined[code] = i
            leader[i] = joined[code]
    return leader, np.bincount(leader, minlength=len(codes))[leader]


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, grp, members) of rows(id, scope, key, facts) sorted by key and then by age; a key may reach over batches."""
    facts, rest = _Facts(), None

    def decided(table: pa.Table, starts: np.ndarray) -> list[pa.RecordBatch]:
        told = table.column("facts").combine_chunks().dictionary_encode()
        numbers = np.array([facts.number(x) for x in told.dictionary.to_pylist()], dtype=np.int64)
        leader, members = _groups(numbers[told.indices.to_numpy()].tolist(), starts.tolist(), facts)
        ids = table.column("id").combine_chunks()
        return pa.table({"id": ids, "grp": ids.take(pa.array(leader)), "members": pa.array(members, pa.int64())}).to_batches()

    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if table.num_rows == 0:
            continue
        columns = [table.column(name).combine_chunks() for name in ("scope", "key")]
        new = np.logical_or.reduce([pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in columns])
        starts = np.concatenate([[0], np.flatnonzero(new) + 1])
        if len(starts) > 1:
            yield from decided(table.slice(0, starts[-1]), starts[:-1])
        rest = table.slice(starts[-1])
    if rest is not None:
        yield from decided(rest, np.array([0]))


def grouped(notices: DataFrame) -> DataFrame:
    """(id, grp, members) of notices(id, first_seen, scope, years array, keys array[, official]); grp is the oldest member's id.

    ids are of any type that can be ordered and tell notices apart; an official id that is only a link to a page is no official id and should be null; a null or empty list
    of years agrees with every list; a null scope is an empty one; a notice without keys is a group of its own; null first_seen comes last; an empty table gives
    an empty result.
    """
    official = F.col("official").cast("string") if "official" in notices.columns else F.lit(None).cast("string")
    texts = F.array().cast("array<string>")
    text_list = lambda name: F.array_except(F.coalesce(F.col(name).cast("array<string>"), texts), F.array(F.lit(None).cast("string")))  # noqa: E731  (different ones, no nulls)
    rows = notices.select(
        "id", F.col("first_seen").isNull().alias("unseen"), "first_seen", F.coalesce(F.col("scope").cast("string"), F.lit("")).alias("scope"),
        F.sort_array(text_list("years")).alias("years"), official.alias("official"), text_list("keys").alias("keys"),
    )
    # how many notices there are, and whether any have several keys or any key may have many notices: keys are counted by cells first, exactly only where that leaves it open
    n = F.size("keys")
    cells = rows.groupBy(F.pmod(F.xxhash64("scope", F.get("keys", F.lit(0))), F.lit(CELLS))).agg(F.count("*").alias("rows"), *[F.count(F.when(x, 1)).alias(name) for name, x in {"keyless": n == 0, "single": n == 1, "several": n > 1}.items()])
    found = cells.agg(F.sum("rows").alias("rows"), F.sum("keyless").alias("keyless"), F.sum("single").alias("single"), F.max("single").alias("crowd"), F.sum("several").alias("several")).first()
    if not found["rows"]:
        return rows.select("id", F.col("id").alias("grp"), F.lit(0).cast("long").alias("members"))
    parts = [rows.where(n == 0).select("id", F.col("id").alias("grp"), F.lit(1).cast("long").alias("members"))] if found["keyless"] else []
    several, single = rows.where(n > 1), rows.where(n == 1).withColumn("key", F.col("keys")[0])
    if not found["single"]:
        parts.append(_contracted(several))
    elif found["several"] or found["crowd"] > HOT:  # keys whose notices need more than themselves; a key counts in all scopes, as its turn is the same in all of them
        sharers = rows.select(n.alias("n"), F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("sharers"), F.max("n").alias("n"))
        wide = stored(sharers.where((F.col("n") > 1) | (F.col("sharers") > HOT)).select("key"), "group-wide")
        parts.append(_contracted(several.unionByName(single.join(wide, "key", "left_semi").select(rows.columns))))
        parts.append(_streamed(single.join(wide, "key", "left_anti"), found["single"]))
    else:
        parts.append(_streamed(single, found["single"]))
    return reduce(DataFrame.unionByName, parts)


def _streamed(single: DataFrame, count: int) -> DataFrame:
    """Groups of notices that have one key each, a key being no larger than what a task may hold."""
    told = single.select("id", "unseen", "first_seen", "scope", "key", F.to_json(F.struct("years", "official")).alias("facts"), F.xxhash64("scope", "key").alias("bucket"))
    parts = max(int(single.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // PART_ROWS))
    ordered = told.repartition(parts, "bucket").sortWithinPartitions("bucket", "scope", "key", "unseen", "first_seen", "id", "facts")
    kind = single.schema["id"].dataType
    return ordered.select("id", "scope", "key", "facts").mapInArrow(_settle, T.StructType().add("id", kind).add("grp", kind).add("members", "long"))


def _contracted(rows: DataFrame) -> DataFrame:
    """Groups of notices by contraction, as the module says."""
    rows = rows.withColumn("tie", F.to_json(F.struct("scope", "years", "official", "keys")))
    rows = stored(rows.withColumn("node", F.monotonically_increasing_id()), "group-rows")
    birth: Column = F.struct(*_BIRTH)
    tokens = rows.select("node", "scope", *_BIRTH, "years", "official", F.posexplode("keys").alias("pos", "key"))
    held = stored(tokens.groupBy("scope", "key").agg(F.count("*").alias("sharers"), F.min(F.struct(*_BIRTH, "pos")).alias("opened")), "group-keys")
    opened = held.groupBy("key").agg(F.min("opened").alias("opened"))  # a bucket's turn is that of its key, whichever scope has it first
    buckets = held.where("sharers > 1").select("scope", "key").join(opened, "key")
    placed = stored(tokens.join(buckets, ["scope", "key"]), "group-tokens")
    # a component is what keys of one scope connect; officials that all agree there are as good as none
    connected = stored(_linked(placed.select("node", "scope", "key"), ["scope", "key"]), "group-connected")
    tokens = placed.join(connected, "node")
    known = tokens.groupBy("component").agg(F.min("official").alias("low"), F.max("official").alias("high"))
    alike = F.coalesce(F.col("low") == F.col("high"), F.lit(True))
    tokens = tokens.join(known, "component").withColumn("official", F.when(~alike, F.col("official")))
    settled = (F.size("years") == 1) & (F.col("official").isNotNull() | alike)
    settled_tokens = tokens = stored(tokens.withColumn("settled", settled).drop("low", "high"), "group-tokens")
    sure = _linked(tokens.where("settled").select("node", "key", "component", "years", F.coalesce("official", F.lit("")).alias("official")), ["component", "key", "years", "official"])
    twins = tokens.where("not settled").groupBy("node", "component", "years", F.coalesce("official", F.lit("")).alias("official")).agg(F.array_sort(F.collect_list("key")).alias("held"))
    eldest = twins.groupBy("component", "years", "official", "held").agg(F.min("node").alias("class"))
    same = twins.join(eldest, ["component", "years", "official", "held"]).select("node", "class")
    classes = stored(sure.select("node", F.col("component").alias("class")).unionByName(same), "group-classes")
    tokens = tokens.join(classes, "node", "left").withColumn("node", F.coalesce("class", "node"))
    # one row a class and key, at the place of its oldest notice there; keys that one class has alone are done
    places = stored(tokens.groupBy("component", "node", "years", "official", "key", "opened").agg(F.min(birth).alias("born")), "group-places")
    open_keys = places.groupBy("component", "key").agg(F.count("*").alias("holders")).where("holders > 1").drop("holders")
    left = places.join(open_keys, ["component", "key"], "left_semi").select("component", "node", "years", "official", "key", "born.*", *[F.col(f"opened.{n}").alias(f"key_{n}") for n in (*_BIRTH, "pos")])
    deals = -(-places.count() // DEAL)
    deal = F.pmod(F.xxhash64("component"), F.lit(max(1, deals))).alias("deal")
    decided = stored(left.groupBy(deal).applyInPandas(_decide, "node long, cluster long"), "group-decided")
    out = rows.select("id", *_BIRTH, "node").join(classes, "node", "left").withColumn("node", F.coalesce("class", "node"))
    out = stored(out.join(decided, "node", "left").withColumn("cluster", F.coalesce("cluster", "node")).select("cluster", *_BIRTH), "group-clusters")
    discard(rows, held, placed, connected, settled_tokens, classes, places, decided)
    groups = out.groupBy("cluster").agg(F.min(birth)["id"].alias("grp"), F.count("*").alias("members"))
    return out.join(groups, "cluster").select("id", "grp", "members")
