"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its five-word shingles (lower-cased letter and digit runs): weight =
(1 + ln tf) * (1 + IDF_SHARE * mean idf of the shingle's words), the idf scaled to 0..1 from document
counts of all texts kept in a hashed table of fixed size. Consistent weighted samples of the set are
banded; texts that share a band are candidates, and a candidate pair is a link if its weighted Jaccard
similarity, computed from the whole texts, is at least `SIMILARITY`. Classes are the connected
components of the links; equal texts are collapsed before, so copies never meet in pairs.

Buckets of a band that are larger than a block are compared in two rounds. The first looks inside each
block, to which the `LEADERS` first texts of the bucket are added, so every text moves once; in a group
of copies that joins nearly all. The second compares blocks with each other where their texts are not
yet in one component, and there only pairs of different components. No link that the bands can see and
that would join two components is lost; pairs never become rows, and a bucket is never one task.

Defined cases: texts without words (null, empty, punctuation) link with nothing; a text of fewer than
five words is one shingle; texts of any length are compared whole; equal texts are one class; a document
is a pair of doc_id and text, so rows that repeat both count once and rows that share a doc_id alone are
told apart; of a class the document with the smallest doc_id stays; a null doc_id is never linked and
always kept; an empty table gives an empty result; other columns are carried where whole documents are
returned, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from ..workspace import stored
from .columns import Shield
from .textarrays import blocks, mix64, shingles, tokens

WIDTH, SIMILARITY = 5, 0.8
IDF_SHARE = 2.0
BANDS, SAMPLES_PER_BAND = 12, 3
IDF_BUCKETS, SLICES = 1 << 18, 16
#: Texts in a block of a bucket, and texts of the bucket that every block sees.
BLOCK_TEXTS, LEADERS = 128, 4
BLOCK = 1 << 18


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents for each hashed word, and the number of texts with words, over all rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n = np.zeros(IDF_BUCKETS, dtype=np.int32), 0
        for batch in batches:
            for _, buf, starts in blocks(batch["text"].tolist()):
                word, bounds = tokens(buf, starts)
                doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                once = np.unique(doc * IDF_BUCKETS + (word % np.uint64(IDF_BUCKETS)).astype(np.int64))
                seen += np.bincount(once % IDF_BUCKETS, minlength=IDF_BUCKETS).astype(np.int32)
                n += int((np.diff(bounds) > 0).sum())
        yield pd.DataFrame({"slice": range(SLICES), "n": [n] * SLICES, "counts": [part.tobytes() for part in np.split(seen, SLICES)]})

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        counts = sum(np.frombuffer(c, dtype=np.dtype("i4" if len(c) == 4 * IDF_BUCKETS // SLICES else "i8")).astype(np.int64) for c in rows["counts"])
        return pd.DataFrame({"slice": rows["slice"].iloc[:1], "n": [int(rows["n"].sum())], "counts": [counts.tobytes()]})

    schema = "slice int, n long, counts binary"
    rows = docs.select("text").mapInPandas(count, schema).groupBy("slice").applyInPandas(total, schema).collect()  # SLICES rows of fixed size
    table = np.zeros((SLICES, IDF_BUCKETS // SLICES), dtype=np.int64)
    for row in rows:
        table[row["slice"]] = np.frombuffer(row["counts"], dtype=np.int64)
    return table.ravel(), (rows[0]["n"] if rows else 0)


@dataclass
class Weights:
    """Scaled idf of each hashed word, as bytes."""

    scaled: np.ndarray

    @classmethod
    def of(cls, docs: DataFrame) -> Weights:
        counts, n = document_frequencies(docs)
        idf = np.log((n + 1) / np.clip(counts, 1, None)) / np.log(n + 2)
        return cls(np.round(np.clip(idf, 0, 1) * 255).astype(np.uint8))

    def sets(self, texts: list[str | None]) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
        """(first text, [(sorted shingle hashes, weights) of each text]) by block."""
        for first, buf, starts in blocks(texts, limit=BLOCK):
            word, bounds = tokens(buf, starts)
            idf = self.scaled[(word % np.uint64(IDF_BUCKETS)).astype(np.int64)].astype(np.float64) / 255
            upto = np.concatenate([[0.0], np.cumsum(np.round(idf * 255))])
            found = []
            for a, b in zip(bounds[:-1], bounds[1:]):
                keys, at, tf = np.unique(shingles(word[a:b], WIDTH), return_index=True, return_counts=True)
                last = np.minimum(a + at + WIDTH, b)
                mean = (upto[last] - upto[a + at]) / 255 / np.maximum(last - a - at, 1)
                found.append((keys, ((1 + np.log(tf)) * (1 + IDF_SHARE * mean)).astype(np.float32)))
            yield first, found

    def one(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        return next(self.sets([text]))[1][0]


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).astype(np.float64).sum())
    either = float(a[1].astype(np.float64).sum() + b[1].astype(np.float64).sum()) - both
    return both / either if either > 0 else 0.0


def _gamma_table() -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at 65,536 midpoints, by bisection of 1 - (1 + x) exp(-x)."""
    p = (np.arange(65536) + 0.5) / 65536
    low, high = np.zeros(65536), np.full(65536, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return high


_GAMMA: list[np.ndarray] = []


def band_keys(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Band keys of non-empty weighted sets, (sets, BANDS): consistent samples hashed SAMPLES_PER_BAND at a time."""
    if not _GAMMA:
        table = _gamma_table()
        _GAMMA[:] = [table.astype(np.float32), np.log(table).astype(np.float32)]
    rate, log_scale = _GAMMA
    keys = np.concatenate([k for k, _ in sets])
    log_weight = np.log(np.concatenate([w for _, w in sets]))
    cuts = np.cumsum([0] + [len(k) for k, _ in sets[:-1]])
    seeds = mix64(np.arange(1, BANDS * SAMPLES_PER_BAND + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    low16 = np.uint64(0xFFFF)
    out = np.zeros((len(sets), BANDS), dtype=np.uint64)
    for k, seed in enumerate(seeds):
        x = (keys ^ seed) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
        r = rate[(x & low16).astype(np.int32)]
        beta = ((x >> np.uint64(32)) & low16).astype(np.float32) / np.float32(65536)
        y = r * (np.floor(log_weight / r + beta) - beta)
        a = log_scale[((x >> np.uint64(16)) & low16).astype(np.int32)] - y - r
        least = np.minimum.reduceat(a, cuts).astype(np.float32).view(np.uint32).astype(np.uint64)
        band = k // SAMPLES_PER_BAND
        out[:, band] = mix64(out[:, band] * np.uint64(0xD6E8FEB86659FD93) + least + np.uint64(1))
    return out


def signatures(docs: DataFrame, weights: Weights) -> DataFrame:
    """(doc_id, digest, bands) of every row; bands is null for texts without words."""

    @F.pandas_udf("array<long>")
    def sampled(texts: pd.Series) -> pd.Series:
        bands = [None] * len(texts)
        for first, sets in weights.sets(texts.tolist()):
            filled = [i for i, (keys, _) in enumerate(sets) if len(keys)]
            if filled:
                for i, row in zip(filled, band_keys([sets[i] for i in filled]).view(np.int64)):
                    bands[first + i] = row
        return pd.Series(bands)

    return docs.select("doc_id", _digest(F.col("text")).alias("digest"), sampled(F.col("text")).alias("bands"))


def _forest(nodes: list[int], groups: list[int], sets: list[tuple[np.ndarray, np.ndarray]], left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links between rows of `left` and of `right` that join what is in different groups and linked.

    The dot product of the square roots of the weights is at least the sum of the minima, so pairs whose
    similarity under that bound is below SIMILARITY are no links; the others are verified exactly unless
    they are joined already.
    """
    mass = np.array([w.sum(dtype=np.float64) for _, w in sets])
    sizes = np.array([len(k) for k, _ in sets])
    key, inverse = np.unique(np.concatenate([k for k, _ in sets]), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    value = np.sqrt(np.concatenate([w for _, w in sets]))
    shared = np.bincount(inverse, minlength=len(key)) > 1
    column = np.cumsum(shared) - 1
    keep = shared[inverse]
    row, value, at = row[keep], value[keep], column[inverse[keep]]
    order = np.argsort(at, kind="stable")
    row, value, at = row[order], value[order], at[order]
    both = np.zeros((len(sets), len(sets)))
    for start in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(at, [start, start + 4096])
        dense = np.zeros((len(sets), 4096), dtype=np.float32)
        dense[row[a:b], at[a:b] - start] = value[a:b]
        both += dense @ dense.T
    both *= 1 + 1e-5  # rounding must not lose a pair
    near = both >= SIMILARITY * (mass[:, None] + mass[None, :] - both)
    group = np.array(groups)
    near &= (left[:, None] & right[None, :]) & (group[:, None] != group[None, :])
    parent = {g: g for g in groups}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in zip(*np.nonzero(near)):
        if root(groups[i]) != root(groups[j]) and weighted_jaccard(sets[i], sets[j]) >= SIMILARITY:
            parent[root(groups[i])] = root(groups[j])
            yield nodes[i], nodes[j]


def _compare(weights: Weights):
    """Tasks, rows (task, low, high, block, node, grp, text) of which follow each other: the links found in each."""

    def linked(rows: list[tuple]) -> list[tuple[int, int]]:
        rows = list({(r[4], r[3]): r for r in rows}.values())  # rows that repeat a document have its text
        if len({r[5] for r in rows}) < 2:
            return []
        sets = [s for _, found in weights.sets([r[6] for r in rows]) for s in found]
        block, low, high = np.array([r[3] for r in rows]), rows[0][1], rows[0][2]
        return list(_forest([r[4] for r in rows], [r[5] for r in rows], sets, block == low, (block == high) | (block < 0) if low == high else block == high))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task: list[tuple] = []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for row in batch.itertuples(index=False, name=None):
                if task and row[:3] != task[0][:3]:
                    found += linked(task)
                    task = []
                task.append(row)
            yield pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)
        yield pd.DataFrame(linked(task) if task else [], columns=["a", "b"], dtype=np.int64)

    return compare


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _run(tasks: DataFrame, docs: DataFrame, classes: DataFrame, weights: Weights, label: str) -> DataFrame:
    """The links (a, b) of tasks(task, low, high, block, node, grp); texts come from the document that stands for a class."""
    named = tasks.join(classes.select("node", F.col("rep").alias("doc_id"), "digest"), "node")
    texts = docs.where("text is not null").select("doc_id", "text", _digest(F.col("text")).alias("digest"))
    key = ["task", "low", "high"]
    rows = named.join(texts, ["doc_id", "digest"]).select(*key, "block", "node", "grp", "text")
    return stored(rows.repartition(*key).sortWithinPartitions(*key).mapInPandas(_compare(weights), "a long, b long"), label)


def links(docs: DataFrame, classes: DataFrame, weights: Weights) -> DataFrame:
    """Verified links (a, b) that connect the classes; classes(node, rep, digest, bands) has one row for each distinct text.

    Buckets of several bands that hold the same texts are compared once.
    """
    banded = classes.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("members > 1")
    distinct = buckets.groupBy("members", "x", "y").agg(F.min(F.struct("band", "key")).alias("of")).select("of.band", "of.key", F.xxhash64("x", "of").alias("task"), F.ceil(F.col("members") / BLOCK_TEXTS).cast("int").alias("blocks"))
    placed = stored(banded.join(distinct, ["band", "key"]).select("task", "blocks", F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int").alias("block"), "node"), "dup-buckets")
    large = placed.where("blocks > 1")
    # the leaders of a bucket have the smallest hashes; a cut leaves few rows of it to rank
    wanted = F.lit(4_294_967_296.0) * (LEADERS + 30) / (F.col("blocks") * BLOCK_TEXTS)
    hashed = large.withColumn("place", F.pmod(F.xxhash64("node", F.lit(3)), F.lit(4_294_967_296))).where(F.col("place") < wanted)
    ranked = hashed.withColumn("nth", F.row_number().over(Window.partitionBy("task").orderBy("place", "node"))).where(F.col("nth") <= LEADERS)
    leaders = ranked.select("task", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("low"), F.lit(-1).alias("block"), "node")
    inside = placed.select("task", F.col("block").alias("low"), "block", "node").unionByName(leaders)
    first = _run(inside.select("task", "low", F.col("low").alias("high"), "block", "node", F.col("node").alias("grp")), docs, classes, weights, "dup-links")
    joined = large.join(components(first), "node", "left").select("task", "blocks", "block", "node", F.coalesce("component", "node").alias("grp"))
    joined = stored(joined, "dup-joined")
    # a block that is whole in one component meets only blocks that are not whole in the same
    shape = joined.groupBy("task", "block").agg(F.min("grp").alias("low_grp"), F.max("grp").alias("high_grp"))
    whole = F.when(F.col("low_grp") == F.col("high_grp"), F.col("low_grp"))
    shape = shape.select("task", "block", whole.alias("whole"))
    main = shape.where("whole is not null").groupBy("task", "whole").count().groupBy("task").agg(F.max_by("whole", F.struct("count", "whole")).alias("main"))
    odd = shape.join(main, "task", "left").select("task", "block", (~F.coalesce(F.col("whole") == F.col("main"), F.lit(False))).alias("odd"))
    members = joined.join(odd, ["task", "block"])
    partners = odd.where("odd").select("task", F.col("block").alias("other"), F.lit(True).alias("other_odd"))
    partners = odd.where("odd").select("task", F.col("block").alias("other"))
    crossed = members.where("not odd").join(partners, "task").select("task", "block", "other", "node", "grp").unionByName(
        members.where("odd").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> block").select("task", "block", "other", "node", "grp")
    )
    second = _run(crossed.select("task", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "grp"), docs, classes, weights, "dup-crossed")
    return first.unionByName(second)


def _decisions(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, class_id) for every row; digest is null for rows that link with nothing."""
    weights = Weights.of(docs)
    signed = stored(signatures(docs, weights), "dup-signatures")
    worded = signed.where("bands is not null and doc_id is not null")
    grouped = worded.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    classes = stored(grouped.withColumn("node", F.monotonically_increasing_id()), "dup-classes")
    found = components(links(docs, classes, weights))
    placed = classes.select("digest", "rep", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("rep").alias("class_id"))
    ids = placed.join(least, "component").select("digest", "class_id")
    rows = signed.select("doc_id", F.when(F.col("bands").isNotNull() & F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    return rows.join(ids, "digest", "left").select("doc_id", "digest", F.coalesce("class_id", "doc_id").alias("class_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, kept) for every row: class_id is the smallest doc_id of the class; every row of that doc_id in the class is marked as kept."""
    found = _decisions(docs.select("doc_id", "text"))
    return found.select("doc_id", "class_id", (F.col("digest").isNull() | (F.col("doc_id") == F.col("class_id"))).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each class, with the columns of docs."""
    found = stored(_decisions(docs.select("doc_id", "text")).where("digest is not null"), "dup-decisions")
    documents = found.groupBy("class_id", "doc_id", "digest").agg(F.count("*").alias("copies"))
    chosen = documents.groupBy("class_id").agg(F.min(F.struct("doc_id", "digest", "copies")).alias("of")).select("of.*")
    shield = Shield(docs)
    rows = shield.frame.select("*", shield["doc_id"].alias("doc_id"), _digest(shield["text"]).alias("digest"))
    # what a class loses is narrow: one row a document, not one a text
    lost = documents.join(chosen.select("doc_id", "digest", F.lit(True).alias("stays")), ["doc_id", "digest"], "left").where("stays is null").select("doc_id", "digest")
    kept = rows.join(lost, ["doc_id", "digest"], "left_anti")
    again = chosen.where("copies > 1").select("doc_id", "digest")
    if again.limit(1).count():
        once = kept.join(again, ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])
        kept = kept.join(again, ["doc_id", "digest"], "left_anti").unionByName(once)
    return kept.select(*shield.restored())
