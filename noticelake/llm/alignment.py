"""Alignment of two tokenizers over the same bytes.

Each vocabulary marks the ends of its tokens in a packed bitset, one bit a byte of the text. The AND of the two sets has the cuts that both share; between two such cuts
lies a group of tokens that cannot be told apart further. Counting bits below a position (rank: a running count for each byte of the set, and the bits
before the position inside it) maps a cut to token numbers on either side. The OR of the sets has one bit for every link, a pair of tokens whose bytes
overlap, and the same ranks give the two tokens.

Documents are encoded once, in blocks of about a megabyte. A task tallies in how many of its documents a pair of ids is linked, and the tallies are
added up by pair, so a pair of every document meets as one row a task. Pairs are looked up in two ways that together are exact: those above a power of two of documents
that at most `HOT` pairs reach lie beside the documents as sorted arrays, the rest is joined by pair. The best count of an id of the first vocabulary is one row an
id, bounded by that vocabulary.

Defined cases: null and empty texts, and texts whose pieces in either vocabulary do not join to a space and the text (a piece vocabulary normalises some),
have no tokens: zeros and an empty digest; strings of special tokens are plain text; equal rows each count as a document; null ids are kept; an empty table gives
an empty result; other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import discard, stored
from . import vocabularies

BLOCK_BYTES = 1 << 20
#: Most pairs that are kept beside the documents: 17 bytes each.
HOT = 1 << 19
#: Pairs that a task tallies before it hands them on, and pairs in one row of tallies.
TALLY, TALLY_ROW = 1 << 21, 1 << 14
_ALIGNED = "doc_id {id}, key long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary, tally_pairs array<long>, tally_docs array<int>"
_LOOKED_UP = "doc_id {id}, key long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, hot_best long, hot_sum long, rest_pairs array<long>, rest_times array<int>"
_GROUPS = "doc_id {id}, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>, byte_ends array<int>"
_BELOW = np.array([(0xFF << (8 - i)) & 0xFF for i in range(8)], dtype=np.uint8)


class Marks:
    """Positions as a packed bitset with ranks."""

    def __init__(self, positions: np.ndarray, size: int):
        bits = np.zeros(size, dtype=bool)
        bits[positions] = True
        self.bits = np.packbits(bits)
        counts = np.cumsum(np.bitwise_count(self.bits), dtype=np.int64)
        self.before = np.concatenate([[0], counts[:-1]])

    def rank(self, positions: np.ndarray) -> np.ndarray:
        """How many marks lie before each position."""
        word = positions >> 3
        return self.before[word] + np.bitwise_count(self.bits[word] & _BELOW[positions & 7])


def places(bits: np.ndarray) -> np.ndarray:
    """The positions of a packed bitset."""
    return np.flatnonzero(np.unpackbits(bits))


class Pieces:
    """The bytes of a vocabulary's ids, end to end."""

    def __init__(self, pieces: list[bytes]):
        self.length = np.array([len(p) for p in pieces], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(pieces) or b"\0", dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        length = self.length[ids]
        shift = self.start[ids] - (np.cumsum(length) - length)
        return self.flat[np.repeat(shift, length) + np.arange(length.sum())]


@dataclass
class Block:
    """Documents of one block that have tokens: which ones, their ids end to end, and where groups and links are."""

    docs: np.ndarray  # numbers of the documents inside the batch
    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray  # by document
    n_b: np.ndarray
    group_bounds: np.ndarray  # first group of each document, with the end appended
    link_bounds: np.ndarray
    a_ends: np.ndarray  # by group: tokens through it
    b_ends: np.ndarray
    byte_ends: np.ndarray
    link_a: np.ndarray  # by link: places in a and b
    link_b: np.ndarray
    byte_bounds: np.ndarray


class Aligner:
    """Two vocabularies and what is looked up of them."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = vocabularies.byte_vocabulary(path_a), vocabularies.piece_vocabulary(path_b)
        self.pieces_a, self.pieces_b = Pieces(self.a.pieces), Pieces(self.b.pieces)
        n_a, n_b = len(self.a.pieces), len(self.b.pieces)
        self.n_b = n_b
        #: every id as text with what follows it: a comma inside a side, a bar after the first side, a semicolon after the group
        self.shown = [b"%d%s" % (i, mark) for n, mark in ((n_a, b","), (n_a, b"|"), (n_b, b","), (n_b, b";")) for i in range(n)]
        self.offsets = np.cumsum([0, n_a, n_a, n_b])

    def block(self, numbers: list[int], texts: list[str]) -> Block:
        raws = [b" " + t.encode() for t in texts]
        a = [self.a.plain_ids(" " + t) for t in texts]
        b = [np.array(ids, dtype=np.int64) for ids in self.b.ids(texts)]
        fits = [len(raw) == self.pieces_a.length[x].sum() == self.pieces_b.length[y].sum() for raw, x, y in zip(raws, a, b)]
        raws, a, b, docs = ([x for x, f in zip(values, fits) if f] for values in (raws, a, b, numbers))
        sizes = np.array([len(r) for r in raws], dtype=np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        whole = np.frombuffer(b"".join(raws), dtype=np.uint8)
        wrong = np.zeros(len(whole), dtype=bool)
        for ids, pieces in ((a, self.pieces_a), (b, self.pieces_b)):
            if ids:
                wrong |= pieces.joined(np.concatenate(ids)) != whole
        if wrong.any():
            bad = set((np.searchsorted(bounds, np.flatnonzero(wrong), side="right") - 1).tolist())
            kept = [i for i in range(len(docs)) if i not in bad]
            a, b, docs = [a[i] for i in kept], [b[i] for i in kept], [docs[i] for i in kept]
            bounds = np.concatenate([[0], np.cumsum(sizes[kept])]).astype(np.int64)
        return self._cut(docs, a, b, bounds)

    def _cut(self, docs: list[int], a: list[np.ndarray], b: list[np.ndarray], bounds: np.ndarray) -> Block:
        none = np.zeros(0, dtype=np.int64)
        ids_a, ids_b = (np.concatenate([none, *x]).astype(np.int64) for x in (a, b))
        size = int(bounds[-1])
        marks_a = Marks(np.cumsum(self.pieces_a.length[ids_a]) - 1, size)
        marks_b = Marks(np.cumsum(self.pieces_b.length[ids_b]) - 1, size)
        cuts, links = places(marks_a.bits & marks_b.bits), places(marks_a.bits | marks_b.bits)
        return Block(
            np.array(docs, dtype=np.int64), ids_a, ids_b, np.array([len(x) for x in a], dtype=np.int64), np.array([len(x) for x in b], dtype=np.int64),
            np.searchsorted(cuts, bounds), np.searchsorted(links, bounds), marks_a.rank(cuts) + 1, marks_b.rank(cuts) + 1, cuts + 1,
            marks_a.rank(links), marks_b.rank(links), bounds,
        )

    def digests(self, block: Block) -> list[str]:
        """SHA-256 of the groups of each document, written out as `a1,a2|b1;...`."""
        starts_b = np.concatenate([[0], block.b_ends[:-1]]).astype(np.int64)
        per_a, per_b = np.diff(block.a_ends, prepend=0), np.diff(block.b_ends, prepend=0)
        code = np.empty(len(block.a) + len(block.b), dtype=np.int64)
        shown_a, shown_b = block.a + self.offsets[0], block.b + self.offsets[2]
        shown_a[block.a_ends - 1] += self.offsets[1] - self.offsets[0]
        shown_b[block.b_ends - 1] += self.offsets[3] - self.offsets[2]
        code[np.arange(len(block.a)) + np.repeat(starts_b, per_a)] = shown_a
        code[np.arange(len(block.b)) + np.repeat(block.a_ends, per_b)] = shown_b
        ends = np.cumsum(block.n_a + block.n_b).tolist()
        out, at = [], 0
        for end in ends:
            out.append(hashlib.sha256(b"".join([self.shown[c] for c in code[at:end].tolist()])[:-1]).hexdigest())
            at = end
        return out

    def pairs(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of each document in order, how often each is linked, and where each document starts (with the end appended)."""
        pair = block.a[block.link_a] * self.n_b + block.b[block.link_b]
        doc = np.repeat(np.arange(len(block.docs)), np.diff(block.link_bounds))
        top = len(self.a.pieces) * self.n_b
        both, times = np.unique(doc * top + pair, return_counts=True)
        return both % top, times, np.searchsorted(both, np.arange(len(block.docs) + 1) * top)


_LOADED: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Aligner(path_a, path_b)
    return _LOADED[path_a, path_b]


def _blocks(one: Aligner, texts: pd.Series) -> Iterator[Block]:
    numbers, block, size = [], [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        if block and size + len(text) > BLOCK_BYTES:
            yield one.block(numbers, block)
            numbers, block, size = [], [], 0
        numbers.append(i)
        block.append(text)
        size += len(text)
    if block:
        yield one.block(numbers, block)


class _Tally:
    """In how many documents of a task each pair is linked; handed on when it grows past its bound."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, pairs: np.ndarray, docs: np.ndarray) -> None:
        self.parts.append((pairs, docs))
        self.size += len(pairs)
        if self.size > 2 * TALLY:
            self._merge()

    def _merge(self) -> None:
        pairs, at = np.unique(np.concatenate([p for p, _ in self.parts]), return_inverse=True)
        docs = np.bincount(at, weights=np.concatenate([d for _, d in self.parts])).astype(np.int64)
        self.parts, self.size = [(pairs, docs)], len(pairs)

    def handed_on(self, last: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.size and (last or self.size > TALLY):
            self._merge()
            if last or self.size > TALLY:
                pairs, docs = self.parts[0]
                for at in range(0, len(pairs), TALLY_ROW):
                    yield pairs[at : at + TALLY_ROW], docs[at : at + TALLY_ROW].astype(np.int32)
                self.parts, self.size = [], 0


def _align(path_a: str, path_b: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    counts = ["n_a", "n_b", "n_groups", "n_links"]

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, tally, last = aligner(path_a, path_b), _Tally(), None
        for batch in batches:
            out = batch[["doc_id", "key"]].copy()
            n = len(out)
            numbers = {name: np.zeros(n, dtype=np.int64) for name in counts}
            digests, pairs, times = [""] * n, [b""] * n, [b""] * n
            for block in _blocks(one, batch["text"]):
                for name, values in zip(counts, (block.n_a, block.n_b, np.diff(block.group_bounds), np.diff(block.link_bounds))):
                    numbers[name][block.docs] = values
                found, often, bounds = one.pairs(block)
                tally.add(*np.unique(found, return_counts=True))
                for d, i, digest in zip(range(len(block.docs)), block.docs.tolist(), one.digests(block)):
                    a, b = bounds[d], bounds[d + 1]
                    digests[i] = digest
                    pairs[i] = np.diff(found[a:b], prepend=0).astype("<u4").tobytes()
                    times[i] = often[a:b].astype("<u4").tobytes()
            yield out.assign(**numbers, groups_sha256=digests, pairs=pairs, times=times, tally_pairs=None, tally_docs=None)
            yield from _tallied(out, tally.handed_on())
            last = out
        if last is not None:
            yield from _tallied(last, tally.handed_on(last=True))

    def _tallied(like: pd.DataFrame, rows: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
        for pairs, docs in rows:
            none = pd.DataFrame({"doc_id": pd.array([None], dtype=object), "key": pd.array([None], dtype="Int64")})
            empty = dict.fromkeys(counts, pd.array([None], dtype="Int64"))
            yield none.assign(**empty, groups_sha256=None, pairs=None, times=None, tally_pairs=[pairs], tally_docs=[docs])[[*like.columns, *counts, "groups_sha256", "pairs", "times", "tally_pairs", "tally_docs"]]

    return align


def _look_up(hot) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, docs, best = hot.value
        for batch in batches:
            rows = []
            for pairs, times in zip(batch["pairs"], batch["times"]):
                pair = np.cumsum(np.frombuffer(pairs, dtype="<u4"), dtype=np.int64)
                often = np.frombuffer(times, dtype="<u4").astype(np.int64)
                at = np.searchsorted(known, pair)
                hit = known[np.minimum(at, len(known) - 1)] == pair if len(known) else np.zeros(len(pair), dtype=bool)
                at, weight = at[hit], often[hit]
                rows.append((int(weight[best[at]].sum()), int((weight * docs[at]).sum()), pair[~hit], often[~hit].astype(np.int32)))
            names = ["hot_best", "hot_sum", "rest_pairs", "rest_times"]
            found = pd.DataFrame(rows, columns=names, index=batch.index)
            yield pd.concat([batch.drop(columns=["pairs", "times"]), found], axis=1)

    return look_up


def _counted(tallies: DataFrame, n_b: int) -> DataFrame:
    """(pair, docs, best) from tallies: in how many documents a pair is linked, and whether no pair of its first id is linked in more."""
    rows = tallies.select(F.explode(F.arrays_zip(F.col("tally_pairs").alias("pair"), F.col("tally_docs").alias("docs"))).alias("x")).select("x.*")
    counts = stored(rows.groupBy("pair").agg(F.sum("docs").alias("docs")), "align-counts")
    first = F.expr(f"pair div {n_b}").alias("first")
    most = counts.groupBy(first).agg(F.max("docs").alias("most"))
    return counts.withColumn("first", first).join(F.broadcast(most), "first").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))  # one row an id of the first vocabulary


def _hot(counts: DataFrame, bound: int) -> tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A number of documents that at most `bound` pairs reach, a power of two, and those pairs in order."""
    power = F.floor(F.log2("docs")).cast("int").alias("power")
    sizes = sorted(((r["power"], r["n"]) for r in counts.groupBy(power).agg(F.count("*").alias("n")).collect()), reverse=True)  # at most 63 rows
    total, least = 0, None
    for p, n in sizes:
        total += n
        if total > bound:
            break
        least = 1 << p
    if least is None:
        none = np.zeros(0, dtype=np.int64)
        return 1 << 62, (none, none, none.astype(bool))
    rows = counts.where(F.col("docs") >= least).toPandas().sort_values("pair")
    return least, (rows["pair"].to_numpy(np.int64), rows["docs"].to_numpy(np.int64), rows["best"].to_numpy(bool))


def align(docs: DataFrame, path_a: str = vocabularies.BYTE_BPE, path_b: str = vocabularies.PIECE_BPE, hot: int = HOT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of docs(doc_id, text).

    n_best counts the links whose pair is in as many documents as any pair of its first id, count_sum adds up the pairs' documents over links.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", F.monotonically_increasing_id().alias("key"), F.col("text").cast("string").alias("text"))
    table = stored(read.mapInPandas(_align(path_a, path_b), _ALIGNED.format(id=kind)), "aligned")
    counts = stored(_counted(table.where("tally_pairs is not null").select("tally_pairs", "tally_docs"), vocabularies.piece_vocabulary(path_b).model.get_piece_size()), "align-best")
    least, known = _hot(counts, hot)
    beside = spark.sparkContext.broadcast(known)
    documents = table.where("key is not null").drop("tally_pairs", "tally_docs")
    partial = stored(documents.mapInPandas(_look_up(beside), _LOOKED_UP.format(id=kind)), "align-partial")
    discard(table)
    rest = partial.where(F.size("rest_pairs") > 0).select("key", F.explode(F.arrays_zip(F.col("rest_pairs").alias("pair"), F.col("rest_times").alias("times"))).alias("x")).select("key", "x.*")
    joined = rest.join(counts.where(F.col("docs") < least), "pair")
    sums = joined.groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("rest_best"), F.sum(F.col("times") * F.col("docs")).alias("rest_sum"))
    added = lambda name: (F.col(f"hot_{name}") + F.coalesce(f"rest_{name}", F.lit(0))).cast("long")
    return partial.join(sums, "key", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", added("best").alias("n_best"), added("sum").alias("count_sum"), "groups_sha256"
    )


def _list_groups(path_a: str, path_b: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = aligner(path_a, path_b)
        for batch in batches:
            rows = [([], [], [], [], [])] * len(batch)
            for block in _blocks(one, batch["text"]):
                first_a, first_b = np.cumsum(block.n_a) - block.n_a, np.cumsum(block.n_b) - block.n_b
                for d, i in enumerate(block.docs.tolist()):
                    groups = slice(block.group_bounds[d], block.group_bounds[d + 1])
                    a, b = (x[s : s + n] for x, s, n in ((block.a, first_a[d], block.n_a[d]), (block.b, first_b[d], block.n_b[d])))
                    rows[i] = a, b, block.a_ends[groups] - first_a[d], block.b_ends[groups] - first_b[d], block.byte_ends[groups] - block.byte_bounds[d]
            out = pd.DataFrame(rows, columns=["a_ids", "b_ids", "a_ends", "b_ends", "byte_ends"], index=batch.index)
            out.insert(0, "doc_id", batch["doc_id"])
            yield out

    return listed


def groups(docs: DataFrame, path_a: str = vocabularies.BYTE_BPE, path_b: str = vocabularies.PIECE_BPE) -> DataFrame:
    """(doc_id, a_ids, b_ids, a_ends, b_ends, byte_ends): both token sequences of every document, and for each group how many tokens and bytes (of a space and the text) it ends."""
    read = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return read.mapInPandas(_list_groups(path_a, path_b), _GROUPS.format(id=docs.schema["doc_id"].dataType.simpleString()))
