"""Packing token sequences into windows of near-equal length by Karmarkar-Karp multiway differencing.

A document's ids end with one end id. Whole runs of `capacity` ids are windows of their own; what remains of a document is one item. Documents are dealt
to pools by a hash of the number under which they were read, so a pool holds some `POOL_WINDOWS` windows whatever the table, and a group of equal
documents is spread. In a pool every item starts as a partition of one item and empty windows. The two partitions with the largest imbalance
(longest less shortest window) are merged, the longest windows of one with the shortest of the other, until one partition is left. The pool starts
with as many windows as its ids need; where a window exceeds the capacity, the count rises and the differencing starts again.

Whole items seldom come out even, so a sixteenth of a pool's documents are cut into halves, quarters and so on, which level what the others leave.
A pool whose windows still rise by more than a hundredth (equal lengths that do not fit together) cuts a quarter of its documents, then all.

Texts are read and encoded once. Checksums of the possible pieces are taken there, so that only narrow rows reach the pools; `sequences` brings the ids.

Defined cases: null and empty texts have the end id alone; strings of special tokens inside texts are those tokens, as the library has it; very long texts
make many whole windows; equal rows are packed each for itself; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import stored
from . import vocabularies

CAPACITY = 2048
END_ID = 1
#: Windows that a pool aims at, besides whole ones.
POOL_WINDOWS = 256
#: Shares of a pool's documents that are cut, one after the other; how far windows may rise before the next share is tried.
SHARES, RISE = (1 / 16, 1 / 4, 1.0), 0.01
#: The shortest piece that is halved again.
GRAIN = 8
_ENCODED = "key long, doc_id {id}, n long, whole array<long>, rest_crc long, halves array<long>"
_PIECES = "key long, doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def halved(length: int) -> list[int]:
    """Lengths of the pieces of an item that is cut: half of it, half of what is left, and so on."""
    out = []
    while length > GRAIN:
        out.append((length + 1) // 2)
        length //= 2
    return [*out, length] if length else out


def _encoder(path: str, capacity: int, end_id: int, with_ids: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = vocabularies.byte_vocabulary(path)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                ids = np.append(vocabulary.ids(text or ""), np.uint32(end_id)).astype("<u4")
                raw, full = memoryview(ids.tobytes()), len(ids) // capacity
                whole = [zlib.crc32(raw[4 * capacity * i : 4 * capacity * (i + 1)]) for i in range(full)]
                ends = np.cumsum([0, *halved(len(ids) - full * capacity)]) + full * capacity
                halves = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                rows.append((len(ids), whole, zlib.crc32(raw[4 * full * capacity :]), halves, bytes(raw) if with_ids else b""))
            out = pd.DataFrame(rows, columns=["n", "whole", "rest_crc", "halves", "ids"])
            out.insert(0, "key", batch["key"])
            out.insert(1, "doc_id", batch["doc_id"])
            yield out if with_ids else out.drop(columns="ids")

    return encode


def differenced(lengths: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """The window of each item among k, and the longest window, by merging the partitions with the largest imbalance."""
    n = len(lengths)
    heap = [(-int(x), i) for i, x in enumerate(lengths.tolist())]
    heapq.heapify(heap)
    sums: dict[int, np.ndarray] = {}
    merges: list[tuple[int, int, np.ndarray]] = []

    def taken() -> tuple[int, np.ndarray]:
        i = heapq.heappop(heap)[1]
        if i in sums:
            return i, sums.pop(i)
        alone = np.zeros(k, dtype=np.int64)
        alone[0] = lengths[i]
        return i, alone

    while len(heap) > 1:
        (a, left), (b, right) = taken(), taken()
        both = left + right[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        node = n + len(merges)
        sums[node] = both
        merges.append((a, b, order))
        heapq.heappush(heap, (int(both[-1] - both[0]), node))
    # from the last merge back: which window each place of a partition is
    places = {n + len(merges) - 1: np.arange(k)} if merges else {0: np.arange(k)}
    longest = int(sums[n + len(merges) - 1][0]) if merges else int(lengths[0])
    for i in range(len(merges) - 1, -1, -1):
        a, b, order = merges[i]
        mine = places.pop(n + i)
        left, right = np.empty(k, dtype=np.int64), np.empty(k, dtype=np.int64)
        left[order] = mine
        right[k - 1 - order] = mine
        places[a], places[b] = left, right
    return np.array([places[i][0] for i in range(n)]), longest


def _pool_pieces(rest: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Which document, start inside its item and length of each piece, its window, and how many windows, for items of the lengths `rest`."""
    total, cut_order = int(rest.sum()), np.flatnonzero(rest)
    least = max(1, -(-total // capacity))
    for share in SHARES:
        cut = set(cut_order[: int(np.ceil(share * len(cut_order)))].tolist())
        pieces = []
        for i in cut_order.tolist():
            at = 0
            for length in halved(int(rest[i])) if i in cut else [int(rest[i])]:
                pieces.append((i, at, length))
                at += length
        table = np.array(pieces, dtype=np.int64).reshape(-1, 3)
        k = least
        while True:
            window, longest = differenced(table[:, 2], k)
            if longest <= capacity:
                return table, window, k
            k += max(1, -(-(longest - capacity) * k // (2 * capacity * POOL_WINDOWS)))
            if share < 1 and k > least + 1 + RISE * least:
                break
    raise AssertionError("windows of one piece each always fit")


def _packer(capacity: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def pack(pool: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", kind="stable").reset_index(drop=True)
        n = rows["n"].to_numpy(dtype=np.int64)
        full = n // capacity
        columns: list[np.ndarray] = []  # document, start, length, checksum, window, place in it
        packed = 0
        if (n - full * capacity).any():
            pieces, window, _ = _pool_pieces(n - full * capacity, capacity)
            order = np.lexsort((pieces[:, 1], pieces[:, 0], window))
            pieces, window = pieces[order], np.unique(window[order], return_inverse=True)[1]  # windows that hold nothing have no number
            packed = int(window.max()) + 1
            before = np.cumsum(pieces[:, 2]) - pieces[:, 2]
            first = np.flatnonzero(np.diff(window, prepend=-1))
            offset = before - before[first][window]
            rest_crc, halves = rows["rest_crc"].tolist(), rows["halves"].tolist()
            nth = [{int(s): j for j, s in enumerate(np.cumsum([0, *halved(int(r))])[:-1])} for r in (n - full * capacity)]
            crc = [rest_crc[i] if length == n[i] - full[i] * capacity else halves[i][nth[i][at]] for i, at, length in pieces.tolist()]
            columns.append(np.column_stack([pieces[:, 0], pieces[:, 1] + full[pieces[:, 0]] * capacity, pieces[:, 2], np.array(crc, dtype=np.int64), window, offset]))
        if full.any():
            doc = np.repeat(np.arange(len(n)), full)
            nth_run = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)
            crc = np.concatenate([np.asarray(x, dtype=np.int64) for x in rows["whole"] if len(x)])
            columns.append(np.column_stack([doc, nth_run * capacity, np.full(len(doc), capacity), crc, packed + np.arange(len(doc)), np.zeros(len(doc), dtype=np.int64)]))
        table = np.concatenate(columns)
        doc = table[:, 0]
        out = rows[["key", "doc_id"]].iloc[doc].reset_index(drop=True)
        out["start"], out["length"], out["ids_crc32"], out["doc_tokens"] = table[:, 1], table[:, 2], table[:, 3], n[doc]
        out["sequence_id"], out["offset"] = (int(pool[0]) << 32) + table[:, 4], table[:, 5]
        return out

    return pack


def _encoded(docs: DataFrame, path: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    read = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", F.col("text").cast("string").alias("text"))
    schema = _ENCODED.format(id=docs.schema["doc_id"].dataType.simpleString()) + (", ids binary" if with_ids else "")
    return stored(read.mapInPandas(_encoder(path, capacity, end_id, with_ids), schema), "pack-encoded")


def _plan(encoded: DataFrame, capacity: int) -> DataFrame:
    rest = encoded.agg(F.sum(F.col("n") % capacity)).first()[0] or 0
    pools = max(1, -(-rest // (capacity * POOL_WINDOWS)))
    pooled = encoded.select("key", "doc_id", "n", "whole", "rest_crc", "halves", F.pmod(F.xxhash64("key"), F.lit(pools)).alias("pool"))
    schema = _PIECES.format(id=encoded.schema["doc_id"].dataType.simpleString())
    return pooled.groupBy("pool").applyInPandas(_packer(capacity), schema)


def pack(docs: DataFrame, path: str = vocabularies.BYTE_BPE, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for every piece of docs(doc_id, text)."""
    return _plan(_encoded(docs, path, capacity, end_id, with_ids=False), capacity).drop("key")


def _window_ids(capacity: int, pad_id: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def joined(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("offset")
        ids = np.frombuffer(b"".join(rows["ids"]), dtype="<u4").astype(np.int32)
        size = len(ids) if len(ids) & (len(ids) - 1) == 0 else capacity
        padded = np.concatenate([ids, np.full(size - len(ids), pad_id, dtype=np.int32)])
        return pd.DataFrame({"sequence_id": [int(key[0])], "ids": [padded], "n_ids": [len(ids)], "starts": [rows["offset"].to_numpy(dtype=np.int32)]})

    return joined


def sequences(docs: DataFrame, path: str = vocabularies.BYTE_BPE, capacity: int = CAPACITY, end_id: int = END_ID, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, n_ids, starts): the windows themselves, padded to the capacity unless their length is a power of two; `starts` are the offsets of pieces."""
    encoded = _encoded(docs, path, capacity, end_id, with_ids=True)
    plan = stored(_plan(encoded, capacity).select("key", "start", "length", "sequence_id", "offset"), "pack-plan")
    cut = F.expr("substring(ids, cast(4 * start + 1 as int), cast(4 * length as int))").alias("ids")
    pieces = plan.join(encoded.select("key", "ids"), "key").select("sequence_id", "offset", cut)
    return pieces.groupBy("sequence_id").applyInPandas(_window_ids(capacity, pad_id), "sequence_id long, ids array<int>, n_ids int, starts array<int>")
