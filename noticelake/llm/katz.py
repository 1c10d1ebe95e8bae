"""Scores of texts under a Katz back-off model of order `ORDER`.

Tokens are runs of characters outside [\\x20\\x09-\\x0D], lower-cased in A-Z, then one end token; a text
begins after `ORDER` - 1 marks that are contexts only. For an n-gram of a context h and a word w

    P(w | h) = d * c(hw) / c(h)        where c(hw) >= KEEP, d being the Good-Turing discount of the count
    P(w | h) = alpha(h) * P(w | h')    otherwise, h' being h without its first word

down to P(w) = (c(w) + 1/2) / (N + (V + 1) / 2), which leaves room for one class of unknown words.
alpha(h) makes the probabilities of every context sum to one: what its kept followers lose goes to the
others. All words and all n-grams take part, those that occur once included, whatever the size of the corpus.

The recursion is a sum of what each level changes,

    log P(w | h) = log P(w | h') - whole(h) + (log(d * c(hw)) - log P(w | h') for kept hw, else free(h)),

whole(h) being the logarithm of c(h) and free(h) = whole(h) + log alpha(h), so a text is scored level by level.

The n-grams of a level, n >= 2, are exchanged once, packed, in all texts that are scored or learnt from, and are
counted and looked up in the same bucket. An n-gram goes to the bucket of its last n - 1 words (suffix), where
log P(w | h') is; if these are frequent, and so known everywhere, to that of its context; if both are, to that of
the whole n-gram. Each bucket gives sums by text, sums by context (of what its followers take), and the contexts
of n-grams that are not kept, whose free(h) is looked up when all contexts are known. whole(h) is looked up
by the context's own occurrences, together with the probabilities of words.

Frequent means at least 1 / `HOT` of all tokens, so at most `HOT` keys are, which every task holds. An n-gram that
recurs in a chunk of texts is sent once, with its count, and the sums of its texts are made up from its value
there. A frequent word, context or n-gram is therefore never one group, and rows are at most as many as tokens.

Defined cases: a null text is empty and has only its end token; equal rows get equal results; texts of
any length are scored whole; with no training rows every probability is that of an unknown word of an
empty model, 1; doc_id may be null or repeat; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import discard, input_partitions, stored
from .textarrays import BLANKS, LOWER_ASCII, blocks, mix64, tokens

ORDER, KEEP, GOOD_TURING = 2, 1, 5
HOT = 1 << 20
CHUNK_TOKENS, TALLY = 1_000_000, 2_000_000
BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
LOW48 = np.uint64((1 << 48) - 1)
NO_ID = np.iinfo(np.int64).min


def joined(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """The key of an n-gram from those of its first and of its last n - 1 words."""
    return mix64(context * np.uint64(0xD6E8FEB86659FD93) + suffix)


def padding(order: int) -> np.uint64:
    """The key of `order` begin marks."""
    key = np.array([BEGIN])
    for _ in range(order - 1):
        key = joined(key, key)
    return key[0]


def grams(texts: list[str | None], order: int) -> Iterator[tuple[int, int, list[np.ndarray], np.ndarray]]:
    """(first text, texts, the `order` words of each n-gram, text of each n-gram) by block; one n-gram ends at every token."""
    for first, buf, starts in blocks(texts, lower=False):
        word, bounds = tokens(LOWER_ASCII[buf], starts, member=BLANKS)
        n, pad = len(bounds) - 1, order - 1
        seq = np.full(len(word) + n * (pad + 1), BEGIN)
        seq[np.arange(len(word)) + np.repeat(np.arange(n), np.diff(bounds)) * (pad + 1) + pad] = word
        ends = bounds[1:] + np.arange(1, n + 1) * (pad + 1) - 1
        seq[ends] = END
        inside = np.ones(len(seq), dtype=bool)
        for j in range(pad):
            inside[np.concatenate([[0], ends[:-1] + 1]) + j] = False
        token = np.flatnonzero(inside)
        yield first, n, [seq[token - j] for j in range(pad, -1, -1)], np.repeat(np.arange(n, dtype=np.int64), np.diff(bounds) + 1)


def keys_of(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, key of the first n - 1 words, key of the last n - 1 words) of n-grams."""
    level = list(words)
    while len(level) > 2:
        level = [joined(a, b) for a, b in zip(level[:-1], level[1:])]
    return (joined(*level), *level) if len(level) == 2 else (level[0], level[0], level[0])


# --- counting --------------------------------------------------------------------------------------


def word_counts(rows: DataFrame) -> DataFrame:
    """(key, count, total) of every token, the end token included: in the rows to learn from, and in all."""

    def counted(learnt: list[np.ndarray], other: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        for held, of in ((learnt, 1), (other, 0)):
            key, total = np.unique(np.concatenate(held or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pd.DataFrame({"key": key.view(np.int64), "count": total * of, "total": total})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        learnt, other, size = [], [], 0
        for batch in batches:
            learn = batch["learn"].to_numpy(dtype=bool)
            for first, _, (key,), text in grams(batch["text"].tolist(), 1):
                mine = learn[first + text]
                learnt.append(key[mine])
                other.append(key[~mine])
                size += len(key)
                if size >= TALLY:
                    yield from counted(learnt, other)
                    learnt, other, size = [], [], 0
        yield from counted(learnt, other)

    found = rows.select("text", "learn").mapInPandas(count, "key long, count long, total long")
    return found.groupBy("key").agg(F.sum("count").alias("count"), F.sum("total").alias("total"))


def _narrow(x: np.ndarray) -> bytes:
    """Small numbers as bytes, shorts or longs; the length tells which."""
    kind = np.uint8 if not len(x) or x.max() < 1 << 8 else np.uint16 if x.max() < 1 << 16 else np.int64
    return x.astype(kind).tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, dtype={1: np.uint8, 2: np.uint16, 8: np.int64}[len(raw) // n] if n else np.uint8).astype(np.int64)


def _bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def bucket_column(key: Column, buckets: int) -> Column:
    return (F.shiftrightunsigned(key, 40) % buckets).cast("int")


def good_turing(levels: dict[int, int]) -> list[float]:
    """Discount factors of the counts 0 .. GOOD_TURING + 1 (the last stands for all larger counts) from the numbers of n-grams by count.

    Where the numbers are too irregular for factors between 0 and 1, they are smoothed first: a straight
    line through log n_r over log r; where that is not steep enough to discount, n_r goes with r ** -2.
    """
    k = GOOD_TURING
    n = np.array([0.0] + [float(levels.get(r, 0)) for r in range(1, k + 2)])
    r = np.arange(1, k + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        common = (k + 1) * n[k + 1] / n[1]
        factor = ((r + 1) * n[2:] / (r * n[1:-1]) - common) / (1 - common)
    if not np.all(np.isfinite(factor) & (factor > 0) & (factor < 1)):
        seen = np.flatnonzero(n > 0)
        slope = np.polyfit(np.log(seen), np.log(n[seen]), 1)[0] if len(seen) > 1 else 0.0
        factor = (1 + 1 / r) ** ((slope if slope < -1.05 else -2.0) + 1)
    return [1.0, *factor.tolist(), 1.0]


# --- the model -------------------------------------------------------------------------------------


@dataclass
class Level:
    """What the n-grams of one order add to a text: table(key, total, value, lp, known), with what the begin marks add to every text."""

    table: DataFrame
    begin: float


@dataclass
class Model:
    tokens: int
    distinct: int
    all_tokens: int

    @property
    def unknown(self) -> float:
        """log10 probability of an unknown word."""
        return float(np.log10(0.5 / (self.tokens + 0.5 * (self.distinct + 1))))

    @property
    def hot_count(self) -> int:
        """Count of an n-gram from which every task holds it; at most HOT n-grams of an order have it."""
        return max(1, -(-self.all_tokens // HOT))


def word_model(rows: DataFrame) -> tuple[Model, DataFrame]:
    """The totals and (key, count, total, lp) of the words of rows(text, learn)."""
    words = stored(word_counts(rows), "katz-words")
    known = F.when(F.col("count") > 0, 1)
    sums = words.agg(F.sum("count"), F.count(known), F.sum("total")).first()
    model = Model(*(int(x or 0) for x in sums))
    lp = F.log10((F.col("count") + 0.5) / F.lit(model.tokens + 0.5 * (model.distinct + 1)))
    return model, words.withColumn("lp", lp)


# --- n-grams of two and more words -----------------------------------------------------------------


@dataclass
class Frequent:
    """The frequent keys of the order below, by falling count after the begin marks. A key's code is its place here, or else the key itself."""

    names: np.ndarray
    below: np.ndarray

    def codes(self, keys: np.ndarray) -> np.ndarray:
        by_key = np.argsort(self.names)
        ordered = self.names[by_key]
        at = np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)
        return np.where(ordered[at] == keys, by_key[at].astype(np.uint64), keys)

    def keys(self, codes: np.ndarray) -> np.ndarray:
        hot = codes < len(self.names)
        out = codes.copy()
        out[hot] = self.names[codes[hot].astype(np.int64)]
        return out


def frequent(lower: DataFrame, order: int, model: Model) -> Frequent:
    """The at most HOT frequent keys of lower(key, total, lp)."""
    hot = lower.where(F.col("total") >= model.hot_count).select("key", "total", "lp").toArrow()
    by_total = np.argsort(-hot["total"].to_numpy(), kind="stable")
    names, below = hot["key"].to_numpy().astype(np.int64).view(np.uint64)[by_total], hot["lp"].to_numpy().astype(np.float64)[by_total]
    return Frequent(np.concatenate([[padding(order)], names]).astype(np.uint64), np.concatenate([[0.0], np.nan_to_num(below)]))


def _places(code: np.ndarray) -> bytes:
    """Codes of frequent keys; the second part is mostly zeros and shrinks."""
    return code.astype(np.uint16).tobytes() + (code >> np.uint64(16)).astype(np.uint8).tobytes()


def _codes(raw: bytes, n: int, hot: bool) -> np.ndarray:
    if not hot:
        return np.frombuffer(raw, np.uint64)
    return np.frombuffer(raw, np.uint16, n).astype(np.uint64) | (np.frombuffer(raw, np.uint8, n, 2 * n).astype(np.uint64) << np.uint64(16))


def _gaps(target: np.ndarray) -> bytes:
    return _narrow(np.diff(target, prepend=0))


def _targets(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(_wide(raw, n))


def _runs(sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.diff(sorted_, prepend=~sorted_[:1]) != 0)


def _recurring(key: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, number of the key at each place) of the keys that occur at least `least` times."""
    part = (key >> np.uint64(44)).astype(np.int64)
    maybe = np.flatnonzero(np.bincount(part, minlength=1 << 20)[part] >= least)
    _, of, count = np.unique(key[maybe], return_inverse=True, return_counts=True)
    often = count >= least
    mine = often[of]
    return maybe[mine], (np.cumsum(often) - 1)[of[mine]]


def _gram_pieces(order: int, hot: Frequent, buckets: int):
    """Map side: for each chunk of texts one row of its texts, and one row of n-grams for each bucket that has some.

    An n-gram's target is the number of its text, or one after those for an n-gram that recurs in the chunk.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        chunk, part = 0, TaskContext.get().partitionId()
        names = "id", "digest", "learn", "context", "suffix", "target"
        held = {k: [] for k in names}
        size = docs = 0

        def flush() -> pd.DataFrame:
            name = (part << 24) + chunk
            info = {k: np.concatenate(held.pop(k)) for k in ("id", "digest", "learn")}
            learn, target = info["learn"], np.concatenate(held.pop("target"))
            context, suffix = hot.codes(np.concatenate(held.pop("context"))), hot.codes(np.concatenate(held.pop("suffix")))
            key, n_hot = joined(context, suffix), len(hot.names)
            bucket = _bucket_of(np.where(suffix >= n_hot, suffix, np.where(context >= n_hot, context, key)), buckets)
            at, number = _recurring(key, max(16, len(key) // (4 * buckets)))
            n = int(number.max()) + 1 if len(number) else 0
            texts, times = np.unique(target[at].astype(np.int64) * n + number, return_counts=True)
            info |= {"text": (texts // max(n, 1)).astype(np.int32), "number": (texts % max(n, 1)).astype(np.int32), "times": times.astype(np.int32), "recurring": n}
            one = at[np.unique(number, return_index=True)[1]]
            again = bucket[one], context[one], suffix[one], np.bincount(number, weights=learn[target[at]], minlength=n).astype(np.int64)
            left = np.ones(len(key), dtype=bool)
            left[at] = False
            left = np.flatnonzero(left)
            kind = 4 * ~learn[target[left]] + 2 * (context[left] >= n_hot) + (suffix[left] >= n_hot)
            slot = bucket[left] * 8 + kind
            by_slot = np.argsort(slot.astype(np.uint16 if buckets * 8 < 1 << 16 else np.int32), kind="stable")
            slot, left = slot[by_slot], left[by_slot]
            context, suffix, target = context[left], suffix[left], target[left]
            rows = {}
            for own in np.split(np.arange(len(slot)), _runs(slot)[1:]):
                if len(own):
                    here, kind = slice(own[0], own[-1] + 1), int(slot[own[0]]) % 8
                    c, s = (x[here].tobytes() if cold else _places(x[here]) for x, cold in ((context, kind & 2), (suffix, kind & 1)))
                    rows.setdefault(int(slot[own[0]]) // 8, []).append((kind, len(own), c, s, _gaps(target[here]), None))
            for b in np.unique(again[0]):
                own = np.flatnonzero(again[0] == b)
                rows.setdefault(int(b), []).append((3, len(own), again[1][own].tobytes(), again[2][own].tobytes(), _gaps(own + docs), _narrow(again[3][own])))
            out = [(b, name, sum(part[1] for part in x), pickle.dumps(x), None) for b, x in rows.items()] + [(name % buckets, name, 0, None, pickle.dumps(info))]
            return pd.DataFrame(out, columns=["bucket", "chunk", "n", "data", "info"])

        for batch in batches:
            ids = _ids(batch)
            digest, learn = batch["digest"].to_numpy(dtype=np.int64), batch["learn"].to_numpy(dtype=bool)
            for first, n, words, doc in grams(batch["text"].tolist(), order):
                _, context, suffix = keys_of(words)
                here = slice(first, first + n)
                for k, x in zip(names, (ids[here], digest[here], learn[here], context, suffix, (doc + docs).astype(np.int32))):
                    held[k].append(x)
                docs += n
                size += len(doc)
                if size >= CHUNK_TOKENS:
                    yield flush()
                    held = {k: [] for k in names}
                    chunk, size, docs = chunk + 1, 0, 0
        if docs:
            yield flush()

    return split


GRAM_SCHEMA = "chunk long, info binary, sums binary, bucket int, contexts binary, asked binary, levels binary, grams binary"


def _gram_counter(hot: Frequent, buckets: int, with_grams: bool):
    """Reduce side: counts of one bucket's n-grams, with the part of the order below that has their suffixes.

    Rows have either sums by target of a chunk (with the frequent contexts of n-grams that are not kept), sums by
    context for the context's bucket, other contexts asked for by targets, numbers of n-grams by count, or n-grams.
    """
    n_hot, ranks = len(hot.names), GOOD_TURING + 2

    def evaluate(pieces: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        out = [{"chunk": c, "info": x} for c, x in zip(pieces["chunk"], pieces["info"]) if x is not None]
        size = int(pieces["n"].sum())
        if not size:
            return _frame(out)
        context, suffix = np.empty(size, dtype=np.uint64), np.empty(size, dtype=np.uint64)
        target, weight = np.empty(size, dtype=np.int32), np.empty(size, dtype=np.int32)
        spans, end = [], 0
        for chunk, data in zip(pieces["chunk"], pieces["data"]):
            if data is None:
                continue
            spans.append([chunk, end])
            for kind, n, c, s, t, w in pickle.loads(data):
                own = slice(end, end + n)
                context[own], suffix[own], target[own] = _codes(c, n, not kind & 2), _codes(s, n, not kind & 1), _targets(t, n)
                weight[own] = kind < 4 if w is None else _wide(w, n)
                end += n
            spans[-1].append(end)
        key = joined(context, suffix)
        by_key = np.argsort(key)
        key = key[by_key]
        new = np.ones(size, dtype=bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        del key
        first = np.flatnonzero(new)
        number = np.empty(size, dtype=np.int32)
        number[by_key] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        count, at = np.add.reduceat(weight[by_key], first, dtype=np.int64), by_key[first]
        del by_key, weight, new
        own_context, own_suffix = context[at], suffix[at]
        del suffix
        below = _below(own_suffix, table)
        kept = count >= KEEP
        rank = np.where(kept, np.minimum(count, GOOD_TURING + 1), 0).astype(np.int8)
        value = np.where(kept, np.log10(np.maximum(count, 1)) - below, 0.0)
        asks = []
        for chunk, begin, stop in spans:
            of, t, c = number[begin:stop], target[begin:stop], context[begin:stop]
            r, n = rank[of], int(t.max()) + 1
            tally = np.bincount(t.astype(np.int64) * ranks + r, minlength=n * ranks).reshape(n, ranks)
            has = np.flatnonzero(tally[:, 1:].any(axis=1))
            sums = np.bincount(t, weights=value[of], minlength=n)[has]
            not_kept = r == 0
            near, far = np.flatnonzero(not_kept & (c < n_hot)), np.flatnonzero(not_kept & (c >= n_hot))
            near = near[np.argsort(t[near], kind="stable")]
            asks.append((np.full(len(far), chunk), c[far], t[far]))
            packed = len(has), _gaps(has), sums.tobytes(), [_narrow(tally[has, k]) for k in range(1, ranks - 1)], len(near), _places(c[near]), _gaps(t[near])
            out.append({"chunk": chunk, "sums": pickle.dumps(packed)})
        del number, target, context
        chunk, c, t = (np.concatenate(x) for x in zip(*asks))
        for b, own in _by_bucket(c, buckets):
            out.append({"bucket": b, "asked": pickle.dumps((c[own].tobytes(), chunk[own], t[own]))})
        trained = np.flatnonzero(count > 0)
        if len(trained):
            trained = trained[np.argsort(own_context[trained])]
            run = _runs(own_context[trained])
            name, times = hot.keys(own_context[trained][run]), count[trained]
            low = np.add.reduceat(np.where(kept[trained], 10.0 ** below[trained], 0.0), run)
            parts = [np.add.reduceat((times == r).astype(np.int64), run) for r in range(1, GOOD_TURING + 1)] + [np.add.reduceat(np.where(times > GOOD_TURING, times, 0), run)]
            for b, own in _by_bucket(name, buckets):
                out.append({"bucket": b, "contexts": pickle.dumps((name[own].tobytes(), low[own].tobytes(), [_narrow(x[own]) for x in parts]))})
            out.append({"levels": np.bincount(times[times <= GOOD_TURING + 1], minlength=ranks).tobytes()})
            if with_grams:
                own = hot.keys(own_context[trained])
                out.append({"grams": pickle.dumps((joined(own, hot.keys(own_suffix[trained])), own, times))})
        return _frame(out)

    def _below(suffix: np.ndarray, table: pd.DataFrame) -> np.ndarray:
        known, lp = table["key"].to_numpy(dtype=np.int64).view(np.uint64), table["lp"].to_numpy(dtype=np.float64)
        by_key = np.argsort(known)
        known, lp = known[by_key], lp[by_key]
        near = suffix < n_hot
        out = np.zeros(len(suffix))
        out[near] = hot.below[suffix[near].astype(np.int64)]
        if len(known):
            far = np.flatnonzero(~near)
            at = np.minimum(np.searchsorted(known, suffix[far]), len(known) - 1)
            out[far] = np.where(known[at] == suffix[far], lp[at], 0.0)  # others are not kept
        return out

    return evaluate


def _frame(rows: list[dict]) -> pd.DataFrame:
    columns = [x.split()[0] for x in GRAM_SCHEMA.split(", ")]
    return pd.DataFrame(rows, columns=columns, dtype=object).astype({"chunk": "Int64", "bucket": "Int64"})


def _by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    bucket = _bucket_of(keys, buckets)
    by_bucket = np.argsort(bucket, kind="stable")
    for own in np.split(by_bucket, _runs(bucket[by_bucket])[1:]):
        if len(own):
            yield int(bucket[own[0]]), own


def _context_values(factor: list[float]):
    """What the sums of contexts, gathered from all buckets, give: log10 of the whole, and with log10 alpha."""

    def evaluate(rows: pd.DataFrame) -> pd.DataFrame:
        keys, lows, parts = [], [], []
        for data in rows["contexts"]:
            key, low, part = pickle.loads(data)
            keys.append(np.frombuffer(key, np.uint64))
            lows.append(np.frombuffer(low))
            parts.append(np.stack([_wide(x, len(keys[-1])) for x in part]))
        key, low, part = np.concatenate(keys), np.concatenate(lows), np.concatenate(parts, axis=1)
        by_key = np.argsort(key)
        run = _runs(key[by_key])
        low, part = np.add.reduceat(low[by_key], run), np.add.reduceat(part[:, by_key], run, axis=1)
        times = np.array([*range(1, GOOD_TURING + 1), 1])
        count = times @ part
        mass = (times * np.where(np.minimum(np.arange(1, GOOD_TURING + 2), KEEP) == KEEP, factor[1:], 0.0)) @ part
        # a context whose followers lose nothing gets one more count, which goes to the others
        whole = np.where(mass >= count * (1 - 1e-12), mass + 1, count)
        free = np.log10((whole - mass) / np.maximum(1 - low, 1e-12))
        return pd.DataFrame({"key": key[by_key][run].view(np.int64), "total": count, "whole": np.log10(whole), "free": free})

    return evaluate


def _asked(asks: pd.DataFrame, contexts: pd.DataFrame) -> pd.DataFrame:
    """Sums by target of what the contexts of one bucket leave to others, where that was asked for."""
    key, value = contexts["key"].to_numpy(dtype=np.int64).view(np.uint64), contexts["free"].to_numpy(dtype=np.float64)
    if not len(key) or not len(asks):
        return pd.DataFrame({"chunk": [], "sums": []})
    by_key = np.argsort(key)
    key, value = key[by_key], value[by_key]
    wanted, chunk, target = zip(*map(pickle.loads, asks["asked"]))
    wanted, chunk, target = np.concatenate([np.frombuffer(x, np.uint64) for x in wanted]), np.concatenate(chunk), np.concatenate(target)
    at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
    known = np.flatnonzero(key[at] == wanted)  # contexts that were never seen leave everything to the order below
    known = known[np.lexsort((target[known], chunk[known]))]
    out = []
    for own in np.split(known, _runs(chunk[known])[1:]):
        if len(own):
            first = _runs(target[own])
            out.append((int(chunk[own[0]]), pickle.dumps((len(first), _gaps(target[own][first]), np.add.reduceat(value[at[own]], first).tobytes(), None, 0, b"", b""))))
    return pd.DataFrame(out, columns=["chunk", "sums"])


def _gram_documents(factor: list[float], free: np.ndarray):
    """All sums of one chunk, one row for each text."""
    discount = np.log10(factor)

    def evaluate(rows: pd.DataFrame) -> pd.DataFrame:
        info = pickle.loads(next(x for x in rows["info"] if x is not None))
        n = len(info["id"])
        total = np.zeros(n + info["recurring"])
        for data in rows["sums"]:
            if data is None:
                continue
            m, target, sums, tally, asked, context, by = pickle.loads(data)
            target = _targets(target, m)
            total[target] += np.frombuffer(sums)
            for k, x in enumerate(tally or (), 1):
                total[target] += discount[k] * _wide(x, m)
            if asked:
                total += np.bincount(_targets(by, asked), weights=free[_codes(context, asked, True).astype(np.int64)], minlength=len(total))
        total[:n] += np.bincount(info["text"], weights=total[n + info["number"]] * info["times"], minlength=n)
        ids = info["id"]
        return pd.DataFrame({"doc_id": pd.Series(ids, dtype="Int64").mask(ids == NO_ID), "digest": info["digest"], "total": total[:n]})

    return evaluate


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for data in batch["grams"]:
            key, context, count = pickle.loads(data)
            yield pd.DataFrame({"key": key.view(np.int64), "context": context.view(np.int64), "count": count})


def gram_sums(rows: DataFrame, lower: DataFrame, n: int, model: Model, buckets: int, with_grams: bool) -> tuple[DataFrame, DataFrame, float, DataFrame | None]:
    """What the n-grams of rows(doc_id, digest, learn, text) change in each row's score but for the wholes of its contexts.

    lower(key, total, lp) has the order below. Returned are (doc_id, digest, total); contexts(key, total, whole, free)
    and the whole of the begin marks; and, if asked for, the n-grams as lower of the next order.
    """
    hot, buckets = frequent(lower, n - 1, model), 2 * buckets  # each holds all occurrences of its n-grams
    pieces = rows.mapInPandas(_gram_pieces(n, hot, buckets), "bucket int, chunk long, n int, data binary, info binary")
    cold = lower.where(F.col("total") < model.hot_count).select(bucket_column(F.col("key"), buckets).alias("bucket"), "key", "lp")
    found = stored(pieces.groupBy("bucket").cogroup(cold.groupBy("bucket")).applyInPandas(_gram_counter(hot, buckets, with_grams), GRAM_SCHEMA), f"katz-counts-{n}")
    levels = np.zeros(GOOD_TURING + 2, dtype=np.int64)
    for (data,) in found.where("levels is not null").select("levels").collect():  # GOOD_TURING + 2 numbers from each bucket
        levels += np.frombuffer(data, dtype=np.int64)
    factor = good_turing(dict(enumerate(levels.tolist())))
    by_bucket = found.where("contexts is not null").select("bucket", "contexts").groupBy("bucket")
    contexts = stored(by_bucket.applyInPandas(_context_values(factor), "key long, total long, whole double, free double"), f"katz-contexts-{n}")
    mark = int(hot.names[:1].view(np.int64)[0])
    near = contexts.where(F.col("key") == mark).unionByName(contexts.join(F.broadcast(lower.where(F.col("total") >= model.hot_count).select("key")), "key", "left_semi")).select("key", "whole", "free").toArrow()
    by_name = dict(zip(near["key"].to_pylist(), near["free"].to_pylist()))  # at most HOT, and the begin marks
    free = np.array([by_name.get(k, 0.0) for k in hot.names.view(np.int64).tolist()])
    begin = next((w for k, w in zip(near["key"].to_pylist(), near["whole"].to_pylist()) if k == mark), 0.0)
    values = contexts.select(bucket_column(F.col("key"), buckets).alias("bucket"), "key", "free")
    asks = found.where("asked is not null").select("bucket", "asked").groupBy("bucket").cogroup(values.groupBy("bucket")).applyInPandas(_asked, "chunk long, sums binary")
    by_chunk = found.where("chunk is not null").select("chunk", "info", "sums").unionByName(asks, allowMissingColumns=True).groupBy("chunk")
    sums = stored(by_chunk.applyInPandas(_gram_documents(factor, free), "doc_id long, digest long, total double"), f"katz-grams-{n}")
    table = None
    if with_grams:
        grams_ = found.where("grams is not null").select("grams").mapInPandas(_unpacked, "key long, context long, count long")
        discounts = F.element_at(F.array(*[F.lit(x) for x in factor]), (F.least(F.col("count"), F.lit(GOOD_TURING + 1)) + 1).cast("int"))
        valued = _attach(grams_.where(F.col("count") >= KEEP), contexts, "context", "whole", model.hot_count)
        table = stored(valued.select("key", F.col("count").alias("total"), (F.log10(discounts * F.col("count")) - F.col("whole")).alias("lp")), f"katz-table-{n}")
    discard(found)
    return sums, contexts, begin, table


def _attach(rows: DataFrame, table: DataFrame, on: str, name: str, hot_count: int) -> DataFrame:
    """rows with `name` of the table's row whose key is in column `on`; every row has one.

    Rows of the at most HOT frequent keys are resolved by a broadcast of that bound, so no key is a large group.
    """
    wanted = table.select(F.col("key").alias(on), name, "total")
    hot = wanted.where(F.col("total") >= hot_count).drop("total")
    cold = wanted.where(F.col("total") < hot_count).drop("total")
    first = rows.join(F.broadcast(hot), on, "left")
    return first.where(F.col(name).isNotNull()).unionByName(first.where(F.col(name).isNull()).drop(name).join(cold.hint("shuffle_hash"), on))


# --- scoring ---------------------------------------------------------------------------------------

def _ids(batch: pd.DataFrame) -> np.ndarray:
    return np.array([int(i) if isinstance(i, str) else NO_ID for i in batch["doc_id"].tolist()], dtype=np.int64)


SUMS = 3  # of values, of unigram log probabilities and of known words


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each wanted key is known, its values) in a sorted table."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=bool), np.zeros((len(wanted), SUMS))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    known = keys[at] == wanted
    return known, values[at] * known[:, None]


def _pieces(order: int, hot_keys: np.ndarray, hot_values: np.ndarray, buckets: int):
    """Map side: for each chunk of texts the sums of frequent n-grams, and one row with the other keys for each bucket that has some."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        chunk, part = 0, TaskContext.get().partitionId()
        held = {k: [] for k in ("id", "digest", "learn", "tokens", "sums", "key", "doc")}
        size = docs = 0

        def flush() -> pd.DataFrame:
            name = (part << 24) + chunk
            info = pickle.dumps({k: np.concatenate(held[k]) for k in ("id", "digest", "learn", "tokens", "sums")})
            key, doc = np.concatenate(held["key"]), np.concatenate(held["doc"])
            bucket = _bucket_of(key, buckets)
            by_bucket = np.argsort(bucket, kind="stable")
            rows = [(name % buckets, name, b"", b"", b"", info)]
            for own in np.split(by_bucket, np.flatnonzero(np.diff(bucket[by_bucket])) + 1):
                if len(own):
                    low = key[own] & LOW48
                    rows.append((int(bucket[own[0]]), name, (low & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), (low >> np.uint64(32)).astype(np.uint16).tobytes(), _narrow(np.diff(doc[own], prepend=0)), None))
            return pd.DataFrame(rows, columns=["bucket", "chunk", "low", "high", "gaps", "info"])

        for batch in batches:
            ids = _ids(batch)
            digest, learn = batch["digest"].to_numpy(dtype=np.int64), batch["learn"].to_numpy(dtype=bool)
            for first, n, words, doc in grams(batch["text"].tolist(), order):
                key = keys_of(words)[0]
                known, value = _found(hot_keys, hot_values, key)
                sums = np.stack([np.bincount(doc[known], weights=value[known, j], minlength=n) for j in range(SUMS)], axis=1).astype(np.float64)  # bincount of nothing is whole numbers
                here = slice(first, first + n)
                for k, x in (("id", ids[here]), ("digest", digest[here]), ("learn", learn[here]), ("tokens", np.bincount(doc, minlength=n)), ("sums", sums), ("key", key[~known]), ("doc", doc[~known] + docs)):
                    held[k].append(x)
                docs += n
                size += len(key)
                if size >= CHUNK_TOKENS:
                    yield flush()
                    held = {k: [] for k in held}
                    chunk, size, docs = chunk + 1, 0, 0
        if docs:
            yield flush()

    return split


def _evaluator(missing: np.ndarray):
    """Reduce side: the keys of one bucket against its part of the table; sums by text of each chunk."""

    def evaluate(pieces: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        keys = table["key"].to_numpy(dtype=np.int64).view(np.uint64) & LOW48
        order = np.argsort(keys)
        keys = keys[order]
        values = np.stack([table["value"].to_numpy(dtype=np.float64)[order], table["lp"].to_numpy(dtype=np.float64)[order], table["known"].to_numpy(dtype=np.float64)[order]], axis=1)
        out = []
        for row in pieces.itertuples(index=False):
            if row.info is not None:
                out.append((row.chunk, row.info, b"", b""))
                continue
            wanted = np.frombuffer(row.low, np.uint32).astype(np.uint64) | (np.frombuffer(row.high, np.uint16).astype(np.uint64) << np.uint64(32))
            doc = np.cumsum(_wide(row.gaps, len(wanted)))
            known, value = _found(keys, values, wanted)
            value[~known] = missing
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            out.append((row.chunk, None, doc[first].astype(np.int32).tobytes(), np.add.reduceat(value, first).tobytes()))
        return pd.DataFrame(out, columns=["chunk", "info", "docs", "sums"])

    return evaluate


def _documents(rows: pd.DataFrame) -> pd.DataFrame:
    """All sums of one chunk, one row for each text."""
    info = pickle.loads(next(x for x in rows["info"] if x is not None))
    sums = info["sums"]
    for docs, part in zip(rows["docs"], rows["sums"]):
        if docs:
            sums[np.frombuffer(docs, np.int32)] += np.frombuffer(part).reshape(-1, SUMS)
    ids = info["id"]
    return pd.DataFrame({
        "doc_id": pd.Series(ids, dtype="Int64").mask(ids == NO_ID), "digest": info["digest"], "learn": info["learn"], "n_tokens": info["tokens"].astype(np.int64),
        "total": sums[:, 0], "base": sums[:, 1], "known": np.rint(sums[:, 2]).astype(np.int64),
    })


def level_sums(rows: DataFrame, level: Level, order: int, model: Model, buckets: int) -> DataFrame:
    """(doc_id, digest, learn, n_tokens, total, base, known): the sums of one order over the n-grams of every row of rows(doc_id, digest, learn, text)."""
    hot = level.table.where(F.col("total") >= model.hot_count).select("key", "value", "lp", "known").toArrow()  # at most HOT rows
    keys = hot["key"].to_numpy().astype(np.int64).view(np.uint64)
    by_key = np.argsort(keys)
    values = np.stack([hot[x].to_numpy().astype(np.float64)[by_key] for x in ("value", "lp", "known")], axis=1)
    missing = np.array([model.unknown, model.unknown, 0.0]) if order == 1 else np.zeros(SUMS)
    pieces = rows.mapInPandas(_pieces(order, keys[by_key], values, buckets), "bucket int, chunk long, low binary, high binary, gaps binary, info binary")
    cold = level.table.where(F.col("total") < model.hot_count).select(bucket_column(F.col("key"), buckets).alias("bucket"), "key", "value", "lp", "known")
    sums = pieces.groupBy("bucket").cogroup(cold.groupBy("bucket")).applyInPandas(_evaluator(missing), "chunk long, info binary, docs binary, sums binary")
    found = sums.groupBy("chunk").applyInPandas(_documents, "doc_id long, digest long, learn boolean, n_tokens long, total double, base double, known long")
    return stored(found.withColumn("total", F.col("total") + F.lit(level.begin)), f"katz-sums-{order}")


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, learn, n_tokens, n_known, train_tokens, base_score, score) of docs(doc_id, text, learn)."""
    spark = docs.sparkSession
    buckets = max(12, input_partitions(spark, docs))
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("digest"), F.coalesce("learn", F.lit(False)).alias("learn"))
    model, words = word_model(rows)
    lower, below, wholes, changes = words, words, [], []
    for n in range(2, order + 1):
        sums, contexts, begin, table = gram_sums(rows, lower, n, model, buckets, n < order)
        if n > 2:
            discard(lower)
        changes.append(sums)
        wholes.append((contexts, begin))
        lower = table
    word = below.select("key", "total", "lp", F.when(F.col("count") > 0, 1.0).otherwise(0.0).alias("known"))
    word = word.join(wholes[0][0].select("key", "whole").hint("shuffle_hash"), "key", "left") if wholes else word.withColumn("whole", F.lit(0.0))
    levels = [Level(stored(word.select("key", "total", (F.col("lp") - F.coalesce("whole", F.lit(0.0))).alias("value"), "lp", "known"), "katz-values"), -wholes[0][1] if wholes else 0.0)]
    levels += [Level(c.select("key", "total", (-F.col("whole")).alias("value"), F.lit(0.0).alias("lp"), F.lit(0.0).alias("known")), -begin) for c, begin in wholes[1:]]
    discard(words, *[c for c, _ in wholes[:1]])
    out = level_sums(rows, levels[0], 1, model, buckets)
    for n, level in enumerate(levels[1:], 2):
        changes.append(level_sums(rows, level, n, model, buckets))
    discard(*[level.table for level in levels])
    key = [F.coalesce("doc_id", F.lit(0)).alias("id_key"), F.col("doc_id").isNull().alias("id_null"), "digest"]
    out = out.select("*", *key[:2])
    for change in changes:
        more = change.select(*key, F.col("total").alias("more")).dropDuplicates(["id_key", "id_null", "digest"])
        out = out.join(more, ["id_key", "id_null", "digest"]).withColumn("total", F.col("total") + F.col("more")).drop("more")
    return out.select("doc_id", "learn", "n_tokens", F.col("known").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("total").alias("score"))
