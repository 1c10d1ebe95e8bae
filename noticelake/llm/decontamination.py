"""Benchmark decontamination by latent semantic retrieval.

Benchmark items, cut into passages, form a TF-IDF matrix whose document frequencies are counted over
all documents. A distributed randomised SVD of that matrix gives a latent space; the rows are benchmark
passages because the leading directions of the corpus itself are spent on common words and would lose
the rare terms that identify an item. Windows of every document (four runs of eight words, moved by
one run) are projected into the space and compared with all passages by cosine; the space has as many
directions as its block has passages, so that no passage lies outside it. Windows that hold a run of
`SEED` words of a passage are candidates whatever their cosine, as the words around a short copy can
outweigh it. Candidates are settled on the words: the longest common subsequence of passage and
surrounding text, and whether the item's answer (its last sentence) is there, so that lightly
paraphrased copies are found and chance similarity is not. An item is found where one of its passages is.

Most windows need no projection. A copy keeps at least `LCS_WITH_ANSWER` of a passage's words, so it
can miss only the rest of them: of that many of the rarest words of the passage and `WITNESSES` more, it
holds at least `WITNESSES`. Where no stretch of twice the passage and a window holds so many, no window is looked at; that is
as far as the words around a candidate are read, so nothing that would be settled as a copy is passed over for its witnesses.

Items of fewer than `MIN_ITEM` words are too short for a subsequence to mean anything; they are found
where all their words follow each other in a text, by exact hashes of runs of words.

The benchmark is a query set: it is read in parts of about `PASSAGES_PER_PART` passages (or one longer
item), each searched against all documents in one pass, in latent spaces of at most
`PASSAGES_PER_BLOCK` passages of at most `PASSAGE` words; what tasks hold is bounded by a part.

Defined cases: null or empty documents and null or wordless items match nothing; texts of any length
are searched whole, block by block; equal rows get equal results; items with equal texts are all found;
items that repeat an item_id with another text count as one item with both texts, and the better overlap
is reported; an empty benchmark or table gives no matches; other columns are carried where documents
are returned, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textarrays import blocks, combine, shingles, tokens

PASSAGES_PER_PART, PASSAGES_PER_BLOCK = 1024, 256
RUN, RUNS = 8, 4
WINDOW = RUN * RUNS
PASSAGE, MIN_ITEM = 64, 8
SEED = MIN_ITEM
OVERSAMPLE = 16
COSINE = 0.4
#: A copy has so much of a passage in order, or a little less together with the item's answer.
LCS, LCS_WITH_ANSWER, ANSWER = 0.75, 0.55, 0.8
WITNESSES = 5
SLICE = 4096
BLOCK = 1 << 18

MATCH = "array<struct<item_id long, cosine double, lcs double, answer_found boolean>>"


def _words(text: str) -> np.ndarray:
    _, buf, starts = next(blocks([text]))
    return tokens(buf, starts)[0]


def _lookup(vocabulary: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Term numbers, len(vocabulary) for unknown words."""
    at = np.minimum(np.searchsorted(vocabulary, word), len(vocabulary) - 1)
    return np.where(vocabulary[at] == word, at, len(vocabulary)).astype(np.int32)


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many documents each term occurs, and the number of documents, over all rows."""
    size = len(vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n = np.zeros(size, dtype=np.int64), 0
        for batch in batches:
            n += len(batch)
            for _, buf, starts in blocks(batch["text"].tolist()):
                word, bounds = tokens(buf, starts)
                term = _lookup(vocabulary, word).astype(np.int64)
                doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                known = term < size
                once = np.unique(doc[known] * size + term[known])
                seen += np.bincount(once % size, minlength=size)
        parts = np.array_split(seen, range(SLICE, size, SLICE))
        yield pd.DataFrame({"slice": range(len(parts)), "n": [n] * len(parts), "sums": [p.tobytes() for p in parts]})

    rows = docs.select("text").mapInPandas(count, "slice int, n long, sums binary").groupBy("slice").applyInPandas(_summed(np.int64), "slice int, n long, sums binary").collect()  # one row for each SLICE terms
    rows.sort(key=lambda r: r["slice"])
    return np.concatenate([np.frombuffer(r["sums"], dtype=np.int64) for r in rows] or [np.zeros(size, dtype=np.int64)]), rows[0]["n"] if rows else 0


def _summed(kind: type):
    def total(rows: pd.DataFrame) -> pd.DataFrame:
        sums = sum(np.frombuffer(s, dtype=kind) for s in rows["sums"])
        return pd.DataFrame({"slice": rows["slice"].iloc[:1], "n": [int(rows["n"].sum())], "sums": [sums.tobytes()]})

    return total


def randomised_svd(passages: DataFrame, terms: int, rank: int, seed: int = 11) -> np.ndarray:
    """Right singular vectors (terms, rank) of the sparse rows passages(at array<int>, weight array<double>).

    Two passes over the rows: one power step of the Gaussian test matrix, which every task draws from
    the same seed, and the Gram matrix of the rows in its range. Partial sums of tasks are added by
    slices of terms.
    """
    width = min(terms, rank + OVERSAMPLE)

    def power(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        test = np.random.default_rng(seed).normal(size=(terms, width))
        total = np.zeros((terms, width))
        for batch in batches:
            for at, weight in zip(batch["at"], batch["weight"]):
                total[at] += np.outer(weight, weight @ test[at])
        parts = np.array_split(total, range(SLICE, terms, SLICE))
        yield pd.DataFrame({"slice": range(len(parts)), "n": [0] * len(parts), "sums": [p.tobytes() for p in parts]})

    schema = "slice int, n long, sums binary"
    rows = passages.mapInPandas(power, schema).groupBy("slice").applyInPandas(_summed(np.float64), schema).collect()  # bounded by a block
    rows.sort(key=lambda r: r["slice"])
    basis, _ = np.linalg.qr(np.concatenate([np.frombuffer(r["sums"]).reshape(-1, width) for r in rows]))

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((basis.shape[1], basis.shape[1]))
        for batch in batches:
            inside = np.stack([weight @ basis[at] for at, weight in zip(batch["at"], batch["weight"])])
            total += inside.T @ inside
        yield pd.DataFrame({"slice": [0], "n": [0], "sums": [total.tobytes()]})

    row = passages.mapInPandas(gram, schema).groupBy("slice").applyInPandas(_summed(np.float64), schema).first()
    values, vectors = np.linalg.eigh(np.frombuffer(row["sums"]).reshape(basis.shape[1], -1))
    keep = np.argsort(-values)[:rank]
    return basis @ vectors[:, keep[values[keep] > 1e-9 * max(values.max(), 1e-30)]]


def longest_common_subsequence(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, one bit for each word of the item."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | (1 << i)
    full = (1 << len(item)) - 1
    row = full
    for w in text.tolist():
        hit = row & masks.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


@dataclass
class Space:
    """The latent space of one block of passages, `first` being the number of its first passage."""

    first: int
    row: np.ndarray  # row of `latent` for each term of the part and for unknown words
    latent: np.ndarray  # (terms + 1, k): idf times the term's latent direction; the last row is zero
    passages: np.ndarray  # (passages, k), unit rows


@dataclass
class Index:
    """What the search needs of one part of the benchmark."""

    ids: list[int]
    answers: list[np.ndarray]
    pieces: list[np.ndarray]  # word hashes of each passage
    length: np.ndarray  # words of each passage
    owner: np.ndarray  # item of each passage
    vocabulary: np.ndarray
    energy: np.ndarray  # squared idf of each term and of unknown words
    spaces: list[Space]
    seeds: np.ndarray  # sorted hashes of all runs of SEED words of passages
    seed_passage: np.ndarray
    witness: np.ndarray  # passages that a term is a witness of, by term
    witness_at: np.ndarray  # bounds of each term in `witness`
    least: np.ndarray  # witnesses that a copy of the passage holds
    short: list[tuple[int, np.ndarray, np.ndarray]]  # number of words, sorted hashes of items, their numbers

    def search(self, texts: list[str | None]) -> list[list[dict]]:
        found: list[dict[int, dict]] = [{} for _ in texts]
        for first, buf, starts in blocks(texts, limit=BLOCK):
            word, bounds = tokens(buf, starts)
            if not len(word):
                continue
            term = _lookup(self.vocabulary, word)
            doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            for item, i in self._whole(word, term, doc):
                found[first + i][item] = {"item_id": self.ids[item], "cosine": 1.0, "lcs": 1.0, "answer_found": True}
            runs = -(-np.diff(bounds) // RUN)
            of = np.repeat(np.arange(len(runs)), runs)
            at = bounds[of] + (np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs)) * RUN
            live = self._live(term, doc, bounds, np.cumsum(runs) - runs)
            if len(live):
                for i, candidates in self._candidates(word, term, at, of, bounds, live):
                    self._settle(found[first + i], candidates, word, bounds[i], bounds[i + 1])
        return [[hits[k] for k in sorted(hits)] for hits in found]

    def _whole(self, word: np.ndarray, term: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, text of the block) where all words of a short item follow each other."""
        known = np.cumsum(np.concatenate([[0], term < len(self.vocabulary)]))
        for n, hashes, items in self.short:
            begin = np.flatnonzero(known[n:] - known[:-n] == n)
            begin = begin[doc[begin] == doc[begin + n - 1]]
            if len(begin):
                key = combine([word[begin + j] for j in range(n)])
                low, high = np.searchsorted(hashes, key), np.searchsorted(hashes, key, "right")
                for i in np.flatnonzero(high > low):
                    for k in range(low[i], high[i]):
                        yield int(items[k]), int(doc[begin[i]])

    def _live(self, term: np.ndarray, doc: np.ndarray, bounds: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Pairs (run, passage), as one sorted number, where the window of the run touches a stretch that holds enough witnesses of the passage."""
        counts = np.append(np.diff(self.witness_at), [0])  # unknown words are no witnesses
        n = counts[term]
        at = np.flatnonzero(n)
        n = n[at]
        passage = self.witness[np.repeat(self.witness_at[term[at]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        place = np.repeat(at, n)
        order = np.argsort(passage * len(term) + place)
        passage, place = passage[order], place[order]
        last = np.arange(len(passage)) + self.least[passage] - 1
        inside = last < len(passage)
        last = np.where(inside, last, 0)
        held = np.flatnonzero(inside & (passage[last] == passage) & (doc[place[last]] == doc[place]) & (place[last] - place <= 2 * self.length[passage] + WINDOW))
        of = doc[place[held]]
        low = base[of] + np.maximum(place[held] - WINDOW + 1 - bounds[of], 0) // RUN
        n = base[of] + (place[last[held]] - bounds[of]) // RUN + 1 - low
        run = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.unique(run * len(self.pieces) + np.repeat(passage[held], n))

    def _candidates(self, word: np.ndarray, term: np.ndarray, at: np.ndarray, of: np.ndarray, bounds: np.ndarray, live: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
        """(text of the block, [(passage, start of the window, cosine)]): live pairs that are near in the latent spaces or hold a seed."""
        windows = np.unique(live // len(self.pieces))
        end, none = np.append(at[1:], len(term)), len(at)
        # the runs of each window; `none` where its text has ended
        run = windows[:, None] + np.arange(RUNS)
        run = np.where((run < none) & (of[np.minimum(run, none - 1)] == of[windows][:, None]), run, none)
        mass = np.append(np.add.reduceat(self.energy[term], at), np.float32(0))
        norm = np.sqrt(np.maximum(mass[run].sum(axis=1), 1e-12))
        needed = np.unique(run[run < none])
        part = np.searchsorted(needed, run)
        places = at[needed][:, None] + np.arange(RUN)
        terms = np.where(places < end[needed][:, None], term[np.minimum(places, len(term) - 1)], len(self.vocabulary))
        seeds = self._seeded(word, term, at[windows], windows, bounds[of[windows] + 1])
        near, cosines = [], []
        for space in self.spaces:
            vector = np.zeros((len(needed) + 1, space.latent.shape[1]), dtype=np.float32)
            for a in range(0, len(needed), 1024):  # a bounded number of word vectors at once
                vector[a : a + 1024][: len(terms) - a] = space.latent[space.row[terms[a : a + 1024]]].sum(axis=1)
            own = seeds[(seeds % len(self.pieces) >= space.first) & (seeds % len(self.pieces) < space.first + len(space.passages))]
            for a in range(0, len(windows), 4096):
                total = sum(vector[part[a : a + 4096, j]] for j in range(RUNS))
                cosine = total @ space.passages.T / norm[a : a + 4096][:, None]
                hit = cosine >= COSINE
                of_part = np.searchsorted(windows[a : a + 4096], own // len(self.pieces))
                inside = (own // len(self.pieces) >= windows[a]) & (own // len(self.pieces) <= windows[a : a + 4096][-1])
                hit[of_part[inside], own[inside] % len(self.pieces) - space.first] = True
                i, p = np.nonzero(hit)
                near.append(windows[a + i] * len(self.pieces) + p + space.first)
                cosines.append(np.clip(cosine[i, p], 0.0, 1.0))
        near, cosines = np.concatenate(near), np.concatenate(cosines)
        kept = np.isin(near, live)
        run, passage = np.divmod(near[kept], len(self.pieces))
        order = np.lexsort((run, passage, of[run]))
        run, passage, cosines = run[order], passage[order], cosines[kept][order]
        for group in np.split(np.arange(len(run)), np.flatnonzero(np.diff(of[run])) + 1):
            if len(group):
                yield int(of[run[group[0]]]), list(zip(passage[group].tolist(), at[run[group]].tolist(), cosines[group].tolist()))

    def _seeded(self, word: np.ndarray, term: np.ndarray, at: np.ndarray, windows: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pairs (window, passage), as one number, where SEED words of the passage begin in the first run of the window."""
        starts, window = (at[:, None] + np.arange(RUN)).ravel(), np.repeat(windows, RUN)
        known = np.cumsum(np.concatenate([[0], term < len(self.vocabulary)]))
        fits = starts + SEED <= np.repeat(end, RUN)
        starts, window = starts[fits], window[fits]
        full = known[starts + SEED] - known[starts] == SEED
        starts, window = starts[full], window[full]
        if not len(starts):
            return np.zeros(0, dtype=np.int64)
        key = combine([word[starts + j] for j in range(SEED)])
        low, high = np.searchsorted(self.seeds, key), np.searchsorted(self.seeds, key, "right")
        n = high - low
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.unique(np.repeat(window, n) * len(self.pieces) + self.seed_passage[np.repeat(low, n) + nth])

    def _settle(self, hits: dict[int, dict], candidates: list[tuple[int, int, float]], word: np.ndarray, low: int, high: int) -> None:
        """Add the items that hold up on the words, each with its best cosine and overlap; candidates are ordered by passage and place."""
        current, matched = -1, -1
        for passage, at, cosine in candidates:
            if passage != current:
                current, matched = passage, -1
            item, words = int(self.owner[passage]), self.pieces[passage]
            if at < matched:  # inside the stretch that has just matched
                hits[item]["cosine"] = max(hits[item]["cosine"], cosine)
                continue
            stretch = word[max(low, at - len(words)) : min(high, at + WINDOW + len(words))]
            lcs = longest_common_subsequence(words, stretch) / len(words)
            if lcs < LCS_WITH_ANSWER:
                continue
            answer = self.answers[item]
            answered = longest_common_subsequence(answer, stretch) >= ANSWER * len(answer)
            if lcs >= LCS or answered:
                matched = at + len(words)
                kept = hits.setdefault(item, {"item_id": self.ids[item], "cosine": cosine, "lcs": lcs, "answer_found": answered})
                kept.update(cosine=max(kept["cosine"], cosine), lcs=max(kept["lcs"], lcs), answer_found=kept["answer_found"] or answered)


def _answer(text: str) -> np.ndarray:
    sentences = [s for s in re.split(r"(?<=[.?!])\s+", text.strip()) if s]
    words = _words(sentences[-1]) if sentences else _words(text)
    return words if len(words) >= 3 else _words(text)[-8:]


def _passages(words: np.ndarray) -> list[np.ndarray]:
    cuts = range(0, max(1, len(words) - PASSAGE // 2), PASSAGE // 2) if len(words) > PASSAGE else [0]
    return [words[a : a + PASSAGE] for a in cuts]


def build_index(docs: DataFrame, rows: list[tuple[int, str]]) -> Index | None:
    """The index of one part of the benchmark, rows (item_id, text); None where no item has words."""
    ids = sorted({i for i, _ in rows})
    number = {item: k for k, item in enumerate(ids)}
    texts = [(number[i], text, _words(text)) for i, text in rows]
    texts = [x for x in texts if len(x[2])]
    if not texts:
        return None
    vocabulary = np.unique(np.concatenate([words for _, _, words in texts]))
    counts, n = document_frequencies(docs, vocabulary)
    idf = np.log((n + 1) / np.maximum(counts, 1)) + 0.1
    answers, pieces, owner = [np.zeros(0, np.uint64)] * len(ids), [], []
    for item, text, words in texts:
        answers[item] = _answer(text)
        if len(words) >= MIN_ITEM:
            cut = _passages(words)
            pieces += cut
            owner += [item] * len(cut)
    least, pairs = [], []
    for k, words in enumerate(pieces):
        at = _lookup(vocabulary, words)
        kept = int(np.ceil(LCS_WITH_ANSWER * len(words) - 1e-9))
        least.append(min(WITNESSES, kept))
        rarest = np.argsort(counts[at], kind="stable")[: len(words) - kept + least[-1]]
        pairs.append(np.stack([np.unique(at[rarest]), np.full(len(np.unique(at[rarest])), k)]))
    term, passage = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), dtype=np.int64)
    order = np.argsort(term, kind="stable")
    seeds = [np.unique(shingles(words, SEED)) for words in pieces]
    seed = np.concatenate(seeds or [np.zeros(0, np.uint64)])
    seed_order = np.argsort(seed, kind="stable")
    short = {}
    for item, _, words in texts:
        if len(words) < MIN_ITEM:
            short.setdefault(len(words), []).append((combine([words[j : j + 1] for j in range(len(words))])[0], item))
    spaces = [_space(docs, pieces[a : a + PASSAGES_PER_BLOCK], a, vocabulary, idf) for a in range(0, len(pieces), PASSAGES_PER_BLOCK)]
    return Index(
        ids, answers, pieces, np.array([len(words) for words in pieces], dtype=np.int64), np.array(owner, dtype=np.int64), vocabulary,
        np.append(idf, np.median(idf)).astype(np.float32) ** 2, spaces,
        seed[seed_order], np.repeat(np.arange(len(seeds)), [len(x) for x in seeds])[seed_order],
        passage[order], np.searchsorted(term[order], np.arange(len(vocabulary) + 1)), np.array(least, dtype=np.int64),
        [(n, np.array([h for h, _ in sorted(of)], dtype=np.uint64), np.array([i for _, i in sorted(of)])) for n, of in sorted(short.items())],
    )


def _space(docs: DataFrame, pieces: list[np.ndarray], first: int, vocabulary: np.ndarray, idf: np.ndarray) -> Space:
    """The latent space of one block of passages, with the weights of the part's vocabulary."""
    terms = np.unique(_lookup(vocabulary, np.concatenate(pieces)))
    rows = []
    for words in pieces:
        at, tf = np.unique(np.searchsorted(terms, _lookup(vocabulary, words)), return_counts=True)
        rows.append((at.tolist(), (tf * idf[terms[at]]).tolist()))
    directions = randomised_svd(docs.sparkSession.createDataFrame(rows, "at array<int>, weight array<double>"), len(terms), len(rows))
    latent = np.stack([np.asarray(w) @ directions[np.asarray(at)] for at, w in rows])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    scaled = np.vstack([directions * idf[terms][:, None], np.zeros((1, directions.shape[1]))])
    row = np.full(len(vocabulary) + 1, len(terms), dtype=np.int32)
    row[terms] = np.arange(len(terms))
    return Space(first, row, scaled.astype(np.float32), latent.astype(np.float32))


def match_column(index: Index, text: Column) -> Column:
    @F.pandas_udf(MATCH)
    def matches(texts: pd.Series) -> pd.Series:
        return pd.Series(index.search(texts.tolist()))

    return matches(text)


def item_parts(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in parts of bounded size; rows that repeat an item are taken once, and rows of one item stay together."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    passages = items.agg(F.sum(F.floor(F.length("text") / (4 * PASSAGE)) + 1)).first()[0] or 0
    n = -(-passages // PASSAGES_PER_PART)
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) if n > 1 else items
        yield [(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()]


def _indexes(docs: DataFrame, benchmark: DataFrame) -> Iterator[Index]:
    for rows in item_parts(benchmark):
        index = build_index(docs, rows)
        if index is not None:
            yield index


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer_found): one row for each document row and benchmark item found in it."""
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, cosine double, lcs double, answer_found boolean")
    for index in _indexes(docs, benchmark):
        found = docs.select("doc_id", F.explode(match_column(index, F.col("text"))).alias("m")).select("doc_id", "m.*")
        out = out.unionByName(found)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark item is found, with their columns."""
    kept = docs
    for index in _indexes(docs, benchmark):
        kept = kept.where(F.size(match_column(index, F.col("text"))) == 0)
    return kept
