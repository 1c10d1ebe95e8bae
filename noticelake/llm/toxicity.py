"""Toxicity scores from a convolutional text classifier.

Every word is embedded as the sum of three rows of hashed tables (two independent hashes of the word
and one of its first bytes). Filters of several widths slide over the words, each keeps its maximum
over the whole text, and a logistic layer reads the maxima. Every labelled document is learnt from: one
network learns from all, and one for each of `FOLDS` parts from the others. The documents are dealt into
blocks of about `BLOCK_ROWS` rows or `BLOCK_BYTES` bytes, and these into at most `ROUNDS` rounds. In a round
each task trains one network on one block, from where the last round ended; what the blocks changed is
averaged row by row of the parameters, by the documents of the blocks that moved the row, so that a word
of few blocks moves as far as a frequent one. One block is plain training. What the networks of the parts
say of all documents they have not seen, counted in steps of 1 / `GRID`, gives, for each language told by
function words of the text, the threshold with the best F1; examples of other languages count with the
weight `OTHERS`, so a language with few examples leans on the rest. Scores are shifted so that every
language's threshold lies at `DECISION`.

Scoring is one Arrow-batched pass over the rows; texts are processed whole.

Defined cases: null, empty or wordless texts get the score of a text in which no filter fires; without
labels of both classes the score is the rate of the only class seen (0 with no labels at all);
labels that are neither 0 nor 1 are not learnt from; a document with both labels counts as toxic; of the
texts of a repeated doc_id the first in order is learnt from; ties of thresholds go to the middle one;
equal rows get equal scores; an empty table gives an empty result; other columns are carried whatever
their names, but columns named `score` and `predicted` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import discard, stored
from .textarrays import blocks, tokens

#: How the labelled documents are dealt for training; the changes of FAN blocks are added at a time, in slices of SLICE rows.
ROUNDS, BLOCK_ROWS, BLOCK_BYTES, FAN, SLICE = 4, 5000, 1 << 24, 32, 4096
DECISION = 0.3
ROWS, DIM, FILTERS, WIDTHS, PREFIX = 1 << 14, 12, 8, (1, 2, 3), 4
STEPS, BATCH, RATE, SEED = 400, 48, 0.01, 7
FOLDS, OTHERS, GRID = 4, 0.2, 256

#: Common function words of each language.
FUNCTION_WORDS = {
    "en": "the and of to in is that for it with as was on be are this by an",
    "fr": "le la les et des du un une en que qui dans pour est sur au pas avec",
    "de": "der die das und den von zu mit sich des auf nicht ein eine ist dem im",
    "es": "el los las y que del se por con una para no su al lo como es más",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]

_SLOTS = [(w, j) for w in WIDTHS for j in range(w)]


def _word_hashes(words: str) -> np.ndarray:
    _, buf, starts = next(blocks([words]))
    return tokens(buf, starts)[0]


_MARKS = [np.sort(_word_hashes(words)) for words in FUNCTION_WORDS.values()]


def _features(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, rows of the three tables for each word, doc bounds, language of each doc) by block."""
    for first, buf, starts in blocks(texts):
        word, bounds, head = tokens(buf, starts, prefix=PREFIX)
        rows = np.stack([word % np.uint64(ROWS), (word >> np.uint64(32)) % np.uint64(ROWS), head % np.uint64(ROWS)]).astype(np.int32)
        hits = np.zeros((len(_MARKS) + 1, len(bounds) - 1))
        for k, marks in enumerate(_MARKS):
            at = np.minimum(np.searchsorted(marks, word), len(marks) - 1)
            seen = np.concatenate([[0], np.cumsum(marks[at] == word)])
            hits[k] = seen[bounds[1:]] - seen[bounds[:-1]]
        hits[-1] = 0.5
        yield first, rows, bounds, hits.argmax(axis=0)


@dataclass
class Network:
    tables: np.ndarray  # (3, ROWS, DIM)
    filters: np.ndarray  # (DIM, len(_SLOTS), FILTERS)
    shift: np.ndarray  # (len(WIDTHS), FILTERS)
    out: np.ndarray  # (len(WIDTHS), FILTERS)
    bias: float
    thresholds: np.ndarray | None = None  # logit by language

    def projected(self) -> np.ndarray:
        """What each table row adds to each filter slot: (3, ROWS, slots * FILTERS)."""
        return (self.tables.reshape(-1, DIM) @ self.filters.reshape(DIM, -1)).reshape(3, ROWS, -1)

    def responses(self, flat: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Filter responses at every word, by width, from what its rows add to the slots; words beyond the text's end add nothing."""
        flat = flat.reshape(len(flat), len(_SLOTS), FILTERS)
        found, slot = [], 0
        for w in WIDTHS:
            total = flat[:, slot].copy()
            for j in range(1, w):
                total[:-j] += flat[j:, slot + j] * (np.arange(len(flat) - j) + j < ends[:-j])[:, None]
            found.append(total)
            slot += w
        return found

    def packed(self) -> np.ndarray:
        """All parameters as rows of DIM numbers."""
        rest = np.concatenate([self.filters.ravel(), self.shift.ravel(), self.out.ravel(), [self.bias]])
        return np.concatenate([self.tables.reshape(-1, DIM), np.pad(rest, (0, -len(rest) % DIM)).reshape(-1, DIM)]).astype(np.float32)

    @staticmethod
    def unpacked(rows: np.ndarray) -> Network:
        shapes = (DIM, len(_SLOTS), FILTERS), (len(WIDTHS), FILTERS), (len(WIDTHS), FILTERS)
        parts = np.split(rows[3 * ROWS :].ravel(), np.cumsum([np.prod(x) for x in shapes]))
        return Network(rows[: 3 * ROWS].reshape(3, ROWS, DIM).copy(), *[part.reshape(x).copy() for part, x in zip(parts, shapes)], float(parts[-1][0]))

    def logits(self, texts: list[str | None], projected: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scores, langs = np.full(len(texts), self.bias), np.full(len(texts), len(LANGUAGES) - 1)
        for first, rows, bounds, lang in _features(texts):
            langs[first : first + len(lang)] = lang
            filled = np.flatnonzero(bounds[1:] > bounds[:-1])
            if not len(filled):
                continue
            ends = np.repeat(bounds[1:], np.diff(bounds))
            for k, found in enumerate(self.responses(_summed(projected, rows), ends)):
                top = np.maximum.reduceat(found, bounds[filled])
                scores[first + filled] += np.maximum(top + self.shift[k], 0) @ self.out[k]
        return scores, langs

    def scored(self, texts: list[str | None], projected: np.ndarray) -> np.ndarray:
        logit, lang = self.logits(texts, projected)
        cut = 0.0 if self.thresholds is None else self.thresholds[lang]
        return 1 / (1 + np.exp(-np.clip(logit - cut + np.log(DECISION / (1 - DECISION)), -40, 40)))


def _summed(tables: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The sum of each word's rows of the three tables."""
    total = tables[0][rows[0]]
    total += tables[1][rows[1]]
    total += tables[2][rows[2]]
    return total


def initial(rng: np.random.Generator) -> Network:
    shape = (len(WIDTHS), FILTERS)
    return Network(rng.normal(0, 0.1, (3, ROWS, DIM)).astype(np.float32), rng.normal(0, 0.3, (DIM, len(_SLOTS), FILTERS)).astype(np.float32), np.zeros(shape, np.float32), np.abs(rng.normal(0, 0.5, shape)).astype(np.float32), -1.0)


def fit(net: Network, docs: list[np.ndarray], labels: np.ndarray, positive: float, steps: int, rng: np.random.Generator) -> None:
    """Train a network on texts given as table rows of their words, in `steps` batches or as many as hold every text once."""
    weight = np.where(labels == 1, positive, 1.0)
    filled = np.array([i for i, rows in enumerate(docs) if rows.shape[1]], dtype=np.int64)
    moments = {k: [np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))] for k in ("tables", "filters", "shift", "out")}
    bias_moment, queue = [0.0, 0.0], filled[:0]
    for step in range(1, max(steps, -(-len(filled) // BATCH)) + 1 if len(filled) else 1):
        if not len(queue) or len(queue) < min(BATCH, len(filled)):
            queue = np.concatenate([queue, rng.permutation(filled)])
        batch, queue = queue[:BATCH], queue[BATCH:]
        grads = _gradients(net, [docs[i] for i in batch], labels[batch], weight[batch])
        for name, (m, v) in moments.items():
            g = grads[name]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            getattr(net, name)[...] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
        g = grads["bias"]
        bias_moment = [0.9 * bias_moment[0] + 0.1 * g, 0.999 * bias_moment[1] + 0.001 * g * g]
        net.bias -= RATE * (bias_moment[0] / (1 - 0.9**step)) / (np.sqrt(bias_moment[1] / (1 - 0.999**step)) + 1e-7)


CHANGES = "run int, node int, slice int, moved binary, sums binary"


def _changes(run: int, node: int, moved: np.ndarray, sums: np.ndarray) -> pd.DataFrame:
    """Sums of changes with their weights, for the moved rows of the parameters, by slice."""
    cuts = np.flatnonzero(np.diff(moved // SLICE)) + 1
    rows = [(run, node, int(at[0]) // SLICE, at.astype(np.int32).tobytes(), own.astype(np.float32).tobytes()) for at, own in zip(np.split(moved, cuts), np.split(sums, cuts)) if len(at)]
    return pd.DataFrame(rows, columns=["run", "node", "slice", "moved", "sums"])


def _opened(moved: bytes, sums: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(moved, np.int32), np.frombuffer(sums, np.float32).reshape(-1, DIM + 1)


def _learner(nets: dict[int, np.ndarray], positive: dict[int, float], steps: int, turn: int):
    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        """One training on one block: what it changes."""
        rows = rows.sort_values(["fold", "text", "label"], kind="stable")
        run, node = int(rows["run"].iloc[0]), int(rows["node"].iloc[0])
        docs = [own[:, a:b] for _, own, bounds, _ in _features(rows["text"].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
        rng = np.random.default_rng(SEED + turn)
        net = initial(rng) if turn == 0 else Network.unpacked(nets[run])
        fit(net, docs, rows["label"].to_numpy(dtype=np.int64), positive[run], steps, rng)
        change = net.packed() - nets[run]
        moved = np.flatnonzero(change.any(axis=1))
        return _changes(run, node, moved, np.column_stack([change[moved] * len(rows), np.full(len(moved), len(rows))]))

    return learn


def _add(rows: pd.DataFrame) -> pd.DataFrame:
    """The changes of several blocks to one slice as those of one."""
    first = int(rows["slice"].iloc[0]) * SLICE
    total = np.zeros((SLICE, DIM + 1))
    for moved, sums in zip(rows["moved"], rows["sums"]):
        at, own = _opened(moved, sums)
        total[at - first] += own
    moved = np.flatnonzero(total[:, DIM])
    return _changes(int(rows["run"].iloc[0]), int(rows["node"].iloc[0]), moved + first, total[moved])


def _checker(nets: dict[int, np.ndarray]):
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What each part's network says of its own texts, counted."""
        of = {fold: Network.unpacked(rows) for fold, rows in nets.items()}
        projected = {fold: net.projected() for fold, net in of.items()}
        for batch in batches:
            for fold, own in batch.groupby("fold"):
                logit, lang = of[fold].logits(own["text"].tolist(), projected[fold])
                seen = pd.DataFrame({"lang": lang, "cell": np.rint(np.clip(logit, -40, 40) * GRID).astype(np.int64), "label": own["label"].to_numpy()})
                yield seen.groupby(["lang", "cell", "label"]).size().reset_index(name="n")

    return check


def train(rows: DataFrame) -> Network | float:
    """The calibrated network of all of rows(text, label, mix); a single class gives a constant score instead."""
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int"))
    seen = rows.groupBy("fold", "label").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()  # FOLDS * 2 rows at most
    if len({r["label"] for r in seen}) < 2:
        return float(next((r["label"] for r in seen), 0))
    count = np.zeros((FOLDS + 1, 2))  # the last run learns from all
    for r in seen:
        count[r["fold"], r["label"]] = r["n"]
    learnt = count.sum(axis=0) - count
    runs = [run for run in range(FOLDS + 1) if learnt[run].min() > 0]
    positive = {run: float(min(5.0, max(1.0, learnt[run, 0] / learnt[run, 1]))) for run in runs}
    blocks_ = max(-(-int(count.sum()) // BLOCK_ROWS), -(-sum(r["size"] for r in seen) // BLOCK_BYTES), 1)
    rounds = min(ROUNDS, blocks_)
    width = -(-blocks_ // rounds)
    nets = {run: initial(np.random.default_rng(SEED)).packed() for run in runs}
    for turn in range(rounds):
        own = rows.where(F.pmod("mix", F.lit(rounds)) == turn).withColumn("node", F.pmod(F.floor(F.col("mix") / rounds), F.lit(width)).cast("int"))
        own = own.select("text", "label", "node", "fold", F.explode(F.array(*map(F.lit, runs))).alias("run")).where("run <> fold")
        changes = own.groupBy("run", "node").applyInPandas(_learner(nets, positive, -(-STEPS // rounds), turn), CHANGES)
        nodes = width
        while nodes > 1:
            nodes = -(-nodes // FAN)
            changes = changes.withColumn("node", F.floor(F.col("node") / FAN).cast("int")).groupBy("run", "node", "slice").applyInPandas(_add, CHANGES)
        changes = stored(changes, "toxicity-changes")
        nets = {run: net.copy() for run, net in nets.items()}
        for r in changes.select("run", "moved", "sums").collect():  # one row of bounded size for each run and slice
            at, sums = _opened(r["moved"], r["sums"])
            nets[r["run"]][at] += sums[:, :DIM] / sums[:, DIM:]
        discard(changes)
    net = Network.unpacked(nets.pop(FOLDS))
    if nets:
        said = rows.where(F.col("fold").isin(list(nets))).select("text", "label", "fold").mapInPandas(_checker(nets), "lang int, cell long, label int, n long")
        said = said.groupBy("lang", "cell", "label").agg(F.sum("n").alias("n")).toPandas()  # at most 80 * GRID cells for each language and label
        if len(said):
            net.thresholds = _thresholds(said["cell"].to_numpy() / GRID, said["label"].to_numpy(), said["lang"].to_numpy(), said["n"].to_numpy())
    return net


def _gradients(net: Network, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> dict:
    rows = np.concatenate(docs, axis=1)
    bounds = np.concatenate([[0], np.cumsum([d.shape[1] for d in docs])])
    ends = np.repeat(bounds[1:], np.diff(bounds))
    words = _summed(net.tables, rows)
    responses = net.responses(words @ net.filters.reshape(DIM, -1), ends)
    tops = np.zeros((len(WIDTHS), len(docs), FILTERS), dtype=np.int64)
    best = np.zeros((len(WIDTHS), len(docs), FILTERS), dtype=np.float32)
    columns = np.arange(FILTERS)
    for k, found in enumerate(responses):
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            tops[k, i] = a + found[a:b].argmax(axis=0)
        best[k] = found[tops[k], columns[None, :]]
    active = np.maximum(best + net.shift[:, None, :], 0)
    logit = net.bias + np.einsum("kif,kf->i", active, net.out)
    error = ((1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y) * weight / len(docs)).astype(np.float32)
    inner = error[None, :, None] * net.out[:, None, :] * (active > 0)
    grads = {"bias": float(error.sum()), "out": np.einsum("i,kif->kf", error, active), "shift": inner.sum(axis=1), "tables": np.zeros_like(net.tables), "filters": np.zeros_like(net.filters)}
    grads["out"] += 1e-4 * net.out
    slot = 0
    for k, w in enumerate(WIDTHS):
        for j in range(w):
            at = tops[k] + j
            live = at < bounds[1:, None]
            at = np.minimum(at, len(ends) - 1)
            g = inner[k] * live  # (docs, FILTERS)
            grads["filters"][:, slot] = np.einsum("if,ifd->df", g, words[at])
            back = g[:, :, None] * net.filters[:, slot].T[None]  # (docs, FILTERS, DIM)
            for t in range(3):
                np.add.at(grads["tables"][t], rows[t][at].ravel(), back.reshape(-1, DIM))
            slot += 1
    return grads


def _thresholds(logit: np.ndarray, y: np.ndarray, lang: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """The cut with the best F1 for each language, examples of other languages weighing OTHERS; each row stands for `times` examples."""
    times = np.ones(len(y)) if times is None else times
    order = np.argsort(-logit, kind="stable")
    z, t, of, n = logit[order], y[order], lang[order], times[order]
    below = np.append(z[1:], z[-1] - 1)
    last = z != below  # equal logits are on one side of any cut
    out = np.zeros(len(LANGUAGES))
    for k in range(len(LANGUAGES)):
        weight = np.where(of == k, 1.0, OTHERS) * n
        f1 = 2 * np.cumsum(weight * t) / (np.cumsum(weight) + (weight * t).sum())
        f1[~last] = -1
        top = np.flatnonzero(f1 >= f1.max() - 1e-12)
        at = top[len(top) // 2]
        out[k] = (z[at] + below[at]) / 2
    return out


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every labelled document as (text, label, mix), mix being a hash by which rows are dealt."""
    marked = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    texts = docs.select("doc_id", "text").where("text is not null").join(marked, "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return stored(texts.select("text", "label", F.shiftrightunsigned(F.xxhash64("doc_id"), 12).alias("mix")), "toxicity-labelled")


def fitted(docs: DataFrame, labels: DataFrame) -> Network | float:
    rows = labelled(docs, labels)
    model = train(rows)
    discard(rows)
    return model


def score_column(model: Network | float, text: Column) -> Column:
    if isinstance(model, float):
        return F.lit(model)

    @F.pandas_udf("double")
    def toxicity_score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        projected = model.projected()
        for batch in batches:
            yield pd.Series(model.scored(batch.tolist(), projected))

    return toxicity_score(text)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with score and predicted; labels(doc_id, toxic) are what may be learnt from."""
    model = fitted(docs, labels)
    scored = docs.drop("score", "predicted").withColumn("score", score_column(model, F.col("text")))
    return scored.withColumn("predicted", (F.col("score") >= DECISION).cast("int"))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with their columns."""
    model = fitted(docs, labels)
    return docs.where(score_column(model, F.col("text")) < DECISION)
