"""Language identification by hierarchical discrimination.

A linear support vector machine first tells the language family, then one-versus-one machines tell
the languages inside that family. Features are the frequencies of hashed byte n-grams (one to four
bytes of the lower-cased letters, other characters as one blank), so a text's score is the mean of
the weights of its n-grams: texts of any length are read whole, block by block. The machines are
trained in numpy (squared hinge, accelerated gradient) on a bounded number of documents of each
language, so that rare languages are learnt beside common ones.

Defined cases: null texts and texts without letters get `und` and score 0; languages outside the
fixed family table form a family of their own; with one learned language that language is predicted;
with none every text is `und`; equal rows get equal results, and ties of votes go to the first language
by name; other columns are carried whatever their names, but columns named `lang_pred` and `score` are
replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import Shield
from .textarrays import blocks

#: Bounds of the documents that are collected for each language, and for all: with many languages each gets an equal part.
MAX_PER_LANGUAGE, MAX_SAMPLE = 700, 14000
PLACES = 1_000_003
BUCKETS, ORDERS = 1 << 13, (1, 2, 3, 4)
STEPS, RIDGE = 80, 1e-3
UNKNOWN = "und"

#: Language families by ISO 639-1 code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tt tk",
    "indo-aryan": "hi ur bn mr ne pa gu",
    "semitic": "ar he am mt",
    "sinitic": "zh",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTER = re.compile(r"[^\W\d_]")
_SPACED = np.arange(256, dtype=np.uint8)
_SPACED[:128] = 0x20
_SPACED[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)


def _grams(buf: np.ndarray) -> Iterator[np.ndarray]:
    """Hashed n-grams starting at every byte, for each order; runs of blanks count once."""
    code = buf.astype(np.uint32)
    packed = code.copy()
    for order in ORDERS:
        if order > 1:
            packed[: len(code) - order + 1] = (packed[: len(code) - order + 1] << np.uint32(8)) | code[order - 1 :]
        h = (packed[: max(0, len(code) - order + 1)] + np.uint32(order * 0x9E37)) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0xC2B2AE35)
        yield (h >> np.uint32(19)).astype(np.int32)


def _letters(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Only letters and single blanks; the texts' starts move along."""
    spaced = _SPACED[buf]
    keep = np.ones(len(spaced), dtype=bool)
    keep[1:] = (spaced[1:] != 0x20) | (spaced[:-1] != 0x20)
    keep[starts[:-1]] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    return spaced[keep], at[starts]


def frequencies(texts: list[str | None]) -> np.ndarray:
    """n-gram frequencies of a few texts, (texts, BUCKETS)."""
    out = np.zeros((len(texts), BUCKETS), dtype=np.float32)
    for first, raw, raw_starts in blocks(texts):
        buf, starts = _letters(raw, raw_starts)
        for h in _grams(buf):
            for i, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
                out[first + i] += np.bincount(h[a:b], minlength=BUCKETS)
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1)


def _machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss; x has a column of ones, y is -1 or 1."""
    each = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1], dtype=np.float32)
    v, momentum = w.copy(), 1.0
    power = np.ones(x.shape[1], dtype=np.float32)
    for _ in range(8):  # the largest curvature gives the step
        power = x.T @ (each * (x @ power))
        power /= max(1e-12, np.linalg.norm(power))
    lipschitz = 2 * float(power @ (x.T @ (each * (x @ power)))) * 1.2 + RIDGE
    for _ in range(STEPS):
        slack = np.maximum(0, 1 - y * (x @ v))
        grad = x.T @ (-2 * each * y * slack) + RIDGE * v
        moved = v - grad / lipschitz
        ahead = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        v = moved + (momentum - 1) / ahead * (moved - w)
        w, momentum = moved, ahead
    return w


@dataclass
class Discriminator:
    classes: list[str]
    family: np.ndarray  # family number of each class
    pairs: list[tuple[int, int, int]]  # (level, a, b): level -1 compares families a and b, else classes inside family `level`
    weights: np.ndarray  # (BUCKETS, machines)
    bias: np.ndarray

    def margins(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        total = np.zeros((len(texts), len(self.pairs)))
        grams = np.zeros(len(texts))
        for first, raw, raw_starts in blocks(texts):
            buf, starts = _letters(raw, raw_starts)
            here = slice(first, first + len(starts) - 1)
            for h in _grams(buf):
                upto = np.minimum(starts, len(h))
                filled = np.flatnonzero(upto[1:] > upto[:-1])
                if not len(filled):
                    continue
                grams[here] += np.diff(upto)
                for k in range(len(self.pairs)):
                    sums = np.add.reduceat(self.weights[k][h], upto[filled])
                    total[first + filled, k] += sums
        return total / np.maximum(grams, 1)[:, None] + self.bias, grams

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        margins, _ = self.margins(texts)
        prob = 1 / (1 + np.exp(-4 * np.clip(margins, -10, 10)))
        families = self.family.max() + 1
        votes = np.zeros((len(texts), families))
        inner = np.zeros((len(texts), len(self.classes)))
        for k, (level, a, b) in enumerate(self.pairs):
            target = votes if level < 0 else inner
            target[:, a] += prob[:, k]
            target[:, b] += 1 - prob[:, k]
        votes = votes / max(1, families * (families - 1) / 2) if families > 1 else votes + 1
        for f in range(families):
            own = np.flatnonzero(self.family == f)
            inner[:, own] = inner[:, own] / (len(own) * (len(own) - 1) / 2) if len(own) > 1 else 1.0
        family = votes.argmax(axis=1)  # the family is decided first
        inside = np.where(self.family[None, :] == family[:, None], inner, -1.0)
        best = inside.argmax(axis=1)
        rows = np.arange(len(texts))
        score = np.clip(votes[rows, family] * inside[rows, best], 0, 1)
        names = np.array(self.classes, dtype=object)[best]
        blank = np.array([t is None or not _LETTER.search(t) for t in texts], dtype=bool)
        names[blank], score[blank] = UNKNOWN, 0.0
        return names, score


def train(texts: list[str], langs: list[str]) -> Discriminator | None:
    classes = sorted(set(langs))
    if not classes:
        return None
    kinds = sorted({_FAMILY_OF.get(c, c) for c in classes})
    family = np.array([kinds.index(_FAMILY_OF.get(c, c)) for c in classes])
    y = np.array([classes.index(c) for c in langs])
    x = frequencies(texts)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-4
    x = np.concatenate([(x - mean) / scale / 30, np.ones((len(x), 1), dtype=np.float32)], axis=1).astype(np.float32)
    pairs = [(-1, a, b) for a, b in combinations(range(len(kinds)), 2)]
    pairs += [(f, a, b) for f in range(len(kinds)) for a, b in combinations(np.flatnonzero(family == f).tolist(), 2)]
    weights, bias = np.zeros((len(pairs), BUCKETS), dtype=np.float32), np.zeros(len(pairs))
    for k, (level, a, b) in enumerate(pairs):
        of = family[y] if level < 0 else y
        rows = (of == a) | (of == b)
        w = _machine(x[rows], np.where(of[rows] == a, 1.0, -1.0).astype(np.float32))
        weights[k] = w[:-1] / scale / 30
        bias[k] = w[-1] - weights[k] @ mean
    return Discriminator(classes, family, pairs, weights, bias)


def sample(docs: DataFrame) -> tuple[list[str], list[str]]:
    """At most MAX_PER_LANGUAGE documents of each language, chosen by the hash of doc_id before any text is collected.

    The languages are counted first, one row each; a cut of the hash then leaves little more than what is
    wanted of every language, so that no language, however common, is ranked whole.
    """
    known = docs.where("lang is not null and text is not null").select("lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(PLACES)).alias("place"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return [], []
    each = max(1, min(MAX_PER_LANGUAGE, MAX_SAMPLE // len(counts)))
    cuts = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, float(PLACES * (each + 6 * each**0.5 + 20) / n))])
    order = Window.partitionBy("lang").orderBy("place", F.xxhash64("text"))
    near = known.where(F.col("place") < F.element_at(cuts, F.col("lang"))).withColumn("nth", F.row_number().over(order))
    rows = near.where(F.col("nth") <= each).select("lang", "nth", "text").toPandas().sort_values(["lang", "nth"])
    return rows["text"].tolist(), rows["lang"].tolist()


def predict_column(model: Discriminator | None, text: Column) -> Column:
    if model is None:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    @F.pandas_udf("lang_pred string, score double")
    def language_of(texts: pd.Series) -> pd.DataFrame:
        names, score = model.predict(texts.tolist())
        return pd.DataFrame({"lang_pred": names, "score": score})

    return language_of(text)


def identify(docs: DataFrame, training: DataFrame) -> DataFrame:
    """docs with lang_pred and score, learnt from training(doc_id, text, lang)."""
    model, shield = train(*sample(training)), Shield(docs)
    found = shield.frame.withColumn("found", predict_column(model, shield["text"]))
    return found.select(*shield.restored(["lang_pred", "score"]), "found.lang_pred", "found.score")
