"""Packing: exact ids, whole coverage, near-equal windows, little padding, odd rows."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from noticelake.llm import packing, queries, vocabularies

FOLDER = "/root/testdata/sf0.001"


def encoded(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*e.ids, 1] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def padding(pieces, capacity=2048):
    total = collections.Counter()
    for r in pieces:
        total[r["sequence_id"]] += r["length"]
    assert max(total.values()) <= capacity
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in total.values()) / sum(total.values()), total


def check(pieces, ids):
    """Every id lies in one piece, checksums and offsets hold; ids by doc_id."""
    by_doc, by_window = collections.defaultdict(list), collections.defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append(r)
        by_window[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids)
    for doc, rows in by_doc.items():
        at = 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[doc]) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[doc][at : at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(ids[doc])
    for rows in by_window.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]


def test_query_packs_every_id(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    pieces = queries.op12_packing(spark, FOLDER).collect()
    check(pieces, dict(zip([r["doc_id"] for r in rows], encoded([r["text"] for r in rows]))))
    assert padding(pieces)[0] < 0.02


def test_odd_rows_and_special_strings(spark):
    texts = [None, "", " \n\t", "a<|endoftext|>b", "x" * 30000, "é\U0001F600 \u0000", "the same text " * 30, "word " * 9000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({n: F.lit("clash") for n in ("key", "n", "pool", "start", "sequence_id")})
    check(packing.pack(docs).collect(), dict(enumerate(encoded(texts))))
    assert packing.pack(docs.limit(0)).count() == 0
    same = spark.createDataFrame([(7, "ab cd")] * 50 + [(None, "ab cd")] * 50, "doc_id long, text string")
    assert packing.pack(same).agg(F.sum("length")).first()[0] == 100 * len(encoded(["ab cd"])[0])


@pytest.mark.parametrize("lengths", ["uniform", "equal", "long", "short"])
def test_windows_are_near_equal_and_full(lengths):
    r = random.Random(1)
    make = {"uniform": lambda: r.randint(1, 2047), "equal": lambda: 1100, "long": lambda: r.randint(1025, 1500), "short": lambda: r.randint(1, 40)}[lengths]
    rest = np.array([make() for _ in range(400)])
    pieces, window, k = packing._pool_pieces(rest, 2048)
    sums = np.bincount(window, weights=pieces[:, 2], minlength=k)
    assert sums.max() <= 2048 and sums.sum() == rest.sum()
    assert k * 2048 - rest.sum() <= 2048 * (2 + 0.02 * k)
    if k > 1:
        assert sums.max() - sums.min() <= 100


def test_differencing_equals_the_known_example():
    """8, 7, 6, 5, 4 in two: differencing ends with 16 and 14."""
    window, longest = packing.differenced(np.array([8, 7, 6, 5, 4]), 2)
    assert longest in (2, 16)
    sums = np.bincount(window, weights=[8, 7, 6, 5, 4])
    assert sorted(sums.tolist()) == [14, 16]


def test_sequences_hold_the_ids(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").limit(60)
    rows = docs.collect()
    want = collections.Counter()
    for ids in encoded([r["text"] for r in rows]):
        want.update(ids)
    found = packing.sequences(docs, pad_id=50256).collect()
    got = collections.Counter()
    for r in found:
        got.update(r["ids"][: r["n_ids"]])
        assert len(r["ids"]) in (2048, r["n_ids"]) and set(r["ids"][r["n_ids"] :]) <= {50256}
    assert got == want


def test_vocabulary_gives_the_ids_of_its_library():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    mine = vocabularies.byte_vocabulary()
    chars = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b {c}{c}1{c} {c}\n" for c in chars[i : i + 500]) for i in range(0, len(chars), 500)] + ["<|endoftext|> it's  \n\n 12"]
    for text, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert mine.plain_ids(text).tolist() == e.ids
