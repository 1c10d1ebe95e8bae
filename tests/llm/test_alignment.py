"""Alignment against a direct version with the vocabularies' own libraries."""

import collections
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from noticelake.llm import alignment, queries

FOLDER = "/root/testdata/sf0.001"


def direct(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte_of = lambda p: bytes([int(p[3:-1], 16)]) if len(p) == 6 and p.startswith("<0x") and p.endswith(">") else p.replace("▁", " ").encode()
    found = []
    for text in texts:
        if not text:
            found.append(None)
            continue
        a, b = tokenizer.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
        bytes_a = [bytes(letters[c] for c in tokenizer.id_to_token(i)) for i in a]
        bytes_b = [byte_of(model.id_to_piece(i)) for i in b]
        whole = (" " + text).encode()
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            found.append(None)
            continue
        spans = []
        for pieces in (bytes_a, bytes_b):
            at, side = 0, []
            for p in pieces:
                side.append((at, at + len(p)))
                at += len(p)
            spans.append(side)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, lo = [], 0
        for c in cuts:
            groups.append(([i for i, s in zip(a, spans[0]) if lo < s[1] <= c], [i for i, s in zip(b, spans[1]) if lo < s[1] <= c]))
            lo = c
        links, j = [], 0
        for i, (s, e) in zip(a, spans[0]):
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(b) and spans[1][k][0] < e:
                links.append((i, b[k]))
                k += 1
        found.append((a, b, groups, links))
    docs = collections.Counter(p for f in found if f for p in set(f[3]))
    best = collections.defaultdict(int)
    for (i, _), n in docs.items():
        best[i] = max(best[i], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = f
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(docs[p] == best[p[0]] for p in links), sum(docs[p] for p in links), hashlib.sha256(shown.encode()).hexdigest()))
    return out


def odd_texts():
    r = random.Random(4)
    letters = "ab é ß日本\U0001F600́ \n\t'1.x▁"
    texts = [None, "", " ", "a▁b", "\u0000", "<|endoftext|> <s> <0x41> <unk>", "é", "\U0001F600" * 5, "x" * 20000, "the same text", "the same text", "the same text", "ﬁ ① Ⅳ", "  two  spaces  "]
    return texts + ["".join(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(60)]


@pytest.mark.parametrize("hot", [0, 5, 1 << 19])
def test_equals_the_direct_version_on_odd_texts(spark, hot):
    texts = odd_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).withColumns({n: F.lit("clash") for n in ("key", "pair", "n_a", "pairs")})
    found = {r["doc_id"]: tuple(r)[1:] for r in alignment.align(docs, hot=hot).collect()}
    assert [found[i] for i in range(len(texts))] == direct(texts)


def test_query_equals_the_direct_version(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    found = {r["doc_id"]: tuple(r)[1:] for r in queries.op11_alignment(spark, FOLDER).collect()}
    assert [found[r["doc_id"]] for r in rows] == direct([r["text"] for r in rows])


def test_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "some text"), (None, "some text"), (1, None)], "doc_id long, text string")
    found = alignment.align(docs).collect()
    assert len(found) == 3 and [r["n_a"] for r in found if r["doc_id"] is None] == [2, 2]
    assert alignment.align(docs.limit(0)).count() == 0


def test_groups_name_tokens_and_bytes(spark):
    texts = [t for t in odd_texts() if t]
    found = alignment.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in found:
        a, b = [0, *r["a_ends"]], [0, *r["b_ends"]]
        shown = ";".join(",".join(map(str, r["a_ids"][a[i] : a[i + 1]])) + "|" + ",".join(map(str, r["b_ids"][b[i] : b[i + 1]])) for i in range(len(a) - 1))
        digest = direct([texts[r["doc_id"]]])[0][-1]
        assert digest == (hashlib.sha256(shown.encode()).hexdigest() if shown else "")
        assert not r["byte_ends"] or r["byte_ends"][-1] == len((" " + texts[r["doc_id"]]).encode())
