"""The Merkle manifest against a direct version: odd rows, hot groups, several fanouts and depths, and altered rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from noticelake.llm import merkle, queries

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def reduced(nodes, fanout):
    """Root, and for each node its siblings and the way to fold it."""
    ways = [[] for _ in nodes]
    at, level = list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        for i, place in enumerate(at):
            run, mine = runs[place // fanout], place % fanout
            ways[i].append((run[:mine], run[mine + 1 :]))
        at, level = [a // fanout for a in at], [sha(r) for r in runs]
    return level[0], ways


def direct(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    lower = {}
    for lang in order:
        members = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        lower[lang] = members, *reduced([leaf(r) for r in members], fanout)
    root, upper = reduced([lower[k][1] for k in order], fanout)
    out = []
    for k, lang in enumerate(order):
        members, subroot, ways = lower[lang]
        for r, way in zip(members, ways):
            whole = way + upper[k]
            node = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                node = leaf((*r[:3], r[3] + 1, r[4]))
            for left, right in whole:
                node = sha([*left, node, *right])
            out.append((r[0], leaf(r), subroot, root, sha(x for left, right in whole for x in left + right), node, node == root))
    return sorted(out, key=repr)


def odd_rows(n):
    r = random.Random(n)
    rows = [(i, r.choice(["a", None]), r.choice(["en", "en", "en", "é", "", None]), r.choice([None, i]), r.choice([None, "", "x" * r.randint(0, 50), "é\U0001F600"])) for i in range(n)]
    rows += [(3, "a", "one", 1, "alone"), (None, "a", "en", 1, "no id"), (None, "a", "en", 1, "no id too")] + [(9, "a", "en", 5, "copy")] * 40
    return rows


@pytest.mark.parametrize("fanout, levels, n", [(2, 2, 150), (3, 2, 100), (2, 8, 300), (5, 1, 60), (2, 3, 0)])
def test_equals_the_direct_version(spark, fanout, levels, n):
    rows = odd_rows(n)
    docs = spark.createDataFrame(rows, DOCS).repartition(3).withColumn("root", F.lit("clash")).withColumn("place", F.lit("clash"))
    changed = F.when(queries.held_out(7, 0), F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    fields = [changed if f == "n_chars" else F.col(f) for f in merkle.FIELDS]
    found = merkle.manifest(merkle.document_leaves(docs, fields), fanout, levels)
    got = [(r["order"], r["leaf"], r["subroot"], r["root"], sha(r["siblings"]), r["folded"], r["folded"] == r["root"]) for r in found.collect()]
    assert sorted(got, key=repr) == direct(rows, fanout)


def test_one_row_and_none(spark):
    one = [(5, "a", "en", 1, "text")]
    assert [tuple(r) for r in merkle.verified(spark.createDataFrame(one, DOCS), F.lit(False)).collect()] == [(5, leaf(one[0]), leaf(one[0]), leaf(one[0]), sha([]), leaf(one[0]), True)]
    assert merkle.verified(spark.createDataFrame([], DOCS), F.lit(False)).count() == 0


def test_query_equals_the_direct_version(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select(*merkle.FIELDS).collect()]
    found = sorted((tuple(r) for r in queries.op13_merkle(spark, folder).collect()), key=repr)
    assert found == direct(rows, 2)
    assert {r[-1] for r in found} == {True, False}
