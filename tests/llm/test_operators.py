"""The text operators on small tables: odd rows, empty tables, and comparison with direct versions."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from noticelake.llm import decontamination, katz, language, licenses, mixing, neardup, pii, pivots, sharding, toxicity
from noticelake.operators.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(3)
WORDS = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(600)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def odd_rows():
    """Null and empty texts, no letters, a very long text and word, repeated rows, null keys."""
    return [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", "a", 3), (4, "... !!! 12", None, "b", 10),
        (5, prose(30000, 5), "en", "a", 1), (6, "x" * 70000, "en", None, 1), (7, prose(60, 7), "fr", "b", 1), (8, prose(60, 7), "fr", "b", 1),
        (9, prose(60, 9), "de", "c", 1), (9, prose(60, 9), "de", "c", 1), (None, prose(40, 11), "de", "c", 1), (12, "the \u0000 \U0001F600 é", "es", "c", 1),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with extra columns whose names clash with results."""
    names = ["size", "shard", "score", "predicted", "lang_pred", "spans", "copies", "class_id", "kept", "copy", "license_id", "learn", "target"]
    return spark.createDataFrame(odd_rows(), DOCS).select("*", *[F.lit("clash").alias(n) for n in names])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def labels_of(spark):
    return spark.createDataFrame([(5, 0), (7, 1), (9, 0), (1, 1), (12, None)], "doc_id long, toxic int")


def test_operators_take_odd_rows(spark, odd):
    n = len(odd_rows())
    bench = spark.createDataFrame([(1, prose(60, 9)), (2, None), (3, ""), (4, "too short")], "item_id long, text string")
    assert language.identify(odd, odd).count() == n
    assert toxicity.score(odd, labels_of(spark)).count() == n
    assert sharding.assign_shards(odd).count() == n
    assert pii.detect(odd).count() == n
    assert neardup.near_duplicates(odd).count() == n
    assert mixing.mix(odd).count() == n
    assert licenses.scan(odd).count() == n
    assert katz.score(odd.withColumn("learn", F.lit(True))).count() == n
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(odd, bench).collect()}
    assert found == {(9, 1)}
    assert decontamination.decontaminated(odd, bench).count() == n - 2


def test_operators_take_empty_tables(spark, none):
    empty_labels, empty_bench = labels_of(spark).limit(0), spark.createDataFrame([], "item_id long, text string")
    for out in (
        language.identify(none, none), toxicity.score(none, empty_labels), sharding.assign_shards(none), pii.detect(none), neardup.near_duplicates(none), mixing.mix(none),
        licenses.scan(none), katz.score(none.withColumn("learn", F.lit(True))), decontamination.contaminated(none, empty_bench), decontamination.decontaminated(none, empty_bench),
        pivots.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")),
    ):
        assert out.count() == 0


def test_language_is_learnt_by_family(spark):
    alphabets = {"en": "thndwr", "de": "schtzk", "fr": "qvxjlm", "es": "rrllob"}
    rows = []
    for k, (lang, letters) in enumerate(alphabets.items()):
        r = random.Random(k)
        rows += [(100 * k + i, " ".join("".join(r.choice(letters) + r.choice("aeio") for _ in range(3)) for _ in range(40)), lang, "s", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    held = F.col("doc_id") % 4 == 1
    found = language.identify(docs.where(held), docs.where(~held)).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.95 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_toxicity_learns_words_and_separates(spark):
    rows, labels = [], []
    for i in range(300):
        toxic = i % 3 == 0
        words = prose(50, i).split()
        if toxic:
            words[i % 50] = random.Random(i).choice(["zzbad", "zzvile"])
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, int(toxic)))
    docs, marked = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = toxicity.score(docs, marked.where("doc_id % 4 <> 1")).where("doc_id % 4 = 1").collect()
    assert np.mean([r["predicted"] == (r["doc_id"] % 3 == 0) for r in found]) >= 0.9


def test_shards_are_contiguous_and_balanced(spark):
    rows = [(i, "x" * random.Random(i).randint(0, 400), "en", "s", 1) for i in range(500)] + [(7, "x" * random.Random(7).randint(0, 400), "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    found = sorted(sharding.assign_shards(docs).collect(), key=lambda r: (r["doc_id"], r["slot"]))
    assert [r["shard"] for r in found] == sorted(r["shard"] for r in found)
    sizes = collections.Counter()
    for r in found:
        assert r["size"] == len(r["text"]) + 1 and r["text_crc32"] == zlib.crc32(r["text"].encode())
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 401
    for shard in sizes:
        assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in found)))


def direct_spans(text):
    out = []
    for kind, pattern in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
            if (kind == 1 and any(int(x) > 255 for x in m.group().split("."))) or (kind == 2 and not (12 <= len(digits) <= 19 and luhn)) or (kind == 3 and not 9 <= len(digits) <= 15):
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_plain_identifiers_equal_the_patterns():
    r = random.Random(1)
    for _ in range(8000):
        text = "".join(r.choice("a1.@-+ 0(9é2") for _ in range(r.randint(0, 40)))
        assert pii.identifiers(text) == direct_spans(text)


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("mail john.doe [at] example (dot) com now", "email", "john.doe [at] example (dot) com"),
        ("joe at mail dot example dot com", "email", "joe at mail dot example dot com"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("card 4111 1111 1111 11l1 x", "card", "4111 1111 1111 11l1"),
        ("ip one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"),
        ("write bosbt.42 at mail8.example.com soon", "email", "bosbt.42 at mail8.example.com"),
        ("joe @ example . com", "email", "joe @ example . com"),
        ("pay 4111.1111.1111.1111 now", "card", "4111.1111.1111.1111"),
        ("192[.]168[.]0[.]1", "ip", "192[.]168[.]0[.]1"),
        ("plus four nine one five one two three four five six seven", "phone", "plus four nine one five one two three four five six seven"),
    ],
)
def test_disguised_identifiers_map_to_the_source(text, kind, found):
    assert [(s["kind"], text[s["start"] : s["end"]]) for s in pii.spans(text) if not s["plain"]][:1] == [(kind, found)]


def test_clean_prose_has_no_identifiers():
    assert pii.spans("The thing at the end. One two or three dots at noon. Look at www.example.com or at 4.5.6, section 1.2 at home.") == []


def test_runs_of_digits_take_linear_time():
    assert pii.spans("1" * 200_000 + "@" * 1000 + "a" * 200_000) == []


def test_near_duplicates_equal_all_pairs(spark):
    texts = [prose(80, i) for i in range(30)]
    r = random.Random(2)
    for i in range(60):
        words = texts[i % 30].split()
        for _ in range(r.choice([0, 1, 2, 4])):
            words[r.randrange(80)] = r.choice(WORDS)
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    weights = neardup.Weights.of(docs)
    sets = [weights.one(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if neardup.weighted_jaccard(sets[i], sets[j]) >= neardup.SIMILARITY:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    found = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    assert found == {i: root(i) for i in range(len(texts))}
    assert neardup.deduplicated(docs).count() == len(set(found.values()))


def test_large_bucket_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", 8)
    base = prose(120, 1).split()
    texts = [" ".join(base[:i] + ["swap"] + base[i + 1 :]) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    assert {r["class_id"] for r in neardup.near_duplicates(docs).collect()} == {0}


def test_consistent_samples_estimate_weighted_similarity():
    r = np.random.default_rng(1)
    keys = np.sort(r.integers(1, 2**63, 3000).astype(np.uint64))
    a = keys[:2000], r.uniform(1, 2, 2000).astype(np.float32)
    b = keys[400:2400], np.concatenate([a[1][400:], r.uniform(1, 2, 400).astype(np.float32)])
    expected = neardup.weighted_jaccard(a, b) ** neardup.SAMPLES_PER_BAND
    same = np.mean([np.mean(np.equal(*neardup.band_keys([(x[0] ^ np.uint64(s), x[1]) for x in (a, b)]))) for s in range(1, 60)])
    assert abs(same - expected) < 0.06


def test_components_meet_over_many_rounds(spark, monkeypatch):
    from noticelake.operators import graph as module

    monkeypatch.setattr(module, "PART_EDGES", 20)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100) for i in range(1, 30)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(30)}


def test_pivot_index_finds_the_links(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(60, 16))
    rows = [(i, (centres[i % 60] + 0.12 * r.normal(size=16)).tolist(), int(i % 60) % 3) for i in range(240)]
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 1), (302, None, 0), (303, [0.0] * 16, 0), (304, [float("nan")] * 16, 0), (305, rows[0][1], None), (306, [1.0], 0)]
    found = {x["vec_id"]: x for x in pivots.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    true = collections.Counter()
    for i, u, p in rows:
        for j, v, q in rows:
            if i != j and p == q and p is not None and u and v and len(u) == len(v) and np.all(np.isfinite(u)) and np.any(u) and np.all(np.isfinite(v)) and np.any(v):
                true[i] += np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v) >= pivots.COSINE
    got = sum(x["n_links"] for x in found.values())
    assert len(found) == len(rows) and got >= 0.9 * sum(true.values()) and all(x["n_links"] <= true[i] for i, x in found.items())
    assert found[300]["component_id"] == found[0]["component_id"]
    assert all(found[i]["n_links"] == 0 and found[i]["kept"] for i in (302, 303, 304, 305, 306))


def test_katz_counts_exactly(spark):
    texts = {i: prose(30, i % 9) for i in range(40)} | {50: "never seen words", 51: None}
    docs = spark.createDataFrame([(i, t, i % 5 != 1) for i, t in texts.items()], "doc_id long, text string, learn boolean")
    found = {r["doc_id"]: r for r in katz.score(docs).collect()}
    tokens = {i: (t or "").lower().split() + ["</s>"] for i, t in texts.items()}
    counts = collections.Counter(w for i, t in tokens.items() if i % 5 != 1 for w in t)
    total, distinct = sum(counts.values()), len(counts)
    for i, t in tokens.items():
        assert found[i]["train_tokens"] == total and found[i]["n_tokens"] == len(t) and found[i]["n_known"] == sum(counts[w] > 0 for w in t)
        assert math.isclose(found[i]["base_score"], sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in t), abs_tol=1e-8)


def direct_katz(tokens, learn, order):
    """P(word, context) by recursion over plain counts."""
    counts = {n: collections.Counter() for n in range(1, order + 1)}
    for i, t in tokens.items():
        seq = ["<s>"] * (order - 1) + t
        for k in range(order - 1, len(seq) if learn[i] else 0):
            for n in counts:
                counts[n][tuple(seq[k - n + 1 : k + 1])] += 1
    total, distinct = sum(counts[1].values()), len(counts[1])
    factor = {n: katz.good_turing(collections.Counter(c.values())) for n, c in counts.items()}
    followers, of, known = collections.defaultdict(list), collections.Counter(), {}
    for n in range(2, order + 1):
        for gram, c in counts[n].items():
            of[gram[:-1]] += c
            if c >= katz.KEEP:
                followers[gram[:-1]].append(gram)

    def mass(gram):
        return factor[len(gram)][min(counts[len(gram)][gram], katz.GOOD_TURING + 1)] * counts[len(gram)][gram]

    def p(word, context):
        if not context:
            return (counts[1][(word,)] + 0.5) / (total + 0.5 * (distinct + 1))
        if context not in known:
            taken, whole = sum(map(mass, followers[context])), of[context]
            if taken and taken >= whole * (1 - 1e-12):
                whole = taken + 1
            known[context] = (whole, (1 - taken / whole) / (1 - sum(p(g[-1], context[1:]) for g in followers[context]))) if taken else (1, 1.0)
        whole, alpha = known[context]
        gram = (*context, word)
        return mass(gram) / whole if counts[len(gram)][gram] >= katz.KEEP else alpha * p(word, context[1:])

    return p, counts[1]


@pytest.mark.parametrize("order, hot", [(1, 20), (2, 20), (3, 20), (3, 1 << 17), (4, 20)])
def test_katz_equals_the_recursion(spark, monkeypatch, order, hot):
    monkeypatch.setattr(katz, "HOT", hot)  # 20: most n-grams are looked up in their buckets
    r = random.Random(4)
    texts = {i: " ".join(WORDS[int(40 * r.random() ** 2)] for _ in range(r.randint(0, 60))) for i in range(120)} | {500: "never Seen words", 501: None, 502: " ".join(WORDS[:3] * 20)}
    tokens, learn = {i: (t or "").lower().split() + ["</s>"] for i, t in texts.items()}, {i: i % 5 != 1 for i in texts}
    docs = spark.createDataFrame([(i, t, learn[i]) for i, t in texts.items()], "doc_id long, text string, learn boolean").repartition(3)
    found = {x["doc_id"]: x for x in katz.score(docs, order).collect()}
    p, words = direct_katz(tokens, learn, order)
    for i, t in tokens.items():
        seq = ["<s>"] * (order - 1) + t
        assert math.isclose(found[i]["score"], sum(math.log10(p(seq[k], tuple(seq[k - order + 1 : k]))) for k in range(order - 1, len(seq))), abs_tol=1e-9)
    if order > 1:
        for context in (("<s>",) * (order - 1), tuple(WORDS[: order - 1]), (WORDS[0],) * (order - 1), ("unseen",) * (order - 1)):
            assert math.isclose(sum(p(w, context) for (w,) in words) + p("unknown", context), 1, rel_tol=1e-9)


def test_katz_keeps_pairs_that_occur_once(spark):
    """Pairs seen once have their discounted share of the context, not what back-off leaves."""
    r = random.Random(9)
    texts = [" ".join(WORDS[int(40 * r.random() ** 2)] for _ in range(40)) for _ in range(60)] + ["u1 u2 u3 u4"]
    found = katz.score(spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, learn boolean")).where("doc_id = 60").first()
    pairs = collections.Counter(p for t in texts for p in zip(["<s>", *t.lower().split()], [*t.lower().split(), "</s>"]))
    once = katz.good_turing(collections.Counter(pairs.values()))[1]
    assert math.isclose(found["score"], 5 * math.log10(once) - math.log10(len(texts)), abs_tol=1e-9)


def test_katz_stores_no_row_for_each_pair(spark, monkeypatch):
    """Pairs are exchanged and kept packed, so that neither joins nor tables grow a row for each of them."""
    rows, put = [], katz.stored
    monkeypatch.setattr(katz, "stored", lambda df, label: (out := put(df, label), rows.append(out.count()))[0])
    texts = [prose(400, i) for i in range(60)]
    assert katz.score(spark.createDataFrame([(i, t, i % 5 != 1) for i, t in enumerate(texts)], "doc_id long, text string, learn boolean")).count() == 60
    pairs = {p for t in texts for p in zip(t.split(), t.split()[1:])}
    assert len(pairs) > 20_000 and sum(rows) < len(pairs) / 2


def test_katz_of_recurring_pairs_in_many_chunks(spark, monkeypatch):
    """n-grams that recur in a chunk are sent once: known ones, ones learnt from some of its texts, and ones never learnt."""
    monkeypatch.setattr(katz, "CHUNK_TOKENS", 300)
    monkeypatch.setattr(katz, "HOT", 20)
    r = random.Random(8)
    texts = {i: " ".join(WORDS[int(40 * r.random() ** 2)] for _ in range(40)) for i in range(50)}
    texts |= {60: "new1 new2 " * 40, 61: "new1 new2 " * 30, 66: "other words " * 40, 71: f"{WORDS[0]} {WORDS[39]} other " * 50, 72: f"{WORDS[1]} {WORDS[2]} " * 40}
    tokens, learn = {i: t.lower().split() + ["</s>"] for i, t in texts.items()}, {i: i % 5 != 1 for i in texts}
    docs = spark.createDataFrame([(i, t, learn[i]) for i, t in texts.items()], "doc_id long, text string, learn boolean").coalesce(1)
    for order in (2, 3):
        found = {x["doc_id"]: x["score"] for x in katz.score(docs, order).collect()}
        p, _ = direct_katz(tokens, learn, order)
        for i, t in tokens.items():
            seq = ["<s>"] * (order - 1) + t
            assert math.isclose(found[i], sum(math.log10(p(seq[k], tuple(seq[k - order + 1 : k]))) for k in range(order - 1, len(seq))), abs_tol=1e-9)


def test_discounts_of_irregular_counts():
    assert katz.good_turing({})[1:-1] == [r / (r + 1) for r in range(1, 6)]
    for levels in ({1: 5, 2: 9}, {2: 4}, {r: 7 for r in range(1, 7)}, {1: 900, 2: 300, 3: 140, 4: 90, 5: 60, 6: 45}):
        assert all(0 < x < 1 for x in katz.good_turing(levels)[1:-1])


def direct_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, out, active = 1.5 * sum(sizes.values()), {}, list(names)
    while active:
        share = left / sum(weight[s] for s in active)
        over = [s for s in active if share * weight[s] > 2 * sizes[s]]
        if not over:
            return out | {s: share * weight[s] for s in active}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            active.remove(s)
    return out


def test_mix_meets_the_targets(spark):
    r = random.Random(5)
    rows = [(i, prose(r.randint(0, 60), i), "en", r.choice(["a", "b", "c", "d", None, "a", "a"]), 1) for i in range(900)]
    docs = spark.createDataFrame(rows, DOCS)
    found = mixing.mix(docs).collect()
    sizes, taken = collections.Counter(), collections.Counter()
    for x in found:
        sizes[x["source"]] += x["size"]
        taken[x["source"]] += x["taken"]
        assert x["taken"] <= 2 * x["size"] and x["size"] == len((x["text"] or "").split())
    expected = direct_targets(sizes)
    for x in found:
        assert math.isclose(x["target"], expected[x["source"]], rel_tol=1e-9) and x["source_size"] == sizes[x["source"]]
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= 5
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((x["doc_id"], x["taken"]) for x in again) == sorted((x["doc_id"], x["taken"]) for x in found)
    assert mixing.mixed_documents(docs).count() == sum(x["copies"] for x in found)


def test_licences_survive_spelling_and_layout(spark):
    mit = dict((i, t) for i, t in licenses.TEXTS)["MIT"]
    other = "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("SUBLICENSE", "sub-licence").replace(". ", ".  ")
    rows = [(1, other), (2, mit + " and more"), (3, "Some text.\nReleased under the MIT Licence\nmore"), (4, None)]
    found = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1]["license_id"] == "MIT" and found[2]["license_id"] is None
    assert found[3]["notice_ids"] == "MIT" and found[3]["n_notices"] == 1
    assert found[4]["license_id"] is None and found[4]["text_digest"] is None


def test_benchmark_copies_are_found_and_clean_texts_left(spark):
    items = [(k, prose(40, 1000 + k) + ". " + prose(8, 2000 + k) + ".") for k in range(25)]
    rows = []
    for k in range(25):
        words = items[k][1].split()
        if k % 3 == 1:  # a light paraphrase: every eighth word changes
            words = [w if i % 8 else "altered" for i, w in enumerate(words)]
        rows.append((k, prose(150, k) + " " + " ".join(words) + " " + prose(90, 50 + k)))
    rows += [(100 + k, prose(300, 500 + k)) for k in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontamination.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(k, k) for k in range(25)}


def test_every_copy_of_a_large_benchmark_is_found(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(5))
    items = {k: " ".join(word() for _ in range(40 if k < 300 else 12)) for k in range(400)}
    common = " ".join(WORDS[:8])  # so short and frequent that the rarer words around it weigh most of the window
    rows = [(k, prose(60, k) + " " + items[k] + " " + prose(60, 900 + k)) for k in items]
    rows += [(1000 + k, common) for k in range(600)]
    rows.append((2000, " ".join(word() for _ in range(60)) + " " + " ".join(items[k].split()[-1] for k in range(30)) + " " + common + " " + " ".join(items[k].split()[0] for k in range(30))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontamination.contaminated(docs, spark.createDataFrame([*items.items(), (900, common)], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(k, k) for k in items] + [(1000 + k, 900) for k in range(600)] + [(2000, 900)]


def test_longest_common_subsequence():
    r = random.Random(8)
    for _ in range(200):
        a, b = ([r.randrange(6) for _ in range(r.randint(1, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontamination.longest_common_subsequence(np.array(a), np.array(b)) == table[-1][-1]


def test_retrieval_equals_all_items_against_all_texts(spark):
    """Every item against every text by longest common subsequence alone."""
    r = random.Random(21)
    items = {k: prose(r.randint(20, 60), 3000 + k) + ". " + prose(6, 4000 + k) + "." for k in range(30)} | {50: prose(170, 5000), 51: items_of_same_text(0), 52: items_of_same_text(0)}
    rows = []
    for k in range(120):
        words = items[k % 30].replace("\n", " ").split()
        share = r.choice([0.0, 0.1, 0.2, 0.3, 0.5, 0.7])
        words = [w if r.random() >= share else r.choice(WORDS) for w in words]
        if k % 7 == 0:
            words = words[: len(words) // 3]
        rows.append((k, prose(r.randint(0, 120), k) + " " + " ".join(words) + " " + prose(r.randint(0, 120), 600 + k)))
    rows += [(200, prose(90, 1) + " " + " ".join(items[50].split()[60:130]) + " " + prose(90, 2)), (201, items_of_same_text(0)), (202, None), (203, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontamination.contaminated(docs, spark.createDataFrame([*items.items()], "item_id long, text string")).collect()
    expected = set()
    for i, text in rows:
        words = decontamination._words(text or "")
        for k, item in items.items():
            answer = decontamination._answer(item)
            for piece in decontamination._passages(decontamination._words(item)):
                for at in range(0, max(1, len(words)), 8):
                    stretch = words[max(0, at - len(piece)) : at + 32 + len(piece)]
                    lcs = decontamination.longest_common_subsequence(piece, stretch) / len(piece)
                    if lcs >= 0.75 or (lcs >= 0.55 and decontamination.longest_common_subsequence(answer, stretch) >= 0.8 * len(answer)):
                        expected.add((i, k))
    assert {(x["doc_id"], x["item_id"]) for x in found} == expected and len(found) == len(expected) > 60
    assert {(200, 50), (201, 51), (201, 52)} <= expected


def items_of_same_text(k):
    return prose(40, 7000 + k)


def test_short_items_are_found_word_for_word(spark):
    items = [(1, "Seven plain words are in this item"), (2, "two zzwords"), (3, "zzsolo"), (4, "?!"), (5, None)]
    rows = [(1, prose(40, 1) + " seven plain, words are in this ITEM " + prose(9, 2)), (2, "seven plain words are not in this item"), (3, "a two zzwords zzsolo"), (4, "two"), (5, "zzwords two"), (6, None), (7, "seven plain words are"), (8, "in this item")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, bench).collect()} == {(1, 1), (3, 2), (3, 3)}
    assert {r["doc_id"] for r in decontamination.decontaminated(docs, bench).collect()} == {2, 4, 5, 6, 7, 8}


def test_guards_of_disguises_are_no_narrower_than_the_patterns():
    for text, found in (("plus one 415 five five five 2671", "plus one 415 five five five 2671"), ("call plus one four 1 five 555 two six 7 one.", "plus one four 1 five 555 two six 7 one"), ("write bosbt.42 at mail8.EXAMPLE.COM soon", "bosbt.42 at mail8.EXAMPLE.COM")):
        assert [text[s["start"] : s["end"]] for s in pii.spans(text) if not s["plain"]] == [found]


def test_thresholds_act_by_language():
    logit = np.array([3.0, 2.0, 1.0, 0.0, 9.0, 8.0, 7.0, 6.0])
    y, lang = np.array([1, 1, 0, 0, 1, 1, 0, 0]), np.array([0] * 4 + [1] * 4)
    cuts = toxicity._thresholds(logit, y, lang)
    assert 1.0 < cuts[0] <= 2.0 and 7.0 < cuts[1] <= 8.0


def test_toxicity_of_a_few_hundred_labels(spark):
    """The same rules at every size: at sf0.01 some 300 labels are learnt from."""
    folder = "/root/testdata/sf0.01"
    from noticelake.llm import queries

    scores = queries.op2_toxicity(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("toxic in (0, 1)").select("predicted", "toxic").collect()
    hits = sum(r["predicted"] and r["toxic"] for r in scores)
    assert 2 * hits / (sum(r["predicted"] for r in scores) + sum(r["toxic"] for r in scores)) >= 0.7


def test_every_labelled_document_is_learnt_from(spark):
    """The toxic documents beyond the 2,000 with the lowest hashes are the only ones with their word."""
    docs = spark.range(7200).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("toxic"), F.xxhash64("id").alias("hash")).orderBy("hash").collect()
    later = {r["doc_id"] for r in [r for r in docs if r["toxic"]][2000:]}
    rows = [(r["doc_id"], prose(12, r["doc_id"]) + (" zzlate" if r["doc_id"] in later else " zzbad" if r["toxic"] else "")) for r in docs] + [(10000 + i, prose(12, 10000 + i) + " zzlate" * (i % 2)) for i in range(200)]
    marked = spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in docs], "doc_id long, toxic int")
    found = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), marked).where("doc_id >= 10000").collect()
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in found]) >= 0.95


def test_changes_of_blocks_are_averaged_over_those_that_move_a_row():
    parts = [(np.array([0, 5]), 2.0, 10), (np.array([5, toxicity.SLICE + 1]), 4.0, 30)]
    rows = pd.concat([toxicity._changes(1, k, moved, np.column_stack([np.full((len(moved), toxicity.DIM), x * n), np.full(len(moved), n)])) for k, (moved, x, n) in enumerate(parts)])
    moved, sums = toxicity._opened(*toxicity._add(rows[rows["slice"] == 0]).loc[0, ["moved", "sums"]])
    assert moved.tolist() == [0, 5] and np.allclose((sums[:, :-1] / sums[:, -1:])[:, 0], [2.0, (20 + 120) / 40])
    assert rows["slice"].tolist() == [0, 0, 1]


def test_counted_logits_give_the_thresholds_of_the_rows():
    r = np.random.default_rng(3)
    cell, y, lang = r.integers(-50, 50, 400), r.integers(0, 2, 400), r.integers(0, 5, 400)
    few, times = np.unique(np.stack([cell, y, lang]), axis=1, return_counts=True)
    assert np.allclose(toxicity._thresholds(few[0] / toxicity.GRID, few[1], few[2], times), toxicity._thresholds(cell / toxicity.GRID, y, lang))


def test_rare_languages_are_learnt_beside_common_ones(spark, monkeypatch):
    monkeypatch.setattr(language, "MAX_PER_LANGUAGE", 30)
    rows = [(i, "text", f"l{i % 22}") for i in range(6600)] + [(9000 + i, "text", f"r{i % 3}") for i in range(90)]
    _, langs = language.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(collections.Counter(langs).values()) == {30} and len(set(langs)) == 25


def test_every_name_can_be_a_callers(spark):
    """Names that operators use inside are carried, unless a result replaces them."""
    rows = [(i, prose(30, i % 7), "en" if i % 2 else "fr", "ab"[i % 2], 1) for i in range(12)]
    inner = ["found", "copy", "id_key", "id_null", "source_key", "source_null", "mix_key", "slice", "rank_before", "each", "extra", "known_digest", "known_lines", "ids", "canonical", "line", "digest", "rows", "place", "part", "_0", "_1", "lam", "rate", "of", "docs", "bucket", "chunk", "nth", "fold", "label"]
    docs = spark.createDataFrame(rows, DOCS).select("*", *[F.concat(F.lit("mine-"), F.col("doc_id")).alias(n) for n in inner])
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, "nothing of this is there at all now")], "item_id long, text string")
    for out in (
        language.identify(docs, docs), toxicity.score(docs, labels), toxicity.clean_documents(docs, labels.where("toxic = 0")), sharding.assign_shards(docs), pii.detect(docs), mixing.mix(docs), mixing.mixed_documents(docs),
        licenses.scan(docs), decontamination.decontaminated(docs, bench), neardup.deduplicated(docs),
    ):
        assert set(inner) <= set(out.columns)
        found = out.collect()
        assert found and all(r[n] == f"mine-{r['doc_id']}" for r in found for n in inner)


def test_repeated_ids_with_different_texts(spark):
    a, b, c = prose(60, 901), prose(60, 902), prose(60, 903)
    rows = [(3, b), (9, a), (9, b), (12, a), (12, a), (None, a), (None, a), (20, c), (20, c), (20, c + " tail"), (21, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = collections.Counter((r["doc_id"], r["text"]) for r in neardup.deduplicated(docs).collect())
    assert {k: n for k, n in kept.items() if k[0] != 20} == {(3, b): 1, (9, a): 1, (None, a): 2, (21, ""): 1}
    assert sum(n for k, n in kept.items() if k[0] == 20) == 1
    assert collections.Counter((r["doc_id"], r["class_id"]) for r in neardup.near_duplicates(docs).collect()) == {(3, 3): 1, (9, 9): 1, (9, 3): 1, (12, 9): 2, (None, None): 2, (20, 20): 3, (21, 21): 1}


@pytest.mark.parametrize("block", [4, 128])
def test_near_duplicates_of_many_texts_against_every_hundredth(spark, monkeypatch, block):
    """Queries: ids divisible by 100, against all rows by weighted Jaccard; linked pairs are in one class, and classes hold nothing unlinked."""
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", block)
    r = random.Random(31)
    texts = []
    for i in range(1500):
        if i % 3 and texts:
            words = texts[r.randrange(max(0, i - 40), i)].split()
            for _ in range(r.choice([1, 1, 2, 3])):
                words[r.randrange(len(words))] = r.choice(WORDS)
            texts.append(" ".join(words))
        else:
            texts.append(prose(r.randint(40, 160), 10_000 + i))
    base = prose(100, 77).split()
    texts += [" ".join(base[:k] + ["swap"] + base[k + 1 :]) for k in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {x["doc_id"]: x["class_id"] for x in neardup.near_duplicates(docs).collect()}
    weights = neardup.Weights.of(docs)
    sets = [weights.one(t) for t in texts]
    linked = hits = 0
    for i in range(0, len(texts), 100):
        for j in range(len(texts)):
            if i != j and neardup.weighted_jaccard(sets[i], sets[j]) >= neardup.SIMILARITY:
                linked += 1
                hits += found[i] == found[j]
    print("links", linked, "recall", hits / linked)
    assert linked >= 10 and hits >= 0.95 * linked
    members = collections.defaultdict(list)
    for i, k in found.items():
        members[k].append(i)
    for k, own in members.items():
        reached, open_ = {own[0]}, [own[0]]
        while open_:
            i = open_.pop()
            for j in own:
                if j not in reached and neardup.weighted_jaccard(sets[i], sets[j]) >= neardup.SIMILARITY:
                    reached.add(j)
                    open_.append(j)
        assert reached == set(own)


def test_pivot_recall_where_the_index_prunes(spark):
    """Clustered vectors of 64 dimensions, three labels of unequal size; queries are the ids divisible by 100."""
    r = np.random.default_rng(9)
    centres = r.normal(size=(900, 64))
    label = np.array([0 if k % 3 else 1 + k % 2 for k in range(900)])
    at = r.integers(0, 900, 9000)
    vectors = centres[at] + r.uniform(0.15, 0.4, (9000, 1)) * r.normal(size=(9000, 64))
    rows = [(i, vectors[i].tolist(), int(label[at[i]])) for i in range(9000)]
    found = {x["vec_id"]: x for x in pivots.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    got = true = 0
    for i in range(0, 9000, 100):
        n = int(((unit @ unit[i] >= pivots.COSINE) & (label[at] == label[at[i]])).sum()) - 1
        assert found[i]["n_links"] <= n
        got, true = got + found[i]["n_links"], true + n
    print("links", true, "recall", got / true)
    assert true > 100 and got >= 0.9 * true


def test_vectors_of_extreme_length_and_shared_ids(spark):
    rows = [(1, [1e-200, 0.0], 0), (2, [2e-200, 0.0], 0), (3, [1e200, 1e200], 0), (4, [2e200, 2e200], 0), (5, [0.0, 1.0], 0), (5, [0.0, -1.0], 0), (6, [0.0, 1.0], 0), (7, [0.0, -2.0], 0)]
    found = collections.Counter((x["vec_id"], x["n_links"], x["component_id"], x["kept"]) for x in pivots.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert found == {(1, 1, 1, True): 1, (2, 1, 1, False): 1, (3, 1, 3, True): 1, (4, 1, 3, False): 1, (5, 1, 5, True): 2, (6, 1, 5, False): 1, (7, 1, 5, False): 1}


def test_whole_licences_by_digest_alone(spark):
    import pathlib

    long_text = "Some Licence of Ours\n\n  Version 7\n" + "\n".join(prose(12, k) for k in range(300))
    known = [("OURS-7", licenses.known_digests(spark, [("x", long_text)]).first()["digest"])]
    other = "(c) 2021 Them\n" + long_text.upper().replace("LICENCE", "license").replace("VERSION 7", "v7")
    rows = [(1, other), (2, long_text + " more"), (3, "Copyright 2020 A. SPDX-License-Identifier: MIT"), (4, "Two names."), (5, "two; NAMES\nand\nTwo names")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in licenses.scan(docs, [("B", "same"), ("A", "Same!")], [("N2", "Two names"), ("N1", "two names")], known).collect()}
    assert found[1]["license_id"] == "OURS-7" and found[2]["license_id"] is None
    assert found[3]["text_digest"] is not None and found[4]["notice_ids"] == "N1,N2" and found[5]["n_notices"] == 2
    assert licenses.scan(spark.createDataFrame([(1, "SAME")], "doc_id long, text string"), [("B", "same"), ("A", "Same!")]).first()["license_id"] == "A"
    assert licenses.scan(docs, [], [], []).count() == 5
    folder = pathlib.Path("/usr/share/common-licenses")  # public texts, where the system carries them
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = [(name, (folder / name).read_text(encoding="utf-8")) for name in names if (folder / name).exists()]
    if texts:
        assert {r["name"]: r["license_id"] for r in licenses.scan(spark.createDataFrame(texts, "name string, text string")).collect()} == {n: names[n] for n, _ in texts}


def test_mix_without_solution_raises(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_STEPS", 1)
    docs = spark.createDataFrame([(i, prose(5 + i, i), "ab"[i % 2]) for i in range(20)], "doc_id long, text string, source string")
    with pytest.raises(RuntimeError):
        mixing.mix(docs).collect()
