"""Guarded grouping against a direct version that looks at all pairs."""

import datetime
import random
import re

import pytest

from noticelake.operators.grouping import grouped

D = datetime.date
SCHEMA = "id string, first_seen date, scope string, years array<int>, keys array<string>, official string"


def direct(rows):
    """Buckets as keys appear, all pairs of a bucket, groups merged where every cross pair agrees."""
    rows = sorted(rows, key=lambda r: (r[1] is None, r[1] or D(1, 1, 1), r[0]))
    buckets = {}
    for n, r in enumerate(rows):
        for k in dict.fromkeys(r[4] or []):
            buckets.setdefault(k, []).append(n)
    group = list(range(len(rows)))

    def agree(a, b):
        a, b = rows[a], rows[b]
        if a[3] and b[3] and not set(a[3]) & set(b[3]):
            return False
        return (a[2] or "") == (b[2] or "") and not (a[5] and b[5] and a[5] != b[5])

    for members in buckets.values():
        for i, x in enumerate(members):
            for y in members[:i]:
                a, b = group[x], group[y]
                if a != b and all(agree(p, q) for p in range(len(rows)) if group[p] == a for q in range(len(rows)) if group[q] == b):
                    group = [a if g == b else g for g in group]
    out = {}
    for n, r in enumerate(rows):
        mine = [rows[p][0] for p in range(len(rows)) if group[p] == group[n]]
        out[r[0]] = mine[0], len(mine)
    return out


def rows_of(seed, n, keys, officials, scopes):
    r = random.Random(seed)
    span = [2024, 2025, 2026, 2027]
    out = []
    for i in range(n):
        years = r.sample(span, r.choice([0, 1, 1, 2, 3]))
        out.append((
            "%05x" % r.randrange(1 << 20) + str(i), r.choice([None, D(2026, 1, r.randint(1, 9))]), r.choice(scopes), years or r.choice([None, []]),
            r.choice([None, *([r.sample(keys, r.randint(0, 3))] * 6)]), r.choice(officials),
        ))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_equals_the_direct_version(spark, seed):
    rows = rows_of(seed, 70, [f"k{i}" for i in range(8 + 6 * (seed % 3))], [None, None, "x", "y"] if seed % 2 else [None, "x"], ["", "", None, "track b"])
    found = {r["id"]: (r["grp"], r["members"]) for r in grouped(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert found == direct(rows)


def test_equals_it_beside_a_hot_key(spark):
    """Most notices share one key and few facts; some are linked to others through keys of their own."""
    r = random.Random(9)
    rows = rows_of(8, 60, [f"k{i}" for i in range(20)], [None, "x", "y"], [""])
    rows += [(f"h{i}", D(2026, 2, r.randint(1, 20)), "", r.choice([[2026], [2026], [2025, 2026], []]), ["hot", *([f"k{r.randrange(20)}"] if i % 10 == 0 else [f"own{i}"])], r.choice([None, "x"])) for i in range(150)]
    found = {r["id"]: (r["grp"], r["members"]) for r in grouped(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == direct(rows)


def test_years_overlap_and_open_years(spark):
    day = D(2026, 1, 1)
    rows = [("a", day, "", [2024, 2025], ["k"], None), ("b", day, "", [2025, 2026], ["k"], None), ("c", day, "", [], ["z"], None), ("d", day, "", [2024, 2025], ["z"], None)]
    found = {r["id"]: (r["grp"], r["members"]) for r in grouped(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {"a": ("a", 2), "b": ("a", 2), "c": ("c", 2), "d": ("c", 2)}
    assert grouped(spark.createDataFrame([], re.sub("id string", "id long", SCHEMA, count=1))).count() == 0


def found_in(spark, rows, parts=1):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(parts) if parts > 1 else spark.createDataFrame(rows, SCHEMA).coalesce(1)
    return sorted(tuple(r) for r in grouped(frame).collect())


@pytest.mark.parametrize("beside", [[], [("z", D(2026, 1, 1), "", [2026], ["k", "other"], None), ("y", D(2026, 1, 2), "", [2026], ["other"], None)]])
def test_notices_of_one_instant_and_id_do_not_depend_on_how_they_arrive(spark, beside):
    """By facts, not by place: of two notices that an order by instant and id leaves open the same one is first."""
    day = D(2026, 2, 1)
    twins = [("a", day, "", [1998, 1997], ["k"], "0"), ("a", day, "", [1999, 1997], ["k"], "1")]
    rest = [("b", D(2026, 1, 1), "", [1997, 1995], ["k"], None), ("a", D(2026, 3, 1), "", [1999, 1997], ["k"], None), ("b", D(2026, 4, 1), "", [2001, 1999], ["k"], None)]
    assert found_in(spark, [*twins, *rest, *beside]) == found_in(spark, [*beside, *rest, *reversed(twins)])


@pytest.mark.parametrize("seed", range(3))
def test_keys_of_their_own_are_decided_as_they_stream_by(spark, seed, monkeypatch):
    """One key a notice, keys longer than a batch, some larger than a task holds, some beside notices of several keys."""
    from noticelake.operators import grouping

    monkeypatch.setattr(grouping, "HOT", 25)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        r = random.Random(seed)
        rows = [(i, s, c, y, r.choice([None, [], ["hot"], *[[f"k{r.randrange(12)}"]] * 9]), o) for i, s, c, y, _, o in rows_of(seed, 130, ["x", "y", "z"], [None, None, "x", "y"], ["", "", "b"])]
        for several in ([], [("several", D(2026, 1, 3), "", [2026], ["k1", "k2"], None)]):
            assert {r[0]: r[1:] for r in found_in(spark, rows + several, 3)} == direct(rows + several)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ids_keep_their_type(spark):
    schema = "id struct<a: long, b: timestamp>, first_seen date, scope string, years array<int>, keys array<string>, official string"
    at, day = datetime.datetime(2026, 1, 1, 2, 3, 4, 567890), D(2026, 1, 1)
    rows = [((1, at), day, "", [2026], ["k"], None), ((2, None), day, "", [], ["k", None, "k"], None), ((3, at), None, None, None, None, None)]
    assert sorted((tuple(r["id"]), tuple(r["grp"]), r["members"]) for r in grouped(spark.createDataFrame(rows, schema)).collect()) == [((1, at), (1, at), 2), ((2, None), (1, at), 2), ((3, at), (3, at), 1)]


def test_one_key_a_notice_takes_no_contraction(spark, monkeypatch):
    from noticelake.operators import grouping

    monkeypatch.setattr(grouping, "components", lambda edges: pytest.fail("no components to find"))
    day = D(2026, 1, 1)
    assert found_in(spark, [("a", day, "", [2026], ["k"], None), ("b", day, "", [2026], ["k"], None), ("c", day, "", [2026], ["l"], None)]) == [("a", "a", 2), ("b", "a", 2), ("c", "c", 1)]


@pytest.mark.parametrize("seed", range(3))
def test_a_key_has_one_turn_in_all_scopes(spark, seed):
    """Keys that notices of one scope have alone may come first, and turn the order, in another scope."""
    r = random.Random(seed)
    rows = [(i, s, c, y, r.sample([f"k{n}" for n in range(9)], 1 if c == "a" else r.choice([1, 2, 3])), o) for i, s, c, y, _, o in rows_of(seed + 20, 60, ["x", "y", "z"], [None, None, "x", "y"], ["a", "b"])]
    assert {r[0]: r[1:] for r in found_in(spark, rows)} == direct(rows)
