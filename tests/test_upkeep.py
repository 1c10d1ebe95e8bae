"""Corrections and refresh plans against direct versions."""

import hashlib
import json
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from noticelake.plans import corrections as C
from noticelake.plans.refresh import deferred, refresh_plan

ITEM = "id string, url string, detail_checked_at string, registration_start string, deadline string, registration_start_time string, deadline_time string, registration_ambiguous boolean, registration_time_ambiguous boolean, date_status string, date_note string, date_evidence string, date_source_url string"
FIELDS = ("registration_start", "deadline", "registration_start_time", "deadline_time")
NOW = "2026-09-22T10:00:00+09:00"


def item(id_, url="https://x.org/a", start="2026-09-01", end="2026-09-30", start_time=None, end_time="18:00", checked="2026-09-21", status="confirmed"):
    return id_, url, checked, start, end, start_time, end_time, True, None, status, None, "line", url


def entry(place, fields, url="https://x.org/a", evidence="https://x.org/e", checked="2026-09-20", reason="said"):
    return place, url, evidence, checked, reason, fields


def frames(spark, items, entries):
    rows = spark.createDataFrame(items, ITEM).withColumn("automatic", F.lit(None).cast(C.AUTOMATIC)).withColumn("manual_correction", F.lit(None).cast(C.MANUAL))
    return rows, spark.createDataFrame(entries, C.ENTRIES), spark.createDataFrame([], C.TRACKING)


def digest(value):
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True).encode()).hexdigest()[:20]


BROKEN = [
    (entry(0, {"deadline": "2026-09-30"}), []), (entry(0, {"deadline": None}), []), (entry(0, {}), ["nothing"]), (entry(0, None), ["nothing"]), (entry(0, {"title": "x"}), ["unknown"]), (entry(0, {"deadline": "2026-02-30"}), ["deadline"]),
    (entry(0, {"deadline": ""}), ["deadline"]), (entry(0, {"deadline_time": "24:00"}), []), (entry(0, {"deadline_time": "24:01", "registration_start_time": "9:00"}), ["registration_start_time", "deadline_time"]), (entry(0, {"deadline": None}, url="x"), ["url"]),
    (entry(0, {"deadline": None}, url=None, evidence=None, checked=None, reason=None), ["url", "evidence_url", "checked_at", "reason"]), (entry(0, {"deadline": None}, checked="2026-09-23"), ["checked_at"]), (entry(0, {"deadline": None}, checked="2026-09-22T23:00"), []), (entry(0, {"deadline": None}, reason=" \n"), ["reason"]),
]


def test_rules_of_entries(spark):
    frame = spark.createDataFrame([(i, *e[1:]) for i, (e, _) in enumerate(BROKEN)], C.ENTRIES)
    found = {r["place"]: r["broken"] for r in C.judged_entries(frame, F.lit("2026-09-22").cast("date")).collect()}
    assert [found[i] for i in range(len(BROKEN))] == [b for _, b in BROKEN]


@pytest.mark.parametrize("fields, items", [
    ({"deadline_time": "09:00"}, [item("a", end=None, end_time=None)]), ({"deadline": "2026-08-01"}, [item("a")]), ({"registration_start": "2026-09-30", "registration_start_time": "19:00"}, [item("a")]),
])
def test_an_entry_that_breaks_a_notice_refuses_all(spark, fields, items):
    with pytest.raises(ValueError, match="break notices: a"):
        C.corrected(*frames(spark, [*items, item("b", "https://x.org/b")], [entry(0, fields)]), NOW)


def test_too_many_and_broken_entries_are_refused(spark):
    with pytest.raises(ValueError, match="at most 500"):
        C.corrected(*frames(spark, [item("a")], [entry(i, {"deadline": None}) for i in range(501)]), NOW)
    with pytest.raises(ValueError, match="3: reason"):
        C.corrected(*frames(spark, [item("a")], [entry(1, {"deadline": None}), entry(3, {"deadline": None}, reason="")]), NOW)


def test_a_moved_day_takes_its_clock_with_it(spark):
    items = [item("a"), item("b", "https://x.org/b"), item("c", "https://X.org/a?utm_source=z#top"), item("d", None), item("e", "https://x.org/e", status=None)]
    entries = [entry(0, {"deadline": "2026-12-01"}), entry(1, {"deadline": "2026-10-05", "registration_start": None}), entry(2, {"deadline": "2026-09-30"}, "https://x.org/e")]
    rows, given, tracking = frames(spark, items, entries)
    now, tracked = C.corrected(rows, given, tracking, NOW)
    told = {r["id"]: r for r in now.collect()}
    assert [(told[i]["registration_start"], told[i]["deadline"], told[i]["deadline_time"]) for i in "abcde"] == [(None, "2026-10-05", None), ("2026-09-01", "2026-09-30", "18:00"), (None, "2026-10-05", None), ("2026-09-01", "2026-09-30", "18:00"), ("2026-09-01", "2026-09-30", "18:00")]
    assert told["a"]["automatic"]["deadline_time"] == "18:00" and told["a"]["automatic"]["registration_ambiguous"] is True and told["a"]["registration_ambiguous"] is False and told["b"]["automatic"] is None
    whole = {"deadline": "2026-10-05", "registration_start": None, "evidence_url": "https://x.org/e", "checked_at": "2026-09-20", "reason": "said"}
    before = dict(zip(FIELDS, ("2026-09-01", "2026-09-30", None, "18:00")))
    assert {r["key"]: r["automatic_signature"] for r in tracked.collect() if r["key"][0] in "ac"} == {f"{i}:{digest(whole)}": digest(before) for i in "ac"}
    again, same = C.corrected(now, given, tracked, "2026-09-23T00:00:00+09:00")
    assert sorted(map(repr, again.collect())) == sorted(map(repr, now.collect())) and sorted(map(tuple, same.collect())) == sorted(map(tuple, tracked.collect()))
    assert sorted(map(repr, C.restored(again).collect())) == sorted(map(repr, rows.collect()))
    none, kept = C.corrected(now, given.limit(0), tracked, NOW)
    assert sorted(map(repr, none.collect())) == sorted(map(repr, rows.collect())) and kept.count() == tracked.count()
    moved = C.restored(now).withColumn("deadline", F.lit("2026-10-01")).withColumn("detail_checked_at", F.when(F.col("id") == "a", "2026-09-20").when(F.col("id") == "c", "2026-09-19"))
    review = {r["id"]: (r["manual_correction"] or {"needs_review": None})["needs_review"] for r in C.corrected(moved, given, tracked, NOW)[0].collect()}
    assert review == {"a": True, "b": None, "c": False, "d": None, "e": False}


def test_the_address_of_a_notice_is_worked_out_once(spark):
    rows, given, tracking = frames(spark, [item("a"), item("b", None), item("c", "https://X.org/a#top"), item("c", "https://X.org/a#top")], [entry(0, {"deadline": "2026-12-01"})])
    told = C.judged_entries(given, F.lit("2026-09-22").cast("date"))
    hit = C.patched(rows, spark.createDataFrame(told.collect(), told.schema), tracking, NOW)
    assert sorted(r["id"] for r in hit.collect()) == ["a", "c", "c"]
    assert sum("artclView" in line for line in hit._jdf.queryExecution().optimizedPlan().toString().splitlines()) == 1


def test_tracking_is_met_once_and_keeps_one_row_a_key(spark):
    items = [item("a"), item("a"), item("b", end="2026-10-02"), item("n", 'https://x.org/q', end='say "now"\n', end_time=None), item("o", None), item(None), item("c")]
    rows, given, none = frames(spark, items, [entry(0, {"deadline_time": "18:30"}), entry(1, {"registration_start": None}, "https://x.org/q")])
    key = lambda r: r["key"].rpartition(":")[0]
    tracked = C.corrected(rows, given, none, NOW)[1].collect()
    assert sorted(map(key, tracked)) == ["", "a", "b", "c", "n"]
    marks = {key(r): r["automatic_signature"] for r in tracked}
    assert marks["n"] == digest(dict(zip(FIELDS, ("2026-09-01", 'say "now"\n', None, None)))) and marks["a"] == marks["c"] == marks[""]
    # a row that knows neither signature nor instant is a row all the same; one without a key is of no notice
    known = spark.createDataFrame([(next(r["key"] for r in tracked if key(r) == "b"), None, None), (None, "x", "y"), (next(r["key"] for r in tracked if key(r) == "c"), "other", "before")], C.TRACKING)
    now, kept = C.corrected(rows, given, known, "2026-09-23T00:00:00+09:00")
    assert sorted((key(r) if r["key"] else None, r["first_applied_at"]) for r in kept.where("key is not null").collect()) == [("", "2026-09-23T00:00:00+09:00"), ("a", "2026-09-23T00:00:00+09:00"), ("b", None), ("c", "before"), ("n", "2026-09-23T00:00:00+09:00")]
    assert kept.count() == 6 and sorted((str(r["id"]), r["manual_correction"] and r["manual_correction"]["needs_review"]) for r in now.collect()) == [("None", False), ("a", False), ("a", False), ("b", False), ("c", True), ("n", False), ("o", None)]
    assert "LeftAnti" not in kept._jdf.queryExecution().optimizedPlan().toString()


def direct_plan(rows, sources, current, today, whole, budget):
    queues, due_ids, level = {s: [] for s, _, on in sorted(sources, key=lambda x: x[1]) if on}, set(), {}
    for i, s, status, tried, checked, version, start, end in rows:
        if status == "excluded" or s not in queues:
            continue
        attempt = tried or checked or ""
        level[i] = 0 if status == "included" and not end else 1 if not attempt else 2
        if version != current or not attempt or attempt[:10] < (whole if start and end else today):
            due_ids.add(i)
            queues[s].append((level[i], attempt, i))
    turns, taken = [deque(sorted(q)) for q in queues.values() if q], []
    while any(turns) and len(taken) < budget:
        for q in turns:
            if q and len(taken) < budget:
                taken.append(q.popleft()[2])
    return {i: (level[i], i in due_ids, i in taken, "budget_deferred" if i in due_ids and i not in taken else None) for i in level}


@pytest.mark.parametrize("seed, budget", [(1, 0), (2, 7), (3, 40), (4, 1000)])
def test_refresh_plan_is_the_round_of_queues(spark, seed, budget):
    rng = random.Random(seed)
    stamps = [None, "", "2026-09-19T01:00", "2026-09-20T23:00", "2026-09-21", "2026-09-22T00:00"]
    rows = [(i, rng.choice([1, 1, 1, 2, 3, 4, 9, None]), rng.choice(["included", "pending", "excluded", None]), rng.choice(stamps), rng.choice(stamps), rng.choice([3, 4, None]), rng.choice([None, "", "2026-09-01"]), rng.choice([None, "", "2026-09-30"])) for i in range(200)]
    sources = [(1, 3, True), (2, 1, True), (3, 2, False), (4, 4, True), (5, 0, True)]
    schema = "id int, source_id int, relevance_status string, detail_attempted_at string, detail_checked_at string, date_parser_version int, registration_start string, deadline string"
    known = spark.createDataFrame(sources, "source_id int, place int, enabled boolean")
    plan = refresh_plan(spark.createDataFrame(rows, schema), known, 4, F.lit("2026-09-22").cast("date"), budget)
    found = {r["id"]: (r["urgency"], r["due"], r["taken"], r["date_failure_code"]) for r in plan.collect()}
    expected = direct_plan(rows, sources, 4, "2026-09-22", "2026-09-20", budget)
    assert found == expected
    waits = {r["source_id"]: r["detail_deferred"] for r in deferred(plan, known).collect()}
    of = {r[0]: r[1] for r in rows}
    assert waits == {s: sum(of[i] == s and e[3] is not None for i, e in expected.items()) for s, _, _ in sources}
