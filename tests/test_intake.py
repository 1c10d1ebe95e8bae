"""Requests, versions, messages and clocks of the world."""

import datetime
import json
import os
import random
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from noticelake.functions import requests as R
from noticelake.functions import timing as M
from noticelake.functions import urls as U
from noticelake.plans import digest
from noticelake.plans.intake import take_in
from noticelake.sources.versions import read_version, versions, write_version

GOOD = {"url": "https://x.org/a", "title": "공모전", "summary": "요약", "evidence_url": "https://x.org/b", "checked_at": "2026-09-20"}
FIX = {"url": "https://x.org/a", "evidence_url": "https://x.org/b", "checked_at": "2026-09-20", "reason": "까닭", "deadline": "2026-09-30"}
REPORT = {"url": "https://x.org/a", "category": "date", "description": "틀림"}
CASES = [
    ("add_notice", GOOD, []), ("correct_notice", FIX, []), ("report", REPORT, []), ("settings", GOOD, ["kind"]), (None, GOOD, ["kind"]), ("add_notice", [1], ["payload"]), ("add_notice", "x", ["payload"]),
    ("add_notice", GOOD | {"secret": 1}, ["fields"]), ("add_notice", GOOD | {"url": "https://intranet/x"}, ["url"]), ("add_notice", GOOD | {"url": 5}, ["url"]), ("report", REPORT | {"category": "x"}, ["category"]), ("report", REPORT | {"description": "x" * 801}, ["description"]),
    ("report", REPORT | {"description": "a\u0001"}, ["description"]), ("report", REPORT | {"id": "x" * 121}, ["id"]), ("add_notice", GOOD | {"evidence_url": "http://x.org"}, ["evidence_url"]), ("add_notice", GOOD | {"checked_at": "2026-9-1"}, ["checked_at"]),
    ("add_notice", GOOD | {"checked_at": "2026-12-01"}, ["future"]), ("add_notice", GOOD | {"title": " "}, ["title"]), ("add_notice", {k: v for k, v in GOOD.items() if k != "summary"}, ["summary"]), ("add_notice", GOOD | {"organizer": ""}, ["organizer"]),
    ("add_notice", GOOD | {"eligibility": None}, ["eligibility"]), ("correct_notice", FIX | {"reason": ""}, ["reason"]), ("correct_notice", FIX | {"exclude": "true"}, ["exclude"]), ("correct_notice", FIX | {"exclude": True}, []), ("add_notice", GOOD | {"deadline": None}, []),
    ("add_notice", GOOD | {"deadline": "2026-02-30"}, ["deadline"]), ("add_notice", GOOD | {"registration_start": "2026-10-01", "deadline": "2026-09-01"}, ["order"]), ("add_notice", GOOD | {"deadline": "2026-09-01", "deadline_time": "18:00"}, []),
    ("add_notice", GOOD | {"deadline_time": "18:00"}, ["clock_alone"]), ("add_notice", GOOD | {"deadline": "2026-09-01", "deadline_time": "24:00"}, ["deadline_time"]), ("correct_notice", {k: v for k, v in FIX.items() if k != "deadline"}, ["nothing"]),
    ("correct_notice", FIX | {"summary": "x"}, ["fields"]), ("add_notice", GOOD | {"secret": 1, "url": "x", "title": 5}, ["fields", "url", "title"]),
]
def today():
    return F.lit("2026-09-22").cast("date")



def test_payloads_of_a_closed_world(spark):
    rows = [(i, k, json.dumps(p)) for i, (k, p, _) in enumerate(CASES)] + [(len(CASES), "report", "{no json"), (len(CASES) + 1, "report", None)]
    frame = spark.createDataFrame(rows, "i int, kind string, payload string")
    found = {r["i"]: r["b"] for r in frame.select("i", R.broken_rules(F.col("kind"), F.col("payload"), today()).alias("b")).collect()}
    assert [(c, found[i]) for i, c in enumerate(CASES) if found[i] != c[2]] == [] and found[len(CASES)] == found[len(CASES) + 1] == ["payload"]


def test_a_payload_is_parsed_once(spark):
    frame = spark.createDataFrame([("report", "{}")], "kind string, payload string")
    plan = frame.select(R.broken_rules(F.col("kind"), F.col("payload"), today()).alias("b"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") + plan.count("parse_json") == 1 and plan.count("json_object_keys") == 0
    guarded = frame.select(U.public_url(F.col("payload")).alias("b"))._jdf.queryExecution().optimizedPlan().toString()
    assert guarded.count("(?i:https)") == 1


def test_requests_apply_once_and_bad_ones_write_nothing(spark, tmp_path):
    folder = f"{tmp_path}/state"
    batch = lambda *rows: spark.createDataFrame([(n, k, json.dumps(p)) for n, k, p in rows], "number long, kind string, payload string")
    status = lambda frame: {(r["number"], r["status"]) for r in frame.collect()}
    assert status(take_in(spark, folder, batch((1, "add_notice", GOOD | {"title": ""}), (0, "add_notice", GOOD)), today())) == {(1, "rejected"), (0, "rejected")} and versions(spark, folder) == []
    assert status(take_in(spark, folder, batch((1, "add_notice", GOOD), (2, "correct_notice", FIX), (3, "report", REPORT), (2, "correct_notice", FIX)), today())) == {(1, "applied"), (2, "applied"), (2, "already_applied"), (3, "review_required")}
    assert status(take_in(spark, folder, batch((1, "add_notice", GOOD), (2, "correct_notice", FIX)), today())) == {(1, "already_applied"), (2, "already_applied")} and versions(spark, folder) == [1]
    take_in(spark, folder, batch((7, "correct_notice", {k: v for k, v in FIX.items() if k != "deadline"} | {"title": "새 제목"})), today())
    now = read_version(spark, folder)
    (fix,) = now["entries"].where("kind = 'correct_notice'").collect()
    assert json.loads(fix["payload"])["deadline"] == "2026-09-30" and json.loads(fix["payload"])["title"] == "새 제목" and fix["number"] == 7
    assert sorted(r["number"] for r in now["ledger"].collect()) == [1, 2, 7] and versions(spark, folder) == [1, 2]


def test_versions_are_whole_or_not_there(spark, tmp_path):
    folder = f"{tmp_path}/v"
    assert read_version(spark, folder) is None
    assert [write_version(folder, {"a": spark.range(n), "b": spark.range(2 * n)}) for n in (1, 2, 3)] == [1, 2, 3] and versions(spark, folder) == [2, 3]

    class Lost(Exception):
        pass

    def lost(batches):
        raise Lost
        yield

    with pytest.raises(Exception):
        write_version(folder, {"a": spark.range(9), "b": spark.range(5).mapInPandas(lost, "id long")})
    assert {k: t.count() for k, t in read_version(spark, folder).items()} == {"a": 3, "b": 6}  # the version before the lost one
    assert write_version(folder, {"a": spark.range(4), "b": spark.range(4)}) == 4
    part = next(f for f in os.listdir(f"{folder}/v4/a") if f.startswith("part-"))
    os.remove(f"{folder}/v4/a/{part}")
    with pytest.raises(ValueError):
        read_version(spark, folder)
    assert {k: t.count() for k, t in read_version(spark, folder, 3).items()} == {"a": 3, "b": 6}


def test_messages_end_at_their_bytes(spark):
    r = random.Random(2)
    texts = {n: ["".join(r.choice("ab가é\U0001F600") for _ in range(r.randint(0, 12))) for _ in range(r.randint(1, 40))] for n in range(40)}
    texts[40], texts[41] = ["x" * 500], [""] * 300
    rows = [(n, i, line) for n, lines in texts.items() for i, line in enumerate(lines)] + [(0, 99, None)]
    found = {r["who"]: r["message"] for r in digest.clipped(spark.createDataFrame(rows, "who int, place int, line string"), ["who"], ["place"], 100).collect()}
    assert found == {n: "\n".join(lines).encode()[:100].decode(errors="ignore") for n, lines in texts.items()}


def test_instants_by_zone(spark):
    def want(day, clock, zone, unsure):
        try:
            if unsure or not clock or not zone:
                return None
            date = datetime.date.fromisoformat(day)
            if clock.startswith("24:00"):
                date, clock = date + datetime.timedelta(1), "00:00"
            return datetime.datetime.combine(date, datetime.time.fromisoformat(clock), tzinfo=ZoneInfo(zone)).timestamp()
        except (ValueError, KeyError):
            return None

    rows = [(d, c, z, u) for d in ("2026-03-08", "2026-11-01", "2026-03-29", "2026-10-25", "2026-02-30") for c in ("02:30", "01:30", "24:00", "18:00:30", "25:00", None) for z in ("America/New_York", "Europe/Berlin", "Asia/Seoul", "UTC", "Mars/Base") for u in (False, True)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, d string, c string, z string, u boolean")
    found = frame.select("i", F.unix_seconds(M.zoned_instant(F.col("d"), F.col("c"), F.col("z"), F.col("u"))).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in found] == [want(*r) for r in rows]
    absent = spark.range(1).select(F.unix_seconds(M.zoned_instant(F.lit("2026-09-30"), F.lit("18:00"), F.lit(None).cast("string"), F.lit(False))).alias("t"), F.unix_seconds(M.zoned_instant(F.lit("2026-09-30"), F.lit("18:00"), F.lit("+09:00"), F.lit(False))).alias("o")).first()
    assert absent["t"] == want("2026-09-30", "18:00", "Asia/Seoul", False) and absent["o"] is None


def test_naive_instants_are_refused(spark):
    texts = {"2026-09-30T18:00:00+09:00": 1790758800, "2026-09-30T09:00Z": 1790758800, "2026-09-30T18:00:00.5+0900": 1790758800, "2026-09-30T18:00:00": None, "2026-09-30": None, "x": None, None: None, "2026-13-30T18:00:00Z": None}
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["s"] for r in frame.select("t", F.unix_seconds(M.instant(F.col("t"))).alias("s")).collect()} == texts


def test_a_day_runs_once_from_before_its_clock(spark):
    cases = [
        ("2026-09-22 00:30:00", "10:00", True, False, (False, "before_window", "2026-09-22 10:00:00")), ("2026-09-22 00:35:00", "10:00", True, False, (True, "due", "2026-09-22 10:00:00")), ("2026-09-22 00:35:00", "10:00", True, True, (False, "already_attempted", None)),
        ("2026-09-22 02:00:00", "10:00", False, False, (False, "before_window", "2026-09-22 12:00:00")), ("2026-09-22 02:35:00", "23:59", False, False, (True, "due", "2026-09-22 12:00:00")), ("2026-09-22 15:00:00", None, None, None, (False, "before_window", "2026-09-23 12:00:00")),
    ]
    frame = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, now string, clock string, enabled boolean, claimed boolean")
    told = frame.select("i", M.due(F.col("now").cast("timestamp"), F.col("clock"), F.col("enabled"), F.col("claimed")).alias("d")).orderBy("i").collect()
    assert [(r["d"]["run"], r["d"]["reason"], r["d"]["target"] and str(r["d"]["target"])) for r in told] == [c[4] for c in cases]
