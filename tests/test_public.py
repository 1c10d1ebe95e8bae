"""What is shown of a run, against direct versions."""

import re
from datetime import datetime

from pyspark.sql import functions as F

from noticelake.functions import public as V

STAMPS = ["2026-09-22T10:00:00+09:00", "2026-09-22 10:00+09:00", "2026-09-22T10:00:00Z", "2026-09-22T10:00:00.123+00:00", "2026-09-22T10:00:00.120000-05:30", "2026-09-22T10:00:00.000000+09:00", "2026-09-22T10:00:00", "2026-09-22", "2026-02-30T10:00:00+09:00", "2026-09-22T25:00:00+09:00", "2026-09-22T10:00:00+25:00", "yesterday", "", None]


def stamp(text):
    try:
        at = datetime.fromisoformat(text)
    except (TypeError, ValueError):
        return None
    return at.isoformat() if at.tzinfo else None


def test_stamps(spark):
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(STAMPS)], "i int, s string")
    found = {r["i"]: r["v"] for r in frame.select("i", V.zoned_stamp(F.col("s")).alias("v")).collect()}
    assert [(s, found[i]) for i, s in enumerate(STAMPS)] == [(s, stamp(s)) for s in STAMPS]


def test_traces(spark):
    long = [{"stage": f"s{i}", "token": "secret", "code": str(i)} for i in range(12)]
    cases = [long, [None, {"stage": "a"}, {"token": "b"}], [], None]
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t array<map<string,string>>")
    found = {r["i"]: r["v"] for r in frame.select("i", V.public_trace(F.col("t")).alias("v")).collect()}
    assert [found[i] for i in range(4)] == [[{"stage": f"s{i}", "code": str(i)} for i in range(8)], [{"stage": "a"}, {}], [], []]


def test_collections_and_notifications(spark):
    claims = [
        None, {}, {"latest": {"status": "accepted"}}, {"2026-09-21": {"status": "failed"}, "2026-09-22": {"status": "accepted", "at": STAMPS[0], "accepted_at": STAMPS[6], "failed_at": "x", "topic": "secret"}}, {"2026-09-22": {"status": "odd"}}, {"2026-09-22": {}},
    ]
    runs = [(None, None), ({}, "2026-09-22"), ({"status": "complete", "token": "x"}, None), ({"attempted_at": "a", "version": "8"}, "b"), (None, ""), ({"status": None}, "c")]
    frame = spark.createDataFrame([(i, c, *r) for i, (c, r) in enumerate(zip(claims, runs))], "i int, c map<string,map<string,string>>, r map<string,string>, u string")
    rows = {r["i"]: r for r in frame.select("i", V.public_notification(F.col("c")).alias("n"), V.public_collection(F.col("r"), F.col("u")).alias("p")).collect()}

    def told(claims):
        days = sorted(d for d in claims or {} if re.fullmatch(r"\d{4}-\d{2}-\d{2}", d))
        if not days:
            return {"status": "not_attempted"}
        claim = claims[days[-1]]
        state = claim.get("status")
        return {"status": state if state in V.CLAIM_STATES else "unknown", "day": days[-1]} | {k: stamp(claim.get(k)) for k in V.CLAIM_STAMPS if stamp(claim.get(k))}

    def shown(run, updated):
        return {"attempted_at": updated, "status": "legacy" if updated else "not_started"} | {k: v for k, v in (run or {}).items() if k in V.COLLECTION_KEYS}

    assert [rows[i]["n"] for i in range(6)] == [told(c) for c in claims]
    assert [rows[i]["p"] for i in range(6)] == [shown(*r) for r in runs]
