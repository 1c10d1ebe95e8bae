"""Library rules against direct versions: identity, guards, reasons, canonical JSON, the registry."""

import hashlib
import ipaddress
import json
import random

import pytest
from pyspark.sql import functions as F

from noticelake.functions import canonical, identity
from noticelake.functions import urls as U
from noticelake.operators.grouping import grouped
from noticelake.operators.registry import registered, resolved
from noticelake.plans import diagnostics

OFFICIAL = "https://dacon.io/competitions/official/236754/overview/"
ITEM = "id string, first_seen string, title string, url string, application_url string, website_url string, date_source_url string, organizer string, registration_start string, deadline string"


def item(i, title="2026 공공데이터 AI 분석 경진대회", url=None, application=None, website=None, source=None, organizer="공공기관", start="2026-09-01", end="2026-09-30"):
    return i, "2026-09-22", title, url or f"https://univ.example/notices/{i}", application, website, source, organizer, start, end


def test_events_are_told_apart(spark):
    """Pairs of notices and how many events they are."""
    other, shared = OFFICIAL.replace("236754", "236753"), "https://agency.example/contest/2026-ai"
    cases = [
        (item("a", website=OFFICIAL), item("b", url=OFFICIAL), 1), (item("a", url=OFFICIAL), item("b", url=other), 2), (item("a", title="2025 AI 경진대회", website=OFFICIAL), item("b", title="2026 AI 경진대회", url=OFFICIAL), 2),
        (item("a", title="2026 AI 교육 3차", website=OFFICIAL), item("b", title="2026 AI 교육 4차", url=OFFICIAL), 2), (item("a", title="2026 데이터 대회 주제 3", website=OFFICIAL), item("b", title="2026 데이터 대회 주제 4", url=OFFICIAL), 2),
        (item("a", title="2026 모델 개발 공모전", website="https://example.org/"), item("b", title="2026 AI 영상 경진대회", website="https://example.org/"), 2), (item("a"), item("b", url="https://www.campuspick.com/contest/view?id=2"), 1),
        (item("a"), item("b", title="2026 공공데이터 AI 분석 해커톤"), 2), (item("a", website=shared), item("b", website=shared, end="2026-10-01"), 1), (item("a", organizer=None), item("b", organizer=None), 2),
        (item("a", website=OFFICIAL, application=other), item("b", url=OFFICIAL, title="2026 다른 이름의 대회"), 2), (item("a", title="2026 AI 대회 학생 부문", website=OFFICIAL), item("b", title="2026 AI 대회 일반 부문", url=OFFICIAL), 2),
    ]
    rows = [(f"{n:02}{row[0]}", *row[1:]) for n, pair in enumerate(cases) for row in pair[:2]]
    found = identity.identified(spark.createDataFrame(rows, ITEM))
    # every case is a world of its own
    apart = found.withColumn("keys", F.transform("keys", lambda k: F.concat(F.left("id", F.lit(2)), k))).withColumn("official", F.concat(F.left("id", F.lit(2)), "official"))
    groups = {}
    for r in grouped(apart).collect():
        groups.setdefault(r["id"][:2], set()).add(r["grp"])
    assert [len(groups[f"{n:02}"]) for n in range(len(cases))] == [c[2] for c in cases]


def test_official_keys(spark):
    rows = [(OFFICIAL, None, None, None), ("https://x.org/1", "https://aifactory.space/ko/competitions/12/a", "https://aifactory.space/competitions/12", None), ("https://x.org/2", OFFICIAL, "https://aifactory.space/competitions/12", None), ("https://x.org/3", None, "https://a.org/events/summer", "https://a.org/events/winter"), ("https://x.org/4", "https://www.inha.ac.kr/contest/12345", None, None), (None, None, None, None)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, u string, a string, w string, d string")
    assert [r["k"] for r in frame.select("i", identity.official_key(F.col("u"), F.col("a"), F.col("w"), F.col("d")).alias("k")).orderBy("i").collect()] == ["dacon:official:236754", "aifactory:12", "", "linked:https://a.org/events/summer", "", ""]


def test_public_addresses(spark):
    r = random.Random(5)
    ips = [".".join(str(r.choice([0, 9, 10, 100, 64, 127, 128, 172, 16, 31, 32, 192, 168, 169, 254, 198, 18, 19, 51, 203, 113, 224, 240, 255, r.randrange(256)])) for _ in range(4)) for _ in range(600)]
    ips += ["192.0.0.9", "192.0.0.10", "192.0.0.8", "8.8.8.8", "100.63.255.255", "100.64.0.0", "01.2.3.4", "1.2.3", "256.1.1.1", "1.2.3.4."]

    def fine(ip):
        try:
            return ipaddress.ip_address(ip).is_global
        except ValueError:
            return False

    named = {
        "https://x.org/a": True, "https://x.org:443/a": True, "https://x.org:8443/a": False, "http://x.org/": False, "https://intranet/x": False, "https://a.internal/x": False, "https://a.local/": False, "https://a.lan": False, "https://u@x.org/": False,
        "https://[::1]/": False, "https://x.org/" + "a" * 1790: False, "https://x.org/a b": False, 'https://x.org/"': False, None: False, "": False, "https://a.localhost": False,
    }
    want = {f"https://{ip}/x": fine(ip) for ip in ips} | named
    frame = spark.createDataFrame([(u,) for u in want], "u string")
    assert {r["u"]: r["p"] for r in frame.select("u", U.public_url(F.col("u")).alias("p")).collect()} == want


def test_reasons_by_the_ladder(spark):
    schema = "manual boolean, needs_review boolean, deadline string, registration_start string, registration_ambiguous boolean, date_status string, date_failure_code string, detail_status string, detail_attempted_at string"
    end, start, at = "2026-09-30", "2026-09-01", "2026-09-20"
    cases = [
        ((True, True, None, None, None, None, None, None, None), "manual_review"), ((True, None, end, None, None, None, None, None, None), "manual_date"), ((None, None, end, start, None, None, "budget_deferred", None, at), "cached_date"),
        ((None, None, end, start, None, None, None, "error", at), "stale_evidence"), ((None, None, end, start, None, None, "http_500", None, at), "stale_evidence"), ((None, None, end, start, True, None, "http_500", None, at), "date_conflict"),
        ((None, None, None, None, None, "conflict", None, None, at), "date_conflict"), ((None, None, end, start, None, None, "confirmed", "ok", at), "confirmed"), ((None, None, end, None, None, None, "", None, None), "partial_date"),
        ((None, None, "2026-9-30", None, None, None, "http_418", None, at), "http_418"), ((None, None, None, None, None, None, "odd", None, at), "parser_error"), ((None, None, None, None, None, None, "robots_disallowed", None, at), "robots_disallowed"),
        ((None, None, None, None, None, None, None, None, None), "not_requested"), ((None, None, None, None, None, None, None, "error", at), "network_error"), ((None, None, None, start, None, None, None, None, at), "partial_date"), ((None, None, None, None, None, None, None, None, at), "no_explicit_date"),
    ]
    frame = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(cases)], "i int, " + schema)
    assert [r["r"] for r in frame.select("i", diagnostics.reason().alias("r")).orderBy("i").collect()] == [c[1] for c in cases]
    told = diagnostics.report(frame.withColumns({"source_id": F.lit("s"), "deadline_time": F.lit("18:00"), "registration_time_ambiguous": F.lit(False)})).first()
    assert (told["denominator"], told["deadline_known"], told["manual_count"], told["deadline_coverage"], told["reasons"]["stale_evidence"]) == (16, 6, 2, 37.5, 2)


VALUES = [
    {"b": 1, "a": "é\"\\\n\t\x01\x1f\x7f/", "m": {"z": [1.5, None], "a": [], "é": [0.1]}, "s": {"y": True, "x": None}, "l": [{"q": "x"}, None]},
    {"b": None, "a": None, "m": None, "s": None, "l": None}, {"b": -5, "a": "", "m": {}, "s": {"y": False, "x": 0}, "l": []},
]


def test_canonical_json_is_that_of_sorted_keys(spark):
    schema = "b long, a string, m map<string,array<double>>, s struct<y:boolean,x:int>, l array<struct<q:string>>"
    frame = spark.createDataFrame(VALUES, schema)
    whole = F.struct(*frame.columns)
    kind = frame.select(whole.alias("x")).schema["x"].dataType
    found = [r["j"] for r in frame.select(canonical.canonical_json(whole, kind).alias("j")).collect()]
    want = [json.dumps({k: v.get(k) for k in frame.columns}, ensure_ascii=False, sort_keys=True) for v in VALUES]
    assert found == want
    assert frame.select(canonical.content_hash(whole, kind).alias("h")).first()["h"] == hashlib.sha256(want[0].encode()).hexdigest()[:20]


def test_doubles_have_their_shortest_digits(spark):
    r = random.Random(3)
    values = [0.0, -0.0, 1.0, -1.5, 1e15, 1e16, 123456789012345680.0, 1e-4, 1e-5, 12345678.0, 0.001234, 1e22, 1e100, 2.3e-308, 1.7976931348623157e308, 1e7, 100.0, float("inf"), float("-inf")]
    values += [r.choice([-1, 1]) * r.random() * 10 ** r.randint(-12, 20) for _ in range(300)]
    found = [x["j"] for x in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", canonical.json_double(F.col("v")).alias("j")).orderBy("i").collect()]
    # as few digits, which read back as the double; of two such texts the JVM may take the other
    want = [json.dumps(v) for v in values]
    assert [float(x) for x in found] == values and [len(x) for x in found] == [len(x) for x in want] and sum(x == y for x, y in zip(found, want)) >= 0.97 * len(values)
    assert float(spark.range(1).select(canonical.json_double(F.lit(5e-324)).alias("j")).first()["j"]) == 5e-324


def test_ids_of_events_outlive_two_merges(spark):
    groups = lambda rows: spark.createDataFrame(rows, "id string, first_seen string, grp string")
    nothing, none = spark.createDataFrame([], "id string, event string"), spark.createDataFrame([], "old string, live string")
    one, aliases = registered(groups([("a", "1", "a"), ("b", "2", "b"), ("c", "3", "c"), ("d", None, "d")]), nothing, none)
    assert {r["id"]: r["event"] for r in one.collect()} == {x: f"evt_{x}" for x in "abcd"} and aliases.count() == 0
    two, aliases = registered(groups([("b", "2", "b"), ("c", "3", "b"), ("d", None, "d")]), one, aliases)
    assert {r["id"]: r["event"] for r in two.collect()} == {"a": "evt_a", "b": "evt_b", "c": "evt_b", "d": "evt_d"} and [tuple(r) for r in aliases.collect()] == [("evt_c", "evt_b")]
    three, aliases = registered(groups([("a", "1", "a"), ("b", "2", "a"), ("e", "9", "a"), ("d", None, "d")]), two, aliases)
    assert {r["id"]: r["event"] for r in three.collect()} == {"a": "evt_a", "b": "evt_a", "c": "evt_a", "d": "evt_d", "e": "evt_a"}
    assert {r["old"]: r["live"] for r in aliases.collect()} == {"evt_c": "evt_a", "evt_b": "evt_a"}


def test_aliases_jump_along_long_chains(spark):
    chain = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(100)], "old string, live string")
    assert {r["live"] for r in resolved(chain).collect()} == {"100"}
    with pytest.raises(ValueError):
        resolved(spark.createDataFrame([("a", "b"), ("b", "a")], "old string, live string"))
