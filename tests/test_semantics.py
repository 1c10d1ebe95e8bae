"""Small fixtures for the rules that the tables do not reach."""

import base64
import datetime
import os

import pytest
from pyspark.sql import functions as F

from noticelake import catalog
from noticelake.functions import text as X
from noticelake.functions import timing as M
from noticelake.functions import urls as U
from noticelake.operators.asof import asof
from noticelake.operators.grouping import grouped
from noticelake.operators.upsert import upsert
from noticelake.plans.day_diff import day_diff
from noticelake.sources import html as H
from noticelake.sources.tree import Page
from noticelake.sources.attachments import extract

D = datetime.date
WRAPPED = base64.b64encode(b"fnct1|@@|%2Fbbs%2Fx%2F1%2F2%2FartclView.do%3Fid%3D3").decode()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "deadline, clock, opened, platform, seen, now, expected",
    [
        ("2026-09-23", "18:00", None, None, None, "2026-09-23 17:59:00", "active"),
        ("2026-09-23", "18:00", None, None, None, "2026-09-23 18:00:00", "closed"),
        ("2026-09-23", None, None, None, None, "2026-09-23 23:59:00", "active"),
        ("2026-10-03", None, "2026-09-24", None, None, "2026-09-23 13:00:00", "upcoming"),
        (None, None, None, "open", "2026-09-22", "2026-09-23 12:00:00", "active"),
        (None, None, None, "open", "2026-09-10", "2026-09-22 12:00:00", "unknown"),
        ("2026-10-03", None, None, "closed", None, "2026-09-22 12:00:00", "closed"),
        ("2026-09-22", "24:00", None, None, None, "2026-09-22 23:59:00", "active"),
    ],
)
def test_status(spark, deadline, clock, opened, platform, seen, now, expected):
    day = lambda v: F.lit(v).cast("date")
    ends = M.exact_instant(day(deadline), F.lit(clock).cast("string"), F.lit(False))
    assert one(spark, M.status_at(F.lit(now).cast("timestamp_ntz"), day(deadline), ends, day(opened), F.lit(platform).cast("string"), day(seen))) == expected


def test_days_are_strict(spark):
    for text, day in (("2026-02-28", D(2026, 2, 28)), ("2026-02-31", None), ("2026-2-3", None), ("x", None)):
        assert one(spark, M.valid_day(F.lit(text))) == day


def test_titles(spark):
    assert one(spark, X.clean_title(F.lit("[공지]  AI 경진대회 | DACON"))) == "AI 경진대회"
    assert one(spark, X.generic_title(F.lit("공지사항 | 학교")))
    assert one(spark, X.preferred_title(F.lit("공지사항"), F.lit("AI 대회 2026"))) == "AI 대회 2026"


def test_utf8_clip_never_splits(spark):
    for limit in range(1, 12):
        assert one(spark, X.utf8_clip(F.lit("aé한😀b"), limit)) == "aé한😀b".encode()[:limit].decode("utf-8", "ignore")


def test_canonical_url(spark):
    cases = {
        "HTTPS://Example.org/a?b=2&utm_source=x&a=1#top": "https://example.org/a?a=1&b=2",
        "https://example.org": "https://example.org/",
        "https://user@example.org/a": "",
        "javascript:alert(1)": "",
        "https://e.org/p;jsessionid=AB?x=": "https://e.org/p?x=",
        "https://d.io/competitions/official/12/leaderboard?tab=1": "https://d.io/competitions/official/12/overview/?tab=1",
        "https://e.org/bbs/x/1/2/artclView.do?layout=z&id=3": "https://e.org/bbs/x/1/2/artclView.do?id=3",
        "https://e.org/sub.do?enc=" + WRAPPED: "https://e.org/bbs/x/1/2/artclView.do?id=3",
        "https://e.org/sub.do?enc=%%%": "https://e.org/sub.do?enc=%%%",
    }
    for url, expected in cases.items():
        assert one(spark, U.canonical_url(F.lit(url))) == expected


def test_addresses_that_are_canonical_stay_as_they_are(spark):
    plain = ["https://e.org/", "http://e.org:8080/A/b.do", "https://e.org//a%20b/~c,(d)!$'*+:@=-_", "https://1.2.3.4/competitionsx/a", "https://../."]
    odd = ["https://e.org", "HTTPS://e.org/", "https://E.org/a", "https://e.org/a#b", "https://e.org/a?b", "https://e.org/a?", "https://e.org/a;jsessionid=b", "https://e.org/a;b", "https://e.org/a&enc=b", " https://e.org/a", "https://e.org/a ", "https://e.org/a\n", "https://e.org/a\u0085", "https://e.org/a<b",
           "https://e.org/competitions/open/1/x", "https://e.org/competitions/", "https://u@e.org/a", "https:///a", "ftp://e.org/a", "https://e.org/한글", "", None]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(plain + odd)], "i int, u string")
    found = [tuple(r[1:]) for r in rows.select("i", F.col("u").rlike(U.CANONICAL), U.canonical_url(F.col("u")), U.canonical_url(F.concat("u", F.lit("#x")))).orderBy("i").collect()]
    assert found[: len(plain)] == [(True, u, u) for u in plain]  # with a fragment, which is dropped, they are taken apart
    assert not any(r[0] for r in found[len(plain) :])
    wanted = ["https://e.org/", "https://e.org/", "https://e.org/a", "https://e.org/a", "https://e.org/a?b", "https://e.org/a", "https://e.org/a", "https://e.org/a;b", "https://e.org/a&enc=b", "https://e.org/a", "https://e.org/a", "", "https://e.org/a\u0085", "",
              "https://e.org/competitions/open/1/overview/", "https://e.org/competitions/", "", "", "", "https://e.org/한글", "", ""]
    assert [r[1] for r in found[len(plain) :]] == wanted


def test_upsert_keeps_missing_values_and_tells_new_from_initial(spark):
    schema = "id long, source string, title string, price double"
    state = spark.createDataFrame([(1, "a", "one", 1.0), (2, "a", "two", 2.0)], schema)
    batch = spark.createDataFrame([(1, "a", None, 1.0), (2, "a", "TWO", 2.0), (3, "a", "three", 3.0), (4, "b", "four", 4.0)], schema)
    ready = spark.createDataFrame([("a",)], "source string")
    found = {r["id"]: (r["title"], r["change"]) for r in upsert(state, batch, "id", ["source", "title", "price"], ["title", "price"], ready, "source").collect()}
    assert found == {1: ("one", None), 2: ("TWO", "updated"), 3: ("three", "new"), 4: ("four", "initial")}


def test_asof_is_strict(spark):
    left = spark.createDataFrame([(1, 10), (1, 11), (2, 5)], "k int, t int")
    right = spark.createDataFrame([(1, 10, "x"), (1, 3, "y")], "k int, t int, v string")
    assert {(r["k"], r["t"]): r["v"] for r in asof(left, right, "k", "t", "v").collect()} == {(1, 10): "y", (1, 11): "x", (2, 5): None}


def test_day_diff_does_not_trust_a_partial_source(spark):
    rows = [("n1", "s", D(2026, 1, 1), 1.0), ("n2", "s", D(2026, 1, 2), 9.0), ("n3", "s", D(2026, 1, 3), 9.0), ("n4", "s", D(2026, 1, 5), 9.0)]
    log = spark.createDataFrame(rows, "notice string, source string, day date, value double")
    found = {r["day"].day: (r["comparison"], r["new_count"], r["unverified_count"]) for r in day_diff(log, "value < 5").collect()}
    assert found == {2: ("comparable", 0, 1), 3: ("comparable", 1, 0), 5: ("gap", 1, 0)}


def test_grouping_is_guarded_and_keeps_the_oldest(spark):
    rows = [
        (1, D(2026, 1, 1), "", [2026], ["k"]), (2, D(2026, 1, 2), "", [2026], ["k", "t"]), (3, D(2026, 1, 3), "", [2027], ["k"]), (4, D(2026, 1, 3), "track b", [2026], ["k"]),
        (5, D(2026, 1, 9), "", [], ["t"]), (6, D(2026, 1, 9), "", [2026], []), (7, D(2025, 12, 1), "", [2027], ["t"]),
    ]
    notices = spark.createDataFrame(rows, "id long, first_seen date, scope string, years array<int>, keys array<string>")
    found = {r["id"]: (r["grp"], r["members"]) for r in grouped(notices).collect()}
    # 7 and 3 know another year than 1 and 2; 5 knows none and joins the older cluster of its key
    assert found[1] == found[2] and found[3] == (3, 1) and found[4] == (4, 1) and found[6] == (6, 1)
    assert found == {r["id"]: (r["grp"], r["members"]) for r in grouped(notices.repartition(3)).collect()}


def test_grouping_by_official_ids_and_bridges(spark):
    day = D(2026, 1, 1)
    rows = [
        (1, day, "", [2026], ["a"], "x"), (2, day, "", [2026], ["a"], "y"), (3, day, "", [2026], ["a", "b"], None),  # 3 goes with the oldest of its key
        (4, day, "", [2026], ["b"], None), (5, day, "", [], ["b", "c"], None), (6, day, "", [2026], ["c"], None),  # 5 learns the year and bridges
        (7, day, "", [], ["z"], None), (8, day, "", [], ["z"], None), (9, day, "", [2025, 2027], ["a"], None), (10, None, None, None, None, None),
    ]
    notices = spark.createDataFrame(rows, "id long, first_seen date, scope string, years array<int>, keys array<string>, official string")
    found = {r["id"]: (r["grp"], r["members"]) for r in grouped(notices).collect()}
    assert found == {1: (1, 5), 3: (1, 5), 4: (1, 5), 5: (1, 5), 6: (1, 5), 2: (2, 1), 7: (7, 2), 8: (7, 2), 9: (9, 1), 10: (10, 1)}
    assert grouped(notices.limit(0)).count() == 0


def test_merge_rules_case_by_case(spark):
    from noticelake.operators.upsert import Rules, claimed, merge

    schema = "id long, source string, title string, due date, clock string"
    then, now = (F.lit(x).cast("timestamp_ntz") for x in ("2026-01-01", "2026-02-01"))
    state = spark.createDataFrame([(1, "a", "one", D(2026, 3, 1), "18:00"), (2, "a", "two", D(2026, 3, 2), "09:00"), (3, "a", "three", D(2026, 3, 3), "10:00"), (4, "a", "four", None, None)], schema).select("*", *[then.alias(c) for c in ("first_seen", "last_seen", "last_changed")])
    batch = spark.createDataFrame([(1, "a", None, D(2026, 3, 9), None, False, 1), (2, "a", "two", D(2026, 3, 2), None, False, 1), (3, "a", "three", None, None, True, 1), (5, "b", "old", None, None, False, 1), (5, "b", "five", None, None, False, 2)], schema + ", vague boolean, nth int")
    rules = Rules("id", "source", ["source", "title", "due", "clock"], ["title", "due", "clock"], ["nth"], (("vague", ["due", "clock"]),), (("due", "clock"),))
    found = {r["id"]: r for r in merge(state, batch, rules, spark.createDataFrame([("a",)], "source string"), now).collect()}
    assert [found[i]["change"] for i in range(1, 6)] == ["updated", None, "updated", None, "initial"]
    assert (found[1]["title"], found[1]["due"], found[1]["clock"], found[1]["old_due"], found[1]["new_due"]) == ("one", D(2026, 3, 9), None, D(2026, 3, 1), D(2026, 3, 9))
    assert found[2]["clock"] == "09:00" and found[3]["due"] is None and found[3]["clock"] is None and found[5]["title"] == "five" and len(found) == 5
    assert found[4]["last_seen"].month == 1 and found[2]["last_seen"].month == 2 and found[2]["last_changed"].month == 1 and found[5]["first_seen"].month == 2
    wanted = spark.createDataFrame([("d1", 5), ("d1", 3), ("d2", 1)], "day string, run int")
    given = claimed(spark.createDataFrame([("d2",)], "day string"), wanted, "day", ["run"])
    assert [tuple(r) for r in given.collect()] == [("d1", 3)] and claimed(given, wanted, "day", ["run"]).where("day = 'd1'").count() == 0


def test_status_of_a_day(spark):
    from noticelake.plans.compare import status_of_day

    days = spark.createDataFrame([(D(2026, 1, 1), "2026-01-01 12:00:00")], "day date, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    told = lambda today, at, now, then: tuple(status_of_day(days, spark.createDataFrame(now, "source string, status string"), spark.createDataFrame(then, "source string, status string"), F.lit(today).cast("date"), F.lit(at).cast("timestamp_ntz")).select("status", "partial").first())
    ok = [("a", "ok"), ("b", "disabled")]
    assert told("2026-01-02", "2026-01-02 09:00:00", ok, ok) == ("comparable", False)
    assert told("2026-01-03", "2026-01-03 09:00:00", ok, [("a", "partial")]) == ("gap", True)
    assert told("2026-01-03", "2026-01-02 09:00:00", ok, ok)[0] == "stale" and told("2026-01-01", "2026-01-01 09:00:00", ok, ok)[0] == "baseline"
    assert told("2026-01-02", "2026-01-02 09:00:00", [("a", "error")], ok)[0] == "unobserved"


def test_streams_of_several_batches(spark, tmp_path):
    from noticelake.operators.upsert import Rules
    from noticelake.streaming import twins as S

    schema = "id long, source string, title string"
    for n, rows in enumerate([[(1, "a", "one"), (2, "a", "two")], [(1, "a", "ONE"), (3, "b", "three")], [(2, "a", None), (1, "a", "ONE")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    ready, now = spark.createDataFrame([("a",)], "source string"), F.lit("2026-01-01").cast("timestamp_ntz")
    state, log = S.merge_stream(stream(), Rules("id", "source", ["source", "title"], ["title"]), ready, now)
    assert {r["id"]: r["title"] for r in state.collect()}.keys() == {1, 2, 3} and state.where("id = 2").first()["title"] == "two"
    kinds = sorted((r["id"], r["change"]) for r in log.collect())
    assert {k for k in kinds if k[1] in ("new", "initial")} == {(1, "new"), (2, "new"), (3, "initial")} and len([k for k in kinds if k[1] != "updated"]) == 3
    claims = S.claim_stream(stream(), "id", ["title"]).collect()
    assert sorted(r["id"] for r in claims) == [1, 2, 3]


def test_policy_of_a_state(spark):
    from noticelake.plans import policy

    sources = spark.createDataFrame([("inha", "https://www.inha.ac.kr/x", "k2web", True, "contest"), ("ds", "https://ds.inha.ac.kr/", "k2web", None, "contest"), ("dacon", "https://dacon.io/", "dacon", True, "contest"), ("cp", "https://campuspick.com", "campuspick", False, "contest")], "id string, url string, kind string, enabled boolean, mode string")
    told = {r["id"]: (r["enabled"], r["mode"]) for r in policy.effective_sources(sources).collect()}
    assert told == {"inha": (False, "candidate"), "ds": (True, "candidate"), "dacon": (True, "candidate_platform"), "cp": (False, "ai_platform")}
    assert {r["id"]: (r["enabled"], r["mode"]) for r in policy.effective_sources(sources, strict=False, with_main=True).collect()}["inha"] == (True, "contest")
    schema = "id string, source string, url string, first_seen date, detail_title string, listing_title string, title string, organizer string, benefits string, schedule string, summary string, body string, checked boolean"
    rows = [
        ("1", "ds", "https://e.org/a?utm_source=x", D(2026, 1, 1), "공지사항", "AI 공모전 2026", "x", "측 안내", None, None, None, None, False), ("2", "ds", "https://e.org/a", D(2026, 1, 2), None, None, "인공지능 대회", "가나", None, None, None, None, False),
        ("3", "cp", "https://e.org/c", D(2026, 1, 1), None, None, "AI 대회", None, None, None, None, None, False), ("4", "ds", "bad", None, None, None, "요리 대회", None, None, None, None, "요리", True), ("5", "ds", None, None, None, None, None, None, None, None, None, None, None),
    ]
    found = {r["id"]: r for r in policy.applied(spark.createDataFrame(rows, schema), policy.effective_sources(sources)).collect()}
    assert found["1"]["duplicate_of"] == "2" and found["1"]["title"] == "AI 공모전 2026" and found["1"]["organizer"] is None and found["2"]["duplicate_of"] is None
    assert [found[i]["relevance"] for i in "12345"] == ["included", "included", "excluded", "excluded", "pending"]
    assert [r["id"] for r in policy.visible(policy.applied(spark.createDataFrame(rows, schema), sources)).collect()] == ["2"]


def test_page_parsing():
    page = Page('<html><title>T</title><body><a href="/x#f">Long link</a><del>2026. 1. 1.</del><script type="application/ld+json">{"@type": "Event", "name": "E"}</script><p>text')
    assert [(href, a.line()) for a, href in page.links()] == [("/x#f", "Long link")]
    assert page.text(None) == "Long link\ntext"
    assert H.embedded_event(page.scripts())["name"] == "E"
    assert H.embedded_event(page.scripts() * 2) is None


def test_embedded_registration_needs_the_own_id_and_agreement():
    block = '{"items": [{"id": 7, "registrationEndAt": "2026-10-31T23:00:00Z"}, {"id": 8, "registrationEndAt": "2026-01-01T00:00:00Z"}]}'
    assert H.embedded_registration([block], "7") == {"starts": None, "ends": "2026-11-01", "clock": "08:00"}
    assert H.embedded_registration([block, block.replace("23:00", "22:00")], "7")["ends"] is None
    assert H.embedded_registration([block], "9")["ends"] is None


def test_embedded_dates_of_other_notices_are_none():
    other = '{"id": 7, "recommended": [{"receiptEndDate": "2026-01-01"}], "apply-start-date": "2026-09-01", "apply_deadline": "2026-09-30T18:00:00+09:00"}'
    assert H.embedded_registration([other], "7") == {"starts": "2026-09-01", "ends": "2026-09-30", "clock": "18:00"}
    assert H.embedded_registration([], "7", marks=[{"data-registration-end": "2026-09-30"}])["ends"] == "2026-09-30"
    assert H.embedded_registration([other], "7", marks=[{"data-registration-end": "2026-10-01"}])["ends"] is None
    assert H.embedded_registration(["[" * 5000, "{", other[:-1] + " " * 2_000_000 + "}"], "7")["ends"] is None
    graph = '{"@graph": [{"@type": ["Thing", "SportsEvent"], "name": "E", "startDate": "2026-01-02", "url": "/e/1"}]}'
    assert H.embedded_event([graph], "https://x.org/e/1")["start"] == "2026-01-02" and H.embedded_event([graph], "https://x.org/e/2") is None
    assert [H.identity_of(u) for u in ("https://x.org/competitions/official/12/a", "https://x.org/v?vid=3", "https://x.org/")] == ["12", "3", ""]


def test_details_of_a_page(spark):
    html = """<html><head><title>2026 AI 경진대회 | DACON</title><meta name="description" content="d"></head><body><h1>공지사항</h1><p>주최: 가나 대학교</p><p>참가 대상: 누구나</p>
<p>접수기간: 9.1 ~ 9.30 18:00</p><p>대회기간: 10.1 ~ 10.3</p><p>시상식 일시: 10.9</p><a href="/apply">참가 신청하기</a><a href="https://o.org/">공식 홈페이지</a></body></html>"""
    other = "<title>2026 공모전 접수 9.1 ~ 9.3</title><p>내용<script type='application/json'>{\"applyEndDate\": \"2026-09-03\"}</script>"
    rows = spark.createDataFrame([(1, "https://x.org/n", html), (2, "https://x.org/m", other), (3, None, None), (4, "http://[bad", "<a href='x'>y</a>")], "page_id int, url string, html string")
    found = {r["page_id"]: r for r in H.details(rows).collect()}
    one = found[1]
    assert (one["title"], one["starts"], one["ends"], one["clock"], one["date_status"]) == ("2026 AI 경진대회", "2026-09-01", "2026-09-30", "18:00", "complete")
    assert (one["organizer"], one["eligibility"], one["event_starts"], one["event_ends"]) == ("가나 대학교", "누구나", "2026-10-01", "2026-10-03")
    assert (one["application_url"], one["website_url"]) == ("https://x.org/apply", "https://o.org/") and one["milestones"][0]["day"] == "2026-10-09" and one["facets"]["audience"]["values"][0] == "undergraduate"
    assert (found[2]["starts"], found[2]["ends"], found[2]["date_status"]) == ("2026-09-01", "2026-09-03", "complete") and found[2]["error"] is None
    assert found[3]["ends"] is None and found[4]["error"].startswith("ValueError") and found[4]["title"] == ""


def test_attachments():
    import io
    import zipfile

    def archive(text):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("Contents/section0.xml", text)
        return out.getvalue()

    assert extract(archive("<p>hello</p><p>there</p>"), "hwpx") == ("ok", "hello\nthere")
    assert extract(archive("<!DOCTYPE x>"), "hwpx")[0] == "unsafe_document"
    assert extract(archive("<p></p>"), "hwpx")[0] == "no_text"
    assert extract(b"x", "hwpx")[0] == "parse_error"
    assert extract("가나".encode("cp949"), "txt") == ("ok", "가나")
    assert extract(b"%PDF", "pdf")[0] == "unsupported"
    assert extract(b"x" * 5_000_001, "txt")[0] == "too_large"


def test_long_attachments_are_read_whole():
    import io
    import zipfile

    long = "가나 " * 50_000
    assert extract(long.encode(), "txt") == ("ok", long)
    assert extract((" " * 100_000 + "x").encode(), "txt")[0] == "ok"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("Contents/section0.xml", "<p>" + "나" * 150_000 + "</p>")
    assert extract(out.getvalue(), "hwpx") == ("ok", "나" * 150_000)


def test_schedule_links_stay_with_the_event():
    links = [("/e/1/schedule", "일정"), ("/e/2/schedule", "일정"), ("/e/1/prizes", "상금")]
    assert H.schedule_links(links, "https://x.org/e/1/overview") == ["https://x.org/e/1/schedule"]


def test_stored_tables_can_be_cleared(spark):
    from noticelake import workspace

    kept = workspace.stored(spark.range(3), "test")
    assert kept.count() == 3
    path = workspace.own_folder(spark).removeprefix("file:").replace("//", "/")
    assert os.path.isdir(path)
    workspace.clear(spark)
    assert not os.path.isdir(path)


def test_calendar_text_is_escaped_and_folded_whole(spark, tmp_path):
    texts = ["a\\b, c; d\r\ne\rf\n", "열린 공고, " * 2000 + "end", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for row in catalog.queries()["ics_folded"](spark, str(tmp_path)).collect():
        text = texts[row["doc_id"]] or ""
        for plain, escaped in (("\\", "\\\\"), ("\r\n", "\\n"), ("\n", "\\n"), (";", "\\;"), (",", "\\,"), ("\r", "")):
            text = text.replace(plain, escaped)
        lines, line = [], ""
        for c in "DESCRIPTION:" + text:
            if len((line + c).encode()) > 75:
                lines.append(line)
                line = " "
            line += c
        assert row["line"] == "\r\n".join([*lines, line])


def test_text_queries_read_every_document(spark, tmp_path):
    texts = {k: f"{k} | x\nsecond line {k}" for k in range(8)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lines = catalog.queries()["lead_next_line_all"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in lines) == sorted((k, n, len(t.split("\n")[n - 1]), len(t.split("\n")[1]) if n == 1 else None) for k, t in texts.items() for n in (1, 2))
    found = catalog.queries()["normalize_text_all"](spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in found) == list(texts)
