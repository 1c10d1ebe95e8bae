"""Labelled fields, dates and clocks of notice texts, case by case."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from noticelake.functions import fields as L
from noticelake.functions import patterns as P
from noticelake.functions import text as X
from noticelake.functions import timing as M

D = datetime.date
NO_YEAR = "cast(null as string)"


def each(spark, texts, **columns):
    """One row for each text, in order, with the given columns of `t`."""
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    return [r.asDict(recursive=True) for r in rows.select("i", *[c.alias(n) for n, c in columns.items()]).orderBy("i").collect()]


def test_dates_with_and_without_a_year(spark):
    cases = {
        "2026년 9월 1일 ~ 2026-09-12": ["2026-09-01", "2026-09-12"],
        "2026.9.1 ~ 9.30(수)": ["2026-09-01", "2026-09-30"],
        "9.1 ~ 9.30": [],
        "2026.9.1 2027.1.2 3.4": ["2026-09-01", "2027-01-02"],
        "12026-01-01 and 2026-01-012": [],
        "2026.13.45": [None],
        "’26. 9. 1.": ["2026-09-01"],
    }
    found = each(spark, cases, days=F.transform(M.date_tokens(F.col("t"), F.expr(NO_YEAR)), lambda x: x.cast("string")), plain=F.transform(M.extract_dates(F.col("t")), lambda x: x.cast("string")))
    assert [r["days"] for r in found] == list(cases.values())
    assert found[0]["plain"] == ["2026-09-01", "2026-09-12"] and found[4]["plain"] == [] and found[5]["plain"] == []
    assert each(spark, ["9.1 ~ 9.30"], days=F.size(M.date_tokens(F.col("t"), F.lit("2025"))))[0]["days"] == 2


def test_clocks(spark):
    cases = {"18:00": "18:00", "오후 6시": "18:00", "오전 12시 5분": "00:05", "PM 1:30": "13:30", "24:00": "24:00", "24:30": None, "25시": None, "오후 13시": None, "no": None, "9시 70분": None}
    assert [r["c"] for r in each(spark, cases, c=M.clock_of(F.col("t")))] == list(cases.values())


WINDOWS = [
    ("접수기간 : 2026. 9. 1.(화) ~ 9. 30.(수) 18:00", None, "2026-09-01", "2026-09-30", "18:00"),
    ("접수 시작일: 2026.9.1 10:00\n접수 마감일: 2026.9.20 오후 6시", None, "2026-09-01", "2026-09-20", "18:00"),
    ("접수기간: 9/1 ~ 10/31", "2026", "2026-09-01", "2026-10-31", None),
    ("접수기간: 9/1 ~ 10/31", None, None, None, None),
    ("접수기간: 2026.9.1 ~ 2026.9.3\n신청기간: 2026.9.1 ~ 2026.9.9", None, None, None, None),
    ("접수기간: 2026.9.9 ~ 2026.9.1", None, None, None, None),
    ("당초 접수기간: 2026.9.1 ~ 2026.9.3\n접수기간: 2026.9.2 ~ 2026.9.5", None, "2026-09-02", "2026-09-05", None),
    ("장학금 신청기간: 2026.9.1 ~ 2026.9.3", None, None, None, None),
    ("접 수 기 간 : 2026.9.1 ~ 2026.9.3 오 후 6시", None, "2026-09-01", "2026-09-03", "18:00"),
    ("모집기간: ~ 2026.9.3 까지", None, None, "2026-09-03", None),
    ("[접수기간] 2026.9.1 ~ 2026.9.3\n대회기간: 2026.10.1 ~ 2026.10.3", None, "2026-09-01", "2026-09-03", None),
    ("신청 방법을 안내합니다. 접수는 온라인", None, None, None, None),
    ("접수기간: 2026.9.1 ~ 2026.9.3 17:00\n신청기간: 2026.9.1 ~ 2026.9.3 18:00", None, "2026-09-01", "2026-09-03", None),
    (None, None, None, None, None),
]


def test_registration_windows(spark):
    rows = spark.createDataFrame([(i, t, y) for i, (t, y, *_) in enumerate(WINDOWS)], "i int, t string, y string").coalesce(1)
    found = rows.withColumn("e", L.entries(F.col("t"))).select("i", L.registration(F.col("e"), F.col("y")).alias("w"), L.registration_clocks(F.col("e"), F.col("y")).alias("c")).orderBy("i").collect()
    text = lambda x: x and x.isoformat()
    assert [(text(r["w"]["starts"]), text(r["w"]["ends"]), r["c"]["ends"]) for r in found] == [w[2:] for w in WINDOWS]
    assert found[12]["c"]["ambiguous"] and not found[0]["c"]["ambiguous"]


def test_spaced_headings_are_joined_in_one_pass(spark):
    rng, letters = random.Random(4), sorted(set("".join(P.FIELD_WORDS)))
    texts = ["접 수\t마 감 일 시", "대 상문 의", "가주 최 주 관", "접 수\n기 간", "일\u00a0정", "주\u200b \ufeff최", "문 의 $1 \\\\", "", None]
    texts += ["".join(rng.choice([rng.choice(letters), " ".join(rng.choice(P.FIELD_WORDS))]) + rng.choice(["", " ", "\t", " \t", ".", ":", "\u00a0"]) for _ in range(8)) for _ in range(400)]

    def joined(text):
        text = re.sub("[\u200b-\u200d\ufeff]", "", text.replace("\u00a0", " "))
        for word in P.FIELD_WORDS:
            text = re.sub(r"(?<![가-힣])" + r"[ \t]*".join(word) + r"(?![가-힣])", word, text)
        return text

    assert [r["n"] for r in each(spark, texts, n=X.normalize(F.col("t")))] == [t if t is None else joined(t) for t in texts]
    plan = spark.createDataFrame([("",)], "t string").select(X.normalize(F.col("t")).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 3


def test_labels_begin_where_they_are_looked_for(spark):
    anywhere = L.LABEL.replace(r"(?=[가-힣A-Za-z]|\d+차)", "")
    assert anywhere != L.LABEL
    texts = ["2026.9.1 접수기간: 9/1", "2차 평가 자료 제출 마감: 9/1", "12차 평가 자료 제출", "- 2차평가자료제출", "\u017fubmission period: 9/1", "REGI\u017fTRATION Opens 9/1", "(주최/주관: 가)", "1. 대상: 나", "① 문의처", "·총 상금: 1", "9/1 ~ 9/3 event dates"]
    found = each(spark, texts, here=F.regexp_replace("t", L.LABEL, "<$0>"), anywhere=F.regexp_replace("t", anywhere, "<$0>"))
    assert all(r["here"] == r["anywhere"] for r in found) and sum("<" in r["here"] for r in found) == 10


def test_fields_of_a_notice(spark):
    text = "AI 경진대회\n주최: 가나 대학교\n주최 측 안내\n참가 대상: 대학생\n\n다른 문단\n총 상금: 500만원\n■ 유의\n주제: 데이터 분석\n평가 방법: 심사\n접수기간: 2026.9.1 ~ 2026.9.9"
    found = each(spark, [text], e=L.entries(F.col("t")))[0]["e"]
    assert [(x["kind"], x["value"]) for x in found] == [("organizer", "가나 대학교 주최 측 안내"), ("eligibility", "대학생"), ("benefits", "총상금 500만원"), ("summary", "데이터 분석"), ("registration", "2026.9.1 ~ 2026.9.9")]
    assert each(spark, [text], v=L.values_of(L.entries(F.col("t")), "summary"))[0]["v"] == ["데이터 분석"]


def test_windows_in_titles(spark):
    cases = {"2026 AI 공모전 참가 신청 (9.1 ~ 9.30)": ("2026-09-01", "2026-09-30"), "2026 해커톤 모집 ~ 10월 5일": (None, "2026-10-05"), "AI 공모전 모집 ~ 10/5": None, "2026 모집 안내, 대회기간 9.1 ~ 9.3": None, "2026 대회 9.1 ~ 9.3": None}
    found = each(spark, cases, w=L.title_registration(F.col("t")))
    assert [r["w"] and tuple(d and d.isoformat() for d in (r["w"]["starts"], r["w"]["ends"])) for r in found] == list(cases.values())


def test_milestones(spark):
    text = "결과물 제출 마감\n2026. 9. 1. 18:00\n시상식 일시: 2026.9.3 또는 2026.9.4\n결과 발표 일자: 10/2"
    found = each(spark, [text], m=L.milestones(F.col("t"), F.lit("2026 AI")))[0]["m"]
    assert [(x["kind"], x["label"], x["day"], x["clock"]) for x in found] == [("submission", "결과물 제출 마감", "2026-09-01", "18:00"), ("event", "결과 발표 일자", "2026-10-02", None)]


def test_facets_and_their_evidence(spark):
    texts = [
        "참가 대상: 누구나\n팀 구성: 개인 또는 팀(2~4인)\n진행 방식: 온라인 예선, 현장 본선\n참가비: 무료", "참가자격: 인하대 재학생\n팀 규모\n3인 이상 팀 필수\n참가비: 30,000원",
        "지원 대상: 대학생 제외", "내용 없음", "참가 대상: 대학생 및 대학원생\n개최 방식: 비대면", None,
    ]
    found = each(spark, texts, f=X.facets(F.col("t")))
    values = [{k: v["values"] for k, v in r["f"].items()} for r in found]
    everyone, unknown = ["undergraduate", "graduate", "general"], ["unknown"]
    assert values[0] == {"audience": everyone, "affiliation": ["unrestricted"], "team": ["individual_or_team"], "mode": ["hybrid"], "cost": ["free"]}
    assert values[1]["affiliation"] == ["inha"] and values[1]["team"] == ["team_required"] and values[1]["cost"] == ["paid"]
    assert found[1]["f"]["team"]["evidence"] == "팀 규모 3인 이상 팀 필수"
    assert values[2]["audience"] == unknown and values[3] == values[5] == dict.fromkeys(values[3], unknown)
    assert values[4]["audience"] == ["undergraduate", "graduate"] and values[4]["mode"] == ["online"]


@pytest.mark.parametrize(
    "title, summary, body, status",
    [
        ("2026 인공지능 공모전", None, None, "included"), ("요리 공모전", "공공 데이터 활용", None, "included"), ("요리 공모전", None, None, "pending"), ("요리 공모전", None, "맛있는 요리", "excluded"),
        ("AI 수상자 발표", None, None, "excluded"), ("글쓰기 대회", "생성형 AI 사용 금지", None, "pending"), ("인하대학교 인공지능융합연구센터 안내", None, "개인 데이터 보관", "excluded"), ("", None, None, "pending"),
    ],
)
def test_classification(spark, title, summary, body, status):
    lit = lambda x: F.lit(x).cast("string")
    assert spark.range(1).select(X.classify(lit(title), lit(summary), lit(body), F.lit(False)).alias("c")).first()["c"]["status"] == status


def test_titles_tags_and_sane_fields(spark):
    cases = {"[홍보] AI 아이디어톤  |  캠퍼스픽": "AI 아이디어톤", "경진대회 진행중 데이터톤 조회 120 스크랩 3": "데이터톤", "비전 챌린지 LG Aimers | 태그": "비전 챌린지", "공모 D-12 남음": "공모", "대회 새글": "대회"}
    assert [r["x"] for r in each(spark, cases, x=X.clean_title(F.col("t")))] == list(cases.values())
    generic = {"인하대학교 AI융합연구센터": True, "에브리커리어 | x": True, "home": False, "": True, "AI 대회": False}
    assert [r["x"] for r in each(spark, generic, x=X.generic_title(F.col("t")))] == list(generic.values())
    tagged = {"수요 예측 경진대회": ["data_analysis", "model_development"], "AI 앱 개발": ["service_development"], "숏폼 제작": ["creative_ai"], "AI 연구소 모델": ["model_development"], "생성형 모델 사용 금지": ["general_ai"]}
    assert [r["x"] for r in each(spark, tagged, x=X.tags(F.col("t")))] == list(tagged.values())
    assert [r["x"] for r in each(spark, ["가나 대학교", "측은 책임을 부담", "자는 없다"], x=X.sane_organizer(F.col("t")))] == ["가나 대학교", None, None]
    assert [r["x"] for r in each(spark, ["상금 100만원 라이선스", "라이선스 안내", "환수 조건"], x=X.sane_benefits(F.col("t")))] == ["상금 100만원 라이선스", None, None]


def test_status_knows_exact_openings_and_ambiguity(spark):
    now = F.lit("2026-09-23 12:00:00").cast("timestamp_ntz")
    day, at = (lambda x: F.lit(x).cast("date")), (lambda x: F.lit(x).cast("timestamp_ntz"))
    status = lambda **k: M.status_at(now, k.get("deadline", day(None)), at(None), k.get("opened", day(None)), F.lit(k.get("platform")).cast("string"), k.get("seen", day(None)), k.get("starts", at(None)), F.lit(k.get("ambiguous", False)))
    cases = [
        (status(deadline=day("2026-09-30"), opened=day("2026-09-23"), starts=at("2026-09-23 18:00:00")), "upcoming"), (status(deadline=day("2026-09-30"), opened=day("2026-09-23"), starts=at("2026-09-23 09:00:00")), "active"),
        (status(deadline=day("2026-09-01"), ambiguous=True), "unknown"), (status(platform="open", seen=day("2026-09-24")), "unknown"), (status(platform="open", seen=day("2026-09-20")), "active"),
    ]
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    assert list(row) == [s for _, s in cases]
