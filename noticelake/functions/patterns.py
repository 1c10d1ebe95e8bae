"""Words, labels and patterns that decide what a notice says. They are data, in one place and in full."""

#: Contests, programmes and topics named by titles.
CONTEST = r"공모|경진|해커톤|데이터톤|아이디어톤|챌린지|콘테스트|캡스톤|competition|hackathon|challenge|contest|awards"
CONTEST_KIND = r"공모|경진|해커톤|데이터톤|챌린지|콘테스트|대회|competition|contest|hackathon|challenge"
PROGRAM_KIND = r"프로그램|부트캠프|교육|세미나|워크숍|특강|인턴십|캠프"
CANDIDATE = r"대회|프로그램|부트캠프|교육|세미나|워크숍|특강"
AI = r"인공\s*지능|데이터|빅데이터|통계|머신\s*러닝|딥\s*러닝|컴퓨터\s*비전|자연어|(?<![A-Za-z0-9])(?:ai|aiot|ml|llm|rag|data|machine learning|deep learning)(?![A-Za-z0-9])"
EXCLUDED = r"수상\s*(?:소식|결과|실적)|입상\s*소식|수상자\s*발표|수상팀\s*발표|수강신청|정규\s*수업"

#: Evidence that a notice is about the topic, and what is none.
AI_TOPIC = (
    r"인공\s*지능|빅\s*데이터|공공\s*데이터|데이터\s*(?:분석|활용|과학|사이언스|마이닝|시각화|셋|톤)|데이터|통계|머신\s*러닝|기계\s*학습|딥\s*러닝|자연어\s*처리|컴퓨터\s*비전|강화\s*학습"
    r"|생성형\s*(?:모델|AI)|(?<![a-z0-9])(?:AI|AIOT|LLM|RAG|ML|data|machine learning|deep learning)(?![a-z0-9])"
)
ORGANISATION = r"(?:인하대학교\s*)?(?:인공지능(?:융합)?(?:연구센터|공학과|융합센터|대학원|전공)|데이터사이언스학과|데이터과학과)|(?:AI|데이터)\s*(?:연구소|연구센터|학과|학부)"
NEGATION = r"(?:AI|인공지능|생성형).{0,60}(?:불가|불허|금지|제외|인정하지|허용하지)|(?:금지|제외).{0,20}(?:AI|인공지능)"
NOT_OPPORTUNITY = (
    r"참여자\s*선발\s*결과|참가자\s*선정\s*결과|선발\s*결과|합격자\s*발표|시험\s*결과\s*제출|장학금\s*신청|수료(?:자|증).*안내|수상\s*(?:소식|결과|실적)|수상자\s*발표|수상팀\s*발표|입상\s*소식"
    r"|수강신청|정규\s*수업|대학원.*신입생|입학\s*전형|채용\s*공고|교수\s*초빙"
)
FIELD_LINE = r"^(?:주최|주관|문의|참가\s*대상|참여\s*대상|지원\s*대상|대상|개인정보|저작권)"
PRIVACY, USE_OF_DATA = r"개인\s*데이터|데이터\s*(?:보관|삭제|수집\s*동의)", r"분석|모델|활용"

#: Technical fields and their patterns; the default where none applies.
TOPICS = {
    "data_analysis": r"데이터\s*(?:분석|시각화|마이닝|과학|활용)|공공\s*데이터|빅\s*데이터|통계|data\s*(?:analysis|science|visualization)|수요\s*예측",
    "model_development": r"모델|머신\s*러닝|딥\s*러닝|컴퓨터\s*비전|자연어\s*처리|분류|탐지|예측|세그멘테이션|강화\s*학습|model|machine\s*learning|deep\s*learning|detection",
    "service_development": r"서비스|챗봇|에이전트|에이아이\s*에이전트|(?:AI|인공지능)\s*앱|RAG|agent|chatbot",
    "creative_ai": r"(?:영상|이미지|음악|디자인|콘텐츠|숏폼|영화)\s*(?:제작|창작|생성|공모)|(?:AI|인공지능)\s*(?:영상|디자인|음악|숏폼|영화)\s*(?:공모|콘테스트)|생성형\s*AI\s*(?:영상|디자인|음악)",
}
DEFAULT_TOPIC = "general_ai"

#: What stands around a title without belonging to it.
TITLE_LEADS = [r"(?:경진대회\s+)?(?:진행중|종료|참가\s*접수중)\s+", r"\[(?:공지|홍보|모집|NEW)\]\s*"]
TITLE_SITES = ["DACON", "데이콘", "캠퍼스픽", "에브리커리어", "인공지능팩토리", r"AI\s*Factory"]
TITLE_TAILS = ["새글", "NEW"]
TITLE_CUTS = [r"알고리즘\s*[|｜]", r"(?:채용|LG Aimers|SCPC)\s*[|｜]", r"참가\s*신청중", r"참가\s*접수중", r"(?:관심|조회|조회수|스크랩)\s*[:：]?\s*\d", r"D\s*[-−]\s*\d+(?:\s|$)"]
#: Titles of boards and sites, which name no notice.
GENERIC_TITLES = [
    "공지사항", "공지", "알림마당", "새소식", "게시판", "공모전", "경진대회", "대회안내", "대회", "상세보기", "글보기", "목록", "제목", "notice", "notices", "news", "competition", "competitions",
    "campuspick", "캠퍼스픽", "에브리커리어", "인공지능융합연구센터", "인하대학교인공지능융합연구센터", "ai융합연구센터", "인하대학교ai융합연구센터",
]

#: Headings that pages space letter by letter.
FIELD_WORDS = ["접수기간", "신청기간", "모집기간", "응모기간", "공모기간", "접수마감", "신청마감", "마감일시", "대회기간", "행사기간", "참가기간", "주최", "주관", "주제", "대상", "문의", "접수처", "일정"]

#: Labels of fields by kind; where several fit, the first kind counts. `stop` ends a field without opening one.
LABELS = {
    "registration": (
        r"참가\s*접수(?=\s*(?:[:：]|\n|20\d{2}|$))|(?:(?:접수|신청|모집|응모)\s*)?마감\s*일\s*시|(?:접수|신청|모집)\s*(?:시작|종료)\s*일\s*시"
        r"|(?:(?:참가|참여|작품|참가자)\s*)?(?:접수|신청|모집|응모|공모|지원)\s*(?:기간|일정|기한|시작(?:일)?|개시(?:일)?|종료(?:일)?|마감(?:일)?)|(?:참가|참여)\s*기간|(?:접수|응모|공모|신청)(?=\s*[:：])"
        r"|(?:registration|application|submission)\s*(?:period|deadline|opens?|closes?|start(?:s| date)?|end(?:s| date)?)"
    ),
    "event": r"(?:대회|행사|본선|해커톤|활동|개최)\s*(?:기간|일시|일정|일자)|event\s*(?:dates?|period)",
    "organizer": r"주최\s*[/·ㆍ및]+\s*주관|주최(?:\s*기관)?|주관(?:\s*기관)?",
    "eligibility": r"대상(?=\s*[:：])|참가\s*(?:대상|자격)|참여\s*(?:대상|자격)|지원\s*(?:대상|자격)|신청\s*자격|응모\s*(?:대상|자격)|모집\s*대상",
    "benefits": r"상금\s*(?:및|/|·)\s*혜택|시상\s*(?:내역|내용|규모)|총\s*상금|상금|혜택",
    "summary": r"참여\s*주제|프로그램\s*(?:주제|내용)|공모\s*주제|대회\s*주제|공모\s*내용|주제|주요\s*내용",
    "schedule": r"상세\s*일정|진행\s*일정|주요\s*일정|추진\s*일정|세부\s*일정",
    "stop": (
        r"(?:장학금|장학급|지원금|환불|환급|이의\s*신청|이의\s*제기|인증서|수료증|결과\s*보고|정산)\s*(?:(?:신청|제출|지급)\s*(?:기간|기한|일정|마감일?)?|규정)|(?:당초|변경\s*전|기존)\s*(?:접수|신청|모집)\s*(?:기간|일정|기한)"
        r"|참가자\s*수|조회\s*수|소개(?=\s*(?:\n|$))|(?:팀\s*병합|팀명\s*변경)\s*기간|평가\s*방법|평가\s*기준|동의사항|참가\s*방법|대회명|신청\s*안내|담당자|선발\s*결과|결과\s*발표|학습\s*데이터셋\s*공개|코드\s*제출|순위\s*발표"
        r"|접수처|(?:공식\s*)?홈페이지|참가\s*신청(?=\s*[:：])|공식\s*사이트|신청\s*방법|접수\s*방법|문의(?:처)?|유의\s*사항|첨부\s*파일|발표\s*일시|심사\s*(?:기간|일정)|팀\s*병합\s*마감"
        r"|(?:소스\s*코드|리더보드|결과물|보고서|작품|2차\s*평가\s*자료)\s*제출(?:\s*마감)?|최종\s*(?:순위|결과)\s*발표|시상식|대회\s*(?:종료|시작)|운영|설명|대회\s*설명"
    ),
}
#: What tells that a label is none, by its surroundings.
NOT_REGISTRATION = r"장학금|장학급|환불|환급|정산|변경\s*전|당초"
NOT_FIELD = r"^(?:측|자(?:는|의|에게)|중(?:에|에는)?|동안|지급(?:과|을)?|환수|취소|관련|안내)(?:\s|$)"
BARE_REGISTRATION, BARE_SCHEDULE = r"접수|신청|응모|공모", r"(?:및\s*)?일정(?:\s*\(안\))?[\s∙·•]*"
NEXT_BULLET = r"\n\s*(?:※|\*|•|○|■|□|-(?=\s*[가-힣A-Za-z])|\d+[.)](?=\s*[가-힣A-Za-z]))\s*(?!\d)"
NEXT_SECTION = r"\n(?:평가|동의|규칙|참가 방법|제출|문의|주의|유의|개요|일정|진행 방식|첨부)(?:[^\n]{0,35})(?:\n|$)"
START_LABEL, END_LABEL, UNTIL = r"시작|개시|open|start", r"마감|종료|기한|deadline|clos|end", r"까지"
RECRUITING, OTHER_PERIOD = r"참여\s*신청|참가\s*신청|접수|모집|응모|지원", r"대회\s*기간|행사\s*기간|교육\s*기간|시험\s*일"

#: Dates with a year, dates without, and signs of a range.
FULL_DATE = r"(?<!\d)20\d{2}\s*[.\-/년]\s*\d{1,2}\s*[.\-/월]\s*\d{1,2}\s*일?(?!\d)"
SHORT_DATE = r"(?<![\d./-])\d{1,2}\s*[./월-]\s*\d{1,2}\s*일?(?!\d)"
RANGE = r"[~～∼–—]|\s-\s|\bto\b|부터"
MILESTONE = r"(?:결과물|제안서|보고서|작품|코드|소스\s*코드)\s*제출\s*(?:마감|기한|기간)|(?:본선|결과\s*발표|시상식)\s*(?:일시|일정|일자)"

#: Fields that hold no organiser, prize or schedule.
NO_ORGANIZER = r"^(?:측|자는|자의)(?![가-힣A-Za-z0-9_])|책임을?\s*부담|제3자에게|리더보드|디버그|제출물|손해(?:에\s*대해|를|배상)"
NO_BENEFITS, LICENCE_WORD, AMOUNT = r"^(?:지급과|지급을|환수|반환|취소)", "라이선스", r"\d[\d,]*\s*(?:만\s*)?원"
NO_SCHEDULE = r"Public\s*점수|Private\s*점수|리더보드에\s*실시간"

#: Lines that state who may take part, how, where and at what price, and what they say.
FACET_LINES = {
    "audience": r"(?:참가|참여|응모|지원|모집)\s*(?:대상|자격)\s*[:：]?|대상\s*[:：]",
    "team": r"(?:팀\s*(?:구성|규모|인원)|참가\s*(?:단위|인원|형태))\s*[:：]?",
    "mode": r"(?:진행\s*(?:방식|형태)|참가\s*방식|개최\s*방식)\s*[:：]?",
    "cost": r"(?:참가비|참가\s*비용|접수비|교육비|수강료)\s*[:：]?",
}
FACET_HEADING = r"(?:참가|참여|응모|지원|모집)\s*(?:대상|자격)|팀\s*(?:구성|규모|인원)|진행\s*(?:방식|형태)|참가비|교육비|수강료"
RESTRICTED, TEAM_RESTRICTED = r"제외|불가|제한|아닌|외에는", r"제외|불가|금지"
STUDENTS, GRADUATES, PUBLIC, EVERYONE = r"대학생|학부생", r"대학원생", r"일반인|누구나|전\s*국민|제한\s*없", r"누구나|전\s*국민|제한\s*없"
OWN_MEMBERS, UNRESTRICTED = r"인하대(?:학교)?\s*(?:재학생|학생|구성원|학부|대학원)", r"누구나|전국|전\s*국민|제한\s*없"
ALONE, TOGETHER, TEAM_ONLY = r"개인|1\s*인|1\s*[~∼-]", r"팀|[2-9]\s*인", r"필수|[2-9]\s*[~∼-]\s*\d+\s*인|[2-9]\s*인\s*(?:이상|팀)"
ONLINE, ONSITE = r"온라인|비대면", r"오프라인|현장|(?<!비)대면"
FREE, NOT_FREE, PAID = r"무료|없음|\b0\s*원", r"유료|\d+[1-9]\d*\s*원|[1-9]\d*\s*만원", r"유료|[1-9][\d,]*\s*(?:만\s*)?원"
BLOCK_PAGE = r"(?i)access denied|captcha|verify you are human|too many requests"

#: Rounds, audiences and named tracks in a title; what is taken off a title before titles are compared; addresses of single events.
ROUNDS = r"\d+\s*차|(?:시즌|season)\s*\d+|(?:주제|트랙|부문|track)\s*[:：]?\s*[0-9A-Z]+"
AUDIENCES = r"(?:학부생|대학원생|학생|일반|청소년|초급|고급)\s*(?:부문|트랙|부|팀)"
NAMED_TRACKS = r"[가-힣A-Za-z]+\s*(?:부문|트랙)"
TITLE_BADGE, TITLE_NOTE = r"^\s*\[(?:행사|홍보|공모|모집|공지|안내)\]\s*", r"\s*(?:개최\s*안내|참가자?\s*모집\s*안내|개최)$"
EVENT_ADDRESS = r"/(?:contest|competition|hackathon|challenge|event)s?/[^/]{3,}"
#: Platforms whose addresses number their events, as host and path; hosts whose pages are no event's own.
PLATFORM_EVENTS = {"dacon": (("dacon.io", "www.dacon.io"), r"^/competitions/(official|open)/(\d+)"), "aifactory": (("aifactory.space", "www.aifactory.space"), r"^/(?:ko/)?competitions/()(\d+)")}
BOARD_HOSTS = ("campuspick.com", "inha.ac.kr")
#: Endings of hosts and networks (first address, prefix length) that are not public; two addresses inside one of them are.
INNER_HOSTS = (".local", ".localhost", ".internal", ".lan")
INNER_NETWORKS = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24),
    ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4),
]
PUBLIC_INSIDE = ("192.0.0.9", "192.0.0.10")
MAX_ADDRESS = 1800
#: Why a date is or is not known, as far as a collector reports it.
REPORTED_REASONS = (
    "manual_date", "manual_review", "not_requested", "budget_deferred", "network_error", "robots_disallowed", "robots_unavailable", "http_401", "http_403", "http_404", "http_429", "access_blocked",
    "browser_failed", "browser_denied", "render_unconfirmed", "no_explicit_date", "date_conflict", "schedule_error", "parser_error", "confirmed", "partial_date", "stale_evidence", "cached_date",
)
#: Fields that a correction may set, what is kept of the automatic reading beside them, how many corrections there may be, and what a corrected notice says.
CORRECTED = ("registration_start", "deadline", "registration_start_time", "deadline_time")
KEPT_BESIDE = ("registration_ambiguous", "registration_time_ambiguous", "date_status", "date_note", "date_evidence", "date_source_url")
MAX_CORRECTIONS, MAX_REASON = 500, 300
CORRECTION_NOTE, CORRECTION_REVIEW = "관리자 근거 확인 보정", " · 자동 수집 내용이 달라져 재검토 필요"
