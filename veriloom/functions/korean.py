"""Korean surface morphology: endings, roles and organisation suffixes, as columns over normalised tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import surface_norm

# Word lists that the results depend on.
SURNAMES = "김이박최정강조윤장임한오서신권황안송전홍유고문양손배백허남심노하곽성차주우구민진지엄채원천방공현함변염여추도소석선설마길연위표명기반왕금옥육인맹제모탁국어은편"
ONTOLOGY = (
    "주인공 경쟁자 독자 압박 행동 선택 저항 보상 인정 결과 전환점 기대감 관계 사건 장면 정보 조직 회사 계약 자산 지위 방식 구조 주기 약속 "
    "차이 효과 진행 역할 세계 성장 감정 긴장 위기 승리 실패 다음화 목격자 기회 현금 기업 대기업 중견기업 중소기업 계열사 본사 법인 인수 투자 사업 "
    "시장 이후 이상 이하 이익 이유 우선 문제 성과 선택지 지원 지속 전략 변화 한계 권한"
).split()
ROLES = (
    "가주 검사 교수 교주 국장 군주 기사 대리 대장 도련님 대표 마왕 무사 박사 부장 사장 상무 선배 선생 소장 스승 실장 아가씨 왕 원장 이사 장군 전무 점장 주임 "
    "차장 총수 팀장 회장 황제"
).split()
HONORIFICS = "군 님 선배 선생 씨 양".split()
ORGANIZATIONS = "주식회사 유한회사 대학병원 투자회사 사모펀드 문파 재단 그룹 기업 회사 건설 전자 증권 은행 병원 호텔 학교 대학 본사 상회 상단 세가 가문 종파 길드 왕국 제국".split()
ATTRIBUTIONS = "관행 노선 문화 방식 스타일 수법 원칙 전략 철학 체계".split()
ENDINGS = (
    "이라고 이라는 이었으며 이었고 이었다 에게서 으로는 에서는 한테서 라고 라는 였으며 였고 였다 에게 에서 으로 처럼 보다 까지 "
    "부터 하고 한테 이랑 이며 이고 이니 께서 로는 에는 랑 로 은 는 이 가 을 를 의 과 와 도 만 에"
).split()


def _any(words) -> str:
    return "(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")"


def without_ending(token: Column, least: int = 2) -> Column:
    """At most one ending goes, the longest that leaves `least` characters: the shortest base that fits."""
    return F.regexp_replace(token, rf"^(.{{{least},}}?){_any(ENDINGS)}$", "$1")


def token_base(token: Column) -> Column:
    return without_ending(surface_norm(token))


def is_role(token: Column) -> Column:
    bare = F.regexp_replace(without_ending(surface_norm(token), 1), rf"^(.+?){_any(HONORIFICS)}$", "$1")
    return F.coalesce(bare.isin([*ROLES, *HONORIFICS]), F.lit(False))


def attached_person(token: Column) -> Column:
    """Two to four syllables before a role or honorific in the same token."""
    return F.nullif(F.regexp_extract(token_base(token), rf"^([가-힣]{{2,4}}?){_any([*ROLES, *HONORIFICS])}$", 1), F.lit(""))


def surname_shaped(base: Column) -> Column:
    return base.rlike(rf"^[{SURNAMES}][가-힣]{{1,3}}$") & ~base.isin(ONTOLOGY)


def organization_stem(token: Column) -> tuple[Column, Column]:
    """Stem and suffix of a token that ends in an organisation word; the longest such word decides."""
    base, form = token_base(token), rf"^(.*?)({_any(ORGANIZATIONS)})$"
    stem, suffix = F.regexp_extract(base, form, 1), F.regexp_extract(base, form, 2)
    fits = stem.rlike("^[가-힣a-z0-9_-]{2,20}$")
    return F.when(fits, stem), F.when(fits, suffix)


#: A Latin letter and more, among which a digit, underscore, hyphen or capital comes after the small letters.
LATIN = "[A-Za-z][a-z]*[A-Z0-9_-][A-Za-z0-9_-]*"


def latin_identifier(token: Column) -> Column:
    """A Latin token with a digit, underscore, hyphen, two capitals or an inner capital."""
    return token.rlike(f"^{LATIN}$")
