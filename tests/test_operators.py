"""Operators on literal inputs and against plain Python."""

import hashlib
import json
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from veriloom.functions import text as T
from veriloom.operators import evidence as E
from veriloom.operators import findings as N
from veriloom.operators import overlap as O
from veriloom.operators import packing as P
from veriloom.operators import profile as R
from veriloom.operators import scoring as G
from veriloom.operators import segment as S
from veriloom.operators import trace as A
from veriloom.operators import validation as V
from veriloom.sources import files as I


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def test_chapters(spark):
    text = "앞말\nⓚ1화. 시작\n첫 줄\n\nⓚ2화. 다음\n둘째 줄\n"
    got = S.chapters(docs(spark, text)).orderBy("sequence").collect()
    assert [(r["sequence"], r["marker"], r["prose"]) for r in got] == [(1, "ⓚ1화. 시작", "첫 줄"), (2, "ⓚ2화. 다음", "둘째 줄")]
    index = S.chapter_index(docs(spark, text)).orderBy("sequence").collect()
    raw = text.encode()
    assert [raw[r["start_byte"] : r["end_byte"]].decode()[:3] for r in index] == ["ⓚ1화", "ⓚ2화"]
    assert index[-1]["end_byte"] == len(raw) and [r["chapter_number"] for r in index] == [1, 2]


def test_chapter_number_forms(spark):
    lines = {
        "ⓚ12화. 제목": 12, "ⓚ12화 제목": 12, "ⓚ12": 12, "ⓚ<7> 제목": 7, "<ⓚ7> 제목": None, "ⓚ제목 33화": 33, "ⓚ제목33화": 33, "ⓚ제목 33화 끝": 33, "ⓚ제목 33화끝": None, "ⓚa33화": None,
        "ⓚ제목 12345화": None, "ⓚ12345": 1234, "ⓚ1권 2화": 1, "ⓚ<12345>": None, "12화": None, "ⓚ제목": None, "ⓚ제 5화 그리고 7화": 5, "ⓚ" + "가" * 121 + " 3화": None, "ⓚ" + "가" * 119 + " 3화": 3,
    }
    rows = docs(spark, *lines).select("doc_id", S.chapter_number(F.col("text")).alias("n"))
    assert [r["n"] for r in rows.orderBy("doc_id").collect()] == list(lines.values())


def test_structure_profile(spark):
    texts = ["ⓚ1화. a\nⓚ3화. b", "ⓚ2화 a\nⓚ3 b\r\nⓚ<4>", "\ufffdⓚ1\u2028ⓚ2\rⓚ3\nx ⓚ4", None, "ⓚ1\nⓚ이름뿐"]
    got = S.structure_profile(docs(spark, *texts)).orderBy("doc_id").collect()
    shown = [(r["marker_lines"], r["chapters"], r["unparsed"], r["gaps"], r["first_number"], r["last_number"], r["replacements"], r["status"]) for r in got]
    assert shown == [
        (2, 2, 0, 1, 1, 3, 0, "needs-review"), (3, 3, 0, 0, 2, 4, 0, "complete"), (2, 2, 0, 0, 2, 3, 1, "needs-review"), (0, 0, 0, 0, None, None, 0, "needs-review"), (2, 1, 1, 0, 1, 1, 0, "complete"),
    ]
    broken = spark.createDataFrame([(0, b"\xff\xe2\x93\x9a1")], "doc_id int, text binary")
    row = S.structure_profile(broken).first()
    assert (row["utf8_valid"], row["marker_lines"], row["status"]) == (False, 0, "needs-review")


def test_chapter_index_at_other_line_ends(spark):
    text = "앞\rⓚ1화\u2028ⓚ2\r\n😀\u2029ⓚ<3> x\nⓚ4\n끝"
    raw = text.encode()
    got = S.chapter_index(docs(spark, text)).orderBy("sequence").collect()
    assert [r["chapter_number"] for r in got] == [1, 3, 4]
    assert [raw[r["start_byte"] :].decode()[:2] for r in got] == ["ⓚ1", "ⓚ<", "ⓚ4"]
    assert [r["end_byte"] for r in got] == [got[1]["start_byte"], got[2]["start_byte"], len(raw)]


def test_chapter_offsets_are_utf16(spark):
    text = "😀\nⓚ1 a😀\n본문\nⓚ2"
    got = S.chapters(docs(spark, text)).orderBy("sequence").collect()
    units = text.encode("utf-16-le")
    assert [units[2 * r["start_offset"] : 2 * r["end_offset"]].decode("utf-16-le") for r in got] == ["ⓚ1 a😀\n본문\n", "ⓚ2"]


def test_survey_windows(spark):
    got = S.survey_picks(spark.createDataFrame([("a", 250), ("b", 751), ("c", 12_000)], "work string, n int"), "work").collect()
    assert [r["chapter_sequence"] for r in got if r["work"] == "a"] == [1, 63, 126, 188, 250]
    assert [r["phase"] for r in got if r["work"] == "a"] == ["opening", "distributed-1", "distributed-2", "distributed-3", "ending"]
    assert sum(r["work"] == "b" for r in got) == 8
    names = [r["window_id"] for r in got if r["work"] == "c"]
    assert len(set(names)) == 120 and names[:2] == ["w01", "w02"] and names[-1] == "w120"
    text = "".join(f"ⓚ{i}화\n" + "가😀" * 30 + "\n" for i in range(1, 13))
    raw = text.encode()
    rows = S.survey_windows(docs(spark, text), size=50).orderBy("window_id").collect()
    assert [r["chapter_number"] for r in rows] == [1, 4, 7, 9, 12]
    for r in rows:
        piece = raw[r["start_byte"] : r["end_byte"]]
        assert piece.decode().startswith("ⓚ") and 47 <= len(piece) <= 50


def test_corpus_identity(spark):
    names = ["긴_제목_작가_합본.txt", "제목_합본.txt", "_작가_합본.txt", "a/b_작가_합본.txt", "제목_작가.txt", None]
    rows = spark.createDataFrame([(str(i), n, "text/plain", 5, "2026-01-01T00:00:00Z") for i, n in enumerate(names)], "provider_file_id string, title string, mime_type string, size_bytes long, modified_at string")
    got = [(r["source_id"], r["author"], r["problem"]) for r in S.corpus_identity(rows).orderBy("provider_file_id").collect()]
    assert got == [("gdrive-0", "작가", None), (None, None, "no-author"), (None, None, "no-author"), (None, None, "unsafe-title"), (None, None, "not-a-corpus-name"), (None, None, "not-a-corpus-name")]


def test_spans_are_byte_exact(spark):
    text = "  가나 \n\n　다😀\t\n라\r마"
    raw = text.encode()
    got = S.evidence_spans(docs(spark, text)).orderBy("line_no").collect()
    assert [raw[r["start_byte"] : r["end_byte"]].decode() for r in got] == ["가나", "다😀", "라", "마"]


def mattr_brute(tokens, w):
    if len(tokens) <= w:
        return len(set(tokens)) / len(tokens)
    parts = [len(set(tokens[i : i + w])) / w for i in range(len(tokens) - w + 1)]
    return sum(parts) / len(parts)


def test_mattr_equals_sliding_windows(spark):
    rng = random.Random(5)
    lists = [[rng.choice("abcdefgh") for _ in range(n)] for n in (1, 5, 9, 10, 11, 40, 100)]
    rows = spark.createDataFrame([(i, p, x) for i, xs in enumerate(lists) for p, x in enumerate(xs)], "doc_id int, pos int, token string")
    got = {r["doc_id"]: r["mattr"] for r in R.mattr(rows, "doc_id", window=10).collect()}
    for i, xs in enumerate(lists):
        assert got[i] == pytest.approx(mattr_brute(xs, 10), abs=0.0006)


def test_row_mattr_equals_sliding_windows(spark):
    rng = random.Random(6)
    lists = [[rng.choice("abcdefgh") for _ in range(n)] for n in (0, 1, 9, 10, 11, 100)] + [None, ["a"] * 30, []]
    rows = spark.createDataFrame(list(enumerate(lists)), "doc_id int, w array<string>").repartition(2)
    got = {r["doc_id"]: r["m"] for r in rows.select("doc_id", R.row_mattr(F.coalesce("w", F.array().cast("array<string>")), 10)[1].alias("m")).collect()}
    for i, xs in enumerate(lists):
        assert got[i] == pytest.approx(mattr_brute(xs, 10) if xs else 0, abs=0.0006)


def test_summary_uses_lower_ranks(spark):
    got = R.summary(spark.createDataFrame([("a", v) for v in (1, 2, 3, 4, 5)], "k string, v int"), "k", "v").first()
    assert (got["mean"], got["std_dev"], got["p10"], got["p50"], got["p90"]) == (3.0, 1.4, 1, 3, 4)


def test_style_profile(spark):
    got = R.style_profile(docs(spark, "“안녕? 안녕!”\n\n바람처럼 달렸다.", "", None)).orderBy("doc_id").collect()
    r = got[0]
    assert (r["characters"], r["paragraphs"], r["sentences"], r["sentence_p50"], r["tokens"]) == (16, 2, 4, 2, 4)
    assert (r["dialogue_paragraph_share"], r["dialogue_share"], r["short_share"]) == (0.5, 0.5, 1.0)
    assert (r["similes_per_10k"], r["questions_per_10k"], r["exclamations_per_10k"], r["mattr"]) == (625.0, 625.0, 625.0, 0.75)
    for r in got[1:]:
        assert (r["sentences"], r["dialogue_share"], r["sentence_mean"], r["questions_per_10k"], r["mattr"]) == (0, 0.0, 0.0, 0.0, 0.0)


def test_token_overlap_equals_brute_force(spark):
    rng = random.Random(2)
    make = lambda n: [rng.choice("abc") for _ in range(n)]
    source, artifacts = make(30), [make(60) for _ in range(4)]
    artifacts[0][20:45] = source[:25]
    items = spark.createDataFrame([(9, " ".join(source))], "item_id int, text string")
    got = {(r["doc_id"], r["source_pos"], r["artifact_pos"]) for r in O.token_overlap(docs(spark, *map(" ".join, artifacts)), items).collect()}
    want = set()
    for i, a in enumerate(artifacts):
        for p in range(19):
            first = next((q for q in range(len(a) - 11) if a[q : q + 12] == source[p : p + 12]), None)
            if first is not None:
                want.add((i, p, first))
    assert got == want and want


def windows_brute(source, artifact, size=120):
    fine = lambda raw, at: at == len(raw) or raw[at] & 0xC0 != 0x80
    ok = lambda raw, at: fine(raw, at) and fine(raw, at + size)
    return {(s, a) for s in range(len(source) - size + 1) for a in range(len(artifact) - size + 1) if source[s : s + size] == artifact[a : a + size] and ok(source, s) and ok(artifact, a)}


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_byte_windows(spark, monkeypatch, most):
    """With the sources' keys broadcast and shuffled."""
    monkeypatch.setattr(O, "MOST_BROADCAST", most)
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("ab é가") for _ in range(n))
    base = make(300)
    sources = ["가" * 50, base, make(40), make(200) + base[100:180]]
    artifacts = ["x" + "가" * 50, make(50) + base[20:230] + make(70), base, make(90), base[:60], "", None, base[150:] + base[:150]]
    items = spark.createDataFrame(list(enumerate(sources)), "item_id int, text string")
    got = {(r["item_id"], r["doc_id"], r["source_offset"], r["artifact_offset"]) for r in O.window_overlap(docs(spark, *artifacts), items).collect()}
    assert got == {(i, j, s, a) for i, x in enumerate(sources) for j, y in enumerate(artifacts) for s, a in windows_brute(x.encode(), (y or "").encode())} and got


def test_leak_matches(spark):
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choice("abcdé가나") for _ in range(rng.randrange(1, 9))) for _ in range(n))
    source = words(120)
    artifact = "앞 " + source[40:330] + "　뒤 " + words(30)
    items = spark.createDataFrame([(7, source)], "item_id int, text string")
    got = O.leak_matches(docs(spark, artifact, words(60)), items).collect()
    raw, own = source.encode(), artifact.encode()
    assert {r["method"] for r in got} == {O.LONG, O.EXACT} and {r["doc_id"] for r in got} == {0}
    for r in got:
        a, b = raw[r["source_start"] : r["source_end"]], own[r["artifact_start"] : r["artifact_end"]]
        assert hashlib.sha256(a).hexdigest() == r["source_slice_sha256"] and hashlib.sha256(b).hexdigest() == r["artifact_slice_sha256"]
        head = "long" if r["method"] == O.LONG else "tokens"
        key = f"{head}:7:{r['source_start']}:{r['artifact_start']}:{r['source_slice_sha256']}"
        assert r["match_id"] == "match-" + hashlib.sha256(key.encode()).hexdigest()[:24]
        assert a.split() == b.split() and (head == "tokens" or a == b)
    first = O.first_matches(O.leak_matches(docs(spark, artifact), items), "doc_id", most=5).orderBy("place").collect()
    assert [r["method"] for r in first] == [O.LONG] * 5 and [r["source_start"] for r in first] == sorted(r["source_start"] for r in first)
    receipts = O.leak_receipts(docs(spark, "x", "y"), spark.createDataFrame([(1, i) for i in range(100)], "doc_id int, at int")).orderBy("doc_id").collect()
    assert [(r["match_count"], r["truncated"], r["status"]) for r in receipts] == [(0, False, "pass"), (100, True, "quarantine")]


def test_leaks_of_few_tokens_show_in_windows(spark):
    """Long words: 120 equal bytes hold fewer than twelve tokens."""
    text = " ".join(c * 40 for c in "가나다라마")
    got = O.leak_receipts(docs(spark, "x" + text), O.leak_matches(docs(spark, "x" + text), spark.createDataFrame([(1, text)], "item_id int, text string"))).first()
    assert got["status"] == "quarantine" and got["match_count"] == 5  # one for each word: others would cut a character


def test_findings(spark):
    candidates = spark.createDataFrame([("c1", "한빛그룹의 김철수 사장은 “푸른 새벽”을 ABx9에서"), ("c2", "아무 말")], "path string, text string")
    samples = spark.createDataFrame([("s1", "한빛 방식으로 김철수는 푸른새벽 abx9"), ("s2", "다른 글")], "ref string, text string")
    got = {(r["rule"], r["term"]) for r in N.findings(candidates, samples, "path", "ref").collect()}
    assert {("quoted-overlap", "푸른새벽"), ("latin-overlap", "abx9"), ("org-stem-overlap", "한빛"), ("surname-overlap", "김철수"), ("person-overlap", "김철수")} <= got
    protected = spark.createDataFrame([("p", "푸른 새벽")], "name string, term string")
    gates = {r["path"]: r["gate"] for r in N.surface_gate(candidates, samples, protected, "path", "ref", "name").collect()}
    assert gates == {"c1": "blocked", "c2": "pass"}


def norm(text):
    return re.sub("[^가-힣a-z0-9]+", "", unicodedata.normalize("NFC", text).lower())


def twin_terms(text):
    """Terms by kind, token by token in plain Python."""
    from veriloom.functions import korean as K

    longest = lambda words: sorted(words, key=lambda w: -len(w))
    text = unicodedata.normalize("NFC", text)
    found = [(m[0], m.start(), m.end()) for m in re.finditer("[가-힣A-Za-z0-9_-]+", text)]
    out = set()

    def base_of(token, least=2):
        plain = re.sub("[^가-힣a-z0-9]+", "", token.lower())
        for ending in longest(K.ENDINGS):
            if plain.endswith(ending) and len(plain) - len(ending) >= least:
                return plain[: -len(ending)]
        return plain

    def is_role(token):
        bare = base_of(token, 1)
        for h in longest(K.HONORIFICS):
            if bare.endswith(h) and len(bare) > len(h):
                if bare[: -len(h)] in [*K.ROLES, *K.HONORIFICS]:
                    return True
        return bare in [*K.ROLES, *K.HONORIFICS]

    surname = lambda w: re.fullmatch(f"[{K.SURNAMES}][가-힣]{{1,3}}", w) and w not in K.ONTOLOGY
    for i, (raw, _, end) in enumerate(found):
        hangul = re.search("[가-힣]", raw)
        plain = re.sub("[^가-힣a-z0-9]+", "", raw.lower())
        base = base_of(raw) if hangul else plain
        if len(base) >= 2:
            out.add(("exact", base))
        if surname(base):
            out.add(("surname", base))
        if base.endswith("이") and surname(base[:-1]):
            out.add(("surname", base[:-1]))
        if re.fullmatch("[A-Za-z][A-Za-z0-9_-]+", raw) and (re.search("[0-9_-]", raw) or re.search("[A-Z].*[A-Z]", raw) or re.search("[a-z][A-Z]", raw)):
            out.add(("latin", plain))
        for role in longest([*K.ROLES, *K.HONORIFICS]):
            if base.endswith(role) and re.fullmatch("[가-힣]{2,4}", base[: -len(role)]):
                out |= {("anchored", base[: -len(role)]), ("person", base[: -len(role)])}
                break
        near = [found[j][0] for j in (i - 1, i + 1) if 0 <= j < len(found)]
        if re.fullmatch("[가-힣]{2,4}", base) and surname(base) and any(map(is_role, near)):
            out.add(("person", base))
        for company in longest(K.ORGANIZATIONS):
            if base.endswith(company):
                stem = base[: -len(company)]
                if re.fullmatch("[가-힣a-z0-9_-]{2,20}", stem):
                    out |= {("org_stem", stem), ("org_full", base), ("exact", base)}
                break
        after = found[i + 1] if i + 1 < len(found) else None
        spaced = after and re.fullmatch(r"[\t\u0020\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]+", text[end : after[1]])
        following = base_of(after[0]) if after else ""
        stem_like = re.fullmatch("[가-힣a-z0-9_-]{2,20}", base)
        if spaced and stem_like and following in K.ORGANIZATIONS:
            out |= {("org_stem", base), ("org_full", base + following), ("exact", base + following)}
        if stem_like and ((plain.endswith("의") and plain != base) or (spaced and following in K.ATTRIBUTIONS)):
            out.add(("attribution", base))
    for m in re.finditer(N.QUOTED, text):
        if len(norm(m[1])) >= 2:
            out.add(("quoted", norm(m[1])))
    return out


SENTENCES = [
    "한빛그룹의 김철수 사장은 “푸른 새벽”을 ABx9에서", "한빛 방식으로 김철수는 푸른새벽 abx9", "박영희이 회장님과 최 전무가 만났다", "대한 은행의 이사 정민수사장님께서", "한빛 그룹에서 「달빛 검」과 x_1", "전략의 문화, 김철수가 아닌 김철수씨",
    "ABC-1 ab Ab aB", "가나다라재단 이야기", unicodedata.normalize("NFD", "한빛그룹의 김철수 사장은 “푸른 새벽”"), "", "이민수　사장 그리고 오세훈 시장",
]


def test_surface_terms_equal_a_plain_twin(spark):
    rng = random.Random(12)
    words = [w for t in SENTENCES for w in re.findall("[가-힣A-Za-z0-9_-]+", t)] + ["사장", "회장님", "그룹", "방식", "의", "은행"]
    texts = SENTENCES + [rng.choice([" ", "\t", ", "]).join(rng.choice(words) for _ in range(rng.randrange(1, 14))) for _ in range(120)]
    got = {}
    for r in N.surface_terms(docs(spark, *texts), "doc_id").collect():
        got.setdefault(r["doc_id"], set()).add((r["kind"], r["term"]))
    for i, text in enumerate(texts):
        assert got.get(i, set()) == twin_terms(text), text


def test_findings_equal_a_plain_twin(spark):
    texts = {f"t{i}": t for i, t in enumerate(SENTENCES)}
    half = {k: v for k, v in texts.items() if int(k[1:]) % 2 == 0}
    rest = {k: v for k, v in texts.items() if int(k[1:]) % 2}
    want = set()
    for c, x in half.items():
        for s, y in rest.items():
            a, b = twin_terms(x), twin_terms(y)
            of = lambda terms, *kinds: {t for k, t in terms if k in kinds}
            want |= {("person-overlap", t, c, s) for t in (of(a, "exact", "anchored") & of(b, "person")) | (of(a, "person") & of(b, "exact"))}
            want |= {("surname-overlap", t, c, s) for t in of(a, "surname") & of(b, "surname")}
            stems = (of(b, "org_stem") & of(a, "exact", "anchored", "org_stem", "attribution")) | (of(a, "org_stem") & of(b, "exact", "org_stem", "attribution"))
            want |= {("org-stem-overlap", t, c, s) for t in stems}
            for kind in N.SHAPES:
                shared = {t for t in of(a, kind) if len(t) >= 2 and t in norm(y)} | {t for t in of(b, kind) if len(t) >= 2 and t in norm(x)}
                want |= {(f"{kind}-overlap", t, c, s) for t in shared}
    frames = [spark.createDataFrame(list(d.items()), "name string, text string") for d in (half, rest)]
    found = N.findings(frames[0].withColumnRenamed("name", "c"), frames[1].withColumnRenamed("name", "s"), "c", "s").collect()
    pairs = {(r, t) for r, t, _, _ in want}
    assert {(r["rule"], r["term"]) for r in found} == pairs and pairs
    for r in found:
        assert r["locations"] == sorted({c for x, t, c, _ in want if (x, t) == (r["rule"], r["term"])}) and r["references"] == sorted({s for x, t, _, s in want if (x, t) == (r["rule"], r["term"])})


def test_texts_get_their_normal_form_once(spark):
    texts = docs(spark, "Xy7 김사장", "nothing")
    steps = lambda df: df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")
    assert steps(N.surface_terms(texts, "doc_id")) == 0  # they are written, over as many tasks as a shuffle has
    assert steps(O.grams(texts, "doc_id", "text", 2, T.surface_tokens)) == 1
    held = O.term_containment(texts, spark.createDataFrame([(1, "xy7")], "r int, term string"), "doc_id", "r")
    assert steps(held) == 1 and [(r["doc_id"], r["r"]) for r in held.collect()] == [(0, 1)]


def test_findings_make_no_pairs(spark):
    many = docs(spark, *["김민수 회장 iPhone7"] * 300)
    found = {(r["rule"], r["term"]): (len(r["locations"]), r["references"]) for r in N.findings(many, many.withColumnRenamed("doc_id", "item_id"), "doc_id", "item_id").collect()}
    assert found["latin-overlap", "iphone7"] == (300, list(range(300))) and found["person-overlap", "김민수"][0] == 300
    plan = N.findings(many, many.withColumnRenamed("doc_id", "item_id"), "doc_id", "item_id")._jdf.queryExecution().optimizedPlan().toString()
    assert not any("doc_id#" in line and "item_id#" in line for line in plan.splitlines() if "Union" not in line and "Relation" not in line)


def test_findings_past_what_is_broadcast_and_over_line_ends(spark):
    """A line feed between two words isn't a blank; terms met by shuffles are those met within the scan."""
    texts = docs(spark, *SENTENCES, "한빛 \n그룹", "새별 은행", "KİX9 한빛")
    samples = texts.withColumnRenamed("doc_id", "item_id")
    stems = {(r["doc_id"], r["term"]) for r in N.surface_terms(texts, "doc_id").where("kind = 'org_stem'").collect()}
    assert (len(SENTENCES), "한빛") not in stems and (len(SENTENCES) + 1, "새별") in stems
    for made in (N.findings, N.overlaps):
        rows = lambda **more: sorted(map(repr, made(texts, samples, "doc_id", "item_id", **more).collect()))  # noqa: B023, E731
        assert rows(most=0) == rows() != []


def test_surface_terms_without_a_dictionary(spark):
    """Past the most tokens that are broadcast, forms are derived in place."""
    texts = docs(spark, *SENTENCES)
    ordered = lambda most: sorted(map(tuple, N.surface_terms(texts, "doc_id", most_tokens=most).collect()))
    assert ordered(0) == ordered(1000)


@pytest.mark.parametrize("most", [1 << 20, 7, 1])
def test_terms_in_shards_of_automata(spark, most):
    rng = random.Random(4)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 6))) for _ in range(40)}
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 60))) for _ in range(30)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    wanted = spark.createDataFrame([(t,) for t in sorted(terms)], "term string")
    got = O.held_terms(rows, wanted, "id", "text", most).collect()
    assert sorted(map(tuple, got)) == sorted((i, t) for i, x in enumerate(texts) for t in terms if t in x)
    assert O.held_terms(rows, wanted.limit(0), "id", "text", most).collect() == []


def test_gate_by_place_leaves_blocked_candidates_without_findings(spark):
    bodies = {"c1": '{"a": ["x", "한빛그룹의 김철수 사장"], "b": {"c": "푸른 새벽"}}', "c2": '{"a": ["한빛그룹", {"k-1": "한빛그룹 그리고"}], "n": 3}', "c3": '{"z": "아무 말"}', "c4": '"one two three four five six"', "c5": "{}"}
    candidates = spark.createDataFrame(list(bodies.items()), "path string, doc string")
    samples = spark.createDataFrame([("s1", "한빛그룹 김철수"), ("s2", "zero one two three four five")], "ref string, text string")
    protected = spark.createDataFrame([("p", "푸른 새벽")], "name string, term string")
    strings = N.candidate_strings(candidates, "path", "doc")
    blockers, found = N.gate_report(strings, samples, protected, "path", "ref", "name")
    assert sorted(map(tuple, blockers.collect())) == [("c1", N.IDENTITY_RULE, "$.b.c", "p"), ("c4", N.COPY_RULE, "$", "s2")]
    rows = {(r["path"], r["rule"], r["term"]): (r["locations"], r["references"]) for r in found.collect()}
    assert rows[("c2", "org_full-overlap", "한빛그룹")] == (["$.a[0]", "$.a[1].k-1"], ["s1"]) and {k[0] for k in rows} == {"c2"}
    gates = {r["path"]: (r["blockers"], r["findings"] > 0, r["gate"]) for r in N.surface_gate(candidates, samples, protected, "path", "ref", "name", strings=strings).collect()}
    assert gates == {"c1": (1, False, "blocked"), "c2": (0, True, "pending_semantic_review"), "c3": (0, False, "pass"), "c4": (1, False, "blocked"), "c5": (0, False, "pass")}


def test_blockers_of_one_pass_are_those_of_each_rule(spark):
    """One pass over the strings for both rules: a stage of its own for a rule would join the strings' grams."""
    rng = random.Random(8)
    words = ["One", "two", "x_1", "a-b", "İz", "가나", "Peru", unicodedata.normalize("NFD", "다라")]
    texts = [rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(0, 30))) for _ in range(60)]
    strings = spark.createDataFrame([(i, "$", x) for i, x in enumerate([*texts, None, "pe-RU"])], "doc_id int, location string, text string")
    samples = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(9))) for i in range(40)], "item_id int, text string")
    protected = spark.createDataFrame([(1, "Peru"), (2, "가나 다라"), (3, "x"), (4, None)], "n int, term string")
    rows = lambda **more: sorted(map(tuple, N.surface_blockers(strings, samples, protected, "doc_id", "item_id", "n", **more).collect()))
    assert rows(most=0) == rows() and {r[1] for r in rows()} == {N.COPY_RULE, N.IDENTITY_RULE} and (61, N.IDENTITY_RULE, "$", "1") in rows()


def test_decomposed_hangul_matches(spark):
    rows = spark.createDataFrame([(1, unicodedata.normalize("NFD", "한빛 그룹의 약속"))], "id int, text string")
    got = O.term_containment(rows, spark.createDataFrame([("t", "한빛그룹")], "ref string, term string"), "id", "ref").collect()
    assert [r["term"] for r in got] == ["한빛그룹"]


def next_fit(costs, target):
    parts, part, total = [], 0, 0
    for c in costs:
        if part and total + c <= target:
            total += c
        else:
            part, total = part + 1, c
        parts.append(part)
    return parts


def test_next_fit(spark):
    rng = random.Random(7)
    groups = {g: [rng.choice([0, 5, 30, 200]) for _ in range(rng.randrange(1, 60))] for g in range(8)}
    rows = spark.createDataFrame([(g, i, c) for g, cs in groups.items() for i, c in enumerate(cs)], "g int, i long, c long")
    packed = P.next_fit(rows, "g", "i", "c", 100)
    got = {(r["g"], r["i"]): r["part"] for r in packed.collect()}
    assert got == {(g, i): p for g, cs in groups.items() for i, p in enumerate(next_fit(cs, 100))}
    assert all(r["covered"] for r in P.exact_cover(packed, rows, "g", "part", "i").collect())
    assert {r["g"]: r["covered"] for r in P.exact_cover(packed.where("not (g = 3 and i = 0)"), rows, "g", "part", "i").collect()} == {g: g != 3 for g in groups}


def test_next_fit_of_one_group_over_many_tasks(spark):
    rng = random.Random(8)
    costs = [rng.choice([0, 0, 1, 9, 40, 101, None]) for _ in range(2500)]
    rows = spark.createDataFrame([(None, f"{i:05}", c) for i, c in enumerate(costs)] + [("other", "a", 500)], "g string, i string, c int")
    packed = P.next_fit(rows, "g", "i", "c", 100)
    got = {r["i"]: r["part"] for r in packed.where("g is null").collect()}
    assert [got[f"{i:05}"] for i in range(2500)] == next_fit([c or 0 for c in costs], 100)
    assert packed.where("g is not null").first()["part"] == 1
    assert P.next_fit(rows.limit(0), "g", "i", "c", 100).collect() == []


def test_greedy_by_the_cost_of_whole_parts(spark):
    rng = random.Random(3)
    words = {g: ["x" * rng.choice([1, 3, 8, 30, 70]) for _ in range(rng.randrange(1, 80))] for g in (1, 2, None, 5)}

    def cost(part):  # not additive: what repeats is free; long parts have none
        return None if len(part) > 9 else len(json.dumps(sorted(set(part))))

    want = {}
    for g, items in words.items():
        part, i = 0, 0
        while i < len(items):
            n = max((k for k in range(1, len(items) - i + 1) if (c := cost(items[i : i + k])) is not None and c <= 60), default=0)
            part += n > 0
            want |= {(g, k): (part, None) if n else (None, "fits-no-part") for k in range(i, i + max(n, 1))}
            i += max(n, 1)
    rows = spark.createDataFrame([(g, i, w) for g, ws in words.items() for i, w in enumerate(ws)], "g int, i long, w string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r["g"], r["i"]): (r["part"], r["error"]) for r in P.greedy_by_cost(rows, "g", "i", "w", 60, cost).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_budgets(spark):
    got = spark.range(1).select(*P.context_budget(F.lit(100)), P.input_gate(F.lit(380_000)), P.input_gate(F.lit(380_001))).first()
    assert tuple(got) == (16_384 + 50 + 48_000, True, True, False)
    assert docs(spark, 'a"b\n', "😀").select(P.encoded_length("text")).collect() == [(8,), (4,)]


def test_intervals(spark):
    arcs = spark.createDataFrame([(1, "b", 2, 5, 4), (1, "a", 1, 3, 3), (1, "c", 8, 7, 0)], "w int, arc string, s long, e long, n long")
    points = spark.createDataFrame([(1, i) for i in range(1, 8)], "w int, seq long")
    first = {r["seq"]: r["arc"] for r in E.first_interval(points, arcs.withColumn("o", F.ascii("arc") * -1), "w", "seq", "s", "e", "o", "arc").collect()}
    last = {r["seq"]: r["arc"] for r in E.last_interval(points, arcs, "w", "seq", "s", "e", "arc").collect()}
    assert first == {1: "a", 2: "b", 3: "b", 4: "b", 5: "b", 6: None, 7: None} and last == first
    rules = sorted(r["rule"] for r in E.tiling(arcs, "w", "s", "e", "n", "arc").collect())
    assert rules == ["interval-end", "interval-start", "interval-start"]


def test_coverage(spark):
    rows = spark.createDataFrame([("ok", 0, 0, 5, 9), ("ok", 1, 5, 9, 9), ("gap", 0, 0, 4, 9), ("gap", 1, 5, 9, 9), ("short", 0, 0, 5, 9)], "g string, i int, s int, e int, size int")
    assert {r["g"]: r["covered"] for r in E.full_coverage(rows, "g", "s", "e", "i", "size").collect()} == {"ok": True, "gap": False, "short": False}
    assert all(r["sorted_apart"] for r in E.partial_coverage(rows, "g", "s", "e", "i").collect())


def test_scales_and_scores(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (0.4, 0.6), (40.0, 60.0), (0.5, 7.0), (None, 1.0), (0.4, 0.4)], "a double, b double")
    both = [F.col("a"), F.col("b")]
    got = rows.select(E.row_scale(both).alias("s")).withColumn("i", F.monotonically_increasing_id()).collect()
    assert [r["s"] for r in got] == ["intensity", "ratio", "percentage", "invalid", "non-numeric", "ratio"]
    flat = spark.createDataFrame([("f", 5.0)] * 20 + [("b", 11.0)] * 20, "g string, s double")
    assert {r["g"]: r["verdict"] for r in E.score_shape(flat, "g", "s").collect()} == {"f": "flat", "b": "out-of-range"}
    one = spark.range(1).select(G.commercial_score([F.lit(90)] * 5, [F.lit(80)] * 3), G.commercial_score([F.lit(101)] * 5, [F.lit(80)] * 3)).first()
    assert tuple(one) == (87.0, None)


def test_modal_value(spark):
    rows = spark.createDataFrame([("g", i, v) for i, v in enumerate(["x", " y ", "y", "x", "", None, "y", "x", "y", "x"])], "g string, i int, v string")
    got = E.modal_value(rows, "g", "v", "i").first()
    assert (got["value"], got["count"], got["warned"]) == ("x", 4, False)


def test_band_sample(spark):
    rows = [("w", "early", f"s{i}", 0, 10 + i, k) for i, k in enumerate(["a", "a", "a", "b", "a"])]
    got = G.band_sample(spark.createDataFrame(rows, "w string, band string, sel string, s int, e int, k string"), "w", "band", "sel", "s", "e", "k").orderBy("pick").collect()
    assert [r["sel"] for r in got] == ["s0", "s3", "s1"]


def test_promotion(spark):
    rows = spark.createDataFrame([("a", 1, 3.0, 90.0, 0), ("a", 2, 2.0, 85.0, 0), ("a", 3, -1.0, 84.0, 0), ("b", 1, 3.0, 90.0, 1)], "g string, p int, gain double, score double, leaks int")
    assert {r["g"]: r["eligible"] for r in G.promotion(rows, "g", "p", "gain", "score", "leaks").collect()} == {"a": True, "b": False}


def chain_twin(texts, budget):
    """The reads that files in order demand, and the whole transcript, in plain Python."""
    dumps = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    cursor = lambda n, h, i: "cursor-" + sha("\0".join([I.CURSOR, n, h, str(i)]))
    name = lambda n: f"input-{n + 1:03d}"
    parts = []
    for text in texts:
        chunks, now = [], ""
        for c in text:
            if len(dumps(now + c)) > budget:
                chunks.append(now)
                now = ""
            now += c
        parts.append(chunks + [now] if now or not text else chunks)
    rows, messages, expected = [], [], None
    for f, chunks in enumerate(parts):
        for i, content in enumerate(chunks):
            if i + 1 < len(chunks):
                following = (name(f), cursor(name(f), sha(texts[f]), i + 1))
            else:
                following = (name(f + 1), cursor(name(f + 1), sha(texts[f + 1]), 0)) if f + 1 < len(texts) else (None, None)
            payload = {"schemaVersion": A.READ_RESULT, "inputId": name(f), "sha256": sha(texts[f]), "sizeBytes": len(texts[f].encode()), "chunkIndex": i, "chunkCount": len(chunks), "chunkSha256": sha(content), "nextInputId": following[0], "nextCursor": following[1], "content": content}
            rows.append((len(rows) + 1, name(f), expected, sha(content), *following))
            call = f"call-{len(rows):04d}-" + "0" * 128
            arguments = {"inputId": name(f)} if expected is None else {"inputId": name(f), "cursor": expected}
            messages += [{"role": "assistant", "finish_reason": "tool_calls", "compacted": 0, "tool_calls": [{"id": call, "function": {"name": A.READ_TOOL, "arguments": dumps(arguments)}}]}, {"role": "tool", "tool_call_id": call, "tool_name": A.READ_TOOL, "compacted": 0, "content": dumps(payload)}]
            expected = following[1]
    return rows, len(dumps(messages).encode())


def test_chunk_chain_and_transcript(spark):
    rng = random.Random(6)
    groups = {g: ["".join(rng.choice('ab"\\\n\t\x01é가😀') for _ in range(rng.choice([0, 5, 60]))) for _ in range(rng.randrange(1, 4))] for g in range(6)}
    files = spark.createDataFrame([(g, i, t) for g, ts in groups.items() for i, t in enumerate(ts)], "g int, i int, text string")
    chain = A.chunk_chain(files, "g", "i", "text", 20)
    sizes = {r["g"]: (r["chunks"], r["transcript_bytes"]) for r in A.transcript_bytes(chain, "g").collect()}
    got = chain.orderBy("g", "at").collect()
    for g, texts in groups.items():
        rows, size = chain_twin(texts, 20)
        assert [(r["at"], r["input_id"], r["cursor"], r["chunk_sha256"], r["next_input_id"], r["next_cursor"]) for r in got if r["g"] == g] == rows
        assert sizes[g] == (len(rows), size)


def test_replay(spark):
    chain = A.chunk_chain(docs(spark, "abcdefg", "hi").withColumn("g", F.lit(1)), "g", "doc_id", "text", 5)
    good = chain.select("g", "at", "input_id", "cursor", "chunk_sha256")
    assert [r["state"] for r in A.replay(good, chain, "g", "at").collect()] == ["ok"] * 4
    assert sorted(r["state"] for r in A.replay(good.where("at <> 2"), chain, "g", "at").collect()) == ["missing", "ok", "wrong-cursor", "wrong-input"]


def test_csv_cases(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes('\ufeffa,b,c\r\n1,"x, y","say ""hi"""\r\n2,"two\nlines"\r\n,,\r\n\r\n\n3,a"b,c"d,"",e'.encode())
    got = I.csv_rows(spark, str(path), ["a", "b", "c"]).collect()
    assert sorted(tuple(r) for r in got) == [("", "", ""), ("1", "x, y", 'say "hi"'), ("2", "two\nlines", ""), ("3", "ab,cd", "")]  # rows have no order across tasks
    assert [(r["row_no"], r["rule"]) for r in I.csv_shape_violations(spark, str(path), ["a", "b", "c"]).orderBy("row_no").collect()] == [(2, "cell-count"), (4, "cell-count")]
    assert I.csv_header_matches(spark, str(path), ["a", "b", "c"]) and not I.csv_header_matches(spark, str(path), ["a", "b"])
    assert I.parse_csv("") == [] and I.parse_csv("a") == [["a"]] and I.parse_csv("a,") == [["a", ""]] and I.parse_csv('""\n,') == [["", ""]]
    path.write_text('a,b\n1,"open')
    with pytest.raises(Exception, match="unclosed"):
        I.csv_rows(spark, str(path), ["a", "b"]).collect()


def test_files_and_publishing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("가나", encoding="utf-8")
    (tmp_path / "in" / "b.txt").write_bytes(b"\xff")
    rows = I.whole_texts(spark, str(tmp_path / "in")).orderBy("path").collect()
    assert [(r["size_bytes"], r["is_utf8"]) for r in rows] == [(6, True), (1, False)]
    data = docs(spark, "x", "y")
    path = I.publish(data, str(tmp_path), "out", F.col("text"))
    assert I.publish(data, str(tmp_path), "out", F.col("text")) == path and spark.read.parquet(path).count() == 2
    both = I.publish_with_receipt(data, spark.range(1), str(tmp_path), "pack", F.col("text"))
    assert spark.read.json(both[1]).first()["data_path"] == both[0]
    assert I.publish_with_receipt(data.orderBy("text"), spark.range(1), str(tmp_path), "pack", F.col("text")) == both
    with pytest.raises(FileExistsError):
        I.publish_with_receipt(data, spark.range(2), str(tmp_path), "pack", F.col("text"))
    assert I.rows_digest(data, F.col("text")) != I.rows_digest(data.union(data), F.col("text")) == I.rows_digest(data.union(data).repartition(3), F.col("text"))
    I.write_lines(data, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 2
    (tmp_path / "bad.json").write_text("{nope")
    assert I.json_documents(spark, str(tmp_path / "bad.json"), "a int", tolerant=True).count() == 0


def test_slices_and_chunks(spark):
    rows = docs(spark, "가나다").select("doc_id", F.encode("text", "UTF-8").alias("d"), F.lit(3).alias("s"), F.lit(6).alias("e"), F.sha2(F.lit("나"), 256).alias("h"))
    assert I.proven_slices(rows, "d", "s", "e", "h").first()["proven"]
    assert not I.proven_slices(rows.withColumn("e", F.lit(5)), "d", "s", "e", "h").first()["proven"]
    got = I.chunks(docs(spark, 'ab"c\n'), "doc_id", "text", 5).orderBy("idx").collect()
    assert [r["chunk"] for r in got] == ["ab", '"c', "\n"]
    assert I.split_by_budget("😀😀😀", 5) == ["😀😀😀"] and I.split_by_budget("", 5) == [""]
    assert got[1]["cursor"] == "cursor-" + hashlib.sha256("\0".join([I.CURSOR, "0", hashlib.sha256(b'ab"c\n').hexdigest(), "1"]).encode()).hexdigest()
    with pytest.raises(ValueError):
        I.split_by_budget("a\x01", 5)


def test_manifest(spark):
    rows = spark.createDataFrame([("k", " ", "0", "x", "../a", "z"), ("k", "n", "3", "2026-01-01", "a/b", "0" * 64)], "k string, name string, n string, d string, p string, h string")
    got = sorted(r["rule"] for r in I.manifest_violations(rows, "k", ["name"], ["n"], ["d"], ["p"], ["h"]).collect())
    assert got == ["count:n", "date:d", "empty:name", "path:p", "repeated", "sha256:h"]


def test_context_windows(spark):
    from veriloom.operators import windows as X

    assert X.term_ranges("한빛그룹의 한빛, 큰한빛", "한빛") == [(0, 5), (6, 8)]
    assert X.term_ranges("A-bc d", "bcd") == [(2, 6)]
    text = "😀" * 200 + "term" + "가" * 300
    start, end = X.context(text, 200, 204)
    assert len(text[start:end].encode()) <= X.MOST_BYTES and start <= 200 and end >= 204
    rows = docs(spark, " ".join(["term x"] * 20), "nothing").withColumn("w", F.lit("term"))
    got = X.term_windows(rows, "doc_id", "text", "w").collect()
    assert len(got) == 8 and not any(r["complete"] for r in got)
    for r in got:
        assert r["window"].encode()[r["match_start"] : r["match_end"]] == b"term"


def test_selectors(spark):
    index = spark.createDataFrame([("d", 1, 0, 10), ("d", 2, 10, 20)], "doc string, sequence int, start_byte long, end_byte long")
    rows = spark.createDataFrame([("d", "a", [2, 1], []), ("d", "b", [], [(5, 9), (5, 9)]), ("d", "c", [1], [(0, 1)])], "doc string, name string, s array<int>, r array<struct<start_byte:long,end_byte:long>>")
    got = [(r["name"], r["place"], r["start_byte"], r["repeated"]) for r in S.observation_selectors(rows, index, "doc", "name", "s", "r").orderBy("name", "place").collect()]
    assert got == [("a", 1, 0, False), ("a", 2, 10, False), ("b", 1, 5, False), ("b", 2, 5, True)]


def test_manager_checks(spark):
    rows = spark.createDataFrame([("a", "supports", ["x"]), ("a", "supports", ["y"]), ("b", "supports", ["x"]), ("c", "contradicts", ["x", "y"])], "g string, c string, f array<string>")
    assert {r["g"]: r["verdict"] for r in G.phase_verdicts(rows, "g", "c", "f", ["x", "y"]).collect()} == {"a": "supported", "b": "insufficient", "c": "contradicted"}
    sources = spark.createDataFrame([("g", 1, "m"), ("g", 2, "m"), ("g", 3, "n")], "g string, s int, sig string")
    compared = spark.createDataFrame([("g", 1, 2, "distinct-variant"), ("g", 2, 3, "shared-core"), ("g", 2, 3, "shared-core"), ("g", 3, 2, "x")], "g string, l int, r int, v string")
    got = sorted((r["l"], r["r"], r["rule"]) for r in G.comparison_violations(compared, sources, "g", "l", "r", "v", "s", "sig").collect())
    assert got == [(1, 2, "same-mechanism"), (1, 3, "missing-pair"), (2, 3, "repeated-pair"), (3, 2, "unbound-pair")]


def test_arrivals(spark, tmp_path):
    from veriloom.streaming.arrivals import scan_arrivals

    leak = " ".join(f"w{i}" for i in range(20))
    data = spark.createDataFrame([(1, leak), (2, "clean")], "doc_id long, text string")
    data.write.parquet(str(tmp_path / "in"))
    sources = spark.createDataFrame([(9, leak)], "item_id long, text string")
    for _ in range(2):
        scan_arrivals(spark, str(tmp_path / "in"), data.schema, sources, str(tmp_path), str(tmp_path / "check")).awaitTermination(120)
    found = list(tmp_path.glob("receipts-*"))
    assert len(found) == 1
    assert {r["doc_id"]: r["status"] for r in spark.read.parquet(str(found[0])).collect()} == {1: "quarantine", 2: "pass"}


def test_pack_values_are_compared_with_their_type(spark):
    from veriloom.operators import validation as V

    pack = {
        "version": 1, "kind": "reference-transformation-pack", "language": "ko", "source": {"chapterCount": 751, "naturalArcCount": 131}, "phases": [0] * 5,
        "storyRetrieval": {"indexedChapterCount": 751}, "styleRetrieval": {"samples": [0] * 15}, "commercialPolicy": {"similarityPenalty": False, "minimumDistanceScore": None},
    }
    as_text = {**pack, "version": "1", "source": {"chapterCount": "751", "naturalArcCount": "131"}, "storyRetrieval": {"indexedChapterCount": "751"}, "commercialPolicy": {"similarityPenalty": "false", "minimumDistanceScore": None}}
    rows = spark.createDataFrame([("right", json.dumps(pack)), ("text", json.dumps(as_text)), ("real", json.dumps({**pack, "version": 1.0})), ("bad", "{")], "k string, pack string")
    got = {}
    for r in V.pack_violations(rows, "k").collect():
        got.setdefault(r["k"], set()).add(r["rule"])
    assert got["text"] == {"identity", "chapter-count", "arc-count", "indexed-chapters", "similarity-penalty"} and set(got) == {"text", "bad"}
    core = spark.createDataFrame([(v, json.dumps({**V.CORE, "version": v})) for v in (1, 2)] + [(3, json.dumps({**V.CORE, "version": "1"}))], "k int, manifest string")
    told = {(r["k"], r["rule"]) for r in V.manifest_violations(core, "k").collect()}
    assert (1, "other:version") not in told and {(2, "other:version"), (3, "other:version")} <= told


def test_arcs_of_any_length_cover_chapters(spark):
    from veriloom.operators import validation as V

    rng = random.Random(9)
    arcs = [("w", n, f"a{n}", float(s), float(s + rng.randrange(0, 40))) for n, s in enumerate(rng.sample(range(-20, 200), 30))] + [("w", 90, "long", 300.0, 5e9), ("w", 91, "late", 4e9, 4e9), ("x", 92, "other", 1.0, 2.0), ("w", 93, "none", 9.0, 8.0)]
    points = [*range(-30, 260), 300, 301, 10**6, 2 * 10**9 + 1, 4 * 10**9, 5 * 10**9, 5 * 10**9 + 1]
    spans = spark.createDataFrame(arcs, "work string, row_no int, arc_id string, s double, e double")
    rows = spark.createDataFrame([("w", i, float(q)) for i, q in enumerate(points)], "work string, row_no int, sequence_no double")
    want = {}
    for i, q in enumerate(points):
        over = [(s, n, a) for w, n, a, s, e in arcs if w == "w" and s <= q <= e]
        if over:
            want[i] = max(over)[2]
    assert {r["row_no"]: r["expected_arc"] for r in V._covering_arcs(rows, spans, "work").collect()} == want


def test_order_over_ranges(spark):
    from veriloom.operators import ranges as N

    rng = random.Random(2)
    rows = [(g, i, rng.randrange(0, 9)) for g, n in (("a", 700), (None, 300), ("b", 1)) for i in range(n)]
    table = spark.createDataFrame(rows, "g string, i long, v long")
    by = {}
    for g, i, v in rows:
        by.setdefault(g, []).append(v)
    for r in N.numbered(table, "g", ["i"], F.col("v"), "n", "before").collect():
        assert (r["n"], r["before"]) == (r["i"], sum(by[r["g"]][: r["i"]]))
    for r in N.previous(table, "g", ["i"], "v", "p").collect():
        assert r["p"] == (by[r["g"]][r["i"] - 1] if r["i"] else None)
    for r in N.greatest_so_far(table, "g", ["i"], "v", "m").collect():
        assert r["m"] == max(by[r["g"]][: r["i"] + 1])


def test_set_digests_do_not_depend_on_the_order_of_rows(spark):
    rows = [("s", i, f"t{i}", None) for i in range(30)] + [(None, 1, "x", "y")]
    body = lambda i, t, n: json.dumps({"id": i, "n": n, "t": t}, separators=(",", ":"))
    want = {"s": hashlib.sha256(("[" + ",".join(body(i, t, n) for _, i, t, n in rows[:30]) + "]").encode()).hexdigest(), None: hashlib.sha256(f"[{body(1, 'x', 'y')}]".encode()).hexdigest()}
    for mixed in (rows, rows[::-1]):
        table = spark.createDataFrame(mixed, "s string, id int, t string, n string").repartition(3)
        assert {r["s"]: r["sha256"] for r in O.set_digests(table, "s", "id", ["t", "n", "id"]).collect()} == want


def test_work_errors_with_arcs_that_overlap(spark):
    rng = random.Random(5)
    arcs = [(w, i, rng.choice(["a", "b", "c", f"d{i}", None]), str(s), str(s + rng.randint(-1, 9)), "1") for w in range(6) for i in range(8) for s in [rng.randint(1, 20)]]
    rows = [(w, i, rng.choice([str(i), "x", "2.5", str(rng.randint(0, 30))]), rng.choice(["a", "b", "c", "zz", None])) for w in range(6) for i in range(1, 25)]
    works = spark.createDataFrame([(w, 24 + w % 2) for w in range(6)], "work int, marker_count int")
    table = spark.createDataFrame(rows, "work int, row_no int, sequence string, arc_id string")
    spans = spark.createDataFrame(arcs, "work int, row_no int, arc_id string, start_sequence string, end_sequence string, episode_count string")
    got = sorted((r["work"], r["rule"], r["detail"]) for r in V.work_errors(works, table, spans, table).collect() if not r["rule"].startswith("arcs:"))
    want = []
    for name in ("chapters", "pacing"):
        want += [(w, f"{name}:row-count", "24") for w in range(6) if w % 2]
        for w, i, sequence, arc in rows:
            number = None if sequence == "x" else float(sequence)
            want += [(w, f"{name}:sequence", sequence)] * (number != i) + [(w, f"{name}:unknown-arc", arc or "")] * (arc is None or arc not in {a[2] for a in arcs if a[0] == w})
            over = [(int(a[3]), a[1], a[2]) for a in arcs if a[0] == w and number is not None and number % 1 == 0 and int(a[3]) <= number <= int(a[4])]
            if over and (last := max(over, key=lambda x: x[:2])[2]) is not None and last != arc:
                want.append((w, f"{name}:other-arc", sequence))
    assert got == sorted(want)


def test_work_violations_share_their_passes(spark):
    cells = lambda names: spark.range(3).selectExpr("id % 2 work", "id row_no", *[f"cast(id as string) {n}" for n in names])
    chapters, arcs = cells(["sequence", "arc_id", *V.REPEATS["chapters"]]), cells(["arc_id", "start_sequence", "end_sequence", "episode_count", *V.REPEATS["arcs"]])
    pacing = cells(["sequence", "arc_id", "concrete_event", *V.REPEATS["pacing"], *V.SCORES, *V.WEIGHTS])
    found = V.work_violations(spark.range(2).selectExpr("id work", "2 marker_count"), chapters, arcs, pacing)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 30
