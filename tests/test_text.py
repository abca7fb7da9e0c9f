"""Micro-fixtures for what the shared tables can't show: Hangul, Unicode blanks, chapters, numbers, JSON."""

from pyspark.sql import functions as F

from veriloom.functions import korean as K
from veriloom.functions import nested
from veriloom.functions import text as T


def values(spark, texts, *columns):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r)[1:] for r in rows.select("i", *columns).orderBy("i").collect()]


def test_scanner_tokens_know_unicode_blanks(spark):
    got = values(spark, ["a b", "가나 ab1!　﻿?", None, ""], T.scanner_tokens(F.col("t")).alias("x"))
    assert [g[0] for g in got] == [["a", "b"], ["가나", "ab1", "!", "?"], [], []]


def test_lengths_and_sentences(spark):
    got = values(spark, ["a😀b　c. d!\n\n e"], T.dense_length(F.col("t")), T.sentences(F.col("t")), F.size(T.paragraphs(F.col("t"))))
    assert got == [(8, ["a😀b　c", "d", "e"], 2)]


def test_dialogue(spark):
    assert values(spark, ["“가”", "가 “나”", "'x", "　「x」"], T.is_dialogue(F.col("t"))) == [(True,), (False,), (True,), (True,)]


def test_rounding(spark):
    rows = spark.sql("select * from values (1.005D, 2), (-0.5D, 0), (0.5D, 0), (2.345D, 1) as v(x, d)")
    assert [r[0] for r in rows.select(F.when(F.col("d") == 2, T.round_half_up(F.col("x"), 2)).when(F.col("d") == 1, T.round_half_up(F.col("x"), 1)).otherwise(T.round_half_up(F.col("x")))).collect()] == [1.0, 0.0, 1.0, 2.3]


def test_strict_forms(spark):
    got = values(spark, ["2026-01-02T03:04:05.678Z", "2026-01-02", "5d", " 1.5 ", "0x10", ""], T.strict_timestamp(F.col("t")).isNotNull(), T.strict_number(F.col("t")))
    assert got == [(True, None), (False, None), (False, None), (False, 1.5), (False, None), (False, None)]


def test_paths(spark):
    assert values(spark, ["a/b.txt", "/a", "a/../b", "a//b", "..", "a\\b", "", "a/"], T.is_safe_path(F.col("t"))) == [(x,) for x in (True, *[False] * 7)]


def test_json_forms(spark):
    got = values(spark, ['```json\n{"b": null, "a": [1]}\n```'], T.canonical_json(T.without_fences(F.col("t"))), T.sorted_json(T.without_fences(F.col("t"))))
    assert got == [('{\n  "b": null,\n  "a": [\n    1\n  ]\n}\n', '{"a":[1],"b":null}')]


def test_nfc(spark):
    assert values(spark, ["한", None], T.nfc(F.col("t"))) == [("한",), (None,)]


def test_json_leaves(spark):
    rows = spark.createDataFrame([(1, '{"b": ["x", {"Text": "y"}], "a": 1}'), (2, None)], "id int, doc string")
    got = sorted((r["path"], r["leaf"]) for r in nested.flatten(rows, "id", "doc").collect())
    assert got == [("$.a", "1"), ("$.b", None), ("$.b[0]", "x"), ("$.b[1].Text", "y")]
    assert [r["path"] for r in nested.forbidden_keys(rows, "id", "doc").collect()] == ["$.b[1].Text"]
    assert [r["path"] for r in nested.forbidden_text(rows, "id", "doc", "^x$").collect()] == ["$.b[0]"]


def test_json_leaves_of_odd_documents(spark):
    docs = ['{"a-b": {"c d": [[], {}, [1.5, "é\\n"]]}, "q\\"r": null}', '"whole"', "[true]", "3", "bad", None, '{"x": 1, "x": {"rawProse": "y"}}']
    rows = spark.createDataFrame(list(enumerate(docs)), "key int, doc string")
    got = sorted((r["k"], r["path"], r["key"], r["leaf"], r["is_text"]) for r in nested.flatten(rows, "key", "doc").collect())
    assert got == [
        (0, "$.a-b", "a-b", None, False), (0, '$.a-b["c d"]', "c d", None, False), (0, '$.a-b["c d"][2][0]', None, "1.5", False), (0, '$.a-b["c d"][2][1]', None, "é\n", True), (0, '$["q\\"r"]', 'q"r', "null", False),
        (1, "$", None, "whole", True), (2, "$[0]", None, "true", False), (6, "$.x", "x", None, False), (6, "$.x.rawProse", "rawProse", "y", True),
    ]


def test_forbidden_keys_and_policies(spark):
    keys = "body text prose quote excerpt raw rawText rawProse sourceText".split()
    rows = spark.createDataFrame([(1, "{" + ",".join(f'"{k.upper()}": [{{"{k}s": 1}}]' for k in keys) + "}")], "id int, doc string")
    assert sorted(r["key"] for r in nested.forbidden_keys(rows, "id", "doc").collect()) == sorted(k.upper() for k in keys)
    texts = ["폭력 묘사는 반드시 삭제한다", "성별 편견은 삭제를 자동으로", "폭력은 반드시 삭제하지 않는다", "반드시 폭력 삭제", "폭력" + "가" * 41 + "항상 금지", "폭력\n반드시 삭제", None]
    assert [g[0] for g in values(spark, texts, nested.states_policy(F.col("t")))] == [True, True, False, False, False, False, False]
    assert [g[0] for g in values(spark, ["이 자폐증은", "가", None], nested.holds_term(F.col("t")))] == [True, False, False]


def test_endings(spark):
    words = ["회사에서는", "김철수가", "나는", "이", "학교", "전략이라고"]
    assert [g[0] for g in values(spark, words, K.token_base(F.col("t")))] == ["회사", "김철수", "나는", "이", "학교", "전략"]


def test_people_and_organisations(spark):
    stem, suffix = K.organization_stem(F.col("t"))
    got = values(spark, ["한빛그룹의", "그룹", "김철수사장은", "사장님", "가재단"], stem, suffix, K.attached_person(F.col("t")), K.is_role(F.col("t")))
    assert got == [("한빛", "그룹", None, False), (None, None, None, False), (None, None, "김철수", False), (None, None, "사장", True), (None, None, None, False)]


def test_latin_identifiers(spark):
    words = ["Abc", "ABc", "aBc", "a_1", "abc", "A", "x9"]
    assert [g[0] for g in values(spark, words, K.latin_identifier(F.col("t")))] == [False, True, True, True, False, False, True]
