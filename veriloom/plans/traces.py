"""Traces: conversations by turn, events with JSON properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nested, text as T
from ..operators import trace as R
from ..sources.files import CURSOR
from .registry import query


@query("w16_turn_shape", """
with x as (select *, lead(role) over (partition by conv_id order by turn) nx from conversations)
select conv_id, arg_min(role, turn) = 'user' starts_right, arg_max(role, turn) = 'assistant' ends_right, count(*) filter (role = 'user' and nx is distinct from 'assistant') unanswered, count(*) n from x group by conv_id""")
def w16(t):
    return R.turn_shape(t.conversations, "conv_id", "turn", "role")


@query("j18_call_result_pairs", """
with c as (select conv_id, turn k, count(*) n from conversations where role = 'user' group by 1, 2), r as (select conv_id, turn - 1 k, count(*) n from conversations where role = 'assistant' group by 1, 2)
select coalesce(c.conv_id, r.conv_id) conv_id, coalesce(c.k, r.k) k, coalesce(c.n, 0)::bigint calls, coalesce(r.n, 0)::bigint results, coalesce(c.n, 0) = 1 and coalesce(r.n, 0) = 1 paired from c full join r on c.conv_id = r.conv_id and c.k = r.k""")
def j18(t):
    calls = t.conversations.where("role = 'user'").select("conv_id", F.col("turn").alias("k"))
    results = t.conversations.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("k"))
    return R.pairing(calls, results, ["conv_id", "k"])


@query("j19_exact_reads", """
select doc_id path, case when doc_id % 7 = 0 then 'not-called' when doc_id % 7 = 1 then 'called-again' when doc_id % 7 = 2 then 'unanswered' when doc_id % 7 = 3 then 'drifted' else 'ok' end state,
  case when doc_id % 7 > 3 then sha256(coalesce(text, '')) end sha256 from documents""")
def j19(t):
    k, text = F.col("doc_id") % 7, F.coalesce("text", F.lit(""))
    docs = t.documents.select(F.col("doc_id").alias("path"), text.alias("content"))
    calls = t.documents.where(k != 0).select(F.col("doc_id").alias("path"), F.explode(F.when(k == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))).alias("n")).select("path", F.concat("n", F.col("path").cast("string")).alias("call_id"))
    numbered = F.array_join(F.transform(F.split(text, "\n", -1), lambda x, i: F.concat((i + 1).cast("string"), F.lit("|"), x)), "\n")
    results = t.documents.where(k != 2).select(F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("call_id"), F.concat(numbered, F.when(k == 3, "x").otherwise("")).alias("answer"))
    return R.exact_reads(docs, calls, results)


# Each source is a group whose documents are files in the order of their ids; the chunks of ASCII budgets are cut as in s9.
_CHAIN = r"""
with recursive f as (select source g, doc_id, coalesce(text, '') t, row_number() over (partition by source order by doc_id) place from documents),
c as (select g, place, unnest(string_split(t, '')) ch, generate_subscripts(string_split(t, ''), 1) i from f where t <> ''),
k as (select g, place, i, case when ch in ('"', '\\', chr(8), chr(9), chr(10), chr(12), chr(13)) then 2 when ord(ch) < 32 then 6 else 1 end cost from c),
u as (select g, place, i, sum(cost) over (partition by g, place order by i) upto from k),
w(g, place, idx, first, last, upto) as (
  select g, place, 0::bigint, 1::bigint, max(i), max(upto) from u where upto <= 3998 group by g, place
  union all
  select w.g, w.place, w.idx + 1, w.last + 1, max(u.i), max(u.upto) from w join u on u.g is not distinct from w.g and u.place = w.place and u.i > w.last and u.upto <= w.upto + 3998 group by w.g, w.place, w.idx, w.last),
ch as (select w.g, w.place, idx, substr(t, first, last - first + 1) content, sha256(t) sha, strlen(t) size from w join f on f.g is not distinct from w.g and f.place = w.place union all select g, place, 0, '', sha256(''), 0 from f where t = ''),
n as (select *, count(*) over (partition by g, place) cnt, row_number() over (partition by g order by place, idx) at_, lead(place) over (partition by g order by place, idx) np, lead(idx) over (partition by g order by place, idx) ni, lead(sha) over (partition by g order by place, idx) nsha from ch),
x as (select *, printf('input-%03d', place) input_id, case when at_ > 1 then 'cursor-' || sha256('@CURSOR' || chr(0) || printf('input-%03d', place) || chr(0) || sha || chr(0) || idx) end cur,
  case when np is not null then printf('input-%03d', np) end next_id, case when np is not null then 'cursor-' || sha256('@CURSOR' || chr(0) || printf('input-%03d', np) || chr(0) || nsha || chr(0) || ni) end next_cur from n)
""".replace("@CURSOR", CURSOR)


def _chain(t):
    return R.chunk_chain(t.documents, "source", "doc_id", "text", 4000)


@query("w17_chunk_chain", _CHAIN + """ select g source, at_ "at", input_id, sha sha256, size::bigint size_bytes, idx::bigint chunk_index, cnt::bigint chunk_count, sha256(content) chunk_sha256, cur "cursor", next_id next_input_id, next_cur next_cursor from x""")
def w17(t):
    return _chain(t).drop("content").withColumns({c: F.col(c).cast("long") for c in ("chunk_index", "chunk_count")})


@query("j23_cursor_replay", _CHAIN + """, y as (select g, at_, case when at_ % 50 = 7 then 'wrong-content' when at_ % 50 = 9 then 'wrong-cursor' when at_ % 50 = 11 then 'wrong-input' else 'ok' end state from x)
select g source, state, count(*) n from y group by 1, 2 union all select g, 'unexpected', 1 from y group by g having true""")
def j23(t):
    chain = _chain(t).drop("content")
    k = F.col("at") % 50
    own = chain.select("source", "at", F.when(k == 11, "input-000").otherwise(F.col("input_id")).alias("input_id"), F.when(k == 9, F.coalesce("next_cursor", F.lit("x"))).otherwise(F.col("cursor")).alias("cursor"), F.when(k == 7, F.col("sha256")).otherwise(F.col("chunk_sha256")).alias("chunk_sha256"))
    own = own.withColumn("chunk_sha256", F.when(k == 7, F.concat(F.lit("x"), "chunk_sha256")).otherwise(F.col("chunk_sha256")))
    extra = chain.groupBy("source").agg((F.max("at") + 1).alias("at")).select("source", "at", F.lit("input-001").alias("input_id"), F.lit(None).cast("string").alias("cursor"), F.lit("").alias("chunk_sha256"))
    return R.replay(own.unionByName(extra), chain, "source", "at").groupBy("source", "state").agg(F.count("*").alias("n"))


# The length of each call and answer, from the lengths of their parts: what JSON escapes once, and what it escapes twice.
@query("b5_transcript_bytes", _CHAIN + r""",
e as (select *, strlen(replace(replace(replace(replace(replace(replace(replace(content, '\', '\\\\'), '"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t'), chr(8), '\\b'), chr(12), '\\f')) + 6 * (length(content) - length(regexp_replace(content, '[\x00-\x07\x0b\x0e-\x1f]', '', 'g'))) twice from x),
p as (select g, strlen('{"role":"assistant","finish_reason":"tool_calls","compacted":0,"tool_calls":[{"id":"","function":{"name":"@TOOL","arguments":"{\"inputId\":\"\"}"}}]}') + length(input_id) + coalesce(length(cur) + strlen(',\"cursor\":\"\"'), 0)
  + strlen('{"role":"tool","tool_call_id":"","tool_name":"@TOOL","compacted":0,"content":"{\"schemaVersion\":\"@RESULT\",\"inputId\":\"\",\"sha256\":\"\",\"sizeBytes\":,\"chunkIndex\":,\"chunkCount\":,\"chunkSha256\":\"\",\"nextInputId\":,\"nextCursor\":,\"content\":\"\"}"}') + length(input_id) + 64 + length(size::varchar) + length(idx::varchar) + length(cnt::varchar) + 64
  + coalesce(length(next_id) + 4, 4) + coalesce(length(next_cur) + 4, 4) + twice + 2 * (6 + greatest(4, length(at_::varchar)) + 128) b from e)
select g source, count(*) chunks, (sum(b) + 2 * count(*) + 1)::bigint transcript_bytes from p group by g""".replace("@TOOL", R.READ_TOOL).replace("@RESULT", R.READ_RESULT))
def b5(t):
    return R.transcript_bytes(_chain(t), "source")


@query("p12_json_leaves", """
select event_id, '$.' || unnest(json_keys(props)) path from events where props is not null""")
def p12(t):
    return nested.flatten(t.events.where("props is not null"), "event_id", "props").select("event_id", "path")


@query("p13_p14_p15_forbidden", r"""
with k as (select event_id, unnest(json_keys(props)) k from events where props is not null)
select event_id, count(*) keys, count(*) filter (regexp_matches(k, '(?i)^(body|text|prose|quote|k)$')) forbidden from k group by event_id""")
def p13(t):
    rows = nested.flatten(t.events.where("props is not null"), "event_id", "props")
    return rows.groupBy("event_id").agg(F.count("key").alias("keys"), F.count_if(F.col("key").rlike("(?i)^(body|text|prose|quote|k)$")).alias("forbidden"))


# Nested documents made from the table; every eleventh doesn't parse. Policies and terms as the fixed values have them.
_NESTED = r"""
d as (select doc_id, case when doc_id % 11 = 0 then '{oops' else json_object('meta', json_object('lang', lang, 'n-chars', n_chars), case when doc_id % 4 = 0 then 'RawText' else 'summary' end, coalesce(text, ''),
  'parts', json_array(json_object('note x', case when doc_id % 7 = 0 then '이 인물은 자폐증이다' else source end, 'excerpt', json_array(1, true, null, case doc_id % 5 when 0 then '폭력 장면은 반드시 삭제' when 1 then '차별 표현 감점은 항상' when 2 then '폭력 장면은 반드시 삭제하지 않는다' else 'x' end))))::varchar end j from documents),
t as (select d.doc_id, regexp_replace(regexp_replace(fullkey, '\."([A-Za-z_][A-Za-z0-9_-]*)"', '.\1', 'g'), '\."([^"]*)"', '["\1"]', 'g') path, key, type, atom, fullkey
  from d, json_tree(case when json_valid(j) then j::json else '1'::json end) where json_valid(j) and fullkey <> '$'),
l as (select doc_id, path, case when fullkey like '%]' then null else key end "key", case when type in ('OBJECT', 'ARRAY') then null when type = 'VARCHAR' then json_extract_string(atom, '$') when type = 'NULL' then 'null' else atom::varchar end leaf, type = 'VARCHAR' is_text from t
  where type not in ('OBJECT', 'ARRAY') or not fullkey like '%]')
"""


def _nested(t):
    k = F.col("doc_id")
    policy = F.when(k % 5 == 0, "폭력 장면은 반드시 삭제").when(k % 5 == 1, "차별 표현 감점은 항상").when(k % 5 == 2, "폭력 장면은 반드시 삭제하지 않는다").otherwise("x")
    text = lambda c: F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"})
    value = lambda c: F.regexp_replace(text(c), r'(?s)^\{"x":(.*)\}$', "$1")
    parts = [
        F.lit('{"meta":{"lang":'), value(F.col("lang")), F.lit(',"n-chars":'), value(F.col("n_chars")), F.when(k % 4 == 0, '},"RawText":').otherwise('},"summary":'), value(F.coalesce("text", F.lit(""))),
        F.lit(',"parts":[{"note x":'), value(F.when(k % 7 == 0, "이 인물은 자폐증이다").otherwise(F.col("source"))), F.lit(',"excerpt":[1,true,null,'), value(policy), F.lit("]}]}"),
    ]
    return t.documents.select("doc_id", F.when(k % 11 == 0, "{oops").otherwise(F.concat(*parts)).alias("j"))


@query("p12_nested_leaves", "with " + _NESTED + """ select doc_id, path, "key", sha256(leaf) leaf, is_text from l""")
def p12_nested(t):
    return nested.flatten(_nested(t), "doc_id", "j").withColumn("leaf", F.sha2("leaf", 256))


@query("p13_p14_p15_document_violations", "with " + _NESTED + r"""
select doc_id, 'raw-bearing-key' rule, path from l where lower("key") in ('body', 'text', 'prose', 'quote', 'excerpt', 'raw', 'rawtext', 'rawprose', 'sourcetext')
union all select doc_id, 'mandatory-policy', path from l where is_text and leaf in ('폭력 장면은 반드시 삭제', '차별 표현 감점은 항상')
union all select doc_id, 'forbidden-term', path from l where is_text and regexp_matches(leaf, '아스퍼거|자폐증')
union all select doc_id, 'broken-document', '$' from d where not json_valid(j)""")
def p13_documents(t):
    return nested.document_violations(_nested(t), "doc_id", "j")


@query("f17_f23_canonical_json", r"""
select event_id, sha256('{' || chr(10) || '  "k": ' || json_extract_string(props, '$.k') || chr(10) || '}' || chr(10)) canonical, sha256('{"k":' || json_extract_string(props, '$.k') || '}') sorted from events where props is not null""")
def f17(t):
    rows = t.events.where("props is not null").select("event_id", T.without_fences(F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).alias("j"))
    return rows.select("event_id", F.sha2(T.canonical_json("j"), 256).alias("canonical"), F.sha2(T.sorted_json("j"), 256).alias("sorted"))
