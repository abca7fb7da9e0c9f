"""Overlap of `documents` (artifacts) with `benchmark` (protected sources)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import overlap as O
from .corpus import spelled
from .registry import query

_GRAMS = spelled(r"""
a as (select doc_id k, regexp_extract_all(coalesce(text, ''), '[가-힣A-Za-z0-9]+|[^@S]') t from documents),
b as (select item_id k, regexp_extract_all(coalesce(text, ''), '[가-힣A-Za-z0-9]+|[^@S]') t from benchmark),
ag as (select k, i - 1 pos, array_to_string(t[i:i + 11], chr(1)) g from a, unnest(range(1, len(t) - 10)) u(i) where len(t) >= 12),
bg as (select k, i - 1 pos, array_to_string(t[i:i + 11], chr(1)) g from b, unnest(range(1, len(t) - 10)) u(i) where len(t) >= 12),
m as (select bg.k item_id, f.k doc_id, bg.pos::bigint source_pos, f.pos::bigint artifact_pos from bg join (select k, g, min(pos) pos from ag where g in (select g from bg) group by k, g) f on f.g = bg.g)
""")


def _tokens(t):
    rows = O.token_overlap(t.documents, t.benchmark)
    return rows.select("item_id", "doc_id", F.col("source_pos").cast("long").alias("source_pos"), F.col("artifact_pos").cast("long").alias("artifact_pos"))


@query("j7_token_overlap", "with " + _GRAMS + " select * from m")
def j7(t):
    return _tokens(t)


# Bytes as hexadecimal digits; artifacts by aligned blocks of 60 bytes, sources by every offset.
_WINDOWS = r"""
hd as (select doc_id, hex(encode(coalesce(text, ''))) h from documents), hb as (select item_id, hex(encode(coalesce(text, ''))) h from benchmark),
bd as (select doc_id, 60 * i at_, substr(h, 120 * i + 1, 120) b from hd, unnest(range(length(h) // 120)) u(i)),
bb as (select item_id, i s, substr(h, 2 * i + 1, 120) b from hb, unnest(range(length(h) // 2 - 59)) u(i) where length(h) >= 240),
hit as (select distinct doc_id, at_, item_id, s from bd join bb using (b)),
bw as (select item_id, doc_id, s - d source_offset, at_ - d artifact_offset, substr(hb.h, 2 * (s - d) + 1, 240) x, substr(hd.h, 2 * (at_ - d) + 1, 240) y, substr(hb.h, 2 * (s - d) + 241, 1) xe, substr(hd.h, 2 * (at_ - d) + 241, 1) ye
  from hit join hd using (doc_id) join hb using (item_id), unnest(range(60)) u(d) where d <= s and d <= at_),
win as (select item_id, doc_id, source_offset, artifact_offset from bw where x = y and length(x) = 240 and substr(x, 1, 1) not in ('8', '9', 'A', 'B') and xe not in ('8', '9', 'A', 'B') and ye not in ('8', '9', 'A', 'B'))
"""


@query("j8_w15_byte_windows", "with " + _WINDOWS + " select item_id, doc_id, source_offset::bigint source_offset, artifact_offset::bigint artifact_offset from win")
def j8(t):
    rows = O.window_overlap(t.documents, t.benchmark)
    return rows.select("item_id", "doc_id", F.col("source_offset").cast("long").alias("source_offset"), F.col("artifact_offset").cast("long").alias("artifact_offset"))


# A token's place in bytes: what comes before it in the text, found by cutting the text at its tokens.
_MATCHES = "with " + _GRAMS + ", " + _WINDOWS + spelled(r""",
tx as (select 'd' side, doc_id k, coalesce(text, '') t from documents where doc_id in (select doc_id from m) union all select 'b', item_id, coalesce(text, '') from benchmark),
pc as (select side, k, unnest(regexp_extract_all(t, '[@S]*(?:[가-힣A-Za-z0-9]+|[^@S])')) piece, generate_subscripts(regexp_extract_all(t, '[@S]*(?:[가-힣A-Za-z0-9]+|[^@S])'), 1) - 1 pos from tx),
pe as (select side, k, pos, sum(strlen(piece)) over (partition by side, k order by pos) e, strlen(regexp_replace(piece, '^[@S]+', '')) n from pc),
tk as (select m.item_id, m.doc_id, (a.e - a.n)::bigint source_start, b.e::bigint source_end, (c.e - c.n)::bigint artifact_start, f.e::bigint artifact_end from m
  join pe a on a.side = 'b' and a.k = m.item_id and a.pos = m.source_pos join pe b on b.side = 'b' and b.k = m.item_id and b.pos = m.source_pos + 11
  join pe c on c.side = 'd' and c.k = m.doc_id and c.pos = m.artifact_pos join pe f on f.side = 'd' and f.k = m.doc_id and f.pos = m.artifact_pos + 11),
al as (select item_id, doc_id, 'long-common-utf8-byte/v1' "method", source_offset::bigint source_start, (source_offset + 120)::bigint source_end, artifact_offset::bigint artifact_start, (artifact_offset + 120)::bigint artifact_end from win
  union all select item_id, doc_id, 'exact-token-sequence/v1', source_start, source_end, artifact_start, artifact_end from tk),
am as (select al.*, sha256(unhex(substr(hb.h, 2 * source_start + 1, 2 * (source_end - source_start)))) source_slice_sha256 from al join hb using (item_id)),
im as (select *, 'match-' || substr(sha256(case when "method" like 'long%' then 'long:' else 'tokens:' end || item_id || ':' || source_start || ':' || artifact_start || ':' || source_slice_sha256), 1, 24) match_id from am)
""")


@query("j7_j8_leak_matches", _MATCHES + " select * from im")
def j7_j8(t):
    return O.leak_matches(t.documents, t.benchmark).drop("artifact_slice_sha256")


@query("g7_leak_receipts", _MATCHES + """, c as (select doc_id, least(count(*), 100)::bigint n from im group by doc_id)
select d.doc_id, coalesce(n, 0)::bigint match_count, coalesce(n, 0) >= 100 truncated, case when coalesce(n, 0) = 0 then 'pass' else 'quarantine' end status from documents d left join c using (doc_id)""")
def g7(t):
    return O.leak_receipts(t.documents, O.leak_matches(t.documents, t.benchmark))


@query("o4_first_matches", _MATCHES + """, o as (select *, row_number() over (partition by doc_id order by item_id, "method" desc, source_start, artifact_start) place from im)
select doc_id, match_id, place from o where place <= 100""")
def o4(t):
    rows = O.first_matches(O.leak_matches(t.documents, t.benchmark), "doc_id")
    return rows.select("doc_id", "match_id", F.col("place").cast("long").alias("place"))


@query("a12_first_occurrence", spelled(r"""
with k as (select doc_id, regexp_extract_all(coalesce(text, ''), '[가-힣A-Za-z0-9]+|[^@S]') t from documents),
e as (select doc_id, unnest(t) token, generate_subscripts(t, 1) - 1 p from k)
select token, count(distinct doc_id) documents, min(p)::bigint first_pos from e group by token"""))
def a12(t):
    # One row for a token of a document, within the row, so that the shuffle moves distinct tokens only.
    rows = t.documents.select("doc_id", F.posexplode(T.scanner_tokens(F.coalesce("text", F.lit("")))).alias("p", "token"))
    return rows.groupBy("token", "doc_id").agg(F.min("p").alias("p")).groupBy("token").agg(F.count("*").alias("documents"), F.min("p").cast("long").alias("first_pos"))


@query("j9_surface_copies", r"""
with a as (select doc_id k, regexp_extract_all(lower(coalesce(text, '')), '[가-힣A-Za-z0-9_-]+') t from documents),
b as (select item_id k, regexp_extract_all(lower(coalesce(text, '')), '[가-힣A-Za-z0-9_-]+') t from benchmark),
ag as (select distinct k, array_to_string(t[i:i + 4], chr(1)) g from a, unnest(range(1, len(t) - 3)) u(i) where len(t) >= 5),
bg as (select distinct k, array_to_string(t[i:i + 4], chr(1)) g from b, unnest(range(1, len(t) - 3)) u(i) where len(t) >= 5)
select distinct ag.k doc_id, bg.k item_id from ag join bg using (g)""")
def j9(t):
    return O.surface_copies(t.documents, t.benchmark, "doc_id", "item_id")


@query("j10_protected_terms", """
with d as (select doc_id, regexp_replace(lower(coalesce(text, '')), '[^가-힣a-z0-9]+', '', 'g') f from documents),
n as (select n_nationkey, regexp_replace(lower(n_name), '[^가-힣a-z0-9]+', '', 'g') term from nation),
r as (select item_id, regexp_replace(lower(text), '[^가-힣a-z0-9]+', '', 'g') term from benchmark)
select doc_id, 'item' kind, item_id reference, term from d join r on contains(f, term) where length(term) >= 2
union all select doc_id, 'nation', n_nationkey, term from d join n on contains(f, term) where length(term) >= 2""")
def j10(t):
    items = t.benchmark.select(F.lit("item").alias("kind"), F.col("item_id").cast("long").alias("reference"), F.col("text").alias("term"))
    nations = t.nation.select(F.lit("nation").alias("kind"), F.col("n_nationkey").cast("long").alias("reference"), F.col("n_name").alias("term"))
    return O.term_containment(t.documents, items.unionByName(nations), "doc_id", "reference", also=("kind",)).select("doc_id", "kind", "reference", "term")


@query("a25_source_set_digest", """
select 'benchmark' name, sha256(string_agg(item_id || ':' || sha256(text), chr(10) order by item_id)) set_sha256 from benchmark""")
def a25(t):
    one = F.struct("item_id", F.concat(F.col("item_id").cast("string"), F.lit(":"), F.sha2("text", 256)).alias("x"))
    rows = t.benchmark.agg(F.array_sort(F.collect_list(one)).alias("xs"))
    return rows.select(F.lit("benchmark").alias("name"), F.sha2(F.array_join(F.transform("xs", lambda x: x["x"]), "\n"), 256).alias("set_sha256"))


# Sets of documents by source, in canonical JSON with keys in order; the table comes in another order.
@query("a25_canonical_set_digests", """
select source, sha256('[' || string_agg('{"doc_id":' || doc_id || ',"lang":' || coalesce('"' || lang || '"', 'null') || ',"text_sha256":"' || sha256(coalesce(text, '')) || '"}', ',' order by doc_id) || ']') sha256 from documents group by source""")
def a25_sets(t):
    rows = t.documents.select("source", "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "lang").orderBy(F.desc("text_sha256"))
    return O.set_digests(rows, "source", "doc_id", ["text_sha256", "lang", "doc_id"])
