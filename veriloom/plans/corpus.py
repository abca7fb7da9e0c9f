"""Segmentation and profiling over `documents`: a source is a work, doc_id the order of its chapters."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence as E
from ..operators import profile as P
from ..operators import segment as S
from .registry import query


def spelled(sql: str) -> str:
    """SQL with @S for the white space class and @TRIM(x) for trimming by it."""
    while (at := sql.rfind("@TRIM(")) >= 0:
        depth, end = 1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}regexp_replace({sql[at + 6 : end - 1]}, '^[@S]+|[@S]+$', '', 'g'){sql[end:]}"
    return sql.replace("@S", T.SPACE)


_LINES = """
l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 line_no from documents),
lb as (select *, coalesce(sum(strlen(line) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0)::bigint start_byte from l)
"""


@query("f1_scanner_tokens", spelled(r"""
with t as (select doc_id, regexp_extract_all(coalesce(text, ''), '[가-힣A-Za-z0-9]+|[^@S]') x from documents)
select doc_id, len(x)::bigint n_tokens, sha256(array_to_string(x, ' ')) tokens_sha256 from t"""))
def f1(t):
    rows = t.documents.select("doc_id", T.scanner_tokens(F.coalesce("text", F.lit(""))).alias("x"))
    return rows.select("doc_id", F.size("x").cast("long").alias("n_tokens"), F.sha2(F.array_join("x", " "), 256).alias("tokens_sha256"))


@query("f2_f3_surface_forms", r"""
with t as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[가-힣A-Za-z0-9_-]+') x, regexp_replace(lower(coalesce(text, '')), '[^가-힣a-z0-9]+', '', 'g') n from documents)
select doc_id, len(x)::bigint n_tokens, sha256(n) norm_sha256 from t""")
def f2(t):
    text = F.coalesce("text", F.lit(""))
    return t.documents.select("doc_id", F.size(T.surface_tokens(text)).cast("long").alias("n_tokens"), F.sha2(T.surface_norm(text), 256).alias("norm_sha256"))


@query("f13_f14_sentence_lengths", spelled(r"""
with s as (select doc_id, unnest(string_split_regex(coalesce(text, ''), '[.!?。！？\n]+')) x from documents),
k as (select doc_id, length(regexp_replace(x, '[@S]+', '', 'g')) n from s where @TRIM(x) <> '')
select doc_id, count(*) sentences, sum(n)::bigint total, max(n)::bigint longest from k group by doc_id"""))
def f13(t):
    rows = t.documents.select("doc_id", F.explode(T.sentences(F.coalesce("text", F.lit("")))).alias("x")).select("doc_id", T.dense_length(F.col("x")).alias("n"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum("n").cast("long").alias("total"), F.max("n").cast("long").alias("longest"))


@query("f15_rounding", """
select l_orderkey, l_linenumber, floor(l_extendedprice * l_discount * 100.0 + 0.5) / 100.0 cents, floor((l_discount - 0.05) * 10.0 + 0.5) / 10.0 tenth from lineitem""")
def f15(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", T.round_half_up(F.col("l_extendedprice") * F.col("l_discount"), 2).alias("cents"), T.round_half_up(F.col("l_discount") - 0.05, 1).alias("tenth"))


@query("f16_f21_ids", """
select doc_id, sha256(coalesce(text, '')) sha256, 'sel-' || substr(sha256(coalesce(source, '') || chr(0) || doc_id), 1, 20) selector_id from documents""")
def f16(t):
    return t.documents.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), T.deterministic_id("sel-", 20, F.coalesce("source", F.lit("")), F.col("doc_id").cast("string")).alias("selector_id"))


@query("f18_dates", """
with t as (select event_id, ts, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') iso from events),
u as (select event_id, ts, iso, case event_id % 5 when 0 then replace(iso, 'T', ' ') when 1 then replace(iso, 'Z', '') when 2 then substr(iso, 1, 10) else iso end given from t)
select event_id, given, case when event_id % 5 >= 3 then epoch_us(date_trunc('millisecond', ts)) // 1000000 end epoch_seconds from u""")
def f18(t):
    k = F.col("event_id") % 5
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    given = F.when(k == 0, F.replace(iso, F.lit("T"), F.lit(" "))).when(k == 1, F.replace(iso, F.lit("Z"), F.lit(""))).when(k == 2, F.substring(iso, 1, 10)).otherwise(iso)
    rows = t.events.select("event_id", given.alias("given"))
    return rows.select("event_id", "given", F.unix_timestamp(T.strict_timestamp(F.col("given"))).alias("epoch_seconds"))


@query("f19_f20_predicates", r"""
with p as (select page_id, regexp_replace(url, '^[a-z]+://', '') path, sha256(regexp_replace(url, '^[a-z]+://', '')) h from pages),
q as (select page_id, path, case page_id % 4 when 0 then upper(h) when 1 then substr(h, 2) when 2 then h || 'a' else h end digest from p)
select page_id, path, length(path) > 0 and not regexp_matches(path, '^/|\\|\x00|//|/$') and not regexp_matches(path, '(^|/)\.\.?(/|$)') safe, page_id % 4 = 3 is_digest from q""")
def f19(t):
    k = F.col("page_id") % 4
    rows = t.pages.select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path")).withColumn("h", F.sha2("path", 256))
    digest = F.when(k == 0, F.upper("h")).when(k == 1, F.substring("h", 2, 64)).when(k == 2, F.concat("h", F.lit("a"))).otherwise(F.col("h"))
    return rows.select("page_id", "path", T.is_safe_path(F.col("path")).alias("safe"), T.is_sha256(digest).alias("is_digest"))


@query("f24_p24_text_clean_up", spelled(r"""
with n as (select doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: i || '|' || x), chr(10)) numbered, text from (select doc_id, coalesce(text, '') "text" from documents))
select doc_id, sha256(@TRIM(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'))) installed, sha256(text) bare from n"""))
def f24(t):
    numbered = F.array_join(F.transform(F.split("text", "\n", -1), lambda x, i: F.concat((i + 1).cast("string"), F.lit("|"), x)), "\n")
    rows = t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", numbered.alias("numbered"))
    return rows.select("doc_id", F.sha2(T.install_form(F.col("text")), 256).alias("installed"), F.sha2(T.without_line_numbers(F.col("numbered")), 256).alias("bare"))


@query("f25_lengths", """
select doc_id, strlen(coalesce(text, ''))::bigint bytes, length(coalesce(text, ''))::bigint points from documents""")
def f25(t):
    text = F.coalesce("text", F.lit(""))
    return t.documents.select("doc_id", F.octet_length(text).cast("long").alias("bytes"), F.length(text).cast("long").alias("points"))


@query("p23_text_checks", """
select doc_id, strlen(coalesce(text, '')) >= 400 long_enough, length(coalesce(text, '')) between 400 and 700 intro_sized, contains(coalesce(text, ''), 'the ') has_section from documents""")
def p23(t):
    found = T.text_checks(F.col("text"), 400, (400, 700), ["the "])
    return t.documents.select("doc_id", found["long_enough"].alias("long_enough"), found["sized"].alias("intro_sized"), found["has:the "].alias("has_section"))


@query("p1_marked_chapters", spelled(r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) i from documents),
m as (select *, sum(case when regexp_matches(line, '^[A-M]') then 1 else 0 end) over (partition by doc_id order by i) seq from l),
r as (select doc_id, seq, string_agg(line, chr(10) order by i) raw from m group by doc_id, seq),
u as (select *, length(raw) + length(regexp_replace(raw, '[^\x{10000}-\x{10ffff}]', '', 'g')) + 1 units from r),
o as (select *, sum(units) over (partition by doc_id order by seq) upto, max(seq) over (partition by doc_id) most from u),
c as (select doc_id, seq, @TRIM(raw) part, (upto - units)::bigint start_offset, (upto - (seq = most)::int)::bigint end_offset from o where seq > 0)
select doc_id, start_offset, end_offset, seq::bigint "sequence", @TRIM(string_split(part, chr(10))[1]) marker, case when contains(part, chr(10)) then sha256(@TRIM(substr(part, instr(part, chr(10)) + 1))) else sha256('') end prose_sha256 from c"""))
def p1(t):
    rows = S.chapters(t.documents, marker="[A-M]")
    return rows.select("doc_id", F.col("sequence").cast("long").alias("sequence"), "marker", F.sha2("prose", 256).alias("prose_sha256"), "start_offset", "end_offset")


# Lines that begin with A to M become chapter lines of the three forms, or ones that none fits, by their number.
_MARKED = """
k as (select doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents),
mk as (select doc_id, array_to_string(list_transform(ls, lambda l, i: case when not regexp_matches(l, '^[A-M]') then l when i % 5 = 1 then 'ⓚ' || (i % 1000) || '화 ' || l when i % 5 = 2 then 'ⓚ<' || (i % 1000) || '> ' || l
  when i % 5 = 3 then 'ⓚ' || substr(l, 1, 20) || ' ' || (i % 1000) || '화' when i % 5 = 4 then 'ⓚ' || (i % 1000) else 'ⓚ' || replace(l, '화', '') end), chr(10)) txt from k),
ml as (select doc_id, unnest(string_split(txt, chr(10))) line, generate_subscripts(string_split(txt, chr(10)), 1) i from mk),
mb as (select *, coalesce(sum(strlen(line) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint start_byte, case when line like 'ⓚ%' and i % 5 > 0 then (i % 1000)::bigint end chapter_number from ml)
"""


def marked(t):
    number = lambda i: ((i + 1) % 1000).cast("string")
    of = lambda i, r: (i + 1) % 5 == r
    line = lambda l, i: (
        F.when(~l.rlike("^[A-M]"), l).when(of(i, 1), F.concat(F.lit("ⓚ"), number(i), F.lit("화 "), l)).when(of(i, 2), F.concat(F.lit("ⓚ<"), number(i), F.lit("> "), l))
        .when(of(i, 3), F.concat(F.lit("ⓚ"), F.substring(l, 1, 20), F.lit(" "), number(i), F.lit("화"))).when(of(i, 4), F.concat(F.lit("ⓚ"), number(i)))
        .otherwise(F.concat(F.lit("ⓚ"), F.replace(l, F.lit("화"), F.lit(""))))
    )
    return t.documents.select("doc_id", F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), line), "\n").alias("text"))


@query("p2_p3_w5_chapter_index", "with " + _MARKED + """,
n as (select *, max(start_byte + strlen(line)) over (partition by doc_id) size from mb)
select doc_id, row_number() over w "sequence", chapter_number, start_byte, coalesce(lead(start_byte) over w, size)::bigint end_byte from n where chapter_number is not null window w as (partition by doc_id order by i)""")
def p2(t):
    rows = S.chapter_index(marked(t))
    return rows.select("doc_id", F.col("sequence").cast("long").alias("sequence"), F.col("chapter_number").cast("long").alias("chapter_number"), "start_byte", F.col("end_byte").cast("long").alias("end_byte"))


_PROFILE = _MARKED + """,
c as (select doc_id, i, chapter_number n, chapter_number - lag(chapter_number) over (partition by doc_id order by i) step from mb where chapter_number is not null),
x as (select doc_id, count(*) chapters, count(*) filter (step <> 1) gaps, arg_min(n, i) first_number, arg_max(n, i) last_number from c group by doc_id),
y as (select doc_id, count(*) filter (line like 'ⓚ%') marker_lines from mb group by doc_id),
z as (select doc_id, (length(txt) - length(replace(txt, chr(65533), '')))::bigint replacements from mk),
sp as (select doc_id, marker_lines, coalesce(chapters, 0)::bigint chapters, (marker_lines - coalesce(chapters, 0))::bigint unparsed, coalesce(gaps, 0)::bigint gaps, first_number, last_number, replacements from z join y using (doc_id) left join x using (doc_id))
"""


@query("p4_w1_a11_structure_profile", "with " + _PROFILE + """
select *, true utf8_valid, case when chapters > 0 and gaps = 0 and replacements = 0 then 'complete' else 'needs-review' end status from sp""")
def p4(t):
    return S.structure_profile(marked(t))


@query("p5_identity", r"""
with f as (select doc_id, case doc_id % 9 when 0 then null when 1 then lang || source || '_합본.txt' when 2 then lang || '/' || source || '_합본.txt' when 3 then lang || '_' || source || '.txt' else lang || '_x_' || source || '_합본.txt' end title, n_chars from documents),
p as (select *, case when title is null or not title like '%^_합본.txt' escape '^' then 'not-a-corpus-name' when contains(title, '/') then 'unsafe-title' when not coalesce(n_chars >= 1, false) then 'bad-size' when doc_id % 9 = 1 then 'no-author' end problem, split_part(title, '_', 3) author from f)
select doc_id, problem, case when problem is null then 'gdrive-' || doc_id end source_id, case when problem is null then author end author, case when problem is null then 'private_sources/korean_webnovel_corpus/' || author || '/' || title end repo_relative_path from p""")
def p5(t):
    k, join = F.col("doc_id") % 9, lambda *c: F.concat(*[F.lit(x) if x in ("_", "/", "_x_", "_합본.txt", ".txt") else F.col(x) for x in c])
    title = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, join("lang", "source", "_합본.txt")).when(k == 2, join("lang", "/", "source", "_합본.txt")).when(k == 3, join("lang", "_", "source", ".txt")).otherwise(join("lang", "_x_", "source", "_합본.txt"))
    files = t.documents.select("doc_id", F.col("doc_id").cast("string").alias("provider_file_id"), title.alias("title"), F.lit("text/plain").alias("mime_type"), F.col("n_chars").alias("size_bytes"), F.lit("2026-01-02T03:04:05Z").alias("modified_at"))
    return S.corpus_identity(files).select("doc_id", "problem", "source_id", "author", "repo_relative_path")


@query("p6_integrity_hints", "with " + _PROFILE + """
select doc_id, array_to_string(list_filter([case when n_chars * 100 < 100000 then 'suspiciously-small' end, case when replacements > 0 then 'replacement-character' end, case when chapters = 0 then 'chapter-markers-missing' end,
  case when unparsed > 0 then 'chapter-markers-unparsed' end, case when gaps > 0 then 'chapter-sequence-anomaly' end], lambda x: x is not null), ',') hints from sp join documents using (doc_id)""")
def p6(t):
    rows = marked(t).withColumn("s", S.structure(F.col("text"))).join(t.documents.select("doc_id", "n_chars"), "doc_id")
    return rows.select("doc_id", F.array_join(S.integrity_hints(F.col("n_chars") * 100, F.col("s")), ",").alias("hints"))


@query("p8_evidence_spans", spelled(r"""
with t0 as (select doc_id, replace(coalesce(text, ''), '. ', '.' || chr(13)) txt from documents),
l as (select doc_id, unnest(string_split_regex(txt, '[\r\n]')) line, generate_subscripts(string_split_regex(txt, '[\r\n]'), 1) - 1 line_no from t0),
lb as (select *, coalesce(sum(strlen(line) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0)::bigint start_byte from l),
s as (select *, @TRIM(line) span, strlen(line) - strlen(regexp_replace(line, '^[@S]+', '')) lead_ from lb)
select doc_id, line_no::bigint line_no, (start_byte + lead_)::bigint start_byte, (start_byte + lead_ + strlen(span))::bigint end_byte, sha256(span) span_sha256 from s where span <> ''"""))
def p8(t):
    rows = S.evidence_spans(t.documents.select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\r")).alias("text")))
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "start_byte", F.col("end_byte").cast("long").alias("end_byte"), "span_sha256")


@query("s8_line_slices", "with " + _LINES + """
select doc_id, min(start_byte)::bigint start_byte, max(start_byte + strlen(line))::bigint end_byte, sha256(string_agg(line, chr(10) order by line_no)) slice_sha256
from lb where line_no between 1 and 3 group by doc_id having count(*) = 3""")
def s8(t):
    rows = S.line_slice(t.documents, 2, 4)
    return rows.select("doc_id", "start_byte", F.col("end_byte").cast("long").alias("end_byte"), "slice_sha256")


@query("p10_coverage_bands", """
with c as (select source, doc_id, strlen(coalesce(text, ''))::bigint b from documents),
r as (select *, (sum(b) over (partition by source order by doc_id) - b)::bigint s, sum(b) over (partition by source)::bigint size from c)
select source, doc_id, s start_byte, s + b end_byte, case when (2 * s + b) * 3 < size * 2 then 'early' when (2 * s + b) * 3 < size * 4 then 'middle' else 'late' end band from r""")
def p10(t):
    rows = t.documents.select("source", "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("b"))
    rows = E.running_total(rows, "source", "doc_id", "b", 256).withColumnsRenamed({"upto": "e", "whole": "size"}).withColumn("s", F.col("e") - F.col("b"))
    return rows.select("source", "doc_id", F.col("s").alias("start_byte"), F.col("e").alias("end_byte"), S.coverage_band(F.col("s"), F.col("e"), F.col("size")).alias("band"))


@query("w9_survey_windows", "with " + _MARKED + """,
n as (select *, max(start_byte + strlen(line)) over (partition by doc_id) size from mb),
ix as (select doc_id, row_number() over w s, chapter_number, start_byte, coalesce(lead(start_byte) over w, size)::bigint end_byte from n where chapter_number is not null window w as (partition by doc_id order by i)),
c as (select doc_id, count(*) n, greatest(5, ceil(count(*) / 100.0))::bigint k from ix group by doc_id),
p as (select doc_id, i, k, (floor(i * (n - 1) / (k - 1) + 0.5) + 1)::bigint s from c, unnest(range(k)) u(i)),
w as (select p.*, ix.chapter_number, ix.start_byte, least(ix.end_byte, ix.start_byte + 60) e from p join ix using (doc_id, s)),
b as (select w.*, hex(encode(txt)) h from w join mk using (doc_id))
select doc_id, printf('w%02d', i + 1) window_id, s chapter_sequence, chapter_number, start_byte,
  e - (case when e * 2 >= length(h) or substr(h, 2 * e + 1, 1) not in ('8', '9', 'A', 'B') then 0 when substr(h, 2 * e - 1, 1) not in ('8', '9', 'A', 'B') then 1 when substr(h, 2 * e - 3, 1) not in ('8', '9', 'A', 'B') then 2 else 3 end) end_byte,
  case when i = 0 then 'opening' when i = k - 1 then 'ending' else 'distributed-' || i end phase from b""")
def w9(t):
    return S.survey_windows(marked(t), size=60).withColumn("chapter_number", F.col("chapter_number").cast("long"))


@query("w9_survey_picks", """
with n as (select source, 120 * count(*) n, greatest(5, ceil(120 * count(*) / 100.0))::bigint k from documents group by source)
select source, printf('w%02d', i + 1) window_id, (floor(i * (n - 1) / (k - 1) + 0.5) + 1)::bigint chapter_sequence, case when i = 0 then 'opening' when i = k - 1 then 'ending' else 'distributed-' || i end phase from n, unnest(range(k)) u(i)""")
def w9_picks(t):
    return S.survey_picks(t.documents.groupBy("source").agg((F.count("*") * 120).alias("n")), "source")


@query("w7_phases", """
with n as (select source, count(*) n from documents group by source)
select source, i phase, (n * i // 5 + 1)::bigint first_, (n * (i + 1) // 5)::bigint last_ from n, unnest(range(5)) u(i)""")
def w7(t):
    rows = t.documents.groupBy("source").agg(F.count("*").alias("n")).select("source", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("phase"))
    first, last = P.phase_bounds(F.col("n"), F.col("phase"))
    return rows.select("source", "phase", first.cast("long").alias("first_"), last.cast("long").alias("last_"))


@query("w8_phase_samples", """
with oc as (select o_custkey work, o_orderkey arc, count(*) n from orders join lineitem on l_orderkey = o_orderkey group by 1, 2),
ar as (select work, arc, (sum(n) over w - n + 1)::bigint s, (sum(n) over w)::bigint e from oc window w as (partition by work order by arc)),
c as (select work, sum(n)::bigint + 2 n from oc group by 1),
p as (select work, i + 1 phase, n * i // 5 + 1 a, n * (i + 1) // 5 b from c, unnest(range(5)) u(i)),
k as (select work, phase, a, b, 'entry' pos, a at_ from p union all select work, phase, a, b, 'escalation', (a + b) // 2 from p union all select work, phase, a, b, 'payoff', b from p),
f as (select k.*, ar.arc, ar.s, ar.e from k left join ar on ar.work = k.work and at_ between s and e)
select work, phase, pos "position", case pos when 'entry' then greatest(a, coalesce(s, a)) when 'payoff' then least(b, coalesce(e, b)) else at_ end::bigint "sequence", coalesce(arc::varchar, 'unknown') arc from f""")
def w8(t):
    from .evidence import arcs

    own = arcs(t).select("work", "arc", F.col("s").alias("start"), F.col("e").alias("end"), F.col("arc").alias("place"))
    return P.phase_samples(own.groupBy("work").agg((F.max("end") + 2).alias("n")), own, "work")


_SUMMARY = """
select source, floor(avg(v) * 10 + 0.5) / 10 mean, floor(sqrt(greatest(0, avg(v::double * v) - avg(v) * avg(v))) * 10 + 0.5) / 10 std_dev,
  list_sort(list(v))[floor((count(*) - 1) * 0.1)::bigint + 1]::bigint p10, list_sort(list(v))[floor((count(*) - 1) * 0.5)::bigint + 1]::bigint p50, list_sort(list(v))[floor((count(*) - 1) * 0.9)::bigint + 1]::bigint p90
from x group by source"""


@query("a2_a3_length_summary", "with x as (select source, length(coalesce(text, ''))::bigint v from documents) " + _SUMMARY)
def a2(t):
    return P.summary(t.documents.select("source", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("v")), "source", "v")


_WORDS = "[a-zß-ÿ]+"
_MATTR = """
k as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-zß-ÿ]+')) t, generate_subscripts(regexp_extract_all(lower(coalesce(text, '')), '[a-zß-ÿ]+'), 1) - 1 p from documents),
q as (select doc_id, p, coalesce(lag(p) over (partition by doc_id, t order by p), -1) q, count(*) over (partition by doc_id) n from k),
ms as (select doc_id, max(n) n, sum(case when n <= 50 then (q < 0)::int else greatest(0, least(p, n - 50) - greatest(q + 1, p - 49) + 1) end) s from q group by doc_id),
mt as (select doc_id, n tokens, floor((case when n <= 50 then s / n else s / (50.0::double * (n - 49)) end) * 1000.0 + 0.5) / 1000.0 mattr from ms)
"""


@query("a4_w14_mattr", "with " + _MATTR + " select * from mt")
def a4(t):
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(_WORDS), F.lit(0))
    tokens, variety = P.row_mattr(F.col("w"), 50)
    return t.documents.select("doc_id", words.alias("w")).select("doc_id", tokens.alias("tokens"), variety.alias("mattr")).where("tokens > 0")


@query("a5_style_profile", spelled("with " + _MATTR + r""",
b as (select doc_id, @TRIM(coalesce(text, '')) c from documents),
s as (select doc_id, length(regexp_replace(u, '[@S]+', '', 'g')) v from (select doc_id, unnest(string_split_regex(c, '[.!?。！？\n]+')) u from b) where @TRIM(u) <> ''),
p as (select doc_id, length(regexp_replace(u, '[@S]+', '', 'g')) v, regexp_matches(@TRIM(u), '^[“「『"''‘—]') talk from (select doc_id, unnest(string_split_regex(c, '\n[@S]*\n')) u from b) where @TRIM(u) <> ''),
sa as (select doc_id, count(*) sentences, count(*) filter (v <= 18) short, floor(avg(v) * 10 + 0.5) / 10 sentence_mean, floor(sqrt(greatest(0, avg(v::double * v) - avg(v) * avg(v))) * 10 + 0.5) / 10 sentence_std_dev, list_sort(list(v))[floor((count(*) - 1) * 0.1)::bigint + 1] sentence_p10, list_sort(list(v))[floor((count(*) - 1) * 0.9)::bigint + 1] sentence_p90 from s group by doc_id),
pa as (select doc_id, count(*) paragraphs, count(*) filter (talk) spoken, coalesce(sum(v) filter (talk), 0) spoken_characters, list_sort(list(v))[floor((count(*) - 1) * 0.5)::bigint + 1] paragraph_p50 from p group by doc_id),
w as (select doc_id, length(regexp_replace(c, '[@S]+', '', 'g')) n, len(regexp_extract_all(c, 'that|than')) similes, length(c) - length(regexp_replace(c, '[?？]', '', 'g')) questions, length(c) - length(regexp_replace(c, '[!！]', '', 'g')) exclamations from b)
select w.doc_id, n::bigint characters, coalesce(sentences, 0)::bigint sentences, coalesce(sentence_mean, 0) sentence_mean, coalesce(sentence_std_dev, 0) sentence_std_dev, coalesce(sentence_p10, 0)::bigint sentence_p10, coalesce(sentence_p90, 0)::bigint sentence_p90,
  coalesce(paragraphs, 0)::bigint paragraphs, coalesce(paragraph_p50, 0)::bigint paragraph_p50, coalesce(floor(short / sentences * 1000.0 + 0.5) / 1000.0, 0) short_share, coalesce(floor(spoken / paragraphs * 1000.0 + 0.5) / 1000.0, 0) dialogue_paragraph_share,
  case when n > 0 then coalesce(floor(spoken_characters / n * 1000.0 + 0.5) / 1000.0, 0) else 0 end dialogue_share, case when n > 0 then floor(similes * 10000.0::double / n * 100.0 + 0.5) / 100.0 else 0 end similes_per_10k,
  case when n > 0 then floor(questions * 10000.0::double / n * 100.0 + 0.5) / 100.0 else 0 end questions_per_10k, case when n > 0 then floor(exclamations * 10000.0::double / n * 100.0 + 0.5) / 100.0 else 0 end exclamations_per_10k,
  coalesce(tokens, 0)::bigint tokens, coalesce(mattr, 0) mattr
from w left join sa using (doc_id) left join pa using (doc_id) left join mt using (doc_id)"""))
def a5(t):
    rows = P.style_profile(t.documents, simile="that|than", word=_WORDS, window=50)
    return rows.drop("sentence_p50", "paragraph_mean", "paragraph_std_dev", "paragraph_p10", "paragraph_p90")


@query("a23_b4_b6_payload_budgets", """
select source, count(*) n, sum(strlen(coalesce(text, '')))::bigint bytes, sum(ceil(strlen(coalesce(text, '')) / 2.0))::bigint proxy_tokens,
  (16384 + ceil(sum(strlen(coalesce(text, ''))) / 2.0) + 48000)::bigint planned, 16384 + ceil(sum(strlen(coalesce(text, ''))) / 2.0) + 48000 < 272000 within_limit, ceil(sum(strlen(coalesce(text, ''))) / 2.0) <= 190000 within_cap
from documents group by source""")
def a23(t):
    from ..operators.packing import context_budget, input_gate

    size = F.octet_length(F.coalesce("text", F.lit("")))
    rows = t.documents.groupBy("source").agg(F.count("*").alias("n"), F.sum(size).cast("long").alias("bytes"), F.sum(F.ceil(size / 2.0)).cast("long").alias("proxy_tokens"))
    planned, fits = context_budget(F.col("bytes"))
    return rows.withColumns({"planned": planned, "within_limit": fits, "within_cap": input_gate(F.col("bytes"))})
