"""Surface findings: pages as candidates, benchmark texts as samples, nation names as protected terms."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import korean as K
from ..operators import findings as N
from ..shared import spread, written
from .registry import query

_TOKENS = "k as (select page_id, unnest(regexp_extract_all(coalesce(html, ''), '[가-힣A-Za-z0-9_-]+')) r from pages)"


@query("f8_latin_identifiers", "with " + _TOKENS + r""", f as (select page_id, regexp_replace(lower(r), '[^가-힣a-z0-9]+', '', 'g') term from k where regexp_matches(r, '^[A-Za-z][A-Za-z0-9_-]+$')
  and (regexp_matches(r, '[0-9_-]') or regexp_matches(r, '[A-Z].*[A-Z]') or regexp_matches(r, '[a-z][A-Z]')))
select distinct page_id, term from f where term <> ''""")
def f8(t):
    return N.surface_terms(t.pages, "page_id", "html").where("kind = 'latin'").select("page_id", "term")


@query("f7_quoted_terms", r"""
with q as (select page_id, unnest(regexp_extract_all(coalesce(html, ''), '["“”''‘’『』「」《》〈〉]([^"“”''‘’『』「」《》〈〉\r\n]{2,80})["“”''‘’『』「」《》〈〉]', 1)) x from pages), n as (select page_id, regexp_replace(lower(x), '[^가-힣a-z0-9]+', '', 'g') term from q)
select distinct page_id, term from n where length(term) >= 2""")
def f7(t):
    return N.surface_terms(t.pages, "page_id", "html").where("kind = 'quoted'").select("page_id", "term")


@query("f4_f5_f6_f9_f10_f11_surface_terms")
def f11(t):
    return N.surface_terms(t.documents, "doc_id").groupBy("kind").agg(F.count("*").alias("n"))


_SHAPES = r"""
p as (select page_id k, coalesce(html, '') t from pages), b as (select item_id k, text t from benchmark),
@SIDE(p, pt, pf), @SIDE(b, bt, bf),
m as (select kind, term, pt.k page_id, bf.k item_id from pt join bf on contains(bf.f, term) union select kind, term, pf.k, bt.k from bt join pf on contains(pf.f, term))
"""
_SIDE = r"""
@Bk as (select k, unnest(regexp_extract_all(t, '[가-힣A-Za-z0-9_-]+')) r from @A),
@Bq as (select k, unnest(regexp_extract_all(t, '["“”''‘’『』「」《》〈〉]([^"“”''‘’『』「」《》〈〉\r\n]{2,80})["“”''‘’『』「」《》〈〉]', 1)) r from @A),
@C as (select k, regexp_replace(lower(t), '[^가-힣a-z0-9]+', '', 'g') f from @A),
@B as (select distinct k, kind, term from (
  select k, 'latin' kind, regexp_replace(lower(r), '[^가-힣a-z0-9]+', '', 'g') term from @Bk where regexp_matches(r, '^[A-Za-z][A-Za-z0-9_-]+$') and (regexp_matches(r, '[0-9_-]') or regexp_matches(r, '[A-Z].*[A-Z]') or regexp_matches(r, '[a-z][A-Z]'))
  union all select k, 'quoted', regexp_replace(lower(r), '[^가-힣a-z0-9]+', '', 'g') from @Bq) where length(term) >= 2)"""


def _shapes(candidates: str = "select page_id k, coalesce(html, '') t from pages") -> str:
    sql = _SHAPES.replace("select page_id k, coalesce(html, '') t from pages", candidates)
    for a, b, c in (("p", "pt", "pf"), ("b", "bt", "bf")):
        sql = sql.replace(f"@SIDE({a}, {b}, {c})", _SIDE.replace("@A", a).replace("@B", b).replace("@C", c).strip())
    return sql


@query("j11_a13_shape_overlaps", "with " + _shapes() + """
select kind || '-overlap' rule, term, array_to_string(list_sort(list(distinct page_id)), ',') locations, array_to_string(list_sort(list(distinct item_id)), ',') refs from m group by kind, term""")
def j11_shapes(t):
    items = t.benchmark.withColumnRenamed("text", "html")
    rows = N.findings(spread(t.pages.select("page_id", "html")), items, "page_id", "item_id", "html").where("rule in ('latin-overlap', 'quoted-overlap')")
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return rows.select("rule", "term", text("locations").alias("locations"), text("references").alias("refs"))


@query("j11_j12_j13_j14_findings")
def j11(t):
    return N.findings(spread(t.pages.select("page_id", "html")), t.benchmark.withColumnRenamed("text", "html"), "page_id", "item_id", "html")


_GATE = r""",
g1 as (select k, regexp_extract_all(lower(t), '[가-힣A-Za-z0-9_-]+') t from p), g2 as (select k, regexp_extract_all(lower(t), '[가-힣A-Za-z0-9_-]+') t from b),
h1 as (select distinct k, array_to_string(t[i:i + 4], chr(1)) g from g1, unnest(range(1, len(t) - 3)) u(i) where len(t) >= 5),
h2 as (select distinct k, array_to_string(t[i:i + 4], chr(1)) g from g2, unnest(range(1, len(t) - 3)) u(i) where len(t) >= 5),
n as (select n_nationkey k, regexp_replace(lower(n_name), '[^가-힣a-z0-9]+', '', 'g') term from nation),
bl as (select distinct h1.k, 'copy' rule, h2.k ref from h1 join h2 using (g) union select distinct pf.k, 'name', n.k from pf join n on contains(f, term)),
bc as (select k, count(*) c from bl group by k), fc as (select page_id k, count(distinct kind || term) c from m group by 1)
select p.k doc_id, coalesce(bc.c, 0)::bigint blockers, case when bc.c > 0 then 0 else coalesce(fc.c, 0) end::bigint findings, case when bc.c > 0 then 'blocked' when fc.c > 0 then 'pending_semantic_review' else 'pass' end gate
from p left join bc on bc.k = p.k left join fc on fc.k = p.k"""


@query("g5_surface_gate", "with " + _shapes("select doc_id k, coalesce(text, '') t from documents") + _GATE)
def g5(t):
    protected = t.nation.select("n_nationkey", F.col("n_name").alias("term"))
    return N.surface_gate(t.documents, t.benchmark, protected, "doc_id", "item_id", "n_nationkey")


# Candidates as documents with several strings: blockers and findings name the places.
_PLACES = _shapes("""select doc_id || chr(1) || path k, t from (select doc_id, '$.body' path, coalesce(text, '') t from documents union all select doc_id, '$.tags[0]', source from documents where source is not null
  union all select doc_id, '$.tags[1].lang-code', lang from documents where lang is not null)""") + r""",
g1 as (select k, regexp_extract_all(lower(t), '[가-힣A-Za-z0-9_-]+') t from p), g2 as (select k, regexp_extract_all(lower(t), '[가-힣A-Za-z0-9_-]+') t from b),
h1 as (select distinct k, array_to_string(t[i:i + 4], chr(1)) g from g1, unnest(range(1, len(t) - 3)) u(i) where len(t) >= 5),
h2 as (select distinct k, array_to_string(t[i:i + 4], chr(1)) g from g2, unnest(range(1, len(t) - 3)) u(i) where len(t) >= 5),
n as (select n_nationkey k, regexp_replace(lower(n_name), '[^가-힣a-z0-9]+', '', 'g') term from nation),
bl as (select distinct h1.k, 'exact-private-surface-copy/v1' rule, h2.k::varchar ref from h1 join h2 using (g) union select distinct pf.k, 'exact-selection-identity/v1', n.k::varchar from pf join n on contains(f, term)),
bp as (select distinct split_part(k, chr(1), 1)::bigint doc_id, rule, split_part(k, chr(1), 2) path, ref from bl)
"""


def _candidates(t):
    value = lambda c: F.regexp_replace(F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"}), r'(?s)^\{"x":(.*)\}$', "$1")
    return t.documents.select("doc_id", F.concat(F.lit('{"body":'), value(F.coalesce("text", F.lit(""))), F.lit(',"n":1,"tags":['), value(F.col("source")), F.lit(',{"lang-code":'), value(F.col("lang")), F.lit("}]}")).alias("j"))


def _report(t):
    strings = N.candidate_strings(_candidates(t), "doc_id", "j")
    return N.gate_report(strings, t.benchmark, t.nation.select("n_nationkey", F.col("n_name").alias("term")), "doc_id", "item_id", "n_nationkey")


@query("g5_j9_j10_blockers_by_place", "with " + _PLACES + " select doc_id, rule, path as location, ref from bp")
def g5_blockers(t):
    return _report(t)[0]


@query("g5_j11_findings_by_place", "with " + _PLACES + """
select split_part(page_id, chr(1), 1)::bigint doc_id, kind || '-overlap' rule, term, array_to_string(list_sort(list(distinct split_part(page_id, chr(1), 2))), ',') locations, array_to_string(list_sort(list(distinct item_id)), ',') refs
from m where split_part(page_id, chr(1), 1)::bigint not in (select doc_id from bp) group by 1, 2, 3""")
def g5_findings(t):
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return _report(t)[1].select("doc_id", "rule", "term", text("locations").alias("locations"), text("references").alias("refs"))


# Texts in Hangul, made from the words of the given ones: names, roles, organisations, attributions, quoted passages.
_LETTERS, _SYLLABLES = "abcdefghijklmnopqrstuvwxyz", "가나다라마바사아자차카타파하거너더러머버서어저처커터"
_FORMS = [("김", "가"), ("", "그룹의"), ("박", ""), ("사장", None), ("이", "사장은"), ("", "의"), ("전략", None), ("Xy", "7"), ("은행", None), ("최", "이"), ("", ""), ("“", " 님”")]
_GAPS = [" ", " ", "\t", ", "]


def _hangul(rows, key: str, text: str = "text"):
    """Word by word in Python, each once for its place modulo the gaps."""

    def run(batches):
        words, table = re.compile("[a-z]+"), str.maketrans(_LETTERS, _SYLLABLES)

        class Made(dict):
            def __init__(self, place: int):
                self.place = place

            def __missing__(self, w: str) -> str:
                before, after = _FORMS[(len(w) + ord(w[0])) % len(_FORMS)]
                g = "" if after is None else w[:3].translate(table) + after
                self[w] = before + g + _GAPS[(len(w) * 3 + self.place) % len(_GAPS)]
                return self[w]

        made = [Made(i) for i in range(len(_GAPS))]

        def token_text(text: str) -> str:
            found = words.findall(text)
            for i, known in enumerate(made):
                if len(known) > N.MOST_TOKENS:
                    known.clear()
                found[i :: len(made)] = map(known.__getitem__, found[i :: len(made)])
            return "".join(found)

        for batch in batches:
            for start in range(0, batch.num_rows, 1_000):
                part = batch.slice(start, 1_000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([token_text(x.as_py()) for x in part.column(1)], pa.string())], names=[key, "text"])

    given = spread(rows.select(key, text)).select(key, F.make_valid_utf8(F.coalesce(F.col(text), F.lit(""))))
    return written(given.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, text string"))


def _hangul_sql(name: str, table: str, key: str) -> str:
    """CTEs name_: (k, t) the made texts, and name (k, kind, term) their terms. Tokens are derived once each, neighbours by windows."""
    made = "case (length(w) + ascii(w)) % 12 " + " ".join(f"when {n} then " + (f"'{a}'" if b is None else f"'{a}' || g || '{b}'") for n, (a, b) in enumerate(_FORMS)) + " end"
    listed = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
    ends = "|".join(sorted(K.ENDINGS, key=lambda w: (-len(w), w)))
    roles = "|".join(sorted([*K.ROLES, *K.HONORIFICS], key=lambda w: (-len(w), w)))
    honorifics = "|".join(sorted(K.HONORIFICS, key=lambda w: (-len(w), w)))
    organizations = "|".join(sorted(K.ORGANIZATIONS, key=lambda w: (-len(w), w)))
    shaped = lambda c: f"(regexp_matches({c}, '^[{K.SURNAMES}][가-힣]{{1,3}}$') and {c} not in {listed(K.ONTOLOGY)})"
    return rf"""
@w as (select {key} k, unnest(regexp_extract_all(coalesce(text, ''), '[a-z]+')) w, generate_subscripts(regexp_extract_all(coalesce(text, ''), '[a-z]+'), 1) - 1 i from {table}),
@g as (select k, i, w, translate(left(w, 3), '{_LETTERS}', '{_SYLLABLES}') g from @w),
@_ as (select k, string_agg({made} || ([' ', ' ', chr(9), ', '])[(length(w) * 3 + i) % 4 + 1], '' order by i) t from @g group by k),
@p as (select k, unnest(regexp_extract_all(t, '[가-힣A-Za-z0-9_-]+|[^가-힣A-Za-z0-9_-]+')) p, generate_subscripts(regexp_extract_all(t, '[가-힣A-Za-z0-9_-]+|[^가-힣A-Za-z0-9_-]+'), 1) i from @_),
@n as (select k, p, lag(p, 2) over o before, lead(p) over o gap, lead(p, 2) over o following from @p window o as (partition by k order by i)),
@t as (select distinct p, before, following, k, regexp_matches(coalesce(gap, ''), '^[\t\p{{Zs}}]+$') spaced from @n where regexp_matches(p, '^[가-힣A-Za-z0-9_-]+$')),
@d as (select *, regexp_replace(lower(p), '[^가-힣a-z0-9]+', '', 'g') form, regexp_matches(p, '[가-힣]') hangul from (select distinct p from @t)),
@b as (select *, case when hangul then regexp_replace(form, '^(.{{2,}}?)(?:{ends})$', '\1') else form end base,
  hangul and regexp_replace(regexp_replace(form, '^(.{{1,}}?)(?:{ends})$', '\1'), '^(.+?)(?:{honorifics})$', '\1') in {listed([*K.ROLES, *K.HONORIFICS])} "role" from @d),
@e as (select *, case when hangul then regexp_extract(base, '^([가-힣]{{2,4}}?)(?:{roles})$', 1) else '' end anchor, case when hangul then regexp_extract(base, '^(.*?)({organizations})$', 1) else '' end stem0,
  case when hangul then regexp_extract(base, '^(.*?)({organizations})$', 2) else '' end suffix from @b),
@f as (select *, case when regexp_matches(stem0, '^[가-힣a-z0-9_-]{{2,20}}$') then stem0 end stem from @e),
@x as (select t.k, f.*, t.spaced, case when a.hangul then a.base end next, f.hangul and (coalesce(b."role", false) or coalesce(a."role", false)) beside from @t t join @f f on f.p = t.p left join @f b on b.p = t.before left join @f a on a.p = t.following),
@y as (select *, spaced and next in {listed(K.ORGANIZATIONS)} and regexp_matches(base, '^[가-힣a-z0-9_-]{{2,20}}$') apart, case when base like '%이' then left(base, length(base) - 1) end helper from @x),
@q as (select k, unnest(regexp_extract_all(t, '{N.QUOTED.replace("'", "''")}', 1)) q from @_),
@ as (select distinct k, kind, term from (
  select k, 'exact' kind, base term from @y where length(base) >= 2 union all select k, 'anchored', anchor from @y union all select k, 'person', anchor from @y
  union all select k, 'person', base from @y where regexp_matches(base, '^[가-힣]{{2,4}}$') and {shaped('base')} and beside
  union all select k, 'surname', base from @y where {shaped('base')} union all select k, 'surname', helper from @y where {shaped('helper')}
  union all select k, 'org_stem', stem from @y union all select k, 'org_full', stem || suffix from @y union all select k, 'exact', stem || suffix from @y
  union all select k, unnest(['org_stem', 'org_full', 'exact']), unnest([base, base || next, base || next]) from @y where apart
  union all select k, 'attribution', base from @y where regexp_matches(base, '^[가-힣a-z0-9_-]{{2,20}}$') and ((form like '%의' and form <> base) or (spaced and next in {listed(K.ATTRIBUTIONS)}))
  union all select k, 'latin', form from @y where regexp_matches(p, '^[A-Za-z][A-Za-z0-9_-]+$') and (regexp_matches(p, '[0-9_-]') or regexp_matches(p, '[A-Z].*[A-Z]') or regexp_matches(p, '[a-z][A-Z]'))
  union all select k, 'quoted', r from (select k, regexp_replace(lower(q), '[^가-힣a-z0-9]+', '', 'g') r from @q) where length(r) >= 2) where term <> '')""".replace("@", name)


@query("f4_f5_f6_f7_f8_f9_f10_f11_hangul_terms", "with " + _hangul_sql("xd", "documents", "doc_id").lstrip() + " select k doc_id, kind, term from xd")
def hangul_terms(t):
    return N.surface_terms(_hangul(t.documents, "doc_id"), "doc_id")


_CLASSES_SQL = ", ".join(f"('{name}', '{rule}', '{a}', '{b}')" for name, (rule, left, right) in N.CLASSES.items() for a in left for b in right)


@query("j11_j12_j13_j14_a13_hangul_findings", "with " + _hangul_sql("xd", "documents", "doc_id").lstrip() + "," + _hangul_sql("xb", "benchmark", "item_id") + rf""",
rules(class, rule, mine, theirs) as (values {_CLASSES_SQL}),
df as (select k, regexp_replace(lower(t), '[^가-힣a-z0-9]+', '', 'g') f from xd_), bf as (select k, regexp_replace(lower(t), '[^가-힣a-z0-9]+', '', 'g') f from xb_),
bs as (select distinct kind, term from xb where kind in ('quoted', 'latin', 'org_full') and length(term) >= 2), ds as (select distinct kind, term from xd where kind in ('quoted', 'latin', 'org_full') and length(term) >= 2),
m as (select rule, d.term, d.k doc_id, b.k item_id from xd d join rules on d.kind = rules.mine join xb b on b.kind = rules.theirs and b.term = d.term
  union select h.kind || '-overlap', h.term, h.k, b.k from (select kind, term, k from bs join df on contains(f, term)) h join xb b on b.kind = h.kind and b.term = h.term
  union select h.kind || '-overlap', h.term, d.k, h.k from (select kind, term, k from ds join bf on contains(f, term)) h join xd d on d.kind = h.kind and d.term = h.term)
select rule, term, count(distinct doc_id) locations, count(distinct item_id) refs, sum(distinct doc_id)::bigint location_sum from m group by rule, term""")
def hangul_findings(t):
    found = N.findings(_hangul(t.documents, "doc_id"), _hangul(t.benchmark, "item_id"), "doc_id", "item_id")
    total = F.aggregate("locations", F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("rule", "term", F.size("locations").cast("long").alias("locations"), F.size("references").cast("long").alias("refs"), total.alias("location_sum"))
