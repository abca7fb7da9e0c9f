"""Assemblies: story index, selectors, projections, signatures, manager checks and pack invariants."""

from __future__ import annotations

import json

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers as N
from ..operators import assembly as A
from ..operators import evidence as E
from ..operators import scoring as G
from ..operators import segment as S
from ..operators import validation as V
from ..operators import windows as X
from .evidence import _ARCS, _CHAPTERS, arcs, chapters
from .registry import query


@query("p7_story_index", "with " + _ARCS + ", " + _CHAPTERS + """,
p as (select l_orderkey, l_linenumber, row_number() over (partition by o_custkey order by o_orderkey, l_linenumber, l_returnflag) seq, o_custkey work, l_returnflag flag from lineitem join orders on l_orderkey = o_orderkey)
select ch.work, ch.seq, arcs.arc, arcs.s arc_start, ch.seq - arcs.s + 1 in_arc, p.flag from ch join arcs on arcs.work = ch.work and ch.seq between arcs.s and arcs.e join p on p.work = ch.work and p.seq = ch.seq""")
def p7(t):
    own = arcs(t).withColumnRenamed("s", "arc_start")
    flags = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("work"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey", "l_linenumber", "l_returnflag")).cast("long").alias("seq"), F.col("l_returnflag").alias("flag"))
    rows = E.story_index(chapters(t).select("work", "seq"), own, flags, "work", "seq", "arc_start", "e", "arc")
    return rows.select("work", "seq", "arc", "arc_start", F.col("in_interval").alias("in_arc"), "flag")


@query("p9_w18_observation_selectors", """
with o as (select l_orderkey, l_linenumber, l_partkey % 50 s, l_partkey % 50 + l_quantity::bigint e from lineitem),
u as (select l_orderkey, s, e, row_number() over w place, coalesce(lag(s) over w = s and lag(e) over w = e, false) repeated from o window w as (partition by l_orderkey order by s, e))
select l_orderkey, place, s start_byte, e end_byte, repeated from u""")
def p9(t):
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct((F.col("l_partkey") % 50).alias("start_byte"), (F.col("l_partkey") % 50 + F.col("l_quantity").cast("long")).alias("end_byte"))).alias("ranges"))
    rows = rows.withColumns({"name": F.lit("o"), "sequences": F.array().cast("array<int>")})
    index = t.spark.createDataFrame([], "l_orderkey long, sequence int, start_byte long, end_byte long")
    found = S.observation_selectors(rows, index, "l_orderkey", "name", "sequences", "ranges")
    return found.select("l_orderkey", F.col("place").cast("long").alias("place"), "start_byte", "end_byte", "repeated")


@query("f21_selector_ids", """
with d as (select doc_id, coalesce(text, '') t, 'source-' || lpad(doc_id::varchar, 12, '0') s from documents)
select doc_id, 'sel-' || substr(s, 8, 12) || '-' || substr(sha256(s || ':0:' || strlen(t) || ':' || sha256(t)), 1, 20) selector_id from d""")
def f21(t):
    source, text = F.concat(F.lit("source-"), F.lpad(F.col("doc_id").cast("string"), 12, "0")), F.coalesce("text", F.lit(""))
    return t.documents.select("doc_id", T.selector_id(source, F.lit(0), F.octet_length(text), F.sha2(text, 256)).alias("selector_id"))


@query("f22_mechanism_signature", r"""
with n as (select item_id, replace(replace(trim(regexp_replace(coalesce(text, ''), '[\t\n\x0b\x0c\r ]+', ' ', 'g')), '\', '\\'), '"', '\"') m from benchmark),
b as (select item_id, '"mechanism":{"protagonistRepeatedVerb":"' || m || '","pressure":"p","activeChoice":"' || m || '","resistance":"r","payoff":"","recognition":"' || m || '"}}' body from n)
select item_id, sha256('{"schemaVersion":"genre-soul-commercial-mechanism-signature/v1",' || body) signature, sha256('{"schemaVersion":"genre-soul-commercial-engine-signature/v1","sourceId":"s-' || item_id || '",' || body) engine from b""")
def f22(t):
    text = F.coalesce("text", F.lit(""))
    fields = [text, F.lit(" p "), text, F.lit("r"), F.lit(""), text]
    return t.benchmark.select("item_id", T.mechanism_signature(fields).alias("signature"), T.mechanism_signature(fields, F.concat(F.lit("s-"), F.col("item_id").cast("string"))).alias("engine"))


_INVENTORY = """inv as (select c_custkey k, 's' || c_custkey source_id, c_name title, c_mktsegment author, sha256(c_name) h, c_custkey + 100 b, case c_custkey % 19 when 0 then 'remote-only' else 'verified-local' end status, case c_custkey % 23 when 0 then 'needs-review' else 'complete' end structure, c_custkey % 300 chapters from customer where c_custkey % 29 <> 0)"""


def _inventory(t):
    k = F.col("c_custkey")
    return t.customer.where(k % 29 != 0).select(
        F.concat(F.lit("s"), k.cast("string")).alias("source_id"), k.cast("string").alias("provider_file_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("author"), F.sha2("c_name", 256).alias("source_sha256"), (k + 100).alias("actual_size_bytes"),
        F.when(k % 19 == 0, "remote-only").otherwise("verified-local").alias("status"), F.when(k % 23 == 0, "needs-review").otherwise("complete").alias("structure_status"), (k % 300).alias("chapters"),
    )


def _selection(t):
    k = F.col("c_custkey")
    basis = F.get(F.array(*map(F.lit, ("commercial-anchor", "genre-breadth", "surface-anchor"))), (k % 3).cast("int"))
    return t.customer.select(
        F.concat(F.lit("g"), F.floor(k / 3).cast("string")).alias("genre"), F.concat(F.lit("s"), k.cast("string")).alias("source_id"), F.when(k % 31 == 0, "x").otherwise(k.cast("string")).alias("provider_file_id"), F.when(k % 37 == 0, F.lit(None)).otherwise(F.col("c_name")).alias("title"),
        F.col("c_mktsegment").alias("author"), F.sha2("c_name", 256).alias("source_sha256"), (k + 100 + (k % 41 == 0).cast("int")).alias("size_bytes"), (k % 300).alias("chapter_count"), F.when(k % 43 == 0, "other").otherwise(basis).alias("basis"),
        F.when(k % 47 == 0, F.lit(None)).otherwise("local-source-inspection").alias("mode"),
    )


@query("j5_selection_claims", "with " + _INVENTORY + """,
s as (select c_custkey k, 'g' || (c_custkey // 3) genre, inv.source_id is not null there, status, structure, case when c_custkey % 43 = 0 then 'other' else ['commercial-anchor', 'genre-breadth', 'surface-anchor'][c_custkey % 3 + 1] end basis from customer left join inv on k = c_custkey)
select genre, 's' || k source_id, 'not-inventoried' rule from s where not there union all select genre, 's' || k, 'drifted:provider_file_id' from s where there and k % 31 = 0 union all select genre, 's' || k, 'drifted:title' from s where there and k % 37 = 0
union all select genre, 's' || k, 'drifted:size_bytes' from s where there and k % 41 = 0 union all select genre, 's' || k, 'not-verified' from s where there and k % 19 = 0 union all select genre, 's' || k, 'incomplete' from s where there and k % 23 = 0
union all select genre, 's' || k, 'bad-basis' from s where k % 43 = 0 union all select genre, 's' || k, 'bad-mode' from s where k % 47 = 0
union all select genre, null, case when count(*) <> 3 then 'wrong-count' else 'bases-not-covered' end from s group by genre having count(*) <> 3 or list_sort(list(basis)) <> ['commercial-anchor', 'genre-breadth', 'surface-anchor']""")
def j5_claims(t):
    return A.selection_violations(_selection(t), _inventory(t))


@query("j6_apply_selection", "with " + _INVENTORY + """
select source_id, case when k % 5 = 0 then 'manager-selected' else 'unclassified' end classification, case when k % 5 = 0 then 'g' || k end genre, k % 5 = 0 eligible from inv""")
def j6(t):
    k = F.col("c_custkey")
    chosen = t.customer.where(k % 5 == 0).select(F.concat(F.lit("s"), k.cast("string")).alias("source_id"), F.concat(F.lit("g"), k.cast("string")).alias("genre"))
    return A.apply_selection(_inventory(t), chosen, "0" * 64).select("source_id", "classification", "genre", "eligible")


@query("j21_routing", """
with n as (select a.n_regionkey g, a.n_nationkey k, (select count(*) from nation b where b.n_regionkey = a.n_regionkey and b.n_nationkey < a.n_nationkey) p from nation a),
r as (select g, p, case when k % 7 = 3 then 'style' else ['spine', 'style', 'supporting'][p + 1] end role, ['spine', 'style', 'supporting'][p + 1] want, case when k % 11 = 2 then null else ['commercial-anchor', 'surface-anchor', 'genre-breadth'][(k % 13 = 4)::int + p + 1] end basis from n where p < 3)
select g, role, 'role-out-of-place' rule from r where role <> want union all select g, role, 'unbound-source' from r where basis is null
union all select g, role, 'wrong-basis' from r where basis <> case role when 'spine' then 'commercial-anchor' when 'style' then 'surface-anchor' else 'genre-breadth' end""".replace("[(k % 13 = 4)::int + p + 1]", "[1 + (p + (k % 13 = 4)::int) % 3]"))
def j21_routing(t):
    k, roles, bases = F.col("n_nationkey"), ("spine", "style", "supporting"), ("commercial-anchor", "surface-anchor", "genre-breadth")
    n = t.nation.select(F.col("n_regionkey").alias("g"), "n_nationkey", (F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1).alias("place")).where("place < 3")
    routes = n.select("g", "place", F.when(k % 7 == 3, "style").otherwise(F.get(F.array(*map(F.lit, roles)), "place")).alias("role"), k.alias("source_id"))
    works = n.where(k % 11 != 2).select("g", k.alias("source_id"), F.get(F.array(*map(F.lit, bases)), ((F.col("place") + (k % 13 == 4).cast("int")) % 3).cast("int")).alias("basis"))
    return A.routing_violations(routes, works, "g")


@query("j22_j24_registry_lookups", """
select o_orderkey, case when o_custkey % 7 = 0 then 'not-registered' when o_custkey % 11 = 0 then 'unsafe-path' when o_custkey % 13 = 0 then 'not-verified' when o_custkey % 5 <> o_orderkey % 5 then 'not-selected' else 'ok' end state,
  case when o_custkey % 7 <> 0 then sha256(c_name) end source_sha256 from orders join customer on c_custkey = o_custkey""")
def j24(t):
    k = F.col("c_custkey")
    registry = t.customer.where(k % 7 != 0).select(k.alias("source_id"), F.when(k % 11 == 0, "../x").otherwise("a/b.txt").alias("path"), F.when(k % 13 == 0, "missing").otherwise("available").alias("status"), F.sha2("c_name", 256).alias("source_sha256"), k.alias("size_bytes"), F.lit(True).alias("eligible"), (k % 5).alias("genre"), F.lit("a" * 64).alias("receipt_sha256"))
    wanted = t.orders.select("o_orderkey", F.col("o_custkey").alias("source_id"), (F.col("o_orderkey") % 5).alias("asked"))
    found = A.resolve_sources(wanted, registry, "asked").select("o_orderkey", "source_id", "state")
    return A.match_sources(found, registry).select("o_orderkey", "state", "source_sha256")


@query("p16_surface_candidate", """
with c as (select conv_id, turn, role, coalesce(text, '') t from conversations), a as (select conv_id, list(t || '/' || role order by turn) p, list(role order by turn) r from c group by conv_id), m as (select conv_id, list(turn || '' order by turn) m from c where role = 'user' group by conv_id)
select conv_id, array_to_string(p, '|') patterns, array_to_string(m, '|') mechanisms, array_to_string(r, '|') rationales from a left join m using (conv_id)""")
def p16(t):
    rows = t.conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("t"))
    listed = F.array_sort(F.collect_list(F.struct("turn", F.col("t").alias("guidance"), F.col("role").alias("commercial_function"), F.col("role").alias("rationale"))))
    results = rows.groupBy("conv_id").agg(listed.alias("patterns")).withColumn("routes", F.col("patterns"))
    works = rows.where("role = 'user'").select("conv_id", F.col("turn").alias("place"), F.col("turn").cast("string").alias("mechanism"))
    found = A.surface_candidate(results, works, "conv_id")
    text = F.array_join(F.transform("patterns", lambda p: F.concat(p["guidance"], F.lit("/"), p["commercial_function"])), "|")
    return found.select("conv_id", text.alias("patterns"), F.array_join("mechanisms", "|").alias("mechanisms"), F.array_join("rationales", "|").alias("rationales"))


@query("p17_opaque_inputs", """
select o_custkey, '[' || string_agg('{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '"}', ',' order by o_orderkey) || ']' candidates, 'candidates,o_custkey' columns_ from orders group by o_custkey""")
def p17(t):
    rows = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("lane")))).alias("candidates"), F.max("o_orderdate").alias("profile"))
    kept = A.opaque(rows, ["o_custkey", "candidates"], {"candidates": ["id", "status"]})
    return kept.select("o_custkey", F.to_json("candidates").alias("candidates"), F.lit(",".join(sorted(kept.columns))).alias("columns_"))


def _observations(t):
    """A customer's orders as observations of a work, their line items as selectors."""
    bands = F.array(*map(F.lit, A.BANDS))
    selector = F.struct(F.concat("l_orderkey", F.lit("-"), F.col("l_partkey") % 50).alias("selector_id"), F.col("l_partkey").alias("start_byte"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end_byte"), F.get(bands, F.col("l_linenumber") % 3).alias("coverage_band"))
    listed = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(selector).alias("selectors"))
    rows = t.orders.join(listed, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select(
        F.col("o_custkey").alias("work"), F.col("o_orderkey").alias("observation_id"), F.col("o_orderkey").alias("place"), (F.col("o_orderkey") % 3).alias("segment_index"), (-F.col("o_orderkey")).alias("observation_index"),
        F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("finding"), F.lit("f").alias("commercial_function"), F.lit("early").alias("coverage_band"), "selectors",
    )


@query("p18_synthesis_input", """
with l as (select l_orderkey o, l_orderkey || '-' || (l_partkey % 50) sel, l_partkey s, l_partkey + l_quantity::bigint e from lineitem),
x as (select o_custkey work, o_orderkey o from orders where o_orderkey % 4 <> 0 and o_orderkey in (select o from l)),
t as (select o_custkey work, count(*) total from orders where o_orderkey in (select o from l) group by 1),
c as (select work, count(distinct x.o) n, count(*) refs, count(distinct sel) sels from x join l using (o) group by work),
w as (select work, string_agg(o::varchar, ',' order by o % 3, -o) ids from x group by work),
f as (select work, string_agg(s || ':' || e, ',' order by o % 3, -o, s, e) ranges from x join l using (o) group by work)
select work, ids, ranges, n, refs selector_references, sels selectors, total total_observations from w join c using (work) join t using (work) join f using (work)""")
def p18(t):
    rows = _observations(t)
    found = A.synthesis_input(rows, "work", rows.where("observation_id % 4 <> 0"))
    ranges = F.flatten(F.transform("observations", lambda o: F.transform(o["selectors"], lambda s: F.concat_ws(":", s["start_byte"], s["end_byte"]))))
    whole = [F.col(c).cast("long").alias(c) for c in ("n", "selector_references", "selectors", "total_observations")]
    return found.select("work", F.array_join(F.transform("observations", lambda o: o["observation_id"].cast("string")), ",").alias("ids"), F.array_join(ranges, ",").alias("ranges"), *whole)


@query("p18_sample_coverage", """
with l as (select o_custkey work, o_orderstatus kind, l_orderkey || '-' || (l_partkey % 50) sel, ['early', 'middle', 'late'][l_linenumber % 3 + 1] band from lineitem join orders on o_orderkey = l_orderkey),
r as (select * from l where sel in (select l_orderkey || '-' || (l_partkey % 50) from lineitem where l_suppkey % 2 = 0)),
w as (select distinct work, b.band from r, (values ('early'), ('middle'), ('late')) b(band)), f as (select work, band, count(distinct sel) n, list_sort(list(distinct kind)) kinds from r group by 1, 2)
select work, band coverage_band, coalesce(n, 0)::bigint selectors, coalesce(array_to_string(kinds, ','), '') kinds, coalesce(n >= 3 and len(kinds) >= 2, false) enough from w left join f using (work, band)""")
def p18_coverage(t):
    wanted = t.lineitem.where("l_suppkey % 2 = 0").join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("work"), F.concat("l_orderkey", F.lit("-"), F.col("l_partkey") % 50).alias("selector_id"))
    return A.sample_coverage(_observations(t), "work", wanted).withColumn("kinds", F.coalesce(F.array_join("kinds", ","), F.lit("")))


def _parts(t):
    rows = _observations(t).select("work", "observation_id").withColumn("part_no", F.expr("observation_id div 4000").cast("int"))
    rows = rows.groupBy("work", "part_no").agg(F.array_sort(F.collect_list("observation_id")).alias("observation_ids"))
    return rows.select("*", F.concat_ws("-", F.lit("part"), "part_no").alias("part_id"), F.concat(F.lit("p/"), F.col("part_no").cast("string")).alias("path"), F.to_json(F.struct("part_no")).alias("result"))


@query("p19_consolidation_input", """
with o as (select o_custkey work, o_orderkey o, o_orderstatus kind from orders where o_orderkey in (select l_orderkey from lineitem)), b as (select l_orderkey o, array_to_string(list_sort(list(distinct ['early', 'middle', 'late'][l_linenumber % 3 + 1])), '+') bands from lineitem group by 1),
c as (select work, string_agg(o || kind || bands, ',' order by o) catalogue, count(*) n from o join b using (o) group by work), q as (select work, o // 4000 p, string_agg(o::varchar, '+' order by o) ids from o group by 1, 2),
d as (select work, string_agg('part-' || p || ':' || ids || ':' || substr(sha256('{"part_no":' || p || '}'), 1, 8), ',' order by p) parts, count(*) k from q group by work)
select work, catalogue, parts, n total_observations, k part_count from c join d using (work)""")
def p19(t):
    found = A.consolidation_input(_observations(t), _parts(t), "work")
    catalogue = F.transform("catalogue", lambda c: F.concat(c["observation_id"].cast("string"), c["kind"], F.array_join(c["bands"], "+")))
    parts = F.transform("parts", lambda p: F.concat(p["part_id"], F.lit(":"), F.array_join(p["observation_ids"].cast("array<string>"), "+"), F.lit(":"), F.substring(p["sha256"], 1, 8)))
    return found.select("work", F.array_join(catalogue, ",").alias("catalogue"), F.array_join(parts, ",").alias("parts"), F.col("total_observations").cast("long").alias("total_observations"), F.col("part_count").cast("long").alias("part_count"))


@query("p19_partition_violations", """
with a as (select o_custkey work, o_orderkey o, row_number() over (partition by o_custkey order by o_orderkey) n from orders where o_orderkey in (select l_orderkey from lineitem)),
b as (select work, o, row_number() over (partition by work order by o) n from a where o % 500 <> 0)
select coalesce(a.work, b.work) work, coalesce(a.n, b.n) n, a.o want, b.o given from a full join b on a.work = b.work and a.n = b.n where a.o is distinct from b.o""")
def p19_partition(t):
    parts = _parts(t).withColumn("observation_ids", F.filter("observation_ids", lambda x: x % 500 != 0))
    return A.partition_violations(_observations(t), parts, "work").withColumn("n", F.col("n").cast("long"))


def _patterns(t):
    rows = t.orders.groupBy(F.col("o_custkey").alias("genre"), (F.col("o_orderkey") % 9).alias("place")).agg(F.collect_list(F.struct(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("observation_id"))).alias("evidence"))
    names = F.array(*map(F.lit, A.DIMENSIONS))
    return rows.select("genre", "place", F.get(names, F.col("place").cast("int")).alias("dimension"), F.lit("common").alias("classification"), F.lit("g").alias("guidance"), F.lit("f").alias("commercial_function"), "evidence")


def _profiled(t):
    seen = _observations(t).select(F.col("work").alias("source_id"), "observation_id", F.lit("seg").alias("segment_id"), "kind", "selectors")
    return A.profile_patterns(_patterns(t), seen)


@query("p20_profile_patterns", """
with l as (select l_orderkey o, string_agg(l_partkey || '-' || (l_partkey + l_quantity::bigint), '+' order by l_partkey, l_partkey + l_quantity::bigint) r from lineitem group by 1)
select o_custkey genre, o_orderkey % 9 place, coalesce(string_agg(o || ':' || o_orderstatus || ':' || r, ',' order by o_custkey || ':' || o) filter (r is not null), '') evidence, count(*) filter (r is null) missing, case when count(r) > 0 then o_custkey::varchar else '' end source_ids, true id_shaped
from orders left join l on o = o_orderkey group by 1, 2""")
def p20(t):
    text = F.transform("evidence", lambda e: F.concat(e["observationId"].cast("string"), F.lit(":"), e["kind"], F.lit(":"), F.array_join(F.transform(e["selectors"], lambda s: F.concat_ws("-", s["startByte"], s["endByte"])), "+")))
    return _profiled(t).select("genre", "place", F.array_join(text, ",").alias("evidence"), "missing", F.array_join(F.col("source_ids").cast("array<string>"), ",").alias("source_ids"), F.col("pattern_id").rlike("^pattern-[0-9a-f]{24}$").alias("id_shaped"))


@query("p20_profile_dimensions", """
with d as (select unnest(['worldConstraints', 'protagonistRepeatedVerbs', 'pressureAndOpposition', 'rewardAndStatusCurrency', 'nextChapterExpectedAction', 'commercialEngines', 'emotionalCoherence', 'arcAndGrowth', 'failurePatterns']) dimension, unnest(range(9)) place)
select g.genre, d.place, d.dimension, count(p.place) n from (select distinct o_custkey genre from orders) g join d on true left join (select distinct o_custkey genre, o_orderkey % 9 place from orders) p on p.genre = g.genre and p.place = d.place group by 1, 2, 3""")
def p20_dimensions(t):
    return A.profile_dimensions(_profiled(t)).select("genre", F.col("place").cast("long").alias("place"), "dimension", F.size("pattern_ids").cast("long").alias("n"))


# A nation's first four customers as sources of a genre; a source's first, second and third order are its evidence.
_ENGINES = """
c as (select c_nationkey genre, c_custkey s, c_name, c_mktsegment seg, row_number() over (partition by c_nationkey order by c_custkey) i from customer qualify i <= 4),
o as (select o_custkey s, o_orderkey o, row_number() over (partition by o_custkey order by o_orderkey) j from orders), sel as (select l_orderkey o, string_agg(l_partkey || '-' || (l_partkey + l_quantity::bigint), '+' order by l_partkey, l_partkey + l_quantity::bigint) r from lineitem group by 1),
v as (select c.*, a.o o1, b.o o2, d.o o3 from c left join o a on a.s = c.s and a.j = 1 left join o b on b.s = c.s and b.j = 2 left join o d on d.s = c.s and d.j = 3),
h as (select *, sha256('{"schemaVersion":"genre-soul-commercial-engine-signature/v1","sourceId":"' || s || '","mechanism":{"protagonistRepeatedVerb":"' || case when i = 2 then 'x y' else c_name end || '","pressure":"' || seg || '","activeChoice":"a","resistance":"b","payoff":"c","recognition":"' || genre || '"}}') sig from v),
ev as (select h.s, genre, i, 'engine-' || substr(sig, 1, 24) engine_id, (s1.r is null)::int + (s2.r is null)::int + (s3.r is null)::int missing, concat_ws(',', 'early:' || o1 || ':' || s1.r, 'middle:' || o2 || ':' || s2.r, 'late:' || o3 || ':' || s3.r) evidence
  from h left join sel s1 on s1.o = o1 left join sel s2 on s2.o = o2 left join sel s3 on s3.o = o3)
"""


def _engines(t):
    first = F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey"))
    c = t.customer.select("c_nationkey", "c_custkey", "c_name", "c_mktsegment", first.alias("i")).where("i <= 4")
    o = t.orders.select("o_custkey", "o_orderkey", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("j")).where("j <= 3")
    o = o.groupBy("o_custkey").agg(*[F.max(F.when(F.col("j") == j, F.col("o_orderkey"))).alias(span) for j, span in enumerate(A.BANDS, 1)])
    mechanism = [F.when(F.col("i") == 2, "  x \n y ").otherwise(F.col("c_name")), F.col("c_mktsegment"), F.lit("a"), F.lit("b"), F.lit("c"), F.col("c_nationkey").cast("string")]
    rows = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_nationkey").alias("genre"), F.col("c_custkey").alias("source_id"), "i", *[m.alias(n) for m, n in zip(mechanism, T.MECHANISM)], F.struct(*A.BANDS).alias("evidence"))
    seen = _observations(t).select(F.col("work").alias("source_id"), "observation_id", F.lit("seg").alias("segment_id"), "kind", "selectors")
    return rows, A.profile_engines(rows, seen)


@query("p20_profile_engines", "with " + _ENGINES.strip() + " select genre, s source_id, engine_id, missing, evidence from ev")
def p20_engines(t):
    text = F.transform("evidence", lambda e: F.concat_ws(":", e["span"], e["observationId"].cast("string"), F.array_join(F.transform(e["selectors"], lambda x: F.concat_ws("-", x["startByte"], x["endByte"])), "+")))
    return _engines(t)[1].select("genre", "source_id", "engine_id", "missing", F.array_join(text, ",").alias("evidence"))


@query("p20_engine_violations", "with " + _ENGINES.strip() + """
select genre, s source_id, 'no-engine' rule from ev where i in (1, 3) union all select genre, s + 1000000, 'unbound-source' from ev where i = 1
union all select genre, s + case when i = 1 then 1000000 else 0 end, 'missing-span' from ev where i <> 3 and (missing > 0 or i = 1)
union all select genre, null, 'wrong-count' from ev group by genre having count(*) <> 3""")
def p20_engine_rules(t):
    rows, _ = _engines(t)
    seen = _observations(t).select(F.col("work").alias("source_id"), "observation_id", F.lit("seg").alias("segment_id"), "kind", "selectors")
    stray = F.when(F.col("i") == 1, 1_000_000).otherwise(0)
    given = rows.where("i <> 3").withColumn("source_id", F.col("source_id") + stray)
    return A.engine_violations(A.profile_engines(given, seen), rows.select("genre", "source_id"))


@query("p20_routing_catalogue", """
with c as (select c_nationkey genre, c_custkey s, row_number() over (partition by c_nationkey order by c_custkey) i from customer qualify i <= 3),
r as (select genre, string_agg('    {' || chr(10) || '      "role": "' || ['spine', 'style', 'supporting'][i] || '",' || chr(10) || '      "sourceId": ' || s || ',' || chr(10) || '      "selectionBasis": "' || ['commercial-anchor', 'surface-anchor', 'genre-breadth'][i] || '",' || chr(10)
  || '      "rationale": "r' || i || '",' || chr(10) || '      "planned": true,' || chr(10) || '      "retrievalActive": false' || chr(10) || '    }', ',' || chr(10) order by i) routes from c group by genre)
select n_nationkey genre, sha256('{' || chr(10) || '  "schemaVersion": "genre-soul-reference-routing-catalog/v1",' || chr(10) || '  "state": "candidate",' || chr(10) || '  "genre": "' || n_nationkey || '",' || chr(10) || '  "soulId": "' || n_name || '",' || chr(10) || '  "version": "v1",' || chr(10)
  || '  "profile": {' || chr(10) || '    "path": "p/' || n_nationkey || '",' || chr(10) || '    "sha256": "' || sha256(n_name) || '"' || chr(10) || '  },' || chr(10) || '  "routes": [' || case when routes is null then '' else chr(10) || routes || chr(10) || '  ' end || '],' || chr(10)
  || '  "authority": {' || chr(10) || '    "scope": "reference-lab-advisory-only",' || chr(10) || '    "mayWriteInkOSCanon": false,' || chr(10) || '    "mayActivateRetrieval": false,' || chr(10) || '    "mayPromoteSoul": false,' || chr(10) || '    "ownerDecisionRequired": true' || chr(10) || '  },' || chr(10)
  || '  "privateRunInputDigest": "' || sha256(n_nationkey::varchar) || '"' || chr(10) || '}' || chr(10)) sha256 from nation left join r on genre = n_nationkey""")
def p20_routing(t):
    profiles = t.nation.select(F.col("n_nationkey").alias("genre"), F.col("n_name").alias("soul_id"), F.lit("v1").alias("version"), F.concat(F.lit("p/"), F.col("n_nationkey").cast("string")).alias("profile_path"), F.sha2("n_name", 256).alias("profile_sha256"), F.sha2(F.col("n_nationkey").cast("string"), 256).alias("input_sha256"))
    place = F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey"))
    routes = t.customer.select(F.col("c_nationkey").alias("genre"), F.col("c_custkey").alias("source_id"), place.alias("place")).where("place <= 3")
    routes = routes.withColumns({"role": F.get(F.array(*map(F.lit, A.ROLE_BASIS)), F.col("place") - 1), "rationale": F.concat(F.lit("r"), F.col("place").cast("string"))})
    return A.routing_catalogue(profiles, routes).drop("catalogue")


@query("p21_semantic_subset", """
select o_custkey, string_agg(o_orderkey::varchar, ',' order by o_orderkey) finding_ids, sha256('[' || string_agg('{"o":' || o_orderkey || '}', ',' order by o_orderkey) || ']') set_sha256 from orders where o_orderstatus <> 'P' group by 1""")
def p21(t):
    rows = t.orders.select("o_custkey", F.col("o_orderkey").alias("finding_id"), F.concat(F.lit('{"o":'), F.col("o_orderkey").cast("string"), F.lit("}")).alias("body"), "o_orderstatus")
    found = A.semantic_subset(rows, rows.where("o_orderstatus <> 'P'"), "o_custkey")
    return found.select("o_custkey", F.array_join(F.col("finding_ids").cast("array<string>"), ",").alias("finding_ids"), "set_sha256")


@query("p25_packet_identity", """
with b as (select event_id, '"a":' || user_id || ',"b":{"t":"' || event_type || '","n":null}' body from events), h as (select *, sha256('{' || body || '}') sha256 from b)
select event_id, sha256, event_id % 4 = 0 genuine from h""")
def p25(t):
    body = F.concat(F.lit('"a":'), F.col("user_id").cast("string"), F.lit(',"b":{"t":"'), "event_type", F.lit('","n":null}'))
    digest = F.sha2(F.concat(F.lit("{"), body, F.lit("}")), 256)
    k = F.col("event_id") % 4
    name = F.concat(F.lit("frp-"), F.substring(F.when(k == 1, F.sha2(digest, 256)).otherwise(digest), 1, 24))
    packet = F.concat(F.lit('{"schemaVersion":"'), F.when(k == 2, "other").otherwise(A.PACKET_SCHEMA), F.lit('","packetId":"'), name, F.lit('",'), body, F.lit(',"packetSha256":"'), F.when(k == 3, F.upper(digest)).otherwise(digest), F.lit('"}'))
    return A.packet_identity(t.events.select("event_id", packet.alias("packet")), "event_id")


@query("p25_identity_projection", """
select doc_id, lang, sha256('{"doc_id":' || doc_id || case when lang is null then '' else ',"lang":"' || lang || '"' end || case when source is null then '' else ',"source":"' || source || '"' end || '}') identity_sha256 from documents""")
def p25_identity(t):
    return t.documents.select("doc_id", "lang", F.sha2(T.sorted_json(F.to_json(F.struct("lang", "doc_id", "source"))), 256).alias("identity_sha256"))


@query("a18_owner_outcome", "select o_custkey, case when bool_or(o_orderstatus = 'P') then 'rejected' else 'approved' end outcome from orders group by 1")
def a18(t):
    return A.owner_outcome(t.orders.withColumn("decision", F.when(F.col("o_orderstatus") == "P", "protected-reject").when(F.col("o_orderstatus") == "F", "generic-allow")), "o_custkey")


@query("a24_usage_totals", """
select user_id, count(*) segments, coalesce(sum(event_id % 7), 0)::bigint exact_read_count, coalesce(sum(case when event_id % 3 > 0 then event_id end), 0)::bigint total_tokens, coalesce(sum(case when event_id % 5 = 0 then 2 end), 0)::bigint api_calls from events group by 1""")
def a24(t):
    k = F.col("event_id")
    return A.usage_totals(t.events.select("user_id", (k % 7).alias("exact_read_count"), F.when(k % 3 > 0, k).alias("total_tokens"), F.when(k % 5 == 0, 2).alias("api_calls")), "user_id")


@query("a27_candidate_counts", """
with x as (select user_id g, event_id c, case when event_id % 6 = 5 then null else event_id % 6 end v, event_id % 4 k, user_id % 3 q from events)
select g, string_agg(c || '=' || coalesce(v, 0), ',' order by c) violations, sum(k)::bigint contradictions, sum(q)::bigint leaks from x group by g""")
def a27(t):
    some, k = lambda n: F.array_repeat(F.lit("x"), n.cast("int")), F.col("event_id")
    rows = t.events.select(F.col("user_id").alias("g"), k.alias("candidate"), F.when(k % 6 != 5, some(k % 6)).alias("violations"), some(k % 4).alias("contradictions"), some(F.col("user_id") % 3).alias("leaks"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("violations")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return A.candidate_counts(rows, "g").select("g", text.alias("violations"), "contradictions", "leaks")


@query("f12_w13_context_windows")
def f12(t):
    term = F.get(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)), F.lit(2))
    rows = t.documents.withColumn("term", term).where("term is not null")
    return X.term_windows(rows, "doc_id", "text", "term").drop("window")


@query("g4_manager_checks", """
with s as (select o_custkey k, case when o_orderstatus = 'P' then 'contradicts' when o_totalprice < 20000 then 'insufficient' else 'supports' end c, o_orderpriority f from orders),
a as (select k, bool_or(c = 'contradicts') x, bool_or(c = 'insufficient') y, list_sort(list(distinct f)) fs from s group by k)
select k, array_to_string(fs, ',') fields, case when x then 'contradicted' when y or len(fs) < 5 then 'insufficient' else 'supported' end verdict from a""")
def g4(t):
    c = F.when(F.col("o_orderstatus") == "P", "contradicts").when(F.col("o_totalprice") < 20000, "insufficient").otherwise("supports")
    rows = t.orders.select(F.col("o_custkey").alias("k"), c.alias("c"), F.array("o_orderpriority").alias("f"))
    out = G.phase_verdicts(rows, "k", "c", "f", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])
    return out.select("k", F.array_join("fields", ",").alias("fields"), "verdict")


@query("g4_pair_violations", """
with w as (select n_regionkey g, n_nationkey a from nation), p as (select x.g, x.a l, y.a r from w x join w y on x.g = y.g and x.a < y.a),
c as (select * from p where (l + r) % 4 <> 0 union all select * from p where (l * r) % 7 = 1)
select p.g, p.l, p.r, case when n is null then 'missing-pair' else 'repeated-pair' end rule from p left join (select l, r, count(*) n from c group by 1, 2) d on d.l = p.l and d.r = p.r where n is null or n > 1""")
def g4_pairs(t):
    n = t.nation.select(F.col("n_regionkey").alias("g"), F.col("n_nationkey").alias("a"), F.col("n_name").alias("s"))
    p = n.select("g", F.col("a").alias("l")).join(n.select("g", F.col("a").alias("r")), "g").where("l < r")
    c = p.where("(l + r) % 4 <> 0").unionByName(p.where("(l * r) % 7 = 1")).withColumn("v", F.lit("shared-core"))
    return G.comparison_violations(c, n, "g", "l", "r", "v", "a", "s")


_PACK = """
p as (select c_custkey k, case k % 8 when 0 then 'en' else 'ko' end lang, case k % 9 when 1 then 750 else 751 end chapters, case k % 10 when 2 then 4 else 5 end phases, case k % 11 when 3 then 'true' else 'false' end penalty, case k % 12 when 4 then '1' else 'null' end distance, case k % 13 when 5 then ',"quote" : "x"' else '' end extra
  from (select c_custkey, c_custkey k from customer))
"""


@query("g8_pack_invariants", "with " + _PACK.strip().replace("case k %", "case c_custkey %").replace("(select c_custkey, c_custkey k from customer)", "customer") + """
select k, 'language' rule from p where k % 8 = 0 union all select k, 'chapter-count' from p where k % 9 = 1 union all select k, 'phase-count' from p where k % 10 = 2 union all select k, 'similarity-penalty' from p where k % 11 = 3
union all select k, 'distance-score' from p where k % 12 = 4 union all select k, 'source-bearing-fields' from p where k % 13 = 5 union all select k, 'indexed-chapters' from p where k % 14 = 7 union all select k, 'identity' from p where k % 15 = 8""")
def g8(t):
    k = F.col("c_custkey")
    when = lambda m, r, yes, no: F.when(k % m == r, yes).otherwise(no)
    listed = lambda n: F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit("{}"), n), ","), F.lit("]"))
    pack = F.concat(
        F.lit('{"version":'), when(15, 8, '"1"', "1"), F.lit(',"kind":"reference-transformation-pack","language":"'), when(8, 0, "en", "ko"), F.lit('","source":{"chapterCount":'), when(9, 1, "750", "751"), F.lit(',"naturalArcCount":131},"phases":'), when(10, 2, listed(4), listed(5)),
        F.lit(',"storyRetrieval":{"indexedChapterCount":'), when(14, 7, '"751"', "751"), F.lit('},"styleRetrieval":{"samples":'), listed(15), F.lit('},"commercialPolicy":{"similarityPenalty":'), when(11, 3, "true", "false"), F.lit(',"minimumDistanceScore":'), when(12, 4, "1", "null"), F.lit("}"), when(13, 5, ',"quote" : "x"', ""), F.lit("}"),
    )
    return V.pack_violations(t.customer.select(k.alias("k"), pack.alias("pack")), "k")


def _answer() -> str:
    """A whole answer as JSON, @K standing for its key."""
    text = {"rationale": "why", "commercialConsequence": "so"}
    s = ["s1", "s2", "s3"]
    return json.dumps({
        "schemaVersion": N.SCHEMA, "genre": "g", "soulId": "soul-@K", "profileSha256": "0" * 64, "synthesisRunId": "run-@K",
        "sampleVerdicts": [{"sampleId": f"{x}-{span}-@K", "phaseContribution": "supports-phase", "supportedMechanismFields": list(fields), **text} for x in s for span, fields in N.PHASE_FIELDS.items()],
        "sourceEngineAssessments": [{"sourceId": x, "phaseSampleIds": {span: f"{x}-{span}-@K" for span in N.PHASE_FIELDS}, "supportedMechanismFields": N.FIELDS, "collectiveVerdict": "supported", **text} for x in s],
        "engineComparisons": [{"leftSourceId": a, "rightSourceId": b, "verdict": "distinct-variant", "semanticDifference": "other", "commercialConsequence": "so"} for a, b in (("s1", "s2"), ("s1", "s3"), ("s2", "s3"))],
        "checks": dict.fromkeys(N.CHECKS, True), "contentNeutrality": N.NEUTRALITY, "result": "pass",
    }, ensure_ascii=False)


# One answer a supplier; what is broken follows from its key, a sample's and a source's place too.
@query("g4_answer_violations", """
with s as (select s_suppkey k, s_suppkey % 3 i from supplier)
select k, '$' path, 'not-an-object' rule from s where k % 12 = 1 union all select k, '$', 'schema' from s where k % 12 = 2 union all select k, '$', 'identity' from s where k % 12 = 3
union all select k, '$.sampleVerdicts[' || 3 * i || ']', 'rationale' from s where k % 12 = 4
union all select k, '$.sampleVerdicts[' || (3 * i) || ']', unnest(['unbound']) from s where k % 12 = 5 union all select k, '$.sampleVerdicts', 'incomplete' from s where k % 12 = 5
union all select k, '$.sourceEngineAssessments[' || i || ']', unnest(['phase-samples', 'fields-of-samples', 'verdict-of-samples']) from s where k % 12 = 5 union all select k, '$.sourceEngineAssessments', 'samples-once' from s where k % 12 = 5
union all select k, '$.engineComparisons[0]', 'unproven-core' from s where k % 12 = 6 and k % 5 <> 0 union all select k, '$.engineComparisons[1]', 'same-mechanism' from s where k % 7 = 0 and k % 12 <> 1
union all select k, '$.checks', 'proven:rawSampleReadback' from s where k % 12 = 7 union all select k, '$.result', 'derived' from s where k % 12 = 8 union all select k, '$.contentNeutrality', unnest(['keys', 'automaticRewrite']) from s where k % 12 = 9
union all select k, '$.engineComparisons', 'pairs' from s where k % 12 = 10 union all select k, '$.engineComparisons[2]', unnest(['order']) from s where k % 12 = 10""")
def g4_answers(t):
    k = F.col("s_suppkey")
    key, place = k.cast("string"), (k % 3 + 1).cast("string")
    whole = F.replace(F.lit(_answer()), F.lit("@K"), key)
    swap = lambda old, new: F.replace(whole, old if not isinstance(old, str) else F.lit(old), new if not isinstance(new, str) else F.lit(new))
    first = F.concat(F.lit('"sampleId": "s'), place, F.lit("-early-"), key, F.lit('"'))
    blank = F.regexp_replace(whole, F.concat(F.lit("("), first, F.lit('.*?"rationale": )"why"')), F.lit('$1" "'))
    changes = {
        1: F.lit("["), 2: swap(N.SCHEMA, "v1"), 3: swap('"genre": "g"', '"genre": "h"'), 4: blank, 5: swap(first, '"sampleId": "none"'), 6: swap('"rightSourceId": "s2", "verdict": "distinct-variant"', '"rightSourceId": "s2", "verdict": "shared-core"'),
        7: swap('"rawSampleReadback": true', '"rawSampleReadback": "true"'), 8: swap('"result": "pass"', '"result": "needs-revision"'), 9: swap('"automaticRewrite": false', '"automatic": false'), 10: swap('"leftSourceId": "s2", "rightSourceId": "s3"', '"leftSourceId": "s3", "rightSourceId": "s2"'),
    }
    text = whole
    for n, changed in changes.items():
        text = F.when(k % 12 == n, changed).otherwise(text)
    samples = F.array(*[F.struct(F.concat(F.lit(f"s{x}-{span}-"), key).alias("sample_id"), F.lit(f"s{x}").alias("source_id"), F.lit(span).alias("span")) for x in (1, 2, 3) for span in N.PHASE_FIELDS])
    sources = F.array(*[F.struct(F.lit(f"s{x}").alias("source_id"), F.when((k % 7 == 0) & F.lit(x == 3), "sig1").otherwise(f"sig{x}").alias("signature")) for x in (1, 2, 3)])
    expected = t.supplier.select(k.alias("k"), F.lit("g").alias("genre"), F.concat(F.lit("soul-"), key).alias("soul_id"), F.lit("0" * 64).alias("profile_sha256"), F.concat(F.lit("run-"), key).alias("run_id"), samples.alias("samples"), sources.alias("sources"), (k % 5 == 0).alias("common_engine"))
    return N.answer_violations(t.supplier.select(k.alias("k"), text.alias("answer")), expected, "k")


@query("g9_core_manifest", """
select c_custkey k, 'not-an-object' rule, null::varchar item from customer where c_custkey % 50 = 49
union all select c_custkey, 'other:stylePolicy', null from customer where c_custkey % 50 <> 49 and c_custkey % 7 = 0 union all select c_custkey, 'too-little-evidence', null from customer where c_custkey % 50 <> 49 and c_custkey % 8 = 1
union all select c_custkey, 'evidence-qa', 'w1' from customer where c_custkey % 50 <> 49 and c_custkey % 9 = 2 union all select c_custkey, 'card-count', null from customer where c_custkey % 50 <> 49 and c_custkey % 10 = 3
union all select c_custkey, 'card-path', 'CHB-CORE-01' from customer where c_custkey % 50 <> 49 and c_custkey % 10 <> 3 and c_custkey % 11 = 4
union all select c_custkey, 'card-id-again', 'CHB-CORE-01' from customer where c_custkey % 50 <> 49 and c_custkey % 10 <> 3 and c_custkey % 12 = 5
union all select c_custkey, 'card-roles', 'CHB-CORE-03' from customer where c_custkey % 50 <> 49 and c_custkey % 10 <> 3 and c_custkey % 13 = 6
union all select c_custkey, 'other:version', null from customer where c_custkey % 50 <> 49 and c_custkey % 17 = 3""")
def g9(t):
    k = F.col("c_custkey")
    card = lambda i, name=None, path=None, roles='["Hook"]': F.concat(F.lit('{"id":"CHB-CORE-0'), name if name is not None else F.lit(str(i)), F.lit('","status":"production_ready","path":"'), path if path is not None else F.lit(f"materials/{i}.md"), F.lit('","roles":'), roles if not isinstance(roles, str) else F.lit(roles), F.lit("}"))
    cards = [card(1, path=F.when(k % 11 == 4, "materials/../1.md").otherwise("materials/1.md")), card(2, name=F.when(k % 12 == 5, "1").otherwise("2")), card(3, roles=F.when(k % 13 == 6, '["Hook","Nope"]').otherwise('["Hook"]')), card(4), card(5)]
    cards.append(F.when(k % 10 != 3, card(6)))
    proof = lambda i, qa: F.concat(F.lit(f'{{"workSlug":"w{i}","status":"GOLD_APPROVED","qa":"'), qa, F.lit('","referenceCard":"x/gold_reference_card.md"}'))
    proofs = F.concat_ws(",", proof(1, F.when(k % 9 == 2, "14/15").otherwise("15/15 PASS")), F.when(k % 8 != 1, proof(2, F.lit("15/15 PASS"))))
    head = {**V.CORE, "stylePolicy": None, "version": None}
    named = F.concat_ws(",", F.when(k % 17 == 3, '"version":"1"').otherwise('"version":1'), *[F.lit(f'"{c}":"{v}"') for c, v in head.items() if v], F.when(k % 7 != 0, f'"stylePolicy":"{V.CORE["stylePolicy"]}"'))
    manifest = F.concat(F.lit("{"), named, F.lit(',"productionEvidence":['), proofs, F.lit('],"cards":['), F.concat_ws(",", *cards), F.lit("]}"))
    return V.manifest_violations(t.customer.select(k.alias("k"), F.when(k % 50 == 49, "broken").otherwise(manifest).alias("manifest")), "k")


@query("g9_reference_cards", """
select doc_id id, unnest(list_filter([case when doc_id % 3 = 0 then 'heading' end, case when strlen(coalesce(text, '')) < 1300 and doc_id % 3 <> 0 or strlen(coalesce(text, '')) < 1300 then 'too-short' end, case when doc_id % 5 = 0 then 'private-path' end, case when doc_id % 7 = 0 then 'missing:## 실패 신호' end], lambda x: x is not null)) rule from documents""".replace("strlen(coalesce(text, '')) < 1300 and doc_id % 3 <> 0 or strlen(coalesce(text, '')) < 1300", "strlen(coalesce(text, '')) + strlen(case when doc_id % 3 = 0 then '' else '# ' || doc_id end) + case when doc_id % 5 = 0 then 16 else 0 end + 118 + case when doc_id % 7 = 0 then 0 else 16 end < 1500"))
def g9_cards(t):
    k = F.col("doc_id")
    marks = F.concat(*[F.when((k % 7 == 0) & F.lit(m == "## 실패 신호"), "").otherwise(m) for m in V.CARD_MARKERS])
    text = F.concat(F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("# "), k.cast("string"))), F.when(k % 5 == 0, "private_sources/").otherwise(""), marks, F.coalesce("text", F.lit("")))
    return V.card_violations(t.documents.select(k.cast("string").alias("id"), text.alias("text"))).select(F.col("id").cast("long").alias("id"), "rule")
