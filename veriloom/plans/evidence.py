"""Evidence checks: orders and line items as intervals, events as scored rows, labels as decisions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import validation as V
from ..operators import works as X
from ..shared import new_path, spread, written
from ..sources import files as S
from .registry import query

# Arcs: a customer's orders in their order, each as long as its line items.
_ARCS = """
o as (select o_custkey work, o_orderkey arc, count(*) n from orders join lineitem on l_orderkey = o_orderkey group by 1, 2),
arcs as (select work, arc, n, (sum(n) over (partition by work order by arc) - n + 1)::bigint s, (sum(n) over (partition by work order by arc))::bigint e from o)
"""


def arcs(t):
    n = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    rows = t.orders.join(n, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("work"), F.col("o_orderkey").alias("arc"), "n")
    end = F.sum("n").over(W.partitionBy("work").orderBy("arc"))
    return rows.withColumn("e", end).withColumn("s", F.col("e") - F.col("n") + 1)


def chapters(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("work"), "o_orderkey", "l_linenumber")
    return rows.select("work", F.col("o_orderkey").alias("true_arc"), F.row_number().over(W.partitionBy("work").orderBy("o_orderkey", "l_linenumber")).cast("long").alias("seq"))


_CHAPTERS = "ch as (select o_custkey work, o_orderkey true_arc, row_number() over (partition by o_custkey order by o_orderkey, l_linenumber) seq from lineitem join orders on l_orderkey = o_orderkey)"
# Arcs that overlap: each reaches two further and starts one earlier.
_WIDE = "wide as (select work, arc, greatest(1, s - 1) s, e + 2 e from arcs)"


def wide(t):
    return arcs(t).select("work", "arc", F.greatest(F.lit(1).cast("long"), F.col("s") - 1).alias("s"), (F.col("e") + 2).alias("e"))


@query("j1_first_interval", "with " + ", ".join([_ARCS, _CHAPTERS, _WIDE]) + """
select work, seq, (select min(arc) from wide where wide.work = ch.work and seq between s and e) arc from ch where work % 20 = 0 or true""".replace(" where work % 20 = 0 or true", ""))
def j1(t):
    return E.first_interval(chapters(t).drop("true_arc"), wide(t), "work", "seq", "s", "e", "arc", "arc")


@query("j2_last_interval", "with " + ", ".join([_ARCS, _CHAPTERS, _WIDE]) + """
select work, seq, (select arg_max(arc, (s, arc)) from wide where wide.work = ch.work and seq between s and e) arc from ch""")
def j2(t):
    return E.last_interval(chapters(t).drop("true_arc"), wide(t), "work", "seq", "s", "e", "arc")


@query("j3_positional_zip", """
with a as (select o_custkey work, o_orderkey v, row_number() over (partition by o_custkey order by o_orderkey) place from orders),
b as (select o_custkey work, o_orderkey v, row_number() over (partition by o_custkey order by o_orderkey) place from orders where o_orderkey % 50 <> 0)
select coalesce(a.work, b.work) work, coalesce(a.place, b.place) place, a.v left_value, b.v right_value from a full join b on a.work = b.work and a.place = b.place where a.v is distinct from b.v""")
def j3(t):
    rows = t.orders.select(F.col("o_custkey").alias("work"), F.col("o_orderkey").alias("v"))
    return E.positional(rows, rows.where("v % 50 <> 0"), "work", "v", "v").withColumn("place", F.col("place").cast("long"))


@query("j4_j20_reconcile_claims", """
with a as (select c_custkey k, c_nationkey, c_mktsegment from customer where c_custkey % 17 <> 0),
b as (select c_custkey k, case when c_custkey % 10 = 0 then c_nationkey + 1 else c_nationkey end c_nationkey, case when c_custkey % 14 = 0 then null else c_mktsegment end c_mktsegment from customer where c_custkey % 13 <> 0)
select coalesce(a.k, b.k) k, case when b.k is null then 'left-only' when a.k is null then 'right-only' when a.c_nationkey is distinct from b.c_nationkey or a.c_mktsegment is distinct from b.c_mktsegment then 'differs' else 'equal' end state,
  case when a.k is null or b.k is null then '' else array_to_string(list_filter([case when a.c_nationkey is distinct from b.c_nationkey then 'c_nationkey' end, case when a.c_mktsegment is distinct from b.c_mktsegment then 'c_mktsegment' end], lambda x: x is not null), ',') end unlike
from a full join b on a.k = b.k""")
def j4(t):
    c = t.customer.select(F.col("c_custkey").alias("k"), "c_nationkey", "c_mktsegment")
    other = c.where("k % 13 <> 0").select("k", F.when(F.col("k") % 10 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).alias("c_nationkey"), F.when(F.col("k") % 14 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return E.claims(c.where("k % 17 <> 0"), other, "k", ["c_nationkey", "c_mktsegment"])


@query("a1_selection_counts", """
with j as (select d.*, l.quality, l.toxic from documents d left join labels l using (doc_id))
select source, count(*) n, count(quality) selected, count(*) filter (quality = 1 and toxic = 0) eligible, count(*) filter (toxic = 1) rejected, count(*) filter (quality is null) unlabelled,
  count(*) filter (coalesce(n_chars, 0) > 1000) long_, count(*) filter (lang = 'en') english, count(*) filter (text is null) missing from j group by source""")
def j5(t):
    rows = t.documents.join(t.labels, "doc_id", "left")
    c = {"eligible": (F.col("quality") == 1) & (F.col("toxic") == 0), "rejected": F.col("toxic") == 1, "unlabelled": F.col("quality").isNull(), "long_": F.coalesce("n_chars", F.lit(0)) > 1000, "english": F.col("lang") == "en", "missing": F.col("text").isNull()}
    return E.counts(rows, "source", {"selected": F.col("quality").isNotNull(), **c})


@query("j15_u4_dangling_references", """
select l_orderkey, l_linenumber, l_partkey from lineitem where l_partkey not in (select p_partkey from part where p_size > 5)""")
def j15(t):
    return E.dangling(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), t.part.where("p_size > 5"), "l_partkey", "p_partkey")


@query("j16_selector_binding", """
select a.l_orderkey, a.l_linenumber, b.l_orderkey is not null bound from lineitem a
left join (select distinct l_orderkey, l_linenumber, l_partkey from lineitem where l_quantity < 45) b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber and a.l_partkey = b.l_partkey""")
def j16(t):
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    return E.bound(t.lineitem.select(*keys), t.lineitem.where("l_quantity < 45"), keys).select("l_orderkey", "l_linenumber", "bound")


@query("j17_pair_comparisons", """
with want as (select a.n_nationkey l, b.n_nationkey r from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey),
got as (select * from want where (l + r) % 3 <> 0)
select l, r, got.l is not null provided from want left join got using (l, r)""".replace("got.l is not null provided from want left join got using (l, r)", "exists (select 1 from got where got.l = want.l and got.r = want.r) provided from want"))
def j17(t):
    a = t.nation.select(F.col("n_nationkey").alias("l"), "n_regionkey")
    want = a.join(t.nation.select(F.col("n_nationkey").alias("r"), "n_regionkey"), "n_regionkey").where("l < r").select("l", "r")
    got = want.where("(l + r) % 3 <> 0").withColumn("g", F.lit(True))
    return want.join(got, ["l", "r"], "left").select("l", "r", F.col("g").isNotNull().alias("provided"))


@query("w2_interval_tiling", "with " + _ARCS + """,
x as (select work, arc, s + (arc % 11 = 0)::int s, e, n + (arc % 7 = 0)::int n from arcs),
y as (select *, coalesce(lag(e) over (partition by work order by s, e) + 1, 1) expected from x)
select 'interval-start' rule, count(*) n from y where s <> expected union all select 'interval-end', count(*) from y where e < s union all select 'interval-length', count(*) from y where n <> e - s + 1""")
def w2(t):
    bad = arcs(t).select("work", "arc", (F.col("s") + (F.col("arc") % 11 == 0).cast("int")).alias("s"), "e", (F.col("n") + (F.col("arc") % 7 == 0).cast("int")).alias("n"))
    found = E.tiling(bad, "work", "s", "e", "n", "arc").groupBy("rule").agg(F.count("*").alias("n"))
    names = t.spark.createDataFrame([("interval-start",), ("interval-end",), ("interval-length",)], "rule string")
    return names.join(found, "rule", "left").fillna(0)


@query("w3_w4_coverage", """
with c as (select source, doc_id, strlen(coalesce(text, ''))::bigint b from documents where coalesce(text, '') <> ''),
r as (select *, (sum(b) over (partition by source order by doc_id) - b)::bigint s, sum(b) over (partition by source)::bigint size from c),
x as (select *, s + b - (doc_id % 400 = 0)::int e from r),
y as (select *, lag(e, 1, 0::bigint) over (partition by source order by doc_id) p from x)
select source, bool_and(s = p and e > s) and arg_max(e, doc_id) = max(size) covered, bool_and(s >= p and e > s) sorted_apart from y group by source""")
def w3(t):
    rows = t.documents.where("coalesce(text, '') <> ''").select("source", "doc_id", F.octet_length("text").cast("long").alias("b"))
    by = W.partitionBy("source").orderBy("doc_id")
    rows = rows.withColumns({"upto": F.sum("b").over(by), "size": F.sum("b").over(W.partitionBy("source"))})
    rows = rows.withColumns({"s": F.col("upto") - F.col("b"), "e": F.col("upto") - (F.col("doc_id") % 400 == 0).cast("int")})
    return E.full_coverage(rows, "source", "s", "e", "doc_id", "size").join(E.partial_coverage(rows, "source", "s", "e", "doc_id"), "source")


@query("w6_dense_sequence", """
with x as (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber) place from lineitem where l_partkey % 9 <> 0)
select l_orderkey, l_linenumber::bigint l_linenumber, place from x where l_linenumber <> place""")
def w6(t):
    rows = E.dense(t.lineitem.where("l_partkey % 9 <> 0"), "l_orderkey", "l_linenumber", ["l_linenumber"])
    return rows.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("place").cast("long").alias("place"))


@query("w18_duplicate_selectors", """
with x as (select l_orderkey, l_partkey, l_suppkey, lag(l_partkey) over w p, lag(l_suppkey) over w q from lineitem window w as (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber))
select l_orderkey, l_partkey, l_suppkey from x where l_partkey = p and l_suppkey = q""")
def w18(t):
    w = W.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber")
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", F.lag("l_partkey").over(w).alias("p"), F.lag("l_suppkey").over(w).alias("q"))
    return rows.where("l_partkey = p and l_suppkey = q").drop("p", "q")


@query("a6_o5_modal_value", """
with n as (select o_orderpriority g, count(*) n from orders group by 1),
c as (select o_orderpriority g, o_orderstatus v, count(*) c, min(o_orderkey) f from orders group by 1, 2),
t as (select g, arg_max(v, (c, -f)) value, max(c) c from c group by g)
select g, value, c "count", n, c >= greatest(5, ceil(n * 0.12)) warned from t join n using (g)""")
def a6(t):
    return E.modal_value(t.orders.withColumnRenamed("o_orderpriority", "g"), "g", "o_orderstatus", "o_orderkey")


@query("a7_score_shape", """
with x as (select user_id, case when user_id % 13 = 0 then value else 1 + floor(abs(value))::bigint % (1 + user_id % 10) end s from events),
y as (select user_id, count(*) filter (s is null or s % 1 <> 0 or s < 1 or s > 10) bad, count(distinct s) different, count(*) n from x group by user_id)
select *, case when bad > 0 then 'out-of-range' when n >= 20 and different < 4 then 'flat' else 'ok' end verdict from y""")
def a7(t):
    s = F.when(F.col("user_id") % 13 == 0, F.col("value")).otherwise(1 + F.floor(F.abs("value")) % (1 + F.col("user_id") % 10))
    return E.score_shape(t.events.select("user_id", s.cast("double").alias("s")), "user_id", "s")


_SCALE = """
x as (select l_orderkey, l_linenumber, case l_linenumber % 4 when 0 then l_quantity / 50.0 when 1 then 1 + floor(l_quantity / 6) when 2 then l_quantity else l_quantity - 3 end a, case l_linenumber % 4 when 0 then 1 - l_quantity / 50.0 when 1 then 2.0 when 2 then 100 - l_quantity else 5.5 end b from lineitem),
y as (select *, case when a is null or b is null then 'non-numeric' when a % 1 = 0 and a between 1 and 10 and b % 1 = 0 and b between 1 and 10 then 'intensity' when a between 0 and 1 and b between 0 and 1 then 'ratio' when a between 0 and 100 and b between 0 and 100 and (a > 10 or b > 10) then 'percentage' else 'invalid' end scale from x)
"""


@query("a8_row_scales", "with " + _SCALE + """
select l_linenumber % 4 g, scale, count(*) n, count(*) filter (case scale when 'ratio' then abs(a + b - 1) <= 0.01 when 'percentage' then abs(a + b - 100) <= 1 else scale = 'intensity' end) sums_ok from y group by 1, 2""")
def a8(t):
    k, q = F.col("l_linenumber") % 4, F.col("l_quantity")
    a = F.when(k == 0, q / 50.0).when(k == 1, 1 + F.floor(q / 6)).when(k == 2, q).otherwise(q - 3)
    b = F.when(k == 0, 1 - q / 50.0).when(k == 1, 2.0).when(k == 2, 100 - q).otherwise(5.5)
    rows = t.lineitem.select(k.alias("g"), a.alias("a"), b.alias("b"))
    rows = rows.withColumn("scale", E.row_scale([F.col("a"), F.col("b")]))
    return rows.groupBy("g", "scale").agg(F.count("*").alias("n"), F.count_if(E.scale_sum_ok(F.col("scale"), [F.col("a"), F.col("b")])).alias("sums_ok"))


@query("a8_mixed_scales", "with " + _SCALE + """
select l_orderkey, count(*) n, count(*) filter (scale = 'non-numeric') non_numeric, count(*) filter (scale = 'invalid') invalid, count(*) filter (scale = 'intensity') intensity, count(*) filter (scale = 'ratio') ratio, count(*) filter (scale = 'percentage') percentage,
  count(*) filter (scale = 'ratio' and abs(a + b - 1) > 0.01) bad_ratio_sums, count(*) filter (scale = 'percentage' and abs(a + b - 100) > 1) bad_percentage_sums, count(distinct scale) filter (scale in ('ratio', 'percentage', 'intensity')) > 1 mixed from y group by 1""")
def a8_mixed(t):
    k, q = F.col("l_linenumber") % 4, F.col("l_quantity")
    a = F.when(k == 0, q / 50.0).when(k == 1, 1 + F.floor(q / 6)).when(k == 2, q).otherwise(q - 3)
    b = F.when(k == 0, 1 - q / 50.0).when(k == 1, 2.0).when(k == 2, 100 - q).otherwise(5.5)
    return V.mixed_scales(t.lineitem.select("l_orderkey", a.alias("a"), b.alias("b")), "l_orderkey", [F.col("a"), F.col("b")])


@query("a9_length_shape", "with " + _ARCS + """
select work, count(*) n, count(*) filter (n <= 3) short, max(n) longest, count(*) >= 12 and count(*) filter (n <= 3) / count(*) >= 0.65 and max(n) <= 8 packet_like from o group by work""")
def a9(t):
    return E.length_shape(arcs(t).withColumnRenamed("n", "length"), "work", "length")


@query("a10_formula_frequency", r"""
select source, count(*) n, count(*) filter (regexp_matches(coalesce(text, ''), 'tion\.')) hits, count(*) >= 20 and count(*) filter (regexp_matches(coalesce(text, ''), 'tion\.')) >= greatest(8, ceil(count(*) * 0.25)) formulaic from documents group by source""")
def a10(t):
    return E.formula_frequency(t.documents, "source", "text", r"tion\.", 0.25)


@query("a19_support_counts", """
select p_partkey, count(distinct l_suppkey) sources, case p_size % 4 when 0 then 'common' when 1 then 'conditional' when 2 then 'specific' else 'failure' end classification,
  case p_size % 4 when 0 then count(distinct l_suppkey) = 3 when 1 then count(distinct l_suppkey) between 2 and 3 when 2 then count(distinct l_suppkey) = 1 else count(distinct l_suppkey) between 1 and 3 end supported
from lineitem join part on l_partkey = p_partkey group by p_partkey, p_size""")
def a19(t):
    from ..operators.scoring import support_rule

    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_partkey", "p_size").agg(F.countDistinct("l_suppkey").alias("sources"))
    kind = F.element_at(F.array(*map(F.lit, ("common", "conditional", "specific", "failure"))), (F.col("p_size") % 4 + 1).cast("int"))
    return rows.select("p_partkey", "sources", kind.alias("classification")).withColumn("supported", support_rule(F.col("classification"), F.col("sources")))


@query("a20_a26_b7_u5_exact_partition", """
with parts as (select n_nationkey k from nation where n_regionkey < 3 union all select n_nationkey from nation where n_regionkey between 2 and 3), p as (select k, count(*) t from parts group by k)
select n_nationkey k, coalesce(t, 0)::bigint times, true wanted from nation left join p on k = n_nationkey""")
def a20(t):
    n = t.nation.select(F.col("n_nationkey").alias("k"), "n_regionkey")
    parts = n.where("n_regionkey < 3").select("k").unionByName(n.where("n_regionkey between 2 and 3").select("k"))
    return E.partition_of(parts, n, "k")


@query("a21_a22_u6_invariants", """
select user_id, count(*) n, count(distinct event_type) types, count(distinct event_type) = 1 uniform, count(distinct event_id) = count(*) ids_unique, strftime(max(ts), '%Y-%m-%d %H:%M:%S') latest from events group by user_id""")
def a21(t):
    rows = t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("types"), F.countDistinct("event_id").alias("ids"), F.max("ts").alias("ts"))
    return rows.select("user_id", "n", "types", (F.col("types") == 1).alias("uniform"), (F.col("ids") == F.col("n")).alias("ids_unique"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("latest"))


@query("a28_totals_agree", """
select o_orderkey, round(o_totalprice, 2) stated, round(sum(l_extendedprice), 2) summed, abs(o_totalprice - sum(l_extendedprice)) < 0.01 agree from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_totalprice""")
def a28(t):
    rows = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("s")).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("o_orderkey", F.round("o_totalprice", 2).alias("stated"), F.round("s", 2).alias("summed"), (F.abs(F.col("o_totalprice") - F.col("s")) < 0.01).alias("agree"))


@query("o2_o3_o6_sorted_samples", """
select o_custkey, array_to_string(list_sort(list(o_orderkey))[1:5], ',') first_five, array_to_string(list_sort(list(distinct o_orderpriority)), ',') priorities from orders group by o_custkey""")
def o6(t):
    text = lambda c: F.array_join(c, ",")
    return t.orders.groupBy("o_custkey").agg(text(F.slice(F.array_sort(F.collect_list("o_orderkey")), 1, 5).cast("array<string>")).alias("first_five"), text(F.array_sort(F.collect_set("o_orderpriority"))).alias("priorities"))


@query("o1_korean_order", """
with w as (select p_partkey, p_size, chr(44032 + (p_partkey * 7919 % 11172)::int) || chr(44032 + (p_partkey * 104729 % 11172)::int) title from part)
select p_partkey, title, row_number() over (partition by p_size order by title, p_partkey) place from w""")
def o1(t):
    # Composed Hangul syllables are in dictionary order by code point too, which is what the SQL relies on.
    code = lambda m: F.decode(F.unhex(F.lpad(F.hex(44032 + F.col("p_partkey") * m % 11172), 4, "0")), "UTF-16BE")
    rows = t.part.select("p_partkey", "p_size", F.concat(code(7919), code(104729)).alias("title"))
    order = W.partitionBy("p_size").orderBy(F.expr("title collate ko"), "p_partkey")
    return rows.withColumn("place", F.row_number().over(order).cast("long")).drop("p_size")


# Titles where the collation and code points differ: letters of either case, single jamo, blanks, digits, marks.
@query("o1_korean_titles", """
with w as (select p_partkey, p_size, case p_partkey % 7 when 0 then lower(p_name) when 1 then upper(p_name) when 2 then chr(12593 + (p_partkey % 30)::int) || p_partkey when 3 then chr(4352 + (p_partkey % 19)::int) when 4 then ' ' || p_name when 5 then chr(44032 + (p_partkey * 7919 % 11172)::int) || 'é' else '_' || p_partkey end title from part)
select p_partkey, title, row_number() over (partition by p_size order by title collate ko, p_partkey) place from w""")
def o1_titles(t):
    k, name = F.col("p_partkey"), F.col("p_name")
    char = lambda code: F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")
    forms = [F.lower(name), F.upper(name), F.concat(char(12593 + k % 30), k.cast("string")), char(4352 + k % 19), F.concat(F.lit(" "), name), F.concat(char(44032 + k * 7919 % 11172), F.lit("é")), F.concat(F.lit("_"), k.cast("string"))]
    rows = t.part.select("p_partkey", "p_size", F.get(F.array(*forms), (k % 7).cast("int")).alias("title"))
    order = W.partitionBy("p_size").orderBy(F.expr("title collate ko"), "p_partkey")
    return rows.withColumn("place", F.row_number().over(order).cast("long")).drop("p_size")


# All twelve claims of a grant against its selector, a different one broken by each row.
_CLAIMS = ("requestId", "packetId", "packetSha256", "matchId", "selectorSha256", "coordinateKind", "sourceId", "sourceSha256", "startByte", "endByte", "expectedSliceSha256", "maxBytes")


@query("j20_grant_claims", """
with k as (select o_orderkey k from orders)
select k, case when k % 29 = 12 then 'left-only' when k % 29 = 13 then 'right-only' when k % 29 < 12 then 'differs' else 'equal' end state, case when k % 29 < 12 then [@NAMES][k % 29 + 1] else '' end unlike from k""".replace("@NAMES", ", ".join(f"'{c}'" for c in _CLAIMS)))
def j20(t):
    k = F.col("k")
    rows = t.orders.select(F.col("o_orderkey").alias("k"), "o_custkey", "o_orderstatus", "o_orderpriority")
    text = F.concat_ws("/", F.col("o_custkey").cast("string"), "o_orderstatus", "o_orderpriority")
    made = {c: F.sha2(F.concat(F.lit(c), text), 256) if c.endswith("256") else F.col("o_custkey") + i if c.endswith(("Byte", "Bytes")) else F.concat(F.lit(c), text) for i, c in enumerate(_CLAIMS)}
    grants = rows.where(k % 29 != 13).select("k", *[v.alias(c) for c, v in made.items()])
    broken = {c: F.when(k % 29 == i, F.lit(None) if i % 2 else (v + 1 if c.endswith(("Byte", "Bytes")) else F.concat(v, F.lit("x")))).otherwise(v) for i, (c, v) in enumerate(made.items())}
    selectors = rows.where(k % 29 != 12).select("k", *[v.alias(c) for c, v in broken.items()])
    return E.claims(grants, selectors, "k", list(_CLAIMS))


# Observations by chapters, by ranges, by both (no selectors), and by a chapter that isn't there.
@query("p9_chapter_selectors", "with " + _ARCS.strip() + """,
i as (select work, row_number() over (partition by work order by arc) q, (s - 1) * 10 a, e * 10 b from arcs), w as (select distinct work from arcs),
c as (select work, unnest(case when work % 4 = 0 then [2, 1, 2] when work % 4 = 3 then [1, 9999] else [] end) q from w),
r as (select work, unnest([5, 0, 5]) a, unnest([9, 5, 9]) b from w where work % 4 = 1),
x as (select c.work, c.q, a, b from c left join i on i.work = c.work and i.q = c.q union all select work, null, a, b from r),
ob as (select *, row_number() over (partition by work order by a nulls first, b nulls first, coalesce(q, -1)) place, lag(a) over (partition by work order by a nulls first, b nulls first, coalesce(q, -1)) = a and lag(b) over (partition by work order by a nulls first, b nulls first, coalesce(q, -1)) = b again from x)
select work, q::bigint "sequence", a::bigint start_byte, b::bigint end_byte, place, coalesce(again, false) repeated from ob""")
def p9_chapters(t):
    from ..operators.segment import observation_selectors

    a = arcs(t)
    index = a.select("work", F.row_number().over(W.partitionBy("work").orderBy("arc")).alias("sequence"), ((F.col("s") - 1) * 10).cast("long").alias("start_byte"), (F.col("e") * 10).cast("long").alias("end_byte"))
    k = F.col("work") % 4
    numbers = lambda *xs: F.array(*[F.lit(x) for x in xs])
    ranges = F.array(*[F.struct(F.lit(x).cast("long").alias("start_byte"), F.lit(y).cast("long").alias("end_byte")) for x, y in ((5, 9), (0, 5), (5, 9))])
    seen = a.select("work").distinct().select("work", F.lit("o").alias("name"), F.when(k.isin(0, 2), numbers(2, 1, 2)).when(k == 3, numbers(1, 9999)).alias("sequences"), F.when(k.isin(1, 2), ranges).alias("ranges"))
    found = observation_selectors(seen, index, "work", "name", "sequences", "ranges").drop("name")
    return found.withColumns({"sequence": F.col("sequence").cast("long"), "place": F.col("place").cast("long")})


@query("a21_a22_runs_by_status", """
select o_custkey, count(distinct o_orderstatus) = 1 uniform, case when count(distinct o_orderstatus) = 1 then max(o_orderstatus) end state, strftime(max(o_orderdate) filter (o_orderstatus = 'F'), '%Y-%m-%d') latest from orders group by 1""")
def a21_runs(t):
    found = E.uniform_state(t.orders, "o_custkey", "o_orderstatus").join(E.latest_completion(t.orders, "o_custkey", "o_orderdate", F.col("o_orderstatus") == "F"), "o_custkey")
    return found.select("o_custkey", "uniform", "state", F.date_format("latest", "yyyy-MM-dd").alias("latest"))


@query("u1_u2_u3_set_checks", """
with s as (select o_custkey k, list(o_orderstatus order by o_orderkey) xs from orders group by o_custkey)
select k, array_to_string(list_sort(list_distinct(xs)), '') distinct_sorted, xs = list_sort(list_distinct(xs)) unique_sorted, list_sort(list_distinct(xs)) = ['F', 'O', 'P'] complete, len(list_filter(list_distinct(xs), lambda x: x not in ('F', 'O'))) = 0 subset from s""")
def u1(t):
    rows = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda x: x["o_orderstatus"]).alias("xs"))
    own = F.array_sort(F.array_distinct("xs"))
    two = F.array(F.lit("F"), F.lit("O"))
    return rows.select("k", F.array_join(own, "").alias("distinct_sorted"), (F.col("xs") == own).alias("unique_sorted"), (own == F.array(F.lit("F"), F.lit("O"), F.lit("P"))).alias("complete"), (F.size(F.array_except("xs", two)) == 0).alias("subset"))


@query("g12_s16_violations", """
with o as (select o_orderkey, o_orderstatus, o_totalprice, o_custkey, row_number() over (partition by o_custkey order by o_orderkey) place from orders)
select 'error' severity, 'status' rule, o_orderkey::varchar detail from o where o_orderstatus not in ('F', 'O')
union all select 'warning', 'price', o_orderkey::varchar from o where o_totalprice > 400000
union all select 'error', 'reference', o_orderkey::varchar from o where o_custkey not in (select c_custkey from customer)
union all select 'warning', 'crowded', o_orderkey::varchar from o where place > 15""")
def g12(t):
    o = t.orders.withColumn("place", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")))
    lost = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    key = F.col("o_orderkey")
    return E.union([
        E.violation(o, ~F.col("o_orderstatus").isin("F", "O"), "status", key), E.violation(o, F.col("o_totalprice") > 400000, "price", key, "warning"),
        E.violation(lost, F.lit(True), "reference", key), E.violation(o, F.col("place") > 15, "crowded", key, "warning"),
    ])


_WORK = """
with oc as (select o_custkey work, o_orderkey arc, count(*) n from orders join lineitem on l_orderkey = o_orderkey group by 1, 2),
ar as (select work, arc, n, row_number() over w row_no, (sum(n) over w - n + 1)::bigint + (arc % 53 = 0)::int s, (sum(n) over w)::bigint e, n + (arc % 59 = 0)::int c from oc window w as (partition by work order by arc)),
tr as (select work, arc, n, (sum(n) over w - n + 1)::bigint s, (sum(n) over w)::bigint e from oc window w as (partition by work order by arc)),
ch as (select o_custkey work, o_orderkey arc, row_number() over (partition by o_custkey order by o_orderkey, l_linenumber) seq from lineitem join orders on l_orderkey = o_orderkey),
mk as (select work, count(*) m from ch group by work)
"""


def _work(t):
    c = written(chapters(t))
    k = F.col("arc")
    text = lambda x: x.cast("string")
    order = W.partitionBy("work").orderBy("arc")
    a = written(arcs(t)).select("work", "arc", F.row_number().over(order).alias("row_no"), text(k).alias("arc_id"), text(F.col("s") + (k % 53 == 0).cast("int")).alias("start_sequence"), text(F.col("e")).alias("end_sequence"), text(F.col("n") + (k % 59 == 0).cast("int")).alias("episode_count"), *[text(k).alias(x) for x in V.REPEATS["arcs"]])
    seq, arc = F.col("seq"), F.col("true_arc")
    sequence = text(F.when(seq % 67 == 0, 0).otherwise(seq))
    told = F.when(arc % 61 == 0, "zz").otherwise(text(arc))
    ch = c.select("work", seq.alias("row_no"), sequence.alias("sequence"), told.alias("arc_id"), *[text(seq).alias(x) for x in V.REPEATS["chapters"]])
    pa = c.select("work", seq.alias("row_no"), text(seq).alias("sequence"), text(arc).alias("arc_id"), *[text(1 + seq % 10).alias(x) for x in V.SCORES], *[F.lit("5").alias(x) for x in V.WEIGHTS], text(seq).alias("pacing_note"), text(seq).alias("concrete_event"))
    works = c.groupBy("work").agg((F.count("*") + (F.col("work") % 71 == 0).cast("int")).alias("marker_count"))
    return works, ch, a.drop("arc"), pa


@query("g12_work_validation", _WORK + """,
laid as (select work, unnest(range(s, e + 1)) q, arc, s from ar where e >= s),
law as (select work, q, arg_max(arc, s) arc from laid group by 1, 2),
r as (
select work, 'chapters:row-count' rule, m::varchar detail from mk where work % 71 = 0 union all select work, 'pacing:row-count', m::varchar from mk where work % 71 = 0
union all select work, 'arcs:coverage', m::varchar from mk where work % 71 = 0
union all select work, 'chapters:sequence', '0' from ch where seq % 67 = 0
union all select work, 'arcs:start', arc::varchar from ar where arc % 53 = 0
union all select work, 'arcs:end', arc::varchar from ar where e < s
union all select work, 'arcs:episode-count', arc::varchar from ar where c <> e - s + 1
union all select work, 'chapters:unknown-arc', 'zz' from ch where arc % 61 = 0
union all select work, 'chapters:other-arc', seq::varchar from ch join law on law.work = ch.work and q = seq where seq % 67 <> 0 and (arc % 61 = 0 or law.arc <> ch.arc)
union all select work, 'pacing:other-arc', seq::varchar from ch join law on law.work = ch.work and q = seq where law.arc <> ch.arc)
select work, 'error' severity, rule, detail from r""".replace("select work, 'chapters:other-arc', seq::varchar from ch", "select ch.work, 'chapters:other-arc', seq::varchar from ch").replace("select work, 'pacing:other-arc', seq::varchar from ch", "select ch.work, 'pacing:other-arc', seq::varchar from ch").replace("(arc % 61 = 0 or", "(ch.arc % 61 = 0 or"))
def g12_work(t):
    return V.work_errors(*_work(t))


# Warnings of every kind: repeated cells, flat and impossible scores, weights of several scales, formulas, packets of short arcs.
@query("g12_work_warnings", _WORK + """,
x as (select work, seq, (1 + seq % 3)::varchar state, case when seq % 45 = 44 then 11 else 1 + seq % 10 end reward, case when seq % 90 = 7 then 'x' when seq % 4 = 0 then '0.2' when seq % 4 = 1 then '0.3' when seq % 4 = 2 then '20' else '5' end weight, seq % 3 = 0 as noted, seq % 5 <> 0 as moved from ch),
n as (select work, count(*) n from x group by 1),
c as (select work, state, count(*) c from x group by 1, 2), m as (select work, max(c) c, any_value(n) n from c join n using (work) group by 1),
s as (select work, count(*) filter (reward > 10) bad, count(distinct reward) kinds, count(*) n from x group by 1),
w as (select work, count(*) filter (weight = 'x') bad, count(*) filter (weight in ('0.2', '0.3')) ratio, count(*) filter (weight = '0.3') off, count(*) filter (weight = '20') percentage, count(*) filter (weight = '5') intensity from x group by 1),
f as (select work, count(*) filter (noted) a, count(*) filter (moved) b, count(*) n from x group by 1),
p as (select work, count(*) n, count(*) filter (c <= 3) short, max(c) longest from ar group by 1)
select work, rule, detail from (
select work, 'chapters:repeated:entry_state' rule, c::varchar detail from m where c >= greatest(5, ceil(n * 0.12))
union all select work, 'pacing:scores:tension_1_10', 'flat' from n where n >= 20
union all select work, 'pacing:scores:reward_1_10', 'out-of-range' from s where bad > 0 union all select work, 'pacing:scores:reward_1_10', 'flat' from s where bad = 0 and n >= 20 and kinds < 4
union all select work, 'pacing:weights:non_numeric', bad::varchar from w where bad > 0 union all select work, 'pacing:weights:bad_ratio_sums', off::varchar from w where off > 0
union all select work, 'pacing:weights:mixed', intensity || ':' || ratio || ':' || percentage from w where (intensity > 0)::int + (ratio > 0)::int + (percentage > 0)::int > 1
union all select work, 'pacing:formula:pacing_note', a::varchar from f where n >= 20 and a >= greatest(8, ceil(n * 0.25)) union all select work, 'pacing:formula:concrete_event', b::varchar from f where n >= 20 and b >= greatest(8, ceil(n * 0.6))
union all select work, 'arcs:packet-like', short::varchar from p where n >= 12 and short / n >= 0.65 and longest <= 8)""")
def g12_warnings(t):
    works, ch, a, pa = _work(t)
    seq = F.col("row_no")
    ch = ch.withColumn("entry_state", (1 + seq % 3).cast("string"))
    weight = F.when(seq % 90 == 7, "x").when(seq % 4 == 0, "0.2").when(seq % 4 == 1, "0.3").when(seq % 4 == 2, "20").otherwise("5")
    pa = pa.withColumns({x: weight for x in V.WEIGHTS} | {"tension_1_10": F.lit("5"), "reward_1_10": F.when(seq % 45 == 44, 11).otherwise(1 + seq % 10).cast("string")})
    pa = pa.withColumns({"pacing_note": F.when(seq % 3 == 0, F.concat(F.lit("다음 추진="), seq.cast("string"))).otherwise(F.col("pacing_note")), "concrete_event": F.when(seq % 5 != 0, F.concat(seq.cast("string"), F.lit(" → x"))).otherwise(F.col("concrete_event"))})
    return V.work_warnings(works, ch, a, pa).select("work", "rule", "detail")


# A folder for each supplier: source, receipt, documents and tables; some missing, broken, short, or other than the receipt says.
_FILES = """
w as (select s_suppkey k, s_suppkey % 5 + 3 m from supplier), s as (select k, m, sha256(string_agg('ⓚ' || i || chr(10), '' order by i)) sha from w, unnest(range(1, m + 1)) r(i) group by k, m),
r as (select k, 'source:sha256' rule, '' detail from s where k % 7 = 1 union all select k, 'source:markers', '' from s where k % 9 = 2
union all select k, 'receipt:unreadable', '' from s where k % 17 = 3 union all select k, 'receipt:sourceSha256', '' from s where k % 17 <> 3 and k % 7 = 1 union all select k, 'receipt:markerCount', '' from s where k % 17 <> 3 and (k % 11 = 4 or k % 9 = 2)
union all select k, 'receipt:analysisCoverage', '' from s where k % 17 <> 3 and k % 13 = 5
union all select k, 'document:unreadable', 'project_bible.md' from s where k % 19 = 6 union all select k, 'document:too-small', 'arc_atlas.md' from s where k % 3 = 1 union all select k, 'document:forbidden-term', 'completion_receipt.md' from s where k % 10 = 3
union all select k, 'table:unreadable', 'arc_map.csv' from s where k % 16 = 7 union all select k, 'table:header', 'arc_pacing.csv' from s where k % 23 = 8 union all select k, 'table:cell-count', 'chapter_map.csv' from s where k % 14 = 9 union all select k, 'table:forbidden-term', 'chapter_map.csv' from s where k % 12 = 10
union all select k, unnest(['chapters:row-count', 'pacing:row-count']), m::varchar from s where k % 9 = 2
union all select k, 'arcs:coverage', case when k % 16 = 7 then '' else m::varchar end from s where k % 16 = 7 or k % 9 = 2
union all select k, unnest(['chapters:unknown-arc', 'pacing:unknown-arc']), 'A1' from s, unnest(range(m)) u(i) where k % 16 = 7)
"""


@query("g12_s1_s2_s4_s6_work_files", "with " + _FILES.strip() + " select k::varchar work, rule, detail from r")
def g12_files(t):
    k, m = F.col("k"), F.col("m")
    w = t.supplier.select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") % 5 + 3).cast("int").alias("m"))
    lines = lambda f: F.array_join(F.transform(F.sequence(F.lit(1), m), f), "\n")
    body = lines(lambda i: F.concat(F.lit(X.MARK), i.cast("string")))
    sha = F.sha2(F.concat(body, F.lit("\n")), 256)
    row = lambda columns, own: lambda i: F.concat_ws(",", *[own(i).get(c, F.concat(F.lit(f"{c[:3]}"), i.cast("string"))) for c in columns])
    names = {n: c.split(",") for n, c in X.TABLES.items()}
    text = lambda x: x.cast("string")
    chapter = row(names["chapter_map.csv"], lambda i: {"sequence": text(i), "arc_id": F.lit("A1"), "title": F.when(i == 1, F.when(k % 12 == 10, "자폐증").otherwise('"a ""b"", c"')).otherwise(F.concat(F.lit("t"), text(i)))})
    pacing = row(names["arc_pacing.csv"], lambda i: {"sequence": text(i), "arc_id": F.lit("A1")} | {c: F.lit("5") for c in V.WEIGHTS} | {c: text(i) for c in V.SCORES})
    arc = row(names["arc_map.csv"], lambda i: {"arc_id": F.lit("A1"), "start_sequence": F.lit("1"), "end_sequence": text(m), "episode_count": text(m), "arc_name": F.when(k % 16 == 7, '"open').otherwise('"two\nlines"')})
    head = lambda n: F.lit(X.TABLES[n] + "\n")
    receipt = F.concat(F.lit('{"sourceSha256":"'), sha, F.lit('","markerCount":'), F.when(k % 11 == 4, F.concat(F.lit('"'), text(m), F.lit('"'))).otherwise(text(m)), F.lit(',"analysisCoverage":"'), F.when(k % 13 == 5, "part").otherwise("full"), F.lit('"}'))
    files = {
        "source.txt": body, X.RECEIPT: F.when(k % 17 == 3, "{").otherwise(receipt),
        **{n: F.repeat(F.lit("x"), size) for n, size in X.DOCUMENTS.items()}, "project_bible.md": F.when(k % 19 != 6, F.repeat(F.lit("x"), 8_000)),
        "arc_atlas.md": F.when(k % 3 == 1, "short").otherwise(F.repeat(F.lit("x"), 15_000)), "completion_receipt.md": F.concat(F.when(k % 10 == 3, "자폐증").otherwise(""), F.repeat(F.lit("x"), 800)),
        "chapter_map.csv": F.concat(head("chapter_map.csv"), lines(chapter), F.when(k % 14 == 9, ",more").otherwise("")), "arc_map.csv": F.concat(head("arc_map.csv"), arc(F.lit(1))),
        "arc_pacing.csv": F.concat(F.when(k % 23 == 8, F.concat(F.lit("\ufeff"), F.replace(head("arc_pacing.csv"), F.lit("pacing_note"), F.lit("note")))).otherwise(head("arc_pacing.csv")), lines(pacing)),
    }
    path = new_path(t.spark)
    listed = F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(n).alias("name"), c.alias("text"))) for n, c in files.items()]))
    rows = spread(w).select(k.alias("work"), F.explode(listed).alias("f")).select("work", "f.*")
    at = F.concat(F.col("work").cast("string"), F.lit("/"), "name")
    S.write_files(rows.select(at.alias("at"), F.concat("text", F.lit("\n")).alias("text")), path)
    found = S.streamed_digests(t.spark, w.select(F.concat(F.lit(f"{path}/"), text(k), F.lit("/source.txt")).alias("path")), X.MARK).withColumn("work", F.regexp_extract("path", "/([^/]+)/source.txt$", 1))
    works = w.select(k.alias("work"), F.when(k % 7 == 1, "0").otherwise(sha).alias("sha256"), (m + (k % 9 == 2).cast("int")).alias("marker_count"))
    return X.work_file_violations(t.spark, works, found, path).where("severity = 'error'").select("work", "rule", "detail")
