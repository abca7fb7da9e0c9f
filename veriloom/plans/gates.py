"""Scores, verdicts and gates over events, labels and orders."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import scoring as G
from .registry import query


@query("g1_commercial_score", """
select l_orderkey, l_linenumber, floor((0.7 * ((l_quantity + 50 + l_tax * 1000 + l_discount * 900 + 60) / 5.0) + 0.3 * ((l_quantity * 2 + 40 + 30) / 3.0)) * 10.0 + 0.5) / 10.0 score from lineitem""")
def g1(t):
    main = [F.col("l_quantity"), F.lit(50), F.col("l_tax") * 1000, F.col("l_discount") * 900, F.lit(60)]
    return t.lineitem.select("l_orderkey", "l_linenumber", G.commercial_score(main, [F.col("l_quantity") * 2, F.lit(40), F.lit(30)]).alias("score"))


@query("g2_consistency", """
select o_custkey, bool_and((o_orderstatus = 'F') = (o_totalprice < 100000)) consistent_, count(*) n from orders group by 1""")
def g2(t):
    violations = F.when(F.col("o_totalprice") < 100000, F.array().cast("array<string>")).otherwise(F.array(F.lit("price")))
    ok = G.consistent(violations, [F.array(F.lit("e"))], F.col("o_orderstatus") == "F", F.lit(True))
    return t.orders.groupBy("o_custkey").agg(F.bool_and(ok).alias("consistent_"), F.count("*").alias("n"))


@query("g3_promotion", """
with p as (select c_nationkey g, o_custkey % 3 pair, (o_totalprice % 9)::bigint - 3 gain, 70 + (o_orderkey % 30) score, (o_orderkey % 5000 = 0)::int leak from orders join customer on o_custkey = c_custkey),
a as (select g, count(distinct pair) pairs, count(*) filter (gain > 0) wins, floor(avg(score) * 1000 + 0.5) / 1000 mean_score, min(gain) filter (gain > 0) least_gain, sum(leak)::bigint leaks from p group by g)
select *, pairs = 3 and wins >= 2 and mean_score >= 85 and coalesce(least_gain >= 2, false) and leaks = 0 eligible from a""".replace("(o_totalprice % 9)::bigint", "floor(o_totalprice % 9)::bigint"))
def g3(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(F.col("c_nationkey").alias("g"), (F.col("o_custkey") % 3).alias("pair"), (F.floor(F.col("o_totalprice") % 9).cast("long") - 3).alias("gain"), (70 + F.col("o_orderkey") % 30).alias("score"), (F.col("o_orderkey") % 5000 == 0).cast("int").alias("leak"))
    out = G.promotion(rows, "g", "pair", "gain", "score", "leak")
    return out.select("g", "pairs", "wins", (F.floor(F.col("mean_score") * 1000 + 0.5) / 1000).alias("mean_score"), "least_gain", "leaks", "eligible")


@query("g3_promotion_conditions", """
with k as (select c_custkey k from customer)
select k, 'status' rule from k where k % 23 = 0 union all select k, 'deep-reads' from k where k % 24 = 1 union all select k, 'packet-schema' from k where k % 25 = 2 union all select k, 'blind-pairs' from k where k % 26 = 3
union all select k, 'commercial' from k where k % 27 = 4 or k % 28 = 5 union all select k, 'genre-identity' from k where k % 29 = 6 union all select k, 'content-neutral' from k where k % 30 = 7 union all select k, 'surface' from k where k % 31 = 8
union all select k, 'qa-and-leaks' from k where k % 32 = 9 union all select k, 'owner-decision' from k where k % 33 = 10 union all select k, 'authority' from k where k % 34 = 11 union all select k, 'digests:blind_reviews' from k where k % 35 = 12
union all select k, 'digests:deep_reads' from k where k % 36 = 13 union all select k, 'digests:leak_scan' from k where k % 37 = 14 union all select k, 'runs' from k where k % 38 = 15 union all select k, 'digests:inputs' from k where k % 39 = 16""")
def g3_conditions(t):
    k = F.col("c_custkey")
    when = lambda m, r, yes, no: F.when(k % m == r, yes).otherwise(no)
    digests = lambda n: F.array_sort(F.array(*[F.sha2(F.concat(F.lit(f"{i}-"), k.cast("string")), 256) for i in range(n)]))
    names = lambda n: F.array(*[F.lit(f"run-{i}") for i in range(n)])
    rows = t.customer.select(
        k.alias("k"), when(23, 0, "fail", "pass").alias("status"), when(24, 1, 2, 3).alias("deep_read_sources"), when(25, 2, "v1", G.PACKET_SCHEMA).alias("packet_schema"), when(26, 3, 2, 3).alias("blind_pairs"), F.lit(3).alias("blind_runs"),
        when(27, 4, 1, 2).alias("soul_wins"), when(28, 5, 84.9, 85.0).alias("average_score"), F.lit(2).alias("least_gain"), when(29, 6, 2, 3).alias("genre_identity_passed"), when(30, 7, 1, 0).alias("neutral_violations"), F.lit(0).alias("canon_writes"),
        when(31, 8, F.lit(None).cast("boolean"), F.lit(True)).alias("surface_classified"), F.lit(0).alias("canon_leaks"), F.lit(True).alias("manager_qa_passed"), when(32, 9, 1, 0).alias("leak_matches"), F.lit(True).alias("owner_required"), when(33, 10, "d", F.lit(None)).alias("owner_decision_id"),
        F.struct(F.lit("analysis-only").alias("scope"), F.lit(False).alias("may_write"), (k % 34 == 11).alias("may_promote"), F.lit(True).alias("owner_required")).alias("authority"),
        digests(3).alias("review_packets"), when(35, 12, digests(4), digests(3)).alias("blind_reviews"), digests(3).alias("content_neutral"), digests(3).alias("surface_comparisons"), when(36, 13, F.reverse(digests(4)), digests(4)).alias("deep_reads"),
        F.lit("a" * 64).alias("manager_qa_sha256"), when(37, 14, "A" * 64, "a" * 64).alias("leak_scan_sha256"), when(38, 15, names(5), names(6)).alias("generation_runs"), names(3).alias("blind_run_ids"), when(39, 16, F.array(F.lit("x")), digests(2)).alias("inputs"),
    )
    return G.promotion_violations(rows, "k")


@query("a13_finding_rollup", """
select event_type rule, (user_id % 50)::bigint term, array_to_string(list_sort(list(distinct user_id)), ',') refs, count(*) n from events group by 1, 2""")
def a13(t):
    rows = t.events.groupBy(F.col("event_type").alias("rule"), (F.col("user_id") % 50).alias("term"))
    return rows.agg(F.array_join(F.array_sort(F.collect_set("user_id")).cast("array<string>"), ",").alias("refs"), F.count("*").alias("n"))


@query("a14_a15_verdicts", """
with x as (select o_custkey k, case o_orderstatus when 'P' then 'contradicted' when 'O' then 'insufficient' else 'supported' end v from orders)
select k, case max(case v when 'contradicted' then 2 when 'insufficient' then 1 else 0 end) when 2 then 'contradicted' when 1 then 'insufficient' else 'supported' end verdict from x group by k""")
def a15(t):
    v = F.when(F.col("o_orderstatus") == "P", "contradicted").when(F.col("o_orderstatus") == "O", "insufficient").otherwise("supported")
    return G.collective_verdict(t.orders.select(F.col("o_custkey").alias("k"), v.alias("v")), "k", "v")


@query("a16_reasoned_verdict", """
with x as (select o_custkey k, bool_or(o_totalprice > 300000) a, bool_or(o_orderstatus = 'P') b, bool_or(o_orderpriority = '1-URGENT') c from orders group by 1)
select k, array_to_string(list_filter([case when b then 'partial' end, case when a then 'price' end, case when c then 'urgent' end], lambda x: x is not null), ',') reasons, case when a or b or c then 'fail' else 'pass' end verdict from x""")
def a16(t):
    out = G.reasoned_verdict(t.orders, "o_custkey", {"price": F.col("o_totalprice") > 300000, "partial": F.col("o_orderstatus") == "P", "urgent": F.col("o_orderpriority") == "1-URGENT"})
    return out.select(F.col("o_custkey").alias("k"), F.array_join("reasons", ",").alias("reasons"), "verdict")


@query("a17_g6_p22_outcomes", """
with x as (select source, case when n_chars < 500 then 'uncertain' when toxic = 1 then 'reject' else 'approve' end v from documents join labels using (doc_id))
select source, count(*) filter (v = 'reject') blocking, count(*) filter (v = 'uncertain') "open", count(*) n, case when count(*) filter (v = 'reject') > 0 then 'blocked' when count(*) filter (v = 'uncertain') > 0 then 'pending_hil' else 'pass' end outcome from x group by source""")
def a17(t):
    rows = t.documents.join(t.labels, "doc_id").select("doc_id", "source", F.when(F.col("toxic") == 1, "reject").otherwise("approve").alias("decision"))
    full = t.documents.select("doc_id", (F.col("n_chars") >= 500).alias("complete"))
    return G.outcome(G.effective_decisions(rows, full, "doc_id", "decision", "complete"), "source", "effective", "reject", "uncertain")


@query("g10_separation", """
select c_nationkey, count(*) filter (c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT')) conflicted, count(*) n from customer group by 1""")
def g10(t):
    producers = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"), F.lit(1).alias("hit")).distinct()
    return t.customer.join(producers, "c_custkey", "left").groupBy("c_nationkey").agg(F.count("hit").alias("conflicted"), F.count("*").alias("n"))


@query("g11_admissible", """
select l_orderkey, bool_and(l_linestatus = 'F' and l_discount * 10 between 0 and 1) admissible from lineitem group by 1""")
def g11(t):
    row = G.admissible(F.when(F.col("l_linestatus") == "F", "keep").otherwise("drop"), F.col("l_discount") * 10)
    return t.lineitem.groupBy("l_orderkey").agg(F.bool_and(row).alias("admissible"))


@query("w10_band_samples", """
with x as (select l_suppkey % 20 g, l_linenumber % 3 band, l_orderkey sel, l_partkey s, l_partkey + l_quantity::bigint e, l_returnflag kind from lineitem),
one as (select g, band, sel, min(s) s, min(e) e, list_sort(list(distinct kind)) kinds from x group by 1, 2, 3),
r as (select *, row_number() over (partition by g, band order by e - s, s, e, sel) rank from one),
f as (select r.*, first_value(kinds) over (partition by g, band order by rank) k1 from r),
q as (select *, min(case when len(k1) < 2 and rank > 1 and len(list_filter(kinds, lambda k: not list_contains(k1, k))) > 0 then rank end) over (partition by g, band) nd from f),
o as (select *, row_number() over (partition by g, band order by case when rank = 1 then 0 when rank = nd then 1 else 2 end, rank) pick from q)
select g::bigint g, band::bigint band, sel, pick from o where pick <= 3""")
def w10(t):
    rows = t.lineitem.select((F.col("l_suppkey") % 20).cast("long").alias("g"), (F.col("l_linenumber") % 3).cast("long").alias("band"), F.col("l_orderkey").alias("sel"), F.col("l_partkey").alias("s"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("e"), F.col("l_returnflag").alias("kind"))
    return G.band_sample(rows, "g", "band", "sel", "s", "e", "kind").select("g", "band", "sel", F.col("pick").cast("long").alias("pick"))


@query("w11_smallest_selector", """
select l_suppkey, l_orderkey, l_linenumber::bigint l_linenumber from (select *, row_number() over (partition by l_suppkey order by l_quantity, l_orderkey, l_linenumber) r from lineitem) where r = 1""")
def w11(t):
    order = W.partitionBy("l_suppkey").orderBy("l_quantity", "l_orderkey", "l_linenumber")
    return t.lineitem.withColumn("r", F.row_number().over(order)).where("r = 1").select("l_suppkey", "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))


@query("w12_first_and_last", """
with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) a, row_number() over (partition by o_custkey order by o_orderkey desc) b, count(*) over (partition by o_custkey) n from orders)
select o_custkey, o_orderkey, n <= 8 complete from r where a <= 4 or b <= 4""")
def w12(t):
    by = W.partitionBy("o_custkey")
    rows = t.orders.select("o_custkey", "o_orderkey", F.row_number().over(by.orderBy("o_orderkey")).alias("a"), F.count("*").over(by).alias("n"))
    return rows.where("a <= 4 or a > n - 4").select("o_custkey", "o_orderkey", (F.col("n") <= 8).alias("complete"))
