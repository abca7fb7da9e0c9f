"""Source reconciliation over tables that stand for files and stores."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import new_path, written
from ..sources import files as S
from .registry import query

@query("s1_s5_s6_inspect_sources", """
with f as (select doc_id, sha256(coalesce(text, '')) h, strlen(coalesce(text, ''))::bigint b from documents where doc_id % 7 <> 0), i as (select doc_id, strlen(coalesce(text, ''))::bigint + (doc_id % 10 = 0)::int b from documents)
select i.doc_id, f.h source_sha256, f.b actual_size_bytes, f.b = i.b size_matches, case when f.h is null then 'remote-only' when f.b = i.b then 'verified-local' else 'drifted-local' end status,
  array_to_string(list_filter([case when i.b < 100000 then 'suspiciously-small' end, case when f.h is not null then 'chapter-markers-missing' end], lambda x: x is not null), ',') hints from i left join f using (doc_id)""")
def s5(t):
    text = F.coalesce("text", F.lit(""))
    docs = t.documents.select("doc_id", F.encode(text, "UTF-8").alias("content"), F.octet_length(text).cast("long").alias("size_bytes"))
    listed = docs.select("doc_id", (F.col("size_bytes") + (F.col("doc_id") % 10 == 0).cast("int")).alias("size_bytes"))
    found = docs.where("doc_id % 7 <> 0").select("doc_id", F.sha2("content", 256).alias("sha256"), "size_bytes", "content")
    rows = S.inspect_sources(listed, found, "doc_id", content="content")
    return rows.select("doc_id", "source_sha256", "actual_size_bytes", "size_matches", "status", F.array_join("hints", ",").alias("hints"))


@query("s2_s3_csv_rows", "select doc_id::varchar doc_id, coalesce(text, '') body, coalesce(source, '') source, '' missing from documents where doc_id % 11 <> 0")
def s2(t):
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", F.col("doc_id").cast("string"), cell("text"), F.coalesce("source", F.lit("")))
    body = F.when(F.col("doc_id") % 11 == 0, F.lit("\r\n")).otherwise(line)  # an empty line isn't a row
    texts = t.documents.select(F.col("doc_id").alias("file"), F.concat(F.lit("\ufeffdoc_id,body,source,missing\r\n"), body, F.lit("\r\n")).alias("csv"))
    return S.csv_records(S.csv_cells_of(texts, "file", "csv"), ["doc_id", "body", "source", "missing"])


# A file for each source, its documents in order, read in pieces; every third receipt states another digest, every fourth one marked line too many.
@query("s1_s6_streamed_receipts", r"""
with f as (select source, string_agg(t || chr(10), '' order by doc_id) body from (select source, doc_id, replace(replace(coalesce(text, ''), chr(10), ' '), chr(13), ' ') t from documents where source is not null) group by source),
g as (select source, sha256(body) h, strlen(body)::bigint size_bytes, (length(chr(10) || body) - length(replace(chr(10) || body, chr(10) || 'E', ''))) // 2 marked, row_number() over (order by source) i from f)
select source, h sha256, size_bytes, marked, concat_ws(',', case when i % 4 = 0 then 'markers' end, case when i % 3 = 0 then 'sha256' end) broken from g""")
def s1_s6(t):
    path = new_path(t.spark)
    body = F.regexp_replace(F.coalesce("text", F.lit("")), "[\n\r]", " ")
    rows = t.documents.where("source is not null").select("source", "doc_id", body.alias("value"))
    rows.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "value").write.partitionBy("source").text(path, lineSep="\n")
    found = written(S.streamed_digests(t.spark, f"{path}/*/*.txt", "E").withColumn("source", F.regexp_extract("path", "source=([^/]*)/", 1)))
    place = F.row_number().over(W.orderBy("source"))  # a row a source
    said = found.select("source", place.alias("i"), F.when(place % 3 == 0, F.lit("0" * 64)).otherwise(F.col("sha256")).alias("sha256"), (F.col("marked") + (place % 4 == 0).cast("int")).alias("n"))
    broken = S.receipt_violations(said, found, "source", marked="n").groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("rule")), ",").alias("broken"))
    return found.join(broken, "source", "left").select("source", "sha256", "size_bytes", "marked", F.coalesce("broken", F.lit("")).alias("broken"))


# The table as CSV files with line feeds, quotes and commas in quoted fields, read in splits.
@query("s2_s3_csv_splits", """
select doc_id::varchar doc_id, coalesce(text, '') body, coalesce(source, '') source, 4::bigint cells from documents""")
def s2_splits(t):
    path = new_path(t.spark)
    rows = t.documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("body"), F.coalesce("source", F.lit("")).alias("source"), F.lit("x,y").alias("last"))
    rows.write.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="")
    cells = S.csv_cells(t.spark, path)
    return S.csv_records(cells.withColumn("cells", F.concat("cells", F.array(F.size("cells").cast("string")))).withColumn("header", F.concat("header", F.array(F.lit("n")))), ["doc_id", "body", "source", "n"]).select("doc_id", "body", "source", F.col("n").cast("long").alias("cells"))


@query("s4_f23_tolerant_json", """
select event_id, case when event_id % 4 = 3 then null else json_extract_string(props, '$.k') end k, event_id % 4 <> 3 and props is not null parsed from events""")
def s4(t):
    k = F.col("event_id") % 4
    answer = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(k == 2, F.concat(F.lit("  ```\n"), "props", F.lit("```\n"))).otherwise(F.concat(F.lit("{oops "), "props"))
    rows = t.events.select("event_id", T.tolerant_json(answer).alias("v"))
    return rows.select("event_id", F.try_variant_get("v", "$.k", "string").alias("k"), F.col("v").isNotNull().alias("parsed"))


@query("s7_p11_f20_byte_slices", """
with d as (select doc_id, hex(encode(coalesce(text, ''))) h, doc_id % 40 s, doc_id % 40 + 1 + doc_id % 23 e from documents),
x as (select *, substr(h, 2 * s + 1, 2 * (e - s)) piece, length(h) // 2 n from d)
select doc_id, case when s < n then piece else '' end slice, e <= n and substr(h, 2 * s + 1, 1) not in ('8', '9', 'A', 'B') and (e = n or substr(h, 2 * e + 1, 1) not in ('8', '9', 'A', 'B')) and doc_id % 13 <> 0 proven from x""")
def s7(t):
    rows = t.documents.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"), (F.col("doc_id") % 40).cast("int").alias("s"), (F.col("doc_id") % 40 + 1 + F.col("doc_id") % 23).cast("int").alias("e"))
    rows = rows.withColumn("sha", F.when(F.col("doc_id") % 13 == 0, F.lit("0" * 64)).otherwise(F.sha2(S.byte_slice(F.col("data"), F.col("s"), F.col("e")), 256)))
    return S.proven_slices(rows, "data", "s", "e", "sha").select("doc_id", F.hex("slice").alias("slice"), "proven")


# One walk over a text's characters with their costs in JSON; a chunk ends where the next character would exceed the budget.
@query("s9_budgeted_chunks", r"""
with recursive c as (select doc_id, text, unnest(string_split(text, '')) ch, generate_subscripts(string_split(text, ''), 1) i from documents where text <> ''),
k as (select doc_id, i, case when ch in ('"', '\', chr(8), chr(9), chr(10), chr(12), chr(13)) then 2 when ord(ch) < 32 then 6 else 1 end cost from c),
u as (select doc_id, i, sum(cost) over (partition by doc_id order by i) upto from k),
w(doc_id, idx, first, last, upto) as (
  select doc_id, 0, 1::bigint, max(i), max(upto) from u where upto <= 1998 group by doc_id
  union all
  select w.doc_id, w.idx + 1, w.last + 1, max(u.i), max(u.upto) from w join u on u.doc_id = w.doc_id and u.i > w.last and u.upto <= w.upto + 1998 group by w.doc_id, w.idx, w.last)
select w.doc_id, idx::bigint idx, last - first + 1 n, 'cursor-' || sha256('@CURSOR' || chr(0) || w.doc_id || chr(0) || sha256(text) || chr(0) || idx) "cursor" from w join documents using (doc_id)
union all select doc_id, 0, 0, 'cursor-' || sha256('@CURSOR' || chr(0) || doc_id || chr(0) || sha256('') || chr(0) || '0') from documents where coalesce(text, '') = ''""".replace("@CURSOR", S.CURSOR))
def s9(t):
    rows = S.chunks(t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", "text", 2000)
    return rows.select("doc_id", F.col("idx").cast("long").alias("idx"), F.length("chunk").cast("long").alias("n"), "cursor")


# Published twice in different orders, then read back from the places that publishing gave: rows, lines, receipt.
@query("s10_s11_s12_s13_published", """
select n_nationkey, n_name, true written, true reused, (select count(*) from nation) said, true from_lines from nation""")
def s12(t):
    folder = new_path(t.spark)
    rows = t.nation.select("n_nationkey", "n_name")
    text = F.concat_ws("\0", "n_nationkey", "n_name")
    first, new = S.publish_once(rows, folder, "nation", text)
    pack = S.publish_pack(rows, rows.agg(F.count("*").alias("n")), folder, "nation", text)
    again, repeated = S.publish_once(rows.orderBy("n_name"), folder, "nation", text)
    said = t.spark.read.schema("n long, data_path string, lines_path string").json(pack["receipt"])
    lines = t.spark.read.schema(rows.schema).json(said.first()["lines_path"]).withColumn("from_lines", F.lit(True))
    found = t.spark.read.parquet(said.first()["data_path"]).withColumns({"written": F.lit(new), "reused": F.lit(again == first == pack["data"] and not repeated)})
    return found.crossJoin(F.broadcast(said.select(F.col("n").alias("said")))).join(lines, ["n_nationkey", "n_name"], "left").withColumn("from_lines", F.coalesce("from_lines", F.lit(False)))


@query("s14_s15_upsert_plan", """
with a as (select doc_id, sha256(coalesce(text, '')) h from documents where doc_id % 5 <> 0), b as (select doc_id, sha256(case when doc_id % 4 = 0 then 'new' else coalesce(text, '') end) h from documents where doc_id % 3 <> 0)
select coalesce(a.doc_id, b.doc_id) doc_id, case when a.h is null then 'installed' when b.h is null then 'kept' when a.h = b.h then 'reused' else 'refreshed' end action from a full join b on a.doc_id = b.doc_id""")
def s14(t):
    text = F.coalesce("text", F.lit(""))
    stored = t.documents.where("doc_id % 5 <> 0").select("doc_id", F.sha2(text, 256).alias("h"))
    offered = t.documents.where("doc_id % 3 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 4 == 0, "new").otherwise(text), 256).alias("h"))
    return S.upsert_plan(stored, offered, "doc_id", "h")


@query("s16_manifest_checks", """
with m as (select c_custkey % 1400 k, case when c_custkey % 50 = 0 then ' ' else c_name end name, case when c_custkey % 40 = 0 then '-1' else c_custkey::varchar end n from customer)
select k::varchar "key", 'empty:name' rule from m where trim(name) = '' union all select k::varchar, 'count:n' from m where not regexp_full_match(n, '[1-9][0-9]*') union all select k::varchar, 'repeated' from m group by k having count(*) > 1""")
def s16(t):
    c = F.col("c_custkey")
    m = t.customer.select((c % 1400).alias("k"), F.when(c % 50 == 0, " ").otherwise(F.col("c_name")).alias("name"), F.when(c % 40 == 0, "-1").otherwise(c.cast("string")).alias("n"))
    return S.manifest_violations(m, "k", ["name"], ["n"], [])


@query("s18_overlay", """
select o_orderkey, case when o_orderkey < 353 then 'base' else 'late' end origin from orders where o_orderkey between 334 and 500""")
def s18(t):
    rows = t.orders.select("o_orderkey")
    return S.overlay(rows.withColumn("origin", F.lit("base")), rows.withColumn("origin", F.lit("late")), "o_orderkey", 353, 334, 500)
