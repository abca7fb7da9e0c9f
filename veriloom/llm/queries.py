"""The operators as queries over the whole tables of a folder, with their production parameters, and their SQL."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import structure_sql

#: Fixed values of the url query: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
VOCABULARY = "byte_bpe_50k.tiktoken"


def _module(name: str):
    return import_module(f"{__package__}.{name}")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark, sf_dir):
    found = _module("exact_dedup").exact_groups(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op2_bpe(spark, sf_dir):
    import public_tokenizers

    found = _module("bpe").encode_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return found.withColumnRenamed("id", "doc_id")


def op3_suffix_dedup(spark, sf_dir):
    found = _module("suffix_dedup").remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_url_filter(spark, sf_dir):
    return _module("url_filter").filter_urls(_table(spark, sf_dir, "pages"), URL_RULES).withColumnRenamed("id", "page_id")


def op5_top_k(spark, sf_dir):
    return _module("topk").top_k(_table(spark, sf_dir, "embeddings"), "id % 50 = 0")


def op6_mixing(spark, sf_dir):
    found = _module("mixing").mix(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")  # the SQL has no slots


def op7_toxicity(spark, sf_dir):
    toxicity, docs = _module("toxicity"), _table(spark, sf_dir, "documents")
    model = toxicity.fit_model(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).withColumnRenamed("id", "doc_id")


def op8_jaccard_join(spark, sf_dir):
    found = _module("jaccard").near_classes(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_links", "n_copies")


def op9_quality(spark, sf_dir):
    quality, docs = _module("quality"), _table(spark, sf_dir, "documents")
    model = quality.fit_model(docs, _table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model).withColumnRenamed("id", "doc_id")


def op10_line_dedup(spark, sf_dir):
    found = _module("line_dedup").remove_repeated_runs(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_removed", "n_chunks", F.sha2("kept", 256).alias("kept_sha256"))


#: A to Z and the small letters for them.
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle_manifest(spark, sf_dir):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = _module("merkle").manifest(_table(spark, sf_dir, "documents"), tampering={"text": F.translate("text", CAPITALS, SMALL)}, tampered=tampered)
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_conversation_repair(spark, sf_dir):
    return _module("conversations").repair_summaries(_table(spark, sf_dir, "conversations"))


def op13_simhash(spark, sf_dir):
    simhash = _module("simhash")
    found = simhash.near_components(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_digits("fp").alias("fingerprint"), "component_id")


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_bpe, op3_suffix_dedup, op4_url_filter, op5_top_k, op6_mixing, op7_toxicity, op8_jaccard_join, op9_quality, op10_line_dedup,
        op11_merkle_manifest, op12_conversation_repair, op13_simhash,
    )
}

_EXACT_SQL = """
with d as (select doc_id, coalesce(text, '') t, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') c from documents),
g as (select c, count(*) n, arg_min(doc_id, (-length(t), doc_id)) k from d group by c)
select d.doc_id, g.k keep_id, cast(g.n as bigint) group_size, d.doc_id = g.k kept, sha256(d.c) text_sha256
from d join g on d.c = g.c
"""

_URL_SQL = """
with rules(h, p, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end r from pages),
c as (select page_id, regexp_extract(r, '^[^/?#]*') h, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) p from u),
l as (select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, p as path from c),
m as (select page_id, arg_max(rules.h || rules.p, length(rules.h || rules.p)) r, arg_max(v, length(rules.h || rules.p)) v
  from l join rules on (host = rules.h or ends_with(host, '.' || rules.h)) and starts_with(path, rules.p) group by page_id)
select l.page_id, host, path, m.r as rule, coalesce(m.v, 'allow') verdict from l left join m on l.page_id = m.page_id
"""

_TOP_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) as bigint) score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""

_MIX_SQL = """
with recursive d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) size from documents),
s as (select source, cast(sum(size) as bigint) z, [5.0, 2.0, 1.0][1 + (row_number() over (order by source nulls last) - 1) % 3] w from d group by source),
tot as (select 1.5 * sum(z) t from s),
fill(step, full_) as (
  select 0, []::varchar[]
  union all
  select step + 1, (select list(coalesce(source, '~null')) from s
    where 2.0 * z <= w * ((select t from tot) - (select coalesce(sum(2.0 * z), 0) from s where list_contains(full_, coalesce(source, '~null'))))
      / (select sum(w) from s where not list_contains(full_, coalesce(source, '~null'))) or list_contains(full_, coalesce(source, '~null')))
  from fill where step < 30),
f as (select coalesce(full_, []) full_ from fill order by step desc limit 1),
tg as (select source, z, case when list_contains((select full_ from f), coalesce(source, '~null')) then 2.0 * z
  else w * ((select t from tot) - (select coalesce(sum(2.0 * z), 0) from s where list_contains((select full_ from f), coalesce(source, '~null'))))
    / (select sum(w) from s where not list_contains((select full_ from f), coalesce(source, '~null'))) end target from s),
p as (select *, coalesce(sum(size) over (partition by source order by md5(cast(doc_id as varchar)), doc_id
  rows between unbounded preceding and 1 preceding), 0) a from d)
select p.doc_id, p.size, tg.z source_size, tg.target target, cast(case when p.size = 0 or tg.z = 0 then 0 else
  cast(floor(tg.target) as bigint) // tg.z * p.size + greatest(0, least(p.a + p.size, cast(floor(tg.target) as bigint) % tg.z) - p.a) end as bigint) taken
from p join tg on p.source is not distinct from tg.source
"""

ORACLES = {
    "op1_exact_dedup": _EXACT_SQL, "op4_url_filter": _URL_SQL, "op5_top_k": _TOP_SQL, "op6_mixing": _MIX_SQL,
    "op11_merkle_manifest": structure_sql.MANIFEST, "op12_conversation_repair": structure_sql.REPAIR,
}
