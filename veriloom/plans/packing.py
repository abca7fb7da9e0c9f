"""Bounded partitions: a source's documents in order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import packing as P
from .registry import query

_ITEMS = "items as (select source, doc_id, strlen(coalesce(text, ''))::bigint b, row_number() over (partition by source order by doc_id) i from documents)"


def _walk(target: int) -> str:
    return f"""with recursive {_ITEMS},
w(source, i, doc_id, b, total, part) as (
  select source, i, doc_id, b, b, 1::bigint from items where i = 1
  union all
  select n.source, n.i, n.doc_id, n.b, case when w.total + n.b <= {target} then w.total + n.b else n.b end, case when w.total + n.b <= {target} then w.part else w.part + 1 end
  from w join items n on n.source is not distinct from w.source and n.i = w.i + 1)
"""


def _items(t):
    return t.documents.select("source", "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("b"))


@query("b1_next_fit", _walk(20_000) + "select source, doc_id, b, part from w")
def b1(t):
    return P.next_fit(_items(t), "source", "doc_id", "b", 20_000)


@query("b2_b3_token_budget", _walk(9_000) + "select source, doc_id, b, part, b <= 9000 fits_alone from w")
def b2(t):
    return P.greedy_by_tokens(_items(t), "source", "doc_id", "b", 9_000)


# Parts whose JSON array stays within the budget; a text that exceeds it by itself is an error row.
@query("b2_b3_exact_cost", """with recursive items as (select source, doc_id, length(j) n, row_number() over (partition by source order by doc_id) i from (select source, doc_id, '{"id":' || doc_id || ',"source":"' || coalesce(source, '') || '","n":' || repeat('9', 1 + coalesce(n_chars, 0)::int % 97) || '}' j from documents)),
w(source, i, doc_id, total, part, fails) as (
  select source, 0::bigint, null::bigint, 1::bigint, 0::bigint, true from items where i = 1
  union all
  select n.source, n.i, n.doc_id, case when n.n + 2 > 120 then 1 when not w.fails and w.total + n.n + 1 <= 120 then w.total + n.n + 1 else n.n + 2 end,
    case when n.n + 2 > 120 then w.part when not w.fails and w.total + n.n + 1 <= 120 then w.part else w.part + 1 end, n.n + 2 > 120
  from w join items n on n.source is not distinct from w.source and n.i = w.i + 1)
select source, doc_id, case when fails then null else part end part, case when fails then 'fits-no-part' end error from w where i > 0""")
def b2_exact(t):
    digits = F.expr("repeat('9', cast(1 + coalesce(n_chars, 0) % 97 as int))")
    items = t.documents.select("source", "doc_id", F.concat(F.lit('{"id":'), F.col("doc_id").cast("string"), F.lit(',"source":"'), F.coalesce("source", F.lit("")), F.lit('","n":'), digits, F.lit("}")).alias("j"))
    return P.greedy_by_cost(items, "source", "doc_id", "j", 120, P.json_cost)


@query("b7_exact_cover", "select source, count(*) filter (doc_id % 97 = 0) = 0 covered from documents group by source")
def b7(t):
    items = _items(t)
    parts = P.next_fit(items, "source", "doc_id", "b", 20_000)
    return P.exact_cover(parts.where("doc_id % 97 <> 0"), items, "source", "part", "doc_id")


@query("b5_encoded_lengths", r"""
with d as (select doc_id, coalesce(text, '') t from documents),
c as (select doc_id, length(t) n, length(t) - length(regexp_replace(t, '["\\\x08\t\n\x0c\r]', '', 'g')) two, length(t) - length(regexp_replace(t, '[\x00-\x07\x0b\x0e-\x1f]', '', 'g')) six, length(t) - length(regexp_replace(t, '[\x{10000}-\x{10ffff}]', '', 'g')) wide from d)
select doc_id, (n + two + 5 * six + wide + 2)::bigint encoded from c""")
def b5(t):
    return t.documents.select("doc_id", P.encoded_length(F.coalesce("text", F.lit(""))).alias("encoded"))
