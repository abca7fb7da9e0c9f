"""The manifest and the repair of conversations in DuckDB's SQL, written apart from the operators.

The CRC-32 is computed byte by byte. The repair is a recursion over the turns from the last to the first: for each state
of the grammar the least of `cost in six digits + audit`, a string, so the order of strings is that of cost, then audit.
"""

#: The table of CRC-32 by its polynomial.
_CRC = """crc_table as (select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, cast(n as bigint)) order by n) t from range(256) r(n))"""
_CRC_OF = (
    "(select xor(list_reduce(list_transform(range(1, length({0}) + 1), lambda i: cast(ascii(substr({0}, i, 1)) as bigint)), "
    "lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) from crc_table)"
)

MANIFEST = """
with recursive {crc},
leaves as (select doc_id, source, text, concat_ws('',
    coalesce(octet_length(encode(cast(doc_id as varchar))) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
    coalesce(octet_length(encode(lang)) || ':' || lang, '-'), coalesce(octet_length(encode(cast(n_chars as varchar))) || ':' || n_chars, '-')) h from documents),
hashed as (select doc_id, coalesce(source, '~null') tree, source, sha256(h || coalesce(octet_length(encode(text)) || ':' || text, '-')) leaf,
  case when {crc_of} % 5 = 0
    then sha256(h || coalesce(octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) end changed from leaves),
ordered as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as place from hashed),
up(lvl, tree, place, digest) as (
  select 0, tree, place, leaf from ordered
  union all
  select lvl + 1, tree, place // 16, sha256(string_agg(digest, '' order by place)) from up
  where tree in (select tree from up group by tree having count(*) > 1) group by lvl, tree, place // 16),
tops as (select tree, max(lvl) levels, arg_max(digest, lvl) subroot from up group by tree),
sources as (select tree, row_number() over (order by source nulls first) - 1 as place from (select distinct tree, source from ordered)),
above(lvl, place, digest) as (
  select 0, place, subroot from sources join tops using (tree)
  union all
  select lvl + 1, place // 16, sha256(string_agg(digest, '' order by place)) from above where (select count(*) from above) > 1 group by lvl, place // 16),
runs as (
  select u.tree, u.lvl, u.place // 16 as run, list(u.digest order by u.place) nodes from up u join tops t on u.tree = t.tree where u.lvl < t.levels group by u.tree, u.lvl, u.place // 16
  union all
  select '~above', lvl, place // 16, list(digest order by place) from above where lvl < (select max(lvl) from above) group by lvl, place // 16),
walk(start, tree, step, place, folded, siblings) as (
  select o.place, o.tree, 0, case when t.levels = 0 then s.place else o.place end, coalesce(o.changed, o.leaf), ''
  from ordered o join tops t on o.tree = t.tree join sources s on s.tree = o.tree
  union all
  select w.start, w.tree, w.step + 1, case when w.step + 1 = t.levels then s.place else w.place // 16 end,
    sha256(list_aggregate(r.nodes[:w.place % 16] || [w.folded] || r.nodes[w.place % 16 + 2:], 'string_agg', '')),
    w.siblings || coalesce(list_aggregate(r.nodes[:w.place % 16] || r.nodes[w.place % 16 + 2:], 'string_agg', ''), '')
  from walk w join tops t on w.tree = t.tree join sources s on s.tree = w.tree
  join runs r on r.tree = case when w.step < t.levels then w.tree else '~above' end and r.lvl = case when w.step < t.levels then w.step else w.step - t.levels end
    and r.run = w.place // 16)
select n.doc_id, n.leaf, t.subroot, (select arg_max(digest, lvl) from above) as root, sha256(arg_max(w.siblings, w.step)) proof_sha256,
  arg_max(w.folded, w.step) folded_root, arg_max(w.folded, w.step) = (select arg_max(digest, lvl) from above) verified
from ordered n join walk w on n.tree = w.tree and n.place = w.start join tops t on t.tree = n.tree group by n.tree, n.place, n.doc_id, n.leaf, t.subroot
""".format(crc=_CRC, crc_of=_CRC_OF.format("cast(doc_id as varchar)"))


def _more(value: str, cost: str, edit: str) -> str:
    return f"printf('%06d', cast(left({value}, 6) as integer) + {cost}) || '{edit}' || substr({value}, 7)"


#: Where a new role or an insert leads, and where a kept letter does.
_FORCED = {0: 2, 1: 2, 2: 3, 3: 2}
_KEPT = {0: "case letter when 's' then v1 when 'u' then v2 end", 1: "case letter when 'u' then v2 end", 2: "case letter when 'a' then v3 end", 3: "case letter when 'u' then v2 end"}
_STEPPED = ", ".join(
    f"least({_more(f'v{s}', '2', 'D')}, case when kind < 2 then {_more(f'v{_FORCED[s]}', '1 + 5 * kind', 'R')} end, case when kind < 2 then {_more(f'({_KEPT[s]})', '5 * kind', 'K')} end) b{s}"
    for s in range(4)
)
_INSERTED = ", ".join(f"least(b{s}, {_more(f'b{_FORCED[s]}', '5', 'I')}, {_more(f'b{_FORCED[_FORCED[s]]}', '10', 'II')}) v{s}" for s in range(4))

REPAIR = """
with recursive {crc},
rows_ as (select conv_id, coalesce(cast(conv_id as varchar), ' ') c, turn, coalesce(role, ' ') role, coalesce(text, ' ') t0,
  coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') k from conversations),
hit as (select *, {crc_of} % 20 h from rows_),
damaged as (select c, turn, case h when 4 then 'user' else role end role, case h when 1 then '' when 2 then regexp_replace(t0, '[.!?]', '', 'g') else t0 end t
  from hit, unnest(case h when 3 then [1, 2] else [1] end) where h <> 0),
turns as (select *, row_number() over (partition by c order by turn nulls first, role, sha256(t)) i, left(role, 1) letter from damaged),
faulty as (select *, not regexp_matches(t, '[^\\x20\\x09-\\x0D]') blank, row_number() over (partition by c, role, t order by i) > 1 as dup, not regexp_matches(t, '[.!?][\\x20\\x09-\\x0D]*\\z') short,
  lag(letter) over (partition by c order by i) || letter pair from turns),
judged as (select *, case when blank or dup then 2 when short then 1 else 0 end kind from faulty),
counts as (select c, count(*) n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (blank) blank, count(*) filter (dup and not blank) dup,
  count(*) filter (kind = 1) short, count(*) filter (pair not in ('su', 'ua', 'au')) illegal from judged group by c),
best(c, i, v0, v1, v2, v3) as (
  select c, n + 1, '000000', '000010II', '000005I', '000000' from counts
  union all
  select c, i, {inserted} from (select b.c, j.i, {stepped} from best b join judged j on j.c = b.c and j.i = b.i - 1)),
plan as (select c, cast(left(v0, 6) as bigint) cost, substr(v0, 7) audit from best where i = 1),
walk(c, k, i, state, said) as (
  select c, 0, 0, '', null::varchar from plan
  union all
  select w.c, k + 1, w.i + (e <> 'I')::int, case when e = 'D' then state when e = 'K' then letter when state = 'u' then 'a' else 'u' end,
    case when e = 'D' then said else concat(said || chr(10), case when e = 'K' then role when state = 'u' then 'assistant' else 'user' end, ':', case when e = 'I' then '' else t end) end
  from (select w.*, substr(p.audit, k + 1, 1) e from walk w join plan p on p.c = w.c where k < length(p.audit)) w left join judged j on j.c = w.c and j.i = w.i + 1),
done as (select c, arg_max(coalesce(said, ''), k) said from walk group by c)
select r.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(dup, 0) as duplicate, coalesce(short, 0) truncated, coalesce(illegal, 0) illegal,
  coalesce(cost, 0) as cost, coalesce(audit, '') audit, sha256(coalesce(said, '')) repaired_sha256
from (select distinct conv_id, c from rows_) r left join counts on counts.c = r.c left join plan on plan.c = r.c left join done on done.c = r.c
""".format(crc=_CRC, crc_of=_CRC_OF.format("k"), inserted=_INSERTED, stepped=_STEPPED)
