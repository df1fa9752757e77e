"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

NGRAM_JOIN = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (
  select doc_id, list_distinct(case when len(ws) >= 4 then list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as g from w),
e as (select doc_id, len(g) as n, unnest(g) as g from s),
p as (select a.doc_id as x, b.doc_id as y, count(*) as k, any_value(a.n) as na, any_value(b.n) as nb from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p where 100 * k >= 85 * (na + nb - k)),
b as (select x, y from l union select y, x from l),
r(doc_id, other) as (select doc_id, doc_id from s union select r.doc_id, b.y from r join b on b.x = r.other)
select s.doc_id, len(g)::bigint as n_shingles, (select min(other) from r where r.doc_id = s.doc_id) as component_id from s
"""

MIX = r"""
with d as (
  select doc_id, source is null as nul, coalesce(source, '') as src, case when text is null then 0 else len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) end as size,
    (('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || ':0'), 1, 13))::bigint + 0.5) / 4503599627370496.0 as u, md5(coalesce(text, '')) as tie from documents),
k as (select *, case when size > 0 then length(bin(size)) - 1 else 0 end as lev from d),
s0 as (select nul, src, sum(size)::bigint as source_size from k group by 1, 2),
s1 as (select *, [5.0, 2.0, 1.0][((row_number() over (order by nul, src) - 1) % 3 + 1)::int]::double as w, (sum(source_size) over ())::double as total from s0),
s2 as (select *, row_number() over o as pos, greatest(total - coalesce(sum(3.0::double * source_size) over (o rows between unbounded preceding and 1 preceding), 0), 0) / sum(w) over (o rows between current row and unbounded following) as left_over
  from s1 window o as (order by source_size / w, nul, src)),
s3 as (select *, (select min({'a': pos, 'l': left_over}) from s2 where 3.0 * source_size >= left_over * w) as c from s2),
s as (select nul, src, source_size, case when c is null or pos < c.a then 3.0 * source_size else least(3.0 * source_size, c.l * w) end::double as target from s3),
l0 as (select nul, src, lev, sum(size)::double as a, pow(2.0, -0.25 * lev) * sum(size) as unit from k group by 1, 2, 3),
l1 as (select l0.*, target, row_number() over o as pos, greatest(target - coalesce(sum(3.0 * a) over (o rows between unbounded preceding and 1 preceding), 0), 0) / sum(unit) over (o rows between current row and unbounded following) as left_over
  from l0 join s using (nul, src) window o as (partition by l0.nul, l0.src order by lev)),
l2 as (select *, min(case when 3.0 * a >= left_over * unit then {'a': pos, 'l': left_over} end) over (partition by nul, src) as c from l1),
l3 as (select *, case when a > 0 then round(case when c is null or pos < c.a then 3.0 * a else least(3.0 * a, c.l * unit) end / a, 9) else 0 end as e from l2),
l as (select nul, src, lev, floor(e)::bigint as whole, e - floor(e) as pi, greatest(target - sum(floor(e) * a) over (partition by nul, src), 0) as room from l3),
q0 as (select k.*, whole, room, case when pi > 0 then (u / (1 - u)) / (pi / (1 - pi)) end as odds from k join l using (nul, src, lev)),
q as (select *, odds / (1 + odds) as q from q0),
f0 as (select *, case when q is not null then sum(size) over (partition by nul, src order by q, doc_id, tie rows unbounded preceding) end as upto from q),
f as (select *, coalesce(upto <= room, false) as inside, room - coalesce(max(case when upto <= room then upto end) over (partition by nul, src), 0) as gap, coalesce(bool_or(upto > room) over (partition by nul, src), false) as full_up from f0),
f1 as (select *, case when q is not null and not inside and full_up then gap end as gap0, false as in0 from f),
""" + "".join(f'''
x{k} as (select *, row_number() over (partition by nul, src, coalesce(not in{k} and size <= gap{k}, false) order by size desc, q desc, doc_id desc, tie desc) = 1 and coalesce(not in{k} and size <= gap{k}, false) as pick{k} from f{k + 1}),
f{k + 2} as (select *, in{k} or pick{k} as in{k + 1}, gap{k} - coalesce(max(case when pick{k} then size end) over (partition by nul, src), 0) as gap{k + 1} from x{k}),''' for k in range(3)) + r"""
y as (select *, case when q is not null and (inside or in3) then 1 else 0 end as copies1 from f4)
select doc_id, size::bigint as size, source_size, target, size * (whole + copies1)::bigint as taken, (whole + copies1)::bigint as copies from y join s using (nul, src)
"""


def _edit(x: str, cost: str, edit: str, line: str = "''") -> str:
    return f"case when {x} is not null then {{'c': {x}.c + {cost}, 'a': {x}.a || '{edit}', 'o': {x}.o || {line}}} end"


#: The edit lattice as a recursive query: a step for each row, the best (cost, audit, output) of each of the four states.
REPAIR = rf"""
with recursive tab as (select list(v order by i) as t from (select i, list_reduce(list_prepend(i, range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384)) as v from range(256) r(i))),
k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, encode(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))::varchar as key from conversations),
c as (select k.*, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(key) + 1), lambda i: ord(key[i])::bigint)), lambda x, b: xor(x >> 8, t[xor(x, b) % 256 + 1])), 4294967295) % 20 as kind from k, tab),
d as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when kind = 3 then [0, 1] else [0] end) as again from c where kind <> 0),
j as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from d),
e as (select *, row_number() over (partition by conv_id, role, text order by i) > 1 as seen,
  not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') as cut from j),
f as (select conv_id, turn, role, text, i, left(role, 1) as ini, blank, seen and not blank as dup, cut and not blank and not seen as cut, not blank and not seen as may from e),
s(conv_id, i, a0, a1, a2, a3) as (
  select distinct conv_id, 0::bigint, {{'c': 0::bigint, 'a': '', 'o': ''}}, null::struct(c bigint, a varchar, o varchar), null::struct(c bigint, a varchar, o varchar), null::struct(c bigint, a varchar, o varchar) from f
  union all
  select g.conv_id, g.i, {_edit("b0", "3", "D")}, list_min([{_edit("b1", "3", "D")}, case when may and ini = 's' then {_edit("b0", "cut::int", "K", "chr(10) || role || ':' || text")} end]),
    list_min([{_edit("b2", "3", "D")}, case when may and ini = 'u' then list_min([{", ".join(_edit(b, "cut::int", "K", "chr(10) || role || ':' || text") for b in ("b0", "b1", "b3"))}]) end, case when may then list_min([{", ".join(_edit(b, "2 + cut::int", "R", "chr(10) || 'user:' || text") for b in ("b0", "b1", "b3"))}]) end]),
    list_min([{_edit("b3", "3", "D")}, case when may and ini = 'a' then {_edit("b2", "cut::int", "K", "chr(10) || role || ':' || text")} end, case when may then {_edit("b2", "2 + cut::int", "R", "chr(10) || 'assistant:' || text")} end])
  from (select f.*, a0 as b0, a1 as b1, b2, list_min([a3, {_edit("b2", "2", "I", "chr(10) || 'assistant:'")}]) as b3
    from (select *, list_min([a2, {", ".join(_edit(b, "2", "I", "chr(10) || 'user:'") for b in ("a0", "a1", "a3"))}]) as b2 from s) x join f on f.conv_id is not distinct from x.conv_id and f.i = x.i + 1) g),
z as (select conv_id, list_min([a0, a3, {_edit("b2", "2", "I", "chr(10) || 'assistant:'")}]) as best
  from (select *, list_min([a2, {", ".join(_edit(b, "2", "I", "chr(10) || 'user:'") for b in ("a0", "a1", "a3"))}]) as b2 from s where i = (select max(f.i) from f where f.conv_id is not distinct from s.conv_id)) y),
p as (select *, lag(ini) over (partition by conv_id order by i) || ini as two from f),
n as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, sum(blank::int) as blank, sum(dup::int) as duplicate, sum(cut::int) as truncated, sum(coalesce(two not in ('su', 'ua', 'au'), false)::int) as illegal from p group by conv_id),
o as (select distinct conv_id from conversations)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
  coalesce(best.c, 0)::bigint as cost, coalesce(best.a, '') as audit, sha256(coalesce(best.o[2:], '')) as repaired_sha256
from o left join n on n.conv_id is not distinct from o.conv_id left join z on z.conv_id is not distinct from o.conv_id
"""

NEGATIVES = r"""
with e as (select row_number() over () as r, vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
a as (select * from e where vec_id % 100 = 0),
s as (select a.r as ar, a.vec_id as anchor_id, b.r as br, b.vec_id as vec_id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score from a join e b on len(a.v) = len(b.v) and a.r <> b.r),
p as (select * from s where same qualify row_number() over (partition by ar order by score desc, vec_id) <= 5)
select p.anchor_id, p.vec_id as positive_id, (row_number() over (partition by p.ar, p.br order by n.score desc, n.vec_id))::int as rank, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score
from p join s n on n.ar = p.ar and not n.same and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score
qualify rank <= 10
"""
