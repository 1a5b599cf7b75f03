"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

def _mix_pass(p: int) -> str:
    """A pass over what is not taken and no larger than what is missing, up to the first that does not fit."""
    return f"""
r{p} as (
  select *, sum(case when size > 0 and not t{p} and size <= g{p} then size else 0 end) over
    (partition by source order by k, doc_id, size rows unbounded preceding)::bigint as n{p} from q{p}),
o{p} as (select *, size > 0 and not t{p} and size <= g{p} and n{p} <= g{p} as now{p} from r{p}),
q{p + 1} as (
  select *, t{p} or now{p} as t{p + 1}, g{p} - sum(case when now{p} then size else 0 end) over (partition by source) as g{p + 1} from o{p}),"""


#: Sources' weights in code-point order, the level by water filling, and a filler of four passes, as plain SQL.
OP6 = f"""
with d as (
  select doc_id, source, case when text is null then 0 else len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) end as size,
         md5('mix:' || coalesce(cast(doc_id as varchar), '')) as k
  from documents),
s as (
  select source, sum(size)::bigint as source_size, row_number() over (order by encode(source) nulls last) - 1 as rk from d group by source),
w as (select *, 3 * source_size as cap, [1.0::double, 2.0::double, 3.0::double][rk % 3 + 1] as weight from s),
l as (
  select *, cap / weight as ratio,
    (sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, rk rows between unbounded preceding and 1 preceding), 0))::double
    / (sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, rk rows between unbounded preceding and 1 preceding), 0)) as level
  from w),
t as (
  select source, source_size, rk, least(cap::double, (select level from l where level <= ratio order by ratio, rk limit 1) * weight) as target from l),
e as (
  select d.doc_id, d.source, d.size, d.k, t.source_size, t.rk, t.target,
    row_number() over (partition by d.source order by d.k, d.doc_id, d.size) as rn,
    case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end::bigint as ep
  from d join t on d.source is not distinct from t.source),
q0 as (select *, false as t0, target - ep * source_size as g0 from e),{"".join(map(_mix_pass, range(4)))}
p as (
  select source, arg_min(rn, struct_pack(off := abs(size - g4), rn := rn)) as pick
  from q4 where not t4 and size > 0 and ep < 3 and abs(size - g4) < g4 group by source),
f as (select q4.*, t4 or coalesce(rn = p.pick, false) as extra from q4 left join p on q4.source is not distinct from p.source),
c as (
  select *, case when size > 0 then ep + extra::int else 0 end as copies,
    sum(case when ep > 0 or extra then size else 0 end) over (partition by source order by rn rows unbounded preceding)::bigint as e from f),
x as (
  select *, greatest(0.0, least(1.0, (e - size / 2.0::double) / target)) as u, [1.5::double, 1.0::double, 0.5::double][rk % 3 + 1] as w0,
    [-1.0::double, 0.0::double, 1.0::double][rk % 3 + 1] as slope from c)
select doc_id, size::bigint as size, source_size, target, (size * copies)::bigint as taken, copies::bigint as copies,
  case when copies > 0 then 2 * u / (w0 + sqrt(greatest(0.0, w0 * w0 + 2 * slope * u))) end as position
from x
"""

OP9 = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""

#: Shared shingles by joining on them, then the smallest reachable id by recursion along links.
OP2 = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (
  select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as m from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
l as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * m >= 75 * (x.n + y.n - m)),
r as (select doc_id as a, doc_id as b from documents union select r.a, l.b from r join l on r.b = l.a),
c as (select a as doc_id, min(b) as component_id from r group by a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d join c on c.doc_id = d.doc_id left join n on n.doc_id = d.doc_id
"""

#: Every window as its words, the smallest doc_id of each, and the words that later documents' windows cover.
OP7 = """
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
p as (select doc_id, unnest(range(1, len(w) - 11)) as i, w from w where len(w) >= 13),
g as (select doc_id, i, array_to_string(w[i:i+12], ' ') as s from p),
m as (select s, min(doc_id) as owner from g group by s),
x as (select distinct doc_id, unnest(range(i, i + 13)) as i from g join m using (s) where m.owner < g.doc_id),
c as (select doc_id, list(i) as gone from x group by doc_id),
k as (select w.doc_id, len(w.w) as n, coalesce(len(c.gone), 0) as r,
  case when c.gone is null then w.w else list_transform(list_filter(range(1, len(w.w) + 1), lambda j: not list_contains(c.gone, j)), lambda j: w.w[j]) end as kept
  from w left join c on c.doc_id = w.doc_id)
select doc_id, n::bigint as n_words, r::bigint as n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from k
"""

OP3 = """
with v as (
  select vec_id, cast(embedding as double[]) as e from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0
    and len(list_filter(embedding, lambda c: c <> 0)) > 0),
s as (select a.vec_id as query_id, b.vec_id as vec_id, list_inner_product(a.e, b.e) as score
  from v a join v b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id and len(a.e) = len(b.e)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""

#: CRC-32 by its table, over the UTF-8 bytes of letters up to U+00FF; near words by what is left without one letter:
#: words of one length leave the same at the same place, and of others the shorter word is what is left.
OP12 = """
with recursive tab as (
  select list(c order by i) as t from (
    select i, list_reduce(list_prepend(i::ubigint, list_transform(range(8), lambda k: 0::ubigint)),
      lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end) as c from range(256) r(i))),
low as (select doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
runs as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) as run from low),
own as (select doc_id, run, count(*) as c, coalesce(doc_id::varchar, '') || ':' || run as s from runs where length(run) >= 7 group by all),
bytes as (
  select *, flatten(list_transform(string_split(s, ''), lambda x: case when unicode(x) < 128 then [unicode(x)] else [195, unicode(x) - 64] end)) as b from own),
hashed as (
  select run, c, xor(4294967295::ubigint, list_reduce(list_prepend(4294967295::ubigint, list_transform(b, lambda x: x::ubigint)),
    lambda h, x: xor(h >> 8, t[(xor(h, x) & 255)::int + 1]))) as h from bytes, tab),
words as (
  select word, sum(c)::bigint as n from (
    select c, case when h % 31 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word from hashed)
  where length(word) >= 7 group by word having sum(c) >= 2),
less as (select distinct word, n, i, substr(word, 1, i::int) || substr(word, i::int + 2) as rest from (select word, n, unnest(range(length(word))) as i from words)),
pairs as (
  select a.word as a, b.word as b, b.n from less a join less b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select l.word, w.word, w.n from less l join words w on l.rest = w.word
  union select w.word, l.word, l.n from less l join words w on l.rest = w.word),
best as (select a as word, count(*) as n_near, max(n) as top, arg_min(b, struct_pack(n := -n, w := encode(b))) as b from pairs group by a),
f as (select word, n, coalesce(n_near, 0) as n_near, case when top >= 10 * n then b end as form, case when top >= 10 * n then top end as form_n from words left join best using (word)),
r as (select word, word as root, 0 as k from f union all select r.word, f.form, k + 1 from r join f on f.word = r.root where f.form is not null)
select f.word, form, e.root, n, n_near::bigint as n_near, form_n::bigint as form_n from f join (select word, arg_max(root, k) as root from r group by word) e using (word)
"""

OP13 = """
with d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
m as (
  select doc_id, part, (len(w) < 100)::int + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int
    + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text))::int + 8 * regexp_matches(text, '[#$%&*|]')::int
    + 16 * coalesce(doc_id > min(doc_id) over (partition by text), false)::int as mask from d),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
c as (select part, mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from m left join l using (doc_id) group by part, mask),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as f, unnest([1, 2, 4, 8, 16]) as bit),
o as (
  select a.f || b.f || x.f || y.f || z.f as filter_order, [a.bit, b.bit, x.bit, y.bit, z.bit] as bits from f a, f b, f x, f y, f z
  where a.bit + b.bit + x.bit + y.bit + z.bit = 31 and a.bit | b.bit | x.bit | y.bit | z.bit = 31),
s as (select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::int as before from o, range(1, 6) r(step)),
t as (
  select part, filter_order, step::int as step, bit, sum(case when mask & (before | bit) = 0 then n else 0 end)::bigint as kept,
    sum(case when mask & bit > 0 and mask & before = 0 then n else 0 end)::bigint as removed,
    sum(case when mask & bit > 0 and mask & before > 0 then n else 0 end)::bigint as redundant,
    sum(case when mask = bit then n else 0 end)::bigint as unique_fails,
    sum(case when mask & bit > 0 and mask & before = 0 then good else 0 end)::bigint as good_lost,
    sum(case when mask & bit > 0 and mask & before = 0 then toxic else 0 end)::bigint as toxic_lost
  from c, s group by all)
select * exclude (bit), sum(removed) over (partition by part, bit)::bigint as shapley from t
"""

ORACLES: dict[str, str] = {"op3_neighbours": OP3, "op7_substring_dedup": OP7, "op2_near_dedup": OP2, "op6_mix": OP6, "op9_exact_dedup": OP9, "op12_spelling": OP12, "op13_filter_audit": OP13}
