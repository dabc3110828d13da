"""DuckDB SQL of operators that SQL can state, written the plain way: all pairs, all windows, whole orders."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

JACCARD = f"""
with recursive d as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w from documents
),
s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s from d
),
n as (select doc_id, len(s) as n_shingles from s),
e as (select doc_id, unnest(s) as x from s),
p as (
  select a.doc_id as a, b.doc_id as b from e a join e b on a.x = b.x and a.doc_id < b.doc_id join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, na.n_shingles, nb.n_shingles having 100 * count(*) >= 90 * (na.n_shingles + nb.n_shingles - count(*))
),
l as (select a as x, b as y from p union all select b, a from p),
r(x, y) as (select doc_id, doc_id from n union select r.x, l.y from r join l on l.x = r.y)
select n.doc_id, n.n_shingles::bigint as n_shingles, min(r.y) as component_id from n join r on r.x = n.doc_id group by n.doc_id, n.n_shingles
"""

SUBSTRINGS = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
k0 as (select doc_id, len(h) // 2 as n, c, substr(h, 200 * c + 1, 400) as part from (select *, unnest(range(0, (len(h) + 199) // 200)) as c from d)),
b as (select doc_id, n, 100 * c + j as p, j, part from (select *, unnest(range(0, least(100, n - 100 * c))) as j from k0)),
w as (select doc_id, p, substr(part, 2 * j + 1, 2) as x, case when p + 100 <= n then hash(substr(part, 2 * j + 1, 200)) end as s from b),
f as (select doc_id, p, x, s is not null and row_number() over (partition by s order by doc_id, p) > 1 as again from w),
c as (select doc_id, p, x, bool_or(again) over (partition by doc_id order by p rows between 99 preceding and current row) as gone from f),
m as (select *, coalesce(lag(gone) over (partition by doc_id order by p), false) as before from c),
k as (
  select doc_id, count(*) filter (gone) as n_removed, count(*) filter (gone and not before) as n_spans, string_agg(x, '' order by p) filter (not gone) as kept from m group by doc_id
)
select d.doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256
from d left join k using (doc_id)
"""

_CLOSER = """
g{i} as (
  select c.source, c.doc_id, c.twin, c.size, g.gap, row_number() over (partition by c.source order by abs(c.size::double - g.gap), c.q, c.doc_id, c.twin, c.size) as o
  from c join gap{i} g on g.source is not distinct from c.source
  where c.extra = 0 and c.size > 0 and c.q is not null and abs(c.size::double - g.gap) < g.gap {skip}
),
x{i} as (select * from g{i} where o = 1)
"""

MIXING = f"""
with i as (
  select doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))::bigint as size from documents
),
t as (select *, row_number() over (partition by doc_id, source, size) as twin from i),
s0 as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as no from t group by source),
s1 as (select *, (no - 1) % 3 + 1 as weight from s0),
s2 as (select *, source_size * 3.0::double / weight as room from s1),
s3 as (
  select *, coalesce(sum(source_size * 3) over w, 0)::bigint as capped, (sum(weight) over () - coalesce(sum(weight) over w, 0))::bigint as open_weight, (sum(source_size) over ())::bigint as total
  from s2 window w as (order by room, source nulls last rows between unbounded preceding and 1 preceding)
),
s4 as (select *, (total - capped)::double / open_weight as level from s3),
f as (select room, level from s4 where level <= room order by room, source nulls last limit 1),
s as (
  select s4.source, source_size, case when f.room is null or s4.room < f.room then source_size * 3.0::double else least(f.level * weight, source_size * 3.0::double) end as target
  from s4 left join f on true
),
b as (select *, -2 * length(bin(size)) as level from t),
v0 as (select source, level, sum(size)::bigint as words from b group by source, level),
v1 as (
  select v0.*, s.source_size, s.target, pow(2.0::double, level / 8.0::double) as appeal,
    coalesce(sum(words * 3) over (partition by v0.source order by level desc rows between unbounded preceding and 1 preceding), 0)::bigint as capped,
    sum(words * pow(2.0::double, level / 8.0::double)) over (partition by v0.source order by level desc rows between current row and unbounded following) as pull
  from v0 join s on s.source is not distinct from v0.source
),
v2 as (select *, case when pull <> 0 then (target - capped) / pull end as rate from v1),
v3 as (select *, max(case when rate * appeal <= 3 then struct_pack(l := level, r := rate) end) over (partition by source).r as fit from v2),
v4 as (select *, case when source_size = 0 then 0 else least(3.0::double, coalesce(fit * appeal, 3.0::double)) end as m from v3),
v5 as (select *, floor(m + 1e-9::double)::bigint as whole from v4),
p as (select *, greatest(m - whole, 0) as part, target - sum(whole * words) over (partition by source) as need from v5),
r as (
  select b.doc_id, b.source, b.size, b.twin, p.source_size, p.target, p.whole, p.need,
    (('0x' || substr(md5('mix-' || b.doc_id || '/' || b.twin), 1, 13))::bigint::double + 0.5) / 4503599627370496::double as u,
    least(greatest(part, 1e-9::double), 1 - 1e-9::double) as pi
  from b join p on p.source is not distinct from b.source and p.level = b.level
),
o as (select *, case when whole < 3 then (u / (1 - u)) / (pi / (1 - pi)) end as q from r),
z as (select *, case when q is not null then (sum(size) over (partition by source order by q nulls last, doc_id, twin rows between unbounded preceding and current row))::bigint end as top from o),
c as (select *, coalesce(top <= need and need > 0, false)::int as extra from z),
gap0 as (select source, need - coalesce(max(top) filter (extra = 1), 0) as gap from c group by source, need),
{_CLOSER.format(i=0, skip="")},
gap1 as (select source, gap - size as gap from x0),
{_CLOSER.format(i=1, skip="and not exists (select 1 from x0 where x0.source is not distinct from c.source and x0.doc_id = c.doc_id and x0.twin = c.twin and x0.size = c.size)")},
y as (select source, doc_id, twin, size from x0 union all select source, doc_id, twin, size from x1)
select c.doc_id, c.size, c.source_size, c.target, (c.whole + c.extra + (y.doc_id is not null)::int)::bigint as copies, (c.size * (c.whole + c.extra + (y.doc_id is not null)::int))::bigint as taken, c.source
from c left join y on y.source is not distinct from c.source and y.doc_id = c.doc_id and y.twin = c.twin and y.size = c.size
"""
