"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_REMOVED = r"""
w as (select doc_id, i, {window} as g from d, unnest(range(greatest(n - {width} + 1, 0))) as u(i)),
m as (select g, min(doc_id) as least from w group by g),
c as (select doc_id, i from w join m using (g) where least < doc_id),
b as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= {width} then 0 else 1 end as fresh from c),
k as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as k from b),
s as (select doc_id, min(i) as s, max(i) + {width} as e from k group by doc_id, k),
seg as (select doc_id, coalesce(lag(e) over (partition by doc_id order by s), 0) as a, s as z from s
  union all select d.doc_id, coalesce(max(e), 0), max(n) from d left join s using (doc_id) group by d.doc_id),
t as (select doc_id, coalesce(sum(e - s), 0)::bigint as n_removed, count(s) as n_spans from d left join s using (doc_id) group by doc_id)
"""

OP6 = (
    "with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, ''))::bigint as n from documents), "
    + _REMOVED.format(window="substr(h, (2 * i + 1)::bigint, 100)", width=50)
    + """, kept as (select doc_id, string_agg(substr(h, (2 * a + 1)::bigint, (2 * (z - a))::bigint), '' order by a) as kept from seg join d using (doc_id) group by doc_id)
select doc_id, n as n_bytes, n_removed, n_spans, sha256(unhex(kept)) as kept_sha256 from d join t using (doc_id) join kept using (doc_id)"""
)

OP9 = (
    r"with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as n from documents), "
    + _REMOVED.format(window="array_to_string(ws[i + 1 : i + 13], ' ')", width=13)
    + """, kept as (select doc_id, flatten(list(ws[a + 1 : z] order by a)) as kept from seg join d using (doc_id) group by doc_id)
select doc_id, n as n_words, n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from d join t using (doc_id) join kept using (doc_id)"""
)

OP7 = r"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select *, replace(replace(replace(text, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>') as et,
  replace(replace(replace(replace(role, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>'), ': ', '\: ') as er from c)
select conv_id, count(*) as n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(case when role = 'assistant' then length(text) end), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
  sum(4 + length(er) + 2 + length(et) + 8)::bigint as formatted_chars,
  regexp_full_match(string_agg(concat(role, ','), '' order by turn, role, text), '(system,)?user,(tool,)*assistant,((user,|tool,)(tool,)*assistant,)*') as valid
from e group by conv_id"""

_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)""".replace("\\'", "''")

OP5 = rf"""with d as (select doc_id, coalesce(text, '') as t from documents),
r as (select doc_id, 0 as k, regexp_extract_all(t, '{_ASSIGN}') as ms, string_split_regex(t, '{_ASSIGN}') as gs from d
  union all select doc_id, 1, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), string_split_regex(t, 'AKIA[A-Z0-9]+') from d
  union all select doc_id, 2, regexp_extract_all(t, '[0-9a-f]+'), string_split_regex(t, '[0-9a-f]+') from d
  union all select doc_id, 3, regexp_extract_all(t, '[A-Za-z0-9+/_=-]{{20,}}'), string_split_regex(t, '[A-Za-z0-9+/_=-]{{20,}}') from d),
u as (select doc_id, k, unnest(ms) as m, unnest(gs[1:len(ms)]) as g, unnest(range(len(ms))) as i from r where len(ms) > 0),
x as (select doc_id, k, m, (sum(length(g)) over w + sum(length(m)) over w - length(m))::bigint as s, (sum(length(g)) over w + sum(length(m)) over w)::bigint as e from u window w as (partition by doc_id, k order by i rows unbounded preceding)),
b as (select doc_id, k, s, e from x where case k when 0 then length(regexp_extract(m, '{_ASSIGN}', 2)) >= 6 when 1 then e - s >= 20 when 2 then e - s >= 24 else false end),
c as (select * from x where k = 3 and regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Za-z]') and not regexp_matches(m, '^[A-Za-z]?[a-z]+$') and not regexp_matches(m, '^[a-z]+([-_/=][a-z]+)+$')
  and not regexp_matches(m, '(?i)example|placeholder|xxxx') and not (m = repeat(m[1:1], length(m)) or m = repeat(m[1:2], length(m) // 2) or m = repeat(m[1:3], length(m) // 3) or m = repeat(m[1:4], length(m) // 4))
  and not exists (select 1 from b where b.doc_id = x.doc_id and b.s < x.e and x.s < b.e)),
h as (select doc_id, s, e, m, list_aggregate(string_split(substr(m, j, 20), ''), 'entropy') as h from (select *, unnest(range(1, length(m) - 18)) as j from c)),
f as (select doc_id, 3 as k, s, e from h group by doc_id, s, e, m having max(h) >= case when regexp_matches(m, '^[0-9a-fA-F]+$') then 3.0 when regexp_matches(m, '^[A-Z2-7=]+$') then 3.4 else 3.7 end),
a as (select *, concat(['assign', 'access', 'hex', 'entropy'][k + 1], ':', s, ':', e) as y from (select * from b union all select * from f))
select d.doc_id, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex,
  sha256(coalesce(string_agg(y, ',' order by s, k, e) filter (k < 3), '')) as base_sha256, coalesce(string_agg(y, ',' order by s, k, e), '') as spans from d left join a using (doc_id) group by d.doc_id"""
