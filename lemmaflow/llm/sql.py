"""SQL twins of the queries whose method SQL can't name but whose result it can."""

from __future__ import annotations

CRC_POLYNOMIAL = 0xEDB88320


def _crc_table() -> list[int]:
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ CRC_POLYNOMIAL * (x & 1)
        out.append(x)
    return out


def crc32(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of an SQL expression."""
    octets = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex({text}), 2 * i::int + 1, 2))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {octets}), lambda c, b: xor(c >> 8, list_extract({_crc_table()}::bigint[], (xor(c, b) & 255) + 1))), 4294967295)"


def lower_ascii(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def jaccard_components(k: int, percent: int, kept: bool = False) -> str:
    """Components of documents whose sets of word k-grams have a similarity of ``percent`` % or more; doc_id must not repeat. Pairs are found by the shared k-grams of all sizes that may link."""
    return f"""
with recursive w as (select doc_id, regexp_extract_all({lower_ascii("text")}, '[^\\x20\\x09-\\x0D]+') as w from documents),
g as (select doc_id, array_to_string(g, ' ') as g from
      (select doc_id, unnest(case when len(w) < {k} then [w] else list_transform(range(1, len(w) - {k} + 2), lambda i: w[i:i + {k - 1}]) end) as g from w where len(w) > 0) group by all),
n as (select doc_id, count(*) as n, md5(string_agg(g, chr(1) order by g)) as print from g group by 1),
c as (select a.doc_id as a, b.doc_id as b, count(*) as c from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from c join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= {percent} * (x.n + y.n - c)),
ways as (select a, b from e union all select b, a from e),
r(id, label) as (select distinct a, a from ways union select ways.b, r.label from r join ways on r.id = ways.a where r.label < ways.b),
m as (select id, min(label) as label from r group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, case when n.n > 0 then min(d.doc_id) over (partition by n.print) else d.doc_id end as class_id, least(d.doc_id, coalesce(m.label, d.doc_id)) as component_id{", d.doc_id = least(d.doc_id, coalesce(m.label, d.doc_id)) as kept" if kept else ""}
from documents d left join n using (doc_id) left join m on m.id = d.doc_id"""


IMPORTANCE = f"""
with words as (select row_number() over () as k, doc_id, regexp_extract_all({lower_ascii("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w, 's' as side from documents
               union all select row_number() over (), null, regexp_extract_all({lower_ascii("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), 't' from benchmark),
f as (select side, k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from words where len(w) > 0),
c as (select side, k, f, count(*) as n from f group by all),
names as (select f, ({crc32("f")}) % 10000 as bucket from (select distinct f from c)),
b as (select side, k, bucket, sum(n) as n from c join names using (f) group by all),
s as (select bucket, sum(n) filter (side = 's') as s, sum(n) filter (side = 't') as t from b group by 1),
big as (select sum(s) as s, sum(t) as t from s),
gain as (select bucket, floor(1000 * ln((coalesce(s.t, 0) + 1)::double * (coalesce(big.s, 0) + 10000)::double / ((coalesce(s.s, 0) + 1)::double * (coalesce(big.t, 0) + 10000)::double)))::bigint as gain from s, big),
w as (select k, floor(sum(n * gain)::bigint / sum(n))::bigint as approx, sum(n * gain)::bigint as total, sum(n)::bigint as n_features from b join gain using (bucket) where side = 's' group by 1),
x as (select doc_id, k, coalesce(len(w), 0) as n_words, coalesce(n_features, 0) as n_features,
             coalesce(case when total < 0 then -((-total + n_features - 1) // n_features) else total // n_features end, 0)::bigint as weight,
             ('0x' || substr(sha256('7:' || doc_id), 1, 8))::bigint as h from words left join w using (k) where side = 's'),
z as (select *, (weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double))))::bigint as score from x),
p as (select *, row_number() over (order by (n_words >= 20) desc, score desc, doc_id) as place, count(*) filter (n_words >= 20) over () as n from z)
select doc_id, n_features, weight, score, case when place <= 25 * n // 100 then place end as rank from p"""

#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. The recursion takes the rows of each conversation from the last to the first; best(r, q) is the least
#: cost and string from state q with r rows to go.
CONVERSATIONS = f"""
with recursive raw as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                       ({crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")}) % 20 as kind from conversations),
rows as (select conv_id, turn, case when kind = 4 then 'user' else role end as role,
                case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
         from raw, unnest(case when kind = 3 then [0, 1] else [0] end) as u(copy) where kind <> 0),
placed as (select *, row_number() over w as i, count(*) over (partition by conv_id) as n, lead(role) over w as next_role from rows window w as (partition by conv_id order by turn nulls first, role, text)),
seen as (select *, row_number() over (partition by conv_id, role, text order by i) > 1 as again, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) as tail, left(role, 1) as c from placed),
f as (select *, case when tail = '' then 'blank' when again then 'duplicate' when tail not in ('.', '!', '?') then 'truncated' else '' end as fault, n - i + 1 as r from seen),
edits as (select conv_id, r, q, op, q2, cost from f, (values (0), (1), (2), (3)) s(q), (values ('D'), ('K'), ('R')) o(op),
          lateral (select case when op = 'D' then q when op = 'R' then case when q = 2 then 3 else 2 end
                               when c = 's' and q = 0 then 1 when c = 'u' and q <> 2 then 2 when c = 'a' and q = 2 then 3 end as q2,
                          case when op = 'D' then 2 when fault in ('blank', 'duplicate') then null else case when op = 'R' then 1 else 0 end + case when fault = 'truncated' then 5 else 0 end end as cost) x
          where q2 is not null and cost is not null),
moves as (select conv_id, r, q, op, q2, cost from edits
          union all select conv_id, r, p.q, 'I' || op, q2, cost + 5 from edits e join (values (0, 2), (1, 2), (2, 3), (3, 2)) p(q, nq) on e.q = p.nq
          union all select conv_id, r, p.q, 'II' || op, q2, cost + 10 from edits e join (values (0, 3), (1, 3), (2, 2), (3, 3)) p(q, nq) on e.q = p.nq),
best(conv_id, r, q, cost, audit) as (
  select conv_id, 0::bigint, q, cost, audit from (select distinct conv_id from rows), (values (0, 0, ''), (1, 10, 'II'), (2, 5, 'I'), (3, 0, '')) s(q, cost, audit)
  union all
  select conv_id, r, q, cost, audit from (select m.conv_id, m.r, m.q, m.cost + b.cost as cost, m.op || b.audit as audit,
                                     row_number() over (partition by m.conv_id, m.q order by m.cost + b.cost, m.op || b.audit) as k
                                     from best b join moves m on m.conv_id is not distinct from b.conv_id and m.r = b.r + 1 and m.q2 = b.q) where k = 1),
won as (select b.conv_id, b.cost, b.audit from best b join (select conv_id, count(*) as n from rows group by 1) x on b.conv_id is not distinct from x.conv_id and b.r = x.n where q = 0),
steps as (select conv_id, p, substr(audit, p::int, 1) as op, sum(case when substr(audit, p::int, 1) = 'I' then 0 else 1 end) over (partition by conv_id order by p) as i from won, lateral (select unnest(range(1, length(audit) + 1)) as p)),
outs as (select s.conv_id, p, op, case when op = 'I' then '' else f.text end as text, case when op = 'K' then f.role end as role, op = 'K' and f.c = 's' as is_system
         from steps s left join f on f.conv_id is not distinct from s.conv_id and f.i = s.i and s.op <> 'I' where op <> 'D'),
named as (select conv_id, p, text, coalesce(role, case when sum(case when is_system then 0 else 1 end) over (partition by conv_id order by p) % 2 = 1 then 'user' else 'assistant' end) as role from outs),
digests as (select conv_id, sha256(string_agg(role || ':' || text, chr(10) order by p)) as digest from named group by 1),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
           count(*) filter (fault = 'truncated') as truncated, count(*) filter (next_role is not null and c || left(next_role, 1) not in ('su', 'ua', 'au')) as illegal from f group by 1)
select x.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
       coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, coalesce(digest, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) x left join counts c on x.conv_id is not distinct from c.conv_id left join won w on x.conv_id is not distinct from w.conv_id
left join digests d on x.conv_id is not distinct from d.conv_id"""
