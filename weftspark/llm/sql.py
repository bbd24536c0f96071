"""DuckDB SQL that states the results of the queries SQL can express."""

from __future__ import annotations

#: Line dedup over a relation {docs} with doc_id and text.
LINES_SQL = r"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
  from {docs}),
k as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
s as (
  select key, min(doc_id) as first_doc from k where length(key) >= 10
  group by key having count(distinct doc_id) >= 2),
j as (select k.*, coalesce(s.first_doc < k.doc_id, false) as gone from k left join s on k.key = s.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as text
from j group by doc_id
"""

ORACLE = {
    "op2_vector_top_k": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as x from embeddings
           where vec_id is not null and embedding is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.x, c.x) as bigint) as score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
""",
    "op6_line_dedup": f"select doc_id, n_lines, n_dropped, sha256(text) as kept_sha256 from ({LINES_SQL.format(docs='documents')})",
    "op7_source_mix": r"""
with d as (
  select doc_id, source, md5(cast(doc_id as varchar)) as h,
         cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size
  from documents),
s as (select source, cast(sum(size) as bigint) as s from d group by source),
w as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as w from s),
c as (select *, 3 * s as cap, cast(3 * s as double) / w as lim from w),
l as (
  select *, (sum(s) over () - coalesce(sum(cap) over b, 0))::bigint::double / ((sum(w) over () - coalesce(sum(w) over b, 0))::bigint) as level,
         cast(sum(s) over () as bigint) as total
  from c window b as (order by lim, source nulls last rows between unbounded preceding and 1 preceding)),
t as (
  select source, s, total, case w when 1 then -0.5::double when 2 then 0.0::double else 0.5::double end as slope,
         least(cast(cap as double), w * coalesce(max(case when level <= lim then level end) over (), 0.0::double)) as target
  from l),
r as (
  select d.*, t.s, t.total, t.slope, t.target, case when t.s > 0 then cast(floor(t.target / t.s) as bigint) else 0 end as passes,
         cast(coalesce(sum(size) over (partition by d.source order by h, doc_id, size rows between unbounded preceding and 1 preceding), 0) as bigint) as start
  from d join t on d.source is not distinct from t.source),
m as (select *, target - passes * s as rest, case when size > 0 and start + size <= target - passes * s then 1 else 0 end as more from r),
g as (select source, max(rest) - sum(more * size) as gap, cast(sum((passes + more) * size) as bigint) as took from m group by source),
f as (
  select m.*, g.took, row_number() over (partition by m.source order by
           case when more = 0 and size > 0 and abs(size - gap) < gap then 0 else 1 end, abs(size - gap), start, doc_id) = 1
         and more = 0 and size > 0 and abs(size - gap) < gap as fill
  from m join g on m.source is not distinct from g.source),
o as (
  select *, passes + more + fill::int as n,
         least((case when passes + more > 0 then start else rest end) / greatest(took, 1), 1.0::double) as done from f)
select doc_id, size, s as source_size, target,
       cast(case when size > 0 then n * size else 0 end as bigint) as taken,
       cast(case when size > 0 then n else 0 end as bigint) as copies,
       case when size > 0 and n > 0 then round(
         case when slope = 0 then done else (sqrt((1 - slope) * (1 - slope) + 4 * slope * done) - (1 - slope)) / (2 * slope) end * total, 3) end as position
from o
""",
    "op13_fill_middle": r"""
with d as (
  select doc_id, coalesce(text, '') as text, sha256('7:' || cast(doc_id as varchar)) as h,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u
  from documents),
c as (
  select *, cast(len(u) as bigint) as n, cast('0x' || h[1:8] as bigint) % (len(u) + 1) as c1, cast('0x' || h[9:16] as bigint) % (len(u) + 1) as c2,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') then 'plain'
              when cast('0x' || h[25:32] as bigint) % 100 < 50 then 'spm' else 'psm' end as form
  from d),
p as (
  select *, coalesce(array_to_string(u[1:least(c1, c2)], ''), '') as pre, coalesce(array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], ''), '') as mid,
         coalesce(array_to_string(u[greatest(c1, c2) + 1:], ''), '') as suf
  from c)
select doc_id, n, form, case when form <> 'plain' then cast(length(pre) as bigint) end as prefix_chars,
       case when form <> 'plain' then cast(length(mid) as bigint) end as middle_chars,
       sha256(case form when 'plain' then text when 'spm' then '<S>' || suf || '<P>' || pre || '<M>' || mid
                   else '<P>' || pre || '<S>' || suf || '<M>' || mid end) as output_sha256,
       sha256(text) as restored_sha256
from p
""",
    # CRC-32 of a string's UTF-8 bytes by its table of 256 steps, made from the polynomial.
    "op12_importance": r"""
with recursive step(b, c, k) as (
  select b, b, 0 from range(256) r(b)
  union all select b, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from step where k < 8),
crc as (select list(c order by b) as steps from step where k = 8),
texts as (select true as corpus, doc_id, text from documents union all select false, null, text from benchmark),
t as (
  select row_number() over () as row, corpus, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from texts),
w as (select row, corpus, unnest(w) as w, unnest(range(len(w))) as pos from t),
r as (select row, corpus, w, lead(w) over a as w2, lead(w, 2) over a as w3 from w window a as (partition by row order by pos)),
f as (select row, corpus, unnest([w, w || ' ' || w2, w || ' ' || w2 || ' ' || w3]) as f from r),
n as (select row, corpus, f, count(*) as n from f where f is not null group by all),
h as (
  select f, xor(list_reduce(list_transform(range(0, 2 * octet_length(encode(f)), 2), lambda i: cast('0x' || substr(hex(encode(f)), i + 1, 2) as bigint)),
                            lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 as bucket
  from (select distinct f from n), crc),
c as (select row, corpus, bucket, sum(n)::bigint as n from n join h using (f) group by all),
s as (select bucket, coalesce(sum(n) filter (corpus), 0)::bigint as s, coalesce(sum(n) filter (not corpus), 0)::bigint as t from c group by bucket),
g as (
  select bucket, floor(1000 * ln((t + 1)::double * ((select sum(s) from s) + 10000)::double / ((s + 1)::double * ((select sum(t) from s) + 10000)::double)))::bigint as gain
  from s),
x as (select row, sum(n * gain)::bigint as weight from c join g using (bucket) where corpus group by row),
d as (
  select row, doc_id, len(w) as n_words, (len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0))::bigint as n_features, coalesce(weight, 0)::bigint as weight,
         coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((cast('0x' || sha256('42:' || cast(doc_id as varchar))[1:8] as bigint) + 0.5::double) / 4294967296)))::bigint as score
  from t left join x using (row) where corpus),
o as (select row, row_number() over (order by score desc, doc_id) as rank from d where n_words >= 20)
select doc_id, n_features, weight, score, case when rank <= 5 * (select count(*) from o) // 100 then rank end as rank from d left join o using (row)
""",
}
