"""The same results as SQL for DuckDB, where SQL can say them, by other ways."""

# Decides each URL by all rules that fit it.
URL_FILTERS = """
with parts as (
  select page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path
  from pages),
rules (verdict, rule_host, rule_path) as (
  values ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
         ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits as (
  select page_id, host, path, r.verdict, rule_host || rule_path as rule,
         row_number() over (partition by page_id, host, path
                            order by length(rule_host || rule_path) desc nulls last) as place
  from parts left join rules r
    on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict
from fits where place = 1
"""

# Compares all pairs of documents that share a shingle, and walks over all links.
NEAR_DUPLICATES = r"""
with recursive split as (
  select doc_id, string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+') as w
  from documents),
words as (
  select doc_id, word, i, count(*) over (partition by doc_id) as n
  from (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from split)
  where word <> ''),
runs as (
  select doc_id, n, word || ' ' || lead(word, 1) over o || ' ' || lead(word, 2) over o || ' '
         || lead(word, 3) over o || ' ' || lead(word, 4) over o as shingle
  from words window o as (partition by doc_id order by i)),
sets as (
  select distinct doc_id, shingle from runs where shingle is not null
  union all
  select doc_id, string_agg(word, ' ' order by i) from words where n < 5 group by doc_id),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as n
  from sets a join sets b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all),
links as (
  select a, b from shared s join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * s.n >= 85 * (x.n + y.n - s.n)),
reached as (
  select doc_id, doc_id as other from documents
  union
  select r.doc_id, l.b from reached r join links l on l.a = r.other)
select d.doc_id, coalesce(any_value(s.n), 0)::bigint as n_shingles,
       min(r.other)::bigint as component_id, d.doc_id = min(r.other) as kept
from documents d join reached r on r.doc_id = d.doc_id left join sizes s on s.doc_id = d.doc_id
group by d.doc_id
"""

# Counts all strings of 200 bytes, and joins the places of those that occur twice to runs.
REPEATS = """
with docs as (
  select doc_id, hex(encode(coalesce(text, ''))) as x,
         octet_length(encode(coalesce(text, '')))::bigint as n
  from documents),
blocks as (  -- strings that begin in 200 bytes lie in 399
  select doc_id, first, substr(x, 2 * first + 1, 798) as x
  from (select doc_id, x, unnest(range(0, n - 199, 200)) as first from docs where n >= 200)),
strings as (
  select doc_id, first + i as i, md5(substr(x, 2 * i + 1, 400)) as s
  from (select doc_id, first, x, unnest(range(0, length(x) // 2 - 199)) as i from blocks)),
places as (
  select doc_id, i from strings
  where s in (select s from strings group by s having count(*) > 1)),
marked as (
  select doc_id, i, case when i > 200 + lag(i) over (partition by doc_id order by i) then 1 else 0 end as new
  from places),
numbered as (
  select doc_id, i, sum(new) over (partition by doc_id order by i rows unbounded preceding) as run
  from marked),
runs as (
  select doc_id, min(i) as low, max(i) + 200 as high from numbered group by doc_id, run),
-- What is left lies between the end of a run, or the beginning, and the next run, or the end.
edges as (
  select doc_id, 0 as low, 0 as high from docs
  union all select doc_id, low, high from runs),
gaps as (
  select e.doc_id, e.high as low,
         coalesce(lead(e.low) over (partition by e.doc_id order by e.high), d.n) as high, d.x
  from edges e join docs d on d.doc_id = e.doc_id),
kept as (
  select doc_id, string_agg(substr(x, 2 * low + 1, 2 * greatest(high - low, 0)), '' order by low) as x
  from gaps group by doc_id),
gone as (select doc_id, sum(high - low) as n, count(*) as spans from runs group by doc_id)
select d.doc_id, d.n as n_bytes, coalesce(g.n, 0)::bigint as n_removed,
       coalesce(g.spans, 0)::bigint as n_spans, sha256(unhex(k.x)) as kept_sha256
from docs d join kept k on k.doc_id = d.doc_id left join gone g on g.doc_id = d.doc_id
"""

# Names each node by the digests of its turns; what lies below begins with that name.
CONVERSATION_TRIE = """
with recursive crc (conv_id, digits, k, v) as (
  select distinct conv_id, cast(conv_id as varchar), 0, 4294967295::bigint
  from conversations where conv_id is not null
  union all
  select conv_id, digits, k + 1,
         case when w & 1 = 1 then xor(w >> 1, 3988292384::bigint) else w >> 1 end
  from (select *, case when k % 8 = 0 then xor(v, ascii(substr(digits, k // 8 + 1, 1))::bigint)
                       else v end as w
        from crc where k < 8 * length(digits))),
heads as (
  select conv_id, conv_id - conv_id % 100 as base, xor(v, 4294967295::bigint) % 6 as h
  from crc where k = 8 * length(digits)),
turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, role, text) as place
  from conversations where conv_id is not null),
taken as (
  select h.conv_id, h.h, count(t.place) as got
  from heads h left join turns t on t.conv_id = h.base and t.place <= h.h group by all),
rebuilt as (
  select h.conv_id, t.place, t.role, t.text
  from heads h join turns t on t.conv_id = h.base and t.place <= h.h
  union all
  select t.conv_id, t.place - k.h + k.got, t.role, t.text
  from turns t join taken k on k.conv_id = t.conv_id and t.place > k.h),
steps as (
  select conv_id, place, length(text) as chars,
         string_agg(sha256(role) || sha256(text), '') over (
           partition by conv_id order by place rows unbounded preceding) as path
  from rebuilt
  union all
  select conv_id, 0, 0, '' from heads),
lengths as (select conv_id, max(place) as n from steps group by conv_id),
nodes as (
  select path, min(s.conv_id) as conv_id, max(place) as depth, count(*) as n_convs, max(chars) as chars,
         string_agg(cast(s.conv_id as varchar), ',' order by s.conv_id) filter (place = l.n) as ends
  from steps s join lengths l on l.conv_id = s.conv_id group by path),
children as (
  select left(path, length(path) - 128) as path, count(*) as n from nodes where path <> '' group by all),
rolled as (
  select a.path, count(*) filter (c.path is null) as n_leaves, sum((b.n_convs - 1) * b.chars) as saved
  from nodes a join nodes b on starts_with(b.path, a.path) left join children c on c.path = b.path
  group by a.path)
select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs::bigint as n_convs,
       coalesce(c.n, 0)::bigint as n_children, r.n_leaves::bigint as n_leaves,
       r.saved::bigint as saved_tokens, sha256(coalesce(n.ends, '')) as ends_sha256
from nodes n join rolled r on r.path = n.path
  left join children c on c.path = n.path
  left join nodes p on n.path <> '' and p.path = left(n.path, length(n.path) - 128)
"""
