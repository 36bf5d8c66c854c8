"""The registered queries that SQL can express, in DuckDB's dialect; every constant is written out here once more."""

MERKLE = r"""with recursive fields as (
  select *, crc % 7 = 0 and n_chars is not null as struck from (
    select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
        lambda acc, b: list_reduce(list_prepend(xor(acc, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
          lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) as crc from documents)),
written as (
  select doc_id, lang, coalesce(struck, false) as struck,
         coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') as head,
         coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as size,
         coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1), '-') as more,
         coalesce(strlen(text) || ':' || text, '-') as body from fields),
hashed as (select doc_id, lang, sha256(head || size || body) as leaf, sha256(head || case when struck then more else size end || body) as shown from written),
leaves as materialized (
  select row_number() over () as rid, doc_id, coalesce('=' || lang, '') as tree, leaf, shown,
         row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by lang) as n from hashed),
levels(lvl, tree, idx, n, h) as (
  select 0::bigint, tree, idx, n, leaf from leaves
  union all
  select lvl + 1, tree, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' order by idx)) from levels where n > 1 group by lvl, tree, idx // 2, n),
subroots as materialized (
  select tree, h, lvl as height, row_number() over (order by tree) - 1 as idx, count(*) over () as n from levels where n = 1),
tops(lvl, idx, n, h) as (
  select 0::bigint, idx, n, h from subroots
  union all
  select lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' order by idx)) from tops where n > 1 group by lvl, idx // 2, n),
steps as materialized (
  select l.rid, v.lvl as step, v.idx % 2 as odd, coalesce(s.h, '') as sibling
  from leaves l join levels v on v.tree = l.tree and v.n > 1 and v.idx = l.idx >> v.lvl::int
  left join levels s on s.tree = v.tree and s.lvl = v.lvl and s.idx = xor(v.idx, 1)
  union all
  select l.rid, r.height + v.lvl, v.idx % 2, coalesce(s.h, '')
  from leaves l join subroots r on r.tree = l.tree join tops v on v.n > 1 and v.idx = r.idx >> v.lvl::int
  left join tops s on s.lvl = v.lvl and s.idx = xor(v.idx, 1)),
folds(rid, step, h) as (
  select rid, 0::bigint, shown from leaves
  union all
  select f.rid, f.step + 1, sha256(case when odd = 1 then sibling || h else h || sibling end) from folds f join steps s on s.rid = f.rid and s.step = f.step),
ends as (select rid, arg_max(h, step) as folded_root from folds group by rid),
proofs as (select rid, string_agg(sibling, '' order by step) as all_siblings from steps group by rid),
top_root as (select h from tops where n = 1)
select doc_id, leaf, r.h as subroot, (select h from top_root) as root, sha256(coalesce(all_siblings, '')) as proof_sha256,
       folded_root, folded_root = (select h from top_root) as verified
from leaves l join subroots r on r.tree = l.tree join ends using (rid) left join proofs using (rid)"""

URLS = r"""with cut as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages),
parts as (
  select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path,
         coalesce(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '') as query from cut),
canon as (
  select *, array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))), '&') as asked,
         regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') as bare, regexp_replace(path, '/+(index\.html?)?$', '') as place from parts),
named as (select page_id, host, path, case when host <> '' then bare || place || case when asked = '' then '' else '?' || asked end end as canonical from canon),
listing as (select distinct canonical from named where regexp_matches(host, '(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.')),
rules(rule, h, p, v) as (values ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
fitting as (select page_id, arg_max(rule, length(rule)) as rule, arg_max(v, length(rule)) as v from named join rules
            on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
select page_id, host, path, rule, coalesce(v, case when l.canonical is not null then 'block' else 'allow' end) as verdict, l.canonical is not null as listed
from named left join fitting using (page_id) left join listing l on l.canonical = named.canonical"""

PHRASES = r"""with texts as (
  select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
pieces as (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as piece from texts),
placed as materialized (select lang, regexp_extract_all(piece, '[^ \t]+') as ws from pieces),
totals as (select lang, sum(len(ws))::bigint as n from placed group by lang),
spans as (select lang, ws, k, unnest(range(len(ws) - k + 1)) as i from placed, range(1, 6) t(k) where len(ws) >= k),
grams as materialized (
  select lang, k, array_to_string(ws[i + 1 : i + k], ' ') as phrase, count(*) as f
  from spans group by all having count(*) >= 100),
cuts as (select lang, phrase, f as a, n, string_split(phrase, ' ') as ws, unnest(range(1, k)) as cut from grams join totals using (lang) where k > 1),
halves as (select *, array_to_string(ws[1 : cut], ' ') as one, array_to_string(ws[cut + 1 :], ' ') as rest from cuts),
rated as (
  select h.lang, h.phrase, a, n, cut, l.f as l, r.f as r, ((1000::hugeint * a * n) // (l.f::hugeint * r.f))::bigint as score
  from halves h join grams l on l.lang = h.lang and l.phrase = one join grams r on r.lang = h.lang and r.phrase = rest),
lowest as (select * from rated qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
kept as (
  select * from lowest x where not exists (
    select 1 from grams g where g.lang = x.lang and g.phrase <> x.phrase and g.f >= x.a and contains(' ' || g.phrase || ' ', ' ' || x.phrase || ' ')))
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
       from kept qualify rank <= 2000"""
