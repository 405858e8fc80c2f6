"""DuckDB SQL for the queries that SQL can express on whole tables.

Not here, and tested against brute force or the libraries instead: tokenizers (op2, op3),
licence paragraphs (op4), trained models (op5, op7), quote parsing (op8), windows of
every item's size (op10), and the pipeline, which holds a trained model.
"""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: str) -> str:
    return f"case when strpos({url}, '://') > 0 then substr({url}, strpos({url}, '://') + 3) end"


def _host(url: str) -> str:
    return f"coalesce(translate(regexp_extract({_rest(url)}, '^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '')"


def _path(url: str) -> str:
    return f"coalesce(regexp_extract({_rest(url)}, '^[^/?#]*([^?#]*)', 1), '')"


def _node(url: str) -> str:
    return f"{_host(url)} || {_path(url)} || coalesce(regexp_extract({_rest(url)}, '^[^?#]*([?][^#]*)', 1), '')"


def _attribute(name: str) -> str:
    pattern = rf"""'(?i)\b{name}\s*=\s*(?:"([^"]*)"|''([^'']*)'')'"""
    return f"(regexp_extract(tag, {pattern}, 1) || regexp_extract(tag, {pattern}, 2))"


URL_FILTERS = rf"""
with recursive rules(rule, verdict) as (values {{rules}}),
tags as (
  select url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) tag from pages where url is not null),
found as (
  select url, replace(trim(case when lower({_attribute('rel')}) = 'canonical' then {_attribute('href')}
    when lower({_attribute('http-equiv')}) = 'refresh'
    then regexp_extract({_attribute('content')}, '(?i)url\s*=\s*[''"]?([^''"]*)', 1) end), '&amp;', '&') named,
    regexp_extract(url, '^(.*?)://', 1) scheme, {_host('url')} host,
    regexp_replace({_path('url')}, '[^/]*$', '') folder
  from tags),
links as (
  select url, case when strpos(named, '://') > 0 then named
    when starts_with(named, '//') then scheme || ':' || named
    when starts_with(named, '/') then scheme || '://' || host || named
    else scheme || '://' || host || case when folder = '' then '/' else folder end || named end target
  from found where named <> ''),
ends as (
  select {_node('url')} a, {_node('target')} b, url, target from links
  where {_host('url')} <> '' and {_host('target')} <> ''),
places as (
  select page_id, {_host('url')} host, {_path('url')} path, {_node('url')} node from pages),
sites as (
  select a node, {_host('url')} host, {_path('url')} path from ends
  union select b, {_host('target')}, {_path('target')} from ends),
judged as (
  select host, path, arg_max(rule, length(rule)) rule, arg_max(verdict, length(rule)) verdict
  from (select host, path from places union select host, path from sites) p
  join (select *, regexp_extract(rule, '^[^/]*') rh, substr(rule, length(regexp_extract(rule, '^[^/]*')) + 1) rp from rules) r
    on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)
  group by 1, 2),
sides as (select a, b from ends union select b, a from ends),
reached as (
  select node, verdict from sites join judged using (host, path)
  union select sides.b, reached.verdict from reached join sides on sides.a = reached.node),
passed as (select node, min(verdict) verdict from reached group by 1)
select page_id, host, path, rule, coalesce(judged.verdict, passed.verdict, 'allow') verdict
from places left join judged using (host, path) left join passed using (node)
"""

EXACT_SEARCH = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) e from embeddings
  where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0)
select query_id, rank, vec_id, score
from (select *, (row_number() over (partition by query_id order by score desc, vec_id))::int rank from s) where rank <= 5
"""

NEAR_DUPS = rf"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') w
  from documents),
s as (
  select doc_id, list_distinct(case when len(w) = 0 then []::varchar[] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) end) s from w),
t as (select doc_id, len(s) n, unnest(s) x from s),
links as (
  select a.doc_id a, b.doc_id b from t a join t b on a.x = b.x and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
sides as (select a, b from links union select b, a from links),
reached as (
  select doc_id d, doc_id r from documents union select sides.b, reached.r from reached join sides on sides.a = reached.d),
named as (select d doc_id, min(r) component_id from reached group by 1)
select s.doc_id, len(s)::bigint n_shingles, component_id, s.doc_id = component_id kept from s join named using (doc_id)
"""

COLLOCATIONS = r"""
with pieces as (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece from documents),
split as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') w from pieces),
runs as (
  select lang, 1 k, unnest(w) phrase from split
  union all select lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from split
  union all select lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from split),
f as materialized (select lang, k, phrase, count(*) c from runs group by all),
parts as materialized (select {'lang': lang, 'phrase': phrase} part, c from f where k < 3 and c >= 10),
totals as (select lang, sum(c)::bigint n from f where k = 1 group by 1),
candidates as (select lang, k, phrase, c a, string_split(phrase, ' ') w from f where k > 1 and c >= 10),
cut as materialized (select lang, phrase, a, cut, {'lang': lang, 'phrase': array_to_string(w[1:cut], ' ')} part_l,
    {'lang': lang, 'phrase': array_to_string(w[cut + 1:], ' ')} part_r
  from (select *, unnest(range(1, k)) cut from candidates)),
cuts as (select lang, phrase, a, cut, l.c l, r.c r, ((1000000::hugeint * a * a) // (l.c::hugeint * r.c))::bigint score
  from cut join parts l on part_l = l.part join parts r on part_r = r.part),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
longer as (select lang, phrase, max(a) a from (
    select lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) phrase from candidates where k = 3)
  group by 1, 2)
select b.lang, row_number() over (partition by b.lang order by score desc, b.a desc, b.phrase)::bigint rank,
  b.phrase, b.a, b.l, b.r, n, score
from best b join totals using (lang) left join longer x on x.lang = b.lang and x.phrase = b.phrase
where x.a is null or 100 * x.a < 50 * b.a
qualify rank <= 2000
"""

PREFIX_TRIE = r"""
with recursive bits as (
  select n, n::bigint v, 0 i from range(256) t(n)
  union all select n, case when v % 2 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, i + 1 from bits where i < 8),
crc_table as (select list(v order by n) of from bits where i = 8),
ordered as (
  select conv_id, coalesce(role, '') role, coalesce(text, '') text,
    row_number() over (partition by conv_id order by turn nulls first,
      substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) - 1 pos
  from conversations where conv_id is not null),
convs as (
  select conv_id, conv_id - conv_id % 100 base, xor(list_reduce(
      list_prepend(4294967295, list_transform(string_split(conv_id::varchar, ''), lambda c: ord(c)::bigint)),
      lambda a, b: xor(of[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 6 h
  from (select distinct conv_id from ordered), crc_table),
rebuilt as (
  select c.conv_id, 0 own, pos, role, text from convs c join ordered o on o.conv_id = base and pos < h
  union all select conv_id, 1, pos, role, text from convs join ordered using (conv_id) where pos >= h),
numbered as (
  select conv_id, row_number() over (partition by conv_id order by own, pos) depth, text,
    md5(length(role) || ':' || role || text) id from rebuilt),
prefixes as (
  select conv_id, depth, length(text) size, string_agg(id, '') over (partition by conv_id order by depth) node from numbered
  union all select conv_id, 0, 0, '' from convs),
deepest as (select conv_id, max(depth) depth from prefixes group by 1),
nodes as (
  select node, p.depth, min(conv_id) conv_id, count(*) n_convs, any_value(size) size,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (p.depth = d.depth), '')) ends
  from prefixes p join deepest d using (conv_id) group by 1, 2),
placed as (select *, left(node, length(node) - 32) up from nodes),
children as (select up, count(*) n from placed where depth > 0 group by 1),
below as (
  select left(x.node, 32 * d)  node, sum((n_convs - 1) * size) saved, count(*) filter (c.up is null) leaves
  from (select *, unnest(range(0, depth + 1)) d from nodes) x left join children c on c.up = x.node group by 1)
select t.conv_id, t.depth, p.conv_id parent_conv_id, t.n_convs, coalesce(c.n, 0) n_children, leaves n_leaves,
  saved::bigint saved_tokens, t.ends ends_sha256
from placed t join below using (node) left join children c on c.up = t.node
left join nodes p on t.depth > 0 and p.node = t.up
"""
