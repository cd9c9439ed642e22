"""SQL of the queries that SQL can express."""

_REACH = """
reach as (select node, node as c from nodes union select l.b, r.c from reach r join both_ways l on l.a = r.node),
least as (select node, min(c) as component_id from reach group by node)"""

SQL: dict[str, str] = {
    "op2_ngram_jaccard": f"""
with recursive words as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
shingles as materialized (
  select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) end) as g from words),
sizes as (select doc_id, count(g) as n from words left join shingles using (doc_id) group by doc_id),
links as materialized (
  select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as common from shingles x join shingles y using (g)
    where x.doc_id < y.doc_id group by all) join sizes p on p.doc_id = a join sizes q on q.doc_id = b
  where 100 * common >= 75 * (p.n + q.n - common)),
both_ways as (select a, b from links union all select b, a from links),
nodes as (select doc_id as node from documents),{_REACH}
select doc_id, n as n_shingles, component_id from sizes join least on node = doc_id""",
    "op10_embedding_dedup": f"""
with recursive vectors as materialized (
  select vec_id, label, embedding::double[] as v, sqrt(list_inner_product(embedding::double[], embedding::double[])) as size
  from embeddings),
links as materialized (
  select x.vec_id as a, y.vec_id as b from vectors x join vectors y on x.label = y.label and x.vec_id < y.vec_id
  where list_inner_product(x.v, y.v) / (x.size * y.size) >= 0.98),
both_ways as (select a, b from links union all select b, a from links),
nodes as (select vec_id as node from embeddings),{_REACH}
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept
from embeddings join least on node = vec_id left join (select a, count(*) as n_links from both_ways group by a) on a = vec_id""",
    "op12_exact_dedup": """
with plain as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
  from documents)
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size, doc_id = max(doc_id) over same as kept,
  text_sha256 from plain window same as (partition by text_sha256)""",
    "op13_spelling_variants": """
with recursive crc_table as (
  select list(c order by i) as t from (
    select i, list_reduce(list_prepend(i::ubigint, list_transform(range(8), lambda x: x::ubigint)),
      lambda c, k: case when c % 2 = 1 then xor(3988292384::ubigint, c >> 1) else c >> 1 end) as c
    from (select unnest(range(256)) as i))),
runs as (
  select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]{7,}')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
counted as (select doc_id, run, count(*) as n from runs group by all),
hashed as (
  select run, n, xor(4294967295::ubigint, list_reduce(list_prepend(4294967295::ubigint,
      flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x: case when unicode(x) < 128 then [unicode(x)::ubigint]
        else [(192 + (unicode(x) >> 6))::ubigint, (128 + (unicode(x) & 63))::ubigint] end))),
      lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::bigint]))) as h from counted, crc_table),
words as materialized (
  select word, sum(n)::bigint as n from (
    select n, case when h % 31 = 0 then left(run, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2)
      else run end as word from hashed)
  where length(word) >= 7 group by word having sum(n) >= 2),
-- A replacement leaves the same rest at the same place; a deletion leaves the other word.
shorter as (
  select word, n, unnest(range(1, length(word) + 1)) as i, left(word, i - 1) || substr(word, i + 1) as part from words),
pairs as (
  select a.word, b.word as other from shorter a join shorter b on a.i = b.i and a.part = b.part and a.word <> b.word
  union select s.word, w.word from shorter s join words w on w.word = s.part
  union select w.word, s.word from shorter s join words w on w.word = s.part),
near as (select p.word, p.other, w.n as other_n from pairs p join words w on w.word = p.other),
best as (
  select word, count(*) as n_near, max(other_n) as most, min_by(other, (-other_n, other)) as first from near group by word),
forms as materialized (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when most >= 10 * w.n then first end as form,
    case when most >= 10 * w.n then most end as form_n from words w left join best b on b.word = w.word),
steps as (
  select word, word as at, form as next from forms
  union all select s.word, f.word, f.form from steps s join forms f on f.word = s.next)
select f.word, f.form, s.at as root, f.n, f.n_near, f.form_n from forms f join steps s on s.word = f.word where s.next is null""",
}
