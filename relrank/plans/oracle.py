"""SQL twins of the catalog's queries, as one SELECT per query over shared common table expressions."""

from __future__ import annotations

import re

from relrank import schema as S

# Same character classes as in functions/text.py, in the other engine's spelling.
WS = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]+"
NWS = r"[^\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]+"
WORD2 = r"[\p{L}\p{N}_]{2,}"
BREAK = r"\r\n|[\n\x{0B}\f\r\x{1C}\x{1D}\x{1E}\x{85}\x{2028}\x{2029}]"


def collapse(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{WS}', ' ', 'g'))"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}|{WS}$', '', 'g')"


def blank(c: str) -> str:
    return f"not coalesce(regexp_matches(cast({c} as varchar), '{NWS}'), false)"


def words(c: str) -> str:
    return f"regexp_extract_all(lower(coalesce({c}, '')), '{WORD}')"


def tokens(c: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({c}, '')), '{WS}'), lambda t: t <> '')"


def word_count(c: str) -> str:
    return f"len(regexp_extract_all(coalesce({c}, ''), '{NWS}+'))"


def char_count(c: str) -> str:
    return "length(" + strip(f"coalesce({c}, '')") + ")"


def grams(c: str) -> str:
    w = f"regexp_extract_all(lower(coalesce({c}, '')), '{WORD2}')"
    pairs = f"list_transform(range(1, len({w})), lambda i: ({w})[i] || ' ' || ({w})[i + 1])"
    return f"list_concat({w}, {pairs})"


def char_grams(c: str) -> str:
    return (
        f"case when length({c}) >= 3 then list_distinct(list_transform(range(1, length({c}) - 1), "
        f"lambda i: substr({c}, i, 3))) else cast([] as varchar[]) end"
    )


def jaccard(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    return (
        f"case when len({a}) > 0 and len({b}) > 0 then "
        f"{shared}::double / (len({a}) + len({b}) - {shared}) else 0.0::double end"
    )


def depth(c: str) -> str:
    t = strip(f"coalesce({c}, '')")
    cases = " ".join(
        f"when contains({t}, '{d}') then len(list_filter(string_split({t}, '{d}'), "
        f"lambda p: trim(p) <> ''))::double"
        for d in (" > ", ">", " / ", "/", "|")
    )
    return f"case when {t} = '' then 0.0::double {cases} else 1.0::double end"


def top_level(c: str) -> str:
    t = strip(f"coalesce({c}, '')")
    cases = " ".join(
        f"when contains({t}, '{d}') then trim(string_split({t}, '{d}')[1])"
        for d in (" > ", " / ", "/", ">", "|")
    )
    return f"coalesce(nullif(case {cases} else {t} end, ''), 'Unknown')"


def primary(c: str) -> str:
    return f"trim(trim(string_split(coalesce({c}, 'Unknown'), '/')[1], '[]''\" '))"


def finite(c: str) -> str:
    n = f"try_cast({c} as double)"
    return f"case when {n} is null or isnan({n}) or isinf({n}) then 0.0::double else {n} end"


def exact_ratio(a: str, b: str) -> str:
    return f"case when ({b}) = 0 then 0.0::double else ({a})::double / ({b}) end"


# Shared tables ------------------------------------------------------------------------

CTE: dict[str, str] = {}

CTE["raw_queries"] = """
select s_suppkey as query_id,
  case when s_suppkey % 3 = 0 then p_name when s_suppkey % 3 = 1 then p_name || ' ' || p_type
    else p_name || ' ' || p_type || ' for home or office' end as query,
  case when s_suppkey % 17 <> 0 then p_type end as query_class
from supplier join part on p_partkey = s_suppkey"""

CTE["sales"] = """
select l_partkey, count(*)::double as n_lines, avg(l_quantity) / 10::double as mean_quantity,
  count(distinct l_orderkey)::double as n_orders
from lineitem group by l_partkey"""

CTE["raw_products"] = """
select p_partkey as product_id,
  case when p_partkey % 5 = 0 then p_name else p_name || ' ' || p_type || ' ' || p_brand end as product_name,
  case when p_partkey % 19 <> 0 then p_type end as product_class,
  case p_partkey % 6 when 0 then p_brand || ' > ' || p_type || ' > ' || p_name
    when 1 then p_brand || ' / ' || p_type || ' / ' || p_name
    when 2 then p_brand || '/' || p_type when 3 then p_brand || '|' || p_type
    when 4 then p_type end as category_hierarchy,
  text as product_description,
  case when p_partkey % 7 = 0 then '' else 'size:' || p_size || chr(10) || 'brand:' || p_brand
    || chr(10) || 'type:' || p_type end as product_features,
  case when p_partkey % 11 <> 0 then n_lines end as rating_count,
  case when p_partkey % 11 <> 0 then mean_quantity end as average_rating,
  case when p_partkey % 11 <> 0 then n_orders end as review_count
from part left join sales on p_partkey = l_partkey
left join documents on doc_id = p_partkey % (select count(*) from documents)"""

CTE["raw_labels"] = """
select l_orderkey * 10 + l_linenumber as id, l_suppkey as query_id, l_partkey as product_id,
  case l_returnflag when 'A' then 'Exact' when 'N' then 'Partial' when 'R' then 'Irrelevant' end as label
from lineitem"""

CTE["queries"] = f"""
select query_id, {collapse('query')} as query, nullif({collapse('query_class')}, '') as query_class
from raw_queries"""

CTE["products"] = "select product_id, " + ", ".join(
    f"{collapse(c)} as {c}" for c in S.PRODUCT_COLUMNS[1:6]
) + ", rating_count, average_rating, review_count from raw_products"

CTE["label_counts"] = """
select query_id, product_id, count(*) as annotation_count,
  count(*) filter (label = 'Exact') as e, count(*) filter (label = 'Partial') as p,
  count(*) filter (label = 'Irrelevant') as i
from raw_labels where query_id is not null and product_id is not null group by all"""

CTE["resolved"] = """
select query_id, product_id,
  case when i = greatest(e, p, i) then 'Irrelevant' when p = greatest(e, p, i) then 'Partial'
    else 'Exact' end as label,
  annotation_count,
  concat_ws('|', case when e > 0 then 'Exact' end, case when i > 0 then 'Irrelevant' end,
    case when p > 0 then 'Partial' end) as original_labels,
  case when (e > 0)::int + (p > 0)::int + (i > 0)::int = 1 then 'agreement'
    when (e = greatest(e, p, i))::int + (p = greatest(e, p, i))::int + (i = greatest(e, p, i))::int = 1
    then 'majority_vote' else 'majority_tie_conservative' end as resolution_method,
  case when i = greatest(e, p, i) then 0 when p = greatest(e, p, i) then 1 else 2 end as relevance_score
from label_counts"""

CTE["judgments"] = "select query_id, product_id, relevance_score from resolved"

CTE["assignment"] = """
select query_id, case when r <= ceil(round(0.5 * ceil(round(0.3 * n, 6)), 6)) then 'test'
  when r <= ceil(round(0.3 * n, 6)) then 'validation' else 'train' end as split
from (select query_id, row_number() over (order by md5('42|' || query_id), query_id) as r,
  count(*) over () as n from (select distinct query_id from raw_labels))"""

CTE["judged"] = "select j.*, a.split from judgments j join assignment a using (query_id)"

CTE["corpus"] = """
select product_id, product_name from products
where product_id in (select product_id from judged where split = 'train')"""

CTE["bm25_stats"] = f"""
select count(*) as n, sum(len({tokens('product_name')}))::double / count(*) as avgdl from corpus"""

CTE["idf"] = f"""
select term, count(*) as df,
  ln(1 + ((select n from bm25_stats) - count(*) + 0.5::double) / (count(*) + 0.5::double)) as idf
from (select unnest(list_distinct({tokens('product_name')})) as term from corpus) group by term"""

CTE["query_terms"] = f"""
select query_id, term, count(*) as times
from (select query_id, unnest({tokens('query')}) as term from queries) group by all"""

CTE["document_terms"] = f"""
select product_id, dl, term, count(*)::double as f from
(select product_id, len({tokens('product_name')}) as dl, unnest({tokens('product_name')}) as term from products)
group by all"""

CTE["bm25"] = """
select j.query_id, j.product_id, round(coalesce(s.s, 0.0::double), 9) as bm25_score from judgments j left join (
  select j.query_id, j.product_id,
    sum(q.times * i.idf * d.f * 2.5::double
      / (d.f + 1.5::double * (0.25::double + 0.75::double * d.dl / (select avgdl from bm25_stats)))) as s
  from judgments j join query_terms q using (query_id) join idf i using (term)
  join document_terms d on d.product_id = j.product_id and d.term = q.term group by all) s
on s.query_id = j.query_id and s.product_id = j.product_id"""

CTE["vocab"] = f"""
select term, count(distinct product_id) as df, count(*) as corpus_count,
  ln((1 + (select count(*) from corpus))::double / (1 + count(distinct product_id))) + 1 as idf
from (select product_id, unnest({grams('product_name')}) as term from corpus) group by term
having count(distinct product_id) <= 0.95::double * (select count(*) from corpus)
order by corpus_count desc, term limit 200000"""


def _tfidf(table: str, key: str, column: str) -> str:
    return f"""
select {key}, term, w / sqrt(sum(w * w) over (partition by {key})) as w from (
  select {key}, term, (1 + ln(count(*)::double)) * any_value(idf) as w
  from (select {key}, unnest({grams(column)}) as term from {table}) join vocab using (term)
  group by {key}, term)"""


CTE["tfidf_q"] = _tfidf("queries", "query_id", "query")
CTE["tfidf_p"] = _tfidf("products", "product_id", "product_name")

CTE["tfidf"] = """
select j.query_id, j.product_id, round(coalesce(s.s, 0.0::double), 9) as tfidf_similarity
from judgments j left join (
  select j.query_id, j.product_id, sum(q.w * p.w) as s from judgments j
  join tfidf_q q using (query_id) join tfidf_p p on p.product_id = j.product_id and p.term = q.term
  group by all) s on s.query_id = j.query_id and s.product_id = j.product_id"""

CTE["query_vectors"] = """
select s_suppkey as query_id, embedding::double[] as v from supplier
join embeddings on vec_id = (s_suppkey * 7) % (select count(*) from embeddings)"""

CTE["product_vectors"] = """
select p_partkey as product_id, embedding::double[] as v from part
join embeddings on vec_id = p_partkey % (select count(*) from embeddings)"""

CTE["semantic"] = """
select query_id, product_id,
  round(case when qn * pn = 0 then 0 else list_inner_product(qv, pv) / (qn * pn) end, 9) as semantic_similarity,
  qn as query_embedding_norm, pn as product_embedding_norm
from (select j.query_id, j.product_id, q.v as qv, p.v as pv,
  sqrt(list_inner_product(q.v, q.v)) as qn, sqrt(list_inner_product(p.v, p.v)) as pn
  from judgments j join query_vectors q using (query_id) join product_vectors p using (product_id))"""

CTE["query_side"] = f"""
select query_id, q_fold, list_distinct({words('q_fold')}) as q_words, {char_grams('q_fold')} as q_grams
from (select query_id, lower({collapse('query')}) as q_fold from queries)"""


def _product_side(table: str) -> str:
    return f"""
select product_id, p_fold, list_distinct({words('p_fold')}) as p_words, {char_grams('p_fold')} as p_grams,
  list_distinct({words('category_hierarchy')}) as path_words,
  list_distinct({words('product_class')}) as class_words,
  len({words('product_name')})::double as title_length,
  len({words('product_description')})::double as description_length,
  (case when n_lines > 1 then n_lines else len({words('product_features')}) end)::double as feature_count,
  {depth('category_hierarchy')} as category_depth,
  {finite('average_rating')} as average_rating, {finite('rating_count')} as rating_count,
  {finite('review_count')} as review_count
from (select *, lower({collapse('product_name')}) as p_fold,
  len(list_filter(string_split_regex(coalesce(product_features, ''), '{BREAK}'), lambda t: trim(t) <> '')) as n_lines
  from {table})"""


CTE["product_side"] = _product_side("products")
CTE["raw_product_side"] = _product_side("raw_products")

COMPARED = {
    "exact_match": "(q_fold <> '' and p_fold <> '' and q_fold = p_fold)::int::double",
    "token_overlap": jaccard("q_words", "p_words"),
    "character_overlap": (
        "case when q_fold = '' or p_fold = '' then 0.0::double when length(q_fold) < 3 or length(p_fold) < 3 "
        f"then (q_fold = p_fold)::int::double else {jaccard('q_grams', 'p_grams')} end"
    ),
    "query_title_overlap": "len(list_intersect(q_words, p_words))::double",
    "category_match": exact_ratio("len(list_intersect(q_words, path_words))", "len(q_words)"),
    "product_class_match": "(len(list_intersect(q_words, class_words)) > 0)::int::double",
    "phrase_match": "(q_fold <> '' and p_fold <> '' and contains(p_fold, q_fold))::int::double",
}
PASSED = [*S.TEXT_FEATURES, *S.METADATA_FEATURES]


def _features(side: str, names: list[str]) -> str:
    columns = ", ".join(f"{COMPARED.get(n, n)} as {n}" for n in names)
    return (
        f"select j.query_id, j.product_id, {columns} from judgments j "
        f"join query_side using (query_id) join {side} using (product_id)"
    )


CTE["compared"] = _features("product_side", [*COMPARED, *PASSED])

CTE["matrix"] = """
select c.query_id, c.product_id, j.relevance_score, b.bm25_score, t.tfidf_similarity,
  c.* exclude (query_id, product_id), s.semantic_similarity, s.query_embedding_norm, s.product_embedding_norm
from compared c join judgments j using (query_id, product_id) join bm25 b using (query_id, product_id)
join tfidf t using (query_id, product_id) join semantic s using (query_id, product_id)"""



def blended(prefix: str = "", weights: tuple[int, ...] = (1, 10, 10, 10)) -> str:
    """The blend in whole units of its tenth digit, rounded to nine; weights in tenths."""
    units = {c: f"round({prefix}{c} * 1e9)::bigint" for c in ("bm25_score", "tfidf_similarity", "token_overlap", "semantic_similarity")}
    total = " + ".join(f"{weight} * {units[c]}" for c, weight in zip(units, weights))
    return f"round(({total})::double / 1e1) / 1e9"


CTE["scored"] = f"""
select m.query_id, m.product_id, m.relevance_score, m.exact_match, p.category_hierarchy, m.bm25_score,
  m.tfidf_similarity as tfidf_score, m.semantic_similarity as semantic_score,
  {blended('m.')} as blend_score
from (select c.query_id, c.product_id, j.relevance_score, b.bm25_score, t.tfidf_similarity, c.exact_match,
  c.token_overlap, s.semantic_similarity from compared c join judgments j using (query_id, product_id)
  join bm25 b using (query_id, product_id) join tfidf t using (query_id, product_id)
  join semantic s using (query_id, product_id)) m join products p using (product_id)"""

CTE["long_scores"] = " union all ".join(
    f"select '{m}' as model, query_id, product_id, relevance_score, category_hierarchy, {m}_score as score from scored"
    for m in ("tfidf", "bm25", "semantic", "blend")
)

CTE["retrieved"] = """
select model, query_id, product_id, relevance_score, score, row_number() over (partition by model, query_id
  order by score desc, case when model in ('bm25', 'semantic') then product_id::varchar end, product_id) as rank
from long_scores"""

CTE["bm25_ranked"] = """
select query_id, product_id, relevance_score, bm25_score as score,
  row_number() over (partition by query_id order by bm25_score desc, product_id::varchar) as rank
from bm25 join judgments using (query_id, product_id)"""

CTE["model_ranked"] = "select *, " + ", ".join(
    f"row_number() over (partition by query_id order by {m}_score desc, product_id) as {m}_rank"
    for m in ("tfidf", "bm25", "semantic", "blend")
) + " from scored"

CTE["requests"] = """
select o_orderkey as request_id, o_orderdate as ts, query_id, query, [null, 0, 1, 3, 1000, null, 2][o_orderkey % 7 + 1]::int as top_k from orders
left join raw_queries on query_id = o_custkey % (select count(*) from supplier)"""

CTE["candidates"] = """
select l_orderkey as request_id, ts, query_id, query, top_k, l_linenumber as position, p.* from lineitem
join requests on request_id = l_orderkey left join raw_products p on product_id = l_partkey"""

CTE["log"] = """
select event_id as request_id, ts, user_id || ':' || event_type as request_key, value as latency_ms,
  case event_type when 'error' then 500 when 'signup' then 400 else 200 end as status
from events"""


def assemble(body: str) -> str:
    """Prepends the common table expressions a query needs, in order."""
    need: list[str] = []
    open_names: set[str] = set()

    def visit(sql: str) -> None:
        for name in CTE:
            if name in need or name in open_names:
                continue
            if re.search(rf"(?<![\w.']){name}(?![\w'])", sql):
                open_names.add(name)
                visit(CTE[name])
                need.append(name)

    visit(body)
    if not need:
        return body
    parts = ", ".join(
        f"{name} as {'' if name == 'chain' else 'materialized'} ({CTE[name]})" for name in need
    )
    return f"with {'recursive ' if 'chain' in need else ''}{parts} {body}"


# Metrics ------------------------------------------------------------------------------


def metric_sql(ranked: str, family: str, ks: list[int], depth_: int, keys: list[str], truth: str = "judgments") -> str:
    """Per-group metrics as a SELECT; `ranked` has keys, rank and relevance_score."""
    key = ", ".join(keys)
    fixed = 10 if family == "retrieved" or len(ks) > 1 else ks[0]
    k_list = f"(select {key}, rank, relevance_score as g from {ranked} where rank <= {depth_})"
    truth_total = f"(select query_id, count(*) filter (relevance_score > 0) as total from {truth} group by query_id)"
    columns = []
    joins = []
    for k in sorted(set(ks)):
        if family == "candidates":
            joins.append(
                f"join (select query_id, sum((pow(2, g) - 1) / log2(i + 1)) as ideal_{k} from (select query_id, "
                f"relevance_score as g, row_number() over (partition by query_id order by relevance_score desc) as i "
                f"from {truth}) where i <= {k} group by query_id) i{k} on i{k}.query_id = a.query_id"
            )
        else:
            same = " and ".join(f"i{k}.{c} = a.{c}" for c in keys)
            joins.append(
                f"join (select {key}, sum((pow(2, g) - 1) / log2(i + 1)) as ideal_{k} from (select {key}, g, "
                f"row_number() over (partition by {key} order by g desc) as i from {k_list} where rank <= {k}) "
                f"group by {key}) i{k} on {same}"
            )
        columns.append(exact_ratio(f"a.hits_{k}", "total") + f" as recall_at_{k}")
        columns.append(exact_ratio(f"a.dcg_{k}", f"ideal_{k}") + f" as ndcg_at_{k}")
    inner = ", ".join(
        f"count(*) filter (rank <= {k} and g > 0) as hits_{k}, "
        f"sum(case when rank <= {k} then (pow(2, g) - 1) / log2(rank + 1) else 0 end) as dcg_{k}"
        for k in sorted(set(ks))
    )
    base = f"""select {key}, {inner}, count(*) filter (g > 0) as listed,
      count(*) filter (g > 0 and rank <= {fixed}) as top_relevant,
      min(rank) filter (g > 0 and rank <= {fixed}) as first_hit,
      coalesce(sum(seen::double / rank) filter (g > 0 and rank <= {fixed}), 0) as precisions
      from (select *, sum((g > 0)::int) over (partition by {key} order by rank) as seen from {k_list}) group by {key}"""
    if family == "list":
        total, ap = "a.listed", "a.top_relevant"
        source = f"({base}) a"
    else:
        total, ap = "t.total", f"least(t.total, {fixed})"
        source = f"({base}) a join {truth_total} t on t.query_id = a.query_id"
    columns = [c.replace("total", total) for c in columns]
    named = ", ".join(f"a.{c} as {c}" for c in keys)
    return (
        f"select {named}, {', '.join(columns)}, coalesce(1.0::double / first_hit, 0.0::double) as mrr_at_10, "
        f"{exact_ratio('precisions', ap)} as map_at_10 from {source} {' '.join(joins)}"
    )


def metric_names(ks: list[int]) -> list[str]:
    return [f"{m}_at_{k}" for k in ks for m in ("recall", "ndcg")] + ["mrr_at_10", "map_at_10"]


def per_query(sql: str, ks: list[int], keys: list[str]) -> str:
    rounded = ", ".join(f"round({c}, 6) as {c}" for c in metric_names(ks))
    return f"select {', '.join(keys)}, {rounded} from ({sql})"


def averaged(sql: str, ks: list[int], by: list[str]) -> str:
    rounded = ", ".join(f"round(avg({c}), 6) as {c}" for c in metric_names(ks))
    keys = "".join(f"{b}, " for b in by)
    group = f" group by {', '.join(by)}" if by else ""
    return f"select {keys}count(*) as queries_evaluated, {rounded} from ({sql}){group}"


def compare_sql(models: list[str], family: str, ks: list[int], depth_: int) -> str:
    names = ", ".join(f"'{m}'" for m in models)
    ranked = f"(select * from retrieved where model in ({names}))"
    return averaged(metric_sql(ranked, family, ks, depth_, ["model", "query_id"]), ks, ["model"])


MODELS = ["tfidf", "bm25", "semantic", "blend"]


def list_ndcg(keys: list[str], rows: str = "long_scores", models: list[str] = MODELS) -> str:
    k = ", ".join(keys)
    ranked = (
        f"(select model, {k}, relevance_score, row_number() over (partition by model, {k} "
        f"order by score desc, product_id) as rank from {rows})"
    )
    per_model = metric_sql(ranked, "list", [10], 10, ["model", *keys])
    columns = ", ".join(
        f"round(max(ndcg_at_10) filter (model = '{m}'), 12) as {m}_ndcg" for m in models
    )
    return f"select {k}, {columns} from ({per_model}) group by {k}"


CTE["query_ndcg"] = list_ndcg(["query_id"])

CTE["per_query_report"] = f"""
select c.query_id, query, len({tokens('query')})::int as query_length_tokens,
  case when len({tokens('query')}) <= 2 then 'short' when len({tokens('query')}) <= 5 then 'medium'
    else 'long' end as query_length_bucket,
  case when any_exact > 0 then 'exact_product_match' when len({tokens('query')}) <= 2 then 'short'
    when len({tokens('query')}) >= 6 then 'long' else 'general' end as query_type,
  candidate_count, relevant_count, exact_count, partial_count, tfidf_ndcg, bm25_ndcg, semantic_ndcg, blend_ndcg,
  blend_ndcg - tfidf_ndcg as blend_minus_tfidf, blend_ndcg - bm25_ndcg as blend_minus_bm25,
  blend_ndcg - semantic_ndcg as blend_minus_semantic,
  case when blend_ndcg - bm25_ndcg > 1e-12 then 'blend_better'
    when blend_ndcg - bm25_ndcg < -1e-12 then 'bm25_better' else 'tie' end as relation
from (select query_id, count(*) as candidate_count, count(*) filter (relevance_score > 0) as relevant_count,
  count(*) filter (relevance_score = 2) as exact_count, count(*) filter (relevance_score = 1) as partial_count,
  max(exact_match) as any_exact from scored group by query_id) c
join query_ndcg n on n.query_id = c.query_id join queries q on q.query_id = c.query_id"""

CTE["categorized"] = f"""
select model, query_id, product_id, relevance_score, score, {top_level('category_hierarchy')} as category
from long_scores"""

CTE["failures"] = """
select case when blend_rank <= 10 then 'irrelevant_in_top10' else 'relevant_below_top10' end as failure_type,
  query_id, query, product_id, relevance_score, blend_rank, blend_score,
  bm25_rank, tfidf_rank
from model_ranked join queries using (query_id)
where (blend_rank <= 10 and relevance_score = 0) or (blend_rank > 10 and relevance_score > 0)"""

CTE["ambiguous"] = f"""
select query_id, query, n::int as relevant_category_count, names as relevant_categories, candidate_count,
  relevant_count, bm25_ndcg, blend_ndcg, blend_minus_bm25
from per_query_report join (select query_id, count(*) as n, string_agg(category, ' | ' order by category) as names
  from (select distinct query_id, {top_level('category_hierarchy')} as category from scored where relevance_score > 0)
  group by query_id having count(*) >= 2) using (query_id)"""


def rounded_report(table: str, columns: list[str], tail: str = "") -> str:
    out = ", ".join(
        f"round({c}, 6) as {c}" if c.endswith("_ndcg") or "_minus_" in c else c for c in columns
    )
    return f"select {out} from {table} {tail}"


REPORT_COLUMNS = (
    "query_id query query_length_tokens query_length_bucket query_type candidate_count relevant_count exact_count "
    "partial_count tfidf_ndcg bm25_ndcg semantic_ndcg blend_ndcg blend_minus_tfidf blend_minus_bm25 "
    "blend_minus_semantic relation"
).split()


def means_by(column: str) -> str:
    names = [*[f"{m}_ndcg" for m in MODELS], "blend_minus_bm25"]
    cols = ", ".join(f"round(avg({c}), 6) as {c}" for c in names)
    return f"select {column}, count(*) as queries, {cols} from per_query_report group by {column}"


# Quality ------------------------------------------------------------------------------


def listed(table: str, columns: list[str], test) -> str:
    parts = ", ".join(
        f"case when count(*) filter ({test(c)}) > 0 then '{c}=' || count(*) filter ({test(c)}) end"
        for c in sorted(columns)
    )
    total = " + ".join(f"count(*) filter ({test(c)})" for c in columns)
    return f"{total} as v, concat_ws(', ', {parts}) as d from {table}"


def check(name: str, source: str, bad: str = "FAIL") -> str:
    return (
        f"select '{name}' as \"check\", case when v > 0 then '{bad}' else 'PASS' end as status, "
        f"v::bigint as violations, d as detail from (select {source})"
    )


def _checks() -> str:
    null = lambda c: f"{c} is null"
    tables = {"query": "raw_queries", "product": "raw_products", "label": "raw_labels"}
    required = {
        "query": ["query_id", "query"],
        "product": ["product_id", "product_name"],
        "label": S.LABEL_COLUMNS,
    }
    out = []
    for name, table in tables.items():
        out.append(check(f"{name}_required_columns", "0 as v, '' as d"))
        out.append(
            check(f"{name}_not_empty", f"(count(*) = 0)::int as v, count(*)::varchar as d from {table}")
        )
        out.append(check(f"{name}_required_values", listed(table, required[name], blank)))

    def unique(column: str, table: str) -> str:
        return (
            f"coalesce(sum(n), 0) as v, '' as d from (select count(*) as n from {table} "
            f"group by {column} having count(*) > 1)"
        )

    out += [
        check("query_query_id_unique", unique("query_id", "raw_queries")),
        check("query_query_not_empty", f"count(*) filter ({blank('query')}) as v, '' as d from raw_queries"),
        check(
            "query_query_class_missing",
            "count(*) filter (query_class is null) as v, '' as d from raw_queries",
            "WARN",
        ),
        check("product_product_id_unique", unique("product_id", "raw_products")),
        check(
            "product_product_name_not_empty",
            f"count(*) filter ({blank('product_name')}) as v, '' as d from raw_products",
        ),
        check(
            "product_optional_missing_values",
            listed("raw_products", S.PRODUCT_COLUMNS[2:], null),
            "WARN",
        ),
        check(
            "labels_valid",
            "count(*) as v, case when count(*) > 0 then 'values=' || count(distinct label) else '' end as d "
            "from raw_labels where coalesce(label not in ('Exact', 'Partial', 'Irrelevant'), true)",
        ),
        check("judgment_id_unique", unique("id", "raw_labels")),
        check(
            "query_product_pair_unique",
            "coalesce(sum(n), 0) as v, case when count(*) > 0 then 'pairs=' || count(*) else '' end as d from "
            "(select count(*) as n from raw_labels group by query_id, product_id having count(*) > 1)",
            "WARN",
        ),
        check(
            "query_product_pair_label_consistency",
            "count(*) filter (labels > 1) as v, '' as d from (select count(distinct label) as labels "
            "from raw_labels group by query_id, product_id having count(*) > 1)",
        ),
    ]
    for key, parent in (("query_id", "raw_queries"), ("product_id", "raw_products")):
        out.append(
            check(
                f"foreign_key_label_{key}",
                f"count(distinct {key}) as v, '' as d from raw_labels where {key} not in (select {key} from {parent})",
            )
        )
    return " union all ".join(out)


CTE["checks"] = _checks()


def status_rows(source: str) -> str:
    return (
        "select \"check\", violations, case when violations = 0 then 'PASS' else 'FAIL' end as status "
        f"from ({source})"
    )


def describe(source: str) -> str:
    """`source` yields metric and value."""
    return f"""select metric, count(v) as count, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std,
  min(v) as min, max(v) as max, round(quantile_cont(v, 0.25), 6) as p25, round(quantile_cont(v, 0.5), 6) as p50,
  round(quantile_cont(v, 0.75), 6) as p75 from (select metric, value::double as v from ({source})) group by metric"""


def lengths() -> str:
    out = [
        f"select 'query_word_count' as metric, {word_count('query')} as value from raw_queries",
        f"select 'query_char_count', {char_count('query')} from raw_queries",
    ]
    for c in ("product_name", "product_description", "product_features", "category_hierarchy"):
        out.append(f"select '{c}_word_count', {word_count(c)} from raw_products")
        out.append(f"select '{c}_char_count', {char_count(c)} from raw_products")
    return " union all ".join(out)


RATINGS = " union all ".join(
    f"select '{c}' as metric, {c} as value from raw_products"
    for c in ("average_rating", "rating_count", "review_count")
)

PER_QUERY = """select 'judgments_per_query' as metric, count(*) as value from raw_labels group by query_id
union all select 'products_per_query', count(distinct product_id) from raw_labels group by query_id"""


def histogram(source: str, bins: int) -> str:
    return f"""select metric, bin::int as bin, round(lo + bin * ((hi - lo) / {bins}::double), 6) as lower, count(*) as count
from (select metric, lo, hi, least(coalesce(floor((v - lo) / nullif((hi - lo) / {bins}::double, 0)), 0), {bins - 1}) as bin
  from (select metric, value::double as v, min(value::double) over (partition by metric) as lo,
    max(value::double) over (partition by metric) as hi from ({source}) where value is not null))
group by metric, bin, lo, hi"""


def unique_row(table: str, label: str, column: str) -> str:
    return (
        f"select '{label}' as table_name, '{column}' as column_name, count(*) as row_count, "
        f"count(distinct {column}) as unique_values, "
        f"count(*) - count(distinct {column}) - (count(*) > count({column}))::int as duplicates from {table}"
    )


def schema_rows(label: str, table: str, columns: dict[str, str]) -> str:
    return " union all ".join(
        f"select '{label}' as table_name, '{c}' as column_name, '{kind}' as dtype, "
        f"count(*) - count({c}) as missing, "
        f"round(100.0::double * ((count(*) - count({c}))::double / count(*)), 2) as missing_pct from {table}"
        for c, kind in columns.items()
    )


PRODUCT_TYPES = dict(
    zip(S.PRODUCT_COLUMNS, ["bigint", *["string"] * 5, "double", "double", "double"])
)

COMPACT = f"""
select 'product_rows' as name, count(*)::double as value from raw_products
union all select 'product_columns', 9 union all select 'query_columns', 3
union all select 'unique_products', count(distinct product_id) from raw_products
union all select 'duplicate_product_ids', count(*) - count(distinct product_id) from raw_products
union all select 'query_rows', count(*) from raw_queries
union all select 'unique_queries', count(distinct query_id) from raw_queries
union all select 'duplicate_query_ids', count(*) - count(distinct query_id) from raw_queries
union all select 'duplicate_query_text', count(*) - count(distinct query) from raw_queries
union all select 'label_rows', count(*) from raw_labels
union all select 'unique_judgments', count(distinct id) from raw_labels
union all select 'duplicate_judgment_ids', count(*) - count(distinct id) from raw_labels
union all select 'duplicate_query_product_pairs', (select count(*) from raw_labels) - count(*)
  from (select distinct query_id, product_id from raw_labels)
union all select 'unknown_product_references', count(*) from raw_labels
  where product_id not in (select product_id from raw_products)
union all select 'unknown_query_references', count(*) from raw_labels
  where query_id not in (select query_id from raw_queries)
union all select 'query_word_mean', round(avg({word_count('query')}), 6) from raw_queries
union all select 'query_word_median', round(quantile_cont({word_count('query')}::double, 0.5), 6) from raw_queries
union all select metric || '_mean', round(avg(value), 6) from ({PER_QUERY}) group by metric
union all select metric || '_median', round(quantile_cont(value::double, 0.5), 6) from ({PER_QUERY}) group by metric"""


# Requests -----------------------------------------------------------------------------

CTE["asked"] = "select distinct query from candidates"
CTE["asked_terms"] = f"""
select query, term, count(*) as times from (select query, unnest({tokens('query')}) as term from asked) group by all"""
CTE["asked_tfidf"] = f"""
select query, term, w / sqrt(sum(w * w) over (partition by query)) as w from (
  select query, term, (1 + ln(count(*)::double)) * any_value(idf) as w
  from (select query, unnest({grams('query')}) as term from asked) join vocab using (term) group by query, term)"""
CTE["asked_pairs"] = "select distinct query, product_id from candidates"
CTE["asked_bm25"] = """
select a.query, a.product_id, round(coalesce(sum(q.times * i.idf * d.f * 2.5::double
  / (d.f + 1.5::double * (0.25::double + 0.75::double * d.dl / (select avgdl from bm25_stats)))), 0.0::double), 9) as bm25_score
from asked_pairs a left join (asked_terms q join idf i using (term)) on q.query = a.query
left join document_terms d on d.product_id = a.product_id and d.term = q.term group by all"""
CTE["asked_cosine"] = """
select a.query, a.product_id, round(coalesce(sum(q.w * p.w), 0.0::double), 9) as tfidf_similarity
from asked_pairs a left join asked_tfidf q on q.query = a.query
left join tfidf_p p on p.product_id = a.product_id and p.term = q.term group by all"""
CTE["asked_side"] = CTE["query_side"].replace("query_id", "query").replace("from queries", "from asked")
CTE["request_matrix"] = (
    "select c.request_id, c.query, c.top_k, c.product_id, c.position, raw.product_name, b.bm25_score, t.tfidf_similarity, "
    + ", ".join(f"{COMPARED.get(n, 'p.' + n)} as {n}" for n in [*COMPARED, *PASSED])
    + ", case when qv.v is null or pv.v is null then 0.0::double else round(case when sqrt(list_inner_product(qv.v, qv.v)) * sqrt(list_inner_product(pv.v, pv.v)) = 0 then 0 "
    "else list_inner_product(qv.v, pv.v) / (sqrt(list_inner_product(qv.v, qv.v)) * sqrt(list_inner_product(pv.v, pv.v))) end, 9) end as semantic_similarity "
    "from candidates c join asked_side q on q.query = c.query "
    "left join query_vectors qv on qv.query_id = c.query_id left join product_vectors pv on pv.product_id = c.product_id "
    "join raw_product_side p on p.product_id = c.product_id join raw_products raw on raw.product_id = c.product_id "
    "join asked_bm25 b on b.query = c.query and b.product_id = c.product_id "
    "join asked_cosine t on t.query = c.query and t.product_id = c.product_id"
)
CTE["ranked_requests"] = f"""
select request_id, query, product_id, product_name, score, rank from (
  select *, row_number() over (partition by request_id order by score desc, product_id, position) as rank from (
    select *, {blended()} as score
    from request_matrix)) where top_k is null or rank <= top_k"""
CTE["all_ranked_requests"] = f"""
select *, row_number() over (partition by request_id order by score desc, product_id, position) as rank from (
  select *, {blended()} as score from request_matrix)"""

FRACTIONS = ("rating_count", "average_rating", "review_count")
LISTS = ("v",)


def encoded(columns: list[str]) -> str:
    """Each value after its length, nulls as n; a fraction as nine decimals and what it lacks to them; a list after its
    size."""

    def fraction(c: str) -> str:
        return f"(round({c}, 9)::decimal(38,9)::varchar || 'r' || round(({c} - round({c}, 9)) * 1e24)::decimal(38,0)::varchar)"

    def field(t: str) -> str:
        return f"coalesce(length({t}) || ':' || {t}, 'n')"

    def one(c: str) -> str:
        if c in LISTS:
            return f"coalesce('[' || len({c}) || ':' || array_to_string(list_transform({c}, lambda e: {field(fraction('e'))}), ''), 'n')"
        return field(fraction(c) if c in FRACTIONS else f"{c}::varchar")

    return " || ".join(one(c) for c in columns)


def lanes(digest: str, digits: int) -> str:
    """Sums of the eight-digit parts of a hex digest."""
    return " || ':' || ".join(
        f"coalesce(sum(('0x' || substr({digest}, {i + 1}, 8))::bigint), 0)::varchar" for i in range(0, digits, 8)
    )


CTE["request_content"] = f"select request_id, sha256({encoded(S.PRODUCT_COLUMNS)}) as h from candidates"


def print_row(name: str, table: str, columns: list[str]) -> str:
    return (
        f"select '{name}' as name, count(*) as row_count, {lanes('h', 32)} as content "
        f"from (select md5({encoded(columns)}) as h from {table})"
    )


PRINTS = {
    "queries": ("queries", S.QUERY_COLUMNS),
    "products": ("products", S.PRODUCT_COLUMNS),
    "judgments": ("resolved", ["query_id", "product_id", "label", "annotation_count", "original_labels", "resolution_method", "relevance_score"]),
    "split": ("judged", ["query_id", "product_id", "relevance_score", "split"]),
}
CTE["prints"] = " union all ".join(print_row(n, t, c) for n, (t, c) in PRINTS.items())


def _situation(name: str, stored_in: str, current_in: str, stored_out: str, current_out: str) -> str:
    """What differs between stored and current prints (selects of name, row_count, content)."""

    def both(a: str, b: str) -> str:
        return f"(select s.name, s.row_count as sn, s.content as sc, c.row_count as cn, c.content as cc from ({a}) s full join ({b}) c on s.name = c.name)"

    differ = "count(*) filter (sn is distinct from cn or sc is distinct from cc)"
    return f"""select '{name}' as situation, (select count(*) = 0 from ({stored_in}))::int as stored_missing,
      (select {differ} > 0 from {both(stored_in, current_in)})::int as inputs_differ,
      (select count(*) filter (coalesce(cn, 0) = 0) > 0 from {both(stored_out, current_out)})::int as outputs_missing,
      (select {differ} > 0 from {both(stored_out, current_out)})::int as outputs_differ"""


_IN, _OUT = "select * from prints where name <> 'split'", "select * from prints where name = 'split'"
_OTHER_IN = f"select * from prints where name not in ('split', 'queries') union all {print_row('queries', 'raw_queries', ['query_id'])}"
_OTHER_OUT = print_row("split", "judged", ["query_id", "product_id", "split"])
CTE["situations"] = " union all ".join([
    _situation("same", _IN, _IN, _OUT, _OUT),
    _situation("no_manifest", _IN + " and false", _IN, _OUT + " and false", _OUT),
    _situation("inputs_changed", _IN, _OTHER_IN, _OUT, _OUT),
    _situation("output_missing", _IN, _IN, _OUT, _OUT + " and false"),
    _situation("output_changed", _IN, _IN, _OUT, _OTHER_OUT),
])


LATENCY = """count(*) as requests, count(*) filter (status = 200) as successful,
  count(*) filter (status <> 200) as failed,
  round(100.0::double * (count(*) filter (status <> 200)::double / count(*)), 2) as error_pct,
  round(count(*) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::double, 0), 6) as throughput,
  round(avg(latency_ms) filter (status = 200), 6) as mean_ms, min(latency_ms) filter (status = 200) as min_ms,
  max(latency_ms) filter (status = 200) as max_ms,
  round(quantile_cont(latency_ms, 0.5) filter (status = 200), 6) as p50_ms,
  round(quantile_cont(latency_ms, 0.95) filter (status = 200), 6) as p95_ms,
  round(quantile_cont(latency_ms, 0.99) filter (status = 200), 6) as p99_ms from log"""


def _six(table: str, columns: list[str], keys: str = "query_id, product_id") -> str:
    return f"select {keys}, " + ", ".join(f"round({c}, 6) as {c}" for c in columns) + f" from {table}"


def _bodies() -> dict[str, str]:
    q: dict[str, str] = {}
    # sources and sinks
    # An empty text is written like a missing one.
    products = "(select * replace (nullif(product_features, '') as product_features) from raw_products)"
    q["tsv_tables"] = " union all ".join(
        print_row(name, table, columns)
        for name, table, columns in (
            ("queries", "raw_queries", S.QUERY_COLUMNS),
            ("products", products, S.PRODUCT_COLUMNS),
            ("labels", "raw_labels", S.LABEL_COLUMNS),
        )
    )
    bm25_top = "select query_id, product_id, score, rank::int as rank from bm25_ranked where rank <= 10"
    q["saved_rankings"] = bm25_top
    judged = ["query_id", "product_id", "label", "annotation_count", "original_labels", "resolution_method", "relevance_score"]
    q["saved_tables"] = " union all ".join(
        print_row(name, table, columns)
        for name, table, columns in (
            ("queries", "queries", S.QUERY_COLUMNS),
            ("products", "products", S.PRODUCT_COLUMNS),
            ("judgments", "resolved", judged),
            ("conflict_audit", "resolved where contains(original_labels, '|')", judged),
            ("product_vectors", "product_vectors", ["product_id", "v"]),
        )
    )
    q["saved_splits"] = "select split, relevance_score, count(*) as judgments from judged group by all"
    q["saved_features"] = "select count(*) as pairs, " + ", ".join(
        f"round(avg({c}), 5) as mean_{c}" for c in S.MODEL_FEATURES
    ) + " from matrix join assignment using (query_id) where split = 'test'"
    q["saved_report"] = compare_sql(MODELS, "candidates", [10], 10)
    # quality
    q["quality_checks"] = "select * from checks"
    q["quality_summary"] = """select count(*) as total_checks, count(*) filter (status = 'PASS') as passed_checks,
      count(*) filter (status = 'FAIL') as failed_checks, count(*) filter (status = 'WARN') as warning_checks,
      count(*) filter (status = 'FAIL') = 0 as valid from checks"""
    q["quality_gate"] = """select "check", violations,
      case when "check" = 'query_product_pair_label_consistency' then 'resolved_by_cleaning' else 'blocking' end as effect
      from checks where status = 'FAIL'"""
    q["fk_violations"] = """select 'product_id' as key, product_id as value from raw_products
      where product_id not in (select product_id from raw_labels)
      union all select 'query_id', query_id from raw_queries where query_id not in (select query_id from raw_labels)"""
    q["invalid_labels"] = """select l_linestatus as label, count(*) as rows from lineitem where l_returnflag <> 'A' group by all"""
    q["split_checks"] = status_rows(
        " union all ".join(
            f"select '{c}_present' as \"check\", count(*) - count({c}) as violations from judged"
            for c in ("query_id", "product_id", "relevance_score")
        )
        + "".join(
            f" union all select '{a}_{b}_disjoint', count(*) from (select query_id from judged where split = '{a}' "
            f"intersect select query_id from judged where split = '{b}')"
            for a, b in (("train", "validation"), ("train", "test"), ("validation", "test"))
        )
    )
    q["prediction_checks"] = """select model, "check", violations, case when violations = 0 then 'PASS' else 'FAIL' end as status
      from (select model, (select count(distinct query_id) from judgments) - count(distinct query_id) as a,
        0::bigint as b, count(*) - count(distinct query_id || '-' || product_id) as c, 0::bigint as d
        from retrieved where rank <= 10 group by model), lateral (values
        ('queries_without_ranking', a), ('unknown_queries', b), ('duplicate_products', c), ('unknown_products', d)
        ) as v("check", violations)"""
    broken = " + ".join(f"count(*) filter (isnan({c}) or isinf({c}))" for c in S.MODEL_FEATURES)
    nulls = " + ".join(f"count(*) - count({c})" for c in S.MODEL_FEATURES)
    q["feature_checks"] = status_rows(
        "select 'has_features' as \"check\", 0::bigint as violations union all select 'expected_features', 0 "
        f"union all select 'numeric_features', 0 union all select 'no_nulls', {nulls} from matrix "
        f"union all select 'all_finite', {broken} from matrix"
    )
    q["input_checks"] = status_rows(
        "select 'query_known' as \"check\", count(*) as violations from judgments where query_id not in (select query_id from queries) "
        "union all select 'candidate_known', count(*) from judgments where product_id not in (select product_id from products) "
        "union all select 'candidate_named', count(*) from judgments join products using (product_id) where product_name is null"
    )
    q["join_guards"] = " union all ".join(
        f"select '{name}' as key, count(*) as repeated_keys, coalesce(sum(n), 0)::bigint as row_count from "
        f"(select count(*) as n from {table} group by {keys} having count(*) > 1)"
        for name, table, keys in (
            ("query_id", "queries", "query_id"),
            ("product_id", "products", "product_id"),
            ("pair", "judgments", "query_id, product_id"),
            ("judgment_id", "raw_labels", "id"),
        )
    )
    # cleaning and split
    q["clean_queries"] = "select * from queries"
    q["clean_products"] = "select * replace (round(average_rating, 6) as average_rating) from products"
    q["clean_documents"] = f"select doc_id, {collapse('text')} as body from documents"
    q["normalized_columns"] = "select product_id, category_hierarchy from raw_products"
    q["resolve_judgments"] = "select * from resolved"
    q["conflict_audit"] = "select * from resolved where contains(original_labels, '|')"
    q["resolution_methods"] = "select resolution_method, count(*) as pairs from resolved group by all"
    q["cleaning_report"] = " union all ".join(
        f"select '{stage}' as stage, '{name}' as table_name, count(*) as row_count from {table}"
        for stage, name, table in (
            ("raw", "queries", "raw_queries"),
            ("raw", "products", "raw_products"),
            ("raw", "labels", "raw_labels"),
            ("clean", "queries", "queries"),
            ("clean", "products", "products"),
            ("clean", "judgments", "resolved"),
            ("clean", "conflict_audit", "resolved where contains(original_labels, '|')"),
        )
    )
    q["request_products"] = "select product_id, " + ", ".join(
        f"coalesce({c}, '') as {c}" for c in S.PRODUCT_COLUMNS[1:6]
    ) + """, coalesce(rating_count, 0.0::double) as rating_count,
      round(coalesce(average_rating, 0.0::double), 6) as average_rating,
      coalesce(review_count, 0.0::double) as review_count from raw_products"""
    q["query_split"] = "select * from assignment"
    q["judgment_split"] = "select * from judged"
    q["split_report"] = """select split, count(distinct query_id) as queries, count(*) as judgments,
      0::bigint as overlapping_queries,
      (select string_agg(i::varchar, ',' order by i) from (select distinct query_id as i from judged b where b.split = a.split
        order by i limit 5)) as first_ids,
      (select string_agg(i::varchar, ',' order by i) from (select distinct query_id as i from judged b where b.split = a.split
        order by i desc limit 5)) as last_ids
      from judged a group by split"""
    q["train_products"] = "select * from corpus"
    q["judged_pairs"] = """select query_id, product_id, relevance_score, query, product_name, product_class,
      category_hierarchy, md5(product_description) as description_md5, rating_count
      from judgments left join queries using (query_id) left join products using (product_id)"""
    # retrieval
    q["bm25_idf"] = "select term, df, round(idf, 9) as idf from idf"
    doc_tokens = tokens("text")
    q["bm25_document_terms"] = f"""select term, count(*) as df, round(ln(1 + ((select count(*) from documents)
      - count(*) + 0.5::double) / (count(*) + 0.5::double)), 9) as idf
      from (select unnest(list_distinct({doc_tokens})) as term from documents) group by term"""
    q["bm25_footprint"] = """select count(*) as vocabulary_size,
      (sum(octet_length(encode(term)) + 8) + 16 * count(*))::bigint as estimated_bytes from idf"""
    q["bm25_scores"] = "select * from bm25"
    q["bm25_ranks"] = "select query_id, product_id, score, rank from bm25_ranked"
    q["bm25_topk"] = bm25_top
    q["tfidf_vocab"] = "select term, df, corpus_count, round(idf, 9) as idf from vocab"
    q["tfidf_vocab_cut"] = """select term, df, corpus_count, round(idf, 9) as idf from vocab
      order by corpus_count desc, term limit 50"""
    q["tfidf_scores"] = "select * from tfidf"
    q["tfidf_topk"] = """select query_id, product_id, score, rank::int as rank from (
      select query_id, product_id, tfidf_similarity as score, row_number() over (partition by query_id
        order by tfidf_similarity desc, product_id) as rank from tfidf) where rank <= 20"""
    q["vector_norms"] = """select 'query' as kind, query_id as id, round(sqrt(list_inner_product(v, v)), 6) as norm from query_vectors
      union all select 'product', product_id, round(sqrt(list_inner_product(v, v)), 6) from product_vectors"""
    q["vector_scores"] = _six("semantic", S.SEMANTIC_FEATURES)
    q["vector_topk"] = """select query_id, product_id, round(score, 6) as score, rank::int as rank from (
      select query_id, product_id, semantic_similarity as score, row_number() over (partition by query_id
        order by semantic_similarity desc, product_id::varchar) as rank from semantic) where rank <= 10"""
    q["similarity_stats"] = """select count(*) as pairs, round(avg(semantic_similarity), 6) as mean,
      round(stddev_samp(semantic_similarity), 6) as std, round(min(semantic_similarity), 6) as min,
      round(max(semantic_similarity), 6) as max from semantic"""
    # features
    q["lexical_features"] = _six(
        "compared", ["exact_match", "token_overlap", "character_overlap", "query_title_overlap"]
    )
    q["text_features"] = _six(f"({_features('raw_product_side', S.TEXT_FEATURES)})", S.TEXT_FEATURES)
    q["metadata_features"] = _six(f"({_features('raw_product_side', S.METADATA_FEATURES)})", S.METADATA_FEATURES)
    q["compat_features"] = _six("compared", S.COMPATIBILITY_FEATURES)
    q["numeric_parsing"] = f"""select event_id, {finite('t')} as number from (select event_id, case event_type
      when 'error' then 'nan' when 'signup' then 'inf' when 'click' then ' ' || value
      else case when user_id > 40 then 'n/a' else value::varchar end end as t from events)"""
    q["feature_matrix"] = _six("matrix", S.ALL_FEATURES, "query_id, product_id, relevance_score")
    # metrics
    ranked = "bm25_ranked"
    q["metrics_list"] = per_query(metric_sql(ranked, "list", [10], 10, ["query_id"]), [10], ["query_id"])
    ks = [1, 5, 10, 20]
    q["metrics_retrieved"] = per_query(metric_sql(ranked, "retrieved", ks, 20, ["query_id"]), ks, ["query_id"])
    candidates = metric_sql(ranked, "candidates", [10], 10, ["query_id"])
    q["metrics_candidates"] = per_query(candidates, [10], ["query_id"])
    q["metrics_macro"] = averaged(candidates, [10], [])
    by_split = """(select split, query_id, relevance_score, row_number() over (partition by query_id
      order by tfidf_similarity desc, product_id) as rank from tfidf join judged using (query_id, product_id))"""
    q["metrics_by_split"] = averaged(
        metric_sql(by_split, "list", [10], 10, ["split", "query_id"]), [10], ["split"]
    )
    q["graded_ranking"] = """select query_id, product_id, score, rank::int as rank, relevance_score
      from bm25_ranked where rank <= 10"""
    q["group_sizes"] = "select query_id, count(*) as group_size from judgments group by query_id"
    q["compare_models"] = compare_sql(MODELS, "candidates", [10], 10)
    q["compare_retrievers"] = compare_sql(["tfidf", "bm25"], "retrieved", ks, 20)
    q["compare_semantic"] = compare_sql(["bm25", "semantic"], "list", [10], 10)
    # error analysis
    q["model_ranks"] = "select query_id, product_id, " + ", ".join(
        f"{m}_rank" for m in MODELS
    ) + " from model_ranked"
    q["query_report"] = rounded_report("per_query_report", REPORT_COLUMNS)
    q["success_cases"] = rounded_report(
        "per_query_report", REPORT_COLUMNS,
        "where blend_minus_bm25 > 0 order by round(per_query_report.blend_minus_bm25, 6) desc, query_id limit 25",
    )
    q["loss_cases"] = rounded_report("per_query_report", REPORT_COLUMNS, "where blend_ndcg - bm25_ndcg < 0")
    q["failure_cases"] = "select * replace (round(blend_score, 6) as blend_score) from failures"
    q["by_length"] = means_by("query_length_bucket")
    q["by_type"] = means_by("query_type")
    by_category = list_ndcg(["category", "query_id"], "categorized", ["blend", "bm25"])
    q["by_category"] = f"""select category, queries, candidates::bigint as candidates,
      relevant_candidates::bigint as relevant_candidates, blend_ndcg, bm25_ndcg, blend_minus_bm25 from (
      select category, count(distinct query_id) as queries, count(*) as candidates,
        count(*) filter (relevance_score > 0) as relevant_candidates from categorized where model = 'bm25' group by category)
      join (select category, round(avg(blend_ndcg), 6) as blend_ndcg, round(avg(bm25_ndcg), 6) as bm25_ndcg,
        round(avg(blend_ndcg - bm25_ndcg), 6) as blend_minus_bm25 from ({by_category}) group by category) using (category)"""
    q["ambiguous_queries"] = """select * replace (round(bm25_ndcg, 6) as bm25_ndcg, round(blend_ndcg, 6) as blend_ndcg,
      round(blend_minus_bm25, 6) as blend_minus_bm25) from ambiguous"""
    q["confusion"] = """select model, count(*) filter (rank <= 10 and relevance_score > 0) as true_positive,
      count(*) filter (rank <= 10 and relevance_score = 0) as false_positive,
      count(*) filter (rank > 10 and relevance_score > 0) as false_negative,
      count(*) filter (rank > 10 and relevance_score = 0) as true_negative
      from (select model, relevance_score, row_number() over (partition by model, query_id
        order by score desc, product_id) as rank from long_scores) group by model"""
    means = ", ".join(f"round(avg({m}_ndcg), 6) as mean_{m}_ndcg" for m in MODELS)
    outcome = """count(*) filter (blend_minus_bm25 > 0) as challenger_better,
      count(*) filter (blend_minus_bm25 < 0) as baseline_better, count(*) filter (blend_minus_bm25 = 0) as ties"""
    q["win_loss"] = f"select {outcome}, {means} from per_query_report"
    q["error_summary"] = f"""select count(*) as test_queries, sum(candidate_count)::bigint as test_candidates,
      least(count(*) filter (blend_minus_bm25 > 0), 25) as success_case_count, {outcome}, {means},
      (select count(*) from failures) as failure_case_count,
      (select count(*) from ambiguous) as ambiguous_query_count from per_query_report"""
    q["category_levels"] = f"""select product_id, {depth('category_hierarchy')} as depth,
      {top_level('category_hierarchy')} as top_level, {primary('category_hierarchy')} as primary_category from raw_products"""
    # profiling
    q["schema_profile"] = " union all ".join(
        [
            schema_rows("queries", "raw_queries", {"query_id": "bigint", "query": "string", "query_class": "string"}),
            schema_rows("products", "raw_products", PRODUCT_TYPES),
            schema_rows(
                "labels", "raw_labels",
                {"id": "bigint", "query_id": "bigint", "product_id": "bigint", "label": "string"},
            ),
        ]
    )
    q["missing_summary"] = schema_rows("products", "raw_products", PRODUCT_TYPES)
    q["uniqueness"] = " union all ".join(
        unique_row(t, n, c)
        for t, n, c in (
            ("raw_queries", "queries", "query_id"),
            ("raw_queries", "queries", "query"),
            ("raw_products", "products", "product_id"),
            ("raw_labels", "labels", "id"),
        )
    )
    q["text_profile"] = describe(lengths())
    q["rating_profile"] = f"""select * replace (round(min, 6) as min, round(max, 6) as max) from ({describe(RATINGS)})"""
    q["value_counts"] = """select 'query_class' as column_name, query_class as value, count(*) as count from raw_queries group by all
      union all select 'product_class', product_class, count(*) from raw_products group by all"""
    q["top_category_values"] = """select 'category_hierarchy' as column_name, category_hierarchy as value, count(*) as count
      from raw_products group by all order by count desc, value nulls first limit 25"""
    q["repeated_queries"] = """select query_id, query, query_class from raw_queries where query in
      (select query from raw_queries group by query having count(*) > 1) order by query, query_id limit 50"""
    q["label_distribution"] = """select label, count(*) as count,
      round(100.0::double * (count(*)::double / (select count(*) from raw_labels)), 2) as percentage from raw_labels group by label"""
    q["judgments_per_query"] = describe(PER_QUERY)
    q["reference_rows"] = """select 'unknown_product_references' as metric, count(*) as row_count from raw_labels
      where product_id not in (select product_id from raw_products) union all select 'unknown_query_references', count(*)
      from raw_labels where query_id not in (select query_id from raw_queries)"""
    summary = f"""select query_id, judgments, unique_products, exact_count, partial_count, irrelevant_count, query,
      query_class, {word_count('query')}::int as query_word_count from (select query_id, count(*) as judgments,
      count(distinct product_id) as unique_products, count(*) filter (label = 'Exact') as exact_count,
      count(*) filter (label = 'Partial') as partial_count, count(*) filter (label = 'Irrelevant') as irrelevant_count
      from raw_labels group by query_id) left join raw_queries using (query_id)"""
    q["query_summary"] = summary
    q["queries_without"] = f"""select count(*) filter (exact_count = 0) as queries_without_exact,
      count(*) filter (partial_count = 0) as queries_without_partial from ({summary})"""
    thirty = (
        f"select 'query_word_count' as metric, {word_count('query')}::double as value from raw_queries union all "
        f"select 'judgments_per_query', count(*) from raw_labels group by query_id union all {RATINGS}"
    )
    forty = f"select 'product_name_word_count' as metric, {word_count('product_name')} as value from raw_products"
    q["histograms"] = f"{histogram(thirty, 30)} union all {histogram(forty, 40)}"
    q["top_categories"] = f"""select {primary('category_hierarchy')} as category, count(*) as count from raw_products
      group by all order by count desc, category limit 20"""
    q["compact_report"] = f"select name, round(value, 6) as value from ({COMPACT})"
    # requests and logs
    q["rank_requests"] = "select * from ranked_requests"
    # The second model counts from the middle of the requests' time.
    changed = "epoch_us(ts) >= (select (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 from requests)"
    q["stream_rank"] = f"""select request_id, query, product_id, product_name, score, rank, model from (
      select *, row_number() over (partition by request_id order by score desc, product_id, position) as rank from (
        select m.*, case when {changed} then {blended('m.', (1, 10, 20, 5))} else {blended('m.')} end as score,
          case when {changed} then 'v2' else 'v1' end as model from request_matrix m join requests r using (request_id)
        where coalesce(m.top_k, 1) > 0))
      where top_k is null or rank <= top_k"""
    q["request_features"] = "select query, count(*) as candidates, " + ", ".join(
        f"round(avg({c}), 5) as {c}" for c in S.MODEL_FEATURES
    ) + " from request_matrix group by query"
    q["ranking_responses"] = """select request_id, query, string_agg(concat_ws('=', product_id::varchar, product_name), ',' order by rank) as results,
      round(sum(score), 5) as score_sum
      from all_ranked_requests group by request_id, query"""
    q["request_rejects"] = f"""select request_id, case when {blank('query')} then 'empty_query'
      when request_id not in (select request_id from candidates) then 'no_products' else 'top_k_not_positive' end as reason
      from requests where {blank('query')} or request_id not in (select request_id from candidates) or top_k <= 0"""
    q["nested_rejects"] = q["request_rejects"]
    q["rank_nested_requests"] = q["rank_requests"]
    q["request_keys"] = """select request_id, 'ranking:relrank:champion:' || sha256(concat_ws('|', top_k::varchar,
      coalesce(n, 0)::varchar, coalesce(content, ''), coalesce(query, ''))) as content_key
      from requests left join (select request_id, count(*) as n, """ + lanes("h", 64) + """ as content
      from request_content group by request_id) using (request_id)"""
    q["request_reuse"] = """select request_id, s.first_id is distinct from request_id as reused from log l left join (
      select c.request_key, c.ts, min(k.request_id) as first_id from chain c join log k on k.request_key = c.request_key
        and k.ts = c.ts group by all) s on s.request_key = l.request_key and s.ts = l.ts"""
    q["request_audit"] = """select request_id::varchar as request_id, query, n::int as candidate_count,
      least(n, top_k)::int as top_k, 'relrank' as model_name, 'champion' as model_alias, null::double as latency_ms,
      ts as created_at from requests join (select request_id, count(*) as n from candidates group by request_id)
      using (request_id) where coalesce(top_k, 1) > 0 and not (""" + blank("query") + ")"
    q["saved_audit"] = """select query, count(distinct request_id) as requests, count(*) as candidates from candidates
      where coalesce(top_k, 1) > 0 group by query"""
    q["latency_report"] = f"select {LATENCY}"
    q["latency_by_user_action"] = (
        f"select split_part(request_key, ':', 2) as action, {LATENCY} group by action"
    )
    q["status_counts"] = "select status, count(*) as count from log group by status order by status"
    q["windowed_signals"] = """select date_trunc('hour', ts)::timestamp as window_start, count(*) as requests,
      count(*) filter (status <> 200) as failures,
      round(count(*) filter (status <> 200)::double / count(*), 6) as error_rate,
      round(avg(latency_ms), 6) as mean_ms, max(latency_ms) as max_ms from log group by window_start"""
    q["stream_signals"] = q["windowed_signals"]
    q["stream_reuse"] = q["request_reuse"]
    q["request_shape"] = f"""select time_bucket(interval 7 days, ts, timestamp '1970-01-01')::timestamp as window_start,
      len({tokens('query')})::int as query_length, count(*) as requests, round(avg(n), 6) as mean_candidates,
      min(n) as min_candidates, max(n) as max_candidates from (select ts, query, coalesce(n, 0) as n from requests
      left join (select request_id, count(*) as n from candidates group by request_id) using (request_id)) group by all"""
    q["encode_text"] = f"""select product_id, place::int as dimension, value from (
      select product_id, place, round(units / sqrt(sum(units::double * units) over (partition by product_id)), 9) as value from (
        select product_id, place, sum(n * weight)::bigint as units from (
          select product_id, gram, count(*) as n from (select product_id, unnest({grams('product_name')}) as gram from products)
          group by all)
        join (select gram, ('0x' || substr(md5(gram), 1, 8))::bigint % 384 as place,
          case when ('0x' || substr(md5(gram), 9, 1))::int % 2 = 0 then 1 else -1 end
            * round((ln((1.0::double + (select count(*) from products)) / (1 + count(distinct product_id))) + 1) * 1e6)::bigint as weight
          from (select product_id, unnest({grams('product_name')}) as gram from products) group by gram) using (gram)
        group by product_id, place)) where value <> 0"""
    # A stump per feature: its training mean at four digits, and the mean gain on either side as values.
    gains = "(pow(2, relevance_score) - 1)"
    cuts = ", ".join(f"round(avg({c}), 4) as cut_{c}" for c in S.MODEL_FEATURES)
    values = ", ".join(
        f"coalesce(round(avg({gains}) filter ({c} <= cut_{c}), 4), 0) as low_{c}, coalesce(round(avg({gains}) filter ({c} > cut_{c}), 4), 0) as high_{c}"
        for c in S.MODEL_FEATURES
    )
    steps = " + ".join(f"case when {c} <= cut_{c} then low_{c} else high_{c} end" for c in S.MODEL_FEATURES)
    q["ensemble_scores"] = f"""select query_id, product_id, round({steps}, 6) as score from matrix
      join assignment using (query_id), (select {cuts} from matrix join assignment using (query_id) where split = 'train') c,
      (select {values} from matrix join assignment using (query_id), (select {cuts} from matrix join assignment using (query_id)
        where split = 'train') where split = 'train') v where split = 'test'"""
    # reproducibility
    q["table_fingerprint"] = "select * from prints"
    q["combined_fingerprint"] = """select sha256('seed=42;' || string_agg(name || '=' || row_count || '=' || content, ';'
      order by name || '=' || row_count || '=' || content)) as fingerprint from prints"""
    q["reuse_decision"] = """select situation, reason = 'cache_hit' as reusable, reason from (select situation,
      case when stored_missing = 1 then 'feature_manifest_missing' when inputs_differ = 1 then 'fingerprint_mismatch'
      when outputs_missing = 1 then 'feature_artifact_missing_or_empty'
      when outputs_differ = 1 then 'artifact_changed:split' else 'cache_hit' end as reason from situations)"""
    return q


# The stored answers of every key: each is the first request after the TTL of the one before it.
CTE["chain"] = """
select request_key, min(ts) as ts from log group by request_key
union all
select l.request_key, min(l.ts) from chain c join log l on l.request_key = c.request_key
  and l.ts >= c.ts + interval 86400 seconds group by l.request_key"""


def all_sql() -> dict[str, str]:
    return {name: assemble(body) for name, body in _bodies().items()}
