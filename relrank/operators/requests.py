"""Ranking requests as tables: validity, features, ranking, content keys, reuse, log reports.

Candidates are kept one per row `(request_id, query, product fields)`, so a request with very many
candidates spreads over tasks like any other rows. Nested requests are exploded on the way in, and
only ranked results are nested again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from relrank import schema as S
from relrank.functions import text as tx
from relrank.functions.numeric import percent, score
from relrank.operators import clean, features, fingerprint, lexical, pairs, percentiles, ranking, scoring, semantic
from relrank.session import materialize

# --- fixed values -----------------------------------------------------------------
MODEL_NAME = "relrank"
MODEL_ALIAS = "champion"
TTL_SECONDS = 300
TITLE_PROFILE = ["p_fold", "p_words", "p_grams", "title_length"]
# ----------------------------------------------------------------------------------


def explode_requests(nested: DataFrame) -> DataFrame:
    """Nested requests to one row per candidate; what else a request carries stays with it."""
    held = [c for c in nested.columns if c != "products"]
    return nested.select(*held, F.posexplode("products").alias("position", "p")).select(*held, "position", "p.*")


def nested_rejects(nested: DataFrame) -> DataFrame:
    sizes = nested.select(
        "request_id", "query", "top_k", F.coalesce(F.size("products"), F.lit(0)).alias("n")
    )
    return _reasons(sizes)


def _reasons(sizes: DataFrame) -> DataFrame:
    reason = (
        F.when(tx.is_blank(F.col("query")), "empty_query")
        .when(F.col("n") <= 0, "no_products")
        .when(F.col("top_k") <= 0, "top_k_not_positive")
    )
    return sizes.select("request_id", reason.alias("reason")).filter(F.col("reason").isNotNull())


def _limit(rows: DataFrame, top_k: int | None):
    """How many results a row's request gets: what the call says, else the request's own top_k, else null for all."""
    if top_k is not None:
        return F.lit(top_k)
    return F.col("top_k") if "top_k" in rows.columns else F.lit(None).cast("int")


def rejects(headers: DataFrame, candidates: DataFrame, top_k: int | None = None) -> DataFrame:
    """Requests that cannot be ranked, with the first reason that applies."""
    sizes = candidates.groupBy("request_id").agg(F.count("*").alias("n"))
    joined = headers.join(sizes, "request_id", "left").select(
        "request_id", "query", _limit(headers, top_k).alias("top_k"), F.coalesce("n", F.lit(0)).alias("n")
    )
    return _reasons(joined)


@dataclass(frozen=True)
class RequestModels:
    """What scoring needs, fitted once: corpus statistics, vocabulary, and vectors by query_id and product_id."""

    bm25: lexical.Bm25Model
    vocabulary: DataFrame
    query_vectors: DataFrame | None = None
    product_vectors: DataFrame | None = None


def fit_models(
    corpus: DataFrame, query_vectors: DataFrame | None = None, product_vectors: DataFrame | None = None
) -> RequestModels:
    bm25 = lexical.fit_bm25(corpus)
    written = lexical.Bm25Model(materialize(bm25.idf, "request-idf"), bm25.n_documents, bm25.mean_length, bm25.params)
    return RequestModels(written, lexical.fit_tfidf(corpus), query_vectors, product_vectors)


def _with_similarity(rows: DataFrame, vectors: semantic.SharedVectors | None) -> DataFrame:
    """Adds semantic_similarity: 0 without vector tables, and for a query or product that has no vector."""
    if vectors is None:
        return rows.withColumn("semantic_similarity", F.lit(0.0))
    known = F.col("query_vector").isNotNull() & F.col("product_vector").isNotNull()
    added = ("query_vector", "product_vector", "query_embedding_norm", "product_embedding_norm")
    return rows.withColumn("semantic_similarity", F.when(known, score(semantic.cosine())).otherwise(0.0)).drop(*added)


def _narrow(candidates: DataFrame, products: DataFrame | None, kept: list[str]) -> DataFrame:
    """Kept columns, product_id, product_name and what a feature needs of the other fields: counts and sets of words
    instead of texts. With a table `products` that is worked out once per product, else once per candidate."""
    if products is None:
        profile = features.product_profile(clean.request_products(candidates), [*kept, "product_name"])
        return profile.drop(*TITLE_PROFILE)
    profile = features.product_profile(clean.request_products(products), ["product_name"]).drop(*TITLE_PROFILE)
    joined = candidates.select(F.col("product_id").cast("long").alias("product_id"), *kept).join(
        profile, "product_id", "left"
    )
    nothing = F.array().cast("array<string>")
    filled = {"product_name": F.coalesce("product_name", F.lit(""))}
    filled |= {c: F.coalesce(c, nothing) for c in ("path_words", "class_words")}
    return joined.withColumns(filled)


def _title_side(named: DataFrame, models: RequestModels) -> DataFrame:
    """One row per product name with its profile and both sparse vectors."""
    weights = lexical.tfidf_weights(named, "product_name", "product_name", models.vocabulary).select(
        "product_name", F.map_from_entries("entries").alias("tfidf_document")
    )
    weighted = lexical.with_bm25_document(named.withColumn("product_id", F.lit(0)), models.bm25)
    profile = features.product_profile(weighted, ["product_name", "bm25_document"])
    return profile.select("product_name", "bm25_document", *TITLE_PROFILE).join(weights, "product_name", "left")


def score_candidates(candidates: DataFrame, models: RequestModels, products: DataFrame | None = None) -> DataFrame:
    """The inference features of every candidate. Candidates carry their product's fields, or only its id: then the
    table `products` has them, one row per product_id, and a product that is not in it counts as one without fields.

    Texts come with the request, so profiles and weights are looked up per distinct query and product name. Candidates
    are written without texts of their products first; what is wide joins them last, from tables of known size.
    """
    kept = [c for c in ("request_id", "ts", "query", "top_k", "position") if c in candidates.columns]
    vectors, numbers = None, []
    if models.query_vectors is not None and models.product_vectors is not None:
        vectors, numbers = semantic.shared_vectors(models.query_vectors, models.product_vectors), ["query_vector_id"]
        candidates = vectors.with_query_number(candidates)
    rows = _narrow(candidates, products, [*kept, *numbers])
    rows = materialize(vectors.with_product_number(rows) if vectors else rows, "candidates")
    asked = rows.select(F.col("query").alias("query_id"), "query").distinct()
    query_side = scoring.query_side(asked, models.bm25, models.vocabulary).withColumnRenamed("query_id", "query")
    titles = _title_side(rows.select("product_name").distinct(), models)
    tables = {**(vectors.tables() if vectors else {}), "query": materialize(query_side, "request-queries")}
    many = vectors.product_values if vectors and vectors.many_products else None
    titles = materialize(titles, "request-titles")
    if pairs.n_parts(titles) == 1:
        tables["product_name"] = titles
    else:
        rows = rows.join(titles, "product_name", "left")
    kept = [*kept, "product_name"]

    def finished(joined: DataFrame) -> DataFrame:
        scored = _with_similarity(joined, vectors).withColumns(features.intersections()).withColumns(
            {"bm25_score": lexical.bm25_score(), "tfidf_similarity": lexical.tfidf_score()}
        )
        columns = dict(zip(features.FeatureGroups().columns(), features.feature_columns(scored.columns)))
        return scored.select(*kept, "product_id", *[columns[c] for c in S.MODEL_FEATURES])

    return pairs.join_broadcast(rows, tables, finished, "scored-candidates", many, "product_vector_id")


def blend_scorer(matrix: DataFrame) -> DataFrame:
    return matrix.withColumn("score", scoring.blend())


def rank_requests(
    candidates: DataFrame,
    models: RequestModels,
    top_k: int | None = None,
    scorer: Callable[[DataFrame], DataFrame] = blend_scorer,
    products: DataFrame | None = None,
) -> DataFrame:
    """`(request_id, query, product_id, product_name, score, rank)`; ties go to the smaller id.

    A request gets `top_k` results, without that as many as its own column top_k says, else all.
    `scorer` adds a `score` column to the feature matrix, for instance a fitted model's transform. A
    score that is not finite stops the job. Rows with a blank query are left to `rejects`. `products` has the fields of
    candidates that carry only ids.
    """
    usable = candidates.filter(~tx.is_blank(F.col("query")))
    scored = scorer(score_candidates(usable, models, products))
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    checked = scored.withColumn(
        "score",
        F.when(finite, F.col("score")).otherwise(
            F.raise_error(F.lit("The model produced a score that is not finite.")).cast("double")
        ),
    )
    results = ["request_id", "query", "product_id", "product_name", "score"]
    checked = checked.select(*results, *[c for c in ("top_k", "position") if c in checked.columns])
    order = ranking.by_score()
    if "position" in checked.columns:
        order = [*order, F.col("position").asc()]
    if top_k is not None:
        ranked = ranking.top_k(checked, ["request_id"], order, top_k)
    else:
        limit = _limit(checked, None)
        ranked = ranking.full_rank(checked, ["request_id"], order).filter(limit.isNull() | (F.col("rank") <= limit))
    return ranked.select(*results, "rank")


def nest_responses(ranked: DataFrame) -> DataFrame:
    """One response row per request with its ranked products in order; at most top_k of them."""
    entry = F.struct("rank", "product_id", "product_name", "score")
    return ranked.groupBy("request_id", "query").agg(
        F.array_sort(F.collect_list(entry)).alias("results")
    )


def content_keys(
    headers: DataFrame,
    candidates: DataFrame,
    top_k: int | None = None,
    model: str = MODEL_NAME,
    alias: str = MODEL_ALIAS,
) -> DataFrame:
    """Equal keys for requests with equal query, products (in any order) and top_k.

    The products enter as two sums of row hashes and a count: independent of order, combined before
    the shuffle, and of fixed size for a request of any length.
    """
    fields = [c for c in S.PRODUCT_COLUMNS if c in candidates.columns]
    hashed = candidates.select("request_id", F.sha2(fingerprint.encoded(candidates, fields), 256).alias("h"))
    sums = hashed.groupBy("request_id").agg(F.count("*").alias("n"), fingerprint.lanes("h", 64).alias("content"))
    payload = F.concat_ws(
        "|",
        _limit(headers, top_k).cast("string"),
        F.coalesce(F.col("n"), F.lit(0)).cast("string"),
        F.coalesce(F.col("content"), F.lit("")),
        F.coalesce(F.col("query"), F.lit("")),
    )
    return headers.join(sums, "request_id", "left").select(
        "request_id",
        F.concat_ws(":", F.lit("ranking"), F.lit(model), F.lit(alias), F.sha2(payload, 256)).alias(
            "content_key"
        ),
    )


# Reuse --------------------------------------------------------------------------------


def _successors(moments: DataFrame, step: int) -> DataFrame:
    """(request_key, micros, next): the key's first moment at or after micros + step, where there is one.

    Moments and the times they look ahead to are range-sorted together; backwards in time the last moment passed is the
    next one. What lies in a later range comes from the ranges' first moments, so that a key spreads over ranges.
    """
    seen = moments.select("request_key", F.col("micros").alias("at"), F.lit(1).alias("mark"), "micros")
    ahead = moments.select("request_key", (F.col("micros") + step).alias("at"), F.lit(0).alias("mark"), "micros")
    both = seen.unionByName(ahead).repartitionByRange("request_key", "at", "mark")
    ranged = materialize(both.withColumn("range", F.spark_partition_id()), "moments")
    moment = F.when(F.col("mark") == 1, F.col("micros"))
    backwards = W.partitionBy("request_key", "range").orderBy(F.desc("at"), F.desc("mark")).rowsBetween(W.unboundedPreceding, 0)
    later = W.partitionBy("request_key").orderBy(F.desc("range")).rowsBetween(W.unboundedPreceding, -1)
    firsts = ranged.groupBy("request_key", "range").agg(F.min(moment).alias("first"))
    firsts = firsts.select("request_key", "range", F.last("first", ignorenulls=True).over(later).alias("beyond"))
    found = ranged.withColumn("within", F.last(moment, ignorenulls=True).over(backwards)).where("mark = 0")
    joined = found.join(firsts, ["request_key", "range"])
    return joined.select("request_key", "micros", F.coalesce("within", "beyond").alias("next")).where("next is not null")


def reuse(log: DataFrame, ttl: float = TTL_SECONDS) -> DataFrame:
    """`(request_id, reused)`: whether an equal request was answered and stored within the TTL.

    A reused answer is not stored again, so the TTL runs from the last stored one. The stored answers of a key are the
    chain that leads from its first request to its first one after the TTL, and so on. Chains are followed by pointer
    doubling: each round marks what the marked requests reach and doubles the steps of the pointers, so that rounds grow
    with the logarithm of the longest chain and no task holds a key. Of equal times the smaller request_id comes first.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = log.select("request_id", F.coalesce("request_key", F.lit("")).alias("request_key"), micros.alias("micros"))
    moments = rows.groupBy("request_key", "micros").agg(F.min("request_id").alias("first_id"))
    moments = materialize(moments, "moments")
    pointers = materialize(_successors(moments, int(ttl * 1_000_000)), "pointers")
    stored = moments.groupBy("request_key").agg(F.min("micros").alias("micros"))
    while not pointers.isEmpty():
        reached = stored.join(pointers, ["request_key", "micros"]).select("request_key", F.col("next").alias("micros"))
        stored = materialize(stored.unionByName(reached), "stored")
        further = pointers.select("request_key", F.col("micros").alias("next"), F.col("next").alias("further"))
        doubled = pointers.join(further, ["request_key", "next"])
        pointers = materialize(doubled.select("request_key", "micros", F.col("further").alias("next")), "pointers")
    first = moments.join(stored, ["request_key", "micros"])
    joined = rows.join(first, ["request_key", "micros"], "left")
    return joined.select("request_id", (~F.col("request_id").eqNullSafe(F.col("first_id"))).alias("reused"))


# Audit and log reports ----------------------------------------------------------------


def audit_rows(
    headers: DataFrame,
    candidates: DataFrame,
    top_k: int | None = None,
    model: str = MODEL_NAME,
    alias: str | Column = MODEL_ALIAS,
) -> DataFrame:
    """One audit row per ranked request, in the audit schema. Latency is set by the caller."""
    sizes = candidates.groupBy("request_id").agg(F.count("*").alias("n"))
    limit = _limit(headers, top_k)
    valid = headers.filter(~tx.is_blank(F.col("query")) & (limit.isNull() | (limit > 0))).join(sizes, "request_id")
    created = F.col("ts") if "ts" in headers.columns else F.current_timestamp()
    values = {
        "request_id": F.col("request_id"),
        "query": F.col("query"),
        "candidate_count": F.col("n"),
        "top_k": F.least(F.col("n"), limit),
        "model_name": F.lit(model),
        "model_alias": alias if isinstance(alias, Column) else F.lit(alias),
        "latency_ms": F.col("latency_ms") if "latency_ms" in headers.columns else F.lit(None),
        "created_at": created,
    }
    return valid.select(
        *[values[f.name].cast(f.dataType).alias(f.name) for f in S.AUDIT_SCHEMA]
    )


def latency_report(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Requests, failures, throughput, and the latency distribution of successful requests."""
    keys = keys or []
    ok = F.col("status") == 200
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    seconds = (F.max(at) - F.min(at)) / 1e6
    n = F.count("*")
    good = F.when(ok, F.col("latency_ms"))
    base = log.groupBy(*keys).agg(
        n.alias("requests"),
        F.count_if(ok).alias("successful"),
        F.count_if(~ok).alias("failed"),
        percent(F.count_if(~ok), n).alias("error_pct"),
        F.round(n / F.nullif(seconds, F.lit(0.0)), 6).alias("throughput"),
        F.round(F.avg(good), 6).alias("mean_ms"),
        F.min(good).alias("min_ms"),
        F.max(good).alias("max_ms"),
    )
    points = percentiles.quantiles(
        log.filter(ok).select(*keys, F.col("latency_ms").alias("value")),
        keys,
        {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99},
    )
    rounded = points.select(
        *keys, *[F.round(c, 6).alias(c) for c in points.columns if c not in keys]
    )
    if keys:
        return base.join(rounded, keys, "left")
    return base.withColumns({c: rounded.select(c).scalar() for c in rounded.columns})


def status_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("status").agg(F.count("*").alias("count")).orderBy("status")
