"""All scores and features of judged pairs in one frame."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relrank.functions.numeric import SCORE_DIGITS
from relrank.operators import features, lexical, pairs, semantic
from relrank.session import materialize

# --- fixed values: weights of the linear blend that stands in for a learned model ---
BLEND = {
    "bm25_score": 0.1,
    "tfidf_similarity": 1.0,
    "token_overlap": 1.0,
    "semantic_similarity": 1.0,
}
# ----------------------------------------------------------------------------------


def blend(weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of the parts at nine digits, added as whole numbers: exact whatever the order of the parts."""
    exact = {name: Decimal(str(weight)) for name, weight in (weights or BLEND).items()}
    digits = max(0, *[-w.as_tuple().exponent for w in exact.values()])
    total = F.lit(0).cast("long")
    for name, weight in exact.items():
        units = F.round(F.col(name) * 10.0**SCORE_DIGITS).cast("long")
        total = total + F.lit(int(weight.scaleb(digits))).cast("long") * units
    return F.round(total.cast("double") / 10.0**digits) / 10.0**SCORE_DIGITS


@dataclass
class SearchTables:
    """Cleaned inputs of a scoring job. `corpus` is what the lexical models are fitted on."""

    queries: DataFrame
    products: DataFrame
    judgments: DataFrame
    corpus: DataFrame
    query_vectors: DataFrame | None = None
    product_vectors: DataFrame | None = None


def query_side(queries: DataFrame, bm25: lexical.Bm25Model, vocabulary: DataFrame) -> DataFrame:
    """One row per query with its profile and both sparse vectors."""
    return (
        features.query_profile(queries)
        .join(lexical.bm25_queries(queries, bm25), "query_id", "left")
        .join(lexical.tfidf_queries(queries, vocabulary), "query_id", "left")
    )


def product_side(
    products: DataFrame,
    bm25: lexical.Bm25Model,
    vocabulary: DataFrame,
    carried: list[str] | None = None,
) -> DataFrame:
    """One row per product with its profile and both sparse vectors."""
    weighted = lexical.with_bm25_document(products, bm25)
    profile = features.product_profile(weighted, ["bm25_document", *(carried or [])])
    return profile.join(lexical.tfidf_documents(products, vocabulary), "product_id", "left")


def scored_pairs(
    t: SearchTables,
    groups: features.FeatureGroups | None = None,
    carried: list[str] | None = None,
) -> DataFrame:
    """Judgment columns and all features. Pairs are shuffled with ids and the numbers of texts and vectors only.

    Profiles of queries and vectors are joined last, once per distinct text and vector; they are written out, measured
    and broadcast, in parts if they are many. Vectors of products that are too many come with the product.
    `carried` names product columns to keep on the pair.
    """
    bm25, vocabulary = lexical.fit_bm25(t.corpus), lexical.fit_tfidf(t.corpus)
    keep = [*t.judgments.columns, *(carried or [])]
    texts = pairs.shared_values(t.queries, "query_id", "query", "text_id")
    asked = query_side(texts.values.withColumnRenamed("text_id", "query_id"), bm25, vocabulary)
    tables = {"text_id": materialize(asked.withColumnRenamed("query_id", "text_id"), "query-side")}
    products = product_side(t.products, bm25, vocabulary, carried)
    rows = t.judgments.join(texts.ids, "query_id", "left")
    with_vectors = t.query_vectors is not None and t.product_vectors is not None
    if with_vectors:
        vectors = semantic.shared_vectors(t.query_vectors, t.product_vectors)
        rows = vectors.with_query_number(rows)
        products = vectors.with_product_side(products)
        tables = {**vectors.tables(), **tables}
    scores = {"bm25_score": lexical.bm25_score(), "tfidf_similarity": lexical.tfidf_score()}
    if with_vectors:
        scores["semantic_similarity"] = semantic.similarity()

    def scored(joined: DataFrame) -> DataFrame:
        joined = joined.withColumns({**features.intersections(), **scores})
        return joined.select(*keep, *features.feature_columns(joined.columns, groups))

    return pairs.join_broadcast(rows, tables, scored, "scored-pairs", products)
