"""BM25 and TF-IDF as tables of term weights and row-local sparse dot products.

Both models reduce to the same shape. A query becomes `array<struct<term, weight>>`, a document
becomes `map<term, weight>`; the score of a pair is their dot product, evaluated on the joined pair
row. Pairs are never exploded by term, so a frequent term cannot skew the scoring, and the only
joins over pairs are the two on query_id and product_id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relrank.functions import text as tx
from relrank.functions.numeric import score
from relrank.functions.vectors import sparse_dot
from relrank.operators import pairs as P
from relrank.operators import ranking
from relrank.session import materialize


@dataclass(frozen=True)
class Bm25Params:
    k1: float = 1.5
    b: float = 0.75

    def __post_init__(self) -> None:
        if self.k1 < 0:
            raise ValueError(f"k1 must be 0 or more, not {self.k1}.")
        if not 0 <= self.b <= 1:
            raise ValueError(f"b must lie between 0 and 1, not {self.b}.")


@dataclass(frozen=True)
class TfidfParams:
    min_df: int = 1
    max_df: float = 0.95
    max_features: int = 200_000


def _entry(term: Column, weight: Column) -> Column:
    return F.struct(term.alias("term"), weight.alias("weight"))


# BM25 ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Bm25Model:
    """A fitted corpus: a term table and two numbers."""

    idf: DataFrame
    n_documents: int
    mean_length: float
    params: Bm25Params


def fit_bm25(corpus: DataFrame, text: str = "product_name", params: Bm25Params | None = None) -> Bm25Model:
    tokens = tx.space_tokens(F.col(text))
    stats = corpus.agg(F.count("*").alias("n"), F.sum(F.size(tokens)).alias("tokens")).first()
    n = stats["n"]
    if n == 0:
        raise ValueError("Cannot fit BM25 on an empty corpus.")
    df = F.col("df")
    idf = (
        corpus.select(F.explode(F.array_distinct(tokens)).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("df"))
        .withColumn("idf", F.log(1.0 + (n - df + 0.5) / (df + 0.5)))
    )
    return Bm25Model(idf, n, stats["tokens"] / n, params or Bm25Params())


def bm25_footprint(idf: DataFrame) -> DataFrame:
    """Vocabulary size and estimated bytes: text plus eight bytes, and two numbers, per term."""
    return idf.agg(
        F.count("*").alias("vocabulary_size"),
        (F.sum(F.octet_length("term") + 8) + 16 * F.count("*")).alias("estimated_bytes"),
    )


def bm25_queries(queries: DataFrame, model: Bm25Model) -> DataFrame:
    """`(query_id, bm25_query)`; a repeated term carries its idf as often as it occurs."""
    terms = queries.select("query_id", F.explode(tx.counts(tx.space_tokens(F.col("query")))).alias("t"))
    weighted = terms.select("query_id", "t.term", F.col("t.weight").alias("times")).join(model.idf, "term")
    return weighted.groupBy("query_id").agg(
        F.array_sort(F.collect_list(_entry(F.col("term"), F.col("times") * F.col("idf")))).alias(
            "bm25_query"
        )
    )


def with_bm25_document(documents: DataFrame, model: Bm25Model) -> DataFrame:
    """Adds `bm25_document`: saturated term frequencies, everything in BM25 but the idf."""
    k1, b = model.params.k1, model.params.b
    tokens = F.col("_tokens")
    share = F.size(tokens) / F.lit(model.mean_length or 1.0)
    saturated = F.transform(
        tx.counts(tokens),
        lambda e: F.struct(e["term"], e["weight"] * (k1 + 1.0) / (e["weight"] + F.col("_fade"))),
    )
    return (
        documents.withColumn("_tokens", tx.space_tokens(F.col("product_name")))
        .withColumn("_fade", k1 * (1.0 - b + b * share))
        .withColumn("bm25_document", F.map_from_entries(saturated))
        .drop("_tokens", "_fade")
    )


def bm25_score() -> Column:
    return score(sparse_dot(F.col("bm25_query"), F.col("bm25_document")))


# TF-IDF -------------------------------------------------------------------------------


def fit_tfidf(
    corpus: DataFrame, text: str = "product_name", params: TfidfParams | None = None
) -> DataFrame:
    """The vocabulary `(term, df, corpus_count, idf)`: at most `max_features` word uni- and bigrams.

    Over the limit, the terms with the largest corpus count stay; ties go to the smaller term. The
    table is written once, as queries and documents both read it.
    """
    p = params or TfidfParams()
    n = corpus.count()
    if n == 0:
        raise ValueError("Cannot fit TF-IDF on an empty corpus.")
    grams = corpus.select(F.monotonically_increasing_id().alias("text_id"), tx.word_grams(F.col(text)).alias("grams"))
    per_text = grams.select("text_id", F.explode("grams").alias("term")).groupBy("text_id", "term")
    counts = (
        per_text.agg(F.count("*").alias("n"))
        .groupBy("term")
        .agg(F.count("*").alias("df"), F.sum("n").alias("corpus_count"))
        .filter((F.col("df") >= p.min_df) & (F.col("df") <= p.max_df * n))
        .withColumn("idf", F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0)
    )
    return _largest(materialize(counts, "tfidf-terms"), p.max_features)


def _largest(terms: DataFrame, limit: int) -> DataFrame:
    """Exact cut at the limit, without collecting a limit's worth of rows from every partition.

    Terms are counted per corpus count. All terms above the threshold count stay; only the terms at
    the threshold are ordered, and only as many of them as there is room for.
    """
    if terms.count() <= limit:
        return terms
    per_count = terms.groupBy("corpus_count").agg(F.count("*").alias("terms"))
    summed = ranking.prefix_sum(per_count, [], [F.col("corpus_count").desc()], "terms", "through")
    cut = summed.filter(F.col("through") >= limit).agg(F.max("corpus_count")).first()[0]
    above = terms.filter(F.col("corpus_count") > cut)
    room = limit - above.count()
    ties = ranking.full_rank(
        terms.filter(F.col("corpus_count") == cut), [], [F.col("term").asc()], "_r"
    )
    return materialize(above.unionByName(ties.filter(F.col("_r") <= room).drop("_r")), "tfidf-cut")


def tfidf_weights(texts: DataFrame, key: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """`(key, entries)`: L2-normalized weights of the in-vocabulary grams of each text."""
    grams = texts.select(key, F.explode(tx.counts(tx.word_grams(F.col(text)))).alias("t"))
    # The vocabulary is a written table of known size: Spark broadcasts it if it is small.
    weighted = grams.select(key, "t.term", F.col("t.weight").alias("n")).join(
        vocabulary.select("term", "idf"), "term"
    )
    weighted = weighted.select(
        key, "term", ((1.0 + F.log("n")) * F.col("idf")).alias("weight")
    )
    length = F.col("length")
    return (
        weighted.groupBy(key)
        .agg(
            F.array_sort(F.collect_list(_entry(F.col("term"), F.col("weight")))).alias("entries"),
            F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"),
        )
        .select(
            key,
            F.transform("entries", lambda e: _entry(e["term"], e["weight"] / length)).alias("entries"),
        )
    )


def tfidf_queries(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    return tfidf_weights(queries, "query_id", "query", vocabulary).withColumnRenamed(
        "entries", "tfidf_query"
    )


def tfidf_documents(documents: DataFrame, vocabulary: DataFrame) -> DataFrame:
    weights = tfidf_weights(documents, "product_id", "product_name", vocabulary)
    return weights.select("product_id", F.map_from_entries("entries").alias("tfidf_document"))


def tfidf_score() -> Column:
    return score(sparse_dot(F.col("tfidf_query"), F.col("tfidf_document")))


# Pairs --------------------------------------------------------------------------------


def score_pairs(
    pairs: DataFrame,
    queries: DataFrame,
    weigh: Callable[[DataFrame], DataFrame],
    documents: DataFrame,
    column: Column,
    out: str,
) -> DataFrame:
    """Scores of (query, product) pairs from the two weight tables; zero where either has none.

    Products come first: that join shuffles bare ids. `weigh` gives the terms of (query_id, query); it runs on the
    distinct texts, which are written out, measured and broadcast, in parts if they are many.
    """
    carried = [F.col(c) for c in pairs.columns]
    texts = P.shared_values(queries, "query_id", "query", "text_id")
    terms = weigh(texts.values.withColumnRenamed("text_id", "query_id")).withColumnRenamed("query_id", "text_id")
    return P.join_broadcast(
        pairs.join(texts.ids, "query_id", "left"),
        {"text_id": materialize(terms, "query-terms")},
        lambda rows: rows.select(*carried, column.alias(out)),
        "lexical",
        documents,
    )


def bm25_pairs(
    pairs: DataFrame, queries: DataFrame, products: DataFrame, model: Bm25Model
) -> DataFrame:
    documents = with_bm25_document(products.select("product_id", "product_name"), model)
    return score_pairs(
        pairs,
        queries,
        lambda texts: bm25_queries(texts, model),
        documents.select("product_id", "bm25_document"),
        bm25_score(),
        "bm25_score",
    )


def tfidf_pairs(
    pairs: DataFrame, queries: DataFrame, products: DataFrame, vocabulary: DataFrame
) -> DataFrame:
    return score_pairs(
        pairs,
        queries,
        lambda texts: tfidf_queries(texts, vocabulary),
        tfidf_documents(products, vocabulary),
        tfidf_score(),
        "tfidf_similarity",
    )
