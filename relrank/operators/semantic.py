"""Embedding similarity of pairs, and the encode step."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relrank.functions import text as tx
from relrank.functions import vectors as V
from relrank.functions.numeric import score
from relrank.operators import pairs as P
from relrank.session import materialize


def with_norm(vectors: DataFrame, key: str, prefix: str) -> DataFrame:
    """`(key, <prefix>_vector, <prefix>_embedding_norm)`: the norm once per vector, not per pair. The vector keeps its
    type, as single precision takes half the room."""
    norm = V.norm(F.col("vector").cast("array<double>"))
    return vectors.select(key, F.col("vector").alias(f"{prefix}_vector"), norm.alias(f"{prefix}_embedding_norm"))


@dataclass(frozen=True)
class SharedVectors:
    """Vectors of queries and products under numbers: pairs carry numbers, each distinct vector is held once."""

    query_ids: DataFrame
    product_ids: DataFrame
    query_values: DataFrame
    product_values: DataFrame
    many_products: bool

    def with_query_number(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.query_ids, "query_id", "left")

    def with_product_number(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.product_ids, "product_id", "left")

    def with_product_side(self, products: DataFrame) -> DataFrame:
        """What a product brings to its pairs: its number, or its vector if there are too many of them to broadcast."""
        numbered = self.with_product_number(products)
        return numbered.join(self.product_values, "product_vector_id", "left") if self.many_products else numbered

    def tables(self) -> dict[str, DataFrame]:
        """What is left to broadcast, by number."""
        products = {} if self.many_products else {"product_vector_id": self.product_values}
        return {**products, "query_vector_id": self.query_values}


def shared_vectors(queries: DataFrame, products: DataFrame) -> SharedVectors:
    q = P.shared_values(queries, "query_id", "vector", "query_vector_id")
    p = P.shared_values(products, "product_id", "vector", "product_vector_id")
    query_values = materialize(with_norm(q.values, "query_vector_id", "query"), "query-vectors")
    product_values = materialize(with_norm(p.values, "product_vector_id", "product"), "product-vectors")
    return SharedVectors(q.ids, p.ids, query_values, product_values, P.n_parts(product_values) > 1)


def similarity() -> Column:
    """Cosine of a joined pair row. A missing vector and differing dimensions stop the job."""
    q, p = F.col("query_vector"), F.col("product_vector")
    return (
        F.when(q.isNull(), F.raise_error(F.lit("A query has no vector.")).cast("double"))
        .when(p.isNull(), F.raise_error(F.lit("A candidate has no vector.")).cast("double"))
        .when(
            F.size(q) != F.size(p),
            F.raise_error(F.lit("Query and product vectors differ in dimension.")).cast("double"),
        )
        .otherwise(score(cosine()))
        .alias("semantic_similarity")
    )


def cosine() -> Column:
    """Of the two vectors of a row, in double precision."""
    q, p = (F.col(c).cast("array<double>") for c in ("query_vector", "product_vector"))
    return V.cosine(q, p, F.col("query_embedding_norm"), F.col("product_embedding_norm"))


def attach_similarity(pairs: DataFrame, queries: DataFrame, products: DataFrame) -> DataFrame:
    """Adds `semantic_similarity` and both norms to pairs, which are shuffled with numbers instead of vectors."""
    carried = [F.col(c) for c in pairs.columns]
    vectors = shared_vectors(queries, products)
    return P.join_broadcast(
        vectors.with_query_number(pairs),
        vectors.tables(),
        lambda rows: rows.select(*carried, similarity(), "query_embedding_norm", "product_embedding_norm"),
        "similarity",
        vectors.with_product_side(vectors.product_ids.select("product_id")) if vectors.many_products else vectors.product_ids,
    )


def similarity_stats(pairs: DataFrame) -> DataFrame:
    c = "semantic_similarity"
    return pairs.agg(
        F.count(c).alias("pairs"),
        F.round(F.avg(c), 6).alias("mean"),
        F.round(F.stddev_samp(c), 6).alias("std"),
        F.round(F.min(c), 6).alias("min"),
        F.round(F.max(c), 6).alias("max"),
    )


DIMENSIONS = 384
IDF_UNITS = 1_000_000


def _hashed_grams(texts: DataFrame, key: str, text: str) -> DataFrame:
    """`(key, gram, n)`: words and word pairs of each text, and how often they occur in it."""
    grams = texts.select(key, F.explode(tx.counts(tx.word_grams(F.col(text)))).alias("t"))
    return grams.select(key, F.col("t.term").alias("gram"), F.col("t.weight").cast("long").alias("n"))


def fit_text_encoder(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """`(gram, weight)`: inverse document frequencies of words and word pairs, in whole millionths, as a written table.

    Counted by Spark and kept as rows: nothing is gathered, whatever the size of the vocabulary. `key` is unique.
    """
    grams = _hashed_grams(texts, key, text).groupBy("gram").agg(F.count("*").alias("df"))
    total = texts.agg(F.count("*").alias("total")).scalar()
    idf = F.log((1.0 + total) / (1.0 + F.col("df"))) + 1.0
    return materialize(grams.select("gram", F.round(idf * IDF_UNITS).cast("long").alias("weight")), "encoder-weights")


def encode_text(texts: DataFrame, key: str, weights: DataFrame, text: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """`(key, vector)` of unit length by signed feature hashing: a gram adds its weighted count, plus or minus, to one of
    the dimensions. Grams that the fit has not seen count for nothing; a text without known ones has the zero vector.

    Weights are whole numbers, so a component does not depend on the order of addition.
    """
    digest = F.md5("gram")
    place = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % dimensions).cast("int")
    sign = F.when(F.conv(F.substring(digest, 9, 1), 16, 10).cast("int") % 2 == 0, F.lit(1)).otherwise(F.lit(-1))
    placed = weights.select("gram", place.alias("place"), (sign * F.col("weight")).alias("weight"))
    rows = _hashed_grams(texts, key, text).join(placed, "gram")
    sums = rows.groupBy(key, "place").agg(F.sum(F.col("n") * F.col("weight")).alias("units"))
    held = sums.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("place", "units"))).alias("held"),
        F.sqrt(F.sum(F.pow(F.col("units").cast("double"), F.lit(2.0)))).alias("length"),
    )

    def component(d: Column) -> Column:
        return score(F.coalesce(F.try_element_at("held", d), F.lit(0)) / F.nullif(F.col("length"), F.lit(0.0)))

    filled = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.coalesce(component(d), F.lit(0.0)))
    return texts.select(key).join(held, key, "left").select(key, filled.alias("vector"))


def encode_with(
    texts: DataFrame,
    key: str,
    load: Callable[[], Callable[[list[str]], np.ndarray]],
    text: str = "text",
    batch: int = 32,
) -> DataFrame:
    """`(key, vector)` from any batch encoder. `load` runs once per task and returns the encoder."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = load()
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                rows = np.asarray(encoder(part[text].fillna("").tolist()), dtype=float)
                lengths = np.linalg.norm(rows, axis=1, keepdims=True)
                rows = np.divide(rows, lengths, out=np.zeros_like(rows), where=lengths != 0)
                yield pd.DataFrame({key: part[key].to_numpy(), "vector": list(rows)})

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInPandas(run, f"{key} {kind}, vector array<double>")
