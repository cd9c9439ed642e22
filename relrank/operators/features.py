"""The pair feature matrix: 19 columns in five groups that can be switched off.

Texts are tokenized once per query and once per product; a pair row only compares the sets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relrank import schema as S
from relrank.functions import category
from relrank.functions import text as tx
from relrank.functions.numeric import finite_or_zero, ratio
from relrank.operators import pairs as P
from relrank.session import materialize


@dataclass(frozen=True)
class FeatureGroups:
    lexical: bool = True
    product_text: bool = True
    metadata: bool = True
    compatibility: bool = True

    def columns(self) -> list[str]:
        groups = [
            (self.lexical, S.LEXICAL_FEATURES),
            (self.product_text, S.TEXT_FEATURES),
            (self.metadata, S.METADATA_FEATURES),
            (self.compatibility, S.COMPATIBILITY_FEATURES),
            (True, S.SEMANTIC_FEATURES),
        ]
        return [name for on, names in groups if on for name in names]


def query_profile(queries: DataFrame) -> DataFrame:
    folded = tx.fold(F.col("query"))
    return queries.select("query_id", folded.alias("q_fold")).select(
        "query_id",
        "q_fold",
        tx.word_set(F.col("q_fold")).alias("q_words"),
        tx.trigram_set(F.col("q_fold")).alias("q_grams"),
    )


def _optional(df: DataFrame, column: str, default: Column) -> Column:
    return F.col(column) if column in df.columns else default


def product_profile(products: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """Everything a pair needs from its product; absent optional columns take their defaults."""
    empty, zero = F.lit(""), F.lit(0.0)
    folded = tx.fold(F.col("product_name"))
    path = _optional(products, "category_hierarchy", empty)
    columns = {
        "p_fold": folded,
        "p_words": tx.word_set(folded),
        "p_grams": tx.trigram_set(folded),
        "path_words": tx.word_set(path),
        "class_words": tx.word_set(_optional(products, "product_class", empty)),
        "title_length": title_length(F.col("product_name")),
        "description_length": title_length(_optional(products, "product_description", empty)),
        "feature_count": feature_count(_optional(products, "product_features", empty)),
        "category_depth": category.depth(path),
        "average_rating": finite_or_zero(_optional(products, "average_rating", zero)),
        "rating_count": finite_or_zero(_optional(products, "rating_count", zero)),
        "review_count": finite_or_zero(_optional(products, "review_count", zero)),
    }
    keys = ["product_id", *(carried or [])]
    return products.select(*keys, *[c.alias(name) for name, c in columns.items()])


def title_length(c: Column) -> Column:
    return F.size(tx.words(c)).cast("double")


def feature_count(c: Column) -> Column:
    """Lines if there are several, words otherwise."""
    lines = F.size(tx.line_items(c))
    items = tx.bind(lines, lambda n: F.when(n > 1, n))
    return F.coalesce(items, F.size(tx.words(c))).cast("double")


def _flag(condition: Column) -> Column:
    return condition.cast("double")


def intersections() -> dict[str, Column]:
    """Sizes of the set intersections, as columns of their own: several features use one."""
    q = F.col("q_words")
    return {
        "shared_words": tx.shared(q, F.col("p_words")),
        "shared_grams": tx.shared(F.col("q_grams"), F.col("p_grams")),
        "shared_path": tx.shared(q, F.col("path_words")),
    }


def comparison_columns() -> dict[str, Column]:
    """Features that compare the two profiles of a pair."""
    q, p = F.col("q_fold"), F.col("p_fold")
    qw, pw = F.col("q_words"), F.col("p_words")
    both = (q != "") & (p != "")
    short = (F.length(q) < 3) | (F.length(p) < 3)
    grams = tx.jaccard(F.col("q_grams"), F.col("p_grams"), F.col("shared_grams"))
    return {
        "exact_match": _flag(both & (q == p)),
        "token_overlap": tx.jaccard(qw, pw, F.col("shared_words")),
        "character_overlap": F.when(~both, F.lit(0.0)).when(short, _flag(q == p)).otherwise(grams),
        "query_title_overlap": F.col("shared_words").cast("double"),
        "category_match": ratio(F.col("shared_path"), F.size(qw)),
        "product_class_match": _flag(F.arrays_overlap(qw, F.col("class_words"))),
        "phrase_match": _flag(both & p.contains(q)),
    }


def feature_columns(available: list[str], groups: FeatureGroups | None = None) -> list[Column]:
    """Feature expressions over joined profiles; score columns not yet computed default to zero."""
    groups = groups or FeatureGroups()
    compared = comparison_columns()
    out = []
    for name in groups.columns():
        if name in compared:
            out.append(compared[name].alias(name))
        elif name in available:
            out.append(F.coalesce(F.col(name).cast("double"), F.lit(0.0)).alias(name))
        else:
            out.append(F.lit(0.0).alias(name))
    return out


def feature_matrix(
    pairs: DataFrame,
    queries: DataFrame,
    products: DataFrame,
    groups: FeatureGroups | None = None,
) -> DataFrame:
    """Pair columns followed by the features. Score columns present on the pairs pass through."""
    for df, needed in ((pairs, ["query_id", "product_id"]), (queries, ["query"]), (products, ["product_name"])):
        missing = sorted(set(needed) - set(df.columns))
        if missing:
            raise ValueError(f"Missing required columns: {missing}")
    names = (groups or FeatureGroups()).columns()
    carried = [c for c in pairs.columns if c not in names]
    texts = P.shared_values(queries, "query_id", "query", "text_id")
    profile = query_profile(texts.values.withColumnRenamed("text_id", "query_id")).withColumnRenamed("query_id", "text_id")

    def compared(rows: DataFrame) -> DataFrame:
        joined = rows.withColumns(intersections())
        return joined.select(*carried, *feature_columns(joined.columns, groups))

    numbered = pairs.join(texts.ids, "query_id", "left")
    tables = {"text_id": materialize(profile, "query-profile")}
    return P.join_broadcast(numbered, tables, compared, "matrix", product_profile(products))


def feature_checks(matrix: DataFrame, features: list[str]) -> DataFrame:
    """Presence, null and finiteness counts of model features, as check rows."""
    missing = [c for c in features if c not in matrix.columns]
    present = [c for c in features if c in matrix.columns]
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    kinds = dict(matrix.dtypes)
    odd = [c for c in present if kinds[c] not in numeric and not kinds[c].startswith("decimal")]
    usable = [c for c in present if c not in odd]
    nulls, infinite = F.lit(0), F.lit(0)
    for c in usable:
        value = F.col(c).cast("double")
        nulls = nulls + value.isNull().cast("long")
        broken = F.isnan(value) | (F.abs(value) == float("inf"))
        infinite = infinite + F.coalesce(broken, F.lit(False)).cast("long")
    counts = matrix.agg(
        F.coalesce(F.sum(nulls), F.lit(0)).cast("long").alias("nulls"),
        F.coalesce(F.sum(infinite), F.lit(0)).cast("long").alias("infinite"),
    )
    rows = counts.select(
        F.expr(
            f"stack(5, 'has_features', cast({int(not present)} as bigint), "
            f"'expected_features', cast({len(missing)} as bigint), "
            f"'numeric_features', cast({len(odd)} as bigint), "
            "'no_nulls', nulls, 'all_finite', infinite) as (check, violations)"
        )
    )
    return rows.withColumn("status", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL"))
