"""Text cleaning and the resolution of repeated annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relrank import schema as S
from relrank.functions import text as tx

PRODUCT_TEXT = [
    "product_name",
    "product_class",
    "category_hierarchy",
    "product_description",
    "product_features",
]


def grade_of(label: Column) -> Column:
    out = None
    for name, grade in S.LABEL_GRADES.items():
        hit = label == name
        out = F.when(hit, F.lit(grade)) if out is None else out.when(hit, F.lit(grade))
    return out.cast("int")


def label_of(grade: Column) -> Column:
    out = None
    for name, value in S.LABEL_GRADES.items():
        hit = grade == value
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def clean_queries(df: DataFrame) -> DataFrame:
    cleaned = {"query": tx.collapse(F.col("query"))}
    if "query_class" in df.columns:
        cleaned["query_class"] = F.nullif(tx.collapse(F.col("query_class")), F.lit(""))
    return df.withColumns(cleaned)


def clean_products(df: DataFrame) -> DataFrame:
    return df.withColumns({c: tx.collapse(F.col(c)) for c in PRODUCT_TEXT if c in df.columns})


def resolve_judgments(labels: DataFrame) -> DataFrame:
    """One row per (query, product): the majority label, the lower grade on a tie.

    The label counts are plain conditional sums, so a pair annotated any number of times is reduced
    before the shuffle. A label outside the scale stops the job: it has no grade.
    """
    names = sorted(S.LABEL_GRADES)
    known = F.col("label").isin(*names)
    counts = (
        labels.filter(F.col("query_id").isNotNull() & F.col("product_id").isNotNull())
        .groupBy("query_id", "product_id")
        .agg(
            *[F.count_if(F.col("label") == name).alias(name) for name in names],
            F.count_if(~F.coalesce(known, F.lit(False))).alias("_unknown"),
            F.count("*").alias("annotation_count"),
        )
    )
    most = F.greatest(*[F.col(name) for name in names])
    winners = [F.when(F.col(name) == most, F.lit(S.LABEL_GRADES[name])) for name in names]
    distinct = sum((F.col(name) > 0).cast("int") for name in names)
    at_most = sum((F.col(name) == most).cast("int") for name in names)
    method = (
        F.when(distinct == 1, "agreement")
        .when(at_most == 1, "majority_vote")
        .otherwise("majority_tie_conservative")
    )
    score = F.when(F.col("_unknown") == 0, F.least(*winners)).otherwise(
        F.raise_error(F.lit("A judgment carries a label outside the scale.")).cast("int")
    )
    return counts.select(
        "query_id",
        "product_id",
        label_of(score).alias("label"),
        "annotation_count",
        F.concat_ws("|", *[F.when(F.col(name) > 0, F.lit(name)) for name in names]).alias(
            "original_labels"
        ),
        method.alias("resolution_method"),
        score.cast("tinyint").alias("relevance_score"),
    )


def conflict_audit(resolved: DataFrame) -> DataFrame:
    return resolved.filter(F.col("original_labels").contains("|"))


def resolution_methods(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("resolution_method").agg(F.count("*").alias("pairs"))


def clean_dataset(queries: DataFrame, products: DataFrame, labels: DataFrame) -> dict[str, DataFrame]:
    judgments = resolve_judgments(labels)
    return {
        "queries": clean_queries(queries),
        "products": clean_products(products),
        "judgments": judgments,
        "conflict_audit": conflict_audit(judgments),
    }


def cleaning_report(raw: dict[str, DataFrame], cleaned: dict[str, DataFrame]) -> DataFrame:
    """Row counts before and after cleaning, one row per table."""
    counts = [
        df.agg(F.count("*").alias("row_count")).select(
            F.lit(stage).alias("stage"), F.lit(name).alias("table_name"), "row_count"
        )
        for stage, tables in (("raw", raw), ("clean", cleaned))
        for name, df in tables.items()
    ]
    out = counts[0]
    for df in counts[1:]:
        out = out.unionByName(df)
    return out


def normalized_names(names: list[str]) -> list[str]:
    """Column names stripped, lower-cased, with underscores for spaces."""
    return [n.strip().lower().replace(" ", "_") for n in names]


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*normalized_names(df.columns))


def request_products(df: DataFrame) -> DataFrame:
    """Defaults for fields a request may leave out, in the feature schema."""
    texts = {c: F.coalesce(F.col(c), F.lit("")) for c in PRODUCT_TEXT}
    numbers = {
        c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        for c in ("rating_count", "average_rating", "review_count")
    }
    return df.withColumns({"product_id": F.col("product_id").cast("long"), **texts, **numbers})
