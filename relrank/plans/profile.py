"""Dataset profiling: schemas, lengths, value counts, label mix, histograms, one compact report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relrank.functions import category
from relrank.functions import text as tx
from relrank.functions.numeric import percent, report
from relrank.operators import percentiles

LENGTH_COLUMNS = ["product_name", "product_description", "product_features", "category_hierarchy"]
RATING_COLUMNS = ["average_rating", "rating_count", "review_count"]


def unpivot(df: DataFrame, columns: dict[str, object], keys: list[str] | None = None) -> DataFrame:
    """Rows (metric, value) for named numeric expressions."""
    entries = [
        F.struct(F.lit(name).alias("metric"), c.cast("double").alias("value"))
        for name, c in columns.items()
    ]
    return df.select(*(keys or []), F.inline(F.array(*entries)))


def schema_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Type, missing count and missing share of every column; one aggregate per table."""
    out = None
    for name, df in tables.items():
        kinds = dict(df.dtypes)
        counts = df.agg(
            F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
        )
        entries = [
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(kinds[c]).alias("dtype"),
                F.col(c).alias("missing"),
                percent(F.col(c), F.col("_n")).alias("missing_pct"),
            )
            for c in df.columns
        ]
        rows = counts.select(F.lit(name).alias("table_name"), F.inline(F.array(*entries)))
        out = rows if out is None else out.unionByName(rows)
    return out


def missing_summary(df: DataFrame, name: str) -> DataFrame:
    return schema_profile({name: df}).orderBy(F.col("missing").desc(), "column_name")


def text_lengths(queries: DataFrame, products: DataFrame) -> DataFrame:
    """Word and character counts of every text column, in long form."""
    q = unpivot(
        queries,
        {
            "query_word_count": tx.word_count(F.col("query")),
            "query_char_count": tx.char_count(F.col("query")),
        },
    )
    columns = {}
    for c in LENGTH_COLUMNS:
        columns[f"{c}_word_count"] = tx.word_count(F.col(c))
        columns[f"{c}_char_count"] = tx.char_count(F.col(c))
    return q.unionByName(unpivot(products, columns))


def text_profile(queries: DataFrame, products: DataFrame) -> DataFrame:
    return percentiles.describe(text_lengths(queries, products), ["metric"])


def ratings(products: DataFrame) -> DataFrame:
    return unpivot(products, {c: F.col(c) for c in RATING_COLUMNS})


def rating_profile(products: DataFrame) -> DataFrame:
    return percentiles.describe(ratings(products), ["metric"])


def uniqueness(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Rows, distinct values and surplus rows per column; a null is one more value for the surplus."""
    out = None
    for c in columns:
        groups = df.groupBy(c).agg(F.count("*").alias("n"))
        row = groups.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
            F.count(c).alias("unique_values"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
        ).select(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), "row_count", "unique_values", "duplicates")
        out = row if out is None else out.unionByName(row)
    return out


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Counts per value, null included; with `top`, the most frequent ones only."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))
    counts = counts.select(F.lit(column).alias("column_name"), "value", "count")
    if top is None:
        return counts
    return counts.orderBy(F.col("count").desc(), F.col("value").asc_nulls_first()).limit(top)


def repeated_queries(queries: DataFrame, rows: int = 50) -> DataFrame:
    """Query rows whose text occurs more than once, ordered by text."""
    repeated = queries.groupBy("query").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    return (
        queries.join(repeated.select("query"), "query", "left_semi")
        .select("query_id", "query", "query_class")
        .orderBy("query", "query_id")
        .limit(rows)
    )


def label_distribution(labels: DataFrame) -> DataFrame:
    counts = labels.groupBy("label").agg(F.count("*").alias("count"))
    total = labels.agg(F.count("*").alias("n")).scalar()
    return counts.withColumn("percentage", percent(F.col("count"), total))


def per_query(labels: DataFrame) -> DataFrame:
    """Judgments and distinct products per query, counted per (query, product) first."""
    pairs = labels.groupBy("query_id", "product_id").agg(F.count("*").alias("n"))
    return pairs.groupBy("query_id").agg(
        F.sum("n").alias("judgments"), F.count("product_id").alias("unique_products")
    )


def judgments_profile(labels: DataFrame) -> DataFrame:
    long = unpivot(
        per_query(labels.filter(F.col("query_id").isNotNull())),
        {
            "judgments_per_query": F.col("judgments"),
            "products_per_query": F.col("unique_products"),
        },
    )
    return percentiles.describe(long, ["metric"])


def reference_rows(labels: DataFrame, queries: DataFrame, products: DataFrame) -> DataFrame:
    """Judgment rows that name an unknown product or query; counted per key before the join."""
    out = []
    for metric, parent, key in (
        ("unknown_product_references", products, "product_id"),
        ("unknown_query_references", queries, "query_id"),
    ):
        counts = labels.groupBy(key).agg(F.count("*").alias("n"))
        missing = counts.join(parent.select(key), key, "left_anti")
        rows = missing.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"))
        out.append(rows.select(F.lit(metric).alias("metric"), "row_count"))
    return out[0].unionByName(out[1])


def query_summary(labels: DataFrame, queries: DataFrame) -> DataFrame:
    """Label counts per query beside its text, class and length."""
    label = F.col("label")
    pairs = labels.filter(F.col("query_id").isNotNull()).groupBy("query_id", "product_id").agg(
        F.count("*").alias("n"),
        F.count_if(label == "Exact").alias("exact"),
        F.count_if(label == "Partial").alias("partial"),
        F.count_if(label == "Irrelevant").alias("irrelevant"),
    )
    counts = pairs.groupBy("query_id").agg(
        F.sum("n").alias("judgments"),
        F.count("product_id").alias("unique_products"),
        F.sum("exact").alias("exact_count"),
        F.sum("partial").alias("partial_count"),
        F.sum("irrelevant").alias("irrelevant_count"),
    )
    attributes = queries.select(
        "query_id", "query", "query_class", tx.word_count(F.col("query")).alias("query_word_count")
    )
    return counts.join(attributes, "query_id", "left")


def queries_without(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count_if(F.col("exact_count") == 0).alias("queries_without_exact"),
        F.count_if(F.col("partial_count") == 0).alias("queries_without_partial"),
    )


def histograms(queries: DataFrame, products: DataFrame, labels: DataFrame) -> DataFrame:
    """Bins of query length, name length, judgments per query and the ratings."""
    thirty = (
        unpivot(queries, {"query_word_count": tx.word_count(F.col("query"))})
        .unionByName(
            unpivot(per_query(labels), {"judgments_per_query": F.col("judgments")})
        )
        .unionByName(ratings(products))
    )
    forty = unpivot(products, {"product_name_word_count": tx.word_count(F.col("product_name"))})
    return percentiles.histogram(thirty, ["metric"], 30).unionByName(
        percentiles.histogram(forty, ["metric"], 40)
    )


def top_categories(products: DataFrame, top: int = 20) -> DataFrame:
    return (
        products.groupBy(category.primary(F.col("category_hierarchy")).alias("category"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.col("count").desc(), "category")
        .limit(top)
    )


def compact_report(queries: DataFrame, products: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (name, value): sizes, surplus rows, broken references, mean and median sizes."""

    def named(df: DataFrame, names: dict[str, str]) -> DataFrame:
        entries = [
            F.struct(F.lit(name).alias("name"), F.col(c).cast("double").alias("value"))
            for name, c in names.items()
        ]
        return df.select(F.inline(F.array(*entries)))

    def ids(df: DataFrame, c: str, rows: str, unique: str, surplus: str) -> DataFrame:
        return named(
            uniqueness(df, "t", [c]),
            {rows: "row_count", unique: "unique_values", surplus: "duplicates"},
        )

    pairs = labels.groupBy("query_id", "product_id").agg(F.count("*").alias("n"))
    surplus_pairs = pairs.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("d"))
    sizes = per_query(labels.filter(F.col("query_id").isNotNull()))
    long = unpivot(
        sizes,
        {"judgments_per_query": F.col("judgments"), "products_per_query": F.col("unique_products")},
    ).unionByName(unpivot(queries, {"query_word": tx.word_count(F.col("query"))}))
    stats = percentiles.describe(long, ["metric"])
    entries = F.array(
        F.struct(F.concat("metric", F.lit("_mean")).alias("name"), F.col("mean").alias("value")),
        F.struct(F.concat("metric", F.lit("_median")).alias("name"), F.col("p50").alias("value")),
    )
    widths = queries.sparkSession.range(1).select(
        F.lit(len(products.columns)).alias("p"), F.lit(len(queries.columns)).alias("q")
    )
    frames = [
        ids(products, "product_id", "product_rows", "unique_products", "duplicate_product_ids"),
        ids(queries, "query_id", "query_rows", "unique_queries", "duplicate_query_ids"),
        ids(labels, "id", "label_rows", "unique_judgments", "duplicate_judgment_ids"),
        named(widths, {"product_columns": "p", "query_columns": "q"}),
        named(uniqueness(queries, "t", ["query"]), {"duplicate_query_text": "duplicates"}),
        named(surplus_pairs, {"duplicate_query_product_pairs": "d"}),
        reference_rows(labels, queries, products).select(
            F.col("metric").alias("name"), F.col("row_count").cast("double").alias("value")
        ),
        stats.select(F.inline(entries)),
    ]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out.select("name", report(F.col("value")).alias("value"))
