"""Judged-search tables derived from the star-schema test tables.

Every view covers all rows of its inputs: queries come from `supplier` and `part`, products from
`part`, `lineitem` and `documents`, judgments from `lineitem`, vectors from `embeddings`, ranking
requests from `orders` and `lineitem`, the service log from `events`. The remainders below only
vary the content of a derived column; they never drop a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


TOP_KS = (None, 0, 1, 3, 1000, None, 2)

def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows hashed over tasks: text work per row follows, and a file's splits may hold very unequal numbers of rows."""
    return df.repartition(key)


def _size(df: DataFrame) -> Column:
    """Row count of a table as a scalar subquery."""
    return df.agg(F.count("*").alias("n")).scalar()


def raw_queries(spark: SparkSession, path: str) -> DataFrame:
    supplier = table(spark, path, "supplier").select("s_suppkey")
    part = table(spark, path, "part").select("p_partkey", "p_name", "p_type")
    long_form = F.concat(F.col("p_name"), F.lit(" "), F.col("p_type"))
    text = (
        F.when(F.col("s_suppkey") % 3 == 0, F.col("p_name"))
        .when(F.col("s_suppkey") % 3 == 1, long_form)
        .otherwise(F.concat(long_form, F.lit(" for home or office")))
    )
    query_class = F.when(F.col("s_suppkey") % 17 != 0, F.col("p_type"))
    return supplier.join(part, F.col("s_suppkey") == F.col("p_partkey")).select(
        F.col("s_suppkey").alias("query_id"), text.alias("query"), query_class.alias("query_class")
    )


def raw_products(spark: SparkSession, path: str) -> DataFrame:
    part = spread(table(spark, path, "part"), "p_partkey")
    documents = table(spark, path, "documents")
    sales = (
        table(spark, path, "lineitem")
        .groupBy("l_partkey")
        .agg(
            F.count("*").cast("double").alias("n_lines"),
            (F.avg("l_quantity") / 10.0).alias("mean_quantity"),
            F.count_distinct("l_orderkey").cast("double").alias("n_orders"),
        )
    )
    key, brand, kind, name = (F.col(c) for c in ("p_partkey", "p_brand", "p_type", "p_name"))
    title = F.when(key % 5 == 0, name).otherwise(F.concat_ws(" ", name, kind, brand))
    branch = key % 6
    category = (
        F.when(branch == 0, F.concat_ws(" > ", brand, kind, name))
        .when(branch == 1, F.concat_ws(" / ", brand, kind, name))
        .when(branch == 2, F.concat_ws("/", brand, kind))
        .when(branch == 3, F.concat_ws("|", brand, kind))
        .when(branch == 4, kind)
    )
    features = F.when(key % 7 == 0, F.lit("")).otherwise(
        F.concat(
            F.lit("size:"), F.col("p_size").cast("string"),
            F.lit("\nbrand:"), brand,
            F.lit("\ntype:"), kind,
        )
    )
    rated = key % 11 != 0
    return (
        part.join(sales, key == F.col("l_partkey"), "left")
        .withColumn("doc_key", key % _size(documents))
        .join(
            documents.select(F.col("doc_id").alias("doc_key"), F.col("text")),
            "doc_key",
            "left",
        )
        .select(
            key.alias("product_id"),
            title.alias("product_name"),
            F.when(key % 19 != 0, kind).alias("product_class"),
            category.alias("category_hierarchy"),
            F.col("text").alias("product_description"),
            features.alias("product_features"),
            F.when(rated, F.col("n_lines")).alias("rating_count"),
            F.when(rated, F.col("mean_quantity")).alias("average_rating"),
            F.when(rated, F.col("n_orders")).alias("review_count"),
        )
    )


def raw_labels(spark: SparkSession, path: str) -> DataFrame:
    label = (
        F.when(F.col("l_returnflag") == "A", "Exact")
        .when(F.col("l_returnflag") == "N", "Partial")
        .when(F.col("l_returnflag") == "R", "Irrelevant")
    )
    return table(spark, path, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_suppkey").alias("query_id"),
        F.col("l_partkey").alias("product_id"),
        label.alias("label"),
    )


def query_vectors(spark: SparkSession, path: str) -> DataFrame:
    return _vectors(spark, path, "supplier", F.col("s_suppkey"), F.col("s_suppkey") * 7, "query_id")


def product_vectors(spark: SparkSession, path: str) -> DataFrame:
    return _vectors(spark, path, "part", F.col("p_partkey"), F.col("p_partkey"), "product_id")


def _vectors(spark, path, name, key: Column, position: Column, out: str) -> DataFrame:
    embeddings = table(spark, path, "embeddings").select("vec_id", "embedding")
    return (
        table(spark, path, name)
        .select(key.alias(out), (position % _size(embeddings)).alias("vec_id"))
        .join(embeddings, "vec_id")
        .select(out, F.col("embedding").alias("vector"))
    )


def request_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row per ranking request: who asked what, and when."""
    suppliers = table(spark, path, "supplier")
    queries = raw_queries(spark, path).select("query_id", "query")
    return (
        table(spark, path, "orders")
        .select(
            F.col("o_orderkey").alias("request_id"),
            F.col("o_orderdate").alias("ts"),
            (F.col("o_custkey") % _size(suppliers)).alias("query_id"),
            # Every kind of wish: none, nothing, one, few, more than there are.
            F.get(F.array(*[F.lit(k).cast("int") for k in TOP_KS]), (F.col("o_orderkey") % len(TOP_KS)).cast("int")).alias("top_k"),
        )
        .join(queries, "query_id", "left")
        .select("request_id", "ts", "query_id", "query", "top_k")
    )


def request_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per candidate of a request, by its product's id; requests without lines have none."""
    return table(spark, path, "lineitem").select(
        F.col("l_orderkey").alias("request_id"),
        F.col("l_linenumber").alias("position"),
        F.col("l_partkey").alias("product_id"),
    )


def service_log(spark: SparkSession, path: str) -> DataFrame:
    status = (
        F.when(F.col("event_type") == "error", 500)
        .when(F.col("event_type") == "signup", 400)
        .otherwise(200)
    )
    return table(spark, path, "events").select(
        F.col("event_id").alias("request_id"),
        "ts",
        F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("request_key"),
        F.col("value").alias("latency_ms"),
        status.alias("status"),
    )
