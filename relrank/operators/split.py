"""Train / validation / test split by query, so that no query leaks across splits."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from relrank import schema as S
from relrank.session import materialize

HASH_PREFIX = 3  # hex digits: 4,096 hash buckets


@dataclass(frozen=True)
class SplitSizes:
    train: float = 0.70
    validation: float = 0.15
    test: float = 0.15
    seed: int = 42

    def __post_init__(self) -> None:
        sizes = (self.train, self.validation, self.test)
        if not all(0 < s < 1 for s in sizes):
            raise ValueError("Split sizes must lie between 0 and 1.")
        if not math.isclose(sum(sizes), 1.0, abs_tol=1e-9):
            raise ValueError("Split sizes must sum to 1.")


def query_ids(judgments: DataFrame) -> DataFrame:
    checked = F.when(
        F.col("query_id").isNull(), F.raise_error(F.lit("A judgment has no query_id."))
    ).otherwise(F.col("query_id"))
    return judgments.select(checked.alias("query_id")).distinct()


def assign_queries(ids: DataFrame, sizes: SplitSizes | None = None) -> DataFrame:
    """`(query_id, split)` with exact split sizes, in a seeded hash order.

    Positions in the hash order are found without a global sort: ids are counted per hash prefix
    (4,096 rows), and numbered inside their prefix. The ids are written first, as they are read for
    the counts, the total and the numbering.
    """
    sizes = sizes or SplitSizes()
    hashed = materialize(ids.select("query_id"), "query-ids").select(
        "query_id",
        F.md5(F.concat_ws("|", F.lit(str(sizes.seed)), F.col("query_id").cast("string"))).alias("h"),
    ).withColumn("prefix", F.substring("h", 1, HASH_PREFIX))
    counts = hashed.groupBy("prefix").agg(F.count("*").alias("n"))
    before = W.orderBy("prefix").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("prefix", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    total = counts.agg(F.sum("n").alias("n")).scalar()
    inside = W.partitionBy("prefix").orderBy("h", "query_id")
    # The offsets have at most 16 ** HASH_PREFIX rows, so broadcasting them is bounded.
    placed = (
        hashed.withColumn("local", F.row_number().over(inside))
        .join(F.broadcast(offsets), "prefix")
        .select("query_id", (F.col("offset") + F.col("local")).alias("position"))
        .withColumn("n", total)
    )
    held_out = F.ceil(F.round(F.lit(sizes.validation + sizes.test) * F.col("n"), 6))
    test_share = sizes.test / (sizes.validation + sizes.test)
    n_test = F.ceil(F.round(F.lit(test_share) * held_out, 6))
    split = (
        F.when(F.col("n") < 3, F.raise_error(F.lit("At least 3 queries are required.")))
        .when(F.col("position") <= n_test, "test")
        .when(F.col("position") <= held_out, "validation")
        .otherwise("train")
    )
    return placed.select("query_id", split.alias("split"))


def assign_split(judgments: DataFrame, assignment: DataFrame) -> DataFrame:
    """Judgments with their query's split; a query without one stops the job."""
    joined = judgments.join(assignment, "query_id", "left")
    checked = F.when(
        F.col("split").isNull(), F.raise_error(F.lit("A judgment belongs to no split."))
    ).otherwise(F.col("split"))
    return joined.withColumn("split", checked)


def split_report(judgments: DataFrame, shown: int = 5) -> DataFrame:
    """Queries, judgments, overlapping queries and the first and last ids per split.

    Counted per (query, split) first; ids are then cut to `shown` by a group limit.
    """
    pairs = judgments.groupBy("query_id", "split").agg(F.count("*").alias("n"))
    spread = pairs.groupBy("query_id").agg(F.count("*").alias("splits"))
    sizes = (
        pairs.join(spread, "query_id")
        .groupBy("split")
        .agg(
            F.count("*").alias("queries"),
            F.sum("n").alias("judgments"),
            F.count_if(F.col("splits") > 1).alias("overlapping_queries"),
        )
    )

    def ends(order, name: str) -> DataFrame:
        ranked = pairs.withColumn("r", F.row_number().over(W.partitionBy("split").orderBy(order)))
        ids = F.array_join(
            F.transform(
                F.array_sort(F.collect_list("query_id")), lambda x: x.cast("string")
            ),
            ",",
        )
        return ranked.filter(F.col("r") <= shown).groupBy("split").agg(ids.alias(name))

    first = ends(F.col("query_id").asc(), "first_ids")
    last = ends(F.col("query_id").desc(), "last_ids")
    return sizes.join(first, "split").join(last, "split")


def split_checks(judgments: DataFrame) -> DataFrame:
    """Null keys and queries shared by two splits, as check rows."""
    nulls = judgments.agg(
        *[
            F.count_if(F.col(c).isNull()).alias(c)
            for c in ("query_id", "product_id", "relevance_score")
        ]
    )
    null_rows = nulls.select(
        F.expr(
            "stack(3, 'query_id_present', query_id, 'product_id_present', product_id, "
            "'relevance_score_present', relevance_score) as (check, violations)"
        )
    )
    flags = [F.max((F.col("split") == s).cast("int")).alias(s) for s in S.SPLITS]
    member = judgments.filter(F.col("query_id").isNotNull()).groupBy("query_id").agg(*flags)
    shared = member.agg(
        F.count_if((F.col("train") + F.col("validation")) == 2).alias("tv"),
        F.count_if((F.col("train") + F.col("test")) == 2).alias("tt"),
        F.count_if((F.col("validation") + F.col("test")) == 2).alias("vt"),
    ).select(
        F.expr(
            "stack(3, 'train_validation_disjoint', tv, 'train_test_disjoint', tt, "
            "'validation_test_disjoint', vt) as (check, violations)"
        )
    )
    rows = null_rows.unionByName(shared)
    return rows.withColumn("status", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL"))


def split_products(
    products: DataFrame, judgments: DataFrame, assignment: DataFrame, split: str = "train"
) -> DataFrame:
    """Products that occur in one split's judgments."""
    ids = assignment.filter(F.col("split") == split).select("query_id")
    used = judgments.join(ids, "query_id", "left_semi").select("product_id").distinct()
    return products.join(used, "product_id", "left_semi")
