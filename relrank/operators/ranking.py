"""Per-group ranking that does not put a hot group into one task.

`top_k` relies on Spark's group limit before the shuffle: every input partition keeps at most k rows
of a group, so a group of any size arrives at its reducer as k rows per partition.

`full_rank` needs all positions. Rows are range-sorted by group and order, and positions are the row number
inside a range plus the number of rows in the ranges before it, so a group of any size spreads over ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from relrank.session import materialize


def id_order(column: str = "product_id", mode: str = "numeric") -> Column:
    """Tie-break on the id: `numeric` (9 before 10) or `string` (10 before 9)."""
    if mode not in ("numeric", "string"):
        raise ValueError(f"Unknown tie mode: {mode}")
    c = F.col(column)
    return (c if mode == "numeric" else c.cast("string")).asc()


def by_score(score: str = "score", tie: str = "numeric") -> list[Column]:
    return [F.col(score).desc(), id_order(mode=tie)]


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    if k <= 0:
        raise ValueError("k must be greater than zero.")
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def prefix_sum(df: DataFrame, keys: list[str], order: list[Column], weight: str, out: str) -> DataFrame:
    """Exact running sum of `weight` per group in the given order, for groups of any size.

    The order must be total within a group. Rows are range-partitioned by (keys, order); the ranges
    are written once, so that their numbers are the same wherever they are read.
    """
    ranged = materialize(
        df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn(
            "_range", F.spark_partition_id()
        ),
        "ranges",
    )
    totals = ranged.groupBy(*keys, "_range").agg(F.sum(weight).alias("_total"))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset")
    )
    inside = W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = F.sum(weight).over(inside)
    return (
        ranged.join(offsets, [*keys, "_range"])
        .withColumn(out, F.col("_offset") + local)
        .drop("_range", "_offset")
    )


def full_rank(df: DataFrame, keys: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """Every row's position in its group (long). The order must be total within a group."""
    return full_ranks(df, keys, {rank: order})


def full_ranks(df: DataFrame, keys: list[str], orders: dict[str, list[Column]]) -> DataFrame:
    """Several rankings of the same groups side by side. Rows are written first: every range sort samples its input."""
    out = materialize(df.withColumn("_one", F.lit(1).cast("long")), "to-rank")
    for rank, order in orders.items():
        out = prefix_sum(out, keys, order, "_one", rank)
    return out.drop("_one")
