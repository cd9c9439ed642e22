"""Exact percentiles with linear interpolation, for value sets of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relrank.operators import ranking
from relrank.session import materialize


def quantiles(
    values: DataFrame,
    keys: list[str],
    points: dict[str, float],
    value: str = "value",
) -> DataFrame:
    """One row per group with a column per point (a fraction between 0 and 1).

    Values are counted first; positions come from a distributed running count of the distinct values.
    """
    counts = (
        values.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("v"))
        .agg(F.count("*").alias("n"))
    )
    counts = materialize(counts, "value-counts")  # read by the range sort, its sample and the totals
    running = ranking.prefix_sum(counts, keys, [F.col("v").asc()], "n", "through")
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    placed = running.join(totals, keys) if keys else running.withColumn(
        "total", totals.select("total").scalar()
    )
    found = []
    for name, p in points.items():
        at = (F.col("total") - 1) * F.lit(float(p))
        low = F.floor(at)
        high = F.least(low + 1, F.col("total") - 1)
        found.append(F.min(F.when(F.col("through") > low, F.col("v"))).alias(f"{name}_low"))
        found.append(F.min(F.when(F.col("through") > high, F.col("v"))).alias(f"{name}_high"))
        found.append(F.min(at - low).alias(f"{name}_part"))
    rows = placed.groupBy(*keys).agg(*found)
    return rows.select(
        *keys,
        *[
            (
                F.col(f"{name}_low")
                + (F.col(f"{name}_high") - F.col(f"{name}_low")) * F.col(f"{name}_part")
            ).alias(name)
            for name in points
        ],
    )


def describe(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """count, mean, std, min, quartiles and max per group."""
    v = F.col(value).cast("double")
    moments = values.groupBy(*keys).agg(
        F.count(v).alias("count"),
        F.round(F.avg(v), 6).alias("mean"),
        F.round(F.stddev_samp(v), 6).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    quartiles = quantiles(values, keys, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, value)
    rounded = quartiles.select(*keys, *[F.round(c, 6).alias(c) for c in ("p25", "p50", "p75")])
    return moments.join(rounded, keys, "left")


def histogram(values: DataFrame, keys: list[str], bins: int = 30, value: str = "value") -> DataFrame:
    """`keys` name the described column. Equal-width bins between a group's smallest and largest value; the last bin is closed."""
    v = F.col(value).cast("double")
    present = values.filter(v.isNotNull()).select(*keys, v.alias("v"))
    ends = present.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    place = F.floor((F.col("v") - F.col("lo")) / F.nullif(width, F.lit(0.0)))
    # Counted per distinct value first, so that the join with the ends carries counts, not rows.
    # The ends have one row per described column, which bounds what is broadcast.
    counted = present.groupBy(*keys, "v").agg(F.count("*").alias("n"))
    return (
        counted.join(F.broadcast(ends), keys)
        .withColumn("bin", F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int"))
        .groupBy(*keys, "bin", F.round(F.col("lo") + F.col("bin") * width, 6).alias("lower"))
        .agg(F.sum("n").alias("count"))
    )
