"""Connected components of an edge table by alternating star contractions (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relrank.session import materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("s")).first()
    return row["n"], row["s"]


def _small_star(edges: DataFrame) -> DataFrame:
    """Ties every node a and its smaller neighbours b to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
    return edges.join(least, "a").select(F.explode(tied)).select("col.a", "col.b").where("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Ties every node's larger neighbours to the smallest node among it and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    tied = both.where("b > a").join(least, "a")
    return tied.select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node with an edge, the smallest node that can be reached from it.

    `edges` has two long columns a and b; loops, repeated edges and nulls are allowed and change nothing. Every round
    is written out, so a lost executor costs one round at most.
    """
    tidy = edges.where("a is not null and b is not null and a <> b")
    tidy = tidy.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = materialize(_small_star(tidy), "edges")
    before = _state(current)
    while before[0]:
        current = materialize(_small_star(_large_star(current)), "edges")
        after = _state(current)
        if after == before:
            break
        before = after
    roots = current.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
