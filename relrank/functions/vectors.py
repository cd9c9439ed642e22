"""Dense and sparse vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays of doubles."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x
    )


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine with norms computed once per vector; zero when a vector has no length."""
    scale = norm_a * norm_b
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(scale, F.lit(0.0)))


def sparse_dot(terms: Column, weights: Column) -> Column:
    """Dot product of `array<struct<term, weight>>` with `map<term, weight>`; missing terms are zero.

    Entries of the array are added one by one, so a term listed twice counts twice.
    """
    total = F.aggregate(
        terms,
        F.lit(0.0),
        lambda acc, x: acc + x["weight"] * F.coalesce(F.try_element_at(weights, x["term"]), F.lit(0.0)),
    )
    return F.coalesce(total, F.lit(0.0))
