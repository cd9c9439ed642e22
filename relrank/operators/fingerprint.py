"""Content fingerprints of tables and the decision whether stored results can be reused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LANE = 8  # hex digits of a row hash that are summed together


def encoded(df: DataFrame, columns: list[str]):
    """The columns as one text, in which no two different rows are alike: a value follows its length, a null is `n`, an
    array follows its size, element by element.

    A fraction is its nine decimals and what it lacks to them in units of 1e-24, which no two doubles of 1e-8 or more
    have in common.
    """
    return F.concat(*[_field(F.col(c), df.schema[c].dataType) for c in columns])


def _field(c, kind: T.DataType):
    if isinstance(kind, T.ArrayType):
        whole = F.array_join(F.transform(c, lambda v: _field(v, kind.elementType)), "")
        return F.coalesce(F.concat(F.lit("["), F.size(c).cast("string"), F.lit(":"), whole), F.lit("n"))
    text = c.cast("string")
    if kind.typeName() in ("double", "float"):
        near = F.round(c.cast("double"), 9)
        number = ~F.isnan(c) & (F.abs(c) < 1e28)
        lacks = F.round((c.cast("double") - near) * 1e24).cast("decimal(38,0)").cast("string")
        exact = F.concat(F.when(number, near).cast("decimal(38,9)").cast("string"), F.lit("r"), F.when(number, lacks))
        text = F.coalesce(exact, text)
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("n"))


def lanes(digest, digits: int):
    """Sums of all parts of a hex digest, joined: independent of row order and combined before the shuffle."""
    parts = [
        F.coalesce(F.sum(F.conv(F.substring(digest, i + 1, LANE), 16, 10).cast("decimal(20,0)")), F.lit(0))
        for i in range(0, digits, LANE)
    ]
    return F.concat_ws(":", *[p.cast("decimal(38,0)").cast("string") for p in parts])


def fingerprint(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Row count and order-insensitive content hash of one table."""
    hashed = df.select(F.md5(encoded(df, columns)).alias("h"))
    return hashed.agg(F.count("*").alias("row_count"), lanes("h", 32).alias("content")).select(F.lit(name).alias("name"), "row_count", "content")


def fingerprints(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    rows = [fingerprint(df, name, columns) for name, (df, columns) in tables.items()]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


def combined(prints: DataFrame, settings: str = "") -> DataFrame:
    """One fingerprint over all inputs and the settings; there is one row per input table."""
    entries = F.array_sort(F.collect_list(F.concat_ws("=", "name", "row_count", "content")))
    return prints.agg(F.sha2(F.concat(F.lit(settings), F.array_join(entries, ";")), 256).alias("fingerprint"))


def reuse_decision(
    stored_inputs: DataFrame,
    current_inputs: DataFrame,
    stored_outputs: DataFrame,
    current_outputs: DataFrame,
) -> DataFrame:
    """One row `(reusable, reason)`. The first failing test, in the listed order, gives the reason."""

    def differing(a: DataFrame, b: DataFrame) -> DataFrame:
        left = a.select("name", F.struct("row_count", "content").alias("a"))
        right = b.select("name", F.struct("row_count", "content").alias("b"))
        return left.join(right, "name", "full_outer")

    inputs = differing(stored_inputs, current_inputs).agg(
        F.count("a").alias("stored"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("inputs")
    )
    outputs = differing(stored_outputs, current_outputs).agg(
        F.count_if(F.col("b").isNull() | (F.col("b.row_count") == 0)).alias("missing"),
        F.min(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("name"))).alias("changed"),
    )
    both = inputs.select(
        "stored",
        "inputs",
        outputs.select("missing").scalar().alias("missing"),
        outputs.select("changed").scalar().alias("changed"),
    )
    reason = (
        F.when(F.col("stored") == 0, "feature_manifest_missing")
        .when(F.col("inputs") > 0, "fingerprint_mismatch")
        .when(F.col("missing") > 0, "feature_artifact_missing_or_empty")
        .when(F.col("changed").isNotNull(), F.concat(F.lit("artifact_changed:"), F.col("changed")))
        .otherwise("cache_hit")
    )
    return both.select((reason == "cache_hit").alias("reusable"), reason.alias("reason"))
