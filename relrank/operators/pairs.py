"""Joins that build (query, candidate) pairs, with their cardinality guards."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relrank.session import materialize, materialize_parts

# The most that a written table, or a part of one, may hold to be broadcast whatever the session's own threshold is.
BROADCAST_BYTES = 32 << 20


def held_bytes(values: DataFrame) -> int:
    """Size of a table's rows: arrays of numbers by their length, everything else as text."""
    widths = {T.FloatType(): 4, T.DoubleType(): 8}
    sizes = []
    for f in values.schema:
        width = widths.get(f.dataType.elementType) if isinstance(f.dataType, T.ArrayType) else None
        text = F.octet_length(F.to_json(F.struct(f.name)))
        sizes.append(text if width is None else 8 + width * F.greatest(F.lit(0), F.coalesce(F.size(f.name), F.lit(0))))
    return values.agg(F.sum(sum(sizes, F.lit(0).cast("long")))).first()[0] or 0


def few(values: DataFrame, limit: int | None = None) -> DataFrame:
    """`values`, a written table, marked for broadcast if it is small: measured, so that the mark has a bound.

    A table of a megabyte is past the threshold of many sessions; the rows that it joins would be shuffled and sorted
    with all that they carry. A larger table is left to Spark's choice.
    """
    return F.broadcast(values) if n_parts(values, limit) == 1 else values


def n_parts(values: DataFrame, limit: int | None = None) -> int:
    """Into how many parts a written table has to go so that each may be broadcast."""
    return max(1, -(-held_bytes(values) // (BROADCAST_BYTES if limit is None else limit)))


def join_broadcast(
    rows: DataFrame, tables: dict[str, DataFrame], finish: Callable[[DataFrame], DataFrame], name: str,
    wide: DataFrame | None = None, key: str = "product_id",
) -> DataFrame:
    """`finish` of `rows` joined with `wide` on its key and then with each written table on the number that names it.

    What `wide` adds is never shuffled again: the tables are broadcast. Those that are too large for that are broadcast
    in parts, one after the other: rows are written before they are wide, each part of them meets its own part of the
    tables, and the results are added to one written table.
    """
    parts = {number: n_parts(values) for number, values in tables.items()}
    several = [number for number, n in parts.items() if n > 1]

    def part(number: str) -> Column:
        return F.pmod(F.xxhash64(number), F.lit(parts[number]))

    def joined(own: DataFrame, held: dict[str, DataFrame]) -> DataFrame:
        out = own if wide is None else own.join(wide, key, "left")
        for number, values in held.items():
            out = out.join(F.broadcast(values), number, "left")
        return finish(out)

    if not several:
        return joined(rows, tables)
    rows = materialize(rows.withColumns({f"_part_{number}": part(number) for number in several}), f"{name}-rows")
    if wide is not None:
        wide = materialize(wide, f"{name}-wide")

    def results() -> Iterator[DataFrame]:
        for chosen in product(*[range(parts[number]) for number in several]):
            own, held = rows, dict(tables)
            for number, k in zip(several, chosen):
                own = own.where(F.col(f"_part_{number}") == k)
                held[number] = tables[number].where(part(number) == k)
            yield joined(own.drop(*[f"_part_{number}" for number in several]), held)

    return materialize_parts(rows.sparkSession, results(), name)


@dataclass(frozen=True)
class SharedValues:
    """The distinct values of a column under numbers, and the number that each key's row holds."""

    ids: DataFrame
    values: DataFrame


def shared_values(rows: DataFrame, key: str, column: str, number: str) -> SharedValues:
    """`ids` is (key, number), `values` is (number, column); both are written and measured.

    What is wide about a key joins pairs once per distinct value, not once per key: pairs carry the number, and a table
    of values is broadcast, however many keys share them.
    """
    values = materialize(rows.select(column).distinct().withColumn(number, F.monotonically_increasing_id()), number)
    held = rows.select(key, F.col(column).alias("_held"))
    ids = held.join(few(values), F.col("_held").eqNullSafe(F.col(column)), "left").select(key, number)
    return SharedValues(few(materialize(ids, f"{number}-of-{key}")), values)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; an empty result proves an m:1 join on them."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    if not duplicate_keys(df, keys).isEmpty():
        raise ValueError(f"Join keys are not unique: {keys}")
    return df


def build_pairs(judgments: DataFrame, queries: DataFrame, products: DataFrame) -> DataFrame:
    """Judgments with query text and product fields; Spark picks broadcast or shuffle by size.

    A query or product id that occurs twice would multiply pairs and is an error.
    """
    require_unique(queries, ["query_id"])
    require_unique(products, ["product_id"])
    return judgments.join(queries.select("query_id", "query"), "query_id", "left").join(
        products, "product_id", "left"
    )


def input_checks(judgments: DataFrame, queries: DataFrame, products: DataFrame) -> DataFrame:
    """Rows a retrieval run cannot score: unknown query, unknown product, product without a name.

    Rows are counted per key before the joins, so that a frequent key is one row in them.
    """
    per_query = judgments.groupBy("query_id").agg(F.count("*").alias("n"))
    unknown_query = per_query.join(queries.select("query_id"), "query_id", "left_anti").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("violations")
    )
    per_product = judgments.groupBy("product_id").agg(F.count("*").alias("n"))
    known = products.select(
        "product_id", F.col("product_name").isNotNull().alias("named"), F.lit(True).alias("known")
    )

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    counts = (
        per_product.join(known, "product_id", "left")
        .agg(
            total(F.col("known").isNull()).alias("unknown"),
            total(F.col("known") & ~F.col("named")).alias("unnamed"),
        )
        .select(
            F.expr(
                "stack(2, 'candidate_known', unknown, 'candidate_named', unnamed) as (check, violations)"
            )
        )
    )
    rows = unknown_query.select(F.lit("query_known").alias("check"), "violations").unionByName(counts)
    return rows.withColumn("status", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL"))


def attach_grades(ranking: DataFrame, judgments: DataFrame) -> DataFrame:
    """Ranking joined to the judged grade on (query, product)."""
    truth = judgments.select("query_id", "product_id", F.col("relevance_score").cast("int"))
    return ranking.join(truth, ["query_id", "product_id"], "left")
