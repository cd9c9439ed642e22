"""Data-quality checks. Every suite returns rows (check, status, violations, detail); none raises.

A table's value checks share one aggregate. Only uniqueness and foreign keys need their own shuffle,
and those count per key before anything is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relrank import schema as S
from relrank.functions import text as tx

COLUMNS = "check string, status string, violations bigint, detail string"

# --- fixed values -----------------------------------------------------------------
CLEANING_RESOLVES = ["query_product_pair_label_consistency"]
# ----------------------------------------------------------------------------------


def _row(check: str, violations: Column, bad: str = "FAIL", detail: Column | None = None) -> Column:
    return F.struct(
        F.lit(check).alias("check"),
        F.when(violations > 0, bad).otherwise("PASS").alias("status"),
        violations.cast("bigint").alias("violations"),
        (F.lit("") if detail is None else detail).cast("string").alias("detail"),
    )


def _rows(counts: DataFrame, rows: list[Column]) -> DataFrame:
    return counts.select(F.inline(F.array(*rows)))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def _columns_row(df: DataFrame, required: list[str], table: str) -> tuple[DataFrame, bool]:
    missing = sorted(set(required) - set(df.columns))
    row = df.sparkSession.range(1).select(
        F.lit(f"{table}_required_columns").alias("check"),
        F.lit("FAIL" if missing else "PASS").alias("status"),
        F.lit(len(missing)).cast("bigint").alias("violations"),
        F.lit(", ".join(missing)).alias("detail"),
    )
    return row, not missing


def _listed(columns: list[str], prefix: str) -> Column:
    """`column=count` for every column with a count, in sorted column order."""
    return F.concat_ws(
        ", ",
        *[
            F.when(
                F.col(f"{prefix}{c}") > 0,
                F.concat(F.lit(f"{c}="), F.col(f"{prefix}{c}").cast("string")),
            )
            for c in sorted(columns)
        ],
    )


def _total(columns: list[str], prefix: str) -> Column:
    out = F.lit(0)
    for c in columns:
        out = out + F.col(f"{prefix}{c}")
    return out


def _counts(df: DataFrame, blanks: list[str], nulls: list[str]) -> DataFrame:
    return df.agg(
        F.count("*").alias("n"),
        *[F.count_if(tx.is_blank(F.col(c))).alias(f"blank_{c}") for c in blanks],
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in nulls],
    )


def _empty(table: str) -> Column:
    return _row(
        f"{table}_not_empty", (F.col("n") == 0).cast("bigint"), detail=F.col("n").cast("string")
    )


def unique_ids(df: DataFrame, column: str, check: str) -> DataFrame:
    """Counts all rows of repeated ids, not only the surplus."""
    repeated = df.groupBy(column).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    counts = repeated.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    return _rows(counts, [_row(check, F.col("rows"))])


def foreign_key_values(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Distinct non-null child values that the parent lacks."""
    values = child.select(key).filter(F.col(key).isNotNull()).distinct()
    return values.join(parent.select(key), key, "left_anti")


def foreign_key(child: DataFrame, parent: DataFrame, key: str, check: str) -> DataFrame:
    counts = foreign_key_values(child, parent, key).agg(F.count("*").alias("n"))
    return _rows(counts, [_row(check, F.col("n"))])


def check_queries(df: DataFrame) -> DataFrame:
    first, complete = _columns_row(df, S.QUERY_COLUMNS, "query")
    if not complete:
        return first
    required = ["query_id", "query"]
    values = _rows(
        _counts(df, required, ["query_class"]),
        [
            _empty("query"),
            _row(
                "query_required_values",
                _total(required, "blank_"),
                detail=_listed(required, "blank_"),
            ),
            _row("query_query_not_empty", F.col("blank_query")),
            _row("query_query_class_missing", F.col("null_query_class"), "WARN"),
        ],
    )
    return _union([first, values, unique_ids(df, "query_id", "query_query_id_unique")])


def check_products(df: DataFrame) -> DataFrame:
    first, complete = _columns_row(df, S.PRODUCT_COLUMNS, "product")
    if not complete:
        return first
    required = ["product_id", "product_name"]
    optional = [c for c in df.columns if c not in required]
    values = _rows(
        _counts(df, required, optional),
        [
            _empty("product"),
            _row(
                "product_required_values",
                _total(required, "blank_"),
                detail=_listed(required, "blank_"),
            ),
            _row("product_product_name_not_empty", F.col("blank_product_name")),
            _row(
                "product_optional_missing_values",
                _total(optional, "null_"),
                "WARN",
                _listed(optional, "null_"),
            ),
        ],
    )
    return _union([first, values, unique_ids(df, "product_id", "product_product_id_unique")])


LISTED_LABELS = 20  # invalid labels that the check row names, in order; it counts them all


def invalid_labels(df: DataFrame) -> DataFrame:
    """Every label outside the scale with its row count; null is one of them."""
    known = F.coalesce(F.col("label").isin(*S.LABEL_GRADES), F.lit(False))
    return df.filter(~known).groupBy("label").agg(F.count("*").alias("rows"))


def pair_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("query_id", "product_id").agg(
        F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")
    )


def duplicate_pairs(df: DataFrame) -> DataFrame:
    keyed = F.col("query_id").isNotNull() & F.col("product_id").isNotNull()
    counts = (
        pair_counts(df)
        .filter(F.col("n") > 1)
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.count("*").alias("pairs"),
            F.count_if(keyed & (F.col("low") != F.col("high"))).alias("conflicts"),
        )
    )
    rows = _rows(
        counts,
        [
            _row(
                "query_product_pair_unique",
                F.col("rows"),
                "WARN",
                F.when(F.col("pairs") > 0, F.concat(F.lit("pairs="), F.col("pairs").cast("string"))).otherwise(""),
            ),
            F.when(F.col("pairs") > 0, _row("query_product_pair_label_consistency", F.col("conflicts"))),
        ],
    )
    # Consistency is only reported where there are repeated pairs.
    return rows.filter(F.col("check").isNotNull())


def check_labels(df: DataFrame) -> DataFrame:
    first, complete = _columns_row(df, S.LABEL_COLUMNS, "label")
    if not complete:
        return first
    required = S.LABEL_COLUMNS
    values = _rows(
        _counts(df, required, []),
        [
            _empty("label"),
            _row(
                "label_required_values",
                _total(required, "blank_"),
                detail=_listed(required, "blank_"),
            ),
        ],
    )
    found = invalid_labels(df)
    named = found.filter(F.col("label").isNotNull()).orderBy("label").limit(LISTED_LABELS)
    names = named.agg(F.array_join(F.sort_array(F.collect_list("label")), ",").alias("names"))
    invalid = found.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count("label").alias("values")
    ).withColumn("names", names.scalar())
    valid = _rows(
        invalid,
        [
            _row(
                "labels_valid",
                F.col("rows"),
                detail=F.when(
                    F.col("rows") > 0, F.concat_ws(":", F.concat(F.lit("values="), F.col("values").cast("string")), "names")
                ).otherwise(""),
            )
        ],
    )
    return _union(
        [first, values, valid, unique_ids(df, "id", "judgment_id_unique"), duplicate_pairs(df)]
    )


def check_all(queries: DataFrame, products: DataFrame, labels: DataFrame) -> DataFrame:
    """The full suite. Foreign keys run whenever both id columns exist, whatever else is missing."""
    frames = [check_queries(queries), check_products(products), check_labels(labels)]
    if "query_id" in labels.columns and "query_id" in queries.columns:
        frames.append(foreign_key(labels, queries, "query_id", "foreign_key_label_query_id"))
    if "product_id" in labels.columns and "product_id" in products.columns:
        frames.append(foreign_key(labels, products, "product_id", "foreign_key_label_product_id"))
    return _union(frames)


def summary(checks: DataFrame) -> DataFrame:
    status = F.col("status")
    return checks.agg(
        F.count("*").alias("total_checks"),
        F.count_if(status == "PASS").alias("passed_checks"),
        F.count_if(status == "FAIL").alias("failed_checks"),
        F.count_if(status == "WARN").alias("warning_checks"),
    ).withColumn("valid", F.col("failed_checks") == 0)


def gate(checks: DataFrame) -> DataFrame:
    """Failures, split into those that block and those that cleaning resolves."""
    resolvable = F.col("check").isin(*CLEANING_RESOLVES)
    return checks.filter(F.col("status") == "FAIL").select(
        "check",
        "violations",
        F.when(resolvable, "resolved_by_cleaning").otherwise("blocking").alias("effect"),
    )


def require_valid(checks: DataFrame) -> None:
    """Stops on blocking failures. There are at most as many rows as checks."""
    blocking = [r["check"] for r in gate(checks).filter(F.col("effect") == "blocking").collect()]
    if blocking:
        raise ValueError("Data validation failed: " + ", ".join(sorted(blocking)))


def prediction_checks(rankings: DataFrame, truth: DataFrame) -> DataFrame:
    """Rankings against judged candidates, per model: query sets, duplicates, unknown products."""
    models = rankings.select("model").distinct()
    judged = truth.select("query_id").distinct()
    predicted = rankings.groupBy("model", "query_id").agg(F.count("*").alias("n"))
    # Queries without a ranking: judged queries minus those the model ranked that are judged.
    n_judged = judged.agg(F.count("*").alias("n")).scalar()
    matched = predicted.join(judged.withColumn("judged", F.lit(True)), "query_id", "left")
    per_model = matched.groupBy("model").agg(
        (n_judged - F.count("judged")).alias("missing"),
        F.count_if(F.col("judged").isNull()).alias("extra"),
    )
    duplicates = (
        rankings.groupBy("model", "query_id", "product_id")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > 1)
        .groupBy("model")
        .agg(F.count("*").alias("duplicates"))
    )
    unknown = (
        rankings.join(truth.select("query_id", "product_id"), ["query_id", "product_id"], "left_anti")
        .groupBy("model")
        .agg(F.count("*").alias("unknown"))
    )
    rows = (
        models.join(per_model, "model", "left")
        .join(duplicates, "model", "left")
        .join(unknown, "model", "left")
    )
    names = {
        "queries_without_ranking": "missing",
        "unknown_queries": "extra",
        "duplicate_products": "duplicates",
        "unknown_products": "unknown",
    }
    checks = [
        F.struct(
            F.lit(name).alias("check"),
            F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias("violations"),
        )
        for name, c in names.items()
    ]
    return rows.select("model", F.inline(F.array(*checks))).withColumn(
        "status", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL")
    )
