"""Recall, reciprocal rank, NDCG and average precision under three evaluation families.

| family     | recall denominator          | ideal order of           | AP denominator          |
|------------|-----------------------------|--------------------------|-------------------------|
| list       | relevant in the given list  | the list's top k         | relevant in top k       |
| retrieved  | relevant in the truth       | the list's top k         | relevant in truth, <= k |
| candidates | relevant in the truth       | the truth's best k       | relevant in truth, <= k |

Only ranks up to the largest cutoff enter a window, so a group's size does not matter; everything
else about a group is a count per grade, combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from relrank.functions.numeric import ratio

FAMILIES = ("list", "retrieved", "candidates")
FIXED_CUTOFF = 10  # MRR and MAP use this cutoff when several are asked for


def cutoffs(ks) -> list[int]:
    values = sorted({int(k) for k in ks})
    if not values:
        raise ValueError("At least one k is required.")
    if values[0] <= 0:
        raise ValueError("All k must be greater than zero.")
    return values


def gain(grade: Column) -> Column:
    return F.pow(F.lit(2.0), grade.cast("double")) - 1.0


def discounted(grade: Column, rank: Column) -> Column:
    return gain(grade) / F.log2(rank + 1.0)


def ideal_dcg(grades: Column, k: int) -> Column:
    """DCG@k of an array of grades in descending order."""
    best = F.slice(grades, 1, k)
    return F.aggregate(
        F.transform(best, lambda g, i: discounted(g, i + 1)), F.lit(0.0), lambda acc, x: acc + x
    )


def truth_summary(truth: DataFrame, keys: list[str], k: int, grade: str = "relevance_score") -> DataFrame:
    """Per group: rows, relevant rows, and the k best grades in order.

    Counted per (group, grade) first; the repeated grades are cut at k, so the array stays short.
    """
    counts = truth.groupBy(*keys, F.col(grade).cast("int").alias("g")).agg(F.count("*").alias("n"))
    repeated = F.array_repeat(F.col("g"), F.least(F.col("n"), F.lit(k)).cast("int"))
    return counts.groupBy(*keys).agg(
        F.sum("n").alias("candidates"),
        F.sum(F.when(F.col("g") > 0, F.col("n")).otherwise(0)).alias("total_relevant"),
        F.slice(F.sort_array(F.flatten(F.collect_list(repeated)), asc=False), 1, k).alias("best"),
    )


def evaluate_groups(
    ranked: DataFrame,
    family: str,
    ks=(10,),
    truth: DataFrame | None = None,
    keys: list[str] | None = None,
    truth_keys: list[str] | None = None,
    grade: str = "relevance_score",
) -> DataFrame:
    """One row of metrics per group.

    `ranked` holds `keys`, `rank` and a grade, at least down to the largest cutoff. Under `list`, it is
    the list itself, and its whole length counts for recall. The other families need the `truth`, the
    full graded candidate set; groups without truth are left out.
    """
    if family not in FAMILIES:
        raise ValueError(f"Unknown metric family: {family}")
    if family != "list" and truth is None:
        raise ValueError(f"The {family} family needs the full candidate grades.")
    keys = keys or ["query_id"]
    ks = cutoffs(ks)
    fixed = FIXED_CUTOFF if family == "retrieved" or len(ks) > 1 else ks[0]
    deepest = max([*ks, fixed])
    g = F.coalesce(F.col(grade).cast("int"), F.lit(0))
    top = ranked.filter(F.col("rank") <= deepest).select(
        *keys, F.col("rank").cast("int"), g.alias("g")
    )
    running = W.partitionBy(*keys).orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    hit = F.col("g") > 0
    top = top.withColumn("seen", F.sum(hit.cast("int")).over(running))

    def upto(k: int, condition: Column | None = None) -> Column:
        inside = F.col("rank") <= k
        return inside if condition is None else inside & condition

    aggregates = [
        F.min(F.when(upto(fixed, hit), F.col("rank"))).alias("first_hit"),
        F.coalesce(
            F.sum(F.when(upto(fixed, hit), F.col("seen") / F.col("rank"))), F.lit(0.0)
        ).alias("precision_sum"),
        F.count_if(upto(fixed, hit)).alias("top_relevant"),
    ]
    for k in ks:
        aggregates.append(F.count_if(upto(k, hit)).alias(f"hits_{k}"))
        aggregates.append(
            F.sum(F.when(upto(k), discounted(F.col("g"), F.col("rank"))).otherwise(0.0)).alias(f"dcg_{k}")
        )
        if family != "candidates":
            aggregates.append(
                F.sort_array(F.collect_list(F.when(upto(k), F.col("g"))), asc=False).alias(f"best_{k}")
            )
    rows = top.groupBy(*keys).agg(*aggregates)

    if family == "list":
        total = ranked.groupBy(*keys).agg(F.count_if(g > 0).alias("total_relevant"))
        rows = rows.join(total, keys)
        ap_base = F.col("top_relevant")
    else:
        on = truth_keys or [k for k in keys if k in truth.columns]
        rows = rows.join(truth_summary(truth, on, deepest, grade), on)
        ap_base = F.least(F.col("total_relevant"), F.lit(fixed))
    out = [F.col(k) for k in keys]
    for k in ks:
        best = F.col("best" if family == "candidates" else f"best_{k}")
        out.append(ratio(F.col(f"hits_{k}"), F.col("total_relevant")).alias(f"recall_at_{k}"))
        out.append(ratio(F.col(f"dcg_{k}"), ideal_dcg(best, k)).alias(f"ndcg_at_{k}"))
    out.append(F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)).alias("mrr_at_10"))
    out.append(ratio(F.col("precision_sum"), ap_base).alias("map_at_10"))
    return rows.select(*out)


def metric_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "_at_" in c]


def macro_average(per_group: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean of every metric over queries, with the number of queries. Rankings that share no query with the truth leave
    nothing to average: that is an error."""
    n = F.count("*")
    none = F.raise_error(F.lit("Rankings and ground truth share no query.")).cast("long")
    return per_group.groupBy(*(by or [])).agg(
        F.when(n > 0, n).otherwise(none).alias("queries_evaluated"),
        *[F.avg(c).alias(c) for c in metric_columns(per_group)],
    )
