"""Model comparison and error analysis over one frame of scored pairs.

`scored` has query_id, product_id, relevance_score, exact_match, category_hierarchy and one
`<model>_score` column per model. Every report works on the top k of each (model, query), on counts
per query, or on full ranks where those are the report.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relrank.functions import category
from relrank.functions import text as tx
from relrank.functions.numeric import report as rounded
from relrank.operators import metrics, ranking

# --- fixed values -----------------------------------------------------------------
STRING_TIES = ("bm25", "semantic")  # retrievers that break ties on the id as text
TOLERANCE = 1e-12
TOP = 10
SUCCESS_ROWS = 25
NDCG_DIGITS = 12  # equal lists give equal values, whatever order their terms are added in
# ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Models:
    names: tuple[str, ...] = ("tfidf", "bm25", "semantic", "blend")
    challenger: str = "blend"
    baseline: str = "bm25"

    @property
    def delta(self) -> str:
        return f"{self.challenger}_minus_{self.baseline}"


def long_scores(scored: DataFrame, models: tuple[str, ...], carried: list[str]) -> DataFrame:
    """One row per (model, pair)."""
    entries = [
        F.struct(F.lit(m).alias("model"), F.col(f"{m}_score").alias("score")) for m in models
    ]
    return scored.select("query_id", "product_id", *carried, F.inline(F.array(*entries)))


def retrieval_order() -> list[Column]:
    """Score, then each retriever's own tie-break."""
    as_text = F.when(F.col("model").isin(*STRING_TIES), F.col("product_id").cast("string"))
    return [F.col("score").desc(), as_text.asc(), F.col("product_id").asc()]


def top_lists(scored: DataFrame, models: tuple[str, ...], k: int) -> DataFrame:
    """`(model, query_id, product_id, score, rank, relevance_score)`, k rows per list."""
    rows = long_scores(scored, models, ["relevance_score"])
    return ranking.top_k(rows, ["model", "query_id"], retrieval_order(), k)


def compare(
    scored: DataFrame,
    models: tuple[str, ...],
    family: str,
    ks=(TOP,),
    depth: int = TOP,
) -> DataFrame:
    """One row of macro-averaged metrics per model; all models in one pass."""
    lists = top_lists(scored, models, depth)
    per_query = metrics.evaluate_groups(
        lists,
        family,
        ks,
        truth=scored.select("query_id", "relevance_score"),
        keys=["model", "query_id"],
        truth_keys=["query_id"],
    )
    out = metrics.macro_average(per_query, ["model"])
    return out.select(
        "model", "queries_evaluated", *[rounded(F.col(c)).alias(c) for c in metrics.metric_columns(out)]
    )


def list_ndcg(scored: DataFrame, models: tuple[str, ...], keys: list[str]) -> DataFrame:
    """List-family NDCG@10 per group, one column per model; ties go to the smaller id."""
    carried = ["relevance_score", *[k for k in keys if k != "query_id"]]
    rows = long_scores(scored, models, carried)
    top = ranking.top_k(rows, ["model", *keys], ranking.by_score(), TOP)
    per_group = metrics.evaluate_groups(top, "list", (TOP,), keys=["model", *keys])
    return per_group.groupBy(*keys).agg(
        *[
            F.round(F.max(F.when(F.col("model") == m, F.col("ndcg_at_10"))), NDCG_DIGITS).alias(
                f"{m}_ndcg"
            )
            for m in models
        ]
    )


def model_ranks(scored: DataFrame, models: tuple[str, ...]) -> DataFrame:
    """Every model's full rank of every pair; ties go to the smaller id. All models are sorted at once, as narrow rows."""
    entries = [F.struct(F.lit(k).alias("model"), F.col(f"{m}_score").alias("score")) for k, m in enumerate(models)]
    narrow = scored.select("query_id", "product_id", F.explode(F.array(*entries)).alias("s")).select("query_id", "product_id", "s.*")
    ranked = ranking.full_rank(narrow, ["query_id", "model"], ranking.by_score())
    ranks = {f"{m}_rank": F.max(F.when(F.col("model") == k, F.col("rank"))) for k, m in enumerate(models)}
    wide = ranked.groupBy("query_id", "product_id").agg(*[r.alias(name) for name, r in ranks.items()])
    return scored.join(wide, ["query_id", "product_id"]).select(*scored.columns, *ranks)


def query_report(scored: DataFrame, queries: DataFrame, models: Models | None = None) -> DataFrame:
    m = models or Models()
    grade = F.col("relevance_score")
    counts = scored.groupBy("query_id").agg(
        F.count("*").alias("candidate_count"),
        F.count_if(grade > 0).alias("relevant_count"),
        F.count_if(grade == 2).alias("exact_count"),
        F.count_if(grade == 1).alias("partial_count"),
        F.max("exact_match").alias("any_exact_match"),
    )
    length = F.size(tx.space_tokens(F.col("query")))
    bucket = F.when(length <= 2, "short").when(length <= 5, "medium").otherwise("long")
    kind = (
        F.when(F.col("any_exact_match") > 0, "exact_product_match")
        .when(length <= 2, "short")
        .when(length >= 6, "long")
        .otherwise("general")
    )
    challenger = F.col(f"{m.challenger}_ndcg")
    others = [x for x in m.names if x != m.challenger]
    deltas = {f"{m.challenger}_minus_{x}": challenger - F.col(f"{x}_ndcg") for x in others}
    delta = F.col(m.delta)
    relation = (
        F.when(delta > TOLERANCE, f"{m.challenger}_better")
        .when(delta < -TOLERANCE, f"{m.baseline}_better")
        .otherwise("tie")
    )
    return (
        counts.join(list_ndcg(scored, m.names, ["query_id"]), "query_id")
        .join(queries.select("query_id", "query"), "query_id", "left")
        .withColumns(deltas)
        .select(
            "query_id",
            "query",
            length.alias("query_length_tokens"),
            bucket.alias("query_length_bucket"),
            kind.alias("query_type"),
            "candidate_count",
            "relevant_count",
            "exact_count",
            "partial_count",
            *[f"{x}_ndcg" for x in m.names],
            *deltas,
            relation.alias("relation"),
        )
    )


def success_cases(queries: DataFrame, models: Models | None = None, rows: int = SUCCESS_ROWS) -> DataFrame:
    m = models or Models()
    return (
        queries.filter(F.col(m.delta) > 0)
        .orderBy(rounded(F.col(m.delta)).desc(), "query_id")
        .limit(rows)
    )


def loss_cases(queries: DataFrame, models: Models | None = None) -> DataFrame:
    m = models or Models()
    return queries.filter(F.col(m.delta) < 0).orderBy(F.col(m.delta).asc(), "query_id")


def failure_cases(ranks: DataFrame, queries: DataFrame, models: Models | None = None) -> DataFrame:
    """Irrelevant products inside the challenger's top ten, relevant ones below it."""
    m = models or Models()
    rank, grade = F.col(f"{m.challenger}_rank"), F.col("relevance_score")
    kind = F.when((rank <= TOP) & (grade == 0), "irrelevant_in_top10").when(
        (rank > TOP) & (grade > 0), "relevant_below_top10"
    )
    return (
        ranks.withColumn("failure_type", kind)
        .filter(F.col("failure_type").isNotNull())
        .join(queries.select("query_id", "query"), "query_id", "left")
        .select(
            "failure_type",
            "query_id",
            "query",
            "product_id",
            "relevance_score",
            rank,
            f"{m.challenger}_score",
            f"{m.baseline}_rank",
            "tfidf_rank",
        )
    )


def means_by(queries: DataFrame, column: str, models: Models | None = None) -> DataFrame:
    m = models or Models()
    averaged = [*[f"{x}_ndcg" for x in m.names], m.delta]
    return queries.groupBy(column).agg(
        F.count("*").alias("queries"), *[rounded(F.avg(c)).alias(c) for c in averaged]
    )


def with_category(scored: DataFrame) -> DataFrame:
    return scored.withColumn("category", category.top_level(F.col("category_hierarchy")))


def category_report(scored: DataFrame, models: Models | None = None) -> DataFrame:
    """NDCG per (category, query), re-ranked inside the category, then averaged per category."""
    m = models or Models()
    rows = with_category(scored)
    grade = F.col("relevance_score")
    counts = (
        rows.groupBy("category", "query_id")
        .agg(F.count("*").alias("n"), F.count_if(grade > 0).alias("relevant"))
        .groupBy("category")
        .agg(
            F.count("*").alias("queries"),
            F.sum("n").alias("candidates"),
            F.sum("relevant").alias("relevant_candidates"),
        )
    )
    pair = (m.challenger, m.baseline)
    c, b = (F.col(f"{x}_ndcg") for x in pair)
    scores = (
        list_ndcg(rows, pair, ["category", "query_id"])
        .groupBy("category")
        .agg(
            rounded(F.avg(c)).alias(f"{m.challenger}_ndcg"),
            rounded(F.avg(b)).alias(f"{m.baseline}_ndcg"),
            rounded(F.avg(c - b)).alias(m.delta),
        )
    )
    return counts.join(scores, "category")


def ambiguous_queries(scored: DataFrame, queries: DataFrame, models: Models | None = None) -> DataFrame:
    """Queries whose relevant products span at least two top-level categories.

    The collected set holds category names, so its size is that of the category list, not of the query.
    """
    m = models or Models()
    spans = (
        with_category(scored)
        .filter(F.col("relevance_score") > 0)
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_set("category")).alias("categories"))
        .filter(F.size("categories") >= 2)
    )
    return queries.join(spans, "query_id").select(
        "query_id",
        "query",
        F.size("categories").alias("relevant_category_count"),
        F.array_join("categories", " | ").alias("relevant_categories"),
        "candidate_count",
        "relevant_count",
        f"{m.baseline}_ndcg",
        f"{m.challenger}_ndcg",
        m.delta,
    )


def confusion(scored: DataFrame, models: Models | None = None) -> DataFrame:
    """True and false positives and negatives when a model's top ten count as predicted relevant."""
    m = models or Models()
    rows = long_scores(scored, m.names, ["relevance_score"])
    top = ranking.top_k(rows, ["model", "query_id"], ranking.by_score(), TOP)
    grade = F.col("relevance_score")
    inside = top.groupBy("model").agg(
        F.count_if(grade > 0).alias("true_positive"), F.count_if(grade <= 0).alias("false_positive")
    )
    totals = scored.agg(F.count_if(grade > 0).alias("relevant"), F.count("*").alias("n"))
    relevant = totals.select("relevant").scalar()
    irrelevant = totals.select((F.col("n") - F.col("relevant")).alias("x")).scalar()
    return inside.select(
        "model",
        "true_positive",
        "false_positive",
        (relevant - F.col("true_positive")).alias("false_negative"),
        (irrelevant - F.col("false_positive")).alias("true_negative"),
    )


def win_loss(queries: DataFrame, models: Models | None = None) -> DataFrame:
    """Counts at exact zero, unlike the per-query relation, which has a tolerance."""
    m = models or Models()
    delta = F.col(m.delta)
    return queries.agg(
        F.count_if(delta > 0).alias("challenger_better"),
        F.count_if(delta < 0).alias("baseline_better"),
        F.count_if(delta == 0).alias("ties"),
        *[rounded(F.avg(f"{x}_ndcg")).alias(f"mean_{x}_ndcg") for x in m.names],
    )


def summary(
    queries: DataFrame, failures: DataFrame, ambiguous: DataFrame, models: Models | None = None
) -> DataFrame:
    """One row: totals, mean NDCG per model, and the sizes of the case reports."""
    m = models or Models()
    base = queries.agg(
        F.count("*").alias("test_queries"),
        F.sum("candidate_count").alias("test_candidates"),
        F.least(F.count_if(F.col(m.delta) > 0), F.lit(SUCCESS_ROWS)).alias("success_case_count"),
        F.count_if(F.col(m.delta) > 0).alias("challenger_better"),
        F.count_if(F.col(m.delta) < 0).alias("baseline_better"),
        F.count_if(F.col(m.delta) == 0).alias("ties"),
        *[rounded(F.avg(f"{x}_ndcg")).alias(f"mean_{x}_ndcg") for x in m.names],
    )
    n_failures = failures.agg(F.count("*").alias("n")).scalar()
    n_ambiguous = ambiguous.agg(F.count("*").alias("n")).scalar()
    return base.withColumns(
        {"failure_case_count": n_failures, "ambiguous_query_count": n_ambiguous}
    )
