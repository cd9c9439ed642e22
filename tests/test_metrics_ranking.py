import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from relrank.operators import metrics, percentiles, ranking


def frame(spark, lists):
    rows = [(q, i + 1, g) for q, grades in enumerate(lists) for i, g in enumerate(grades)]
    return spark.createDataFrame(rows, "query_id long, rank int, relevance_score int")


def test_candidates_recall_and_ap(spark):
    ranked = frame(spark, [[2, 0, 0]])
    truth = frame(spark, [[2, 1, 0, 0, 0]])
    row = metrics.evaluate_groups(ranked, "candidates", (3,), truth=truth).first()
    assert row["recall_at_3"] == 0.5 and row["mrr_at_10"] == 1.0 and row["map_at_10"] == 0.5


def test_ap_five_sixths(spark):
    lists = frame(spark, [[2, 0, 1]])
    row = metrics.evaluate_groups(lists, "candidates", (3,), truth=lists).first()
    assert math.isclose(row["map_at_10"], 5 / 6)


def test_retrieved_counts_all_relevant(spark):
    ranked = frame(spark, [[2, 1]])
    row = metrics.evaluate_groups(ranked, "retrieved", (1, 5), truth=ranked).first()
    assert row["recall_at_1"] == 0.5 and row["ndcg_at_1"] == 1.0 and row["recall_at_5"] == 1.0


def test_family_errors(spark):
    ranked = frame(spark, [[1]])
    with pytest.raises(ValueError):
        metrics.evaluate_groups(ranked, "other")
    with pytest.raises(ValueError):
        metrics.evaluate_groups(ranked, "candidates")
    with pytest.raises(ValueError):
        metrics.cutoffs([0])


def brute(grades, truth, k, family):
    top = grades[:k]
    dcg = lambda v: sum((2**g - 1) / math.log2(i + 2) for i, g in enumerate(v))
    ideal = sorted(truth if family == "candidates" else top, reverse=True)[:k]
    total = sum(g > 0 for g in (grades if family == "list" else truth))
    seen = hits = 0
    for i, g in enumerate(top, 1):
        if g > 0:
            seen += 1
            hits += seen / i
    base = sum(g > 0 for g in top) if family == "list" else min(total, k)
    return (
        sum(g > 0 for g in top) / total if total else 0.0,
        dcg(top) / dcg(ideal) if dcg(ideal) else 0.0,
        hits / base if base else 0.0,
    )


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=14), min_size=4, max_size=8))
def test_families_against_brute_force(spark, lists):
    full = frame(spark, lists)
    for family in metrics.FAMILIES:
        out = metrics.evaluate_groups(full, family, (10,), truth=full).collect()
        for row in out:
            grades = lists[row["query_id"]]
            want = brute(grades, grades, 10, family)
            got = (row["recall_at_10"], row["ndcg_at_10"], row["map_at_10"])
            assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(want, got)), (family, grades)
            assert all(0 <= v <= 1 + 1e-12 for v in got)


def test_tie_modes(spark):
    df = spark.createDataFrame([(1, 9, 0.5), (1, 10, 0.5)], "query_id long, product_id long, score double")
    first = lambda tie: ranking.top_k(df, ["query_id"], ranking.by_score(tie=tie), 1).first()["product_id"]
    assert first("numeric") == 9 and first("string") == 10
    with pytest.raises(ValueError):
        ranking.top_k(df, ["query_id"], ranking.by_score(), 0)


def test_hot_groups_rank_like_small_ones(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 50).alias("query_id"),
        F.col("id").alias("product_id"),
        F.pmod(F.xxhash64("id"), F.lit(20)).cast("double").alias("score"),
    )
    window = Window.partitionBy("query_id").orderBy(*ranking.by_score())
    plain = df.withColumn("rank", F.row_number().over(window).cast("long")).collect()
    spread = ranking.full_rank(df, ["query_id"], ranking.by_score()).collect()
    assert len(spread) == 3000
    assert sorted(r.asDict().items() for r in plain) == sorted(r.asDict().items() for r in spread)


def test_hot_quantiles(spark):
    df = spark.range(1001).select(
        F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("metric"),
        F.sqrt(F.pmod(F.xxhash64("id"), F.lit(700))).alias("value"),
    )
    points = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    plain = [F.percentile("value", F.lit(p)).alias(n) for n, p in points.items()]
    plain = sorted(df.groupBy("metric").agg(*plain).collect())
    spread = sorted(percentiles.quantiles(df, ["metric"], points).collect())
    assert len(plain) == len(spread) == 2
    for a, b in zip(plain, spread):
        assert a["metric"] == b["metric"]
        assert all(math.isclose(a[p], b[p]) for p in points)
    whole = percentiles.quantiles(df.select("value"), [], {"p50": 0.5}).first()
    assert math.isclose(whole["p50"], df.agg(F.percentile("value", F.lit(0.5))).first()[0])


def test_top_k_limits_groups_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("query_id"), F.col("id").alias("product_id"), F.rand(1).alias("score"))
    plan = ranking.top_k(df, ["query_id"], ranking.by_score(), 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
