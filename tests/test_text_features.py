import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from relrank.functions import category, numeric
from relrank.functions import text as tx
from relrank.operators import features, lexical, semantic
from relrank.operators.pairs import few, shared_values

NAMES = ["red wooden dining table", "blue dining chair", "wooden desk", "table table lamp"]


@pytest.fixture(scope="module")
def products(spark):
    return spark.createDataFrame(list(enumerate(NAMES)), "product_id long, product_name string")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "wooden table table"), (2, "unknown")], "query_id long, query string")


@pytest.fixture(scope="module")
def pairs(products, queries):
    return queries.select("query_id").join(F.broadcast(products.select("product_id")), F.lit(True))


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


def test_bm25_against_brute_force(spark, products, queries, pairs):
    docs = [n.split() for n in NAMES]
    avg = sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))
    idf = {t: math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) for t, n in df.items()}

    def want(q, d):
        return sum(
            idf[t] * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg))
            for t in q.split()
            if t in idf
        )

    texts = {1: "wooden table table", 2: "unknown"}
    for r in lexical.bm25_pairs(pairs, queries, products, lexical.fit_bm25(products)).collect():
        assert math.isclose(r["bm25_score"], want(texts[r["query_id"]], docs[r["product_id"]]), abs_tol=1e-8)


def test_fit_rejects_empty_corpus(products):
    empty = products.filter(F.lit(False))
    with pytest.raises(ValueError):
        lexical.fit_bm25(empty)
    with pytest.raises(ValueError):
        lexical.fit_tfidf(empty)


def test_tfidf_terms_and_cut(spark, products):
    vocabulary = {r["term"]: r for r in lexical.fit_tfidf(products).collect()}
    assert vocabulary["table"]["df"] == 2 and vocabulary["table"]["corpus_count"] == 3
    assert "table table" in vocabulary and "dining table" in vocabulary
    kept = lexical.fit_tfidf(products, params=lexical.TfidfParams(max_features=5)).collect()
    order = sorted(vocabulary.values(), key=lambda r: (-r["corpus_count"], r["term"]))
    assert {r["term"] for r in kept} == {r["term"] for r in order[:5]}


def test_identical_text_has_cosine_one(spark, products):
    q = products.select(F.col("product_id").alias("query_id"), F.col("product_name").alias("query"))
    same = products.select(F.col("product_id").alias("query_id"), "product_id")
    scores = lexical.tfidf_pairs(same, q, products, lexical.fit_tfidf(products)).collect()
    assert all(math.isclose(r["tfidf_similarity"], 1.0, abs_tol=1e-8) for r in scores)


def test_category_readings(spark):
    assert one(spark, category.depth, "Furniture > Chairs > Dining Chairs") == 3
    assert one(spark, category.depth, "A / B/C") == 2
    assert one(spark, category.depth, " ") == 0 and one(spark, category.depth, "A") == 1
    assert one(spark, category.top_level, "A / B > C") == "A / B"
    assert one(spark, category.top_level, None) == "Unknown"
    assert one(spark, category.primary, "['Home' / x") == "Home"


def test_numbers(spark):
    for text, want in ((" 1.5 ", 1.5), ("nan", 0.0), ("inf", 0.0), ("x", 0.0), (None, 0.0)):
        assert one(spark, numeric.finite_or_zero, text) == want


def test_feature_count_lines_then_words(spark):
    assert one(spark, features.feature_count, "a b\nc\n\nd") == 3
    assert one(spark, features.feature_count, "a b c d") == 4
    assert one(spark, features.feature_count, None) == 0


def test_unicode_words_and_trigrams(spark):
    assert one(spark, tx.words, "Élan, déjà-vu_2") == ["élan", "déjà", "vu_2"]
    assert len(one(spark, tx.trigram_set, "aaaa")) == 1
    assert len(one(spark, tx.trigram_set, "abcdé")) == 3
    assert one(spark, tx.trigram_set, "ab") == []


def test_feature_row(spark):
    pair = spark.createDataFrame([(1, 7)], "query_id long, product_id long")
    q = spark.createDataFrame([(1, "dining table")], "query_id long, query string")
    p = spark.createDataFrame([(7, "Red Dining Table", "table")], "product_id long, product_name string, product_class string")
    row = features.feature_matrix(pair, q, p).first()
    assert row["query_title_overlap"] == 2 and row["phrase_match"] == 1 and row["exact_match"] == 0
    assert math.isclose(row["token_overlap"], 2 / 3) and row["product_class_match"] == 1
    assert row["category_match"] == 0 and row["rating_count"] == 0 and row["semantic_similarity"] == 0
    only = features.FeatureGroups(product_text=False, metadata=False, compatibility=False)
    assert "title_length" not in features.feature_matrix(pair, q, p, only).columns


def test_cosine_order_zero_and_errors(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    p = spark.createDataFrame(
        [(101, [1.0, 0.0]), (102, [0.5, 0.5]), (103, [0.0, 0.0]), (104, [1.0])],
        "product_id long, vector array<double>",
    )
    ids = spark.createDataFrame([(1, 101), (1, 102), (1, 103)], "query_id long, product_id long")
    rows = semantic.attach_similarity(ids, q, p).orderBy(F.desc("semantic_similarity")).collect()
    assert [r["product_id"] for r in rows] == [101, 102, 103] and rows[-1]["semantic_similarity"] == 0
    for bad, message in ((104, "dimension"), (999, "no vector")):
        df = spark.createDataFrame([(1, bad)], "query_id long, product_id long")
        with pytest.raises(Exception, match=message):
            semantic.attach_similarity(df, q, p).collect()


def test_custom_encoder(spark, products):
    def load():
        import numpy as np

        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    rows = semantic.encode_with(products, "product_id", load, "product_name").collect()
    assert len(rows) == 4 and all(math.isclose(sum(x * x for x in r["vector"]), 1.0) for r in rows)


def test_pairs_are_not_shuffled_with_vectors_that_queries_share(spark):
    """5,000 queries with 200 vectors: as one row per query they were too large to broadcast, as values they are not."""
    rng = np.random.default_rng(1)
    held = [[float(x) for x in v] for v in rng.normal(size=(200, 64))]
    q = spark.createDataFrame([(i, held[i % 200]) for i in range(5000)], "query_id long, vector array<double>")
    p = spark.createDataFrame([(1, held[0])], "product_id long, vector array<double>")
    ids = spark.range(5000).select(F.col("id").alias("query_id"), F.lit(1).cast("long").alias("product_id"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "300k")
    try:
        out = semantic.attach_similarity(ids, q, p)
        assert "hashpartitioning(query_id" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == 5000
        assert out.where("query_id = 400").first()["semantic_similarity"] == 1.0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_shared_values_keep_every_key(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b")], "query_id long, query string")
    shared = shared_values(rows, "query_id", "query", "text_id")
    back = shared.ids.join(shared.values, "text_id").select("query_id", "query")
    assert shared.values.count() == 3
    assert sorted(back.collect()) == sorted(rows.collect())


def test_few_values_are_broadcast_below_any_threshold_of_the_session(spark, queries, products, pairs):
    rng = np.random.default_rng(5)
    held = [(k, rng.random(8).tolist()) for k in range(len(NAMES))]
    vectors = spark.createDataFrame(held, "id long, vector array<double>")
    q, p = vectors.withColumnRenamed("id", "query_id"), vectors.withColumnRenamed("id", "product_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = [
            semantic.attach_similarity(pairs, q, p),
            features.feature_matrix(pairs, queries, products),
            lexical.bm25_pairs(pairs, queries, products, lexical.fit_bm25(products)),
        ]
        for df, wide in zip(found, ("query_vector#", "q_words#", "bm25_query#"), strict=True):
            plan = df._jdf.queryExecution().executedPlan().toString()
            joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
            assert not any("text_id" in j or "vector_id" in j for j in joins), (wide, plan)
            assert df.count() == pairs.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_many_values_are_left_to_spark(spark, products):
    assert "broadcast" in few(products)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in few(products, limit=10)._jdf.queryExecution().logical().toString().lower()
