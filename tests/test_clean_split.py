import pytest
from pyspark.sql import functions as F

from relrank.operators import clean, pairs, quality, split


def test_normalize_keeps_case_and_collapses_space(spark):
    df = spark.createDataFrame([("  Red \t Chair ",), (None,), ("a b",)], "t string")
    rows = [r[0] for r in df.select(clean.tx.collapse(F.col("t"))).collect()]
    assert rows == ["Red Chair", "", "a b"]


@pytest.mark.parametrize(
    "labels, expected",
    [
        (["Exact", "Exact"], ("Exact", "agreement")),
        (["Exact", "Exact", "Irrelevant"], ("Exact", "majority_vote")),
        (["Exact", "Partial"], ("Partial", "majority_tie_conservative")),
        (["Partial", "Irrelevant"], ("Irrelevant", "majority_tie_conservative")),
    ],
)
def test_resolution(spark, labels, expected):
    df = spark.createDataFrame(
        [(i, 1, 2, label) for i, label in enumerate(labels)],
        "id long, query_id long, product_id long, label string",
    )
    row = clean.resolve_judgments(df).first()
    assert (row["label"], row["resolution_method"]) == expected
    assert row["annotation_count"] == len(labels)
    assert row["original_labels"] == "|".join(sorted(set(labels)))


def test_unknown_label_stops_the_job(spark):
    df = spark.createDataFrame([(1, 1, 2, "Maybe")], "id long, query_id long, product_id long, label string")
    with pytest.raises(Exception, match="outside the scale"):
        clean.resolve_judgments(df).collect()


def test_split_sizes_are_exact_disjoint_and_repeatable(spark):
    ids = spark.range(480).withColumnRenamed("id", "query_id")
    a = split.assign_queries(ids).collect()
    b = split.assign_queries(ids.orderBy(F.desc("query_id"))).collect()
    assert sorted(a) == sorted(b) and len({r["query_id"] for r in a}) == 480
    sizes = {s: sum(r["split"] == s for r in a) for s in ("train", "validation", "test")}
    assert sizes == {"train": 336, "validation": 72, "test": 72}
    other = split.assign_queries(ids, split.SplitSizes(seed=7)).collect()
    assert sorted(other) != sorted(a)


def test_split_rejects_bad_sizes_and_few_queries(spark):
    with pytest.raises(ValueError):
        split.SplitSizes(train=0.9)
    with pytest.raises(Exception, match="At least 3"):
        split.assign_queries(spark.range(2).withColumnRenamed("id", "query_id")).collect()


def test_shared_query_is_found(spark):
    df = spark.createDataFrame(
        [(1, 1, 2, "train"), (1, 2, 0, "test"), (2, 1, 1, "validation")],
        "query_id long, product_id long, relevance_score int, split string",
    )
    failed = {r["check"] for r in split.split_checks(df).collect() if r["status"] == "FAIL"}
    assert failed == {"train_test_disjoint"}


def test_checks_on_dirty_tables(spark):
    queries = spark.createDataFrame(
        [(1, "sofa", None), (1, " ", "x"), (3, "lamp", "x")],
        "query_id long, query string, query_class string",
    )
    rows = {r["check"]: r for r in quality.check_queries(queries).collect()}
    assert rows["query_query_id_unique"]["violations"] == 2
    assert rows["query_required_values"]["detail"] == "query=1"
    assert rows["query_query_class_missing"]["status"] == "WARN"
    missing = quality.check_queries(queries.drop("query_class")).collect()
    assert [r["status"] for r in missing] == ["FAIL"]


def test_label_checks(spark):
    labels = spark.createDataFrame(
        [(1, 1, 1, "Exact"), (2, 1, 1, "Partial"), (3, 1, 2, "Wrong"), (4, 2, 9, None)],
        "id long, query_id long, product_id long, label string",
    )
    rows = {r["check"]: r["violations"] for r in quality.check_labels(labels).collect()}
    assert rows["labels_valid"] == 2
    assert rows["query_product_pair_unique"] == 2
    assert rows["query_product_pair_label_consistency"] == 1
    products = spark.createDataFrame([(1,), (2,)], "product_id long")
    assert quality.foreign_key(labels, products, "product_id", "fk").first()["violations"] == 1
    with pytest.raises(ValueError, match="labels_valid"):
        quality.require_valid(quality.check_labels(labels))


def test_check_row_names_invalid_labels(spark):
    rows = [(1, 1, 1, "Exact"), (2, 1, 2, "Odd"), (3, 1, 3, "Bad"), (4, 1, 4, None), (5, 1, 5, "Bad")]
    df = spark.createDataFrame(rows, "id long, query_id long, product_id long, label string")
    row = quality.check_labels(df).filter("check = 'labels_valid'").first()
    assert row["violations"] == 4 and row["detail"] == "values=2:Bad,Odd"


def test_pairs_need_unique_keys(spark):
    judgments = spark.createDataFrame([(1, 1)], "query_id long, product_id long")
    queries = spark.createDataFrame([(1, "a"), (1, "b")], "query_id long, query string")
    with pytest.raises(ValueError, match="not unique"):
        pairs.build_pairs(judgments, queries, judgments.select("product_id"))
