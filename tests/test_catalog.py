"""Every SQL twin names real columns, and a sample of queries is compared on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests import compare

SAMPLE = ["quality_checks", "resolve_judgments", "query_split", "bm25_topk", "tfidf_topk", "feature_matrix",
          "compare_models", "query_report", "compact_report", "rank_requests", "request_reuse"]


@pytest.fixture(scope="module")
def con(small):
    return compare.database(small)


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_twin(spark, small, con, name):
    df = entry.queries()[name](spark, small)
    assert compare.difference(df, con, entry.oracle_sql()[name]) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 10 and "ndcg_at_10" in df.columns
