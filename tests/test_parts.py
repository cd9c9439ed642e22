"""Tables that are too large to be broadcast whole are broadcast in parts."""

from pyspark.sql import functions as F

from relrank.operators import lexical, pairs, semantic


def _tables(spark):
    """Forty queries and products with vectors and texts of their own; every pair but those of one query."""
    ids = spark.range(40)
    vector = F.array(*[(F.hash("id", F.lit(d)) % 1000 / 1000.0).cast("float") for d in range(8)]).alias("vector")
    name = F.concat(F.lit("red chair "), F.col("id").cast("string"), F.lit(" wood "), (F.col("id") % 7).cast("string"))
    queries = ids.select(F.col("id").alias("query_id"), name.alias("query"))
    products = ids.select(F.col("id").alias("product_id"), F.concat(name, F.lit(" table")).alias("product_name"))
    both = queries.select("query_id").where("query_id <> 5").crossJoin(products.select("product_id"))
    vectors = [ids.select(F.col("id").alias(k), vector) for k in ("query_id", "product_id")]
    return queries, products, both, vectors


def _all(spark):
    queries, products, both, (q, p) = _tables(spark)
    model = lexical.fit_bm25(products)
    unknown = both.unionByName(spark.createDataFrame([(999, 1)], both.schema))
    return [semantic.attach_similarity(both, q, p), lexical.bm25_pairs(unknown, queries, products, model)]


def test_parts_give_what_the_whole_gives(spark, monkeypatch):
    whole = [sorted(map(tuple, df.collect())) for df in _all(spark)]
    monkeypatch.setattr(pairs, "BROADCAST_BYTES", 700)
    seen, written = [], pairs.materialize_parts

    def recorded(session, frames, name):
        return written(session, (seen.append((name, f._jdf.queryExecution().executedPlan().toString())) or f for f in frames), name)

    monkeypatch.setattr(pairs, "materialize_parts", recorded)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = [sorted(map(tuple, df.collect())) for df in _all(spark)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert parts == whole and [len(rows) for rows in whole] == [39 * 40, 39 * 40 + 1]
    assert {name for name, _ in seen} == {"similarity", "lexical"}
    for _, plan in seen:  # no wide pair is shuffled: what a query brings is broadcast
        joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
        assert not any("text_id" in j or "query_vector_id" in j for j in joins), plan


def test_sizes_of_vectors_are_those_of_their_numbers(spark):
    rows = spark.createDataFrame([([0.123456789] * 64,), (None,)], "v array<float>")
    assert pairs.held_bytes(rows) == 8 + 64 * 4 + 8
    assert pairs.n_parts(rows, 100) == 3 and pairs.n_parts(rows) == 1
