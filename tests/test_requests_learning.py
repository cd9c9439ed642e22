import datetime as dt
import hashlib
import math
import random
import re
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relrank.operators import boosting, fingerprint, learning, metrics, requests, semantic, trees
from relrank.operators.trees import Tree, TreeEnsemble, walk
from relrank.session import scratch_path
from relrank.plans import catalog
from relrank.sources import tables
from relrank.streaming import ranking as stream_ranking
from relrank.streaming import signals

T0 = dt.datetime(2024, 1, 1)


def log(spark, rows):
    data = [(i, T0 + dt.timedelta(seconds=s), k) for i, (k, s) in enumerate(rows)]
    return spark.createDataFrame(data, "request_id long, ts timestamp, request_key string")


def brute(rows, ttl):
    stored, out = {}, {}
    for i, (k, s) in sorted(enumerate(rows), key=lambda x: (x[1][0], x[1][1], x[0])):
        out[i] = k in stored and s < stored[k] + ttl
        if not out[i]:
            stored[k] = s
    return out


def test_reuse_agrees_with_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aaab"), rng.randrange(3000)) for _ in range(400)]
    want = brute(rows, 300)
    got = {r["request_id"]: r["reused"] for r in requests.reuse(log(spark, rows), 300).collect()}
    assert got == want


def test_reuse_of_one_key_spreads_over_tasks(spark):
    """A key with nearly all rows: its chain crosses ranges, and no operator gathers it."""
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.97 else f"k{i}", rng.randrange(400_000)) for i in range(6000)]
    frame = log(spark, rows)
    assert {r["request_id"]: r["reused"] for r in requests.reuse(frame, 300).collect()} == brute(rows, 300)
    moments = frame.groupBy("request_key", F.unix_micros("ts").alias("micros")).agg(F.min("request_id"))
    ranged = requests._successors(moments, 300_000_000)
    assert ranged.where("request_key = 'hot'").count() > 5000
    assert "Python" not in requests.reuse(frame, 300)._jdf.queryExecution().toString()
    assert requests.reuse(frame.limit(0)).count() == 0


def test_stream_reuse_equals_batch_and_forgets(spark):
    """The log comes shuffled over micro-batches within the lateness; at the end no state is left."""
    signals.stateful(spark)
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "b", None]), rng.randrange(6000)) for _ in range(400)]
    folder = scratch_path(spark, "stream-reuse")
    df = log(spark, rows)
    arrival = F.unix_seconds("ts") + F.pmod(F.xxhash64("request_id"), F.lit(600))
    part = F.floor((arrival - F.unix_seconds(F.lit(T0))) / 1700)
    for k in range(4):
        df.where(part == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    signals.closing_row(df, "2 hours").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = signals.stream_reuse(stream, 300, lateness="40 minutes")
    signals.run_to_table(out, f"{folder}/out", f"{folder}/cp")
    got = {r["request_id"]: r["reused"] for r in spark.read.parquet(f"{folder}/out").collect()}
    named = [("" if k is None else k, s) for k, s in rows]
    assert got == brute(named, 300) == {r["request_id"]: r["reused"] for r in requests.reuse(df, 300).collect()}
    state = spark.read.format("statestore").option("stateVarName", "stored").load(f"{folder}/cp")
    assert state.count() == 0


def test_a_hit_does_not_extend_the_ttl(spark):
    got = {r["request_id"]: r["reused"] for r in requests.reuse(log(spark, [("a", 0), ("a", 200), ("a", 400)]), 300).collect()}
    assert got == {0: False, 1: True, 2: False}


def nested(spark):
    products = [(2, "oak desk"), (1, "oak desk"), (3, "lamp")]
    rows = [("r1", "oak desk", 2, products), ("r2", " ", 5, products), ("r3", "x", 5, []), ("r4", "x", 0, products)]
    full = [(a, b, k, [(i, n, *[None] * 7) for i, n in p]) for a, b, k, p in rows]
    return spark.createDataFrame(full, requests.S.REQUEST_SCHEMA)


def test_rank_nested_requests(spark):
    rows = requests.explode_requests(nested(spark).filter("request_id = 'r1'"))
    corpus = spark.createDataFrame([(1, "oak desk"), (2, "lamp"), (3, "chair")], "product_id long, product_name string")
    models = requests.fit_models(corpus)
    out = requests.nest_responses(requests.rank_requests(rows, models)).first()  # the request asks for two
    assert [r["product_id"] for r in out["results"]] == [1, 2]
    assert requests.rank_requests(rows.drop("top_k"), models).count() == 3
    with pytest.raises(Exception, match="not finite"):
        requests.rank_requests(rows, models, 2, lambda m: m.withColumn("score", F.lit(float("nan")))).collect()


def test_rejects(spark):
    got = {r["request_id"]: r["reason"] for r in requests.nested_rejects(nested(spark)).collect()}
    assert got == {"r2": "empty_query", "r3": "no_products", "r4": "top_k_not_positive"}


def test_content_key_ignores_product_order(spark):
    heads = spark.createDataFrame([(1, "q"), (2, "q"), (3, "q")], "request_id long, query string")
    rows = [(1, 5, "a"), (1, 6, "b"), (2, 6, "b"), (2, 5, "a"), (3, 5, "a")]
    cands = spark.createDataFrame(rows, "request_id long, product_id long, product_name string")
    keys = {r["request_id"]: r["content_key"] for r in requests.content_keys(heads, cands).collect()}
    assert keys[1] == keys[2] != keys[3]


def test_content_keys_and_fingerprints_tell_fields_apart(spark):
    heads = spark.createDataFrame([(1, "q"), (2, "q"), (3, "q"), (4, "q")], "request_id long, query string")
    rows = [(1, 5, "a|b", "c"), (2, 5, "a", "b|c"), (3, 5, None, "c"), (4, 5, "n", "c")]
    cands = spark.createDataFrame(rows, "request_id long, product_id long, product_name string, product_class string")
    keys = [r["content_key"] for r in requests.content_keys(heads, cands).collect()]
    assert len(set(keys)) == 4
    columns = ["product_id", "product_name", "product_class"]
    prints = [fingerprint.fingerprint(cands.filter(F.col("request_id") == i), "t", columns).first()["content"] for i in range(1, 5)]
    assert len(set(prints)) == 4


def test_similarity_enters_the_request_features(spark):
    rows = requests.explode_requests(nested(spark).filter("request_id = 'r1'")).withColumn("query_id", F.lit(7))
    corpus = spark.createDataFrame([(1, "oak desk"), (2, "lamp")], "product_id long, product_name string")
    qv = spark.createDataFrame([(7, [1.0, 0.0])], "query_id int, vector array<double>")
    pv = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "product_id long, vector array<double>")
    out = requests.score_candidates(rows, requests.fit_models(corpus, qv, pv)).collect()
    assert {r["product_id"]: r["semantic_similarity"] for r in out} == {1: 1.0, 2: 0.0, 3: 0.0}


def test_fingerprint_ignores_row_order_and_sees_changes(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    one = fingerprint.fingerprint(df, "t", ["id", "t"]).first()
    assert one == fingerprint.fingerprint(df.orderBy(F.desc("id")), "t", ["id", "t"]).first()
    assert one != fingerprint.fingerprint(df.limit(1), "t", ["id", "t"]).first()


def test_fingerprints_are_exact(spark):
    """Each single change is seen: small fractions, neighbouring doubles, and where an array's elements end."""

    def content(value, kind):
        return fingerprint.fingerprint(spark.createDataFrame([(value,)], f"x {kind}"), "t", ["x"]).first()["content"]

    fractions = [1e-10, 4e-10, 0.1, float(np.nextafter(0.1, 1)), 5.25, float(np.nextafter(5.25, 9)), -5.25, 0.0, 1e9 + 0.5, float("nan"), float("inf"), float("-inf"), 1e30, None]
    assert len({content(x, "double") for x in fractions}) == len(fractions)
    arrays = [["a, b"], ["a", "b"], ["a", None], ["a", "n"], [], None, ["a,b"], ["1:a"], ["a", ""], [""]]
    assert len({content(x, "array<string>") for x in arrays}) == len(arrays)
    vectors = [[0.1, 0.2], [0.2, 0.1], [0.1], [0.1, None], [0.1, float(np.nextafter(0.2, 1))]]
    assert len({content(x, "array<double>") for x in vectors}) == len(vectors)


def test_rankings_without_judged_queries_are_an_error(spark):
    ranked = spark.createDataFrame([(1, 1, 2)], "query_id long, rank int, relevance_score int")
    truth = spark.createDataFrame([(2, 1)], "query_id long, relevance_score int")
    per_query = metrics.evaluate_groups(ranked, "candidates", (10,), truth=truth)
    with pytest.raises(Exception, match="share no query"):
        metrics.macro_average(per_query).collect()


def test_encoder_against_brute_force(spark):
    texts = ["Oak desk, oak table", "desk lamp", None, "", "unseen words", "x"]
    fitted = spark.createDataFrame(list(enumerate(texts[:4])), "id long, text string")
    every = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    weights = semantic.fit_text_encoder(fitted, "id")
    got = {r["id"]: r["vector"] for r in semantic.encode_text(every, "id", weights, dimensions=32).collect()}

    def grams(t):
        w = re.findall(r"\w{2,}", (t or "").lower())
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    df = {g: sum(g in grams(t) for t in texts[:4]) for t in texts[:4] for g in grams(t)}
    for i, t in enumerate(texts):
        want = [0.0] * 32
        for g in grams(t):
            if g in df:
                h = hashlib.md5(g.encode()).hexdigest()
                want[int(h[:8], 16) % 32] += (1 if int(h[8], 16) % 2 == 0 else -1) * round((math.log(5 / (1 + df[g])) + 1) * 1e6)
        length = math.sqrt(sum(x * x for x in want))
        assert np.allclose(got[i], [x / length if length else 0.0 for x in want], atol=1e-8)


def test_late_rows_correct_their_window(spark):
    folder = scratch_path(spark, "late")
    rows = [(i, T0 + dt.timedelta(minutes=m), 500 if i % 4 == 0 else 200, float(i)) for i, m in enumerate([5, 20, 70, 200, 30, 250, 10, 65, 400, 390])]
    df = spark.createDataFrame(rows, "request_id long, ts timestamp, status int, latency_ms double")
    for part in range(5):
        df.where(F.floor(F.col("request_id") / 2) == part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    signals.run_signals(stream, f"{folder}/out", f"{folder}/cp", lateness="30 minutes")
    got = {r["window_start"]: r.asDict() for r in signals.corrected(spark, f"{folder}/out").collect()}
    late = {w: r.pop("late_requests") for w, r in got.items()}
    assert got == {r["window_start"]: r.asDict() for r in signals.windowed_signals(df).collect()}
    # 30 comes after 200, and 10 and 65 after 250.
    assert sorted(r["request_id"] for r in spark.read.parquet(f"{folder}/out/late").collect()) == [4, 6, 7]
    assert {w.hour: n for w, n in late.items() if n} == {T0.hour: 2, T0.hour + 1: 1}


def test_stream_ranks_by_the_model_of_the_time(spark):
    folder = scratch_path(spark, "versions")
    products = [(1, "oak desk"), (2, "lamp"), (3, "oak desk lamp")]
    base = spark.createDataFrame([(f"r{i}", T0 + dt.timedelta(hours=i), "oak desk", k, [(a, b, *[None] * 7) for a, b in products]) for i, k in enumerate([None, 2, 0, None])],
        T.StructType([requests.S.REQUEST_SCHEMA["request_id"], T.StructField("ts", T.TimestampType()), *requests.S.REQUEST_SCHEMA.fields[1:]]))
    micros = [r["m"] for r in base.select(F.unix_micros("ts").alias("m")).orderBy("m").collect()]
    stream_ranking.publish(spark, f"{folder}/models", 1, micros[0], {"token_overlap": 1.0})
    stream_ranking.publish(spark, f"{folder}/models", 2, micros[1], {"token_overlap": -1.0})
    for i in range(4):
        base.where(F.col("request_id") == f"r{i}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(base.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    corpus = spark.createDataFrame(products, "product_id long, product_name string")
    stream_ranking.rank_stream(stream, requests.fit_models(corpus), f"{folder}/out", f"{folder}/cp", f"{folder}/models")
    ranked = stream_ranking.read_batches(spark, f"{folder}/out", "ranked")
    first = {r["request_id"]: r["product_id"] for r in ranked.where("rank = 1").collect()}
    assert first["r0"] == 1 and first["r1"] == first["r3"] == 2 and "r2" not in first
    assert ranked.where("request_id = 'r1'").count() == 2
    audit = {r["request_id"]: (r["model_alias"], r["top_k"]) for r in stream_ranking.read_batches(spark, f"{folder}/out", "audit").collect()}
    assert audit == {"r0": ("v1", 3), "r1": ("v2", 2), "r3": ("v2", 3)}
    # A batch that broke off before its manifest entry is not read.
    ranked.drop("batch").write.parquet(f"{folder}/out/ranked/batch=99")
    assert stream_ranking.read_batches(spark, f"{folder}/out", "ranked").count() == ranked.count() == 8


def test_raw_files_and_audit_round_trip(spark):
    folder = scratch_path(spark, "test")
    queries = spark.createDataFrame([(1, 'a "b"\tc', None)], "query_id long, query string, query_class string")
    tables.write_tsv(queries, f"{folder}/q")
    assert tables.read_tsv(spark, f"{folder}/q", queries.schema).collect() == queries.collect()
    with pytest.raises(ValueError):
        tables.write_by_split(queries, f"{folder}/s")
    spark.createDataFrame([(1, 2)], "query_id long, product_id long").write.option("header", "true").csv(f"{folder}/bad")
    with pytest.raises(ValueError, match="lack"):
        tables.read_rankings(spark, f"{folder}/bad")


def test_stream_windows_equal_batch(spark):
    folder = scratch_path(spark, "stream-test")
    rows = [(i, T0 + dt.timedelta(minutes=7 * i), 200 if i % 3 else 500, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "request_id long, ts timestamp, status int, latency_ms double")
    df.write.parquet(f"{folder}/in")
    stream = signals.windowed_signals(spark.readStream.schema(df.schema).parquet(f"{folder}/in"))
    signals.run_updates(stream, f"{folder}/out", f"{folder}/cp")
    got = {r["window_start"]: r for r in signals.latest(spark.read.parquet(f"{folder}/out"), ["window_start"]).collect()}
    want = {r["window_start"]: r for r in signals.windowed_signals(df).collect()}
    assert got == want


def training(spark, n=30, per=12, offset=0):
    rng = random.Random(offset)
    rows = []
    for q in range(n):
        for p in range(per):
            good = rng.random()
            grade = 2 if good > 0.75 else 1 if good > 0.45 else 0
            rows.append((q + offset, p, grade, good + rng.gauss(0, 0.05), rng.random()))
    return spark.createDataFrame(rows, "query_id long, product_id long, relevance_score int, good double, noise double")


SMALL = boosting.RankParams(rounds=8, learning_rate=0.5, num_leaves=7, min_rows=5, subsample=1.0, columns=1.0, patience=4, max_bins=16)
NAMES = ["good", "noise"]


def brute_lambdas(rows, score, p):
    """LambdaRank over all pairs of a query, with no discount below the top list."""
    out = {}
    for q in {r["query_id"] for r in rows}:
        own = sorted((r for r in rows if r["query_id"] == q), key=lambda r: (-score[q, r["product_id"]], r["product_id"]))
        ideal = sum((2**g - 1) / math.log2(k + 2) for k, g in enumerate(sorted((r["relevance_score"] for r in own), reverse=True)[: p.top]))
        discount = [1 / math.log2(k + 2) if k < p.top else 0.0 for k in range(len(own))]
        for a, x in enumerate(own):
            g = h = 0.0
            for b, y in enumerate(own):
                if x["relevance_score"] != y["relevance_score"] and ideal:
                    delta = abs(2 ** x["relevance_score"] - 2 ** y["relevance_score"]) * abs(discount[a] - discount[b]) / ideal
                    side = 1 if x["relevance_score"] > y["relevance_score"] else -1
                    rho = 1 / (1 + math.exp(side * (score[q, x["product_id"]] - score[q, y["product_id"]])))
                    g, h = g + side * rho * delta, h + rho * (1 - rho) * delta
            out[q, x["product_id"]] = g, h
    return out


def brute_split(rows, part, found, edges, p):
    """The best (gain, feature, edge) of a set of rows, by trying every edge."""
    worth = lambda keys: sum(found[k][0] for k in keys) ** 2 / max(sum(found[k][1] for k in keys), 1e-12)
    keys = [(r["query_id"], r["product_id"]) for r in part]
    best = None
    for f, name in enumerate(NAMES):
        for e in edges[f]:
            low = [k for k, r in zip(keys, part) if r[name] <= e]
            high = [k for k, r in zip(keys, part) if r[name] > e]
            if min(len(low), len(high)) >= p.min_rows and min(sum(found[k][1] for k in side) for side in (low, high)) >= p.min_curvature:
                gain = worth(low) + worth(high) - worth(keys)
                if gain > 1e-6 and (best is None or gain > best[0] + 1e-6):
                    best = gain, f, e
    return best


@pytest.mark.parametrize("block, small", [(boosting.BLOCK, 0), (4, 60), (boosting.BLOCK, boosting.SMALL_LEAF)])
def test_first_tree_is_the_brute_force_one(spark, monkeypatch, block, small):
    """Leaf by leaf, the leaf of the largest gain first; also with every query cut into pieces, and with leaves whose
    rows are never fetched, late or from the start."""
    monkeypatch.setattr(boosting, "BLOCK", block)
    monkeypatch.setattr(boosting, "SMALL_LEAF", small)
    frame = training(spark, 15, 14)
    rows = frame.collect()
    p = replace(SMALL, rounds=1, learning_rate=1.0, top=5)
    fit = boosting.RankerFit(frame, None, NAMES, [p])
    assert fit.in_pieces[0] == (block == 4)
    fit.grow(fit.settings, 1)
    found = brute_lambdas(rows, {(r["query_id"], r["product_id"]): 0.0 for r in rows}, p)
    leaves, splits = [rows], []
    while len(leaves) < p.num_leaves:
        options = [(brute_split(rows, part, found, fit.edges, p), part) for part in leaves]
        options = [(s, part) for s, part in options if s]
        if not options:
            break
        (gain, f, e), part = max(options, key=lambda o: o[0][0])
        splits.append((f, e, round(gain, 4)))
        leaves = [x for x in leaves if x is not part]
        leaves += [[r for r in part if r[NAMES[f]] <= e], [r for r in part if r[NAMES[f]] > e]]
    tree = fit.model(fit.settings[0]).trees[0]
    got = sorted((int(f), float(c), round(float(g), 4)) for f, c, g in zip(tree.feature, tree.cut, tree.gain) if f >= 0)
    assert got == sorted(splits) and len(splits) == 6
    scored = {(r["query_id"], r["product_id"]): r["score"] for r in fit.model(fit.settings[0]).transform(frame).collect()}
    for part in leaves:
        keys = [(r["query_id"], r["product_id"]) for r in part]
        step = sum(found[k][0] for k in keys) / sum(found[k][1] for k in keys)
        assert all(abs(scored[k] - step) < 1e-5 for k in keys)


def test_pieces_change_nothing(spark, monkeypatch):
    """A query in pieces has the same gradients, trees and validation values as one that is whole."""
    train, held = training(spark, 12, 30), training(spark, 8, 30, 500)
    models = []
    for block in (boosting.BLOCK, 7):
        monkeypatch.setattr(boosting, "BLOCK", block)
        fit = boosting.RankerFit(train, held, NAMES, [replace(SMALL, top=5, subsample=0.7), replace(SMALL, top=5, objective="pointwise")], every=2)
        fit.grow(fit.settings, 5)
        models.append(fit.settings)
    for one, two in zip(*models):
        assert len(one.trees) == len(two.trees) == 5 and np.allclose(one.ndcg, two.ndcg, atol=1e-9)
        for a, b in zip(one.trees, two.trees):  # gradients are rounded piece by piece
            assert a.feature.tolist() == b.feature.tolist() and a.cut.tolist() == b.cut.tolist() and np.allclose(a.value, b.value, atol=1e-5)


def test_ranker_learns_the_order(spark):
    train, held = training(spark), training(spark, offset=1000)
    model = boosting.fit_ranker(train, held, SMALL, NAMES)
    assert 1 <= model.best_round <= 8 and learning.mean_ndcg(model.transform(held)) > 0.9
    assert learning.importance_rows(spark, NAMES, model.gains()).first()["feature"] == "good"
    again = boosting.fit_ranker(train.repartition(3), held, SMALL, NAMES)
    assert [t.value.tolist() for t in again.trees] == [t.value.tolist() for t in model.trees]


def test_one_projection_scores_like_the_walk(spark):
    """Hundreds of trees: the native expression, the node table read back, and numpy agree exactly."""
    rng = np.random.default_rng(1)
    trees = []
    for _ in range(500):
        n = 15
        feature = np.where(np.arange(n) < 7, rng.integers(0, 2, n), -1)
        left = np.where(feature >= 0, 2 * np.arange(n) + 1, 0)
        trees.append(Tree(feature, rng.random(n), left, np.where(feature >= 0, left + 1, 0), rng.standard_normal(n), np.zeros(n)))
    model = TreeEnsemble(NAMES, trees)
    frame = training(spark, 10, 10)
    rows = frame.select("query_id", "product_id", *NAMES).collect()
    x = np.array([[r[c] for c in NAMES] for r in rows])
    want = np.zeros(len(rows))
    for t in trees:
        want += t.value[walk(t, x)]
    scored = model.transform(frame)
    got = {(r["query_id"], r["product_id"]): r["score"] for r in scored.collect()}
    assert [got[r["query_id"], r["product_id"]] for r in rows] == want.tolist()
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("Project") == 1
    back = TreeEnsemble.from_nodes(model.nodes(spark), NAMES).transform(frame)
    assert {(r["query_id"], r["product_id"]): r["score"] for r in back.collect()} == got
    with pytest.raises(ValueError, match="another order"):
        model.transform(frame.select("query_id", "noise", "good"))
    with pytest.raises(ValueError, match="lacks"):
        model.transform(frame.drop("noise"))


def test_halving_search(spark):
    train, held = training(spark, 20), training(spark, 15, offset=1000)
    settings = [replace(SMALL, rounds=6, learning_rate=rate) for rate in (0.001, 0.3, 0.5, 0.002, 0.6)]
    trials, model = boosting.halving_search(train, held, NAMES, settings, first=2)
    assert [t.stopped_at for t in sorted(trials, key=lambda t: t.number)].count(0) == 1
    assert sorted(t.stopped_at for t in trials) == [0, 1, 1, 1, 2] and trials[0].stopped_at == 0
    assert abs(learning.mean_ndcg(model.transform(held)) - trials[0].ndcg) < 1e-9
    table = learning.trial_table(spark, trials)
    assert table.count() == 5 and {r["rounds"] for r in table.where("stopped_at = 1").collect()} == {2}
    report = learning.training_report(learning.retrain(train, trials[0], NAMES), {"validation": held}).first()
    assert report["best_round"] == trials[0].best_round and '"learning_rate"' in report["params"]


def test_other_models(spark):
    train = training(spark)
    multi = learning.fit_multiclass(train, trees=5)
    ranked = learning.rank_scored(multi.transform(train)).collect()
    assert len(ranked) == train.count() and min(r["rank"] for r in ranked) == 1
    bad = train.withColumn("good", F.lit(float("nan")))
    with pytest.raises(ValueError, match="all_finite"):
        learning.require_trainable(bad, NAMES)
    with pytest.raises(ValueError, match="Grades"):
        learning.require_trainable(train.withColumn("relevance_score", F.lit(5)), NAMES)


def test_candidates_by_id_score_as_with_all_fields(spark):
    """The table of products has the fields; a product that is not in it counts as one without fields."""
    rows = requests.explode_requests(nested(spark).filter("request_id = 'r1'"))
    rows = rows.withColumn("product_description", F.lit("solid  oak\ntop"))
    table = rows.where("product_id <> 3").select(*requests.S.PRODUCT_COLUMNS)
    empty = {c: F.lit(None).cast(t) for c, t in rows.dtypes if c in requests.S.PRODUCT_COLUMNS and c != "product_id"}
    unknown = F.col("product_id") == 3
    full = rows.withColumns({c: F.when(unknown, e).otherwise(F.col(c)) for c, e in empty.items()})
    models = requests.fit_models(spark.createDataFrame([(1, "oak desk"), (2, "lamp")], "product_id long, product_name string"))
    by_id = rows.drop(*empty)
    want = requests.score_candidates(full, models)
    got = requests.score_candidates(by_id, models, table)
    assert sorted(got.select(want.columns).collect()) == sorted(want.collect())
    assert requests.rank_requests(by_id, models, products=table).count() == 2


def test_requests_are_nested_without_the_texts_of_their_products(spark, small):
    i = catalog.Inputs(spark, small)
    assert dict(catalog._nested(i, "inner").dtypes)["products"] == "array<struct<product_id:bigint>>"
    whole = requests.explode_requests(catalog._nested(i, "inner")).select("request_id", "product_id")
    assert sorted(whole.collect()) == sorted(i.lines.select("request_id", "product_id").collect())


def test_responses_hold_every_candidate(spark, small):
    """Also of requests that ask for a few: the response tells all of them apart."""
    out = catalog.all_queries()["ranking_responses"](spark, small)
    found = out.agg(F.sum(F.size(F.split("results", ",")))).first()[0]
    assert found == catalog.Inputs(spark, small).lines.count()


def test_stream_reuse_keeps_a_state_per_bucket_of_keys(spark):
    """Many keys of few requests are decided in as many states as there are buckets."""
    signals.stateful(spark)
    folder = scratch_path(spark, "stream-buckets")
    keys = 3 * signals.BUCKETS
    ids = spark.range(2 * keys).select(
        (F.col("id") + 2**53 + 1).alias("request_id"), F.concat(F.lit("k"), (F.col("id") % keys).cast("string")).alias("request_key"),
        F.timestamp_seconds(F.unix_seconds(F.lit(T0)) + F.floor(F.col("id") / keys) * 100).alias("ts"),
    )
    ids.coalesce(1).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(ids.schema).parquet(f"{folder}/in")
    signals.run_to_table(signals.stream_reuse(stream, 300), f"{folder}/out", f"{folder}/cp")
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{folder}/cp")
    assert 0 < waiting.select("key").distinct().count() <= signals.BUCKETS
    signals.closing_row(ids, "2 hours").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    signals.run_to_table(signals.stream_reuse(stream, 300), f"{folder}/out", f"{folder}/cp")
    got = spark.read.parquet(f"{folder}/out")
    assert got.count() == 2 * keys
    assert tuple(got.where("reused").agg(F.min("request_id"), F.count("*")).first()) == (2**53 + 1 + keys, keys)


def test_a_pass_walks_only_to_the_leaves_it_counts():
    rng = np.random.default_rng(5)
    feature = np.where(np.arange(15) < 7, rng.integers(0, 3, 15), -1)
    left = np.where(feature >= 0, 2 * np.arange(15) + 1, 0)
    tree = Tree(feature, rng.integers(0, 9, 15), left, np.where(feature >= 0, left + 1, 0), rng.standard_normal(15), np.zeros(15))
    x = rng.integers(0, 9, (400, 3)).astype(np.uint8)
    rows, columns = np.flatnonzero(rng.random(400) < 0.7), np.ascontiguousarray(x.T)
    ends = walk(tree, x)
    for leaves in ([7], [8, 11, 14], list(range(7, 15))):
        got = {leaf: own.tolist() for leaf, own in trees.parts(tree, columns, rows, leaves)}
        assert got == {leaf: [r for r in rows.tolist() if ends[r] == leaf] for leaf in leaves}
    score = x[:, 0] / 7
    want = score + tree.value[ends]
    trees.add_tree(score, tree, columns)
    assert score.tolist() == want.tolist()


def test_what_reaches_a_pass(spark):
    """Drawn rows are bits and not numbers of rows, and pointwise curvatures, which are one, are not sent."""
    fit = boosting.RankerFit(training(spark, 10, 10), None, NAMES, [SMALL, replace(SMALL, objective="pointwise")])
    sent = fit._gradients(fit.settings).collect()
    assert sum(columns.shape[1] for columns, _ in sent) == 100
    for columns, settings in sent:
        assert columns.shape[0] == len(NAMES) and settings[1][2] is None
        for bits, gradient, _ in settings:
            assert bits.nbytes == -(-columns.shape[1] // 8)
            assert len(gradient) == np.unpackbits(bits, count=columns.shape[1]).sum()
    fit.close()
