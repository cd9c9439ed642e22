"""Headline queries on one scale factor; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from relrank.plans import catalog
from relrank.session import build_session

HEADLINE = [
    "resolve_judgments",
    "query_split",
    "bm25_scores",
    "bm25_topk",
    "tfidf_scores",
    "vector_topk",
    "feature_matrix",
    "metrics_candidates",
    "compare_models",
    "quality_checks",
    "compact_report",
    "rank_requests",
    "request_reuse",
    "latency_report",
    "table_fingerprint",
]

# Reports over one scored table: it is computed once, inside the measured time.
ERROR_ANALYSIS = [
    catalog.query_report,
    catalog.success_cases,
    catalog.loss_cases,
    catalog.failure_cases,
    catalog.by_length,
    catalog.by_type,
    catalog.by_category,
    catalog.ambiguous_queries,
    catalog.confusion,
    catalog.win_loss,
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.all_queries()
    run(queries["label_distribution"](spark, path))  # session start-up is not a query
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        run(queries[name](spark, path))
        times[name] = round(time.perf_counter() - start, 3)
    start = time.perf_counter()
    inputs = catalog.Inputs(spark, path)
    for build in ERROR_ANALYSIS:
        run(build(inputs))
    times["error_analysis_set"] = round(time.perf_counter() - start, 3)
    # The fit alone: the training frames are written before.
    catalog.training_frames(inputs)
    start = time.perf_counter()
    run(queries["ltr_lambdamart"](spark, path))
    times["ltr_lambdamart"] = round(time.perf_counter() - start, 3)
    out = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(path.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
