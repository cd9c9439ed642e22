"""python tests/run_all.py <sf> [name ...]: every query against its SQL twin, with times."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from relrank.session import build_session  # noqa: E402
from tests import compare  # noqa: E402


def main() -> None:
    path = f"/root/testdata/sf{sys.argv[1]}"
    spark = build_session(
        "check", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = compare.database(path)
    sql = entry.oracle_sql()
    failures = 0
    for name, build in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            df = build(spark, path)
            if name in sql:
                problem = compare.difference(df, con, sql[name])
                note = "ok" if problem is None else "DIFF " + problem[:1500]
            else:
                rows = df.collect()
                note = f"rows {len(rows)} {rows[:1]}"[:300]
                problem = None
        except Exception as e:  # noqa: BLE001
            problem = note = "ERROR " + str(e)[:1500]
        failures += problem is not None
        print(f"{name:26s} {time.time() - start:6.1f}s {note}", flush=True)
    print("failures", failures)


main()
