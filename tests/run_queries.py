"""Command line: python tests/run_queries.py SF_DIR [name part ...] - compare queries with their SQL."""

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

import __spark_entry__ as app  # noqa: E402
from compare import difference, duck_bag, oracle, spark_bag  # noqa: E402
from conftest import make_session  # noqa: E402


def main(sf_dir: str, wanted: list[str]) -> None:
    spark, con, sql = make_session(), oracle(sf_dir), app.oracle_sql()
    bad = 0
    for name, fn in app.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            got = spark_bag(fn(spark, sf_dir))
            took = time.time() - start
            start = time.time()
            verdict = difference(got, duck_bag(con, sql[name])) if name in sql else "rows only"
            mark = "ok" if verdict is None else ("--" if verdict == "rows only" else "BAD")
            print(f"{mark:4}{name:36}{len(got[1]):8} rows {took:7.2f}s sql {time.time() - start:6.2f}s {verdict or ''}"[:900], flush=True)
            bad += mark == "BAD"
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERR {name:36} {type(e).__name__} {str(e)[:700]}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
