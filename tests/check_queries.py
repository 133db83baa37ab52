"""Run every registered query against its SQL: ``python -m tests.check_queries [sf_dir] [name..]``."""

from __future__ import annotations

import sys
import time
import traceback

import __spark_entry__ as contract
from repolumen.session import build_session
from tests.compare import connect, differences


def main(sf_dir: str, names: list[str]) -> int:
    spark = build_session(
        "check",
        "local[8]",
        {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(sf_dir), contract.oracle_sql(), 0
    for name, query in contract.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            problem = differences(df, con, oracles[name]) if name in oracles else f"rows {df.collect()[:2]}"
        except Exception as error:  # report and go on with the next query
            problem = "".join(traceback.format_exception_only(error))[:1500]
        took = time.time() - start
        weak = name not in oracles
        bad += bool(problem) and not weak
        print(f"{'ok  ' if not problem else 'weak' if weak else 'BAD '} {name} {took:.1f}s {problem or ''}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    sys.exit(main(sf, sys.argv[2:]) > 0)
