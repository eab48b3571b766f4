"""Run registered queries against their check SQL: python tests/run_checks.py [prefix ...] [--sf DIR]."""

from __future__ import annotations

import os
import sys
import tempfile
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checking import connect, difference  # noqa: E402
from tidewater.plans.catalog import ORACLES, QUERIES  # noqa: E402
from tidewater.session import build_session, release_scratch  # noqa: E402


def main() -> int:
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf_dir = args[i + 1]
        del args[i : i + 2]
    cpus = os.environ.get("TEST_CPUS", os.cpu_count())
    spark = build_session(
        "checks", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tidewater-checks-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, build in QUERIES.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            problem = difference(df, con, ORACLES[name]) if name in ORACLES else None
            note = "" if name in ORACLES else f" (rows only: {df.count()})"
        except Exception as exc:
            problem, note = f"{type(exc).__name__}: {str(exc)[:1500]}", ""
            if "-v" in sys.argv:
                traceback.print_exc()
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s{note} {problem or ''}", flush=True)
    release_scratch(spark)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
