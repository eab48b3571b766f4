"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

A query that is not timed starts the session and compiles what all share; every query is then run three times, and
its median counts.

BENCH_QUERIES=all (or a comma-separated list of prefixes) selects other queries.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewater.plans.catalog import QUERIES  # noqa: E402
from tidewater.session import build_session, release_scratch  # noqa: E402

HEADLINE = (
    "g01_market_state_strict", "w01_last_n_ticks", "w02_rolling_metrics", "w03_moving_averages",
    "g05_keyed_window_counts", "g06_ohlc_bars", "f01_news_sentiment", "g17_headline_analysis", "p10_signal_history",
    "p03_normalized_ticks", "s12_decoded_messages", "p05_flattened_messages", "j01_orders_customers",
    "j05_reconciled_deployments", "j08_portfolio_holdings", "g07_stage_statistics", "g08_scope_summary",
    "w05_nearest_rank_p95", "w07_trimmed_history", "w09_cooldown", "m01_upsert", "m02_status_update",
    "k02_partitioned_write", "k06_dead_letters", "k11_http_payloads", "r02_stream_window_counts", "r03_stream_market_state",
)


def selected() -> list[str]:
    wanted = os.environ.get("BENCH_QUERIES")
    if not wanted:
        return list(HEADLINE)
    if wanted == "all":
        return list(QUERIES)
    return [q for q in QUERIES if q.startswith(tuple(wanted.split(",")))]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "6g"),
            "spark.checkpoint.dir": os.environ.get("BENCH_SCRATCH") or tempfile.mkdtemp(prefix="tidewater-bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # session start is not part of any query: one that is not timed runs before the clock starts
    QUERIES["u01_catalog_and_live_only"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    seconds = {}
    for name in selected():
        runs = []
        for _ in range(int(os.environ.get("BENCH_RUNS", "3"))):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
            release_scratch(spark)
        seconds[name] = round(statistics.median(runs), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
