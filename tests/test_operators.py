import math
import os
import random
import re
import statistics

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidewater import session
from tidewater.operators import conversation, cooldown, documents, fleet, listing, mutation, order_stats, rules, trials
from tidewater.sinks import lake


# --- order statistics ----------------------------------------------------------------------------


def nearest_rank(values):
    ordered = sorted(values)
    return ordered[round(0.95 * (len(ordered) - 1))]


@pytest.mark.parametrize("n", [1, 2, 5, 11, 30, 31, 999, 1000, 1001, 1002, 5000])
def test_exact_ranks(spark, n):
    rng = random.Random(n)
    data = [("g", rng.choice([rng.uniform(0, 10), float(rng.randrange(5))])) for _ in range(n)]
    (r,) = rows(order_stats.exact_summary(spark.createDataFrame(data, "g string, v double"), ["g"], "v"))
    values = [v for _, v in data]
    assert r["n"] == n
    assert r["p95"] == nearest_rank(values)
    assert r["median"] == pytest.approx(statistics.median(values))
    assert r["mean"] == pytest.approx(statistics.mean(values))
    assert r["std"] == pytest.approx(statistics.stdev(values) if n > 1 else 0.0)
    assert (r["min"], r["max"]) == (min(values), max(values))


def test_exact_ranks_with_one_hot_group_and_equal_values(spark):
    rng = random.Random(3)
    data = [("hot", round(rng.expovariate(1), 2)) for _ in range(20_000)] + [("same", 4.0)] * 3000
    data += [(f"g{i % 50}", rng.random()) for i in range(500)] + [("none", None)]
    got = {r["g"]: r for r in rows(order_stats.exact_median_and_p95(spark.createDataFrame(data, "g string, v double"), ["g"], "v"))}
    groups = {}
    for g, v in data:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g]["p95"] == nearest_rank(values) and got[g]["median"] == pytest.approx(statistics.median(values))


def test_ranks_of_a_large_group(spark):
    df = spark.range(200_000).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"))
    (r,) = rows(order_stats.exact_median_and_p95(df, ["g"], "v"))
    assert (r["median"], r["p95"]) == (99999.5, float(round(0.95 * 199_999)))


def scratch_rows(spark, before):
    """Rows of the scratch tables that were written since ``before`` paths were known."""
    return sum(spark.read.parquet(path).count() for path in session._scratch.get(id(spark.sparkContext), [])[before:])


def test_values_of_a_large_group_are_counted_not_moved(spark):
    n = 300_000
    df = spark.range(n).select(F.lit("g").alias("g"), F.sqrt("id").alias("v"))
    known = len(session._scratch.get(id(spark.sparkContext), []))
    (r,) = rows(order_stats.exact_summary(df, ["g"], "v"))
    assert r["n"] == n and r["median"] == pytest.approx((math.sqrt(n // 2 - 1) + math.sqrt(n // 2)) / 2)
    assert r["p95"] == math.sqrt(round(0.95 * (n - 1)))
    assert scratch_rows(spark, known) < n / 50


@pytest.mark.parametrize("range_rows", [10, 1 << 20])
def test_large_and_small_groups_with_odd_values(spark, monkeypatch, range_rows):
    """Both ways give what sorting gives; a small ``RANGE_ROWS`` divides cells again and again."""
    monkeypatch.setattr(order_stats, "CROWDED_ROWS", 50)
    monkeypatch.setattr(order_stats, "RANGE_ROWS", range_rows)
    rng = random.Random(range_rows)
    inf, nan = math.inf, math.nan
    pools = {
        "narrow": [1000 + rng.random() for _ in range(300)], "signs": [rng.gauss(0, 1) * 10 ** rng.randrange(-300, 300) for _ in range(301)],
        "ties": [4.0] * 200 + [4.0000000001] * 90 + [0.0, -0.0], None: [float(rng.randrange(9) - 4) for _ in range(400)],
        "ends": [-inf] * 70 + [inf] * 90 + [1.7e308, -1.7e308, 5e-324, -5e-324], "nan": [nan] * 60 + [inf] * 60 + [1.0, 2.0],
        "small": [3.0, 1.0, nan], "one": [7.0], "fifty": [rng.random() for _ in range(50)],
    }
    data = [(g, v) for g, values in pools.items() for v in values] + [("small", None), ("none", None)]
    rng.shuffle(data)
    got = {r["g"]: r for r in rows(order_stats.exact_summary(spark.createDataFrame(data, "g string, v double").repartition(3), ["g"], "v"))}
    assert set(got) == set(pools)
    for g, values in pools.items():
        ordered = sorted(values, key=lambda v: (v != v, v))
        n, r = len(ordered), got[g]
        want = {"n": n, "min": ordered[0], "max": ordered[-1], "p95": ordered[round(0.95 * (n - 1))]}
        want["median"] = (ordered[(n - 1) // 2] + ordered[n // 2]) / 2
        if all(map(math.isfinite, values)) and g != "signs":
            want |= {"mean": statistics.fmean(values), "std": statistics.stdev(values) if n > 1 else 0.0}
        for name, value in want.items():
            assert r[name] == pytest.approx(value, rel=1e-9, abs=1e-12, nan_ok=True) if name in ("mean", "std") else (r[name] == value or (value != value and r[name] != r[name])), (g, name)


def test_small_groups_are_shuffled_once(spark):
    df = spark.range(20_000).select((F.col("id") % 500).alias("g"), F.col("id").cast("double").alias("v"))
    known = len(session._scratch.get(id(spark.sparkContext), []))
    out = order_stats.exact_median_and_p95(df, ["g"], "v")
    assert len(rows(out)) == 500
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1
    assert out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hash") == 1
    assert scratch_rows(spark, known) == 0


def test_partitions_of_small_groups_follow_the_rows(spark):
    """A task sorts about ``RANGE_ROWS`` values, however many shuffle partitions the cluster is set to."""
    df = spark.createDataFrame([(1, 2.0)], "g int, v double")
    for millions in (50, 300):
        out = order_stats._sorted_summary(df, ["g"], millions * session.RANGE_ROWS, 0.95)
        assert f"{millions}), REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()


def test_many_partitions_are_reached_in_two_shuffles(spark, monkeypatch):
    """To more than 200 partitions a task would hold and sort all rows of its input before it writes them."""
    df = spark.range(5000).select((F.col("id") % 40).alias("g"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("v"))
    plan = lambda n: order_stats._sorted_summary(df, ["g"], n, 0.95)._jdf.queryExecution().executedPlan().toString()
    assert [f"{parts}), REPARTITION_BY_NUM" in plan(300 * session.RANGE_ROWS) for parts in (200, 300)] == [True, True]
    assert plan(200 * session.RANGE_ROWS).count("REPARTITION_BY_NUM") == 1
    want = rows(order_stats._sorted_summary(df, ["g"], 5000, 0.95), "g")
    monkeypatch.setattr(order_stats, "DIRECT_PARTITIONS", 3)
    out = order_stats._sorted_summary(df, ["g"], 7 * session.RANGE_ROWS, 0.95)
    assert out._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 2
    got = rows(out, "g")
    for r in [*got, *want]:
        r["std"] = round(r["std"], 9)
    assert got == want and len(got) == 40


def test_more_shuffle_partitions_than_tasks_can_write_to_directly_are_not_used(spark):
    df = spark.createDataFrame([(1, 2.0)], "g int, v double")
    spark.conf.set("spark.sql.shuffle.partitions", "1000")
    try:
        plan = order_stats._sorted_summary(df, ["g"], 36 * session.RANGE_ROWS, 0.95)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert "200), REPARTITION_BY_NUM" in plan and plan.count("REPARTITION_BY_NUM") == 1


def test_handoff_speedup_of_zero_is_infinite(spark):
    data = [(1, "serialized", 4.0, 1.0), (1, "serialized", 6.0, 3.0), (1, "zero_copy", 0.0, 1.0)]
    (r,) = rows(trials.handoff_speedup(spark.createDataFrame(data, "dataset_size int, path string, elapsed_ms double, peak_mem_mb double")))
    assert math.isinf(r["speedup"]) and r["serialized_mean_ms"] == 5.0 and r["zero_copy_std_ms"] == 0.0


def test_empty_mode_buckets_are_zero_filled(spark):
    columns = ", ".join(f"{c} double" for c in trials.STAGES.values())
    one = spark.createDataFrame([(1, "a", True, "fully_live", *[2.0] * 6)], f"trial int, system_name string, success boolean, mode_classification string, {columns}")
    got = {(r["scope"], r["stage"]): r for r in rows(trials.scope_summary(one))}
    assert len(got) == 4 * 6
    assert got[("partial_fallback", "total")]["p95_seconds"] == 0.0 and got[("partial_fallback", "total")]["trial_count"] == 0
    assert got[("overall", "signal")]["mean_seconds"] == 2.0 and got[("overall", "signal")]["std_seconds"] == 0.0


@pytest.mark.parametrize("n", [1, 2, 3, 40, 60_000])
def test_sketched_summary_is_exact(spark, n):
    """Groups made of others, with ties, nulls and NaN, against the same statistics by plain sorting."""
    rng = random.Random(n)
    data = [("g", rng.choice(["x", "y", None]), rng.choice([float(rng.randrange(50)), rng.gauss(0, 1e6)])) for _ in range(n)]
    data += [("h", "x", 2.0), ("g", "x", None), ("g", "y", float("nan")), ("only null", "x", None)]
    df = spark.createDataFrame(data, "g string, mode string, v double").repartition(5)
    got = rows(order_stats.sketched_summary(df, ["g"], "v", ["mode"], F.array(F.lit("all"), F.col("mode"))))
    lists = {}
    for g, mode, v in data:
        if v is not None and v == v:
            for scope in ("all", mode):
                lists.setdefault((g, scope), []).append(v)
    assert {(r["g"], r["scope"]) for r in got} == set(lists)
    for r in got:
        values = sorted(lists[r["g"], r["scope"]])
        assert (r["n"], r["min"], r["max"]) == (len(values), values[0], values[-1])
        assert r["median"] == statistics.median(values) and r["p95"] == values[round(0.95 * (len(values) - 1))]
        assert r["mean"] == pytest.approx(statistics.fmean(values)) and r["std"] == pytest.approx(statistics.stdev(values) if len(values) > 1 else 0.0)


def test_a_missed_bracket_is_noticed(spark, monkeypatch):
    monkeypatch.setattr(order_stats, "SLACK", -0.3)
    df = spark.range(5000).select(F.lit("g").alias("g"), F.pmod(F.xxhash64("id"), F.lit(10**6)).cast("double").alias("v"))
    want = rows(order_stats.exact_summary(df, ["g"], "v"))
    got = rows(order_stats.sketched_summary(df, ["g"], "v"))
    assert [r.pop("std") for r in got] == pytest.approx([r.pop("std") for r in want]) and got == want


# --- cooldown ------------------------------------------------------------------------------------


def fold(times, wait):
    fired, last = [], None
    for t in sorted(set(times)):
        if last is None or t - last >= wait:
            fired.append(t)
            last = t
    return fired


def test_cooldown_known_case(spark):
    data = [("scale", t * 1000, t) for t in (0, 60, 120, 200, 245)] + [("other", 60_000, 9)]
    got = rows(cooldown.fired_times(spark.createDataFrame(data, "k string, t bigint, id bigint"), "k", "t"), "k", "t")
    assert [(r["k"], r["t"]) for r in got] == [("other", 60_000), ("scale", 0), ("scale", 120_000), ("scale", 245_000)]


@pytest.mark.parametrize("blocks, wait, spread", [(1, 37, 3000), (7, 37, 3000), (60, 37, 3000), (30, 900, 3000), (20, 0, 3000), (25, 5, 10**13)])
def test_cooldown_equals_fold_for_any_block(spark, blocks, wait, spread):
    rng = random.Random(blocks)
    data = [("hot" if rng.random() < 0.8 else f"k{rng.randrange(5)}", rng.randrange(spread), i) for i in range(1500)]
    data += [(None, 5, 1), (None, 6, 2)]
    df = spark.createDataFrame(data, "k string, t bigint, id bigint")
    got = {}
    for r in rows(cooldown.fired_times(df, "k", "t", wait, blocks)):
        got.setdefault(r["k"], []).append(r["t"])
    expected = {}
    for k, t, _ in data:
        expected.setdefault(k, []).append(t)
    assert {k: sorted(v) for k, v in got.items()} == {k: fold(v, wait) for k, v in expected.items()}


def test_a_million_events_of_one_key(spark):
    """Most of them in one burst; the blocks that Spark deals are even, and the result is that of a plain fold."""
    burst = spark.range(1_000_000).select(F.lit("one").alias("k"), (F.col("id") * F.when(F.col("id") % 10 == 0, 977).otherwise(1)).alias("t"))
    got = sorted(r["t"] for r in cooldown.fired_times(burst, "k", "t", 120_000, 16).collect())
    assert got == fold([i * (977 if i % 10 == 0 else 1) for i in range(1_000_000)], 120_000)


def test_exempt_rows_fire_and_do_not_block(spark):
    data = [("a", 0, 1, False), ("a", 0, 2, False), ("a", 10, 3, True), ("a", 120_000, 4, False), ("a", 120_001, 5, True)]
    df = spark.createDataFrame(data, "k string, t bigint, id bigint, free boolean")
    got = rows(cooldown.mark_fired(df, "k", "t", "id", exempt=F.col("free")), "id")
    assert [r["fired"] for r in got] == [True, False, True, True, True]


# --- fleet ---------------------------------------------------------------------------------------


def classify(spark, status, states, running, unhealthy, alive):
    apps = spark.createDataFrame([("app", status, states, running, unhealthy)], "name string, app_status string, deployment_states array<string>, running bigint, unhealthy bigint")
    actors = spark.createDataFrame([("ALIVE", "app")] * alive, "state string, app_name string")
    (r,) = rows(fleet.classify_applications(apps, fleet.alive_replicas(actors)))
    return r["observed_status"], r["health_status"], r["recovery_state"], r["running_replicas"]


@pytest.mark.parametrize(
    "args, expected",
    [
        (("RUNNING", ["HEALTHY"], 1, 0, 0), ("ready", "healthy", "idle", 1)),
        (("DEPLOYING", ["UPDATING"], 0, 1, 0), ("recovering", "degraded", "recovering", 0)),
        (("DELETING", [], 1, 0, 1), ("missing", "offline", "idle", 1)),
        (("RUNNING", [], 2, 1, 2), ("degraded", "degraded", "idle", 2)),
        (("NOT_STARTED", [], 2, 0, 0), ("missing", "offline", "idle", 0)),
        (("UNHEALTHY", [], 0, 0, 0), ("degraded", "degraded", "failed", 0)),
        (("", [], 0, 0, 0), ("unknown", "unknown", "idle", 0)),
        (("NOT_STARTED", [], 2, 0, 1), ("unknown", "unknown", "idle", 1)),
        (("", [], 0, 0, 2), ("ready", "healthy", "idle", 2)),
    ],
)
def test_application_rules(spark, args, expected):
    assert classify(spark, *args) == expected


ENTRY = (
    "name string, app_name string, managed boolean, desired_status string, observed_status string, health_status string, "
    "recovery_state string, last_action_type string, last_failure_reason string, last_reconciled_ms bigint"
)
APP = "name string, observed_status string, health_status string, recovery_state string, failure_reason string, running_replicas int, unhealthy_replicas int"


def reconcile(spark, app=None, available=True, now=100_000, **entry):
    values = dict(name="x", app_name=None, managed=True, desired_status="running", observed_status="ready", health_status="healthy",
                  recovery_state="idle", last_action_type=None, last_failure_reason=None, last_reconciled_ms=None) | entry
    catalog = spark.createDataFrame([tuple(values.values())], ENTRY)
    apps = spark.createDataFrame([app] if app else [], APP)
    (r,) = rows(fleet.reconcile(catalog, apps, F.lit(now), available))
    return r


def test_reconcile_branches(spark):
    absent = reconcile(spark)
    assert (absent["observed_status"], absent["health_status"], absent["alive"]) == ("missing", "offline", False)
    assert reconcile(spark, desired_status="stopped")["observed_status"] == "offline"
    ready = reconcile(spark, ("x", "ready", "healthy", "idle", None, 2, 0))
    assert ready["alive"] and ready["alive_count"] == 2
    assert reconcile(spark, recovery_state="recovering", last_action_type="scale_up")["observed_status"] == "recovering"
    respawn = dict(recovery_state="recovering", last_action_type=" RESPAWN ")
    held = reconcile(spark, last_reconciled_ms=40_000, **respawn)
    assert (held["observed_status"], held["recovery_state"], held["alive"]) == ("recovering", "recovering", True)
    late = reconcile(spark, last_reconciled_ms=39_999, **respawn)
    assert (late["observed_status"], late["health_status"], late["recovery_state"]) == ("missing", "offline", "failed")
    late_app = reconcile(spark, ("x", "recovering", "degraded", "recovering", None, 0, 1), last_reconciled_ms=None, **respawn)
    assert (late_app["observed_status"], late_app["health_status"]) == ("degraded", "degraded")
    down = reconcile(spark, available=False, health_status="unknown", observed_status="stale")
    assert (down["observed_status"], down["health_status"]) == ("stale", "degraded")


def test_health_of_an_empty_fleet(spark):
    empty = spark.createDataFrame([], "managed boolean, desired_status string, observed_status string")
    assert rows(fleet.fleet_health(empty))[0]["healthy"] is True
    assert rows(fleet.fleet_health(empty, runtime_available=False))[0]["healthy"] is False
    none = spark.createDataFrame([], "snapshot_ts bigint, service string, healthy boolean")
    assert rows(fleet.snapshot_health(none))[0]["status"] == "unknown"


def test_unconstrained_match_keeps_all_alive(spark):
    caps = spark.createDataFrame(
        [("a", "x", ["t"], ["alt"], None, None, "invoke", True), ("b", "y", [], [], None, None, "chat", False)],
        "agent string, id string, tags array<string>, aliases array<string>, input_type string, output_type string, interaction_mode string, alive boolean",
    )
    assert [r["agent"] for r in rows(fleet.match_capabilities(caps))] == ["a"]
    assert len(rows(fleet.match_capabilities(caps, alive_only=False))) == 2
    assert [r["agent"] for r in rows(fleet.match_capabilities(caps, "ALT", [" T "]))] == ["a"]
    assert rows(fleet.match_capabilities(caps, "x", ["t", "u"])) == []


# --- rules ---------------------------------------------------------------------------------------


def lag(spark, topics, alive):
    df = spark.createDataFrame([(t, n, 0) for t, n in topics], "topic string, high bigint, committed bigint")
    return rows(rules.lag_actions(rules.lag_totals(df), F.lit(alive), "w"))


def test_lag_rule(spark):
    assert lag(spark, [("t", 100)], 3) == []
    (up,) = lag(spark, [("news", 200), ("market_data", 800)], 3)
    assert (up["action"], up["count"]) == ("scale_up", 2) and "market_data" in up["reason"] and "1000" in up["reason"]
    (down,) = lag(spark, [("t", 0)], 3)
    assert down["action"] == "scale_down"
    assert lag(spark, [("t", 0)], 2) == []
    assert lag(spark, [("t", 500)], 3) == [] and len(lag(spark, [("t", 501)], 3)) == 1


def test_lag_ignores_negative_commits(spark):
    df = spark.createDataFrame([("t", 10, -1001), ("t", 5, 9)], "topic string, high bigint, committed bigint")
    assert rows(rules.lag_by_topic(df)) == [{"topic": "t", "lag": 10}]


def test_cpu_rule(spark):
    data = [("hot", "9", "10", 1), ("idle", "1", "10", 2), ("last", "1", "10", 1), ("bad", "x", "10", 5), ("none", None, None, 2), ("edge", "8.5", "10", 9)]
    got = rows(rules.cpu_actions(spark.createDataFrame(data, "cluster string, cpu_used string, cpu_total string, alive bigint"), "w"), "cluster")
    assert [(r["cluster"], r["action"]) for r in got] == [("hot", "scale_up"), ("idle", "scale_down"), ("none", "scale_down")]


def test_staleness_rule(spark):
    data = [("lake", "old", 100_000, None), ("lake", "new", 700_001, None), ("lake", "empty", None, None), ("lake", "zero", 0, None), ("lake", "bad", 1, "e")]
    got = rows(rules.staleness_actions(spark.createDataFrame(data, "service string, table_name string, latest_commit_ms bigint, error string"), F.lit(1_000_001)))
    assert [r["agent"] for r in got] == ["lake/old"] and "900.0 seconds" in got[0]["reason"]


def test_ranges_of_a_page():
    counts = [(0, 10), (1, 0), (2, 7), (4, 10)]
    every = [(n, i) for n, size in counts for i in range(size)]
    for first in range(30):
        for size in (1, 4, 12):
            wanted, skip = listing.ranges_of_page(counts, first, size)
            held = [x for x in every if x[0] in wanted]
            assert held[skip : skip + size] == every[first : first + size] and set(wanted) == {n for n, _ in every[first : first + size]}


def test_deep_pages_read_few_ranges(spark, tmp_path):
    df = spark.range(9_000).select((F.col("id") * 7 % 9_000).alias("x"), F.col("id").alias("y"))
    order, path = [F.col("x").desc(), F.col("y")], str(tmp_path / "ordered")
    listing.write_in_order(df, order, path, rows=1000)
    for page in (1, 45, 88, 90, 91):
        got = listing.ordered_page(spark, path, order, page, 100)
        assert [r["x"] for r in got.collect()] == list(range(8_999, -1, -1))[(page - 1) * 100 : page * 100]
    plan = listing.ordered_page(spark, path, order, 45, 100)._jdf.queryExecution().executedPlan().toString()
    (pruned,) = re.findall(r"PartitionFilters: \[[^\]]*\]", plan)
    assert len(re.findall(r"\d+", pruned.split("_range", 1)[1])) <= 4


def test_log_search_prunes_days(spark, tmp_path):
    path = str(tmp_path / "logs")
    logs = spark.range(40).select(
        F.timestamp_seconds(F.col("id") * 43_200).alias("time"), *[F.lit("x").alias(c) for c in listing.LOG_COLUMNS[1:]]
    )
    lake.append_logs(logs, path)
    now = F.timestamp_seconds(F.lit(19 * 86_400))
    found = listing.search_logs(spark.read.parquet(path), now, since="2d")
    assert found.count() == 6
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*day#\d+ >= 1970-01-18|PartitionFilters: \[[^\]]*day#\d+ >= 17\b", plan), plan


def test_commit_times_of_stored_tables(spark, tmp_path):
    paths = {name: str(tmp_path / name) for name in ("fresh", "stale", "missing")}
    for name in ("fresh", "stale"):
        spark.range(10).repartition(2).write.parquet(paths[name])
    for file in (tmp_path / "stale").iterdir():
        os.utime(file, (1000, 1000))
    times = rules.commit_times(spark, paths)
    got = {r["table_name"]: r for r in rows(times)}
    assert got["stale"]["latest_commit_ms"] == 1_000_000 and got["missing"]["error"] and got["missing"]["latest_commit_ms"] is None
    assert got["fresh"]["latest_commit_ms"] > 10**12
    now = F.lit(got["fresh"]["latest_commit_ms"] + 60_000)
    assert [r["agent"] for r in rows(rules.staleness_actions(times, now, 3600))] == ["lake/stale"]


def test_rule_book_isolates_failures(spark, tmp_path):
    (tmp_path / "good.py").write_text(
        "NAME = 'always'\n\ndef rule(tables):\n    return tables['t'].selectExpr(\"'alert' action\", \"'x' target\", \"'a' agent\", \"'' deployment_name\", '1 count', \"'r' reason\")\n"
    )
    (tmp_path / "broken.py").write_text("raise RuntimeError('no')\n")
    (tmp_path / "late.py").write_text("def rule(tables):\n    return tables['missing']\n")
    book = rules.RuleBook()
    assert book.load(str(tmp_path)) == ["always", "late"]
    got = rows(book.evaluate(spark, {"t": spark.range(2)}))
    assert [r["rule"] for r in got] == ["always", "always"] and set(book.failures) == {"broken", "late"}


# --- table changes -------------------------------------------------------------------------------


def test_upsert_keeps_registration_time(spark):
    schema = "name string, id int, status string, registered_at string"
    old = spark.createDataFrame([("a", 1, "s", "t0"), ("b", 2, "s", "t0"), ("c", 3, "s", None)], schema)
    new = spark.createDataFrame([("a", 9, "n", None), ("b", 9, None, "t1"), ("d", 4, "n", None)], schema)
    got = rows(mutation.upsert(old, new), "name")
    assert [tuple(r.values()) for r in got] == [
        ("a", 1, "n", "t0"), ("b", 2, None, "t1"), ("c", 3, "s", None), ("d", 4, "n", None)
    ]


def test_partial_update_flags(spark):
    old = spark.createDataFrame([("a", "s", "why"), ("b", "s", "why"), ("c", "s", "why")], "name string, status string, reason string")
    changes = spark.createDataFrame([("a", "x", False, "new"), ("b", "x", True, None)], "name string, status string, set_reason boolean, reason string")
    got = rows(mutation.partial_update(old, changes, replace=("status",), if_flagged=("reason",)), "name")
    assert [tuple(r.values()) for r in got] == [("a", "x", "why"), ("b", "x", None), ("c", "s", "why")]


def test_context_expiry_and_lists(spark):
    ops = spark.createDataFrame(
        [
            (1, "a", "set", '"v"', "o", None, 0), (2, "b", "set", "1", "o", 10, 0), (3, "l", "append", "1", "o", None, 0),
            (4, "l", "append", "2", "o", None, 5), (5, "m", "set", "0", "o", None, 0), (6, "m", "append", "7", "o", None, 1),
            (7, "d", "set", "1", "o", None, 0), (8, "d", "delete", None, "o", None, 1),
            (9, "s", "set", "[4, {\"x\": 5}]", "o", None, 0), (10, "s", "append", "6", "o", None, 1),
        ],
        "seq bigint, key string, op string, value_json string, owner string, ttl_s bigint, ts_ms bigint",
    )
    live = rows(mutation.context_entries(ops, F.lit(10_000)), "key")
    assert [r["key"] for r in live] == ["a", "l", "m", "s"]
    assert [r["key"] for r in rows(mutation.context_entries(ops, F.lit(9_999)), "key")] == ["a", "b", "l", "m", "s"]
    elements = rows(mutation.context_elements(ops, F.lit(10_000)), "key", "ts_ms", "pos")
    assert [(r["key"], r["value_json"]) for r in elements] == [
        ("l", "1"), ("l", "2"), ("m", "7"), ("s", "4"), ("s", '{"x":5}'), ("s", "6")
    ]
    assert [r["key"] for r in rows(mutation.context_keys(ops, F.lit(10_000), "l%"))] == ["l"]


@pytest.mark.parametrize("chunk_ms", [1, 20_000, 10**9])
def test_a_list_that_expired_starts_again(spark, chunk_ms):
    columns = "seq bigint, key string, op string, value_json string, owner string, ttl_s bigint, ts_ms bigint"
    ops = spark.createDataFrame(
        [
            (1, "k", "append", "1", "o", 10, 0), (2, "k", "append", "2", "o", None, 100_000),
            (3, "j", "append", "1", "o", 10, 0), (4, "j", "append", "2", "o", None, 9_999), (5, "j", "append", "3", "o", 1, 90_000),
            (6, "g", "set", "[1]", "o", 5, 0), (7, "g", "append", "2", "o", 5, 4_000), (8, "g", "append", "3", "o", 900, 9_000),
            (9, "g", "append", "4", "o", None, 9_001),
        ],
        columns,
    )
    got = rows(mutation.context_elements(ops, F.lit(90_500), chunk_ms), "key", "seq")
    assert [(r["key"], r["value_json"]) for r in got] == [("g", "3"), ("g", "4"), ("j", "1"), ("j", "2"), ("j", "3"), ("k", "2")]
    present = {r["key"]: r["present"] for r in rows(mutation.context_exists(ops, F.lit(91_000)))}
    assert present == {"g": True, "j": False, "k": True}
    assert {r["key"]: r["expires_ms"] for r in rows(mutation.context_info(ops, F.lit(90_500)))} == {"g": None, "j": 91_000, "k": None}


def test_delete_stale_and_conform(spark):
    t = spark.createDataFrame([("a", "alive", 5), ("b", "alive", 50), ("c", "alive", None)], "name string, status string, last_heartbeat_at bigint")
    remaining, affected = mutation.delete_keys(t, spark.createDataFrame([("a",), ("z",)], "name string"))
    assert [r["name"] for r in rows(remaining, "name")] == ["b", "c"] and rows(affected) == [{"affected": 1}]
    marked, count = mutation.mark_stale(t, F.lit(10))
    assert [r["status"] for r in rows(marked, "name")] == ["stale", "alive", "alive"] and rows(count) == [{"affected": 1}]
    grown = mutation.conform(t)
    assert rows(grown, "name")[0]["desired_status"] == "running" and grown.columns[:3] == t.columns


# --- conversations, documents, listings ------------------------------------------------------------


def history(spark, messages, **limits):
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(messages)], "conv_id bigint, turn bigint, role string, text string")
    return [r["turn"] for r in sorted(rows(conversation.trim_history(df, **limits)), key=lambda r: r["turn"])]


def test_history_trimming(spark):
    assert history(spark, [("system", "s")] + [("user", "x")] * 21) == [0] + list(range(2, 22))
    assert history(spark, [("user", "x")] * 21) == list(range(1, 21))
    assert history(spark, [("system", "s" * 40), ("user", "a" * 40), ("user", "b" * 4000), ("user", "c" * 40)], max_tokens=30) == [0, 3]
    assert history(spark, [("user", "x"), ("system", "s"), ("user", "y")], max_messages=2) == [1, 2]
    assert history(spark, [("system", "s")]) == [0]


def test_latest_user_message_falls_back(spark):
    df = spark.createDataFrame([(1, 0, "user", " hi "), (1, 1, "assistant", "yes"), (2, 0, "assistant", " only ")], "conv_id bigint, turn bigint, role string, text string")
    assert {r["conv_id"]: r["message"] for r in rows(conversation.latest_user_message(df))} == {1: "hi", 2: " only "}


def test_next_value(spark):
    df = spark.createDataFrame([("two", 0, "1"), ("two", 1, "x"), ("two", 2, "3"), ("one", 0, "5"), ("none", 0, "x")], "k string, i int, v string")
    got = {r["k"]: (r["input_points"], r["next_value"]) for r in rows(conversation.next_value(df, "k", ["i"], "v"))}
    assert got == {"two": (2, 5.0), "one": (1, 5.0), "none": (0, 0.0)}


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_html_to_text(spark):
    html = "<html><head><style>p{}</style><SCRIPT>var a='<p>';</script ></head><!-- <b>no</b> --><body>A&amp;B&nbsp;<b>c</b>\n d &lt;e&gt;</body></html>"
    assert one(spark, documents.html_to_text, html) == "A&B c d <e>"
    assert one(spark, documents.url_key, "https://x.org/en/685?page=2&ref=x#top") == "685"


def test_fenced_json(spark):
    parse = lambda t: one(spark, lambda c: documents.parse_response(c, "a int"), t)
    assert parse('```json\n{"a": 1}\n```')["a"] == 1
    assert parse('{"a": 2}')["a"] == 2
    assert parse("no json") is None and parse(None) is None


def test_embedded_json(spark):
    df = spark.createDataFrame([("1", 'log\n\n  {"a": 1,\n"b": 2}'), ("2", "{bad\nstill"), ("3", '{bad\n{"a": 3}')], "run_id string, stdout string")
    got = {r["run_id"]: r["payload"] for r in rows(documents.embedded_json(df))}
    assert got == {"1": '  {"a": 1,\n"b": 2}', "2": None, "3": '{"a": 3}'}


@pytest.mark.parametrize("text, expected", [("30m", (30, "minutes")), ("24H", (24, "hours")), ("7d", (7, "days")), ("abc", (1, "hours")), ("", (1, "hours")), ("5x", (1, "hours"))])
def test_since(text, expected):
    assert listing.since_interval(text) == expected


def test_history_is_oldest_first(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "t int")
    assert [r["t"] for r in listing.history(df, ["t"], 2).collect()] == [3, 4]


def test_page_counts_when_divisible(spark):
    assert rows(listing.page_counts(spark.range(100), 50)) == [{"total": 100, "pages": 2, "total_pages": 3}]
