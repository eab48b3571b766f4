"""Registered trial statistics, conversations, listings and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater import api
from tidewater.functions.numeric import rounded
from tidewater.operators import conversation, listing, order_stats, trials
from tidewater.plans.inputs import CATALOG, NOW_MS, SYSTEMS, TICKS, TRIALS, catalog, ticks, trials as trial_input
from tidewater.plans.registry import query, r
from tidewater.session import scratch_path, table
from tidewater.sinks import lake

P95 = "CAST(round_even(0.95 * (count(*) - 1), 0) AS BIGINT)"


def stats_sql(value: str) -> str:
    """Six statistics; the nearest-rank p95 indexes the sorted list of the group."""
    return f"""{r(f'avg({value})', 6)} AS mean_seconds, {r(f'coalesce(stddev_samp({value}), 0.0)', 6)} AS std_seconds,
      {r(f'median({value})', 6)} AS median_seconds, {r(f'min({value})', 6)} AS min_seconds, {r(f'max({value})', 6)} AS max_seconds,
      {r(f'list_sort(list({value}))[{P95} + 1]', 6)} AS p95_seconds"""


def _rounded(df, keys):
    return df.select(*keys, *[rounded(F.col(c), 6).alias(c) for c in df.columns if c not in keys])


@query("g07_stage_statistics", f"WITH {TRIALS} SELECT system_name, stage, {stats_sql('seconds')} FROM stage_rows GROUP BY 1, 2")
def stage_statistics(spark, sf_dir):
    return _rounded(trials.stage_statistics(trial_input(spark, sf_dir)), ["system_name", "stage"])


@query(
    "g08_scope_summary",
    f"""WITH {TRIALS}, scoped AS (SELECT system_name, 'overall' AS scope, stage, seconds FROM stage_rows
        UNION ALL SELECT system_name, mode, stage, seconds FROM stage_rows),
    stats AS (SELECT system_name, scope, stage, {stats_sql('seconds')} FROM scoped GROUP BY 1, 2, 3),
    counts AS (SELECT system_name, 'overall' AS scope, count(*) AS trial_count FROM trials GROUP BY 1
        UNION ALL SELECT system_name, mode, count(*) FILTER (WHERE success) FROM trials WHERE mode <> 'failed' GROUP BY 1, 2)
    SELECT * FROM counts JOIN stats USING (system_name, scope)""",
)
def scope_summary(spark, sf_dir):
    return _rounded(trials.scope_summary(trial_input(spark, sf_dir)), ["system_name", "scope", "stage", "trial_count"])


@query(
    "g08_system_counts",
    f"""WITH {TRIALS} SELECT system_name, count(*) AS trial_count, count(*) FILTER (WHERE success) AS success_count,
      count(*) FILTER (WHERE NOT success) AS failure_count,
      {', '.join(f"count(*) FILTER (WHERE success AND mode = '{m}') AS {m}_count" for m in trials.MODE_BUCKETS)}
    FROM trials GROUP BY 1""",
)
def system_counts(spark, sf_dir):
    return trials.system_counts(trial_input(spark, sf_dir))


@query(
    "g09_comparison",
    f"""WITH {TRIALS}, m AS (SELECT system_name, avg(total) FILTER (WHERE success) AS mean FROM trials GROUP BY 1)
    SELECT arg_min(system_name, mean) AS fastest_mean_system,
      {r("max(mean) FILTER (WHERE system_name = 'sequential') / max(mean) FILTER (WHERE system_name = 'integrated')", 6)} AS sequential_over_integrated_ratio,
      {r("max(mean) FILTER (WHERE system_name = 'spark_glue') / max(mean) FILTER (WHERE system_name = 'integrated')", 6)} AS spark_glue_over_integrated_ratio,
      (SELECT count(DISTINCT trial) FROM trials) AS trial_count, (SELECT count(*) FROM trials) AS row_count FROM m""",
)
def comparison(spark, sf_dir):
    return _rounded(
        trials.comparison(trial_input(spark, sf_dir), "integrated", list(SYSTEMS)),
        ["fastest_mean_system", "trial_count", "row_count"],
    )


@query(
    "g10_handoff_speedup",
    f"""WITH t AS (SELECT l_linenumber AS dataset_size, CASE l_linestatus WHEN 'F' THEN 's' ELSE 'z' END AS path,
          l_extendedprice AS ms, l_quantity AS mem FROM lineitem),
    a AS (SELECT dataset_size, path, avg(ms) AS mean, coalesce(stddev_samp(ms), 0) AS std, median(ms) AS med, avg(mem) AS mem FROM t GROUP BY 1, 2)
    SELECT dataset_size,
      {', '.join(f"{r(f'max({c}) FILTER (WHERE path = {q}{k}{q})', 4)} AS {n}_{o}" for k, n in (('s', 'serialized'), ('z', 'zero_copy'))
                 for c, o, q in (('mean', 'mean_ms', chr(39)), ('std', 'std_ms', chr(39)), ('med', 'median_ms', chr(39)), ('mem', 'mean_peak_mem_mb', chr(39))))},
      {r("max(mean) FILTER (WHERE path = 's') / max(mean) FILTER (WHERE path = 'z')", 4)} AS speedup
    FROM a GROUP BY 1""",
)
def speedup(spark, sf_dir):
    """Line numbers as data sizes, line status as the path, price as latency, quantity as memory."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("dataset_size"), F.when(F.col("l_linestatus") == "F", "serialized").otherwise("zero_copy").alias("path"),
        F.col("l_extendedprice").alias("elapsed_ms"), F.col("l_quantity").alias("peak_mem_mb"),
    )
    out = trials.handoff_speedup(li)
    return out.select("dataset_size", *[rounded(F.col(c), 4).alias(c) for c in out.columns if c != "dataset_size"])


RECOVERY = """t AS (SELECT CASE o_orderstatus WHEN 'P' THEN 'automatic' ELSE 'manual' END AS mode, o_orderkey % 10 <> 0 AS success,
    CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS mttr FROM orders)"""


def _recovery(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") == "P", "automatic").otherwise("manual").alias("mode"), (F.col("o_orderkey") % 10 != 0).alias("success"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("mttr_seconds"),
    )


@query(
    "g11_recovery_summary",
    f"""WITH {RECOVERY}, ok AS (SELECT mode, mttr FROM t WHERE success AND mttr IS NOT NULL)
    SELECT mode, (SELECT count(*) FROM t WHERE t.mode = ok.mode) AS trial_count, count(*) AS success_count,
      (SELECT count(*) FROM t WHERE t.mode = ok.mode) - count(*) AS failure_count, {r('avg(mttr)', 4)} AS mean_mttr_seconds,
      {r('coalesce(stddev_samp(mttr), 0)', 4)} AS std_mttr_seconds, {r('min(mttr)', 4)} AS min_mttr_seconds, {r('max(mttr)', 4)} AS max_mttr_seconds,
      {r(f'list_sort(list(mttr))[{P95} + 1]', 4)} AS p95_mttr_seconds FROM ok GROUP BY mode""",
)
def recovery(spark, sf_dir):
    out = trials.recovery_summary(_recovery(spark, sf_dir))
    return out.select(*[rounded(F.col(c), 4).alias(c) if c.endswith("_seconds") else F.col(c) for c in out.columns])


@query(
    "g11_recovery_comparison",
    f"""WITH {RECOVERY}, m AS (SELECT avg(mttr) FILTER (WHERE success AND mode = 'automatic') AS a, avg(mttr) FILTER (WHERE success AND mode = 'manual') AS b FROM t)
    SELECT {r('b / a', 6)} AS manual_over_automatic_ratio, {r('(b - a) / b * 100.0', 6)} AS automatic_improvement_pct FROM m""",
)
def recovery_comparison(spark, sf_dir):
    out = trials.recovery_comparison(_recovery(spark, sf_dir), "automatic", "manual")
    return out.select(*[rounded(F.col(c), 6).alias(c) for c in out.columns])


@query(
    "w05_nearest_rank_p95",
    f"""SELECT l_suppkey, count(*) AS n, {r('median(l_extendedprice)', 4)} AS median, list_sort(list(l_extendedprice))[{P95} + 1] AS p95
    FROM lineitem GROUP BY 1""",
)
def nearest_rank(spark, sf_dir):
    out = order_stats.exact_median_and_p95(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice")
    return out.withColumn("median", rounded(F.col("median"), 4))


# --- conversations ----------------------------------------------------------------------------------


@query(
    "w07_trimmed_history",
    """WITH f AS (SELECT conv_id, min(turn) AS t0, arg_min(role, turn) = 'system' AS sys, arg_min(length(text) // 4, turn) AS sys_tokens
                  FROM conversations GROUP BY 1),
    others AS (SELECT c.conv_id, turn, role, length(text) // 4 AS tokens, CASE WHEN sys THEN sys_tokens ELSE 0 END AS base,
        row_number() OVER (PARTITION BY c.conv_id ORDER BY turn DESC) AS rn
      FROM conversations c JOIN f USING (conv_id) WHERE NOT (sys AND turn = t0)),
    kept AS (SELECT conv_id, turn, role, tokens, base + sum(tokens) OVER (PARTITION BY conv_id ORDER BY rn) AS used FROM others WHERE rn <= 3)
    SELECT conv_id, turn, role, tokens FROM kept WHERE used <= 200
    UNION ALL SELECT conv_id, turn, role, length(text) // 4 FROM conversations JOIN f USING (conv_id) WHERE sys AND turn = t0""",
)
def trimmed_history(spark, sf_dir):
    """Limits of 3 messages and 200 tokens, so that both of them bite on the given conversations."""
    out = conversation.trim_history(table(spark, sf_dir, "conversations"), 3, 200)
    return out.select("conv_id", "turn", "role", "tokens")


@query(
    "w07_default_limits",
    """WITH f AS (SELECT conv_id, min(turn) AS t0, arg_min(role, turn) = 'system' AS sys, arg_min(length(text) // 4, turn) AS sys_tokens
                  FROM conversations GROUP BY 1),
    others AS (SELECT c.conv_id, turn, role, length(text) // 4 AS tokens, CASE WHEN sys THEN sys_tokens ELSE 0 END AS base,
        row_number() OVER (PARTITION BY c.conv_id ORDER BY turn DESC) AS rn
      FROM conversations c JOIN f USING (conv_id) WHERE NOT (sys AND turn = t0)),
    kept AS (SELECT conv_id, turn, role, tokens, base + sum(tokens) OVER (PARTITION BY conv_id ORDER BY rn) AS used FROM others WHERE rn <= 20)
    SELECT conv_id, turn, role, tokens FROM kept WHERE used <= 4000
    UNION ALL SELECT conv_id, turn, role, length(text) // 4 FROM conversations JOIN f USING (conv_id) WHERE sys AND turn = t0""",
)
def default_history(spark, sf_dir):
    return conversation.trim_history(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "tokens")


@query(
    "w06_next_value",
    f"""WITH e AS (SELECT user_id, value, event_id, event_type = 'error' AS bad, ts FROM events),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM e WHERE NOT bad),
    p AS (SELECT user_id, count(*) AS input_points, max(value) FILTER (WHERE rn = 1) AS a, max(value) FILTER (WHERE rn = 2) AS b FROM n GROUP BY 1)
    SELECT u.user_id, coalesce(input_points, 0) AS input_points, {r('coalesce(a + coalesce(a - b, 0.0), 0.0)', 2)} AS next_value
    FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN p USING (user_id)""",
)
def next_value(spark, sf_dir):
    """Values of error events are unreadable text and are skipped."""
    e = table(spark, sf_dir, "events").withColumn(
        "reading", F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string"))
    )
    return conversation.next_value(e, "user_id", ["ts", "event_id"], "reading")


# --- listings ---------------------------------------------------------------------------------------


@query(
    "w04_newest_snapshots",
    """SELECT event_id, epoch_us(ts) // 1000 AS ts_ms, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 200""",
)
def snapshots(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), "event_type", "value"
    )
    return listing.history(e, ["ts_ms", "event_id"], 200)


@query("w04_newest_alerts", "SELECT event_id, user_id, value FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100")
def alerts(spark, sf_dir):
    errors = table(spark, sf_dir, "events").filter("event_type = 'error'")
    return listing.newest(errors, ["ts", "event_id"], 100).select("event_id", "user_id", "value")


@query("t01_sorted_ticks", f'WITH {TICKS} SELECT id, symbol, CASE WHEN id % 11 <> 0 THEN "timestamp" ELSE 0 END AS at FROM ticks')
def sorted_ticks(spark, sf_dir):
    """Ticks in time order, those without a time first."""
    t = ticks(spark, sf_dir).select("id", "symbol", F.when(F.col("id") % 11 != 0, F.col("timestamp")).alias("timestamp"))
    at = F.coalesce("timestamp", F.lit(0))
    return t.orderBy(at, "id").select("id", "symbol", at.alias("at"))


@query("t02_latest_prices", f'WITH {TICKS} SELECT id, close, volume FROM ticks WHERE symbol = \'purchase\' ORDER BY "timestamp" DESC, id DESC LIMIT 5')
def latest_prices(spark, sf_dir):
    t = ticks(spark, sf_dir).filter(F.col("symbol") == "purchase")
    return listing.newest(t, ["timestamp", "id"], 5).select("id", "close", "volume")


@query(
    "t04_log_search",
    """SELECT epoch_us(ts) // 1000 AS time_ms, event_id, 'agent' || CAST(user_id AS VARCHAR) AS agent_name, props AS metadata FROM events
       WHERE ts >= TIMESTAMP '2024-01-24 00:00:00' AND event_type = 'error' AND value > 0 ORDER BY ts DESC, event_id DESC LIMIT 500""",
)
def log_search(spark, sf_dir):
    """Events as a written log table: type as component; errors of the last seven days, at most 500 although 800 are asked for."""
    e = table(spark, sf_dir, "events")
    logs = e.select(
        F.col("ts").cast("timestamp").alias("time"), F.col("event_type").alias("component"), F.lit("ERROR").alias("level"),
        F.lit("").alias("message"), F.lpad(F.col("event_id").cast("string"), 19, "0").alias("trace_id"),
        F.concat(F.lit("agent"), F.col("user_id").cast("string")).alias("agent_name"), F.col("props").alias("metadata"),
    )
    path = scratch_path(spark, "logs")
    lake.append_logs(logs, path)
    found = listing.search_logs(
        spark.read.parquet(path), F.lit("2024-01-31 00:00:00").cast("timestamp"),
        component="error", level="error", since="7d", limit=800, tie=["trace_id"],
    )
    return found.select(F.unix_millis("time").alias("time_ms"), F.col("trace_id").cast("bigint").alias("event_id"), "agent_name", "metadata")


@query(
    "t06_minimum_rows_gate",
    """SELECT user_id, count(*) AS row_count, count(*) >= 70 AS passed,
       CASE WHEN count(*) < 70 THEN 'only ' || CAST(count(*) AS VARCHAR) || ' rows; at least 70 needed' END AS error FROM events GROUP BY 1""",
)
def gate(spark, sf_dir):
    return listing.row_gate(table(spark, sf_dir, "events"), "user_id", 70)


@query("t03_preview", "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents ORDER BY doc_id LIMIT 10")
def preview(spark, sf_dir):
    """The first rows of a table by key, as the read surface previews them; the cut is the feature."""
    rows = api.preview(spark, f"{sf_dir}/documents.parquet", order=["doc_id"])
    return rows.select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(
    "s19_listing_page",
    """SELECT event_id, epoch_us(ts) // 1000 AS ts_ms, value FROM events WHERE lower(event_type) = 'click' ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100""",
)
def listing_page(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = listing.page(e, [F.col("ts").desc(), F.col("event_id").desc()], 3, 50, {"event_type": "CLICK", "user_id": None})
    return rows.select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), "value")


@query(
    "s19_deep_page",
    "SELECT event_id, epoch_us(ts) // 1000 AS ts_ms, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 4950",
)
def deep_page(spark, sf_dir):
    """The hundredth page of all events, newest first, from a table written in that order."""
    order, path = [F.col("ts").desc(), F.col("event_id").desc()], scratch_path(spark, "in-order")
    listing.write_in_order(table(spark, sf_dir, "events"), order, path)
    rows = listing.ordered_page(spark, path, order, 100, 50)
    return rows.select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), "value")


@query(
    "s19_page_counts",
    "SELECT count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages, count(*) // 50 + 1 AS total_pages FROM events WHERE event_type = 'click'",
)
def page_counts(spark, sf_dir):
    return listing.page_counts(table(spark, sf_dir, "events").filter("event_type = 'click'"), 50)


@query(
    "g16_table_profile",
    "SELECT count(*) AS row_count, 6 AS column_count, 'event_id,ts,user_id,event_type,value,props' AS columns FROM events",
)
def profile(spark, sf_dir):
    return listing.profile(table(spark, sf_dir, "events"), ["ts", "event_id"])[0]


@query("g16_last_rows", "SELECT event_id, user_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 5")
def last_rows(spark, sf_dir):
    return listing.profile(table(spark, sf_dir, "events"), ["ts", "event_id"])[1].select("event_id", "user_id", "event_type", "value")


@query(
    "g22_run_summary",
    """WITH t AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'P' THEN 'RUNNING' ELSE 'COMPLETED' END AS s
                  FROM orders ORDER BY o_orderkey DESC LIMIT 20),
    f AS (SELECT o_orderkey FROM t WHERE s = 'FAILED' ORDER BY o_orderkey DESC LIMIT 5)
    SELECT count(*) AS recent_runs, count(*) FILTER (WHERE s = 'RUNNING') AS running, count(*) FILTER (WHERE s = 'FAILED') AS failed,
      (SELECT string_agg('run' || CAST(o_orderkey AS VARCHAR) || '/' || CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey DESC) FROM f) AS failed_details FROM t""",
)
def run_summary(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("started"), F.concat(F.lit("run"), F.col("o_orderkey").cast("string")).alias("name"),
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "P", "RUNNING").otherwise("COMPLETED").alias("state_type"),
    )
    out = listing.run_summary(runs, ["started"])
    return out.withColumn(
        "failed_details",
        F.array_join(F.transform("failed_details", lambda d: F.concat(d["name"], F.lit("/"), d["id"].cast("string"))), ","),
    )


@query(
    "k16_audit_rows",
    """SELECT event_id AS request_id, user_id, 'data' AS domain, event_type AS action, CASE WHEN event_id % 4 = 0 THEN '{}' ELSE props END AS parameters,
      'http' AS protocol, CASE event_type WHEN 'click' THEN 200 WHEN 'view' THEN 403 WHEN 'error' THEN 404 WHEN 'signup' THEN 400 ELSE 500 END AS status_code,
      value AS duration_ms, CASE WHEN event_type <> 'click' THEN 'failed ' || event_type END AS error_detail FROM events""",
)
def audit(spark, sf_dir):
    from tidewater.sinks.outputs import audit_rows

    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    failure = F.when(kind == "view", "PermissionError").when(kind == "error", "DomainNotFoundError").when(kind == "signup", "ValueError").when(
        kind == "purchase", "RuntimeError"
    )
    return audit_rows(e.select(
        F.col("event_id").alias("request_id"), "user_id", F.lit("data").alias("domain"), kind.alias("action"),
        F.when(F.col("event_id") % 4 != 0, F.col("props")).alias("parameters"), F.lit("http").alias("protocol"),
        failure.alias("error_class"), F.col("value").alias("duration_ms"), F.concat(F.lit("failed "), kind).alias("error_detail"),
    ))
