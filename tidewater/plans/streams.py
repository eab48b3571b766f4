"""Registered streams: each drains the given table through Structured Streaming and returns the sink table."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.functions.numeric import rounded
from tidewater.operators.market import newest_rows, rounded_state
from tidewater.plans.inputs import NOW_MS, TICKS, ticks
from tidewater.plans.market import LAST_25, NUMBERED, state_sql
from tidewater.plans.registry import query, r
from tidewater.session import scratch_path, table
from tidewater.sinks import lake as lake_sink
from tidewater.sources import message_log
from tidewater.sources.candidates import fallback_prices, window_or_fallback, with_fallback
from tidewater.streaming import cooldown, metrics, outputs, windows

FILES = 6  # the given events land as so many files, in time order
FILES_PER_BATCH = 2
BATCHES = FILES // FILES_PER_BATCH

EVENTS_SQL = f"""landed AS (
  SELECT *, epoch_us(ts) // 1000 AS ts_ms, min(epoch_us(ts) // 1000) OVER () AS first_ms, max(epoch_us(ts) // 1000) OVER () AS last_ms,
    CAST((ts_ms - first_ms) * {FILES} // (last_ms - first_ms + 1) AS BIGINT) AS file, file // {FILES_PER_BATCH} AS batch_id,
    event_id % 50 = 0 AND ts_ms < first_ms + (last_ms - first_ms) // 5 AS late FROM events)"""


def _in_slices(spark, sf_dir):
    """Events with the time slice (file) they land in and whether they are late: then they land with the last file."""
    e = table(spark, sf_dir, "events").withColumn("ts_ms", F.unix_millis(F.col("ts").cast("timestamp")))
    first, last = e.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    slice_ = F.floor((F.col("ts_ms") - first) * FILES / (last - first + 1)).cast("int")
    late = (F.col("event_id") % 50 == 0) & (F.col("ts_ms") < first + (last - first) // 5)
    return e.withColumns({"file": slice_, "late": late})


def _land(spark, rows, label):
    """One file per value of ``file``, one after the other, so that a file's time tells the order of arrival."""
    cut, path = scratch_path(spark, f"{label}-cut"), scratch_path(spark, label)
    rows.write.partitionBy("file").parquet(cut)
    for i in range(FILES):
        spark.read.parquet(f"{cut}/file={i}").coalesce(1).write.mode("append").parquet(path)
    return path


def _tick_stream(spark, sf_dir, with_late=False):
    """Ticks in capped batches; ``with_late``: some early ones arrive with the last file."""
    rows = _in_slices(spark, sf_dir)
    if with_late:
        rows = rows.withColumn("file", F.when(F.col("late"), FILES - 1).otherwise(F.col("file")))
    path = _land(spark, rows.drop("ts_ms", "late"), "landing")
    raw = windows.landing_stream(spark, path, table(spark, sf_dir, "events").schema, files_per_trigger=FILES_PER_BATCH)
    ts = F.col("ts").cast("timestamp")
    return raw.select(
        F.col("event_type").alias("symbol"), F.col("value").alias("close"),
        F.get_json_object("props", "$.k").cast("double").alias("volume"), F.unix_millis(ts).alias("timestamp"),
        F.col("event_id").alias("id"), ts.alias("ts"),
    )


def _batches(query):
    return F.lit(windows.data_batches(query)).alias("batches")


@query(
    "r02_stream_window_counts",
    f"""WITH {TICKS}
    SELECT "timestamp" - "timestamp" % 10000 AS time, symbol, {r('avg(close)', 6)} AS avg_price, count(*) AS count, {BATCHES} AS batches
    FROM ticks GROUP BY 1, 2""",
)
def stream_counts(spark, sf_dir):
    """Updated windows go to one folder per batch; the newest row per window is the table.

    Files arrive in time order, so a minute of lateness loses nothing and frees closed windows.
    """
    path, checkpoint = scratch_path(spark, "windows"), scratch_path(spark, "checkpoint")
    counts = windows.windowed_counts(_tick_stream(spark, sf_dir))
    with windows.rocksdb(spark):
        ran = windows.drain(counts, checkpoint, windows.batch_writer(path), "update")
    newest = windows.newest_per_key(spark, path, counts.schema, ["time", "symbol"])
    return newest.withColumn("avg_price", rounded(F.col("avg_price"), 6)).select("*", _batches(ran))


def _streamed_metrics(spark, sf_dir):
    path, checkpoint = scratch_path(spark, "state"), scratch_path(spark, "checkpoint")
    windows.drain(_tick_stream(spark, sf_dir), checkpoint, windows.newest_tick_windows(path))
    return windows.window_metrics(windows.latest_state(spark, path))


@query(
    "r03_stream_market_state",
    f"""WITH {TICKS}, {EVENTS_SQL}, {LAST_25}, {NUMBERED}, state AS ({state_sql('strict')} FROM numbered GROUP BY symbol),
    counters AS (SELECT event_type AS symbol, count(*) AS tick_count, count(DISTINCT batch_id) AS batch_count FROM landed GROUP BY 1)
    SELECT * FROM state JOIN counters USING (symbol)""",
)
def stream_state(spark, sf_dir):
    """The newest 25 ticks per symbol are carried from batch to batch; the final metrics equal the batch ones."""
    out = _streamed_metrics(spark, sf_dir)
    counters = out.select("symbol", "tick_count", "batch_count")
    return rounded_state(out.drop("tick_count", "batch_count")).join(counters, "symbol")


@query(
    "g21_tick_counters",
    f"""WITH {EVENTS_SQL} SELECT event_type AS symbol, count(*) AS tick_count, count(DISTINCT batch_id) AS batch_count FROM landed GROUP BY 1""",
)
def counters(spark, sf_dir):
    return _streamed_metrics(spark, sf_dir).select("symbol", "tick_count", "batch_count")


@query(
    "r04_two_sinks",
    f"""WITH {EVENTS_SQL}, sinks AS (SELECT unnest(['lake', 'sql']) AS sink)
    SELECT sink, batch_id, count(*) AS row_count, CAST(sum(event_id) AS BIGINT) AS id_sum FROM landed, sinks GROUP BY 1, 2""",
)
def two_sinks(spark, sf_dir):
    """Every batch goes to both targets."""
    lake, sql, status, checkpoint = (scratch_path(spark, n) for n in ("lake", "sql", "status", "checkpoint"))
    sink = outputs.dual_sink({"lake": (lake, windows.batch_writer(lake)), "sql": (sql, windows.batch_writer(sql))}, status)
    windows.drain(_tick_stream(spark, sf_dir), checkpoint, sink)
    both = [spark.read.parquet(p).select(F.lit(n).alias("sink"), F.col("batch_id").cast("bigint").alias("batch_id"), "id") for n, p in (("lake", lake), ("sql", sql))]
    return both[0].unionByName(both[1]).groupBy("sink", "batch_id").agg(F.count(F.lit(1)).alias("row_count"), F.sum("id").alias("id_sum"))


@query(
    "k13_sink_status",
    f"""WITH {EVENTS_SQL}, sizes AS (SELECT batch_id, count(*) AS n FROM landed GROUP BY 1)
    SELECT batch_id, 'lake' AS sink, TRUE AS persisted, CAST(NULL AS VARCHAR) AS error, n AS stored_rows FROM sizes
    UNION ALL SELECT batch_id, 'broken', FALSE, 'RuntimeError: no connection for ' || CAST(n AS VARCHAR) || ' rows', 0 FROM sizes""",
)
def sink_status(spark, sf_dir):
    """A sink that raises is reported for every batch and does not stop the other one."""
    lake, status, checkpoint = (scratch_path(spark, n) for n in ("lake", "status", "checkpoint"))

    def broken(batch, batch_id):
        raise RuntimeError(f"no connection for {batch.count()} rows")

    sink = outputs.dual_sink({"lake": (lake, windows.batch_writer(lake)), "broken": ("none", broken)}, status)
    windows.drain(_tick_stream(spark, sf_dir), checkpoint, sink)
    stored = spark.read.parquet(lake).groupBy("batch_id").agg(F.count(F.lit(1)).alias("stored_rows")).withColumn("sink", F.lit("lake"))
    return spark.read.parquet(status).join(stored, ["batch_id", "sink"], "left").select(
        F.col("batch_id").cast("bigint").alias("batch_id"), "sink", "persisted", "error", F.coalesce("stored_rows", F.lit(0)).alias("stored_rows")
    )


@query(
    "k14_overwrite_then_append",
    f"WITH {EVENTS_SQL} SELECT event_type AS symbol, batch_id, count(*) AS row_count FROM landed GROUP BY 1, 2",
)
def overwrite_then_append(spark, sf_dir):
    """The first batch replaces what an earlier run left in the table; the later ones append."""
    path, checkpoint = scratch_path(spark, "prices"), scratch_path(spark, "checkpoint")
    left_over = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("symbol"), F.lit(7).alias("batch_id"))
    left_over.write.partitionBy("batch_id").parquet(path)
    windows.drain(_tick_stream(spark, sf_dir), checkpoint, outputs.overwrite_then_append(path))
    return spark.read.parquet(path).groupBy("symbol", F.col("batch_id").cast("bigint").alias("batch_id")).agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "k15_log_retention",
    f"""WITH {EVENTS_SQL} SELECT event_id, event_type AS component, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
      CAST(ts AS DATE) AS day, batch_id FROM landed WHERE CAST(ts AS DATE) >= DATE '2024-02-10' - 30""",
)
def log_retention(spark, sf_dir):
    """Events streamed into the log table, partitioned by day; then days older than thirty are removed."""
    path, checkpoint = scratch_path(spark, "logs"), scratch_path(spark, "checkpoint")
    logs = _tick_stream(spark, sf_dir).select(
        F.col("ts").alias("time"), F.col("symbol").alias("component"), F.when(F.col("symbol") == "error", "ERROR").otherwise("INFO").alias("level"),
        F.col("close").cast("string").alias("message"), F.col("id").cast("string").alias("trace_id"), F.lit("agent").alias("agent_name"), F.lit("{}").alias("metadata"),
    )
    windows.drain(logs, checkpoint, lambda batch, i: lake_sink.append_logs(batch, path, i))
    lake_sink.expire_days(spark, path, datetime.date(2024, 2, 10))
    return spark.read.parquet(path).select(
        F.col("trace_id").cast("bigint").alias("event_id"), "component", "level", "day", F.col("batch_id").cast("bigint").alias("batch_id")
    )


def _landing(spark, sf_dir):
    """Events as JSON lines in a landing folder of several files; a mark before errors makes them invalid JSON."""
    text = F.to_json(F.struct("event_id", "event_type", "value"))
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("!"), text)).otherwise(text)
    cut, path = scratch_path(spark, "lines-cut"), scratch_path(spark, "lines")
    _in_slices(spark, sf_dir).select(line.alias("value"), "file").write.partitionBy("file").text(cut)
    for i in range(FILES):
        spark.read.text(f"{cut}/file={i}").coalesce(1).write.mode("append").text(path)
    return path


@query(
    "r05_landing_with_dead_letters",
    f"""WITH {EVENTS_SQL} SELECT batch_id, CASE WHEN event_type = 'error' THEN 'dead' ELSE 'good' END AS route, count(*) AS row_count,
       CAST(sum(event_id) AS BIGINT) AS id_sum FROM landed GROUP BY 1, 2""",
)
def landing(spark, sf_dir):
    """JSON lines in capped micro-batches; lines that do not parse reach the dead-letter table with their whole text."""
    path, checkpoint = scratch_path(spark, "routed"), scratch_path(spark, "checkpoint")
    lines = windows.landing_stream(spark, _landing(spark, sf_dir), "value string", "text", files_per_trigger=FILES_PER_BATCH)
    rows = windows.parse_landing(lines, "event_id bigint, event_type string, value double")
    sink = outputs.with_dead_letters(path, F.col("corrupt").isNull(), F.lit("not a JSON object"))
    windows.drain(rows, checkpoint, sink)
    kept = F.get_json_object(F.substring("corrupt", 2, 1_000_000), "$.event_id").cast("bigint")
    return spark.read.parquet(path).groupBy(F.col("batch_id").cast("bigint").alias("batch_id"), "route").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(F.coalesce("event_id", kept)).alias("id_sum")
    )


@query("s13_micro_batches", f"WITH {EVENTS_SQL} SELECT event_id, event_type, value, batch_id FROM landed WHERE event_type <> 'error'")
def micro_batches(spark, sf_dir):
    """Valid landing rows as they arrive, in capped batches."""
    path, checkpoint = scratch_path(spark, "rows"), scratch_path(spark, "checkpoint")
    lines = windows.landing_stream(spark, _landing(spark, sf_dir), "value string", "text", files_per_trigger=FILES_PER_BATCH)
    rows = windows.parse_landing(lines, "event_id bigint, event_type string, value double").filter("corrupt IS NULL").drop("corrupt")
    windows.drain(rows, checkpoint, windows.batch_writer(path))
    return spark.read.parquet(path).select("event_id", "event_type", "value", F.col("batch_id").cast("bigint").alias("batch_id"))


@query("r06_bounded_drain", f"SELECT event_id AS id, event_type AS symbol, value AS close, {BATCHES} AS batches FROM events")
def bounded_drain(spark, sf_dir):
    """Everything available at the start is processed once, in capped batches, then the query ends by itself."""
    path, checkpoint = scratch_path(spark, "rows"), scratch_path(spark, "checkpoint")
    ran = windows.drain(_tick_stream(spark, sf_dir), checkpoint, windows.batch_writer(path))
    return spark.read.parquet(path).select("id", "symbol", "close", _batches(ran))


@query(
    "r14_late_rows",
    f"""WITH {EVENTS_SQL}, w AS (SELECT ts_ms - ts_ms % 10000 AS time, event_type AS symbol, {r('avg(value)', 6)} AS avg_price, count(*) AS count
      FROM landed WHERE NOT late GROUP BY 1, 2)
    SELECT *, {BATCHES} AS batches, (SELECT count(*) FROM landed WHERE late) > 0 AS had_late FROM w WHERE time + 10000 <= (SELECT max(ts_ms) FROM landed) - 60000""",
)
def late_rows(spark, sf_dir):
    """One minute of lateness: windows are emitted once they are closed; early rows that come with the last file are dropped."""
    path, checkpoint = scratch_path(spark, "closed"), scratch_path(spark, "checkpoint")
    counts = windows.windowed_counts(_tick_stream(spark, sf_dir, with_late=True))
    with windows.rocksdb(spark):
        ran = windows.drain(counts, checkpoint, windows.batch_writer(path))
    had_late = not _in_slices(spark, sf_dir).filter("late").isEmpty()
    closed = spark.read.schema(counts.schema).parquet(path).select(*counts.columns)
    return closed.withColumn("avg_price", rounded(F.col("avg_price"), 6)).select("*", _batches(ran), F.lit(had_late).alias("had_late"))


@query(
    "r14_late_rows_kept",
    f"""WITH {EVENTS_SQL}, arrived AS (SELECT *, CASE WHEN late THEN {BATCHES - 1} ELSE batch_id END AS b FROM landed),
    marks AS (SELECT b, max(ts_ms) AS newest FROM arrived GROUP BY b),
    limits AS (SELECT b, max(newest) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 60000 AS last FROM marks)
    SELECT b AS batch_id, CASE WHEN ts_ms - ts_ms % 10000 + 10000 <= last THEN 'late' ELSE 'counted' END AS route, count(*) AS row_count
    FROM arrived JOIN limits USING (b) GROUP BY 1, 2""",
)
def late_rows_kept(spark, sf_dir):
    """Every row is in a window's count or among the dead rows of its batch."""
    path, checkpoint = scratch_path(spark, "routes"), scratch_path(spark, "checkpoint")
    windows.drain(_tick_stream(spark, sf_dir, with_late=True), checkpoint, windows.counts_with_late_rows(path))
    counted = spark.read.parquet(f"{path}/counts").groupBy("batch_id").agg(F.sum("count").alias("row_count"))
    dead = spark.read.parquet(f"{path}/dead").groupBy("batch_id", F.col("reason").alias("route")).agg(F.count(F.lit(1)).alias("row_count"))
    both = counted.withColumn("route", F.lit("counted")).unionByName(dead)
    return both.select(F.col("batch_id").cast("bigint").alias("batch_id"), "route", "row_count")


def _stored_window(spark, sf_dir, symbol):
    """Newest ticks per symbol as a written table, since the fallback rules read it several times."""
    path = scratch_path(spark, "window")
    newest = newest_rows(ticks(spark, sf_dir, symbol), "symbol", ["timestamp", "id"])
    newest.select("symbol", "close", "volume", "timestamp", "id").write.parquet(path)
    return spark.read.parquet(path)


@query(
    "r08_fallback_window",
    f"""WITH {TICKS}, {LAST_25},
    wanted AS (SELECT DISTINCT event_type AS symbol FROM events UNION SELECT DISTINCT c_mktsegment FROM customer)
    SELECT symbol, count(*) AS row_count, max("timestamp") AS newest_ms, 'live' AS mode FROM last25 GROUP BY 1
    UNION ALL SELECT symbol, 25, {NOW_MS} - 60000, 'fallback' FROM wanted WHERE symbol NOT IN (SELECT symbol FROM last25)""",
)
def fallback_window(spark, sf_dir):
    """Stored windows of the symbols that have one; the fixed window for market segments, which have none."""
    live = _stored_window(spark, sf_dir, "event_type")
    wanted = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol")).union(
        table(spark, sf_dir, "customer").select("c_mktsegment")
    ).distinct()
    rows = with_fallback(live, wanted, fallback_prices(wanted, F.lit(NOW_MS)), F.lit("stream failed"))
    return rows.groupBy("symbol", "mode").agg(F.count(F.lit(1)).alias("row_count"), F.max("timestamp").alias("newest_ms"))


@query(
    "s18_bounded_window",
    f"""WITH t AS (SELECT 'U' || CAST(user_id AS VARCHAR) AS symbol, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events),
    w AS (SELECT symbol, count(*) AS n FROM t WHERE rn <= 25 GROUP BY 1),
    wanted AS (SELECT 'U' || CAST(c_custkey AS VARCHAR) AS symbol FROM customer UNION SELECT symbol FROM t)
    SELECT symbol, n AS row_count, 'live' AS mode, NULL AS source_error FROM w WHERE n >= 20
    UNION ALL SELECT symbol, 25, 'fallback', 'fewer than 20 live rows' FROM wanted WHERE symbol NOT IN (SELECT symbol FROM w WHERE n >= 20)""",
)
def bounded_window(spark, sf_dir):
    """Users with at least 20 of 25 ticks keep their window; all other users and customers get the fixed one."""
    live = _stored_window(spark, sf_dir, "user_id")
    customers = table(spark, sf_dir, "customer").select(F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("symbol"))
    wanted = customers.union(live.select("symbol")).distinct()
    rows = window_or_fallback(live, wanted, fallback_prices(wanted, F.lit(NOW_MS)))
    return rows.groupBy("symbol", "mode", "source_error").agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "q02_query_stream_table",
    f"""WITH {TICKS}, w AS (SELECT "timestamp" - "timestamp" % 10000 AS time, symbol, count(*) AS c FROM ticks GROUP BY 1, 2)
    SELECT symbol, count(*) AS windows, CAST(sum(c) AS BIGINT) AS ticks FROM w GROUP BY 1""",
)
def query_stream(spark, sf_dir):
    """SQL over the table a stream maintains."""
    from tidewater.api import query as run_query

    return run_query(
        spark, "SELECT symbol, count(*) AS windows, sum(count) AS ticks FROM {w} GROUP BY symbol", w=stream_counts(spark, sf_dir)
    )


@query(
    "w09_streaming_cooldown",
    """WITH RECURSIVE e AS (SELECT event_type AS k, epoch_us(ts) // 1000 AS ts_ms, event_id AS id FROM events),
    fired(k, ts_ms) AS (
      SELECT k, min(ts_ms) FROM e GROUP BY k
      UNION ALL
      SELECT f.k, (SELECT min(ts_ms) FROM e WHERE e.k = f.k AND e.ts_ms >= f.ts_ms + 3600000) FROM fired f
      WHERE EXISTS (SELECT 1 FROM e WHERE e.k = f.k AND e.ts_ms >= f.ts_ms + 3600000))
    SELECT e.k, e.ts_ms, e.id, f.ts_ms IS NOT NULL AS fired, 6 AS batches FROM e LEFT JOIN fired f ON f.k = e.k AND f.ts_ms = e.ts_ms""",
)
def streamed_cooldown(spark, sf_dir):
    """Every event is a candidate, in six batches in time order; the last fired time of a key is carried over."""
    landed = _land(spark, _in_slices(spark, sf_dir).drop("ts_ms", "late"), "landing")
    raw = windows.landing_stream(spark, landed, table(spark, sf_dir, "events").schema, files_per_trigger=1)
    events = raw.select(F.col("event_type").alias("k"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"))
    path, checkpoint = scratch_path(spark, "fired"), scratch_path(spark, "checkpoint")
    with windows.rocksdb(spark):
        ran = windows.drain(cooldown.stream_fired(events, "k", "ts", "id", 3_600_000), checkpoint, windows.batch_writer(path))
    out = spark.read.parquet(path)
    return out.select("k", F.unix_millis("ts").alias("ts_ms"), "id", "fired", _batches(ran))


MESSAGES_SQL = """numbered AS (
  SELECT event_type AS topic, CAST(user_id % 3 AS INT) AS "partition", event_id, ts,
    row_number() OVER (PARTITION BY event_type, user_id % 3 ORDER BY ts, event_id) - 1 AS "offset" FROM events)"""


@query(
    "s11_offset_batches",
    f"""WITH {MESSAGES_SQL}, n AS (SELECT greatest(100, count(*) // 5) AS cap, count(*) AS messages FROM events)
    SELECT topic, "partition", count(*) AS messages, min("offset") AS first_offset, max("offset") AS last_offset,
      CAST(sum(event_id) AS BIGINT) AS id_sum, CAST(ceil(any_value(n.messages) / any_value(cap)) AS INT) AS batches, any_value(cap) AS largest
    FROM numbered, n GROUP BY ALL""",
)
def offset_batches(spark, sf_dir):
    """Events as stored messages of three partitions a topic, read by offsets in batches of a fifth of all (100 at least)."""
    e = table(spark, sf_dir, "events")
    place = [F.col("event_type"), F.col("user_id") % 3]
    messages = e.select(
        F.col("event_id").cast("string").cast("binary").alias("key"), F.col("props").cast("binary").alias("value"),
        F.col("event_type").alias("topic"), (F.col("user_id") % 3).cast("int").alias("partition"),
        (F.row_number().over(Window.partitionBy(*place).orderBy("ts", "event_id")) - 1).cast("bigint").alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"), F.lit(0).alias("timestampType"),
    )
    log, path, checkpoint = scratch_path(spark, "log"), scratch_path(spark, "batches"), scratch_path(spark, "checkpoint")
    message_log.append_messages(messages, log)
    cap = max(100, e.count() // 5)
    stream = message_log.message_stream(spark, log, batch_size=cap)
    message_log.drain_messages(stream, checkpoint, windows.batch_writer(path))
    got = spark.read.parquet(path)
    sizes = got.groupBy("batch_id").agg(F.count("*").alias("n")).agg(F.count("*").cast("int").alias("batches"), F.max("n").alias("largest"))
    by_place = got.groupBy("topic", "partition").agg(
        F.count("*").alias("messages"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"),
        F.sum(F.col("key").cast("string").cast("bigint")).alias("id_sum"),
    )
    batches, largest = sizes.first()
    return by_place.withColumns({"batches": F.lit(batches), "largest": F.lit(largest)})


@query(
    "r15_observed_counters",
    f"""WITH {EVENTS_SQL} SELECT batch_id, count(*) AS row_count, CAST(sum(event_id) AS BIGINT) AS id_sum, max(ts_ms) AS newest_ms FROM landed GROUP BY 1""",
)
def observed_counters(spark, sf_dir):
    """Counters of every batch, observed while it is written to the lake; the rows are not read again."""
    lake, log, checkpoint = (scratch_path(spark, n) for n in ("lake", "counters", "checkpoint"))
    rows = metrics.observed(
        _tick_stream(spark, sf_dir),
        row_count=F.count(F.lit(1)), id_sum=F.sum("id"), newest_ms=F.max("timestamp"),
    )
    listener = metrics.CounterLog(spark, log)
    spark.streams.addListener(listener)
    try:
        ran = windows.drain(rows, checkpoint, windows.batch_writer(lake))
        return metrics.counted(spark, log, "row_count bigint, id_sum bigint, newest_ms bigint", ran)
    finally:
        spark.streams.removeListener(listener)
