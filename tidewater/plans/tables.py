"""Registered sources and sinks: scans, round trips, dead letters, payload rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater import api
from tidewater.functions.numeric import rounded
from tidewater.operators.market import ohlc_bars
from tidewater.operators.normalize import normalize_ticks
from tidewater.plans.inputs import NOW_MS, TICKS, ticks
from tidewater.plans.registry import query, r
from tidewater.session import scratch_path, table
from tidewater.sinks import lake, outputs
from tidewater.sources.files import FileSource, news_files, ohlc_files, text_lines
from tidewater.sources.jdbc import table_endpoint


@query(
    "s01_parquet_scan",
    "SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01' AND l_quantity < 10",
)
def parquet_scan(spark, sf_dir):
    """Four columns and two pushed-down filters."""
    li = FileSource((f"{sf_dir}/lineitem.parquet",), "parquet").read(spark)
    kept = li.filter((F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp_ntz")) & (F.col("l_quantity") < 10))
    return kept.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")


@query(
    "s02_csv_scan",
    f"""WITH {TICKS} SELECT symbol, "timestamp" - "timestamp" % 86400000 AS "timestamp",
        arg_min(close, id) AS open, max(close) AS high, min(close) AS low, arg_max(close, id) AS close, sum(volume) AS volume
    FROM ticks GROUP BY 1, 2""",
)
def csv_scan(spark, sf_dir):
    """Daily bars written as gzipped CSV per symbol folder and read back; the symbol comes from the path."""
    bars = ohlc_bars(ticks(spark, sf_dir), width="1 day").select(
        F.col("epoch_ms").alias("timestamp"), "open", "high", "low", "close", "volume", "symbol"
    )
    path = scratch_path(spark, "ohlc")
    bars.write.partitionBy("symbol").option("compression", "gzip").csv(path, header=True)
    rows = ohlc_files(f"{path}/*/*.gz").read(spark)
    return rows.withColumn("symbol", F.regexp_extract("path", r"/symbol=([^/]+)/[^/]+\.gz$", 1)).drop("path")


@query(
    "s03_json_scan",
    "SELECT lang AS category, doc_id AS datetime, text AS headline, doc_id AS id, CAST(NULL AS VARCHAR) AS image, source, text AS summary FROM documents",
)
def json_scan(spark, sf_dir):
    """Documents as news records, written as JSON lines and read with the explicit schema."""
    news = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("category"), F.col("doc_id").alias("datetime"), F.col("text").alias("headline"),
        F.col("doc_id").alias("id"), "source", F.col("text").alias("summary"),
    )
    path = scratch_path(spark, "news")
    news.write.json(path)
    return news_files(path).read(spark).select("category", "datetime", "headline", "id", "image", "source", "summary")


@query("s04_text_scan", "SELECT CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines_, CAST(sum(length(replace(text, chr(10), ''))) AS BIGINT) AS chars FROM documents")
def text_scan(spark, sf_dir):
    """Whole texts written as text files and read as lines."""
    path = scratch_path(spark, "text")
    table(spark, sf_dir, "documents").select("text").write.option("lineSep", "\n").text(path)
    lines = text_lines(path).read(spark)
    return lines.agg(F.count(F.lit(1)).alias("lines_"), F.sum(F.length("value")).cast("bigint").alias("chars"))


@query("s08_lake_table_scan", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'P'")
def lake_scan(spark, sf_dir):
    """Only the folder of one status is listed and read."""
    path = scratch_path(spark, "orders")
    lake.write_table(table(spark, sf_dir, "orders"), path, "overwrite", ("o_orderstatus",))
    return lake.read_table(spark, path).filter("o_orderstatus = 'P'").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


@query(
    "s10_table_endpoint",
    "SELECT 'customer' AS table_name, 20 AS row_limit, c_custkey, c_name, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY c_custkey LIMIT 20",
)
def endpoint(spark, sf_dir):
    allowed = {"customer": table(spark, sf_dir, "customer"), "supplier": table(spark, sf_dir, "supplier")}
    return table_endpoint(allowed, "customer", ["c_custkey"], 20).select("table_name", "row_limit", "c_custkey", "c_name", "total")


@query("k01_append_and_overwrite", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'O'")
def append_overwrite(spark, sf_dir):
    """Open orders are written, replaced by pending ones, then finished ones are appended."""
    path = scratch_path(spark, "orders")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    for status, mode in (("O", "overwrite"), ("P", "overwrite"), ("F", "append")):
        lake.write_table(orders.filter(F.col("o_orderstatus") == status), path, mode)
    return lake.read_table(spark, path)


@query("k02_partitioned_write", "SELECT l_returnflag, count(*) AS row_count, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY 1")
def partitioned(spark, sf_dir):
    path = scratch_path(spark, "lineitem")
    lake.write_table(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity"), path, "overwrite", ("l_returnflag",))
    return lake.read_table(spark, path).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("row_count"), F.sum("l_quantity").cast("bigint").alias("quantity"))


@query(
    "k03_schema_evolution",
    """SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS o_orderpriority FROM orders""",
)
def evolution(spark, sf_dir):
    """Later rows bring a new column; earlier ones read null there."""
    path = scratch_path(spark, "orders")
    orders = table(spark, sf_dir, "orders")
    lake.write_table(orders.filter("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey"), path, "overwrite")
    lake.write_table(orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderpriority"), path, "append")
    return lake.read_table(spark, path)


@query("k04_distributed_write", "SELECT count(*) AS row_count, CAST(sum(l_linenumber) AS BIGINT) AS line_sum FROM lineitem")
def distributed_write(spark, sf_dir):
    """Every task writes its own files; nothing is coalesced or collected."""
    path = scratch_path(spark, "lineitem")
    lake.write_table(table(spark, sf_dir, "lineitem"), path, "overwrite")
    return lake.read_table(spark, path).agg(F.count(F.lit(1)).alias("row_count"), F.sum("l_linenumber").alias("line_sum"))


@query("k05_zone_free_times", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS wall_time, 'timestamp_ntz' AS column_type FROM events")
def zone_free(spark, sf_dir):
    path = scratch_path(spark, "events")
    zoned = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    lake.write_table(zoned, path, "overwrite")
    return lake.read_table(spark, path).select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("wall_time"), F.typeof("ts").alias("column_type")
    )


@query(
    "k06_dead_letters",
    """SELECT CASE WHEN event_type = 'error' THEN 'dead' ELSE 'good' END AS route, count(*) AS row_count,
       CAST(sum(event_id) AS BIGINT) AS id_sum, count(*) FILTER (WHERE event_type = 'error') AS with_error FROM events GROUP BY 1""",
)
def dead_letters(spark, sf_dir):
    """Error events carry a price that is no number; they reach the dead-letter table with the reason."""
    e = table(spark, sf_dir, "events")
    price = F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string"))
    payload = F.to_json(F.struct(F.col("event_type").alias("symbol"), price.alias("price"), F.lit(1).alias("volume"), F.lit(NOW_MS).alias("timestamp")))
    rows = normalize_ticks(e.select("event_id", payload.alias("payload")), keep=("event_id", "payload"), now_ms=F.lit(NOW_MS))
    path = scratch_path(spark, "routed")
    lake.write_with_dead_letters(rows, path, F.col("valid"), F.lit("price, volume or time is no number"), F.lit("2024-02-01").cast("date"))
    both = lake.read_table(spark, path)
    return both.groupBy("route").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("event_id").alias("id_sum"), F.count("dlq_error").alias("with_error")
    )


@query(
    "k09_conflict_skip_append",
    """SELECT c_custkey AS id, 'stored' AS origin FROM customer WHERE c_acctbal > 5000
       UNION ALL SELECT DISTINCT o_custkey, 'new' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)""",
)
def conflict_append(spark, sf_dir):
    """Rows whose key is stored are skipped; the rest is appended."""
    path = scratch_path(spark, "target")
    stored = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("id"), F.lit("stored").alias("origin"))
    lake.write_table(stored, path, "overwrite")
    incoming = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.lit("new").alias("origin"))
    fresh = lake.skip_conflicts(incoming, lake.read_table(spark, path), ["id"], ["origin"])
    staged = scratch_path(spark, "staged")
    lake.write_table(fresh, staged, "overwrite")  # the target must not be read while it is appended to
    lake.write_table(lake.read_table(spark, staged), path, "append")
    return lake.read_table(spark, path)


@query(
    "k10_sql_rows",
    """SELECT event_id, '{"event_type":"' || event_type || '","user_id":' || CAST(user_id AS VARCHAR) || '}' AS who,
         '[' || CAST(event_id AS VARCHAR) || ',' || CAST(user_id AS VARCHAR) || ']' AS ids, value FROM events""",
)
def sql_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return outputs.flatten_for_sql(e.select("event_id", F.struct("event_type", "user_id").alias("who"), F.array("event_id", "user_id").alias("ids"), "value"))


@query(
    "k11_http_payloads",
    """SELECT event_id, user_id, TRUE AS whole_batch, '2024-02-01T00:00:00Z' AS sent FROM events""",
)
def payloads(spark, sf_dir):
    """Request bodies of at most a hundred events, read back: every event is in one, beside its count and time."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    sent = outputs.http_payloads(e, order=["event_id"], sent_at=F.timestamp_millis(F.lit(NOW_MS)))
    body = F.from_json("payload", "records array<struct<event_id:bigint,user_id:bigint>>, _metadata struct<count:bigint,timestamp:string>")
    read = sent.select("count", body.alias("b"))
    whole = (F.size("b.records") == F.col("count")) & (F.col("b._metadata.count") == F.col("count")) & (F.col("count") <= 100)
    return read.select(F.explode("b.records").alias("r"), whole.alias("whole_batch"), F.col("b._metadata.timestamp").alias("sent")).select(
        "r.event_id", "r.user_id", "whole_batch", "sent"
    )


@query("k12_vector_rows", "SELECT vec_id, label, len(embedding) AS dimension, TRUE AS in_batch FROM embeddings WHERE len(embedding) = 64")
def vectors(spark, sf_dir):
    """Vectors written in insert batches of at most a thousand rows."""
    path = scratch_path(spark, "vectors")
    lake.write_table(outputs.vector_batches(table(spark, sf_dir, "embeddings"), "embedding", 64), path, "overwrite")
    stored = lake.read_table(spark, path)
    sizes = stored.groupBy("part", "batch").agg((F.count(F.lit(1)) <= outputs.VECTOR_BATCH).alias("in_batch"))
    return stored.join(sizes, ["part", "batch"]).select("vec_id", "label", F.size("embedding").alias("dimension"), "in_batch")


@query(
    "k17_trial_files",
    f"""SELECT o_orderstatus AS system_name, count(*) AS trials, {r('avg(o_totalprice)', 4)} AS mean_price FROM orders GROUP BY 1""",
)
def trial_files(spark, sf_dir):
    """Trials as CSV with a header, the summary as JSON; both are read back."""
    trials_path, summary_path = scratch_path(spark, "trials"), scratch_path(spark, "summary")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trial"), F.col("o_orderstatus").alias("system_name"), "o_totalprice")
    o.write.csv(trials_path, header=True)
    back = FileSource((trials_path,), "csv", "trial bigint, system_name string, o_totalprice double").read(spark)
    summary = back.groupBy("system_name").agg(F.count(F.lit(1)).alias("trials"), rounded(F.avg("o_totalprice"), 4).alias("mean_price"))
    summary.write.json(summary_path)
    return FileSource((summary_path,), "json", "system_name string, trials bigint, mean_price double").read(spark)


@query(
    "q01_run_sql",
    f"""WITH lines AS (SELECT o_orderkey, o_custkey, c_mktsegment, {r('o_totalprice', 2)} AS price FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT *, (SELECT count(*) FROM lines) AS row_count FROM lines""",
)
def run_sql(spark, sf_dir):
    """User SQL over the given tables: the whole written result beside the row count that was reported for it."""
    answer = api.run_sql(
        spark,
        """SELECT o_orderkey, o_custkey, c_mktsegment, round(round(o_totalprice, 10), 2) AS price
           FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
        orders=table(spark, sf_dir, "orders"), customer=table(spark, sf_dir, "customer"),
    )
    if not answer["success"]:
        raise RuntimeError(answer["error_message"])
    return api.read_result(spark, answer["path"]).withColumn("row_count", F.lit(answer["row_count"]).cast("bigint"))


SCHEMA_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string"}


@query(
    "q03_table_schema",
    f"""WITH counted AS (SELECT count(*) AS row_count FROM orders)
    SELECT column_name AS name, CASE column_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in SCHEMA_TYPES.items())}
      ELSE 'timestamp_ntz' END AS type, row_count FROM (DESCRIBE orders), counted""",
)
def table_schema(spark, sf_dir):
    """Columns and types of a table by its path, with the number of rows behind them."""
    path = f"{sf_dir}/orders.parquet"
    columns = spark.createDataFrame(api.get_schema(spark, path), "name string, type string")
    return columns.withColumn("row_count", F.lit(spark.read.parquet(path).count()).cast("bigint"))
