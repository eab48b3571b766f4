"""Streaming aggregation and stateful windows with bounded replays."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidewater.operators.market import WINDOW_ROWS, keyed_window_counts, market_state, newest_rows

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def landing_stream(
    spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int | None = None
) -> DataFrame:
    """Stream over a landing folder; the file cap plays the part of a message-count limit per batch."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def parse_landing(lines: DataFrame, schema: str) -> DataFrame:
    """JSON lines to columns; ``corrupt`` holds the text of lines that are not valid JSON objects."""
    parsed = F.from_json("value", f"{schema}, corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})
    return lines.select(parsed.alias("r")).select("r.*")


def drain(
    df: DataFrame, checkpoint: str, each_batch: Callable[[DataFrame, int], None], mode: str = "append"
) -> StreamingQuery:
    """Process everything that is available, in batches of the source's cap, then stop."""
    query = _writer(df, checkpoint, each_batch, mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_every(
    df: DataFrame,
    checkpoint: str,
    each_batch: Callable[[DataFrame, int], None],
    every: str = "5 seconds",
    mode: str = "append",
) -> StreamingQuery:
    """Start a query that takes a batch each ``every``, of at most the source's cap: time or count, whatever comes first.

    It runs until the caller stops it.
    """
    return _writer(df, checkpoint, each_batch, mode).trigger(processingTime=every).start()


def _writer(df: DataFrame, checkpoint: str, each_batch, mode: str):
    return df.writeStream.outputMode(mode).foreachBatch(each_batch).option("checkpointLocation", checkpoint)


def data_batches(query: StreamingQuery) -> int:
    """How many of a query's recent batches had input rows."""
    return sum(1 for p in query.recentProgress if p["numInputRows"] > 0)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Stateful queries that start inside keep their state in RocksDB, on disk, and not on the heap."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Write each batch to its own folder; replaying a batch replaces that folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def newest_per_key(spark: SparkSession, path: str, schema, key: list[str]) -> DataFrame:
    """Current table behind a folder of update batches: the newest row of each key."""
    columns = [f.name for f in schema.fields if f.name not in key]
    with_batch = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    updates = spark.read.schema(with_batch).parquet(path)
    return (
        updates.groupBy(*key)
        .agg(F.max_by(F.struct(*columns), "batch_id").alias("row"))
        .select(*key, "row.*")
    )


def windowed_counts(ticks: DataFrame, ts: str = "ts", width: str = "10 seconds", lateness: str = "1 minute") -> DataFrame:
    """Count and mean price per symbol and event-time window.

    Rows later than ``lateness`` behind the newest event are dropped; state of
    closed windows is freed.
    """
    return keyed_window_counts(ticks.withWatermark(ts, lateness), ts, width)


LATE, UNUSABLE = "late", "unusable"


def counts_with_late_rows(
    path: str, ts: str = "ts", width: str = "10 seconds", lateness: str = "1 minute"
) -> Callable[[DataFrame, int], None]:
    """foreachBatch body that counts as ``windowed_counts`` does, and keeps what that drops.

    A row is late if its window ended ``lateness`` before the newest row of earlier batches. Late and unusable rows
    go to ``path/dead`` with a reason, all others into counts and sums per symbol and window in ``path/counts``; each
    row ends in one of them. Both are folders per batch id, as are the newest times in ``path/marks``, so a replayed
    batch finds the same limit and replaces its own folders.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        limit = F.lit(None).cast("timestamp")
        if batch_id:
            marks = spark.read.schema("newest timestamp, batch_id bigint").parquet(f"{path}/marks")
            before = marks.filter(F.col("batch_id") < batch_id).agg(F.max("newest")).first()[0]
            limit = F.lit(before).cast("timestamp") - F.expr(f"INTERVAL '{lateness}'")
        at = F.coalesce(F.col(ts), F.timestamp_seconds(F.lit(0)))  # window() leaves rows without a time out
        late = F.coalesce(F.window(at, width)["end"] <= limit, F.lit(False))
        usable = F.coalesce((F.col("symbol") != "") & F.col("close").isNotNull() & F.col(ts).isNotNull(), F.lit(False))
        batch = batch.withColumn("reason", F.when(~usable, UNUSABLE).when(late, LATE)).persist()
        try:
            counted = batch.filter(F.col("reason").isNull()).groupBy(F.window(ts, width), "symbol").agg(
                F.count(F.lit(1)).alias("count"), F.sum("close").alias("total")
            )
            out = counted.select(F.unix_millis("window.start").alias("time"), "symbol", "count", "total")
            out.write.mode("overwrite").parquet(f"{path}/counts/batch_id={batch_id}")
            batch.filter(F.col("reason").isNotNull()).write.mode("overwrite").parquet(f"{path}/dead/batch_id={batch_id}")
            newest = batch.agg(F.max(ts).alias("newest"))
            newest.write.mode("overwrite").parquet(f"{path}/marks/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return write


def counted_windows(spark: SparkSession, path: str) -> DataFrame:
    """time, symbol, avg_price and count of all batches of ``counts_with_late_rows``."""
    parts = spark.read.parquet(f"{path}/counts").groupBy("time", "symbol")
    sums = parts.agg(F.sum("count").alias("count"), F.sum("total").alias("total"))
    return sums.select("time", "symbol", (F.col("total") / F.col("count")).alias("avg_price"), "count")


# --- last-25 window per symbol ------------------------------------------------------------------

WINDOW_COLUMNS = ("symbol", "timestamp", "id", "close", "volume")


STATE_BUCKETS = 64


def state_versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """Batch ids for which a bucket of a state table has a folder, rising; names only, bounded by the buckets."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    files = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(folder: str, prefix: str) -> list[int]:
        if not files.exists(fs_path(folder)):
            return []
        names = [s.getPath().getName() for s in files.listStatus(fs_path(folder)) if s.isDirectory()]
        return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))

    return {b: numbers(f"{path}/bucket={b}", "batch_id=") for b in numbers(path, "bucket=")}


def _folders(path: str, versions: dict[int, int]) -> list[str]:
    return [f"{path}/bucket={b}/batch_id={v}" for b, v in sorted(versions.items())]


def newest_tick_windows(path: str, n: int = WINDOW_ROWS, buckets: int = STATE_BUCKETS) -> Callable[[DataFrame, int], None]:
    """foreachBatch body that keeps the newest ``n`` ticks and the lifetime counters of every symbol.

    The state lies in buckets of symbols. A batch reads and writes only buckets that hold one of its symbols: its newest
    ticks per symbol (a rank limit below the shuffle, so a busy symbol sends n rows per task) are merged with those of
    the bucket's newest version before it. A version is a folder of the batch id; a replayed batch starts from the
    same versions and replaces its own. Versions older than the one that a batch started from are removed.
    """
    bucket = F.pmod(F.xxhash64("symbol"), F.lit(buckets)).cast("int")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.select(*WINDOW_COLUMNS).persist()
        try:
            touched = [r.bucket for r in batch.select(bucket.alias("bucket")).distinct().collect()]
            versions = state_versions(spark, path)
            before = {b: [v for v in versions.get(b, []) if v < batch_id] for b in touched}
            known = _folders(path, {b: v[-1] for b, v in before.items() if v})
            fresh = newest_rows(batch, "symbol", ["timestamp", "id"], n).drop("rn")
            seen = batch.groupBy("symbol").agg(F.count(F.lit(1)).alias("tick_count")).withColumn("batch_count", F.lit(1))
            if known:
                state = spark.read.parquet(*known)
                fresh = fresh.unionByName(state.select(*WINDOW_COLUMNS))
                seen = seen.unionByName(state.filter("rn = 1").select("symbol", "tick_count", "batch_count"))
            counters = seen.groupBy("symbol").agg(
                F.sum("tick_count").alias("tick_count"), F.sum("batch_count").alias("batch_count")
            )
            windows = newest_rows(fresh, "symbol", ["timestamp", "id"], n).join(counters, "symbol")
            rows = windows.withColumns({"bucket": bucket, "batch_id": F.lit(batch_id)}).repartition("bucket")
            writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("bucket", "batch_id").parquet(path)
        finally:
            batch.unpersist()
        for folder in [f"{path}/bucket={b}/batch_id={v}" for b, old in before.items() for v in old[:-1]]:
            place = spark._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

    return write


def latest_state(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of every bucket of a state table."""
    return spark.read.parquet(*_folders(path, {b: v[-1] for b, v in state_versions(spark, path).items() if v}))


def window_metrics(windows: DataFrame) -> DataFrame:
    """Market state of stored windows with the lifetime counters."""
    counters = windows.groupBy("symbol").agg(
        F.max("tick_count").alias("tick_count"), F.max("batch_count").alias("batch_count")
    )
    return market_state(windows).join(counters, "symbol")
