"""foreachBatch sinks: several targets with captured errors, first-batch overwrite, dead letters, progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewater.sinks.lake import write_with_dead_letters

Sink = Callable[[DataFrame, int], None]

STATUS_SCHEMA = "batch_id bigint, sink string, persisted boolean, target string, error string"


def write_to_all(batch: DataFrame, batch_id: int, sinks: dict[str, tuple[str, Sink]]) -> list[tuple]:
    """Run every sink; one that fails does not keep the others from running.

    Returns status rows (batch_id, sink, persisted, target, error).
    """
    rows = []
    for name, (target, sink) in sinks.items():
        try:
            sink(batch, batch_id)
            rows.append((batch_id, name, True, target, None))
        except Exception as exc:  # reported per sink
            rows.append((batch_id, name, False, target, f"{type(exc).__name__}: {str(exc).splitlines()[0]}"))
    return rows


def dual_sink(sinks: dict[str, tuple[str, Sink]], status_path: str | None = None) -> Sink:
    """foreachBatch body for several sinks; the batch is cached while they read it.

    Status rows go to ``status_path/batch_id=<id>``, replaced when a batch is replayed.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            rows = write_to_all(batch, batch_id, sinks)
        finally:
            batch.unpersist()
        if status_path:
            status = batch.sparkSession.createDataFrame(rows, STATUS_SCHEMA)
            status.drop("batch_id").write.mode("overwrite").parquet(f"{status_path}/batch_id={batch_id}")

    return write


def overwrite_then_append(path: str) -> Sink:
    """First batch replaces the table, later ones append.

    Later batches go to a folder of their own, so a replayed batch is not doubled.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch_id == 0:
            batch.withColumn("batch_id", F.lit(0)).write.mode("overwrite").partitionBy("batch_id").parquet(path)
        else:
            batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def with_dead_letters(path: str, valid: Column, error: Column, day: Column | None = None) -> Sink:
    """Good and bad rows of each batch in one pass, as ``route`` folders below ``path/batch_id=<id>``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        on = F.current_date() if day is None else day
        write_with_dead_letters(batch, f"{path}/batch_id={batch_id}", valid, error, on, "overwrite")

    return write


def progress_rows(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """Batch id, input rows and rates of the recent progress reports of a query."""
    rows = [
        (p["batchId"], p["numInputRows"], float(p.get("processedRowsPerSecond") or 0.0), query.isActive)
        for p in query.recentProgress
    ]
    return spark.createDataFrame(rows, "batch_id bigint, input_rows bigint, rows_per_second double, running boolean")
