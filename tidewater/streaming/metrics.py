"""Counters of a stream without a second pass: observed while a batch runs, and put down when it has ended."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

COUNTERS = "counters"


def observed(df: DataFrame, **counters: Column) -> DataFrame:
    """``df`` with aggregates that Spark computes as rows pass by."""
    return df.observe(COUNTERS, *[c.alias(n) for n, c in counters.items()])


class CounterLog(StreamingQueryListener):
    """Puts the observed counters of each batch down as one JSON line in ``path/batch_id=<id>``.

    A batch that is run again replaces its line. Times are written as text.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(COUNTERS)
        if found is not None:
            self._put(event.progress.batchId, found.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def _put(self, batch_id: int, counters: dict) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch_id={batch_id}/counters.json")
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = files.create(place, True)
        try:
            out.write(json.dumps(counters, default=str).encode() + b"\n")
        finally:
            out.close()


def counted(spark: SparkSession, path: str, schema: str, query: StreamingQuery, wait_seconds: float = 60.0) -> DataFrame:
    """The counters of a finished query by batch_id; waits until the listener has put down its recent batches."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    files = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    due = {p["batchId"] for p in query.recentProgress if p["observedMetrics"]}
    until = time.monotonic() + wait_seconds
    while any(not files.exists(fs_path(f"{path}/batch_id={b}/counters.json")) for b in due):
        if time.monotonic() > until:
            raise TimeoutError(f"counters of some of the batches {sorted(due)} are missing")
        time.sleep(0.05)
    return spark.read.schema(f"{schema}, batch_id bigint").json(path)
