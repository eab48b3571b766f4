"""Cooldown over a stream: the last fired time of each key is value state, freed by a timer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class LastFired(StatefulProcessor):
    """Marks the rows of a key that fire and remembers the last one.

    A timer at the end of the cooldown removes the state: once the watermark is there, any row still to come fires
    with or without it.
    """

    def __init__(self, columns: list[str], tie: str, cooldown_ms: int) -> None:
        self.columns, self.tie, self.cooldown = columns, tie, cooldown_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last_fired = handle.getValueState("last_fired", "t bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).set_axis(self.columns, axis=1)  # Spark changes some names
        batch = batch.sort_values(["_t", self.tie], kind="stable", ignore_index=True)
        t = batch["_t"].to_numpy()
        known = self.last_fired.get()[0] if self.last_fired.exists() else None
        last = known
        at = 0 if last is None else int(np.searchsorted(t, last + self.cooldown))
        fired = np.zeros(len(t), bool)
        while at < len(t):  # one turn per event that fires
            fired[at], last = True, int(t[at])
            at = int(np.searchsorted(t, last + max(1, self.cooldown)))
        if last != known:
            if known is not None:
                self.handle.deleteTimer(known + self.cooldown)
            self.last_fired.update((last,))
            self.handle.registerTimer(last + self.cooldown)
        yield batch.drop(columns="_t").assign(fired=fired)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last_fired.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def stream_fired(
    events: DataFrame, key: str, ts: str, tie: str, cooldown_ms: int = 120_000, lateness: str = "1 hour", exempt: Column | None = None
) -> DataFrame:
    """The stream's rows with a boolean ``fired``, decided in order of (``ts``, ``tie``) within and across batches.

    ``ts`` is a time stamp. A row that comes after later ones have fired is judged against the last that fired; rows
    more than ``lateness`` behind the newest are dropped as by any watermark. Rows matching ``exempt`` always fire
    and never hold back others. Run it with RocksDB as the state store (``windows.rocksdb``).
    """
    spared = F.lit(False) if exempt is None else F.coalesce(exempt, F.lit(False))
    marked = events.withWatermark(ts, lateness).withColumn("_exempt", spared)
    limited = marked.filter(~F.col("_exempt")).drop("_exempt").withColumn("_t", F.unix_millis(ts))
    columns = [c for c in limited.columns if c != "_t"]
    schema = ", ".join(f"`{c}` {limited.schema[c].dataType.simpleString()}" for c in columns) + ", fired boolean"
    judged = limited.groupBy(key).transformWithStateInPandas(
        LastFired(limited.columns, tie, cooldown_ms), outputStructType=schema, outputMode="append", timeMode="EventTime"
    )
    if exempt is None:
        return judged
    return judged.unionByName(marked.filter("_exempt").drop("_exempt").withColumn("fired", F.lit(True)))
