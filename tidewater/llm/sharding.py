"""Jump consistent hashing: stable keys to shards without a ring table.

Appending one shard moves only the share of rows that the new shard takes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewater.llm.common import stage

BLOCK_ROWS = 1 << 16
OWN = ("shard", "grown_shard", "slot", "_row", "_block", "_n", "_place", "_first")


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key; all keys jump together until each has passed the last shard."""
    key = keys.astype(np.uint64)
    at = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    jump = np.zeros(len(key), np.int64)
    while len(live):
        at[live] = jump[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        jump[live] = (
            (at[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0))
        ).astype(np.int64)
        live = live[jump[live] < shards]
    return at.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64).view(np.uint64), shards))

    return of(F.xxhash64(key))


def shard(df: DataFrame, key: str, shards: int, payload: list[Column]) -> DataFrame:
    """Rows with ``shard``, ``grown_shard`` (with one shard more) and ``slot`` (gapless from 0 in a shard).

    Only the key and ``payload`` travel. A shard is numbered in blocks: each block counts its rows, the counts
    give every block its first slot, and rows are numbered inside their block, so a shard that holds a large part
    of all rows never meets in one task. A null key hashes to a fixed value; rows with equal keys share a shard
    but not a slot. A key or payload column with a name of ``OWN``, in any case, is refused. An empty table gives an empty result.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    taken = [c for c in df.select(F.col(key).alias(key), *payload).columns if c.lower() in OWN]
    if taken:
        raise ValueError(f"give these columns another name: {taken}")
    row = F.monotonically_increasing_id()
    placed = stage(
        df.select(
            F.col(key).alias(key), *payload,
            shard_of(F.col(key), shards).alias("shard"), shard_of(F.col(key), shards + 1).alias("grown_shard"),
        ).withColumn("_row", row).withColumn("_block", F.shiftright("_row", BLOCK_ROWS.bit_length() - 1)),
        "shards",
    )
    counts = placed.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(
        "shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")
    )
    inside = F.row_number().over(Window.partitionBy("shard", "_block").orderBy("_row"))
    return (
        placed.withColumn("_place", inside)
        .join(firsts, ["shard", "_block"])
        .withColumn("slot", (F.col("_first") + F.col("_place") - 1).cast("long"))
        .drop("_row", "_block", "_place", "_first")
    )
