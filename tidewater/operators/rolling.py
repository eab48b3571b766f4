"""Rolling metrics at every tick, split so that one busy symbol never sits in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.operators.market import SMA_LONG, SMA_SHORT, WINDOW_ROWS, trend_score
from tidewater.session import range_count, scratch_path


def with_lookback(df: DataFrame, key: str, ts_ms: str, tie: str, lookback: int, chunks: int | None = None) -> DataFrame:
    """Deal rows into ranges of (key, time, tie) with about equal row counts and prepend the rows before each range.

    Row frames that reach at most ``lookback`` rows back then give the same result inside (key, ``chunk``) as over
    the whole key, so a busy key is spread over many tasks, however its rows lie in time. Prepended rows carry
    ``borrowed = true`` and are dropped after the frames were evaluated. The dealt rows are written once to the
    shared folder. ``chunks`` is the number of ranges (by default it follows the number of rows).
    """
    order = [key, ts_ms, tie]
    dealt = df.repartitionByRange(chunks or range_count(df), *order)
    path = scratch_path(df.sparkSession, "ranges")
    dealt.withColumn("chunk", F.spark_partition_id()).write.parquet(path)
    cut = df.sparkSession.read.parquet(path)
    rows = cut.withColumn("borrowed", F.lit(False))

    newest_first = W.partitionBy(key, "chunk").orderBy(F.col(ts_ms).desc(), F.col(tie).desc())
    tails = cut.withColumn("from_end", F.row_number().over(newest_first)).filter(F.col("from_end") <= lookback)

    # Chunk sizes are one row per (key, chunk); running totals over them say how
    # many rows lie between two chunks. A chunk has a row at least, so only the
    # next `lookback` chunks can need something from this one.
    by_chunk = W.partitionBy(key).orderBy("chunk")
    sizes = cut.groupBy(key, "chunk").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.withColumn("up_to_here", F.sum("size").over(by_chunk))
    sizes = sizes.withColumn("before_here", F.col("up_to_here") - F.col("size"))
    followers = F.collect_list(F.struct("chunk", "before_here")).over(by_chunk.rowsBetween(1, lookback))
    links = (
        sizes.withColumn("followers", followers)
        .select(key, "chunk", "up_to_here", F.explode("followers").alias("next"))
        .withColumn("between", F.col("next.before_here") - F.col("up_to_here"))
        .filter(F.col("between") < lookback)
        .select(key, "chunk", F.col("next.chunk").alias("target"), "between")
    )
    borrowed = (
        tails.join(links, [key, "chunk"])
        .filter(F.col("from_end") + F.col("between") <= lookback)
        .select(*df.columns, F.col("target").alias("chunk"), F.lit(True).alias("borrowed"))
    )
    return rows.unionByName(borrowed)


def _priced_averages(spread: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds ``short_average`` and ``long_average`` over the last 5 and 20 rows with a price, on every such row."""
    priced = W.partitionBy(key, "chunk", F.col("close").isNull()).orderBy(*order)
    for name, length in (("short_average", SMA_SHORT), ("long_average", SMA_LONG)):
        spread = spread.withColumn(
            name, F.when(F.col("close").isNotNull(), F.avg("close").over(priced.rowsBetween(-(length - 1), 0)))
        )
    return spread


def _last_known(name: str, frame) -> Column:
    return F.last(name, ignorenulls=True).over(frame)


def rolling_state(
    ticks: DataFrame, key: str = "symbol", ts_ms: str = "timestamp", tie: str = "id", chunks: int | None = None
) -> DataFrame:
    """Strict market state as of every tick over the last 25 ticks of its symbol.

    As in the state of a single window, rows without a price count as ticks but take no place in prices and averages.
    """
    spread = with_lookback(ticks.select(key, ts_ms, tie, "close", "volume"), key, ts_ms, tie, WINDOW_ROWS - 1, chunks)
    spread = _priced_averages(spread, key, [ts_ms, tie])
    full = W.partitionBy(key, "chunk").orderBy(ts_ms, tie).rowsBetween(-(WINDOW_ROWS - 1), 0)
    volume = F.coalesce("volume", F.lit(0.0))

    framed = spread.select(
        key, ts_ms, tie, "borrowed",
        _last_known("close", full).alias("last_price"),
        F.count(F.lit(1)).over(full).alias("window_count"),
        F.count("close").over(full).alias("priced"),
        F.first("close", ignorenulls=True).over(full).alias("first_price"),
        F.avg("close").over(full).alias("avg_price"),
        F.avg(volume).over(full).alias("avg_volume"),
        F.min("close").over(full).alias("min_price"),
        F.max("close").over(full).alias("max_price"),
        F.stddev_pop("close").over(full).alias("deviation"),
        F.sum(volume).over(full).alias("total_volume"),
        F.sum(F.col("close") * volume).over(full).alias("turnover"),
        _last_known("short_average", full).alias("short_average"),
        _last_known("long_average", full).alias("long_average"),
    ).filter(~F.col("borrowed"))

    first, last, n = F.col("first_price"), F.col("last_price"), F.col("priced")
    state = framed.select(
        key, ts_ms, tie, "window_count", "last_price", "avg_price", "avg_volume", "min_price", "max_price",
        F.when(first != 0, (last - first) / F.nullif(first, F.lit(0.0)) * 100.0).alias("price_return_pct"),
        F.when(n >= 2, F.col("deviation")).alias("volatility_estimate"),
        F.when(F.col("total_volume") > 0, F.col("turnover") / F.nullif("total_volume", F.lit(0.0))).alias("vwap"),
        F.when(n >= SMA_SHORT, F.col("short_average")).alias("sma_5"),
        F.when(n >= SMA_LONG, F.col("long_average")).alias("sma_20"),
    )
    return state.withColumn(
        "trend_score", trend_score(F.col("sma_5"), F.col("sma_20"), F.col("price_return_pct"))
    )


def moving_averages(
    ticks: DataFrame, key: str = "symbol", ts_ms: str = "timestamp", tie: str = "id", chunks: int | None = None
) -> DataFrame:
    """Only the two moving averages at every tick, by the rule of ``rolling_state``: null until enough prices exist."""
    spread = with_lookback(ticks.select(key, ts_ms, tie, "close"), key, ts_ms, tie, WINDOW_ROWS - 1, chunks)
    spread = _priced_averages(spread, key, [ts_ms, tie])
    full = W.partitionBy(key, "chunk").orderBy(ts_ms, tie).rowsBetween(-(WINDOW_ROWS - 1), 0)
    n = F.count("close").over(full)
    return (
        spread.withColumn("sma_5", F.when(n >= SMA_SHORT, _last_known("short_average", full)))
        .withColumn("sma_20", F.when(n >= SMA_LONG, _last_known("long_average", full)))
        .filter(~F.col("borrowed"))
        .select(key, ts_ms, tie, "sma_5", "sma_20")
    )
