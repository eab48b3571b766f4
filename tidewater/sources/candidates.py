"""Choosing among alternative sources: ordered candidates and fallback rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_candidate(rows: DataFrame, key: str = "symbol", rank: str = "candidate_rank") -> DataFrame:
    """Rows of the lowest-ranked candidate that returned any row for the key.

    The winning rank is a combining aggregate joined back on (key, rank), so a
    key with very many rows is never gathered in one task.
    """
    winner = rows.groupBy(key).agg(F.min(rank).alias(rank))
    return rows.join(winner, [key, rank])


def with_fallback(
    live: DataFrame, wanted: DataFrame, fallback: DataFrame, error: Column, key: str = "symbol"
) -> DataFrame:
    """Live rows, plus fallback rows for wanted keys the live source has nothing for."""
    marked = live.select(
        "*",
        F.lit("live").alias("mode"),
        F.lit(False).alias("fallback_used"),
        F.lit(None).cast("string").alias("source_error"),
    )
    missing = wanted.select(key).distinct().join(live.select(key).distinct(), key, "left_anti")
    filled = fallback.join(missing, key, "left_semi").select(
        "*", F.lit("fallback").alias("mode"), F.lit(True).alias("fallback_used"), error.alias("source_error")
    )
    return marked.unionByName(filled, allowMissingColumns=True)


def window_or_fallback(
    window: DataFrame, wanted: DataFrame, fallback: DataFrame, minimum: int = 20, key: str = "symbol"
) -> DataFrame:
    """Bounded windows of the keys that have enough rows; the fallback window for all other wanted keys.

    ``window`` is read several times: pass a written table.
    """
    counts = window.groupBy(key).agg(F.count(F.lit(1)).alias("row_count"))
    enough = counts.filter(F.col("row_count") >= minimum)
    error = F.lit(f"fewer than {minimum} live rows")
    return with_fallback(window.join(enough.select(key), key, "left_semi"), wanted, fallback, error, key)


def fallback_prices(symbols: DataFrame, now_ms: Column, rows: int = 25) -> DataFrame:
    """The fixed 25-point price window for each symbol, minute by minute up to now."""
    base, pattern = FALLBACK_BASE_PRICE, FALLBACK_PATTERN[-rows:]
    points = F.posexplode(F.array(*[F.lit(float(p)) for p in pattern])).alias("i", "shift")
    return symbols.select("symbol", points).select(
        "symbol",
        (F.lit(base) + F.col("shift")).alias("close"),
        F.round(F.lit(1.1) + F.col("i") * F.lit(0.07), 4).alias("volume"),
        (now_ms - (len(FALLBACK_PATTERN) - F.col("i")) * 60_000).alias("timestamp"),
        F.col("i").cast("bigint").alias("id"),
        F.lit("fallback").alias("provider"),
    )


# Shape of the fallback price window.
FALLBACK_BASE_PRICE = 68400.0
FALLBACK_PATTERN = (
    -120, -90, -60, -35, -20, -10, 0, 12, 25, 40, 55, 70, 82,
    95, 105, 116, 128, 141, 155, 170, 185, 198, 212, 228, 245,
)
