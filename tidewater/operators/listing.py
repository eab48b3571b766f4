"""Sorted, filtered and paged listings, log search, table profile and row gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import RANGE_ROWS, range_count

# Limits of the read surface.
LOG_LIMIT = 500
LOG_DEFAULT_LIMIT = 100
MINIMUM_ROWS = 20
LOG_COLUMNS = ("time", "component", "level", "message", "trace_id", "agent_name", "metadata")


def newest(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Top ``n`` by descending order; planned as a bounded top-k, not a full sort."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def history(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Newest ``n`` rows, returned oldest first."""
    return newest(df, order, n).orderBy(*order)


def page(
    df: DataFrame,
    order: list[Column],
    page_number: int = 1,
    page_size: int = 100,
    filters: dict[str, str | None] | None = None,
) -> DataFrame:
    """One page of a listing with optional equality filters."""
    rows = df
    for name, wanted in (filters or {}).items():
        if wanted is not None:
            rows = rows.filter(F.lower(name) == wanted.lower())
    return rows.orderBy(*order).offset((page_number - 1) * page_size).limit(page_size)


def write_in_order(df: DataFrame, order: list[Column], path: str, rows: int = RANGE_ROWS) -> None:
    """Write a table in ranges of a total order (folders ``_range``), about ``rows`` rows each, for ``ordered_page``."""
    dealt = df.repartitionByRange(range_count(df, rows), *order).withColumn("_range", F.spark_partition_id())
    dealt.sortWithinPartitions(*order).write.mode("overwrite").partitionBy("_range").parquet(path)


def ranges_of_page(counts: list[tuple[int, int]], first: int, size: int) -> tuple[list[int], int]:
    """The ranges that hold rows ``first`` to ``first + size`` and how many rows of them come before.

    ``counts``: (range, rows), in order.
    """
    wanted, skip, before = [], 0, 0
    for number, rows in counts:
        if rows and before < first + size and before + rows > first:
            if not wanted:
                skip = first - before
            wanted.append(number)
        before += rows
    return wanted, max(0, skip)


def ordered_page(spark: SparkSession, path: str, order: list[Column], page_number: int = 1, page_size: int = 100) -> DataFrame:
    """One page of a table that ``write_in_order`` wrote: counts per range tell which ranges hold it, and only those are read.

    A deep page costs as much as the first one.
    """
    rows = spark.read.parquet(path)
    counts = sorted((r["_range"], r["count"]) for r in rows.groupBy("_range").count().collect())  # one row per range
    wanted, skip = ranges_of_page(counts, (page_number - 1) * page_size, page_size)
    return rows.filter(F.col("_range").isin(wanted)).orderBy(*order).offset(skip).limit(page_size).drop("_range")


def page_counts(df: DataFrame, page_size: int) -> DataFrame:
    """Row total, exact page count, and the count that adds a page when the total divides evenly."""
    total = F.count(F.lit(1))
    return df.agg(
        total.alias("total"),
        F.ceil(total / page_size).cast("bigint").alias("pages"),
        (F.floor(total / page_size) + 1).cast("bigint").alias("total_pages"),
    )


def since_interval(text: str) -> tuple[int, str]:
    """('24h' -> (24, 'hours')); anything unreadable means one hour."""
    units = {"m": "minutes", "h": "hours", "d": "days"}
    try:
        value, unit = int(text[:-1]), text[-1].lower()
    except (ValueError, IndexError, TypeError):
        return 1, "hours"
    return (value, units[unit]) if unit in units else (1, "hours")


def since_lower_bound(duration: Column, now: Column) -> Column:
    """Column form of ``since_interval``: the time from which rows are wanted."""
    value = F.regexp_extract(duration, r"^([+-]?\d+).$", 1)
    unit = F.lower(F.right(duration, F.lit(1)))
    readable = value != ""
    seconds = (
        F.when(readable & (unit == "m"), F.lit(60))
        .when(readable & (unit == "h"), F.lit(3600))
        .when(readable & (unit == "d"), F.lit(86400))
    )
    amount = F.when(seconds.isNotNull(), value.try_cast("bigint") * seconds).otherwise(F.lit(3600))
    return F.timestamp_seconds(F.unix_seconds(now) - amount)


def search_logs(
    logs: DataFrame,
    now: Column,
    component: str | None = None,
    level: str | None = None,
    agent_name: str | None = None,
    trace_id: str | None = None,
    since: str = "1h",
    limit: int = LOG_DEFAULT_LIMIT,
    tie: list[str] | None = None,
) -> DataFrame:
    """Newest log rows that match the given filters; the bounds are literals, so files and partitions are pruned."""
    amount, unit = since_interval(since)
    lower = now - F.make_dt_interval(
        **{{"minutes": "mins", "hours": "hours", "days": "days"}[unit]: F.lit(amount)}
    )
    rows = logs.filter(F.col("time") >= lower)
    if "day" in logs.columns:  # the partition column of a written log table
        rows = rows.filter(F.col("day") >= F.to_date(lower))
    for name, wanted in (
        ("component", component), ("level", level.upper() if level else None),
        ("agent_name", agent_name), ("trace_id", trace_id),
    ):
        if wanted:
            rows = rows.filter(F.col(name) == wanted)
    order = [F.col("time").desc(), *[F.col(c).desc() for c in tie or []]]
    return rows.orderBy(*order).limit(min(limit, LOG_LIMIT)).select(
        *[c for c in LOG_COLUMNS if c in logs.columns], *[c for c in tie or [] if c not in LOG_COLUMNS]
    )


def search_by_name(names: DataFrame, needle: str, name: str = "name") -> DataFrame:
    """Rows whose name contains the text, ignoring case, in name order."""
    return names.filter(F.contains(F.lower(name), F.lit(needle.lower()))).orderBy(name)


def row_gate(df: DataFrame, key: str, minimum: int = MINIMUM_ROWS) -> DataFrame:
    """Row count per key and whether it suffices; failing keys are reported instead of stopping the job."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("row_count")).select(
        key, "row_count",
        (F.col("row_count") >= minimum).alias("passed"),
        F.when(
            F.col("row_count") < minimum,
            F.format_string("only %d rows; at least " + str(minimum) + " needed", "row_count"),
        ).alias("error"),
    )


def profile(df: DataFrame, order: list[str], last: int = 5) -> tuple[DataFrame, DataFrame]:
    """(row count and column names, newest rows by an order key)."""
    head = df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        F.lit(",".join(df.columns)).alias("columns"),
    )
    return head, newest(df, order, last)


def run_summary(runs: DataFrame, order: list[str], latest: int = 20, named: int = 5) -> DataFrame:
    """Counts over the latest runs and the first failed ones among them (at most ``named``)."""
    recent = newest(runs, order, latest)
    failed = F.col("state_type") == "FAILED"
    position = F.struct(*[(-F.col(c)).alias(c) for c in order], F.col("name"), F.col("id"))
    return recent.agg(
        F.count(F.lit(1)).alias("recent_runs"),
        F.count_if(F.col("state_type") == "RUNNING").alias("running"),
        F.count_if(failed).alias("failed"),
        F.transform(
            F.slice(F.sort_array(F.collect_list(F.when(failed, position))), 1, named),
            lambda r: F.struct(r["name"].alias("name"), r["id"].alias("id")),
        ).alias("failed_details"),
    )
