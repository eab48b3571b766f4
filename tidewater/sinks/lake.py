"""Lake tables: append, overwrite, partitioned and evolving writes, zone-free times, dead letters."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODES = ("append", "overwrite")


def strip_time_zone(df: DataFrame) -> DataFrame:
    """Every timestamp column as zone-free UTC wall time."""
    zoned = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in zoned}) if zoned else df


def write_table(
    df: DataFrame,
    path: str,
    mode: str = "append",
    partition_by: tuple[str, ...] = (),
    fmt: str = "parquet",
) -> None:
    """One distributed, atomic write job; rows of a partition value are spread, not gathered.

    With ``fmt="delta"`` (if its jar is present) the schema options of that format are set;
    parquet tables evolve on read, see ``read_table``.
    """
    if mode not in MODES:
        raise ValueError(f"write mode must be one of {MODES}: {mode}")
    writer = strip_time_zone(df).write.mode(mode).format(fmt)
    if fmt == "delta":
        writer = writer.option("mergeSchema" if mode == "append" else "overwriteSchema", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Table scan; columns added later are null in older rows."""
    reader = spark.read.format(fmt)
    return (reader.option("mergeSchema", True) if fmt == "parquet" else reader).load(path)


def skip_conflicts(new_rows: DataFrame, existing: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """New rows whose key is not stored yet, first one per key."""
    payload = [c for c in new_rows.columns if c not in key]
    first = (
        new_rows.groupBy(*key)
        .agg(F.min_by(F.struct(*payload), F.struct(*order)).alias("row"))
        .select(*key, "row.*")
    )
    return first.join(existing.select(*key), key, "left_anti").select(*new_rows.columns)


def write_with_dead_letters(
    df: DataFrame, path: str, valid: Column, error: Column, day: Column, mode: str = "append"
) -> None:
    """Good and bad rows in one pass: ``route=good`` and ``route=dead`` folders below ``path``.

    The input is evaluated once; bad rows carry ``dlq_error`` and ``dlq_date``.
    """
    ok = F.coalesce(valid, F.lit(False))
    routed = df.select(
        "*",
        F.when(~ok, error).alias("dlq_error"),
        F.when(~ok, day).alias("dlq_date"),
        F.when(ok, "good").otherwise("dead").alias("route"),
    )
    write_table(routed, path, mode, ("route",))


def write_or_dead_letter(df: DataFrame, path: str, dlq_path: str, **options) -> str | None:
    """Write a batch; if the write fails, store the batch with the error text instead of stopping.

    Returns the error text, or None when the batch reached its table.
    """
    try:
        write_table(df, path, **options)
        return None
    except Exception as exc:  # every write failure goes the same way
        message = f"{type(exc).__name__}: {str(exc).splitlines()[0]}"
        # payload as JSON text, so batches of any schema share one table
        stored = df.select(F.to_json(F.struct("*")).alias("record")).select(
            "record", F.lit(message).alias("dlq_error"), F.current_date().alias("dlq_date")
        )
        stored.write.mode("append").partitionBy("dlq_date").parquet(dlq_path)
        return message


# Columns of the log table and the days it is kept.
LOG_COLUMNS = ("time", "component", "level", "message", "trace_id", "agent_name", "metadata")
LOG_RETENTION_DAYS = 30


def append_logs(logs: DataFrame, path: str, batch_id: int = 0) -> None:
    """Append log rows below ``path/day=<date>/batch_id=<id>``; a replayed batch replaces its own folders only."""
    rows = logs.select(*LOG_COLUMNS).withColumns({"day": F.to_date("time"), "batch_id": F.lit(batch_id)})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").parquet(path)


def expire_days(spark: SparkSession, path: str, today: datetime.date, days: int = LOG_RETENTION_DAYS) -> list[str]:
    """Remove whole days that are older than the retention time; their names, oldest first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    first = f"day={today - datetime.timedelta(days=days)}"
    names = sorted(s.getPath().getName() for s in files.listStatus(folder) if s.isDirectory())
    old = [n for n in names if n.startswith("day=") and n < first]
    for name in old:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, name), True)
    return old
