"""Session defaults, table loading and the shared scratch folder."""

from __future__ import annotations

import math
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app_name: str = "tidewater", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with the defaults the library is written against.

    Shuffle partitions are left to the cluster (AQE coalesces them); pass
    ``**{"spark.sql.shuffle.partitions": "8"}`` for local runs.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """All event times in the library are UTC; zone-free columns are read as UTC instants."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where that is not set, a folder of its own below the warehouse is: a session's tables have to be shared, too. On a
    cluster whose warehouse is a local folder, there is none.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not configured:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        on_one_machine = "://" not in warehouse or warehouse.startswith("file:")
        if on_one_machine and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = f"{warehouse.rstrip('/')}/_scratch"
    return configured.rstrip("/")


RANGE_ROWS = 1 << 20  # rows of a range where work is dealt into ranges of an order
LEAST_RANGE_ROWS = 1 << 12


def range_count(df: DataFrame, rows: int = RANGE_ROWS) -> int:
    """Ranges for about ``rows`` rows each, so that their number grows with the table; small tables get more, smaller ones."""
    return ranges_for(df.sparkSession, df.count(), rows)


def ranges_for(spark: SparkSession, n: int, rows: int = RANGE_ROWS) -> int:
    """``range_count`` of a table of n rows."""
    spread = min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / LEAST_RANGE_ROWS))
    return max(1, spread, math.ceil(n / rows))


_scratch: dict[int, list[str]] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for a written table or a stream checkpoint."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _scratch.setdefault(id(spark.sparkContext), []).append(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later jobs start there."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_scratch(spark: SparkSession) -> int:
    """Remove every scratch path this session was given; results that still read them must have been used before."""
    paths = _scratch.pop(id(spark.sparkContext), [])
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)
