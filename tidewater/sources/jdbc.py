"""SQL sources over JDBC: query scans split over a key range, and the allow-listed table endpoint."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FETCH_SIZE = 1000  # fixed value: rows per round trip


@dataclass(frozen=True)
class SqlSource:
    """A query (or table) of an SQL store.

    Set ``partition_column`` with bounds so that many tasks read ranges of it;
    without it one task reads the whole result.
    """

    url: str
    query: str
    driver: str | None = None
    user: str | None = None
    password: str | None = None
    fetch_size: int = FETCH_SIZE
    partition_column: str | None = None
    lower_bound: int | None = None
    upper_bound: int | None = None
    num_partitions: int | None = None
    extra: dict = field(default_factory=dict)

    def options(self) -> dict[str, str]:
        if not self.query.strip():
            raise ValueError("a query is required")
        options = {"url": self.url, "fetchsize": str(self.fetch_size), **self.extra}
        for name, value in (("driver", self.driver), ("user", self.user), ("password", self.password)):
            if value is not None:
                options[name] = value
        if self.partition_column is None:
            return {**options, "query": self.query}
        bounds = (self.lower_bound, self.upper_bound, self.num_partitions)
        if None in bounds:
            raise ValueError("partition_column needs lower_bound, upper_bound and num_partitions")
        return {
            **options,
            "dbtable": f"({self.query}) q",
            "partitionColumn": self.partition_column,
            "lowerBound": str(self.lower_bound),
            "upperBound": str(self.upper_bound),
            "numPartitions": str(self.num_partitions),
        }

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.format("jdbc").options(**self.options()).load()


def table_endpoint(tables: dict[str, DataFrame], name: str, order: list[str], limit: int) -> DataFrame:
    """First ``limit`` rows of an allowed table, each with the table name, limit and total."""
    if name not in tables:
        raise ValueError(f"table not allowed: {name}")
    rows = tables[name]
    total = rows.agg(F.count(F.lit(1))).scalar()
    return rows.orderBy(*order).limit(limit).select(
        F.lit(name).alias("table_name"), F.lit(limit).alias("row_limit"), "*", total.alias("total")
    )
