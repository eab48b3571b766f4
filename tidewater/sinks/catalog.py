"""Catalog registration and the mapping from Spark types to catalog column types."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Catalog type names; everything not listed is stored as string.
CATALOG_TYPES = {
    T.ByteType: "int",
    T.ShortType: "int",
    T.IntegerType: "int",
    T.LongType: "bigint",
    T.FloatType: "float",
    T.DoubleType: "double",
    T.BooleanType: "boolean",
    T.TimestampType: "timestamp",
    T.TimestampNTZType: "timestamp",
    T.DateType: "date",
    T.BinaryType: "binary",
    T.StringType: "string",
}


def catalog_type(kind: T.DataType) -> str:
    return CATALOG_TYPES.get(type(kind), "string")


def catalog_columns(schema: T.StructType, partition_by: tuple[str, ...] = ()) -> tuple[list, list]:
    """((name, type) of data columns, (name, type) of partition columns)."""
    named = [(f.name, catalog_type(f.dataType)) for f in schema.fields]
    return [c for c in named if c[0] not in partition_by], [c for c in named if c[0] in partition_by]


def catalog_rows(df: DataFrame) -> DataFrame:
    """The same mapping as rows (ordinal, name, type)."""
    names, _ = catalog_columns(df.schema)
    return df.sparkSession.createDataFrame(
        [(i, n, t) for i, (n, t) in enumerate(names)], "ordinal int, name string, type string"
    )


def hadoop_location(location: Column) -> Column:
    return F.regexp_replace(location, r"^s3://", "s3a://")


def plain_location(location: Column) -> Column:
    return F.regexp_replace(location, r"^s3a://", "s3://")


def register_table(
    spark: SparkSession, name: str, location: str, schema: T.StructType,
    partition_by: tuple[str, ...] = (), fmt: str = "parquet",
) -> bool:
    """Register an external table with the catalog's column types; False when it was registered before.

    Nested columns are registered as text, as every type without a counterpart is; read such a table by its path.
    """
    database, table = name.split(".", 1) if "." in name else ("default", name)
    location = re.sub(r"^s3://", "s3a://", location)
    quoted = ".".join(f"`{n.replace('`', '``')}`" for n in (database, table))
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database.replace('`', '``')}`")
    if spark.catalog.tableExists(f"{database}.{table}"):
        return False
    data, parts = catalog_columns(schema, partition_by)
    columns = ", ".join(f"`{n.replace('`', '``')}` {kind}" for n, kind in data + parts)
    partitions = f"PARTITIONED BY ({', '.join(f'`{p}`' for p in partition_by)})" if partition_by else ""
    escaped = location.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {quoted} ({columns}) USING {fmt} {partitions} LOCATION '{escaped}'")
    if partition_by:
        spark.sql(f"MSCK REPAIR TABLE {quoted}")
    return True
