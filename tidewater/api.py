"""Read surface: run SQL, query stream tables, schema, table list, preview; and user function hooks."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import scratch_path

# Path rule, page and preview sizes, seconds that a table list is kept.
PATH_PATTERN = r"[A-Za-z0-9_\-./:]+"
PATH_MAX = 256
PAGE_ROWS = 10_000
PREVIEW_ROWS = 10
TABLE_LIST_SECONDS = 60.0

ROW_NUMBER = "_row_number"


def check_table_path(path: str) -> str:
    if not path:
        raise ValueError("table path must not be empty")
    if len(path) > PATH_MAX:
        raise ValueError(f"table path is longer than {PATH_MAX} characters")
    if not re.fullmatch(PATH_PATTERN, path):
        raise ValueError(f"invalid table path: {path!r}")
    return path


def is_safe_path(path: Column) -> Column:
    return F.coalesce((F.length(path) > 0) & (F.length(path) <= PATH_MAX) & path.rlike(rf"\A{PATH_PATTERN}\z"), F.lit(False))


def run_sql(spark: SparkSession, sql: str, page_size: int = PAGE_ROWS, **tables: DataFrame) -> dict:
    """Whole result of a query as a written table, its true row count and its first page; or the error.

    The result is written once, below the shared folder, and ``path`` names it: nothing is cut. ``rows`` holds the
    first ``page_size`` rows as plain lists, ``next_page`` (of ``read_page``) is None when that was all.
    """
    if not sql or not sql.strip():
        raise ValueError("sql is required")
    try:
        result = query(spark, sql, **tables)
        path = scratch_path(spark, "result")
        result.withColumn(ROW_NUMBER, F.monotonically_increasing_id()).write.parquet(path)
        count = spark.read.parquet(path).count()
        page = read_page(spark, path, None, page_size)
        return {"success": True, "columns": result.columns, "path": path, "row_count": count, **page}
    except Exception as exc:  # the envelope reports every failure
        return {"success": False, "error_type": type(exc).__name__, "error_message": str(exc)}


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """The whole result that ``run_sql`` wrote."""
    return spark.read.parquet(path).drop(ROW_NUMBER)


def read_page(spark: SparkSession, path: str, after: int | None, page_size: int = PAGE_ROWS) -> dict:
    """The next ``page_size`` rows of a written result behind row number ``after``, in the order they were written."""
    rows = spark.read.parquet(path)
    if after is not None:
        rows = rows.filter(F.col(ROW_NUMBER) > after)
    got = rows.orderBy(ROW_NUMBER).limit(page_size + 1).collect()
    page = got[:page_size]
    return {
        "rows": [list(r)[:-1] for r in page],
        "next_page": page[-1][ROW_NUMBER] if len(got) > page_size else None,
    }


def query(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """SQL over named DataFrames (batch or the sink tables of a stream), result left distributed."""
    return spark.sql(sql, **tables) if tables else spark.sql(sql)


def _open(spark: SparkSession, name: str) -> DataFrame:
    check_table_path(name)
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def get_schema(spark: SparkSession, name: str) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in _open(spark, name).schema.fields]


def preview(spark: SparkSession, name: str, limit: int = PREVIEW_ROWS, order: list[str] | None = None) -> DataFrame:
    """First rows of a table, in the given order if there is one."""
    rows = _open(spark, name)
    return (rows.orderBy(*order) if order else rows).limit(limit)


_table_lists: dict[tuple, tuple[float, dict]] = {}


def list_tables(
    spark: SparkSession,
    database: str = "default",
    fallback: tuple[tuple[str, str], ...] = (),
    keep_seconds: float = TABLE_LIST_SECONDS,
    clock: Callable[[], float] = time.monotonic,
) -> dict:
    """(name, path) of the catalog's tables; a configured list when the catalog cannot be read.

    A list that was read is kept for ``keep_seconds`` per session and database; one statement reads all tables.
    """
    key = (id(spark), database)
    read_at, known = _table_lists.get(key, (None, None))
    if known is not None and clock() - read_at < keep_seconds:
        return known
    try:
        found = []
        for row in spark.sql(f"SHOW TABLE EXTENDED IN {quoted(database)} LIKE '*'").collect():
            if not row.isTemporary:
                place = re.search(r"^Location: (.*)$", row.information, re.MULTILINE)
                found.append((row.tableName, place[1] if place else ""))
        answer = {"source": "catalog", "tables": sorted(found)}
        _table_lists[key] = (clock(), answer)
        return answer
    except Exception as exc:
        return {"source": "fallback", "tables": list(fallback), "error": f"{type(exc).__name__}: {exc}"}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def chain(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply user transforms one after another; the plan stays lazy."""
    for step in steps:
        df = df.transform(step)
    return df


def score_with(
    df: DataFrame, payload: str, load: Callable[[], Callable[[pd.Series], pd.DataFrame]], output: str
) -> DataFrame:
    """Score a payload column with a user model loaded once per task.

    ``load()`` returns a function from a batch of payloads to a frame with the
    columns of ``output``; batches arrive through Arrow.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for values in batches:
            yield scorer(values)

    scored = df.withColumn("_scored", F.pandas_udf(run, output)(F.col(payload)))
    return scored.select(*df.columns, "_scored.*")
