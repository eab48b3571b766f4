"""Row shapes of the outgoing sinks: SQL tables, HTTP payloads, vector batches, logs, audit rows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Status codes by error class, batch sizes.
AUDIT_STATUS = (
    ("PermissionError", 403),
    ("DomainNotFoundError", 404),
    ("ActionNotFoundError", 422),
    ("ValueError", 400),
    ("CircuitOpenError", 503),
)
HTTP_BATCH = 100
VECTOR_BATCH = 1000


def flatten_for_sql(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, the rest unchanged."""
    nested = (T.StructType, T.ArrayType, T.MapType, T.VariantType)
    return df.select(
        *[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields]
    )


def quoted_table(table: str, schema: str = "public") -> str:
    return ".".join('"' + part.replace('"', '""') + '"' for part in (schema, table))


def insert_from(staged: str, table: str, columns: list[str], schema: str = "public", conflict: str | None = None) -> str:
    """One statement that moves staged rows into a table; ``conflict`` is its conflict clause, such as ON CONFLICT DO NOTHING."""
    names = ",".join('"' + c.replace('"', '""') + '"' for c in columns)
    sql = f"INSERT INTO {quoted_table(table, schema)} ({names}) SELECT {names} FROM {quoted_table(staged, schema)}"
    return f"{sql} {conflict}" if conflict else sql


def write_jdbc(
    df: DataFrame, url: str, table: str, properties: dict[str, str] | None = None,
    column_types: str | None = None, batch_size: int = 1000, schema: str = "public",
    ddl: str | None = None, conflict: str | None = None, execute: Callable[[str], None] | None = None,
) -> None:
    """Append over JDBC; each task writes its partition in one transaction, so an error rolls it back.

    ``ddl`` runs once before the write. With a ``conflict`` clause the rows go to a staging table first and one
    statement moves them, so the clause holds for the whole write. Both need ``execute``, a function that runs a
    statement on a connection of the caller's.
    """
    if (ddl or conflict) and execute is None:
        raise ValueError("ddl and conflict need a function that executes a statement")
    if ddl:
        execute(ddl)
    flat = flatten_for_sql(df)
    target = f"{table}_staged_{uuid.uuid4().hex[:12]}" if conflict else table
    writer = flat.write.mode("append").option("batchsize", batch_size)
    if column_types:
        writer = writer.option("createTableColumnTypes", column_types)
    try:
        writer.jdbc(url, quoted_table(target, schema) if conflict else table, properties=properties or {})
        if conflict:
            execute(insert_from(target, table, flat.columns, schema, conflict))
    finally:
        if conflict:
            execute(f"DROP TABLE IF EXISTS {quoted_table(target, schema)}")


def batch_numbers(df: DataFrame, size: int) -> DataFrame:
    """Add (``part``, ``batch``): consecutive rows of a partition, ``size`` at a time.

    The row position comes from the partition-local part of the generated id, so
    no shuffle and no global numbering is needed.
    """
    row = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        df.withColumn("_id", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("_id", 33))
        .withColumn("batch", F.floor(row / size))
        .drop("_id")
    )


def http_payloads(
    df: DataFrame, batch_key: str | None = "records", order: list[str] | None = None,
    sent_at: Column | None = None, metadata: bool = True, size: int = HTTP_BATCH,
) -> DataFrame:
    """(part, batch, count, payload): one JSON payload per batch of at most ``size`` rows.

    A payload is {key: [records], _metadata} or a bare array. Batches are dealt by ``batch_numbers``, so no list can
    outgrow ``size``, whatever the rows hold.
    """
    columns = df.columns
    ordering = F.struct(*(order or columns))
    grouped = batch_numbers(df, size).groupBy("part", "batch").agg(
        F.count(F.lit(1)).alias("count"),
        F.sort_array(F.collect_list(F.struct(ordering.alias("o"), F.struct(*columns).alias("r")))).alias("sorted"),
    )
    records = F.transform("sorted", lambda s: s["r"])
    if batch_key is None:
        payload = F.to_json(records)
    else:
        fields = [records.alias(batch_key)]
        if metadata:
            at = F.current_timestamp() if sent_at is None else sent_at
            stamp = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
            fields.append(F.struct("count", stamp.alias("timestamp")).alias("_metadata"))
        payload = F.to_json(F.struct(*fields))
    return grouped.select("part", "batch", "count", payload.alias("payload"))


def post_partitions(
    df: DataFrame, post: Callable[[object], None], batch_size: int = HTTP_BATCH, batch_key: str | None = None
) -> None:
    """Send each partition in batches through an injected ``post`` function; empty batches are not sent."""

    def send(rows: Iterator) -> None:
        batch = []

        def flush() -> None:
            if batch:
                post({batch_key: list(batch)} if batch_key else list(batch))
                batch.clear()

        for row in rows:
            batch.append(json.loads(row.record))
            if len(batch) == batch_size:
                flush()
        flush()

    df.select(F.to_json(F.struct("*")).alias("record")).foreachPartition(send)


def http_poster(
    url: str, method: str = "POST", headers: dict[str, str] | None = None, auth_type: str = "none",
    auth_token: str = "", auth_header: str = "Authorization", timeout: float = 30.0, raise_on_error: bool = True,
) -> Callable[[object], None]:
    """Function for ``post_partitions`` that sends one JSON body per call."""
    import base64

    sent = {"Content-Type": "application/json", **(headers or {})}
    if auth_type == "bearer":
        sent[auth_header] = f"Bearer {auth_token}"
    elif auth_type == "header":
        sent[auth_header] = auth_token
    elif auth_type == "basic":
        sent["Authorization"] = "Basic " + base64.b64encode(auth_token.encode()).decode()

    def post(payload: object) -> None:
        import urllib.request

        request = urllib.request.Request(url, json.dumps(payload).encode(), sent, method=method)
        try:
            with urllib.request.urlopen(request, timeout=timeout):
                pass
        except OSError:
            if raise_on_error:
                raise

    return post


def vector_rows(df: DataFrame, column: str, dimension: int) -> DataFrame:
    """Rows with float vectors; ``valid`` tells whether the dimension is right and no value is missing."""
    vector = F.col(column).cast("array<float>")
    return df.withColumn(column, vector).withColumn(
        "valid", F.coalesce((F.size(vector) == dimension) & ~F.exists(vector, lambda x: x.isNull()), F.lit(False))
    )


def vector_batches(df: DataFrame, column: str, dimension: int, size: int = VECTOR_BATCH) -> DataFrame:
    """Valid vector rows dealt into insert batches (part, batch) of at most ``size`` rows."""
    return batch_numbers(vector_rows(df, column, dimension).filter("valid").drop("valid"), size)


def audit_status(error_class: Column) -> Column:
    code = F.when(error_class.isNull(), 200)
    for name, status in AUDIT_STATUS:
        code = code.when(error_class == name, status)
    return code.otherwise(500)


def audit_rows(requests: DataFrame) -> DataFrame:
    """One audit row per handled request."""
    return requests.select(
        "request_id", "user_id", "domain", "action",
        F.coalesce("parameters", F.lit("{}")).alias("parameters"),
        "protocol",
        audit_status(F.col("error_class")).alias("status_code"),
        "duration_ms",
        F.when(F.col("error_class").isNotNull(), F.col("error_detail")).alias("error_detail"),
    )
