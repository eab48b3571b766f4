"""Changes to operational tables, written as joins that produce the next table version.

Spark's file tables have no row updates, so every change returns the full next
version as a DataFrame, to be written beside the older ones. Tables hold one
row per key, and change sets are reduced to one row per key before they meet it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Columns added to older catalog tables, with type and default.
CATALOG_ADDED_COLUMNS = (
    ("last_heartbeat_at", "timestamp", None),
    ("status", "string", "unknown"),
    ("managed", "boolean", True),
    ("desired_status", "string", "running"),
    ("observed_status", "string", "unknown"),
    ("health_status", "string", "unknown"),
    ("recovery_state", "string", "idle"),
    ("last_reconciled_at", "timestamp", None),
    ("last_failure_reason", "string", None),
    ("last_action_type", "string", None),
    ("reconcile_notes", "string", None),
    ("runtime_source", "string", None),
    ("runtime_namespace", "string", None),
    ("route_prefix", "string", None),
    ("deployment_metadata", "string", "{}"),
)


def last_change_per_key(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Newest change of each key, as an aggregate that combines map-side."""
    rest = [c for c in changes.columns if c != key]
    return (
        changes.groupBy(key)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("change"))
        .select(key, "change.*")
    )


def upsert(
    target: DataFrame,
    source: DataFrame,
    key: str = "name",
    keep_when_null: tuple[str, ...] = ("registered_at",),
    insert_only: tuple[str, ...] = ("id", "is_enabled", "created_at"),
) -> DataFrame:
    """Insert new keys, replace existing ones.

    ``keep_when_null`` columns keep the old value when the new one is null;
    ``insert_only`` columns never change once a row exists.
    """
    t, s = target.alias("t"), source.alias("s")
    matched_source = F.col(f"s.{key}").isNotNull()
    known = F.col(f"t.{key}").isNotNull()
    columns = [F.coalesce(f"s.{key}", f"t.{key}").alias(key)]
    for name in target.columns:
        if name == key:
            continue
        old, new = F.col(f"t.{name}"), F.col(f"s.{name}")
        if name not in source.columns:
            value = old
        elif name in insert_only:
            value = F.when(known, old).otherwise(new)
        elif name in keep_when_null:
            value = F.coalesce(new, old)
        else:
            value = F.when(matched_source, new).otherwise(old)
        columns.append(value.alias(name))
    return t.join(s, F.col(f"t.{key}") == F.col(f"s.{key}"), "full_outer").select(*columns)


def partial_update(
    target: DataFrame,
    changes: DataFrame,
    key: str = "name",
    replace: tuple[str, ...] = (),
    if_given: tuple[str, ...] = (),
    if_flagged: tuple[str, ...] = (),
) -> DataFrame:
    """Update only the named columns of matching keys.

    ``replace`` always takes the new value, ``if_given`` takes it when not null,
    ``if_flagged`` takes it (null included) when the change row's ``set_<column>`` is true.
    """
    t, c = target.alias("t"), changes.alias("c")
    hit = F.col(f"c.{key}").isNotNull()
    columns = []
    for name in target.columns:
        old = F.col(f"t.{name}")
        if name in replace:
            value = F.when(hit, F.col(f"c.{name}")).otherwise(old)
        elif name in if_given:
            value = F.coalesce(f"c.{name}", f"t.{name}")
        elif name in if_flagged:
            value = F.when(F.coalesce(f"c.set_{name}", F.lit(False)), F.col(f"c.{name}")).otherwise(old)
        else:
            value = old
        columns.append(value.alias(name))
    return t.join(c, F.col(f"t.{key}") == F.col(f"c.{key}"), "left").select(*columns)


def update_status(target: DataFrame, changes: DataFrame) -> DataFrame:
    return partial_update(
        target,
        changes,
        replace=("status", "updated_at"),
        if_given=(
            "observed_status", "health_status", "recovery_state",
            "last_reconciled_at", "last_seen_at", "last_heartbeat_at",
        ),
        if_flagged=("last_failure_reason", "last_action_type", "reconcile_notes"),
    )


def update_control(target: DataFrame, changes: DataFrame) -> DataFrame:
    return partial_update(
        target,
        changes,
        replace=("updated_at",),
        if_given=("managed", "desired_status"),
        if_flagged=("reconcile_notes",),
    )


def delete_keys(target: DataFrame, keys: DataFrame, key: str = "name") -> tuple[DataFrame, DataFrame]:
    """(remaining rows, one row with the number of removed rows)."""
    wanted = keys.select(key)
    remaining = target.join(wanted, key, "left_anti")
    affected = target.join(wanted, key, "left_semi").agg(F.count(F.lit(1)).alias("affected"))
    return remaining, affected


def list_entries(
    catalog: DataFrame, runtime_source: str | None = None, enabled_only: bool = True,
    json_columns: dict[str, str] | None = None,
) -> DataFrame:
    """Filtered catalog listing by name; JSON text columns are parsed to the given types."""
    rows = catalog
    if runtime_source is not None:
        rows = rows.filter(F.col("runtime_source") == runtime_source)
    if enabled_only:
        rows = rows.filter("is_enabled")
    for name, schema in (json_columns or {}).items():
        rows = rows.withColumn(name, F.from_json(name, schema))
    return rows.orderBy("name")


def mark_stale(
    target: DataFrame, cutoff: Column, from_statuses: list[str] | None = None, stale_status: str = "stale"
) -> tuple[DataFrame, DataFrame]:
    """(next version, one row with the number of rows marked)."""
    hit = F.col("last_heartbeat_at").isNotNull() & (F.col("last_heartbeat_at") < cutoff)
    if from_statuses:
        hit = hit & F.col("status").isin(*from_statuses)
    hit = F.coalesce(hit, F.lit(False))
    marked = target.withColumn("status", F.when(hit, stale_status).otherwise(F.col("status")))
    return marked, target.agg(F.count_if(hit).alias("affected"))


def revoke(keys: DataFrame, requests: DataFrame) -> DataFrame:
    """Deactivate keys on request, but only those that belong to the requesting user."""
    wanted = requests.select("key_id", "user_id").distinct().withColumn("revoked", F.lit(True))
    return (
        keys.join(wanted, ["key_id", "user_id"], "left")
        .withColumn("is_active", F.col("is_active") & F.col("revoked").isNull())
        .drop("revoked")
    )


def conform(df: DataFrame, columns: tuple[tuple[str, str, object], ...] = CATALOG_ADDED_COLUMNS) -> DataFrame:
    """Add missing columns with their defaults; present ones are kept as they are."""
    return df.select(
        "*",
        *[F.lit(default).cast(kind).alias(name) for name, kind, default in columns if name not in df.columns],
    )


# --- key/value context with expiry, kept as an event log ---------------------------------------
#
# ops: (seq, key, op in set|append|delete, value_json, owner, ttl_s, ts_ms)


def expires_ms() -> Column:
    return F.when(F.col("ttl_s").isNotNull(), F.col("ts_ms") + F.col("ttl_s") * 1000)


def context_entries(ops: DataFrame, now_ms: Column) -> DataFrame:
    """Live entry per key: its owner, creation time, expiry and what kind of value it holds.

    The newest operation decides owner and expiry, as every write renews them.
    """
    newest = ops.groupBy("key").agg(
        F.max_by(F.struct("op", "value_json", "owner", "ts_ms", expires_ms().alias("expires_ms")), F.struct("ts_ms", "seq")).alias("n")
    )
    return newest.select("key", "n.*").filter(
        (F.col("op") != "delete") & (F.col("expires_ms").isNull() | (F.col("expires_ms") > now_ms))
    ).select(
        "key",
        F.col("op").alias("kind"),
        F.when(F.col("op") == "set", F.col("value_json")).alias("value_json"),
        "owner",
        F.col("ts_ms").alias("created_ms"),
        "expires_ms",
    )


CONTEXT_CHUNK_MS = 86_400_000


def _with_previous_expiry(ops: DataFrame, chunk_ms: int) -> DataFrame:
    """Operations with the expiry that the one before them (same key) had set: null for none, or after a delete.

    Keys are cut into chunks of time: a chunk looks back inside itself, and its first operation gets the last expiry
    of the key's previous chunk, so a busy key is spread over as many tasks as it has chunks.
    """
    at, renewed = ["ts_ms", "seq"], F.when(F.col("op") != "delete", expires_ms())
    cut = ops.withColumns({"chunk": F.floor(F.col("ts_ms") / chunk_ms), "expires": renewed})
    inside = W.partitionBy("key", "chunk").orderBy(*at)
    last = cut.groupBy("key", "chunk").agg(F.max_by("expires", F.struct(*at)).alias("last"))
    before = last.select("key", "chunk", F.lag("last").over(W.partitionBy("key").orderBy("chunk")).alias("carried"))
    return (
        cut.withColumns({"place": F.row_number().over(inside), "inside": F.lag("expires").over(inside)})
        .join(before, ["key", "chunk"])
        .withColumn("previous_expiry", F.when(F.col("place") == 1, F.col("carried")).otherwise(F.col("inside")))
        .drop("chunk", "expires", "place", "inside", "carried")
    )


def context_elements(ops: DataFrame, now_ms: Column, chunk_ms: int = CONTEXT_CHUNK_MS) -> DataFrame:
    """List entries as rows (key, ts_ms, seq, pos, value_json), ready to be ordered by (ts_ms, seq, pos).

    A list starts with the elements of the newest set value, if that is a list, or empty after a delete, or with the
    first append after the key had expired; every later append adds one. Elements stay rows, so a list may grow
    without bound and no task has to hold it.
    """
    seen = _with_previous_expiry(ops, chunk_ms)
    expired = F.coalesce(F.col("previous_expiry") <= F.col("ts_ms"), F.lit(False))
    starts = (
        seen.filter(F.col("op").isin("set", "delete") | expired)
        .groupBy("key")
        .agg(F.max(F.struct("ts_ms", "seq", "op", "value_json")).alias("start"))
    )
    live = context_entries(ops, now_ms).filter(F.col("kind") == "append").select("key")
    here, start = F.struct("ts_ms", "seq"), F.struct("start.ts_ms", "start.seq")
    appended = (
        ops.filter(F.col("op") == "append")
        .join(starts, "key", "left")
        .filter(F.col("start").isNull() | (here > start) | ((here == start) & (F.col("start.op") == "append")))
        .select("key", "ts_ms", "seq", F.lit(0).alias("pos"), "value_json")
    )
    items = F.try_variant_get(F.try_parse_json("start.value_json"), "$", "array<variant>")
    initial = (
        starts.filter(F.col("start.op") == "set")
        .select("key", "start.ts_ms", "start.seq", F.posexplode(items).alias("pos", "item"))
        .select("key", "ts_ms", "seq", "pos", F.to_json("item").alias("value_json"))
    )
    return appended.unionByName(initial).join(live, "key", "left_semi")


def context_exists(ops: DataFrame, now_ms: Column) -> DataFrame:
    """(key, present) for every key that was ever written."""
    live = context_entries(ops, now_ms).select("key", F.lit(True).alias("present"))
    return ops.select("key").distinct().join(live, "key", "left").select("key", F.coalesce("present", F.lit(False)).alias("present"))


def context_info(ops: DataFrame, now_ms: Column) -> DataFrame:
    """(key, created_ms, owner, expires_ms) of the live entries, as the store's own notes have them."""
    return context_entries(ops, now_ms).select("key", "created_ms", "owner", "expires_ms")


def context_keys(ops: DataFrame, now_ms: Column, like: str | None = None) -> DataFrame:
    live = context_entries(ops, now_ms).select("key")
    return live if like is None else live.filter(F.col("key").like(like))


def thread_append(threads: DataFrame, messages: DataFrame) -> DataFrame:
    """Threads are rows ordered by (conv_id, timestamp, seq); appending adds rows."""
    return threads.unionByName(messages, allowMissingColumns=True)
