"""How the given tables stand in for ticks, news, messages, catalogs and trials.

Every function has a SQL twin of the same name in capitals, used by the check queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.sentiment import Lexicon
from tidewater.session import table

NOW_MS = 1_706_745_600_000  # 2024-02-01 00:00:00 UTC, the fixed "now" of the registered queries
DAY_MS = 86_400_000


def ticks(spark: SparkSession, sf_dir: str, symbol: str = "event_type") -> DataFrame:
    """events as ticks: close = value, volume = props.k, epoch-ms timestamp."""
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    name = F.col("event_type") if symbol == "event_type" else F.concat(F.lit("U"), F.col("user_id").cast("string"))
    return e.select(
        name.alias("symbol"),
        F.col("value").alias("close"),
        F.get_json_object("props", "$.k").cast("double").alias("volume"),
        F.unix_millis(ts).alias("timestamp"),
        F.col("event_id").alias("id"),
        ts.alias("ts"),
    )


TICKS = """ticks AS (
  SELECT event_type AS symbol, value AS close, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume,
         epoch_us(ts) // 1000 AS "timestamp", event_id AS id, ts
  FROM events)"""

USER_TICKS = """ticks AS (
  SELECT 'U' || CAST(user_id AS VARCHAR) AS symbol, value AS close,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume,
         epoch_us(ts) // 1000 AS "timestamp", event_id AS id, ts
  FROM events)"""

# Common words stand in for the market words, which the given texts do not contain.
COMMON_WORDS = Lexicon(
    positive=("that", "is", "the", "la", "die", "los"),
    negative=("for", "of", "and", "le", "und", "de"),
    digits=2,
)


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts as headlines; symbol U0..U99 from the document id."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("U"), F.pmod("doc_id", F.lit(100)).cast("string")).alias("symbol"),
        F.col("doc_id").alias("ordinal"),
        F.col("text").alias("headline"),
        "source",
    )


HEADLINES = """headlines AS (
  SELECT 'U' || CAST(doc_id % 100 AS VARCHAR) AS symbol, doc_id AS ordinal,
         text AS headline, source
  FROM documents)"""


def _sql_list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def net_hits_sql(text: str, positive: tuple[str, ...], negative: tuple[str, ...], punctuation: bool = False) -> str:
    lowered = f"lower({text})"
    if punctuation:
        lowered = f"translate({lowered}, '.,', '  ')"
    words = f"list_distinct(string_split_regex({lowered}, '\\s+'))"
    return (
        f"(len(list_intersect({words}, {_sql_list(positive)})) - len(list_intersect({words}, {_sql_list(negative)})))"
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers as catalog entries with states derived from their keys."""
    k = F.col("c_custkey")
    pick = lambda mod, *values: F.element_at(
        F.array(*[F.lit(v) for v in values]), (F.pmod(k, F.lit(mod)) + 1).cast("int")
    )
    return table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"),
        k.alias("id"),
        F.when(F.pmod(k, F.lit(4)) != 0, F.col("c_mktsegment")).alias("class_name"),
        F.concat(F.lit("cap"), F.pmod(k, F.lit(10)).cast("string")).alias("capabilities"),
        F.when(F.pmod(k, F.lit(5)) != 0, "serve").otherwise("external").alias("runtime_source"),
        (F.pmod(k, F.lit(7)) != 0).alias("is_enabled"),
        (F.pmod(k, F.lit(9)) != 0).alias("managed"),
        F.when(F.pmod(k, F.lit(11)) == 0, "stopped").otherwise("running").alias("desired_status"),
        pick(7, "ready", "degraded", "recovering", "missing", "offline", "stale", "unknown").alias("observed_status"),
        pick(4, "healthy", "degraded", "offline", "unknown").alias("health_status"),
        F.when(F.pmod(k, F.lit(6)) < 3, "recovering").otherwise("idle").alias("recovery_state"),
        F.when(F.pmod(k, F.lit(3)) != 1, "respawn").alias("last_action_type"),
        F.when(F.pmod(k, F.lit(5)) == 2, F.concat(F.lit("reason "), k.cast("string"))).alias("last_failure_reason"),
        (F.lit(NOW_MS) - F.pmod(k, F.lit(120)) * 1000).alias("last_reconciled_ms"),
        pick(4, "alive", "stale", "offline", "unknown").alias("status"),
        (F.pmod(k, F.lit(2)) == 0).alias("alive"),
        F.when(F.pmod(k, F.lit(13)) != 0, F.lit(NOW_MS) - k * 1000).alias("registered_at"),
        F.when(F.pmod(k, F.lit(8)) != 0, F.lit(NOW_MS) - F.pmod(k, F.lit(1000)) * 1000).alias("last_heartbeat_at"),
        F.concat(F.lit("/"), F.col("c_name")).alias("route_prefix"),
    )


CATALOG = f"""catalog AS (
  SELECT c_name AS name, c_custkey AS id,
         CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS class_name,
         'cap' || CAST(c_custkey % 10 AS VARCHAR) AS capabilities,
         CASE WHEN c_custkey % 5 <> 0 THEN 'serve' ELSE 'external' END AS runtime_source,
         c_custkey % 7 <> 0 AS is_enabled,
         c_custkey % 9 <> 0 AS managed,
         CASE WHEN c_custkey % 11 = 0 THEN 'stopped' ELSE 'running' END AS desired_status,
         (['ready', 'degraded', 'recovering', 'missing', 'offline', 'stale', 'unknown'])[CAST(c_custkey % 7 AS INT) + 1]
           AS observed_status,
         (['healthy', 'degraded', 'offline', 'unknown'])[CAST(c_custkey % 4 AS INT) + 1] AS health_status,
         CASE WHEN c_custkey % 6 < 3 THEN 'recovering' ELSE 'idle' END AS recovery_state,
         CASE WHEN c_custkey % 3 <> 1 THEN 'respawn' END AS last_action_type,
         CASE WHEN c_custkey % 5 = 2 THEN 'reason ' || CAST(c_custkey AS VARCHAR) END AS last_failure_reason,
         {NOW_MS} - (c_custkey % 120) * 1000 AS last_reconciled_ms,
         (['alive', 'stale', 'offline', 'unknown'])[CAST(c_custkey % 4 AS INT) + 1] AS status,
         c_custkey % 2 = 0 AS alive,
         CASE WHEN c_custkey % 13 <> 0 THEN {NOW_MS} - c_custkey * 1000 END AS registered_at,
         CASE WHEN c_custkey % 8 <> 0 THEN {NOW_MS} - (c_custkey % 1000) * 1000 END AS last_heartbeat_at,
         '/' || c_name AS route_prefix
  FROM customer)"""


def runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live side: customers with at least three open orders, and all suppliers, which no catalog knows."""
    orders = table(spark, sf_dir, "orders")
    k = F.col("o_custkey")
    known = (
        orders.groupBy(k.alias("k"))
        .agg(F.count_if(F.col("o_orderstatus") == "O").alias("open_orders"))
        .filter(F.col("open_orders") >= 3)
        .join(table(spark, sf_dir, "customer"), F.col("k") == F.col("c_custkey"))
        .select(
            F.col("c_name").alias("name"),
            F.when(F.pmod("k", F.lit(2)) == 0, F.concat(F.lit("Live"), F.col("c_mktsegment"))).alias("class_name"),
            F.when(F.pmod("k", F.lit(3)) == 0, F.lit("live-cap")).alias("capabilities"),
            (F.col("open_orders") > 4).alias("alive"),
            F.lit("serve").alias("runtime_source"),
            F.lit(None).cast("string").alias("route_prefix"),
            (F.lit(NOW_MS) - F.col("open_orders")).alias("last_seen_at"),
        )
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"),
        F.lit("Supplier").alias("class_name"),
        F.lit("supply").alias("capabilities"),
        (F.col("s_acctbal") > 0).alias("alive"),
        F.lit("serve").alias("runtime_source"),
        F.lit(None).cast("string").alias("route_prefix"),
        F.lit(None).cast("bigint").alias("last_seen_at"),
    )
    return known.unionByName(suppliers)


RUNTIME = f"""runtime AS (
  SELECT c.c_name AS name, CASE WHEN o.k % 2 = 0 THEN 'Live' || c.c_mktsegment END AS class_name,
         CASE WHEN o.k % 3 = 0 THEN 'live-cap' END AS capabilities, o.open_orders > 4 AS alive,
         'serve' AS runtime_source, CAST(NULL AS VARCHAR) AS route_prefix, {NOW_MS} - o.open_orders AS last_seen_at
  FROM (SELECT o_custkey AS k, count(*) FILTER (WHERE o_orderstatus = 'O') AS open_orders
        FROM orders GROUP BY 1 HAVING open_orders >= 3) o JOIN customer c ON c.c_custkey = o.k
  UNION ALL
  SELECT s_name, 'Supplier', 'supply', s_acctbal > 0, 'serve', NULL, NULL FROM supplier)"""


def replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a replica of its customer's application; its status gives the replica state."""
    state = F.when(F.col("o_orderstatus") == "O", "RUNNING").when(F.col("o_orderstatus") == "P", "STARTING").otherwise("DEAD")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("app"), F.col("o_custkey").cast("string")).alias("name"),
        F.col("o_custkey").alias("custkey"),
        state.alias("state"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderkey").alias("id"),
    )


REPLICAS = """replicas AS (
  SELECT 'app' || CAST(o_custkey AS VARCHAR) AS name, o_custkey AS custkey,
         CASE o_orderstatus WHEN 'O' THEN 'RUNNING' WHEN 'P' THEN 'STARTING' ELSE 'DEAD' END AS state,
         o_orderpriority AS priority, o_orderkey AS id
  FROM orders)"""


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One application per customer with orders: reported status by key, deployment states by priority."""
    token = F.element_at(
        F.array(*[F.lit(s) for s in APP_STATUSES]), (F.pmod("custkey", F.lit(len(APP_STATUSES))) + 1).cast("int")
    )
    states = F.when(F.col("priority") == "1-URGENT", "UPDATING").when(
        (F.col("priority") == "2-HIGH") & (F.pmod("custkey", F.lit(3)) == 0), "UNHEALTHY"
    ).otherwise("RUNNING")
    return (
        replicas(spark, sf_dir)
        .groupBy("name", "custkey")
        .agg(
            F.count_if(F.col("state") == "RUNNING").alias("running"),
            F.count_if(F.col("state") == "STARTING").alias("unhealthy"),
            F.collect_set(states).alias("deployment_states"),
        )
        .select("name", token.alias("app_status"), "deployment_states", "running", "unhealthy")
    )


APP_STATUSES = ("RUNNING", "DEPLOYING", "", "DELETING", "UNHEALTHY", "HEALTHY", "NOT_STARTED")
APPLICATIONS = """applications AS (
  SELECT name, (['RUNNING', 'DEPLOYING', '', 'DELETING', 'UNHEALTHY', 'HEALTHY', 'NOT_STARTED'])[CAST(custkey % 7 AS INT) + 1]
           AS app_status,
         list(DISTINCT CASE WHEN priority = '1-URGENT' THEN 'UPDATING'
                            WHEN priority = '2-HIGH' AND custkey % 3 = 0 THEN 'UNHEALTHY' ELSE 'RUNNING' END)
           AS deployment_states,
         count(*) FILTER (WHERE state = 'RUNNING') AS running,
         count(*) FILTER (WHERE state = 'STARTING') AS unhealthy
  FROM replicas GROUP BY name, custkey)"""

SYSTEMS = ("sequential", "spark_glue", "integrated")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitems as benchmark trials: system by key, durations from quantity, price, discount and tax."""
    k = F.col("l_orderkey")
    system = F.element_at(F.array(*[F.lit(s) for s in SYSTEMS]), (F.pmod(k, F.lit(3)) + 1).cast("int"))
    mode = (
        F.when(F.col("l_returnflag") == "A", "fully_live")
        .when(F.col("l_returnflag") == "N", "partial_fallback")
        .otherwise("fully_fallback")
    )
    return table(spark, sf_dir, "lineitem").select(
        k.alias("trial"),
        system.alias("system_name"),
        (F.col("l_linenumber") != 7).alias("success"),
        (F.col("l_quantity") + F.col("l_extendedprice") / 1000).alias("total_duration_seconds"),
        F.col("l_quantity").alias("ingest_duration_seconds"),
        F.col("l_discount").alias("agent_setup_duration_seconds"),
        (F.col("l_extendedprice") / 1000).alias("signal_duration_seconds"),
        F.col("l_tax").alias("persistence_duration_seconds"),
        (F.col("l_linenumber") / 10.0).alias("visibility_duration_seconds"),
        F.when(F.col("l_linenumber") == 7, "failed").otherwise(mode).alias("mode_classification"),
    )


TRIALS = """trials AS (
  SELECT l_orderkey AS trial,
         (['sequential', 'spark_glue', 'integrated'])[CAST(l_orderkey % 3 AS INT) + 1] AS system_name,
         l_linenumber <> 7 AS success,
         l_quantity + l_extendedprice / 1000 AS total, l_quantity AS ingest, l_discount AS agent_setup,
         l_extendedprice / 1000 AS signal, l_tax AS persistence, l_linenumber / 10.0::DOUBLE AS visibility,
         CASE WHEN l_linenumber = 7 THEN 'failed' WHEN l_returnflag = 'A' THEN 'fully_live'
              WHEN l_returnflag = 'N' THEN 'partial_fallback' ELSE 'fully_fallback' END AS mode
  FROM lineitem),
stage_rows AS (
  SELECT trial, system_name, mode, stage, seconds FROM trials
  UNPIVOT (seconds FOR stage IN (total, ingest, agent_setup, signal, persistence, visibility)) WHERE success)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as broker messages: key = user, value = a JSON payload in one of four shapes, or broken bytes."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    flat = F.to_json(F.struct(F.lit("trade").alias("e"), F.col("event_type").alias("s"),
                              F.col("value").cast("string").alias("p"), k.alias("q"), F.col("event_id").alias("T")))
    nested = F.to_json(F.struct(F.struct(F.col("event_type").alias("s"), F.col("value").alias("p"),
                                         k.cast("int").alias("q"), F.col("event_id").alias("T")).alias("data")))
    generic = F.to_json(F.struct(F.col("event_type").alias("symbol"), F.lit(0).alias("price"),
                                 F.col("value").alias("p"), k.cast("int").alias("volume"), F.col("event_id").alias("timestamp")))
    text = (
        F.when(F.pmod("event_id", F.lit(5)) == 0, flat)
        .when(F.pmod("event_id", F.lit(5)) == 1, nested)
        .when(F.pmod("event_id", F.lit(5)) == 2, generic)
        .when(F.pmod("event_id", F.lit(5)) == 3, F.concat(F.lit("not json "), F.col("event_type")))
        .otherwise(F.lit("[1, 2]"))
    )
    return e.select(
        F.when(F.pmod("event_id", F.lit(4)) != 0, F.col("user_id").cast("string").cast("binary")).alias("key"),
        text.cast("binary").alias("value"),
        F.lit("events").alias("topic"),
        F.pmod("user_id", F.lit(3)).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
        F.when(F.pmod("event_id", F.lit(6)) == 0, -1).otherwise(0).alias("timestampType"),
    )
