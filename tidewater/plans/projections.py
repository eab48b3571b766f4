"""Registered projections, filters, normalisers and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.api import is_safe_path
from tidewater.functions.numeric import clamp, rounded
from tidewater.operators import conversation, documents, listing, normalize, rules, trials
from tidewater.operators.fleet import is_alive, legacy_status, states_from_legacy
from tidewater.plans.inputs import CATALOG, NOW_MS, catalog, headlines, HEADLINES, messages
from tidewater.plans.registry import query, r
from tidewater.session import table
from tidewater.sinks.catalog import hadoop_location, plain_location
from tidewater.sources import candidates, envelope

MESSAGE_SQL = """m AS (
  SELECT event_id, event_type, user_id, value, CAST(json_extract_string(props, '$.k') AS INT) AS k, epoch_us(ts) // 1000 AS ms
  FROM events)"""


@query("p01_minimum_id", "SELECT doc_id, source FROM documents WHERE coalesce(CASE WHEN doc_id % 10 <> 0 THEN doc_id END, 0) >= 100")
def minimum_id(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 10 != 0, F.col("doc_id")).alias("id"))
    return normalize.minimum_id(d, 100).select("doc_id", "source")


@query(
    "p02_title_length",
    f"WITH {HEADLINES} SELECT ordinal, coalesce(length(CASE WHEN ordinal % 7 <> 0 THEN headline END), 0) AS title_length FROM headlines",
)
def title_length(spark, sf_dir):
    h = headlines(spark, sf_dir).select("ordinal", F.when(F.col("ordinal") % 7 != 0, F.col("headline")).alias("title"))
    return normalize.title_length(h).drop("title")


@query(
    "p03_normalized_ticks",
    f"""WITH {MESSAGE_SQL}
    SELECT event_id AS "offset", upper(event_type) AS symbol, value AS close, CAST(k AS DOUBLE) AS volume,
           event_id AS "timestamp", 'live_stream' AS provider
    FROM m WHERE (event_id % 5 IN (0, 1) OR event_id % 5 = 2 AND value <> 0) AND event_id <> 0""",
)
def normalized_ticks(spark, sf_dir):
    """Three payload shapes; broken text and arrays are dropped, as are a zero time and, in generic records, a zero price."""
    texts = messages(spark, sf_dir).select("offset", F.col("value").cast("string").alias("payload"))
    return normalize.normalize_ticks(texts, keep=("offset",), now_ms=F.lit(NOW_MS)).filter("valid").drop("valid")


@query(
    "p04_normalized_news",
    """SELECT doc_id, trim(text) AS headline, source, '' AS url,
         CASE WHEN doc_id % 4 = 0 THEN CAST(n_chars AS VARCHAR) ELSE '1706745600' END AS published_at, 'live' AS provider
       FROM documents WHERE text <> ''""",
)
def normalized_news(spark, sf_dir):
    """Four wrappings (news, data, results list and a bare record) and four headline keys."""
    d = table(spark, sf_dir, "documents")
    body = F.col("text")
    k = F.col("doc_id") % 4

    def record(name):
        return F.struct(F.lit("").alias("headline" if name != "headline" else "note"), body.alias(name), F.col("source"))

    payload = (
        F.when(k == 0, F.to_json(F.struct(F.array(F.struct(body.alias("headline"), "source", F.col("n_chars").alias("datetime"))).alias("news"))))
        .when(k == 1, F.to_json(F.struct(F.array(record("title")).alias("data"))))
        .when(k == 2, F.to_json(F.struct(F.array(record("text")).alias("results"))))
        .otherwise(F.to_json(record("summary")))
    )
    wrapped = d.select("doc_id", F.lit("U").alias("symbol"), payload.alias("payload"))
    return normalize.normalize_news(wrapped, keep=("doc_id",), now_s=F.lit(NOW_MS // 1000)).drop("symbol", "ordinal")


@query(
    "p05_flattened_messages",
    f"""WITH {MESSAGE_SQL}
    SELECT CASE WHEN event_id % 4 <> 0 THEN CAST(user_id AS VARCHAR) END AS kafka_key, 'events' AS kafka_topic,
      CAST(user_id % 3 AS INT) AS kafka_partition, event_id AS kafka_offset,
      CASE WHEN event_id % 6 <> 0 THEN ms END AS kafka_timestamp,
      CASE WHEN event_id % 5 = 0 THEN 'trade' END AS e, CASE WHEN event_id % 5 = 0 THEN event_type END AS s,
      CASE WHEN event_id % 5 = 2 THEN event_type END AS symbol, CASE WHEN event_id % 5 = 2 THEN k END AS volume
    FROM m WHERE event_id % 5 < 3""",
)
def flattened(spark, sf_dir):
    return envelope.flatten(messages(spark, sf_dir), "e string, s string, symbol string, volume int")


@query(
    "s12_decoded_messages",
    f"""WITH {MESSAGE_SQL}
    SELECT event_id AS "offset", CASE WHEN event_id % 4 <> 0 THEN CAST(user_id AS VARCHAR) END AS key,
      event_id % 5 <> 3 AS is_json,
      CASE WHEN event_id % 5 = 3 THEN 'not json ' || event_type END AS plain_text,
      CASE WHEN event_id % 6 <> 0 THEN ms END AS "timestamp"
    FROM m""",
)
def decoded(spark, sf_dir):
    d = envelope.decode(messages(spark, sf_dir))
    return d.select(
        "offset", "key", F.col("value_json").isNotNull().alias("is_json"),
        F.when(F.col("value_json").isNull(), F.col("value_text")).alias("plain_text"), "timestamp",
    )


@query(
    "s11_message_envelope",
    f"""WITH {MESSAGE_SQL}
    SELECT CASE WHEN event_id % 4 <> 0 THEN CAST(user_id AS VARCHAR) END AS key, 'events' AS topic, CAST(user_id % 3 AS INT) AS "partition",
           event_id AS "offset", CASE WHEN event_id % 6 <> 0 THEN ms END AS "timestamp", event_id % 5 <> 3 AS is_json FROM m""",
)
def envelope_rows(spark, sf_dir):
    """Every message as its decoded envelope: key text, place in the topic, time where it has one, whether it holds JSON."""
    return envelope.decode(messages(spark, sf_dir)).select(
        "key", "topic", "partition", "offset", "timestamp", F.col("value_json").isNotNull().alias("is_json")
    )


@query(
    "p14_application_rows",
    """SELECT o_orderkey AS doc, 'app' || CAST(o_custkey AS VARCHAR) AS name,
      CASE o_orderstatus WHEN 'F' THEN 'RUNNING' WHEN 'O' THEN 'DEPLOYING' ELSE 'DELETING' END AS app_status,
      CASE WHEN o_orderkey % 2 = 0 THEN '/' || CAST(o_custkey AS VARCHAR) END AS route_prefix,
      CASE WHEN o_orderkey % 2 = 0 THEN 'HEALTHY' ELSE 'UPDATING' END AS deployment_states,
      CASE WHEN o_orderkey % 2 = 0 THEN 'RUNNING:' || CAST(o_custkey % 4 AS VARCHAR) ELSE 'RUNNING:1,STARTING:1' END AS replicas FROM orders""",
)
def application_rows(spark, sf_dir):
    """Every order as a status payload of its customer's application, in map and list shape by turns: many payloads per application."""
    o = table(spark, sf_dir, "orders")
    customer = F.col("o_custkey").cast("string")
    status = F.when(F.col("o_orderstatus") == "F", "running").when(F.col("o_orderstatus") == "O", "Deploying").otherwise("DELETING")
    as_map = F.concat(
        F.lit('{"applications": {"app'), customer, F.lit('": {"status": "'), status, F.lit('", "route_prefix": "/'), customer,
        F.lit('", "deployments": {"d": {"status": "healthy", "replica_states": {"RUNNING": '), (F.col("o_custkey") % 4).cast("string"), F.lit("}}}}}}"),
    )
    as_list = F.concat(
        F.lit('{"data": {"applications": [{"name": "app'), customer, F.lit('", "app_status": "'), status,
        F.lit('", "deployments": [{"name": "d", "state": "updating", "replicas": [{"state": "starting"}, {"status": "Running"}]}]}]}}'),
    )
    payloads = o.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, as_map).otherwise(as_list).alias("payload"))
    apps, replicas = normalize.application_rows(payloads, key="o_orderkey")
    listed = replicas.groupBy("doc", "name").agg(
        F.array_join(F.sort_array(F.collect_list(F.concat("state", F.lit(":"), F.col("n").cast("string")))), ",").alias("replicas")
    )
    return apps.join(listed, ["doc", "name"], "left").select(
        "doc", "name", "app_status", "route_prefix", F.array_join("deployment_states", ",").alias("deployment_states"), "replicas"
    )


@query(
    "s15_unwrapped_rows",
    """WITH w AS (SELECT event_id, value, event_id % 6 AS shape FROM events)
    SELECT event_id, CAST(i AS INT) AS ordinal, event_id + i AS record_id FROM w, range(2) t(i)
    WHERE shape < 4 OR (shape = 4 AND i = 0)""",
)
def unwrapped(spark, sf_dir):
    """Lists under results, data and items, a bare list, a single object, and a scalar (no rows)."""
    e = table(spark, sf_dir, "events")
    shape = F.col("event_id") % 6
    pair = F.array(F.struct(F.col("event_id").alias("id")), F.struct((F.col("event_id") + 1).alias("id")))
    payload = (
        F.when(shape == 0, F.to_json(F.struct(pair.alias("results"))))
        .when(shape == 1, F.to_json(F.struct(F.lit("x").alias("results"), pair.alias("data"))))
        .when(shape == 2, F.to_json(F.struct(pair.alias("items"))))
        .when(shape == 3, F.to_json(pair))
        .when(shape == 4, F.to_json(F.struct(F.col("event_id").alias("id"))))
        .otherwise(F.lit("17"))
    )
    rows = normalize.unwrap_rows(e.select("event_id", payload.alias("payload")))
    return rows.select("event_id", "ordinal", F.try_variant_get("record", "$.id", "bigint").alias("record_id"))


CANDIDATE_INPUT = """syms AS (
  SELECT p_partkey, upper(p_type) || CASE p_size % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'USDT' WHEN 2 THEN 'BTC' ELSE '' END AS s FROM part)"""


def _part_symbols(spark, sf_dir):
    size = F.col("p_size") % 4
    tail = F.when(size == 0, "usd").when(size == 1, "USDT ").when(size == 2, "btc").otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lower("p_type"), tail).alias("symbol"))


@query(
    "p06_symbol_candidates",
    f"""WITH {CANDIDATE_INPUT}
    SELECT p_partkey, CAST(0 AS INT) AS candidate_rank, s AS candidate FROM syms
    UNION ALL SELECT p_partkey, 1, s || 'T' FROM syms WHERE s LIKE '%USD'
    UNION ALL SELECT p_partkey, 2, s[:-4] FROM syms WHERE s LIKE '%USD'
    UNION ALL SELECT p_partkey, 3, s[:-4] || '-USD' FROM syms WHERE s LIKE '%USD'
    UNION ALL SELECT p_partkey, 1, s[:-5] FROM syms WHERE s LIKE '%USDT'
    UNION ALL SELECT p_partkey, 2, s[:-5] || 'USD' FROM syms WHERE s LIKE '%USDT'""",
)
def symbol_candidates(spark, sf_dir):
    return _part_symbols(spark, sf_dir).select(
        "p_partkey", F.posexplode(normalize.symbol_candidates(F.col("symbol"))).alias("candidate_rank", "candidate")
    )


@query("p07_is_crypto", f"WITH {CANDIDATE_INPUT} SELECT p_partkey, s LIKE '%USD' OR s LIKE '%USDT' OR s LIKE '%BTC' OR s LIKE '%ETH' AS is_crypto FROM syms")
def is_crypto(spark, sf_dir):
    return _part_symbols(spark, sf_dir).select("p_partkey", normalize.is_crypto(F.col("symbol")).alias("is_crypto"))


@query("p08_trimmed_headlines", f"WITH {HEADLINES} SELECT ordinal, trim(headline) AS headline FROM headlines WHERE trim(headline) <> '' AND ordinal % 9 <> 0")
def trimmed(spark, sf_dir):
    h = headlines(spark, sf_dir).select(
        "ordinal", F.when(F.col("ordinal") % 9 == 0, F.lit("   ")).otherwise(F.concat(F.lit(" "), "headline", F.lit(" "))).alias("headline")
    )
    return normalize.trimmed_headlines(h)


@query(
    "p09_mode_class",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'failed'
         WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'fully_fallback'
         WHEN o_orderstatus = 'F' OR o_orderpriority = '1-URGENT' THEN 'partial_fallback' ELSE 'fully_live' END AS mode FROM orders""",
)
def mode_class(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey",
        trials.mode_class(F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey") % 10 != 0).alias("mode"),
    )


@query(
    "p11_trial_rows",
    """SELECT o_orderkey AS trial, o_orderstatus AS system_name, o_orderkey % 10 <> 0 AS success,
         CASE WHEN o_orderkey % 10 = 0 THEN 'boom' ELSE '' END AS error,
         CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice ELSE 0.0 END AS total_duration_seconds,
         CAST(0 AS DOUBLE) AS ingest_duration_seconds, CAST(0 AS DOUBLE) AS signal_duration_seconds,
         CASE WHEN o_orderkey % 2 = 0 THEN 'live' ELSE 'unknown' END AS news_mode,
         o_orderpriority = '1-URGENT' AS news_fallback_used,
         CASE WHEN o_orderkey % 10 = 0 THEN 'failed' WHEN o_orderpriority = '1-URGENT' THEN 'partial_fallback' ELSE 'fully_live' END
           AS mode_classification FROM orders""",
)
def trial_rows(spark, sf_dir):
    """Nested results; durations that are absent become 0.0."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    durations = ["shared_input_capture_duration_seconds", *trials.STAGES.values()]
    nested = o.select(
        key.alias("trial"), F.col("o_orderstatus").alias("system_name"), F.lit(True).alias("success"),
        F.when(key % 10 == 0, "boom").alias("error"), F.lit("events").alias("provider_requested"), F.lit("X").alias("symbol"),
        F.struct(
            F.when(key % 3 != 0, F.col("o_totalprice")).alias("total_duration_seconds"),
            *[F.lit(None).cast("double").alias(d) for d in durations if d != "total_duration_seconds"],
        ).alias("timings"),
        F.struct(F.when(key % 2 == 0, "live").alias("mode"), (F.col("o_orderpriority") == "1-URGENT").alias("fallback_used")).alias("news_meta"),
        F.struct(F.lit("live").alias("mode"), F.lit(None).cast("boolean").alias("fallback_used")).alias("price_meta"),
    )
    return trials.shape_trials(nested).select(
        "trial", "system_name", "success", "error", "total_duration_seconds", "ingest_duration_seconds",
        "signal_duration_seconds", "news_mode", "news_fallback_used", "mode_classification",
    )


@query(
    "p12_alert_rows",
    """SELECT o_orderkey AS id,
         CASE WHEN o_orderstatus = 'F' THEN 'error' WHEN o_orderkey % 5 IN (1, 3, 4) THEN 'warning' ELSE 'info' END AS level,
         CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'succeeded' END AS status,
         CASE WHEN o_orderkey % 2 = 0 THEN 'done' WHEN o_orderstatus = 'F' THEN 'broken' ELSE 'because' END AS detail,
         CASE WHEN o_orderkey % 3 = 0 THEN 'dep' ELSE 'runtime' END AS target FROM orders""",
)
def alert_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    names = F.array(*[F.lit(a) for a in ("scale_up", "respawn", "scale_down", "alert", "circuit_break")])
    actions = o.select(
        key.alias("id"), F.element_at(names, (key % 5 + 1).cast("int")).alias("action"), F.lit("because").alias("reason"),
        F.when(key % 3 == 0, "dep").otherwise("").alias("deployment_name"), F.lit("runtime").alias("target"),
        (F.col("o_orderstatus") != "F").alias("success"),
        F.when(key % 2 == 0, "done").otherwise("").alias("detail"), F.when(F.col("o_orderstatus") == "F", "broken").alias("error"),
    )
    return rules.alert_rows(actions).select("id", "level", "status", "detail", "target")


@query(
    "p15_latest_user_message",
    """SELECT conv_id, coalesce(arg_max(trim(text), turn) FILTER (WHERE role = 'user'), arg_max(text, turn)) AS message
       FROM conversations GROUP BY conv_id""",
)
def latest_user(spark, sf_dir):
    return conversation.latest_user_message(table(spark, sf_dir, "conversations"))


@query(
    "p16_legacy_status",
    f"""WITH {CATALOG}
    SELECT name, CASE WHEN observed_status IN ('ready', 'degraded', 'recovering') THEN 'alive' WHEN observed_status = 'stale' THEN 'stale'
        WHEN observed_status IN ('missing', 'offline') THEN 'offline' ELSE 'unknown' END AS legacy,
      CASE WHEN status = 'alive' THEN 'ready' ELSE status END AS new_observed,
      CASE status WHEN 'alive' THEN 'healthy' WHEN 'stale' THEN 'degraded' WHEN 'offline' THEN 'offline' ELSE health_status END AS new_health
    FROM catalog""",
)
def legacy(spark, sf_dir):
    observed, health = states_from_legacy(F.col("status"), F.col("health_status"))
    return catalog(spark, sf_dir).select(
        "name", legacy_status(F.col("observed_status")).alias("legacy"), observed.alias("new_observed"), health.alias("new_health")
    )


@query(
    "p17_alive_rule",
    f"""WITH {CATALOG} SELECT name, desired_status = 'running' AND observed_status IN ('ready', 'degraded', 'recovering')
      AND health_status <> 'offline' AS is_alive FROM catalog""",
)
def alive_rule(spark, sf_dir):
    return catalog(spark, sf_dir).select(
        "name", is_alive(F.col("desired_status"), F.col("observed_status"), F.col("health_status")).alias("is_alive")
    )


@query("p19_safe_paths", "SELECT page_id, length(url) <= 256 AND regexp_full_match(url, '[A-Za-z0-9_./:-]+') AS is_safe FROM pages")
def safe_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", is_safe_path(F.col("url")).alias("is_safe"))


@query(
    "p20_location_rewrite",
    """SELECT doc_id, 's3a://' || source || '/' || lang AS hadoop_location, 's3://' || source || '/' || lang AS plain_location FROM documents""",
)
def locations(spark, sf_dir):
    place = F.concat(F.when(F.col("doc_id") % 2 == 0, "s3://").otherwise("s3a://"), "source", F.lit("/"), "lang")
    return table(spark, sf_dir, "documents").select(
        "doc_id", hadoop_location(place).alias("hadoop_location"), plain_location(place).alias("plain_location")
    )


# --- scalar functions -------------------------------------------------------------------------------


@query(
    "f06_fenced_json",
    """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE event_type END AS action,
         CASE WHEN event_id % 4 = 3 THEN NULL ELSE value END AS confidence FROM events""",
)
def fenced(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    body = F.to_json(F.struct(F.col("event_type").alias("action"), F.col("value").alias("confidence")))
    kind = F.col("event_id") % 4
    text = (
        F.when(kind == 0, body)
        .when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("  ```\n"), body, F.lit("\n ``` \n")))
        .otherwise(F.concat(F.lit("Sorry: "), body))
    )
    parsed = documents.parse_response(text, "action string, confidence double")
    return e.select("event_id", parsed.alias("p")).select("event_id", "p.action", "p.confidence")


@query(
    "f08_json_round_trip",
    """SELECT event_id, CAST(coalesce(json_extract_string(props, '$.k')::INT, -1) AS INT) AS k,
         '{"event_type":"' || event_type || '","user_id":' || CAST(user_id AS VARCHAR) || '}' AS serialized FROM events WHERE event_id % 3 <> 0
       UNION ALL SELECT event_id, -1, '{"event_type":"' || event_type || '","user_id":' || CAST(user_id AS VARCHAR) || '}'
       FROM events WHERE event_id % 3 = 0""",
)
def json_round_trip(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.lit("{broken")).otherwise(F.col("props"))
    return e.select(
        "event_id", F.coalesce(F.from_json(text, "k int")["k"], F.lit(-1)).alias("k"),
        F.to_json(F.struct("event_type", "user_id")).alias("serialized"),
    )


@query(
    "f09_duration_bounds",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
      {NOW_MS} // 1000 - CASE l_linenumber % 5 WHEN 0 THEN 60 * CAST(l_quantity AS BIGINT) WHEN 1 THEN 3600 * CAST(l_quantity AS BIGINT)
        WHEN 2 THEN 86400 * CAST(l_quantity AS BIGINT) ELSE 3600 END AS since_s FROM lineitem""",
)
def duration_bounds(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    amount, n = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber") % 5
    text = (
        F.when(n == 0, F.concat(amount, F.lit("m"))).when(n == 1, F.concat(amount, F.lit("h")))
        .when(n == 2, F.concat(amount, F.lit("D"))).when(n == 3, F.lit("soon")).otherwise(F.concat(amount, F.lit("x")))
    )
    lower = listing.since_lower_bound(text, F.timestamp_millis(F.lit(NOW_MS)))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.unix_seconds(lower).alias("since_s"))


@query(
    "f10_time_conversions",
    """SELECT event_id, epoch_us(ts) // 1000 AS epoch_ms, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso,
       (epoch_us(ts) // 1000000) * 1000 AS parsed_ms FROM events""",
)
def time_conversions(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, sf_dir, "events").select(
        "event_id", F.unix_millis(ts).alias("epoch_ms"), iso.alias("iso"), F.unix_millis(F.to_timestamp(iso)).alias("parsed_ms")
    )


@query("f11_token_estimate", "SELECT conv_id, turn, length(text) // 4 AS tokens FROM conversations")
def tokens(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", conversation.token_estimate(F.col("text")).alias("tokens"))


@query(
    "f12_handler_name",
    """SELECT page_id, 'handle_' || replace(replace(CASE WHEN page_id % 3 = 0 THEN split_part(url, '/', 3) ELSE 'page.view-' || CAST(page_id AS VARCHAR) END, '-', '_'), '.', '_')
       AS handler FROM pages""",
)
def handlers(spark, sf_dir):
    host = F.split("url", "/")[2]
    kind = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("page.view-"), F.col("page_id").cast("string")))
    return table(spark, sf_dir, "pages").select("page_id", normalize.handler_name(kind, host).alias("handler"))


@query(
    "f13_clamp_and_round",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
        least(greatest(l_quantity / 20 - 1, -1.0), 1.0) AS clamped, {r('l_extendedprice / 7', 2)} AS two_digits FROM lineitem""",
)
def clamp_round(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        clamp(F.col("l_quantity") / 20 - 1).alias("clamped"), rounded(F.col("l_extendedprice") / 7, 2).alias("two_digits"),
    )


@query(
    "f14_document_metrics",
    r"""SELECT doc_id, length(text) AS char_count, len(string_split(text, chr(10))) AS line_count,
        len(list_filter(string_split_regex(text, '[ \n\t]+'), lambda x : x <> '')) AS word_count FROM documents""",
)
def metrics(spark, sf_dir):
    return documents.document_metrics(table(spark, sf_dir, "documents")).select("doc_id", "char_count", "line_count", "word_count")


PAGE_TEXT = r"""
WITH t AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'),
    '(?s)<[^>]*>', ' ', 'g') AS x FROM pages),
u AS (SELECT page_id, html, replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'),
    '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS x FROM t),
p AS (SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title,
    trim(regexp_replace(x, '[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS page_text
    FROM u)
SELECT *, length(page_text) AS text_length FROM p"""


@query("f14_page_text", PAGE_TEXT)
def page_text(spark, sf_dir):
    """Visible text of every page: tags, scripts and comments gone, entities decoded."""
    text = documents.html_to_text(F.col("html"))
    return table(spark, sf_dir, "pages").select(
        "page_id", documents.html_title(F.col("html")).alias("title"), text.alias("page_text"), F.length(text).alias("text_length")
    )


@query(
    "f15_embedded_json",
    """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE '{"id": ' || CAST(event_id AS VARCHAR) || ','
         || CASE WHEN event_id % 4 = 2 THEN '' ELSE chr(10) END || '"kind": "' || event_type || '"}' END AS payload FROM events""",
)
def embedded(spark, sf_dir):
    """Log text around a JSON object, with a misleading brace line before it now and then."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_id") % 4
    head, tail = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(",")), F.concat(F.lit('"kind": "'), "event_type", F.lit('"}'))
    text = (
        F.when(kind == 0, F.concat(F.lit("starting\n\n"), head, F.lit("\n"), tail))
        .when(kind == 1, F.concat(F.lit("{not json\nok\n"), head, F.lit("\n"), tail))
        .when(kind == 2, F.concat(head, tail))
        .otherwise(F.lit("no object here\n{broken"))
    )
    return documents.embedded_json(e.select("event_id", text.alias("stdout")), "event_id").select("event_id", "payload")


# --- candidate and fallback sources -------------------------------------------------------------------


@query(
    "s16_first_candidate",
    """WITH o AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS candidate_rank FROM orders)
    SELECT 'U' || CAST(o_custkey AS VARCHAR) AS symbol, o_orderkey, candidate_rank FROM o
    WHERE candidate_rank = (SELECT min(candidate_rank) FROM o i WHERE i.o_custkey = o.o_custkey)""",
)
def first_candidate(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    rows = o.select(F.concat(F.lit("U"), F.col("o_custkey").cast("string")).alias("symbol"), "o_orderkey", rank.alias("candidate_rank"))
    return candidates.first_candidate(rows).select("symbol", "o_orderkey", "candidate_rank")


def _fallback(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("symbol"))
    live = table(spark, sf_dir, "events").select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"), F.col("value").alias("close"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), F.col("event_id").alias("id"), F.lit("events").alias("provider"),
    )
    missing = customers.join(live, "symbol", "left_anti")
    spare = candidates.fallback_prices(missing, F.lit(NOW_MS)).drop("volume")
    return candidates.with_fallback(live, customers, spare, F.lit("no live rows"))


FALLBACK_SQL = f"""WITH wanted AS (SELECT 'U' || CAST(c_custkey AS VARCHAR) AS symbol FROM customer),
live AS (SELECT 'U' || CAST(user_id AS VARCHAR) AS symbol, value AS close, epoch_us(ts) // 1000 AS "timestamp", event_id AS id FROM events),
pattern AS (SELECT unnest([-120, -90, -60, -35, -20, -10, 0, 12, 25, 40, 55, 70, 82, 95, 105, 116, 128, 141, 155, 170, 185, 198, 212, 228, 245]) AS shift,
            unnest(range(25)) AS i),
filled AS (
  SELECT symbol, close, "timestamp", id, 'events' AS provider, 'live' AS mode, FALSE AS fallback_used, NULL AS source_error FROM live
  UNION ALL
  SELECT symbol, 68400.0::DOUBLE + shift, {NOW_MS} - (25 - i) * 60000, i, 'fallback', 'fallback', TRUE, 'no live rows'
  FROM wanted w, pattern WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.symbol = w.symbol))"""


@query("s17_fallback_rows", f"{FALLBACK_SQL} SELECT * FROM filled")
def fallback_rows(spark, sf_dir):
    return _fallback(spark, sf_dir).select("symbol", "close", "timestamp", "id", "provider", "mode", "fallback_used", "source_error")


@query("u03_live_and_fallback", f"{FALLBACK_SQL} SELECT mode, count(*) AS row_count, count(DISTINCT symbol) AS symbols FROM filled GROUP BY mode")
def live_and_fallback(spark, sf_dir):
    return _fallback(spark, sf_dir).groupBy("mode").agg(F.count(F.lit(1)).alias("row_count"), F.countDistinct("symbol").alias("symbols"))
