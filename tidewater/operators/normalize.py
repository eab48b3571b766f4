"""Turning raw payloads into typed ticks, news rows and flattened messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.numeric import first_truthy_text

# List keys of wrapped payloads, and symbol suffixes.
ROW_LIST_KEYS = ("results", "data", "items")
NEWS_LIST_KEYS = ("news", "data", "results", "items")
HEADLINE_KEYS = ("headline", "title", "text", "summary")
DATE_KEYS = ("publishedDate", "published_at", "datetime", "date")
SOURCE_KEYS = ("site", "source", "publisher")
URL_KEYS = ("url", "link")
CRYPTO_SUFFIXES = ("USD", "USDT", "USDC", "BTC", "ETH")
DEFAULT_SYMBOL = "BTCUSDT"


def _text(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def is_object(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))


def _fields(record: Column) -> Column:
    """Map of a JSON object's fields to (text, kept): ``kept`` is the text unless it is null, '', zero or false.

    ``kept`` gives ``or`` chains their meaning: a quoted "0" counts, the number 0 does not.
    """

    def field(_, item: Column) -> Column:
        text = F.try_variant_get(item, "$", "string")
        is_text = F.schema_of_variant(item) == "STRING"
        zero = F.coalesce(F.try_variant_get(item, "$", "double") == 0, text == "false")
        return F.struct(text.alias("text"), F.when((text != "") & (is_text | ~zero), text).alias("kept"))

    return F.transform_values(record, field)


def _as_fields(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def _first_kept(fields: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[fields[k]["kept"] for k in keys])


def _bind(value: Column, body) -> Column:
    """Array of one element: ``body`` applied to ``value``, which is evaluated once."""
    return F.transform(value, body)


def normalize_ticks(
    messages: DataFrame,
    payload: str = "payload",
    default_symbol: str = DEFAULT_SYMBOL,
    now_ms: Column | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Typed ticks from JSON payloads of three shapes: flat trade, nested trade, generic record.

    Rows without a price are dropped. ``valid`` is false where price, volume or
    time cannot be read as numbers; route those rows to the dead-letter table.
    """
    now_ms = F.unix_millis(F.current_timestamp()) if now_ms is None else now_ms
    # keys differ by case only (e/E, t/T), so the record is a map, not a struct; quoted zeros count, numbers do not
    keys = [F.col(k) for k in dict.fromkeys((*keep, payload))]
    parsed = messages.select(*keys, F.try_parse_json(payload).alias("v"))
    top = parsed.select(*keys, _fields(_as_fields(F.col("v"))).alias("top"), F.try_variant_get("v", "$.data", "variant").alias("inner"))
    fields = top.select(*keys, "top", _fields(_as_fields(F.col("inner"))).alias("data"))
    t, d = F.col("top"), F.col("data")

    def by_shape(flat: Column, nested: Column, generic: Column) -> Column:
        return F.when(t["e"]["text"] == "trade", flat).when(F.size(F.map_keys(d)) > 0, nested).otherwise(generic)

    # the last alternative of an ``or`` chain counts even when it is zero
    price = by_shape(t["p"]["text"], d["p"]["text"], F.coalesce(_first_kept(t, ("price", "p")), t["close"]["text"]))
    trade = F.struct(
        price.alias("price"),
        by_shape(t["q"]["text"], d["q"]["text"], F.coalesce(_first_kept(t, ("volume", "q")), t["v"]["text"])).alias("amount"),
        by_shape(
            F.coalesce(t["T"]["kept"], t["E"]["text"]),
            F.coalesce(d["T"]["kept"], d["E"]["text"]),
            F.coalesce(_first_kept(t, ("timestamp", "T")), now_ms.cast("string")),
        ).alias("at"),
        F.upper(
            F.coalesce(
                by_shape(t["s"]["kept"], d["s"]["kept"], _first_kept(t, ("symbol", "s"))),
                F.lit(default_symbol),
            )
        ).alias("symbol"),
    )
    # exploding a list of one or none drops rows without parsing the payload twice
    found = F.when(t.isNotNull(), F.filter(F.array(trade), lambda r: r["price"].isNotNull()))
    rows = fields.select(*keep, F.explode(found).alias("t")).select(*keep, "t.*")

    amount = F.nullif("amount", F.lit(""))
    close, volume = F.col("price").try_cast("double"), amount.try_cast("double")
    at = F.floor(F.col("at").try_cast("double")).cast("bigint")
    return rows.select(
        *keep,
        "symbol",
        close.alias("close"),
        F.when(amount.isNull(), 0.0).otherwise(volume).alias("volume"),
        at.alias("timestamp"),
        F.lit("live_stream").alias("provider"),
        (close.isNotNull() & at.isNotNull() & (amount.isNull() | volume.isNotNull())).alias("valid"),
    )


def unwrap_rows(messages: DataFrame, payload: str = "payload", list_keys: tuple[str, ...] = ROW_LIST_KEYS) -> DataFrame:
    """One row per record of a payload: a list, the first list under a known key, or the object itself.

    Adds ``ordinal`` and ``record`` (variant); scalar payloads give nothing.
    """
    v = F.col("v")
    records = F.coalesce(
        F.try_variant_get(v, "$", "array<variant>"),
        *[F.try_variant_get(v, f"$.{k}", "array<variant>") for k in list_keys],
        F.when(is_object(v), F.array(v)),
    )
    parsed = messages.withColumn("v", F.try_parse_json(payload))
    return parsed.select(
        *messages.columns, F.posexplode(records).alias("ordinal", "record")
    )


def normalize_news(
    messages: DataFrame, payload: str = "payload", provider: str = "live", now_s: Column | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """News rows from wrapped payloads; records without any headline text are dropped.

    Input columns: ``symbol`` and the payload. The per-symbol cap is ``market.first_rows``.
    """
    now_s = F.unix_timestamp() if now_s is None else now_s

    def read_item(fields: Column) -> Column:
        return F.struct(
            F.trim(_first_kept(fields, HEADLINE_KEYS)).alias("headline"),
            F.coalesce(_first_kept(fields, SOURCE_KEYS), F.lit(provider)).alias("source"),
            F.coalesce(_first_kept(fields, URL_KEYS), F.lit("")).alias("url"),
            F.coalesce(_first_kept(fields, DATE_KEYS), now_s.cast("string")).alias("published_at"),
        )

    records = unwrap_rows(messages, payload, NEWS_LIST_KEYS)
    fields = F.filter(F.array(_as_fields(F.col("record"))), lambda m: m.isNotNull())
    items = F.filter(_bind(_bind(fields, _fields), read_item), lambda i: i["headline"].isNotNull())
    return records.select(*keep, "symbol", "ordinal", F.explode(items).alias("i")).select(
        *keep, "symbol", "ordinal", "i.headline", "i.source", "i.url", "i.published_at", F.lit(provider).alias("provider")
    )


def symbol_candidates(symbol: Column, default_symbol: str = DEFAULT_SYMBOL) -> Column:
    """Spellings to try for a symbol, in order and without repeats."""
    s = first_truthy_text(F.upper(F.trim(symbol)), F.lit(default_symbol))
    none = F.array().cast("array<string>")
    usd_base = F.left(s, F.length(s) - 3)
    usdt_base = F.left(s, F.length(s) - 4)
    usd = F.when(
        F.endswith(s, F.lit("USD")),
        F.array(F.concat(s, F.lit("T")), usd_base, F.concat(usd_base, F.lit("-USD"))),
    ).otherwise(none)
    usdt = F.when(
        F.endswith(s, F.lit("USDT")), F.array(usdt_base, F.concat(usdt_base, F.lit("USD")))
    ).otherwise(none)
    cleaned = F.transform(F.concat(F.array(s), usd, usdt), lambda c: F.upper(F.trim(c)))
    return F.array_distinct(F.filter(cleaned, lambda c: c != ""))


def is_crypto(symbol: Column) -> Column:
    return F.upper(F.trim(symbol)).rlike(f"({'|'.join(CRYPTO_SUFFIXES)})$")


def handler_name(type_text: Column, topic: Column) -> Column:
    """handle_<type>, with dashes and dots as underscores; null when neither is given."""
    event = F.trim(first_truthy_text(type_text, topic))
    return F.when(event != "", F.concat(F.lit("handle_"), F.translate(event, "-.", "__")))


def minimum_id(df: DataFrame, min_id: int, column: str = "id") -> DataFrame:
    return df.filter(F.coalesce(column, F.lit(0)) >= min_id)


def title_length(df: DataFrame, column: str = "title") -> DataFrame:
    return df.withColumn("title_length", F.length(F.coalesce(column, F.lit(""))))


def trimmed_headlines(df: DataFrame, column: str = "headline") -> DataFrame:
    return df.withColumn(column, F.trim(column)).filter(F.col(column) != "")


def analyst_result(label: Column, score: Column, summary: Column) -> list[Column]:
    """label limited to the three known ones, score as a number in [-1, 1] or 0, summary trimmed."""
    lowered = F.lower(F.coalesce(label, F.lit("neutral")))
    number = F.coalesce(score.cast("string").try_cast("double"), F.lit(0.0))
    return [
        F.when(lowered.isin("bullish", "bearish", "neutral"), lowered).otherwise("neutral").alias("label"),
        F.greatest(F.least(number, F.lit(1.0)), F.lit(-1.0)).alias("score"),
        F.trim(F.coalesce(summary, F.lit(""))).alias("summary"),
    ]


def parsed_action(action: Column, confidence: Column) -> list[Column]:
    """BUY, SELL or HOLD (anything else is HOLD) and a confidence in [0, 1]."""
    upper = F.upper(F.coalesce(action, F.lit("HOLD")))
    number = F.coalesce(confidence.cast("string").try_cast("double"), F.lit(0.0))
    return [
        F.when(upper.isin("BUY", "SELL", "HOLD"), upper).otherwise("HOLD").alias("action"),
        F.greatest(F.least(number, F.lit(1.0)), F.lit(0.0)).alias("confidence"),
    ]


def application_rows(payloads: DataFrame, payload: str = "payload", key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(applications, replicas) from status payloads whose lists may be maps or arrays.

    applications: doc, entry_no, name, app_status, route_prefix, deployment_states; replicas: doc, entry_no, name,
    state, n. ``doc`` is the payload's ``key`` (without one, a hash of its text: equal payloads then count once) and
    ``entry_no`` the entry's place in it, so that payloads with the same application stay apart.
    """
    v = F.col("v")
    if key is None:
        payloads = payloads.select(F.xxhash64(payload).alias("doc"), payload).distinct()
    else:
        payloads = payloads.select(F.col(key).alias("doc"), payload)
    parsed = payloads.withColumn("v", F.try_parse_json(payload))
    node = F.coalesce(
        F.try_variant_get(v, "$.applications", "variant"),
        F.try_variant_get(v, "$.data.applications", "variant"),
        F.when(_text(v, "$.name").isNotNull(), F.parse_json(F.concat(F.lit("["), F.col(payload), F.lit("]")))),
    )
    own = ["doc", "entry_no", "name"]
    apps = _named_entries(parsed.select("doc", node.alias("node")), ["doc"])
    status = F.coalesce(_status_token(F.col("entry"), "status"), _status_token(F.col("entry"), "app_status"))
    apps = apps.select(
        "doc", "entry_no", F.col("entry_name").alias("name"),
        F.coalesce(status, F.lit("")).alias("app_status"),
        _text(F.col("entry"), "$.route_prefix").alias("route_prefix"),
        F.try_variant_get("entry", "$.deployments", "variant").alias("node"),
    )
    deployments = _named_entries(apps.select(*own, "node"), own, number="deployment_no").select(
        *own,
        F.coalesce(
            *[_status_token(F.col("entry"), k) for k in ("status", "deployment_status", "message", "state")], F.lit("")
        ).alias("state"),
        "entry",
    )
    # the states of one application in one payload, as many as it has deployments at most
    states = deployments.groupBy(*own).agg(F.sort_array(F.collect_set("state")).alias("deployment_states"))
    counted = deployments.select(
        *own,
        F.explode(
            F.coalesce(F.try_variant_get("entry", "$.replica_states", "map<string,int>"), F.create_map().cast("map<string,int>"))
        ).alias("state", "n"),
    )
    listed = deployments.select(
        *own, F.explode(F.try_variant_get("entry", "$.replicas", "array<variant>")).alias("r")
    ).select(
        *own, F.coalesce(_status_token(F.col("r"), "state"), _status_token(F.col("r"), "status")).alias("state"),
        F.lit(1).alias("n"),
    )
    replicas = (
        counted.unionByName(listed)
        .withColumn("state", F.upper(F.trim("state")))
        .filter(F.col("state") != "")
        .groupBy(*own, "state")
        .agg(F.sum("n").alias("n"))
    )
    return apps.drop("node").join(states, own, "left"), replicas


def _status_token(value: Column, key: str) -> Column:
    """Upper-cased status at ``key``; an object there is searched for its own status or state."""
    inner = F.try_variant_get(value, f"$.{key}", "variant")
    token = F.when(
        is_object(inner), F.coalesce(_text(value, f"$.{key}.status"), _text(value, f"$.{key}.state"))
    ).otherwise(_text(value, f"$.{key}"))
    return first_truthy_text(F.upper(F.trim(token)))


def _named_entries(df: DataFrame, keep: list[str], node: str = "node", number: str = "entry_no") -> DataFrame:
    """Entries of a map- or list-shaped variant with their place and name: own ``name`` first, then the map key."""
    as_map = F.try_variant_get(node, "$", "map<string,variant>")
    as_list = F.try_variant_get(node, "$", "array<variant>")
    from_map = F.transform(
        F.map_entries(as_map), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("entry"))
    )
    from_list = F.transform(as_list, lambda e: F.struct(F.lit("").alias("key"), e.alias("entry")))
    exploded = df.select(*keep, F.posexplode(F.coalesce(from_map, from_list)).alias(number, "e")).select(
        *keep, number, "e.key", "e.entry"
    )
    own = F.coalesce(
        first_truthy_text(_text(F.col("entry"), "$.name")),
        first_truthy_text(_text(F.col("entry"), "$.deployment_name")),
        F.col("key"),
    )
    return (
        exploded.filter(is_object(F.col("entry")))
        .withColumn("entry_name", F.trim(own))
        .filter(F.col("entry_name") != "")
        .select(*keep, number, "entry_name", "entry")
    )


def actor_rows(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Actor rows from both listing shapes: a map by id, or a result list."""
    v = F.col("v")
    parsed = payloads.withColumn("v", F.try_parse_json(payload))
    by_id = F.transform(
        F.map_entries(F.try_variant_get(v, "$.data.actors", "map<string,variant>")),
        lambda e: F.struct(e["key"].alias("key"), e["value"].alias("entry")),
    )
    in_list = F.transform(
        F.try_variant_get(v, "$.data.result.result", "array<variant>"),
        lambda e: F.struct(F.lit(None).cast("string").alias("key"), e.alias("entry")),
    )
    entry = F.col("a.entry")
    get = lambda *keys: F.coalesce(*[first_truthy_text(_text(entry, f"$.{k}")) for k in keys])
    name = F.coalesce(get("name"), F.lit("unknown"))
    return (
        parsed.select(F.explode(F.coalesce(by_id, in_list)).alias("a"))
        .filter(is_object(entry))
        .select(
            F.coalesce("a.key", get("actor_id"), F.lit("")).alias("actor_id"),
            name.alias("name"),
            F.coalesce(get("class_name", "className"), F.lit("unknown")).alias("class_name"),
            F.coalesce(get("state"), F.lit("UNKNOWN")).alias("state"),
            _text(entry, "$.pid").alias("pid"),
            replica_application(name).alias("app_name"),
        )
    )


def replica_application(actor_name: Column) -> Column:
    """Application a replica actor serves, from names of the form ServeReplica:<app>:<rest>; null for others."""
    return first_truthy_text(F.trim(F.regexp_extract(actor_name, r"^ServeReplica:([^:]*):", 1)))
