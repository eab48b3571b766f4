"""Registered market queries: last-N state, rolling metrics, windows, sentiment, fused signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.numeric import rounded
from tidewater.functions.sentiment import (
    HEADLINE_LEXICON, MESSAGE_LEXICON, Lexicon, found_words, with_sentiment,
)
from tidewater.operators import market as m
from tidewater.operators.normalize import analyst_result, parsed_action, trimmed_headlines
from tidewater.operators.rolling import moving_averages, rolling_state
from tidewater.plans.inputs import (
    COMMON_WORDS, HEADLINES, NOW_MS, TICKS, USER_TICKS, headlines, net_hits_sql, ticks,
)
from tidewater.plans.registry import query, r
from tidewater.session import table

def state_sql(mode: str, digits: int | None = 6) -> str:
    """State per symbol over ``numbered`` rows; ``digits`` of None leaves the numbers unrounded."""
    cut = (lambda e: e) if digits is None else (lambda e: r(e, digits))
    first = "max(close) FILTER (WHERE rn = n)"
    last = "max(close) FILTER (WHERE rn = 1)"
    ret = f"CASE WHEN {first} <> 0 THEN ({last} - {first}) / {first} * 100.0 END"
    s5, s20 = "avg(close) FILTER (WHERE rn <= 5)", "avg(close) FILTER (WHERE rn <= 20)"
    vol = "stddev_pop(close)"
    if mode == "strict":
        s5 = f"CASE WHEN count(*) >= 5 THEN {s5} END"
        s20 = f"CASE WHEN count(*) >= 20 THEN {s20} END"
    if mode != "zero_fill":
        vol = f"CASE WHEN count(*) >= 2 THEN {vol} END"
    trend = (
        f"CASE WHEN {s5} IS NOT NULL AND {s20} <> 0 THEN least(greatest(({s5} - {s20}) / {s20} * 50.0, -1.0), 1.0) "
        f"WHEN {ret} IS NOT NULL THEN least(greatest({ret} / 5.0, -1.0), 1.0) ELSE 0.0 END"
    )
    return f"""
  SELECT symbol, count(*) AS window_count, {cut(last)} AS last_price,
         {cut('avg(close)')} AS avg_price, {cut('avg(volume)')} AS avg_volume,
         {cut('min(close)')} AS min_price, {cut('max(close)')} AS max_price,
         {cut(ret)} AS price_return_pct, {cut(vol)} AS volatility_estimate,
         {cut('CASE WHEN sum(volume) > 0 THEN sum(close * volume) / sum(volume) END')} AS vwap,
         {cut(s5)} AS sma_5, {cut(s20)} AS sma_20, {cut(trend)} AS trend_score,
         max("timestamp") FILTER (WHERE rn = 1) AS last_tick_at
"""


LAST_25 = """last25 AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY "timestamp" DESC, id DESC) AS rn
  FROM ticks QUALIFY rn <= 25)"""
NUMBERED = "numbered AS (SELECT *, max(rn) OVER (PARTITION BY symbol) AS n FROM last25)"


@query("w01_last_n_ticks", f"WITH {TICKS}, {LAST_25} SELECT symbol, id, \"timestamp\", close, volume, rn FROM last25")
def last_n(spark, sf_dir):
    return m.newest_rows(ticks(spark, sf_dir), "symbol", ["timestamp", "id"]).select(
        "symbol", "id", "timestamp", "close", "volume", "rn"
    )


@query("g01_market_state_strict", f"WITH {USER_TICKS}, {LAST_25}, {NUMBERED} {state_sql('strict')} FROM numbered GROUP BY symbol")
def state_strict(spark, sf_dir):
    window = m.newest_rows(ticks(spark, sf_dir, "user_id"), "symbol", ["timestamp", "id"])
    return m.rounded_state(m.market_state(window, "strict"))


@query(
    "g02_market_state_lenient",
    f"""WITH {USER_TICKS}, {LAST_25},
    dirty AS (SELECT symbol, "timestamp", rn,
                     CASE WHEN id % 7 = 0 THEN NULL ELSE close END AS close,
                     CASE WHEN id % 5 = 0 THEN 0.0 ELSE volume END AS volume FROM last25),
    renumbered AS (SELECT symbol, "timestamp", close, volume,
                     row_number() OVER (PARTITION BY symbol ORDER BY rn) AS rn,
                     count(*) OVER (PARTITION BY symbol) AS n FROM dirty WHERE close IS NOT NULL)
    {state_sql('lenient')} FROM renumbered GROUP BY symbol""",
)
def state_lenient(spark, sf_dir):
    """Every seventh close is no number and every fifth volume is unreadable."""
    dirty = ticks(spark, sf_dir, "user_id").select(
        "symbol", "timestamp", "id",
        F.when(F.col("id") % 7 == 0, F.lit("n/a")).otherwise(F.col("close").cast("string")).alias("close"),
        F.when(F.col("id") % 5 == 0, F.lit("?")).otherwise(F.col("volume").cast("string")).alias("volume"),
    )
    window = m.newest_rows(dirty, "symbol", ["timestamp", "id"])
    return m.rounded_state(m.market_state(window, "lenient"))


@query(
    "g03_market_state_zero_fill",
    f"""WITH {USER_TICKS}, {LAST_25},
    filled AS (SELECT symbol, "timestamp", rn, CASE WHEN id % 7 = 0 THEN 0.0 ELSE close END AS close, volume FROM last25),
    numbered AS (SELECT *, max(rn) OVER (PARTITION BY symbol) AS n FROM filled)
    {state_sql('zero_fill')} FROM numbered GROUP BY symbol""",
)
def state_zero_fill(spark, sf_dir):
    holes = ticks(spark, sf_dir, "user_id").withColumn("close", F.when(F.col("id") % 7 != 0, F.col("close")))
    window = m.newest_rows(holes, "symbol", ["timestamp", "id"])
    return m.rounded_state(m.market_state(window, "zero_fill"))


@query(
    "g04_trend_score",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
        {r('''CASE WHEN l_linenumber > 2 AND l_discount <> 0
             THEN least(greatest((l_tax - l_discount) / l_discount * 50.0, -1.0), 1.0)
             WHEN l_linenumber > 1 THEN least(greatest((l_quantity - 25) / 5.0, -1.0), 1.0) ELSE 0.0 END''', 6)} AS trend_score
        FROM lineitem""",
)
def trend(spark, sf_dir):
    """Tax and discount as the two averages, quantity as the return; both missing on first lines."""
    li = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        rounded(
            m.trend_score(
                F.when(n > 2, F.col("l_tax")), F.when(n > 2, F.col("l_discount")), F.when(n > 1, F.col("l_quantity") - 25)
            ),
            6,
        ).alias("trend_score"),
    )


@query(
    "g05_keyed_window_counts",
    f"""WITH {TICKS}
    SELECT "timestamp" - "timestamp" % 10000 AS time, symbol, {r('avg(close)', 6)} AS avg_price, count(*) AS count
    FROM ticks WHERE symbol <> '' AND close IS NOT NULL GROUP BY 1, 2""",
)
def window_counts(spark, sf_dir):
    return m.rounded_state(
        m.keyed_window_counts(ticks(spark, sf_dir)).select(
            F.col("time").alias("timestamp"), "symbol", "avg_price", F.col("count").alias("window_count")
        )
    ).select(F.col("timestamp").alias("time"), "symbol", "avg_price", F.col("window_count").alias("count"))


@query(
    "g06_ohlc_bars",
    f"""WITH {TICKS}
    SELECT symbol, "timestamp" - "timestamp" % 3600000 AS epoch_ms,
           arg_min(close, "timestamp" * 1000000000 + id) AS open, max(close) AS high, min(close) AS low,
           arg_max(close, "timestamp" * 1000000000 + id) AS close, {r('sum(volume)', 4)} AS volume, count(*) AS trade_count
    FROM (SELECT symbol, close, volume, "timestamp"::HUGEINT AS "timestamp", id FROM ticks) GROUP BY 1, 2""".replace(
        '"timestamp" - "timestamp" % 3600000', 'CAST("timestamp" - "timestamp" % 3600000 AS BIGINT)'
    ),
)
def bars(spark, sf_dir):
    return m.ohlc_bars(ticks(spark, sf_dir)).withColumn("volume", rounded(F.col("volume"), 4))


ROLLING = """
  WINDOW w25 AS (PARTITION BY symbol ORDER BY "timestamp", id ROWS BETWEEN 24 PRECEDING AND CURRENT ROW)"""
GAPPED = f"""{TICKS}, gapped AS (SELECT symbol, "timestamp", id, volume, CASE WHEN id % 9 <> 0 THEN close END AS close FROM ticks),
  windows AS (SELECT *, list(close) OVER w25 AS all_prices, count(*) OVER w25 AS window_count, avg(volume) OVER w25 AS avg_volume,
      sum(close * volume) OVER w25 AS pv, sum(volume) OVER w25 AS v FROM gapped {ROLLING}),
  priced AS (SELECT *, list_filter(all_prices, lambda x: x IS NOT NULL) AS prices FROM windows),
  averaged AS (SELECT *, CASE WHEN len(prices) >= 5 THEN list_avg(prices[-5:]) END AS s5,
      CASE WHEN len(prices) >= 20 THEN list_avg(prices[-20:]) END AS s20 FROM priced)"""


def _gapped(spark, sf_dir):
    """Ticks of five symbols; every ninth has no price."""
    return ticks(spark, sf_dir).withColumn("close", F.when(F.col("id") % 9 != 0, F.col("close")))


@query(
    "w02_rolling_metrics",
    f"""WITH {GAPPED},
    ret AS (SELECT *, CASE WHEN prices[1] <> 0 THEN (prices[-1] - prices[1]) / prices[1] * 100.0 END AS ret FROM averaged)
    SELECT symbol, "timestamp", id, window_count, {r('prices[-1]', 6)} AS last_price, {r('list_avg(prices)', 6)} AS avg_price,
      {r('avg_volume', 6)} AS avg_volume, {r('list_min(prices)', 6)} AS min_price, {r('list_max(prices)', 6)} AS max_price,
      {r('ret', 6)} AS price_return_pct, {r('CASE WHEN len(prices) >= 2 THEN list_stddev_pop(prices) END', 6)} AS volatility_estimate,
      {r('CASE WHEN v > 0 THEN pv / v END', 6)} AS vwap, {r('s5', 6)} AS sma_5, {r('s20', 6)} AS sma_20,
      {r('''CASE WHEN s20 <> 0 THEN least(greatest((s5 - s20) / s20 * 50.0, -1.0), 1.0)
            WHEN ret IS NOT NULL THEN least(greatest(ret / 5.0, -1.0), 1.0) ELSE 0.0 END''', 6)} AS trend_score
    FROM ret""",
)
def rolling(spark, sf_dir):
    """State as of every tick, with ticks that have no price among them."""
    return m.rounded_state(rolling_state(_gapped(spark, sf_dir)))


@query(
    "w03_moving_averages",
    f"""WITH {GAPPED} SELECT symbol, "timestamp", id, {r('s5', 6)} AS sma_5, {r('s20', 6)} AS sma_20 FROM averaged""",
)
def averages(spark, sf_dir):
    return m.rounded_state(moving_averages(_gapped(spark, sf_dir)))


@query(
    "k18_enriched_ticks",
    f"""WITH {TICKS}, {LAST_25}, {NUMBERED}, state AS ({state_sql('strict')} FROM numbered GROUP BY symbol)
    SELECT t.id, t.symbol, t.close, t.volume, t."timestamp" AS timestamp_ms, s.window_count, s.avg_price, s.vwap,
           s.sma_5, s.sma_20, s.trend_score, s.last_tick_at
    FROM ticks t JOIN state s USING (symbol)""",
)
def enriched(spark, sf_dir):
    t = ticks(spark, sf_dir)
    state = m.rounded_state(m.market_state(m.newest_rows(t, "symbol", ["timestamp", "id"])))
    return m.enrich_ticks(t.select("id", "symbol", "close", "volume", F.col("timestamp").alias("timestamp_ms")), state).select(
        "id", "symbol", "close", "volume", "timestamp_ms", "window_count", "avg_price", "vwap",
        "sma_5", "sma_20", "trend_score", "last_tick_at",
    )


# --- sentiment ------------------------------------------------------------------------------------

FIRST_8 = """first8 AS (
  SELECT symbol, ordinal, trim(headline) AS headline,
         row_number() OVER (PARTITION BY symbol ORDER BY ordinal) AS rn
  FROM headlines WHERE trim(headline) <> '' QUALIFY rn <= 8)"""


def score_sql(net: str, step: float, digits: int) -> str:
    return r(f"least(greatest({step} * {net}, -0.9), 0.9)", digits)


def label_sql(value: str, limit: float = 0.0) -> str:
    return f"CASE WHEN {value} > {limit} THEN 'bullish' WHEN {value} < -{limit} THEN 'bearish' ELSE 'neutral' END"


def _sentiment_query(name: str, lexicon: Lexicon, true_lexicon: Lexicon, what: str):
    digits = lexicon.digits or 6
    net = net_hits_sql("text", lexicon.positive, lexicon.negative, lexicon.strip_punctuation)
    true_net = net_hits_sql("text", true_lexicon.positive, true_lexicon.negative, lexicon.strip_punctuation)

    @query(
        name,
        f"""WITH n AS (SELECT doc_id, {net} AS net, {true_net} AS market_net FROM documents)
        SELECT doc_id, {label_sql('net')} AS label, {score_sql('net', lexicon.step, digits)} AS score,
               {label_sql('market_net')} AS market_label, {score_sql('market_net', lexicon.step, digits)} AS market_score
        FROM n""",
    )
    def build(spark, sf_dir):
        d = table(spark, sf_dir, "documents").select("doc_id", "text")
        scored = with_sentiment(with_sentiment(d, "text", lexicon), "text", true_lexicon, "market_")
        return scored.select(
            "doc_id", "label", rounded(F.col("score"), digits).alias("score"),
            "market_label", rounded(F.col("market_score"), digits).alias("market_score"),
        )

    build.__doc__ = f"{what}: whole document texts, with common words and with the market words."
    return build


_sentiment_query(
    "f01_news_sentiment", COMMON_WORDS,
    Lexicon(COMMON_WORDS.positive, COMMON_WORDS.negative), "Distinct-word scorer, two digits",
)
_sentiment_query(
    "f02_headline_sentiment", Lexicon(COMMON_WORDS.positive, COMMON_WORDS.negative), HEADLINE_LEXICON, "Unrounded scorer"
)
_sentiment_query(
    "f03_message_sentiment",
    Lexicon(COMMON_WORDS.positive, COMMON_WORDS.negative, 0.25, 0.9, 2, True), MESSAGE_LEXICON, "Scorer without punctuation",
)


@query(
    "u04_word_set_overlap",
    f"""SELECT doc_id,
      len(list_intersect(list_distinct(string_split_regex(lower(text), '\\s+')), ['that', 'is', 'the', 'la', 'die', 'los'])) AS overlap
      FROM documents""",
)
def overlap(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(found_words(F.col("text"), COMMON_WORDS.positive)).alias("overlap"))


NET = net_hits_sql("headline", COMMON_WORDS.positive, COMMON_WORDS.negative)
ANALYSIS = f"""scored AS (SELECT symbol, rn, headline, {score_sql(NET, 0.3, 2)} AS score FROM first8),
analysis AS (SELECT symbol, round(avg(score), 10) AS mean, {r('avg(score)', 2)} AS score, count(*) AS article_count,
             max(headline) FILTER (WHERE rn = 1) AS first_headline FROM scored GROUP BY symbol)"""


@query(
    "g17_headline_analysis",
    f"""WITH {HEADLINES}, {FIRST_8}, {ANALYSIS}
    SELECT symbol, {label_sql('mean', 0.15)} AS label, score, article_count,
      'Headline sentiment is ' || {label_sql('mean', 0.15)} || ' based on ' || CAST(article_count AS VARCHAR) || ' recent articles.' AS summary,
      article_count AS breakdown_size, first_headline
    FROM analysis""",
)
def headline_analysis(spark, sf_dir):
    a = m.headline_sentiment(headlines(spark, sf_dir), COMMON_WORDS)
    return a.select(
        "symbol", "label", "score", "article_count", "summary",
        F.size("headlines").cast("bigint").alias("breakdown_size"), F.col("headlines")[0]["headline"].alias("first_headline"),
    )


@query(
    "w08_first_items_per_symbol",
    f"WITH {HEADLINES}, {FIRST_8} SELECT symbol, ordinal, headline, rn FROM first8",
)
def first_items(spark, sf_dir):
    return m.first_rows(trimmed_headlines(headlines(spark, sf_dir)), "symbol", ["ordinal"], m.NEWS_PER_SYMBOL).select(
        "symbol", "ordinal", "headline", "rn"
    )


SIGNAL = f"""{USER_TICKS}, {LAST_25}, {NUMBERED}, {HEADLINES}, {FIRST_8}, {ANALYSIS},
state AS ({state_sql('strict', None)} FROM numbered GROUP BY symbol),
signal AS (
  SELECT s.*, a.article_count, {label_sql('a.mean', 0.15)} AS label, coalesce(a.score, 0.0) AS sentiment,
         0.65 * s.trend_score + 0.35 * coalesce(a.score, 0.0) AS final
  FROM state s LEFT JOIN analysis a USING (symbol))"""


STATE_NUMBERS = ("last_price", "sma_5", "sma_20", "vwap", "price_return_pct", "volatility_estimate")


def _signals(spark, sf_dir, symbol_column="user_id"):
    window = m.newest_rows(ticks(spark, sf_dir, symbol_column), "symbol", ["timestamp", "id"])
    state = m.market_state(window)
    analysis = m.headline_sentiment(headlines(spark, sf_dir), COMMON_WORDS)
    return m.fused_signals(state, analysis, F.lit(NOW_MS))


@query(
    "f04_fused_signal",
    f"""WITH {SIGNAL}
    SELECT upper(symbol) AS symbol,
      CASE WHEN round(final, 10) > 0.3 THEN 'BUY' WHEN round(final, 10) < -0.3 THEN 'SELL' ELSE 'HOLD' END AS action,
      {r('least(abs(final), 1.0)', 2)} AS confidence, {r('trend_score', 2)} AS trend_score,
      CASE WHEN article_count IS NULL THEN 'neutral' ELSE label END AS sentiment_label,
      {r('sentiment', 2)} AS sentiment_score
    FROM signal""",
)
def fused(spark, sf_dir):
    return _signals(spark, sf_dir).select(
        "symbol", "action", "confidence", "trend_score", "sentiment_label", "sentiment_score"
    )


@query(
    "p10_signal_history",
    f"""WITH {SIGNAL}
    SELECT upper(symbol) AS symbol,
      CASE WHEN round(final, 10) > 0.3 THEN 'BUY' WHEN round(final, 10) < -0.3 THEN 'SELL' ELSE 'HOLD' END AS action,
      {r('least(abs(final), 1.0)', 2)} AS confidence, {r('trend_score', 2)} AS trend_score,
      CASE WHEN article_count IS NULL THEN 'neutral' ELSE label END AS sentiment_label,
      {r('sentiment', 2)} AS sentiment_score,
      CASE WHEN article_count IS NULL THEN 'No headline analysis available.' ELSE
        'Headline sentiment is ' || label || ' based on ' || CAST(article_count AS VARCHAR) || ' recent articles.' END AS analyst_summary,
      {', '.join(f"{r(c, 6)} AS {c}" for c in STATE_NUMBERS)}, window_count, {NOW_MS} AS timestamp_ms
    FROM signal""",
)
def signal_rows(spark, sf_dir):
    """Flagship: last-25 state, headline sentiment and the fused signal as history rows, rounded on output only."""
    history = m.signal_history(_signals(spark, sf_dir))
    return history.withColumns({c: rounded(F.col(c), 6) for c in STATE_NUMBERS})


@query(
    "f05_analyst_result",
    """SELECT conv_id, turn,
        CASE WHEN role = 'user' THEN 'bullish' WHEN role = 'system' THEN 'bearish' ELSE 'neutral' END AS label,
        CAST(CASE WHEN turn % 3 = 0 THEN 0.0 ELSE least(greatest(turn - 2.0, -1.0), 1.0) END AS DOUBLE) AS score,
        trim(text, ' ') AS summary FROM conversations""",
)
def analyst(spark, sf_dir):
    """Roles as labels (unknown ones become neutral), the turn as a score that is no number now and then."""
    c = table(spark, sf_dir, "conversations")
    label = F.when(F.col("role") == "user", "BULLISH").when(F.col("role") == "system", "Bearish").otherwise(F.col("role"))
    score = F.when(F.col("turn") % 3 == 0, "high").otherwise((F.col("turn") - 2.0).cast("string"))
    return c.select("conv_id", "turn", *analyst_result(label, score, F.col("text")))


@query(
    "f07_parsed_action",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
        CASE l_returnflag WHEN 'A' THEN 'BUY' WHEN 'R' THEN 'SELL' ELSE 'HOLD' END AS action,
        least(greatest(l_quantity / 25 - 0.5, 0.0), 1.0) AS confidence FROM lineitem""",
)
def action(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    word = F.when(F.col("l_returnflag") == "A", "buy").when(F.col("l_returnflag") == "R", "Sell").otherwise("wait")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        *parsed_action(word, F.col("l_quantity") / 25 - 0.5),
    )


@query(
    "p21_market_documents",
    f"""WITH {USER_TICKS}, {LAST_25}, {HEADLINES}, {FIRST_8},
    prices AS (SELECT symbol, count(*) AS price_rows, max(close) FILTER (WHERE rn = 1) AS newest_close,
                      min("timestamp") AS oldest_ms FROM last25 GROUP BY symbol),
    news AS (SELECT symbol, count(*) AS news_rows, max(headline) FILTER (WHERE rn = 1) AS first_headline FROM first8 GROUP BY symbol)
    SELECT p.symbol, price_rows, newest_close, oldest_ms, coalesce(news_rows, 0) AS news_rows, first_headline,
           price_rows AS state_window, 'batch' AS mode
    FROM prices p LEFT JOIN news n USING (symbol)""",
)
def documents(spark, sf_dir):
    prices = m.newest_rows(ticks(spark, sf_dir, "user_id"), "symbol", ["timestamp", "id"])
    news = m.first_rows(trimmed_headlines(headlines(spark, sf_dir)), "symbol", ["ordinal"], m.NEWS_PER_SYMBOL)
    docs = m.market_documents(
        prices, news, m.market_state(prices), {"mode": F.lit("batch"), "provider": F.lit("events")}
    )
    return docs.select(
        "symbol",
        F.size("ohlc").cast("bigint").alias("price_rows"),
        F.element_at("ohlc", -1)["close"].alias("newest_close"),
        F.col("ohlc")[0]["timestamp"].alias("oldest_ms"),
        F.coalesce(F.size("news"), F.lit(0)).cast("bigint").alias("news_rows"),
        F.col("news")[0]["headline"].alias("first_headline"),
        F.col("market_state.window_count").alias("state_window"),
        F.col("ohlc_meta.mode").alias("mode"),
    )


@query(
    "g20_payload_summary",
    f"""WITH {TICKS}
    SELECT symbol, count(*) AS row_count, min("timestamp") AS first_timestamp,
           arg_max(close, CAST("timestamp" AS HUGEINT) * 1000000000 + id) AS last_close,
           CAST(sum(length('{{"symbol":"' || symbol || '","id":' || CAST(id AS VARCHAR) || ',"timestamp":' || CAST("timestamp" AS VARCHAR) || '}}')) AS BIGINT) AS payload_bytes
    FROM ticks GROUP BY symbol""",
)
def payload_summary(spark, sf_dir):
    t = ticks(spark, sf_dir)
    return t.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("timestamp").alias("first_timestamp"),
        F.max_by("close", F.struct("timestamp", "id")).alias("last_close"),
        F.sum(F.octet_length(F.to_json(F.struct("symbol", "id", "timestamp")))).alias("payload_bytes"),
    )
