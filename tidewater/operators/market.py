"""Windowed market state, trend score, fused signal and OHLC bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions.numeric import clamp, first_truthy_text, rounded
from tidewater.functions.sentiment import AGGREGATE_LABEL_LIMIT, Lexicon, NEWS_LEXICON, label_of, with_sentiment

# Window length, moving-average lengths, weights, limits and the summary where there is none.
WINDOW_ROWS = 25
SMA_SHORT = 5
SMA_LONG = 20
TREND_GAIN = 50.0
RETURN_SCALE = 5.0
TREND_WEIGHT = 0.65
SENTIMENT_WEIGHT = 0.35
ACTION_LIMIT = 0.3
NEWS_PER_SYMBOL = 8
NO_ANALYSIS = "No headline analysis available."

STATE_COLUMNS = (
    "window_count", "last_price", "avg_price", "avg_volume", "min_price", "max_price",
    "price_return_pct", "volatility_estimate", "vwap", "sma_5", "sma_20", "trend_score", "last_tick_at",
)


def newest_rows(
    df: DataFrame, key: str, order: list[str], n: int = WINDOW_ROWS, rank: str = "rn"
) -> DataFrame:
    """Newest ``n`` rows per key.

    The ``row_number() <= n`` filter becomes a group limit below the shuffle, so
    every task sends at most ``n`` rows per key and a hot key stays small.
    """
    window = W.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def first_rows(df: DataFrame, key: str, order: list[str], n: int, rank: str = "rn") -> DataFrame:
    """First ``n`` rows per key in input order (same group limit as ``newest_rows``)."""
    window = W.partitionBy(key).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def trend_score(sma_5: Column, sma_20: Column, return_pct: Column) -> Column:
    by_average = clamp((sma_5 - sma_20) / F.nullif(sma_20, F.lit(0.0)) * F.lit(TREND_GAIN))
    by_return = clamp(return_pct / F.lit(RETURN_SCALE))
    # greatest/least skip nulls, so an unknown input must be kept out of the clamp
    return (
        F.when(sma_5.isNotNull() & sma_20.isNotNull() & (sma_20 != 0), by_average)
        .when(return_pct.isNotNull(), by_return)
        .otherwise(F.lit(0.0))
    )


def _usable_rows(window: DataFrame, mode: str) -> DataFrame:
    close = F.expr("try_cast(close AS double)")
    volume = F.coalesce(F.expr("try_cast(volume AS double)"), F.lit(0.0))
    rows = window.select("symbol", "rn", "timestamp", close.alias("close"), volume.alias("volume"))
    if mode == "strict":
        return rows
    if mode == "lenient":
        return rows.filter(F.col("close").isNotNull())
    if mode == "zero_fill":
        return rows.withColumn("close", F.coalesce("close", F.lit(0.0)))
    raise ValueError(f"unknown market-state mode: {mode}")


def market_state(window: DataFrame, mode: str = "strict") -> DataFrame:
    """One state row per symbol from its newest rows (``rn`` = 1 is the newest).

    ``strict``: moving averages only when enough prices exist, volatility from two.
    ``lenient``: rows without a numeric close are left out, short averages allowed.
    ``zero_fill``: a missing close counts as 0, volatility from one row.
    """
    rows = _usable_rows(window, mode)
    # position among priced rows, newest first: rows without a price do not take a place
    place = F.count("close").over(W.partitionBy("symbol").orderBy("rn"))
    rows = rows.withColumn("place", F.when(F.col("close").isNotNull(), place))
    close, volume, place = F.col("close"), F.col("volume"), F.col("place")

    state = rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("window_count"),
        F.count("close").alias("priced"),
        F.min_by("close", "place").alias("last_price"),
        F.max_by("close", "place").alias("first_price"),
        F.avg("close").alias("avg_price"),
        F.avg("volume").alias("avg_volume"),
        F.min("close").alias("min_price"),
        F.max("close").alias("max_price"),
        F.stddev_pop("close").alias("deviation"),
        F.sum("volume").alias("total_volume"),
        F.sum(close * volume).alias("turnover"),
        F.avg(F.when(place <= SMA_SHORT, close)).alias("short_average"),
        F.avg(F.when(place <= SMA_LONG, close)).alias("long_average"),
        F.min_by("timestamp", "rn").alias("last_tick_at"),
    )
    priced, first, last = F.col("priced"), F.col("first_price"), F.col("last_price")
    if mode == "strict":
        sma_5 = F.when(priced >= SMA_SHORT, F.col("short_average"))
        sma_20 = F.when(priced >= SMA_LONG, F.col("long_average"))
    else:
        sma_5, sma_20 = F.col("short_average"), F.col("long_average")
    state = state.select(
        "symbol",
        "window_count",
        "last_price",
        "avg_price",
        "avg_volume",
        "min_price",
        "max_price",
        F.when(first != 0, (last - first) / F.nullif(first, F.lit(0.0)) * 100.0).alias("price_return_pct"),
        F.when(priced >= (1 if mode == "zero_fill" else 2), F.col("deviation")).alias("volatility_estimate"),
        F.when(F.col("total_volume") > 0, F.col("turnover") / F.nullif("total_volume", F.lit(0.0))).alias("vwap"),
        sma_5.alias("sma_5"),
        sma_20.alias("sma_20"),
        "last_tick_at",
    )
    return state.withColumn(
        "trend_score", trend_score(F.col("sma_5"), F.col("sma_20"), F.col("price_return_pct"))
    )


def rounded_state(state: DataFrame, digits: int = 6) -> DataFrame:
    """Cut the float columns of a state to a fixed number of digits for storage or comparison."""
    exact = {"window_count", "last_tick_at", "symbol", "timestamp", "id"}
    return state.select(*[c if c in exact else rounded(F.col(c), digits).alias(c) for c in state.columns])


def headline_sentiment(
    news: DataFrame,
    lexicon: Lexicon = NEWS_LEXICON,
    key: str = "symbol",
    order: str = "ordinal",
    limit: int = NEWS_PER_SYMBOL,
) -> DataFrame:
    """Mean headline score per symbol over its first ``limit`` non-blank headlines.

    The list of scored headlines is kept beside the mean; it cannot outgrow ``limit``.
    """
    named = news.withColumn("headline", F.trim("headline")).filter(F.col("headline") != "")
    capped = first_rows(named, key, [order], limit)
    scored = with_sentiment(capped, "headline", lexicon)
    means = scored.groupBy(key).agg(
        F.avg("score").alias("mean_score"),
        F.count(F.lit(1)).alias("article_count"),
        F.sort_array(F.collect_list(F.struct("rn", "headline", "label", "score"))).alias("ranked"),
    )
    mean = F.round("mean_score", 10)
    return means.select(
        key,
        label_of(mean, AGGREGATE_LABEL_LIMIT).alias("label"),
        rounded(F.col("mean_score"), 2).alias("score"),
        "article_count",
        F.format_string(
            "Headline sentiment is %s based on %d recent articles.",
            label_of(mean, AGGREGATE_LABEL_LIMIT),
            F.col("article_count"),
        ).alias("summary"),
        F.transform(
            "ranked",
            lambda r: F.struct(r["headline"].alias("headline"), r["label"].alias("label"), r["score"].alias("score")),
        ).alias("headlines"),
    )


def fused_score(trend: Column, sentiment: Column) -> Column:
    return F.lit(TREND_WEIGHT) * trend + F.lit(SENTIMENT_WEIGHT) * sentiment


def action_for(score: Column) -> Column:
    return (
        F.when(score > ACTION_LIMIT, F.lit("BUY"))
        .when(score < -ACTION_LIMIT, F.lit("SELL"))
        .otherwise(F.lit("HOLD"))
    )


def fused_signals(state: DataFrame, analysis: DataFrame, timestamp_ms: Column) -> DataFrame:
    """Join the market state with the headline analysis and decide an action per symbol."""
    joined = state.join(
        analysis.select(
            "symbol",
            F.col("label").alias("sentiment_label"),
            F.col("score").alias("sentiment"),
            F.col("summary").alias("analyst_summary"),
            F.col("headlines").alias("analyst_headlines"),
        ),
        "symbol",
        "left",
    )
    sentiment = F.coalesce("sentiment", F.lit(0.0))
    score = fused_score(F.col("trend_score"), sentiment)
    return joined.select(
        F.upper("symbol").alias("symbol"),
        action_for(F.round(score, 10)).alias("action"),
        rounded(F.least(F.abs(score), F.lit(1.0)), 2).alias("confidence"),
        rounded(F.col("trend_score"), 2).alias("trend_score"),
        F.lower(F.coalesce("sentiment_label", F.lit("neutral"))).alias("sentiment_label"),
        rounded(sentiment, 2).alias("sentiment_score"),
        F.coalesce("analyst_summary", F.lit(NO_ANALYSIS)).alias("analyst_summary"),
        "analyst_headlines",
        F.struct(
            "last_price", "sma_5", "sma_20", "vwap", "price_return_pct", "volatility_estimate", "window_count"
        ).alias("market_state"),
        timestamp_ms.cast("bigint").alias("timestamp_ms"),
    )


def signal_history(signals: DataFrame, default_symbol: str = "BTCUSDT") -> DataFrame:
    """Flatten nested signals into the 15 typed history columns with their defaults."""
    state = F.col("market_state")
    number = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0)).alias(name)
    return signals.select(
        F.upper(first_truthy_text(F.col("symbol"), F.lit(default_symbol))).alias("symbol"),
        F.upper(F.coalesce("action", F.lit("HOLD"))).alias("action"),
        number("confidence"),
        number("trend_score"),
        F.lower(F.coalesce("sentiment_label", F.lit("neutral"))).alias("sentiment_label"),
        number("sentiment_score"),
        F.coalesce("analyst_summary", F.lit("")).alias("analyst_summary"),
        *[
            state[name].cast("double").alias(name)
            for name in ("last_price", "sma_5", "sma_20", "vwap", "price_return_pct", "volatility_estimate")
        ],
        state["window_count"].cast("int").alias("window_count"),
        F.col("timestamp_ms").cast("bigint").alias("timestamp_ms"),
    )


def keyed_window_counts(ticks: DataFrame, ts: str = "ts", width: str = "10 seconds") -> DataFrame:
    """Count and mean price per symbol and tumbling window; works on batch and stream input."""
    usable = ticks.filter((F.col("symbol") != "") & F.col("close").isNotNull())
    return (
        usable.groupBy(F.window(ts, width), "symbol")
        .agg(F.count(F.lit(1)).alias("count"), F.avg("close").alias("avg_price"))
        .select(F.unix_millis("window.start").alias("time"), "symbol", "avg_price", "count")
    )


def ohlc_bars(ticks: DataFrame, ts: str = "ts", order: tuple[str, ...] = ("timestamp", "id"), width: str = "1 hour") -> DataFrame:
    """Open/high/low/close/volume bar per symbol and window."""
    position = F.struct(*order)
    return (
        ticks.groupBy(F.window(ts, width), "symbol")
        .agg(
            F.min_by("close", position).alias("open"),
            F.max("close").alias("high"),
            F.min("close").alias("low"),
            F.max_by("close", position).alias("close"),
            F.sum("volume").alias("volume"),
            F.count(F.lit(1)).alias("trade_count"),
        )
        .select(
            "symbol", F.unix_millis("window.start").alias("epoch_ms"),
            "open", "high", "low", "close", "volume", "trade_count",
        )
    )


def enrich_ticks(ticks: DataFrame, state: DataFrame) -> DataFrame:
    """Attach the symbol's metrics snapshot to each tick (one state row per symbol)."""
    return ticks.join(state, "symbol", "left")


def market_documents(prices: DataFrame, news: DataFrame, state: DataFrame, metadata: dict[str, Column]) -> DataFrame:
    """One nested record per symbol; both lists are already bounded per symbol."""
    price_lists = prices.groupBy("symbol").agg(
        F.sort_array(F.collect_list(F.struct("timestamp", "id", "close", "volume"))).alias("ohlc")
    )
    news_lists = news.groupBy("symbol").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", "headline"))).alias("news")
    )
    state_records = state.select("symbol", F.struct(*[c for c in state.columns if c != "symbol"]).alias("market_state"))
    return (
        state_records.join(price_lists, "symbol", "left")
        .join(news_lists, "symbol", "left")
        .withColumn("ohlc_meta", F.struct(*[c.alias(n) for n, c in metadata.items()]))
    )
