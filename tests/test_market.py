import random
import statistics

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidewater.functions.sentiment import HEADLINE_LEXICON, MESSAGE_LEXICON, NEWS_LEXICON, with_sentiment
from tidewater.operators import market as m
from tidewater.operators.rolling import moving_averages, rolling_state

OFFSETS = [-120, -90, -60, -35, -20, -10, 0, 12, 25, 40, 55, 70, 82, 95, 105, 116, 128, 141, 155, 170, 185, 198, 212, 228, 245]


def tick_frame(spark, data):
    return spark.createDataFrame(data, "symbol string, close double, volume double, timestamp bigint, id bigint")


def state(spark, data, mode="strict"):
    window = m.newest_rows(tick_frame(spark, data), "symbol", ["timestamp", "id"])
    return {r["symbol"]: r for r in rows(m.market_state(window, mode))}


def series(prices, volumes=None, symbol="A"):
    volumes = volumes or [1.0] * len(prices)
    return [(symbol, p, v, i, i) for i, (p, v) in enumerate(zip(prices, volumes))]


def test_known_25_tick_window(spark):
    data = series([68400.0 + o for o in OFFSETS], [round(1.1 + 0.07 * i, 4) for i in range(25)])
    s = state(spark, data)["A"]
    assert s["window_count"] == 25 and s["last_price"] == 68645.0
    for name, value in {
        "avg_price": 68477.08, "avg_volume": 1.94, "min_price": 68280.0, "max_price": 68645.0,
        "price_return_pct": 0.5345635618043351, "volatility_estimate": 99.8774929601259, "vwap": 68502.96556701031,
        "sma_5": 68613.6, "sma_20": 68512.6, "trend_score": 0.07370906957260416,
    }.items():
        assert s[name] == pytest.approx(value, rel=1e-10), name


def test_rising_series(spark):
    s = state(spark, series([60000.0 + i for i in range(25)]))["A"]
    assert (s["sma_5"], s["sma_20"]) == (60022.0, 60014.5)
    assert s["trend_score"] == pytest.approx(0.006248489948262503)


@pytest.mark.parametrize(
    "mode, volatility, sma_5", [("strict", None, None), ("lenient", None, 7.0), ("zero_fill", 0.0, 7.0)]
)
def test_one_row(spark, mode, volatility, sma_5):
    s = state(spark, series([7.0]), mode)["A"]
    assert (s["volatility_estimate"], s["sma_5"]) == (volatility, sma_5)
    assert s["trend_score"] == 0.0


def test_short_and_degenerate_windows(spark):
    data = (
        series([1.0, 2.0, 3.0, 4.0], symbol="four")
        + series([100.0 + i for i in range(10)], symbol="ten")
        + series([1.0, 2.0], [0.0, 0.0], symbol="dry")
        + series([0.0, 5.0], symbol="zero")
    )
    s = state(spark, data)
    assert s["four"]["sma_5"] is None and s["four"]["trend_score"] == 1.0
    assert s["ten"]["sma_5"] == 107.0 and s["ten"]["sma_20"] is None
    assert s["ten"]["trend_score"] == pytest.approx(1.0)  # 9 % / 5, clamped
    assert s["dry"]["vwap"] is None
    assert s["zero"]["price_return_pct"] is None and s["zero"]["trend_score"] == 0.0


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        m.market_state(m.newest_rows(tick_frame(spark, series([1.0])), "symbol", ["id"]), "other")


def brute_force(data):
    out = {}
    by_symbol = {}
    for row in sorted(data, key=lambda r: (r[3], r[4])):
        window = by_symbol.setdefault(row[0], [])
        window.append(row)
        last = window[-25:]
        prices, volumes = [r[1] for r in last if r[1] is not None], [r[2] for r in last]
        turnover = sum(r[1] * r[2] for r in last if r[1] is not None)
        out[row[4]] = {
            "window_count": len(last),
            "last_price": prices[-1] if prices else None,
            "avg_price": sum(prices) / len(prices) if prices else None,
            "min_price": min(prices, default=None),
            "volatility_estimate": statistics.pstdev(prices) if len(prices) > 1 else None,
            "vwap": turnover / sum(volumes) if sum(volumes) and prices else None,
            "sma_5": sum(prices[-5:]) / 5 if len(prices) >= 5 else None,
            "sma_20": sum(prices[-20:]) / 20 if len(prices) >= 20 else None,
        }
    return out


@pytest.mark.parametrize("chunks, spread", [(1, 400), (5, 400), (60, 400), (40, 1)])
def test_rolling_equals_brute_force_for_any_chunk(spark, chunks, spread):
    """One symbol holds most rows, some have no price; ranges hold from a few ticks (borrowing over many) to all.

    A spread of one puts every tick into the same millisecond.
    """
    rng = random.Random(chunks)
    data = [
        (
            "hot" if rng.random() < 0.7 else f"s{rng.randrange(4)}", None if rng.random() < 0.2 else round(rng.uniform(1, 9), 2),
            float(rng.randrange(3)), rng.randrange(spread), i,
        )
        for i in range(300)
    ]
    expected = brute_force(data)
    got = rows(rolling_state(tick_frame(spark, data), chunks=chunks))
    assert len(got) == len(data)
    for r in got:
        for name, value in expected[r["id"]].items():
            assert r[name] == (None if value is None else pytest.approx(value, abs=1e-7)), (r["id"], name)
    averages = rows(moving_averages(tick_frame(spark, data), chunks=chunks))
    for r in averages:
        for name in ("sma_5", "sma_20"):
            value = expected[r["id"]][name]
            assert r[name] == (None if value is None else pytest.approx(value, abs=1e-7))


def test_a_burst_is_spread_over_tasks(spark):
    """All ticks of one symbol in one second still make ranges of about equal size."""
    from tidewater.operators.rolling import with_lookback

    burst = spark.range(20_000).select(F.lit("one").alias("symbol"), F.lit(5).alias("timestamp"), "id")
    sizes = [r["count"] for r in rows(with_lookback(burst, "symbol", "timestamp", "id", 24, 10).groupBy("chunk").count())]
    assert len(sizes) == 10 and max(sizes) < 2 * min(sizes) and sum(sizes) == 20_000 + 9 * 24


def test_signals_are_fused_before_rounding(spark):
    """A trend just above the limit that rounds to it still buys."""
    state = spark.createDataFrame(
        [("A", 0.3 / 0.65 + 2e-8)], "symbol string, trend_score double"
    ).selectExpr("*", "1D last_price", "1D sma_5", "1D sma_20", "1D vwap", "1D price_return_pct", "1D volatility_estimate", "25 window_count")
    none = spark.createDataFrame([], "symbol string, label string, score double, summary string, headlines array<string>")
    (r,) = rows(m.fused_signals(state, none, F.lit(0)))
    assert r["action"] == "BUY"
    (r,) = rows(m.fused_signals(m.rounded_state(state), none, F.lit(0)))
    assert r["action"] == "HOLD"


def test_last_rows_use_a_group_limit(spark):
    plan = m.newest_rows(tick_frame(spark, series([1.0])), "symbol", ["timestamp", "id"])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize(
    "text, lexicon, label, score",
    [
        ("Bitcoin surges to new highs", NEWS_LEXICON, "bullish", 0.3),
        ("Market crashes amid fears", NEWS_LEXICON, "neutral", 0.0),
        ("surges jumps soars bullish", NEWS_LEXICON, "bullish", 0.9),
        ("rally rally rally", NEWS_LEXICON, "bullish", 0.3),
        ("loss and hack", NEWS_LEXICON, "bearish", -0.6),
        ("up and wins", HEADLINE_LEXICON, "bullish", 0.6),
        ("up and wins", NEWS_LEXICON, "neutral", 0.0),
        ("Gain, surge. rally", MESSAGE_LEXICON, "bullish", 0.75),
        ("drop.miss", MESSAGE_LEXICON, "bearish", -0.5),
        (None, NEWS_LEXICON, "neutral", 0.0),
        ("", NEWS_LEXICON, "neutral", 0.0),
    ],
)
def test_sentiment(spark, text, lexicon, label, score):
    (r,) = rows(with_sentiment(spark.createDataFrame([(text,)], "t string"), "t", lexicon))
    assert r["label"] == label and r["score"] == pytest.approx(score)


@pytest.mark.parametrize(
    "trend, sentiment, action, confidence",
    [(1.0, 0.9, "BUY", 0.97), (-1.0, 0.0, "SELL", 0.65), (0.3 / 0.65, 0.0, "HOLD", 0.3), (0.0, 0.0, "HOLD", 0.0)],
)
def test_fused_signal(spark, trend, sentiment, action, confidence):
    states = spark.createDataFrame(
        [("a", trend, 1.0, None, None, None, None, None, 1)],
        "symbol string, trend_score double, last_price double, sma_5 double, sma_20 double, vwap double, "
        "price_return_pct double, volatility_estimate double, window_count bigint",
    )
    analysis = spark.createDataFrame(
        [("a", "bullish", sentiment, "s", [])],
        "symbol string, label string, score double, summary string, headlines array<struct<headline:string,label:string,score:double>>",
    )
    (r,) = rows(m.signal_history(m.fused_signals(states, analysis, F.lit(5))))
    assert (r["symbol"], r["action"], r["confidence"], r["timestamp_ms"]) == ("A", action, confidence, 5)


def test_headline_analysis_bounds_and_labels(spark):
    news = spark.createDataFrame(
        [("A", i, "profit up") for i in range(12)] + [("A", 12, "crash"), ("B", 0, "  "), ("B", 1, " loss ")],
        "symbol string, ordinal bigint, headline string",
    )
    out = {r["symbol"]: r for r in rows(m.headline_sentiment(news))}
    assert out["A"]["article_count"] == 8 and len(out["A"]["headlines"]) == 8 and out["A"]["label"] == "bullish"
    assert out["B"]["headlines"] == [{"headline": "loss", "label": "bearish", "score": -0.3}]
    assert out["B"]["summary"] == "Headline sentiment is bearish based on 1 recent articles."


def test_keyed_counts_skip_blank_symbols_and_missing_prices(spark):
    data = spark.createDataFrame(
        [("A", 1.0, 1), ("A", 3.0, 2), ("A", None, 3), ("", 5.0, 4), (None, 5.0, 5), ("A", 9.0, 11)],
        "symbol string, close double, s int",
    ).withColumn("ts", F.timestamp_seconds("s"))
    got = rows(m.keyed_window_counts(data), "time")
    assert [(r["time"], r["symbol"], r["avg_price"], r["count"]) for r in got] == [(0, "A", 2.0, 2), (10000, "A", 9.0, 1)]
