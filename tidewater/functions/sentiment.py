"""Lexicon sentiment as column expressions.

A text is lower-cased and its distinct white-space separated words are matched
against two word lists. Each net hit moves the score by ``step`` up to ``cap``.
Only list words are taken out of the text, in one regular-expression pass.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.numeric import clamp, rounded

NO_SPACE = r"[^\s\x1c-\x1f]"


@dataclass(frozen=True)
class Lexicon:
    positive: tuple[str, ...]
    negative: tuple[str, ...]
    step: float = 0.3
    cap: float = 0.9
    digits: int | None = None
    strip_punctuation: bool = False


# Word lists, steps and caps of the three scorers.
NEWS_LEXICON = Lexicon(
    positive=(
        "surges", "jumps", "soars", "bullish", "growth",
        "profit", "beats", "rally", "inflows", "approval",
    ),
    negative=(
        "plummets", "drops", "falls", "bearish", "loss",
        "misses", "crash", "lawsuit", "hack", "outflows",
    ),
    digits=2,
)
HEADLINE_LEXICON = Lexicon(
    positive=(
        "surges", "jumps", "soars", "up", "bullish",
        "growth", "profit", "beats", "rally", "wins",
    ),
    negative=(
        "plummets", "drops", "falls", "down", "bearish",
        "loss", "misses", "crash", "lawsuit", "hack",
    ),
)
MESSAGE_LEXICON = Lexicon(
    positive=("surge", "surges", "growth", "beat", "beats", "bullish", "rally", "gain"),
    negative=("drop", "drops", "miss", "misses", "bearish", "hack", "crash", "loss"),
    step=0.25,
    digits=2,
    strip_punctuation=True,
)
AGGREGATE_LABEL_LIMIT = 0.15


def found_words(text: Column, vocabulary: tuple[str, ...], strip_punctuation: bool = False) -> Column:
    """Distinct vocabulary words that occur as whole words of the text."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    if strip_punctuation:
        lowered = F.translate(lowered, ".,", "  ")
    words = "|".join(re.escape(w) for w in vocabulary)
    pattern = f"(?U)(?<!{NO_SPACE})(?:{words})(?!{NO_SPACE})"
    return F.array_distinct(F.regexp_extract_all(lowered, F.lit(pattern), F.lit(0)))


def overlap(words: Column, vocabulary: tuple[str, ...]) -> Column:
    return F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in vocabulary])))


def with_net_hits(df: DataFrame, text: str, lexicon: Lexicon, name: str) -> DataFrame:
    """Add positive minus negative words; the text is scanned once for both lists."""
    vocabulary = tuple(dict.fromkeys(lexicon.positive + lexicon.negative))
    found = df.withColumn("_found", found_words(F.col(text), vocabulary, lexicon.strip_punctuation))
    net = overlap(F.col("_found"), lexicon.positive) - overlap(F.col("_found"), lexicon.negative)
    return found.withColumn(name, net).drop("_found")


def score_of(net: Column, lexicon: Lexicon) -> Column:
    raw = clamp(net * F.lit(lexicon.step), -lexicon.cap, lexicon.cap)
    return raw if lexicon.digits is None else rounded(raw, lexicon.digits)


def label_of(value: Column, limit: float = 0.0) -> Column:
    return (
        F.when(value > limit, F.lit("bullish"))
        .when(value < -limit, F.lit("bearish"))
        .otherwise(F.lit("neutral"))
    )


def with_sentiment(df, text: str, lexicon: Lexicon = NEWS_LEXICON, prefix: str = ""):
    """Add ``label`` and ``score`` columns for a text column."""
    scored = with_net_hits(df, text, lexicon, "_net")
    return scored.select(
        *df.columns,
        label_of(F.col("_net")).alias(f"{prefix}label"),
        score_of(F.col("_net"), lexicon).alias(f"{prefix}score"),
    )
