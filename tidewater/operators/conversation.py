"""Conversation threads: history trimming, latest user message, next-value forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions.numeric import rounded

# History limits and characters per token.
MAX_MESSAGES = 20
MAX_TOKENS = 4000
CHARS_PER_TOKEN = 4


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / CHARS_PER_TOKEN).cast("bigint")


def trim_history(
    messages: DataFrame, max_messages: int = MAX_MESSAGES, max_tokens: int = MAX_TOKENS
) -> DataFrame:
    """Keep a leading system message, then the newest messages that fit both limits.

    The message limit is applied first, so at most ``max_messages`` rows per
    conversation reach the running token sum. Token counts are never negative,
    so the running sum only grows and "stop at the first that does not fit" is a filter.
    """
    sized = messages.withColumn("tokens", token_estimate(F.col("text")))
    opening = sized.groupBy("conv_id").agg(
        F.min_by(F.struct("turn", "role", "tokens"), "turn").alias("first")
    )
    system = opening.filter(F.col("first.role") == "system").select(
        "conv_id", F.col("first.turn").alias("system_turn"), F.col("first.tokens").alias("system_tokens")
    )
    newest_first = W.partitionBy("conv_id").orderBy(F.col("turn").desc())
    # the system message is the oldest row, so it never pushes another one out
    recent = (
        sized.withColumn("place", F.row_number().over(newest_first))
        .filter(F.col("place") <= max_messages)
        .join(system, "conv_id", "left")
        .filter(F.col("system_turn").isNull() | (F.col("turn") != F.col("system_turn")))
    )
    used = F.sum("tokens").over(newest_first.rowsBetween(W.unboundedPreceding, 0))
    kept = (
        recent.withColumn("used", used + F.coalesce("system_tokens", F.lit(0)))
        .filter(F.col("used") <= max_tokens)
        .select("conv_id", "turn", "role", "text", "tokens")
    )
    # joined on both keys, so the rows of one long conversation spread over tasks
    leading = sized.join(
        system.select("conv_id", F.col("system_turn").alias("turn")), ["conv_id", "turn"], "left_semi"
    )
    return kept.unionByName(leading.select("conv_id", "turn", "role", "text", "tokens"))


def latest_user_message(messages: DataFrame) -> DataFrame:
    """Last user message per conversation, else the last message of any role."""
    from_user = F.col("role") == "user"
    return messages.groupBy("conv_id").agg(
        F.coalesce(
            F.max_by(F.when(from_user, F.trim("text")), F.when(from_user, F.col("turn"))),
            F.max_by("text", "turn"),
            F.lit(""),
        ).alias("message"),
    )


def next_value(series: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Linear next value per key from the last two numeric points.

    One point repeats itself, none gives 0. Only two rows per key leave a task.
    """
    number = F.col(value).cast("string").try_cast("double")
    points = series.select(key, *order, number.alias("y"))
    keys = points.groupBy(key).agg(F.count("y").alias("input_points"))
    newest = W.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    last_two = (
        points.filter(F.col("y").isNotNull())
        .withColumn("place", F.row_number().over(newest))
        .filter(F.col("place") <= 2)
        .groupBy(key)
        .agg(
            F.max(F.when(F.col("place") == 1, F.col("y"))).alias("last"),
            F.max(F.when(F.col("place") == 2, F.col("y"))).alias("previous"),
        )
    )
    forecast = F.col("last") + F.coalesce(F.col("last") - F.col("previous"), F.lit(0.0))
    return keys.join(last_two, key, "left").select(
        key, "input_points", rounded(F.coalesce(forecast, F.lit(0.0)), 2).alias("next_value")
    )
