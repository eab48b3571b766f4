"""Statistics over benchmark trials: stage summaries, scopes, comparisons, speed-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.order_stats import exact_summary

# Stages, their trial columns, and the mode buckets.
STAGES = {
    "total": "total_duration_seconds",
    "ingest": "ingest_duration_seconds",
    "agent_setup": "agent_setup_duration_seconds",
    "signal": "signal_duration_seconds",
    "persistence": "persistence_duration_seconds",
    "visibility": "visibility_duration_seconds",
}
MODE_BUCKETS = ("fully_live", "partial_fallback", "fully_fallback")
STATISTICS = ("mean", "std", "median", "min", "max", "p95")


def mode_class(news_fallback: Column, price_fallback: Column, success: Column) -> Column:
    news, price = F.coalesce(news_fallback, F.lit(False)), F.coalesce(price_fallback, F.lit(False))
    return (
        F.when(~F.coalesce(success, F.lit(False)), "failed")
        .when(news & price, "fully_fallback")
        .when(news | price, "partial_fallback")
        .otherwise("fully_live")
    )


def shape_trials(results: DataFrame) -> DataFrame:
    """Flatten nested run results into trial rows; absent durations become 0.0.

    Input columns: trial, system_name, success, error, provider_requested, symbol,
    timings (struct of durations), news_meta and price_meta (struct mode, fallback_used).
    """
    duration = lambda name: F.coalesce(F.col("timings")[name].cast("double"), F.lit(0.0)).alias(name)
    fallback = lambda meta: F.coalesce(F.col(meta)["fallback_used"], F.lit(False))
    ok = F.col("error").isNull() & F.coalesce("success", F.lit(True))
    return results.select(
        "trial",
        "system_name",
        ok.alias("success"),
        F.coalesce("error", F.lit("")).alias("error"),
        "provider_requested",
        "symbol",
        duration("shared_input_capture_duration_seconds"),
        *[duration(column) for column in STAGES.values()],
        F.coalesce(F.col("news_meta")["mode"], F.lit("unknown")).alias("news_mode"),
        F.coalesce(F.col("price_meta")["mode"], F.lit("unknown")).alias("price_mode"),
        fallback("news_meta").alias("news_fallback_used"),
        fallback("price_meta").alias("price_fallback_used"),
        mode_class(fallback("news_meta"), fallback("price_meta"), ok).alias("mode_classification"),
    )


def stage_rows(trials: DataFrame, keep: list[str]) -> DataFrame:
    """One row per successful trial and stage."""
    renamed = trials.filter("success").select(*keep, *[F.col(c).alias(s) for s, c in STAGES.items()])
    return renamed.unpivot(keep, list(STAGES), "stage", "seconds")


def _as_seconds(summary: DataFrame, keys: list[str]) -> DataFrame:
    return summary.select(*keys, *[F.col(s).alias(f"{s}_seconds") for s in STATISTICS])


def stage_statistics(trials: DataFrame) -> DataFrame:
    summary = exact_summary(stage_rows(trials, ["system_name"]), ["system_name", "stage"], "seconds")
    return _as_seconds(summary, ["system_name", "stage"])


def scope_summary(trials: DataFrame) -> DataFrame:
    """system x {overall, each mode} x stage, zero where a bucket has no successful trial.

    ``overall`` counts every trial, the mode buckets count successful ones.
    """
    scopes = F.array(F.lit("overall"), F.col("mode_classification"))
    scoped = stage_rows(trials, ["system_name", "mode_classification"]).select(
        "system_name", F.explode(scopes).alias("scope"), "stage", "seconds"
    )
    stats = exact_summary(scoped, ["system_name", "scope", "stage"], "seconds")

    totals = trials.groupBy("system_name").agg(
        F.count(F.lit(1)).alias("overall"),
        *[F.count_if(F.col("success") & (F.col("mode_classification") == m)).alias(m) for m in MODE_BUCKETS],
    )
    counted = totals.unpivot(["system_name"], ["overall", *MODE_BUCKETS], "scope", "trial_count")
    grid = counted.withColumn("stage", F.explode(F.array(*[F.lit(s) for s in STAGES])))
    return grid.join(stats, ["system_name", "scope", "stage"], "left").select(
        "system_name", "scope", "stage", "trial_count",
        *[F.coalesce(s, F.lit(0.0)).alias(f"{s}_seconds") for s in STATISTICS],
    )


def system_counts(trials: DataFrame) -> DataFrame:
    ok = F.col("success")
    return trials.groupBy("system_name").agg(
        F.count(F.lit(1)).alias("trial_count"),
        F.count_if(ok).alias("success_count"),
        F.count_if(~ok).alias("failure_count"),
        *[F.count_if(ok & (F.col("mode_classification") == m)).alias(f"{m}_count") for m in MODE_BUCKETS],
    )


def comparison(trials: DataFrame, reference_system: str, order: list[str]) -> DataFrame:
    """One row: fastest system by mean total, each mean over the reference mean, distinct trials.

    Equal means are decided by position in ``order``; systems without a success do not compete.
    """
    means = [f"mean_{i}" for i in range(len(order))]
    totals = trials.agg(
        *[
            F.avg(F.when(F.col("success") & (F.col("system_name") == s), F.col(STAGES["total"]))).alias(m)
            for s, m in zip(order, means)
        ],
        F.countDistinct("trial").alias("trial_count"),
        F.count(F.lit(1)).alias("row_count"),
    )
    entries = F.array(
        *[
            F.struct(F.col(m).alias("mean"), F.lit(i).alias("place"), F.lit(s).alias("name"))
            for i, (s, m) in enumerate(zip(order, means))
        ]
    )
    base = F.nullif(means[order.index(reference_system)], F.lit(0.0))
    return totals.select(
        F.array_min(F.filter(entries, lambda e: e["mean"].isNotNull()))["name"].alias("fastest_mean_system"),
        *[
            F.coalesce(F.coalesce(F.col(m), F.lit(0.0)) / base, F.lit(0.0)).alias(f"{s}_over_{reference_system}_ratio")
            for s, m in zip(order, means)
            if s != reference_system
        ],
        "trial_count",
        "row_count",
    )


def handoff_speedup(trials: DataFrame, slow: str = "serialized", fast: str = "zero_copy") -> DataFrame:
    """Per dataset size: mean, std, median latency and mean memory of both paths, and their ratio."""
    picked = trials.filter(F.col("path").isin(slow, fast))
    latency = exact_summary(picked, ["dataset_size", "path"], "elapsed_ms")
    memory = picked.groupBy("dataset_size", "path").agg(F.avg("peak_mem_mb").alias("mem"))
    joined = latency.join(memory, ["dataset_size", "path"])
    pivoted = joined.groupBy("dataset_size").pivot("path", [slow, fast]).agg(
        F.first("mean").alias("mean_ms"),
        F.first("std").alias("std_ms"),
        F.first("median").alias("median_ms"),
        F.first("mem").alias("mean_peak_mem_mb"),
    )
    quick = F.col(f"{fast}_mean_ms")
    speedup = F.when(quick == 0, F.lit(float("inf"))).otherwise(
        F.col(f"{slow}_mean_ms") / F.nullif(quick, F.lit(0.0))
    )
    return pivoted.withColumn("speedup", speedup)


def recovery_summary(trials: DataFrame) -> DataFrame:
    """Per mode: counts and recovery-time statistics of the successful trials."""
    usable = trials.filter(F.col("success") & F.col("mttr_seconds").isNotNull())
    counts = trials.groupBy("mode").agg(
        F.count(F.lit(1)).alias("trial_count"),
        F.count_if(F.col("success") & F.col("mttr_seconds").isNotNull()).alias("success_count"),
    )
    stats = exact_summary(usable, ["mode"], "mttr_seconds")
    return counts.join(stats, "mode", "left").select(
        "mode", "trial_count", "success_count",
        (F.col("trial_count") - F.col("success_count")).alias("failure_count"),
        F.coalesce("mean", F.lit(0.0)).alias("mean_mttr_seconds"),
        F.coalesce("std", F.lit(0.0)).alias("std_mttr_seconds"),
        F.col("min").alias("min_mttr_seconds"),
        F.col("max").alias("max_mttr_seconds"),
        F.col("p95").alias("p95_mttr_seconds"),
    )


def recovery_comparison(trials: DataFrame, automatic: str, manual: str) -> DataFrame:
    usable = F.col("success") & F.col("mttr_seconds").isNotNull()
    mean = lambda mode: F.avg(F.when(usable & (F.col("mode") == mode), F.col("mttr_seconds")))
    means = trials.agg(mean(automatic).alias("a"), mean(manual).alias("m"))
    a, m = F.nullif("a", F.lit(0.0)), F.nullif("m", F.lit(0.0))
    return means.select(
        (m / a).alias("manual_over_automatic_ratio"),
        ((m - a) / m * 100.0).alias("automatic_improvement_pct"),
    )
