"""Operational rules: lag, CPU, staleness and healing produce action rows; actions become alert rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.numeric import first_truthy_text
from tidewater.operators.cooldown import mark_fired

# Thresholds and step counts.
LAG_SCALE_UP = 500
LAG_IDLE = 0
LAG_UP_COUNT = 2
MIN_ALIVE_FOR_LAG_SCALE_DOWN = 2
CPU_SCALE_UP = 85.0
CPU_SCALE_DOWN = 20.0
STALE_SECONDS = 300
COOLDOWN_MS = 120_000

ACTION_COLUMNS = "action string, target string, agent string, deployment_name string, count int, reason string"


def partition_lag(high: Column, committed: Column) -> Column:
    """Messages behind; a negative committed offset (none yet) counts as zero."""
    return F.greatest(high - F.greatest(committed, F.lit(0)), F.lit(0))


def lag_by_topic(offsets: DataFrame) -> DataFrame:
    return offsets.groupBy("topic").agg(F.sum(partition_lag(F.col("high"), F.col("committed"))).alias("lag"))


def lag_totals(offsets: DataFrame) -> DataFrame:
    """Total lag and the topic that is furthest behind (equal lags: first by name)."""
    topics = lag_by_topic(offsets)
    order = F.struct(-F.col("lag"), F.col("topic"))
    return topics.agg(
        F.coalesce(F.sum("lag"), F.lit(0)).cast("bigint").alias("total_lag"),
        F.coalesce(F.min_by("topic", order), F.lit("unknown")).alias("worst_topic"),
        F.min_by("lag", order).alias("worst_lag"),
    )


def lag_actions(
    totals: DataFrame, alive: Column, agent: str, step: int = LAG_UP_COUNT, healthy: Column | None = None
) -> DataFrame:
    """Scale up above the lag limit, scale down when nothing waits and more than two are alive.

    ``totals`` has one row per checked group; ``alive`` is a column of it or a literal. ``healthy`` tells whether
    the service that reports the lag is well: where it is false or null (the service is missing), nothing is done.
    """
    if healthy is not None:
        totals = totals.filter(F.coalesce(healthy, F.lit(False)))
    total = F.col("total_lag")
    up = total > LAG_SCALE_UP
    down = (total <= LAG_IDLE) & (alive > MIN_ALIVE_FOR_LAG_SCALE_DOWN)
    return totals.filter(up | down).select(
        F.when(up, "scale_up").otherwise("scale_down").alias("action"),
        F.lit("runtime").alias("target"),
        F.lit(agent).alias("agent"),
        F.lit("").alias("deployment_name"),
        F.when(up, step).otherwise(1).alias("count"),
        F.when(
            up,
            F.format_string(
                "%d messages wait, most of them (%d) in %s; more than " + str(LAG_SCALE_UP) + " ask for another agent.",
                total, F.coalesce("worst_lag", total), F.col("worst_topic"),
            ),
        )
        .otherwise(F.format_string("Lag is %d and %d agents are alive. Scaling down.", total, alive.cast("bigint")))
        .alias("reason"),
    )


def cpu_percent(used: Column, total: Column) -> Column:
    """Share of CPU in use; absent values mean 0 used of 1, text that is no number gives null."""
    number = lambda c, default: F.when(c.isNull(), F.lit(default)).otherwise(c.try_cast("double"))
    return number(used, 0.0) / F.nullif(number(total, 1.0), F.lit(0.0)) * 100.0


def cpu_actions(clusters: DataFrame, agent: str) -> DataFrame:
    """``clusters``: cluster, cpu_used, cpu_total (text), alive."""
    percent = cpu_percent(F.col("cpu_used"), F.col("cpu_total"))
    rows = clusters.withColumn("percent", percent)
    up = F.col("percent") > CPU_SCALE_UP
    down = (F.col("percent") < CPU_SCALE_DOWN) & (F.col("alive") > 1)
    return rows.filter(up | down).select(
        "cluster",
        F.when(up, "scale_up").otherwise("scale_down").alias("action"),
        F.lit("runtime").alias("target"),
        F.lit(agent).alias("agent"),
        F.lit("").alias("deployment_name"),
        F.lit(1).alias("count"),
        F.when(up, F.format_string("CPU is at %.1f%%, scaling up.", F.col("percent")))
        .otherwise(F.format_string("CPU is low at %.1f%% with %d alive, scaling down.", F.col("percent"), F.col("alive")))
        .alias("reason"),
    )


def commit_times(spark: SparkSession, tables: dict[str, str], service: str = "lake") -> DataFrame:
    """service, table_name, latest_commit_ms and error of stored tables, from the times of their files.

    No column is read. A table that cannot be read has its error's first line, a table without files no commit.
    """
    known, failed = [], []
    for name, path in tables.items():
        try:
            files = spark.read.parquet(path).select(F.unix_millis("_metadata.file_modification_time").alias("ms"))
            known.append(files.agg(F.max("ms").alias("latest_commit_ms")).withColumn("table_name", F.lit(name)))
        except AnalysisException as exc:
            failed.append((name, str(exc).splitlines()[0]))
    columns = "service string, table_name string, latest_commit_ms bigint, error string"
    out = spark.createDataFrame([(service, name, None, error) for name, error in failed], columns)
    for table in known:
        out = out.unionByName(table.select(F.lit(service).alias("service"), "table_name", "latest_commit_ms", F.lit(None).cast("string").alias("error")))
    return out


def staleness_actions(tables: DataFrame, now_ms: Column, limit_seconds: int = STALE_SECONDS) -> DataFrame:
    """Alert for every table whose last commit is older than the limit.

    Tables with an error or without any commit are left out.
    """
    age = (now_ms - F.col("latest_commit_ms")) / 1000.0
    known = F.col("error").isNull() & (F.coalesce("latest_commit_ms", F.lit(0)) != 0)
    return tables.filter(known & (age > limit_seconds)).select(
        F.lit("alert").alias("action"),
        F.lit("webhook").alias("target"),
        F.concat(F.col("service"), F.lit("/"), F.col("table_name")).alias("agent"),
        F.lit("").alias("deployment_name"),
        F.lit(1).alias("count"),
        F.format_string(
            "%s got no commit for %.1f seconds; at most " + str(limit_seconds) + " are allowed.",
            F.col("table_name"), age,
        ).alias("reason"),
    )


def healing_actions(deployments: DataFrame, managed_classes: DataFrame) -> DataFrame:
    """Respawn what is missing or offline, alert on what is degraded.

    Only managed, served deployments that should run and are not yet recovering;
    ``managed_classes`` has one column ``class_name``. Actions carry the identity that
    a respawn restores: namespace, route prefix (the name's own by default) and metadata.
    """
    for name in ("runtime_namespace", "route_prefix", "deployment_metadata"):
        if name not in deployments.columns:
            deployments = deployments.withColumn(name, F.lit(None).cast("string"))
    eligible = deployments.withColumn("class_name", F.trim(F.coalesce("class_name", F.lit("")))).filter(
        F.coalesce("managed", F.lit(False))
        & (F.col("desired_status") == "running")
        & (F.lower(F.trim(first_truthy_text(F.col("replication_mode"), F.lit("serve")))) == "serve")
        & (F.coalesce("recovery_state", F.lit("idle")) != "recovering")
        & (F.trim(F.coalesce("name", F.lit(""))) != "")
        & (F.col("class_name") != "")
    )
    owned = eligible.join(managed_classes, "class_name", "left_semi")
    gone = F.coalesce("observed_status", F.lit("unknown")).isin("missing", "offline")
    weak = (F.col("observed_status") == "degraded") | (F.col("health_status") == "degraded")
    return owned.filter(gone | F.coalesce(weak, F.lit(False))).select(
        F.when(gone, "respawn").otherwise("alert").alias("action"),
        F.when(gone, "runtime").otherwise("alert").alias("target"),
        F.col("class_name").alias("agent"),
        F.col("name").alias("deployment_name"),
        F.coalesce("runtime_namespace", F.lit("")).alias("runtime_namespace"),
        first_truthy_text(F.col("route_prefix"), F.concat(F.lit("/"), "name")).alias("route_prefix"),
        F.coalesce("deployment_metadata", F.lit("{}")).alias("deployment_metadata"),
        F.lit(1).alias("count"),
        first_truthy_text(
            F.col("last_failure_reason"),
            F.when(gone, F.format_string("'%s' is %s and will be brought back as it was.", "name", "observed_status"))
            .otherwise(F.format_string("'%s' is degraded, please look at it.", "name")),
        ).alias("reason"),
    )


def cooldown_scope() -> Column:
    """What a cooldown is keyed on: deployment, else class, else target."""
    return first_truthy_text(F.col("deployment_name"), F.col("agent"), F.col("target"))


def with_cooldown(actions: DataFrame, cooldown_ms: int = COOLDOWN_MS) -> DataFrame:
    """Mark the actions that fire. Input needs ``ts_ms`` and ``id``; respawns are exempt."""
    keyed = actions.withColumn("cooldown_key", F.concat(F.col("action"), F.lit(":"), cooldown_scope()))
    return mark_fired(
        keyed, "cooldown_key", "ts_ms", "id", cooldown_ms, exempt=F.col("action") == "respawn"
    )


def alert_rows(actions: DataFrame) -> DataFrame:
    """Alert log rows from executed actions with ``success``, ``detail`` and ``error``."""
    ok = F.coalesce("success", F.lit(True))
    level = (
        F.when(~ok, "error")
        .when(F.col("action").isin("respawn", "alert", "circuit_break"), "warning")
        .otherwise("info")
    )
    kept = [c for c in actions.columns if c not in ("success", "detail", "error", "target")]
    return actions.select(
        *kept,
        level.alias("level"),
        F.when(ok, "succeeded").otherwise("failed").alias("status"),
        first_truthy_text(F.col("detail"), F.col("error"), F.col("reason")).alias("detail"),
        first_truthy_text(F.col("deployment_name"), F.col("target")).alias("target"),
    )


Rule = Callable[[dict[str, DataFrame]], DataFrame]


class RuleBook:
    """User rules: functions from named input tables to action rows.

    A rule that fails to build is recorded and left out; the others still run.
    """

    def __init__(self) -> None:
        self._rules: dict[str, Rule] = {}
        self.failures: dict[str, str] = {}

    def register(self, name: str, rule: Rule) -> None:
        self._rules[name] = rule

    def load(self, folder: str) -> list[str]:
        """Register ``rule`` (named ``NAME`` or after its file) from every module in a folder."""
        import importlib.util
        from pathlib import Path

        loaded = []
        for path in sorted(Path(folder).glob("*.py")):
            if path.name.startswith("_"):
                continue
            try:
                spec = importlib.util.spec_from_file_location(f"rule_{path.stem}", path)
                module = importlib.util.module_from_spec(spec)
                spec.loader.exec_module(module)
                name = getattr(module, "NAME", path.stem)
                self.register(name, module.rule)
                loaded.append(name)
            except Exception as exc:  # a broken plug-in must not stop the others
                self.failures[path.stem] = f"{type(exc).__name__}: {exc}"
        return loaded

    def evaluate(self, spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
        result = spark.createDataFrame([], f"rule string, {ACTION_COLUMNS}")
        for name, rule in self._rules.items():
            try:
                actions = rule(tables)
                shaped = actions.select(
                    F.lit(name).alias("rule"),
                    *[F.col(c.split()[0]).cast(c.split()[1]) for c in ACTION_COLUMNS.split(", ")],
                )
                result = result.unionByName(shaped)
            except Exception as exc:
                self.failures[name] = f"{type(exc).__name__}: {exc}"
        return result
