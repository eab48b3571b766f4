"""Service catalog and runtime state: merge, classification, reconciliation, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.numeric import first_truthy_text

# Status vocabularies.
HEALTHY = ("RUNNING", "HEALTHY")
RECOVERING = ("DEPLOYING", "UPDATING", "STARTING", "RESTARTING")
DELETING = ("DELETING", "STOPPING", "STOPPED", "DELETING_APP")
DEGRADED = ("UNHEALTHY", "DEPLOY_FAILED", "FAILED")
LIVE_STATES = ("ready", "degraded", "recovering")
SUMMARY_STATES = ("ready", "degraded", "missing", "recovering", "offline", "stale", "unknown")
RECOVERY_WINDOW_SECONDS = 60
PASSTHROUGH_FIELDS = (
    "capabilities", "capability_specs", "metadata", "deployment_metadata", "runtime_source",
    "runtime_namespace", "route_prefix", "registered_at", "last_seen_at", "last_heartbeat_at",
)


def is_alive(desired: Column, observed: Column, health: Column) -> Column:
    return (
        (F.coalesce(desired, F.lit("")) == "running")
        & F.coalesce(observed, F.lit("unknown")).isin(*LIVE_STATES)
        & (F.coalesce(health, F.lit("unknown")) != "offline")
    )


def legacy_status(observed: Column) -> Column:
    return (
        F.when(observed.isin(*LIVE_STATES), "alive")
        .when(observed == "stale", "stale")
        .when(observed.isin("missing", "offline"), "offline")
        .otherwise("unknown")
    )


def states_from_legacy(status: Column, health: Column) -> tuple[Column, Column]:
    """Observed status and health implied by a legacy status; unlisted ones pass through."""
    observed = F.when(status == "alive", "ready").otherwise(status)
    implied = (
        F.when(status == "alive", "healthy")
        .when(status == "stale", "degraded")
        .when(status == "offline", "offline")
        .otherwise(health)
    )
    return observed, implied


def merge_catalog_runtime(catalog: DataFrame, runtime: DataFrame) -> DataFrame:
    """Full outer merge by trimmed name: runtime wins for class, capabilities and alive."""
    named = lambda df: df.withColumn("name", F.trim("name")).filter(F.col("name") != "")
    c = named(catalog).withColumn("in_catalog", F.lit(True)).alias("c")
    r = named(runtime).withColumn("in_runtime", F.lit(True)).alias("r")
    both = c.join(r, F.col("c.name") == F.col("r.name"), "full_outer")
    return both.select(
        F.coalesce("c.name", "r.name").alias("name"),
        F.coalesce(
            first_truthy_text(F.col("r.class_name"), F.col("c.class_name")), F.lit("")
        ).alias("class_name"),
        F.coalesce(
            first_truthy_text(F.col("r.capabilities"), F.col("c.capabilities")), F.lit("")
        ).alias("capabilities"),
        "c.desired_status",
        "c.observed_status",
        "c.health_status",
        F.coalesce("r.alive", "c.alive", F.lit(False)).alias("alive"),
        F.when(F.col("in_catalog") & F.col("in_runtime"), "catalog+runtime")
        .when(F.col("in_runtime"), "runtime")
        .otherwise("catalog")
        .alias("source"),
    )


def overlay_live(catalog: DataFrame, live: DataFrame, now: str) -> DataFrame:
    """Catalog rows with live values laid over them, plus live rows the catalog does not know.

    Ten descriptive fields come from the live side when present there; control
    fields stay with the catalog. ``now`` is the observation time given to live rows.
    """
    live = live.withColumn("name", F.trim("name")).filter(F.col("name") != "")
    c, r = catalog.alias("c"), live.alias("r")

    def field(name: str) -> Column:
        sides = [f"{side}.{name}" for side, df in (("r", live), ("c", catalog)) if name in df.columns]
        return F.coalesce(*sides).alias(name)

    known = c.join(r, F.col("c.name") == F.col("r.name"), "left").select(
        F.col("c.name").alias("name"),
        *[field(f) for f in PASSTHROUGH_FIELDS if f in catalog.columns or f in live.columns],
        "c.desired_status",
        "c.observed_status",
        "c.health_status",
        first_truthy_text(F.col("c.status"), F.when(F.col("r.alive"), "alive"), F.lit("unknown")).alias("status"),
        F.when(F.col("r.name").isNotNull(), is_alive(
            F.col("c.desired_status"), F.col("c.observed_status"), F.col("c.health_status")
        )).otherwise(F.coalesce("c.alive", F.lit(False))).alias("alive"),
        F.when(F.col("r.name").isNotNull(), "catalog+runtime").otherwise("catalog").alias("source"),
    )
    up = F.coalesce("alive", F.lit(False))
    unknown = live.join(catalog.select("name"), "name", "left_anti").select(
        "name",
        *[
            (
                F.coalesce(f, F.concat(F.lit("/"), "name")) if f == "route_prefix"
                else F.coalesce(f, F.lit(now).cast(live.schema[f].dataType)) if f in ("last_seen_at", "last_heartbeat_at")
                else F.col(f)
            ).alias(f)
            for f in PASSTHROUGH_FIELDS if f in live.columns
        ],
        F.lit("running").alias("desired_status"),
        F.when(up, "ready").otherwise("unknown").alias("observed_status"),
        F.when(up, "healthy").otherwise("unknown").alias("health_status"),
        F.when(up, "alive").otherwise("unknown").alias("status"),
        up.alias("alive"),
        F.lit("runtime").alias("source"),
    )
    return known.unionByName(unknown, allowMissingColumns=True)


def alive_replicas(actors: DataFrame) -> DataFrame:
    """Live replicas per application; actors without an application are skipped."""
    app = F.trim(F.coalesce("app_name", F.lit("")))
    return (
        actors.filter((F.upper("state") == "ALIVE") & (app != ""))
        .groupBy(app.alias("name"))
        .agg(F.count(F.lit(1)).alias("alive_replicas"))
    )


def actor_state_counts(actors: DataFrame) -> DataFrame:
    return actors.agg(
        F.count_if(F.col("state") == "ALIVE").alias("alive"),
        F.count_if(F.col("state") == "DEAD").alias("dead"),
    )


def replica_totals(replicas: DataFrame) -> DataFrame:
    """Running and not-running replicas per application from (name, state) rows."""
    state = F.upper(F.trim("state"))
    return (
        replicas.filter(state != "")
        .groupBy("name")
        .agg(
            F.count_if(state.isin(*HEALTHY)).alias("running"),
            F.count_if(~state.isin(*HEALTHY)).alias("unhealthy"),
        )
    )


def classify_applications(apps: DataFrame, actors_alive: DataFrame) -> DataFrame:
    """Observed status, health and recovery state of each application.

    ``apps``: name, app_status, deployment_states (array), running, unhealthy.
    ``actors_alive``: name, alive_replicas. The rules apply in the order listed.
    """
    joined = apps.join(actors_alive, "name", "left").withColumn(
        "alive_replicas", F.coalesce("alive_replicas", F.lit(0))
    )
    status = F.upper(F.trim(F.coalesce("app_status", F.lit(""))))
    states = F.coalesce("deployment_states", F.array().cast("array<string>"))

    def any_in(tokens: tuple[str, ...]) -> Column:
        return status.isin(*tokens) | F.exists(states, lambda s: F.upper(s).isin(*tokens))

    flagged = joined.select(
        "name", status.alias("app_status"), "running", "unhealthy", "alive_replicas",
        any_in(RECOVERING).alias("is_recovering"),
        any_in(DELETING).alias("is_deleting"),
        any_in(DEGRADED).alias("is_degraded"),
        status.isin(*HEALTHY, *RECOVERING, "").alias("status_ok"),
    )
    running, alive = F.col("running"), F.col("alive_replicas")
    effective = (
        F.when((running > 0) & F.col("status_ok"), running)
        .when(running > 0, F.least(running, alive))
        .otherwise(alive)
    )
    flagged = flagged.withColumn("running_replicas", effective)
    up = F.col("running_replicas") > 0
    rules = [
        (F.col("is_deleting"), ("missing", "offline", "idle", "being deleted or stopped")),
        (F.col("is_recovering") & ~up, ("recovering", "degraded", "recovering", None)),
        (
            up & ((F.col("unhealthy") > 0) | F.col("is_recovering") | F.col("is_degraded")),
            ("degraded", "degraded", "idle", None),
        ),
        (up & F.col("status_ok"), ("ready", "healthy", "idle", None)),
        (
            (running > 0) & (alive <= 0) & ~F.col("is_recovering"),
            ("missing", "offline", "idle", "reported without live replicas"),
        ),
        (F.col("is_degraded"), ("degraded", "degraded", "failed", "reported in a degraded state")),
    ]
    default = ("unknown", "unknown", "idle", None)

    def pick(position: int) -> Column:
        chosen = None
        for condition, values in rules:
            value = F.lit(values[position]).cast("string")
            chosen = F.when(condition, value) if chosen is None else chosen.when(condition, value)
        return chosen.otherwise(F.lit(default[position]).cast("string"))

    return flagged.select(
        "name", "app_status", "running_replicas",
        F.col("running").alias("reported_running_replicas"),
        "alive_replicas",
        F.col("unhealthy").alias("unhealthy_replicas"),
        pick(0).alias("observed_status"),
        pick(1).alias("health_status"),
        pick(2).alias("recovery_state"),
        F.when(
            pick(3).isNotNull(), F.concat(F.lit("Application '"), "name", F.lit("' is "), pick(3), F.lit("."))
        ).alias("failure_reason"),
    )


# What a respawn needs to bring back the same deployment.
IDENTITY_COLUMNS = ("route_prefix", "runtime_namespace", "deployment_metadata")

# Notes on where a reconciled state comes from, in this library's own words.
NOTES = {
    "catalog": "runtime not reachable, state kept from the catalog",
    "stopped": "not meant to run",
    "live": "taken from the live application",
    "started": "recovery was started earlier",
    "absent": "expected, but not there",
    "waiting": "respawn is still inside its window",
    "expired": "respawn ran out of its window, a new decision may be made",
}


def in_recovery_window(reconciled_ms: Column, now_ms: Column, seconds: int = RECOVERY_WINDOW_SECONDS) -> Column:
    """True while the last reconciliation is at most ``seconds`` old; unknown times are outside."""
    if seconds <= 0:
        return F.lit(False)
    return F.coalesce(now_ms - reconciled_ms <= seconds * 1000, F.lit(False))


def reconcile(
    catalog: DataFrame,
    app_state: DataFrame,
    now_ms: Column,
    runtime_available: bool = True,
    window_seconds: int = RECOVERY_WINDOW_SECONDS,
) -> DataFrame:
    """Desired state (catalog) against observed state (applications), one row per deployment.

    A respawn that was started recently keeps its deployment ``recovering`` until it
    is ready or the recovery window has passed; after that it is ``failed``. The
    live application's route prefix counts before the catalog's; the namespace and
    metadata that a respawn needs are carried along, null where the catalog has none.
    """
    optional = lambda df, name: F.col(name) if name in df.columns else F.lit(None).cast("string")
    identity = [optional(catalog, c).alias(c) for c in IDENTITY_COLUMNS]
    catalog = catalog.withColumn("name", F.trim(first_truthy_text(F.col("app_name"), F.col("name"))))
    c = catalog.alias("c")
    a = app_state.select(
        F.col("name").alias("app"),
        F.coalesce("observed_status", F.lit("unknown")).alias("app_observed"),
        F.coalesce("health_status", F.lit("unknown")).alias("app_health"),
        F.coalesce("recovery_state", F.lit("idle")).alias("app_recovery"),
        F.col("failure_reason").alias("app_reason"),
        F.coalesce("running_replicas", F.lit(0)).alias("alive_count"),
        F.coalesce("unhealthy_replicas", F.lit(0)).alias("dead_count"),
        optional(app_state, "route_prefix").alias("app_prefix"),
    )
    rows = c.join(a, F.col("c.name") == F.col("app"), "left").select(
        "c.name",
        F.coalesce("managed", F.lit(True)).alias("managed"),
        first_truthy_text(F.col("desired_status"), F.lit("running")).alias("desired_status"),
        first_truthy_text(F.col("observed_status"), F.lit("unknown")).alias("was_observed"),
        first_truthy_text(F.col("health_status"), F.lit("unknown")).alias("was_health"),
        first_truthy_text(F.col("recovery_state"), F.lit("idle")).alias("was_recovery"),
        F.lower(F.trim(F.coalesce("last_action_type", F.lit("")))).alias("was_action"),
        F.col("last_failure_reason").alias("was_reason"),
        in_recovery_window(F.col("last_reconciled_ms"), now_ms, window_seconds).alias("in_window"),
        "app", "app_observed", "app_health", "app_recovery", "app_reason",
        F.coalesce("alive_count", F.lit(0)).alias("alive_count"),
        F.coalesce("dead_count", F.lit(0)).alias("dead_count"),
        "app_prefix", *identity,
    )
    has_app = F.col("app").isNotNull()
    absent = F.concat(F.lit("Deployment '"), F.col("name"), F.lit("' is absent from live state."))
    none = F.lit(None).cast("string")

    if runtime_available:
        # (condition, observed, health, recovery, reason, note) in order of precedence
        cases = [
            (F.col("desired_status") != "running", F.lit("offline"), F.lit("offline"), F.lit("idle"), none, F.lit(NOTES["stopped"])),
            (
                has_app,
                F.col("app_observed"), F.col("app_health"), F.col("app_recovery"), F.col("app_reason"), F.lit(NOTES["live"]),
            ),
            (
                F.col("was_recovery") == "recovering",
                F.lit("recovering"), F.lit("degraded"), F.lit("recovering"), none, F.lit(NOTES["started"]),
            ),
            (F.lit(True), F.lit("missing"), F.lit("offline"), F.lit("idle"), absent, F.lit(NOTES["absent"])),
        ]
    else:
        health = F.when(F.col("was_health") != "unknown", F.col("was_health")).otherwise("degraded")
        cases = [(F.lit(True), F.col("was_observed"), health, F.col("was_recovery"), F.col("was_reason"), F.lit(NOTES["catalog"]))]

    def by_case(position: int) -> Column:
        chosen = None
        for case in cases:
            value = case[position]
            chosen = F.when(case[0], value) if chosen is None else chosen.when(case[0], value)
        return chosen

    base = rows.select(
        "*", by_case(1).alias("obs"), by_case(2).alias("hea"), by_case(3).alias("rec"), by_case(4).alias("rea"),
        by_case(5).alias("note"),
    )
    respawning = (F.col("was_recovery") == "recovering") & (F.col("was_action") == "respawn") & (F.col("obs") != "ready")
    holding, expired = respawning & F.col("in_window"), respawning & ~F.col("in_window")
    late_observed = F.when(
        F.col("obs").isin("recovering", "unknown", "stale"), F.when(has_app, "degraded").otherwise("missing")
    ).otherwise(F.col("obs"))
    late_health = F.when(late_observed.isin("missing", "offline"), "offline").otherwise("degraded")
    timed_out = F.concat(F.lit("'"), F.col("name"), F.lit("' was started again and did not come back in time."))

    def settled(hold: Column, late: Column, otherwise: str) -> Column:
        return F.when(holding, hold).when(expired, late).otherwise(F.col(otherwise))

    final = base.select(
        "name", "managed", "desired_status",
        settled(F.lit("recovering"), late_observed, "obs").alias("observed_status"),
        settled(F.lit("degraded"), late_health, "hea").alias("health_status"),
        settled(F.lit("recovering"), F.lit("failed"), "rec").alias("recovery_state"),
        settled(none, first_truthy_text(F.col("rea"), timed_out), "rea").alias("last_failure_reason"),
        settled(F.lit(NOTES["waiting"]), F.lit(NOTES["expired"]), "note").alias("reconcile_notes"),
        F.coalesce(first_truthy_text(F.col("app_prefix")), F.col("route_prefix")).alias("route_prefix"),
        *[c for c in IDENTITY_COLUMNS if c != "route_prefix"],
        "alive_count", "dead_count",
    )
    return final.withColumn(
        "alive", is_alive(F.col("desired_status"), F.col("observed_status"), F.col("health_status"))
    )


def status_summary(deployments: DataFrame) -> DataFrame:
    """Total, managed and one count per known state, in one row."""
    observed = F.coalesce("observed_status", F.lit("unknown"))
    return deployments.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.coalesce("managed", F.lit(False))).alias("managed"),
        *[F.count_if(observed == s).alias(s) for s in SUMMARY_STATES],
    )


def fleet_health(deployments: DataFrame, runtime_available: bool = True) -> DataFrame:
    """Healthy when every managed deployment that should run is ready."""
    relevant = F.coalesce("managed", F.lit(False)) & (F.coalesce("desired_status", F.lit("")) == "running")
    ready = F.coalesce("observed_status", F.lit("unknown")) == "ready"
    return deployments.agg(
        (F.coalesce(F.bool_and(~relevant | ready), F.lit(True)) & F.lit(runtime_available)).alias("healthy"),
        F.count_if(relevant & ~ready).alias("not_ready"),
    )


def snapshot_health(services: DataFrame) -> DataFrame:
    """healthy / degraded over the service rows of the newest snapshot; unknown without any."""
    newest = services.groupBy("snapshot_ts").agg(F.bool_and("healthy").alias("ok"), F.count(F.lit(1)).alias("services"))
    return newest.agg(
        F.when(F.count(F.lit(1)) == 0, "unknown")
        .when(F.max_by("ok", "snapshot_ts"), "healthy")
        .otherwise("degraded")
        .alias("status"),
        F.max("snapshot_ts").alias("snapshot_ts"),
        F.coalesce(F.max_by("services", "snapshot_ts"), F.lit(0)).alias("services"),
    )


def capability_tokens(capabilities: DataFrame) -> DataFrame:
    """Adds the lower-cased set of names (id and aliases) a capability answers to."""
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    return capabilities.withColumn(
        "tokens",
        F.array_distinct(F.transform(F.concat(F.array("id"), aliases), lambda t: F.lower(F.trim(t)))),
    )


def match_capabilities(
    capabilities: DataFrame,
    capability: str | None = None,
    required_tags: list[str] | None = None,
    interaction_mode: str | None = None,
    input_type: str | None = None,
    output_type: str | None = None,
    alive_only: bool = True,
) -> DataFrame:
    """Capability rows that meet every given constraint; no constraint keeps all rows."""
    tags = sorted({t.strip().lower() for t in required_tags or [] if t.strip()})
    rows = capability_tokens(capabilities)
    conditions = []
    if alive_only:
        conditions.append(F.col("alive"))
    if capability:
        conditions.append(F.array_contains("tokens", capability.strip().lower()))
    for column, wanted in (
        ("interaction_mode", interaction_mode), ("input_type", input_type), ("output_type", output_type)
    ):
        if wanted:
            conditions.append(F.lower(F.coalesce(column, F.lit(""))) == wanted.strip().lower())
    if tags:
        wanted_tags = F.array(*[F.lit(t) for t in tags])
        conditions.append(F.size(F.array_except(wanted_tags, F.col("tags"))) == 0)
    for condition in conditions:
        rows = rows.filter(condition)
    return rows


def matching_agents(
    agents: DataFrame,
    capabilities: DataFrame,
    capability: str | None = None,
    required_tags: list[str] | None = None,
    interaction_mode: str | None = None,
    input_type: str | None = None,
    output_type: str | None = None,
    alive_only: bool = True,
) -> DataFrame:
    """Agents (``agent``, ``alive``) with the capability rows that meet every given constraint, one row each.

    Without a constraint every agent is listed with all its capabilities, and one that has none with nulls.
    """
    wanted = agents.filter("alive") if alive_only else agents
    own = capabilities.drop("alive")
    constraints = dict(
        capability=capability, required_tags=required_tags, interaction_mode=interaction_mode,
        input_type=input_type, output_type=output_type,
    )
    if any(constraints.values()):
        return wanted.join(match_capabilities(own, **constraints, alive_only=False), "agent")
    return wanted.join(capability_tokens(own), "agent", "left")


def normalize_capabilities(entries: DataFrame) -> DataFrame:
    """Plain names or records become one 7-field capability; entries without an id are dropped.

    Input: agent, position, entry (string holding a JSON record or a plain name).
    """
    record = F.from_json(
        "entry",
        "id string, name string, description string, tags array<string>, aliases array<string>, "
        "input_type string, output_type string, interaction_mode string",
    )
    is_record = F.startswith(F.trim("entry"), F.lit("{"))
    parsed = entries.withColumn("r", F.when(is_record, record))
    words = lambda c: F.filter(
        F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda t: F.lower(F.trim(t))), lambda t: t != ""
    )
    ident = F.trim(
        F.when(is_record, first_truthy_text(F.col("r.id"), F.col("r.name"))).otherwise(F.col("entry"))
    )
    return (
        parsed.withColumn("id", ident)
        .filter(F.col("id") != "")
        .select(
            "agent", "position", "id",
            F.coalesce(first_truthy_text(F.col("r.description")), F.col("id")).alias("description"),
            words(F.col("r.tags")).alias("tags"),
            words(F.col("r.aliases")).alias("aliases"),
            F.col("r.input_type").alias("input_type"),
            F.col("r.output_type").alias("output_type"),
            F.coalesce(first_truthy_text(F.col("r.interaction_mode")), F.lit("invoke")).alias("interaction_mode"),
        )
    )


def first_capability(capabilities: DataFrame) -> DataFrame:
    """First entry per agent and lower-cased id (an aggregate, so a hot agent is combined map-side)."""
    payload = [c for c in capabilities.columns if c not in ("agent",)]
    return (
        capabilities.groupBy("agent", F.lower("id").alias("id_key"))
        .agg(F.min_by(F.struct(*payload), "position").alias("first"))
        .select("agent", "first.*")
    )


def capability_statistics(capabilities: DataFrame) -> DataFrame:
    alive = F.col("alive")
    return capabilities.agg(
        F.countDistinct(F.when(alive, F.lower("id"))).alias("live_capabilities"),
        F.countDistinct(F.when(alive, F.col("agent"))).alias("live_agents"),
        F.countDistinct("agent").alias("agents"),
        F.count(F.lit(1)).alias("registrations"),
    )


def effective_permissions(role_grants: DataFrame, role_policies: DataFrame, policy_permissions: DataFrame) -> DataFrame:
    """Distinct (user, permission) pairs reached through roles and policies.

    Duplicates are removed after each step, so the joins carry distinct keys only.
    """
    by_role = (
        role_policies.join(policy_permissions, "policy").select("role", "permission").distinct()
    )
    return role_grants.distinct().join(by_role, "role").select("user_id", "permission").distinct()


def authorized(role_grants: DataFrame, role_policies: DataFrame, policy_permissions: DataFrame, permission: str) -> DataFrame:
    """Users holding one permission (semi joins, no duplicates to remove later)."""
    policies = policy_permissions.filter(F.col("permission") == permission)
    roles = role_policies.join(policies, "policy", "left_semi").select("role")
    return role_grants.join(roles, "role", "left_semi").select("user_id").distinct()

