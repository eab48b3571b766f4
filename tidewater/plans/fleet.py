"""Registered joins, reconciliation, rules, and operational-table changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import cooldown, documents, fleet, listing, mutation, rules
from tidewater.plans.inputs import (
    APPLICATIONS, CATALOG, NOW_MS, REPLICAS, RUNTIME, applications, catalog, replicas, runtime,
)
from tidewater.plans.projections import PAGE_TEXT
from tidewater.plans.registry import query, r
from tidewater.session import table
from tidewater.sinks.lake import skip_conflicts

ALIVE = "observed_status IN ('ready', 'degraded', 'recovering') AND health_status <> 'offline'"

# --- joins ------------------------------------------------------------------------------------------


@query(
    "j01_orders_customers",
    "SELECT o_orderkey, o_custkey AS customer_id, c_name, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey",
)
def orders_customers(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "customer_id")
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "customer_id")
    return orders.join(customers, "customer_id").select("o_orderkey", "customer_id", "c_name", "c_mktsegment", "o_totalprice")


@query(
    "j02_articles_with_pages",
    rf"""WITH texts AS ({PAGE_TEXT}), p AS (SELECT page_id, regexp_extract(url, '([^/?#]+)/?([?#].*)?$', 1) AS page_key, url, t.page_text FROM pages JOIN texts t USING (page_id)),
    first AS (SELECT page_key, min(url) AS path, arg_min(page_text, url) AS page_text FROM p GROUP BY 1)
    SELECT d.doc_id, d.source, CAST(d.doc_id AS VARCHAR) AS page_key, f.path, md5(f.page_text) AS page_text_md5
    FROM documents d LEFT JOIN first f ON f.page_key = CAST(d.doc_id AS VARCHAR)""",
)
def articles(spark, sf_dir):
    """Documents as articles; pages are found by the last part of their address."""
    pages = table(spark, sf_dir, "pages").select(
        documents.url_key(F.col("url")).alias("page_key"), F.col("url").alias("path"), "html"
    )
    news = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("doc_id").cast("string").alias("page_key"))
    return documents.articles_with_pages(news, pages).select(
        "doc_id", "source", "page_key", "path", F.md5(F.col("page_text").cast("binary")).alias("page_text_md5")
    )


@query(
    "j03_catalog_runtime_merge",
    f"""WITH {CATALOG}, {RUNTIME}
    SELECT coalesce(c.name, r.name) AS name, coalesce(r.class_name, c.class_name, '') AS class_name,
      coalesce(r.capabilities, c.capabilities, '') AS capabilities, c.desired_status, c.observed_status, c.health_status,
      coalesce(r.alive, c.alive, FALSE) AS alive,
      CASE WHEN c.name IS NULL THEN 'runtime' WHEN r.name IS NULL THEN 'catalog' ELSE 'catalog+runtime' END AS source
    FROM (SELECT * FROM catalog WHERE runtime_source = 'serve' AND is_enabled) c FULL JOIN runtime r ON r.name = c.name""",
)
def merged(spark, sf_dir):
    known = catalog(spark, sf_dir).filter((F.col("runtime_source") == "serve") & F.col("is_enabled"))
    return fleet.merge_catalog_runtime(known, runtime(spark, sf_dir))


OVERLAY = f"""WITH {CATALOG}, {RUNTIME},
overlay AS (
  SELECT c.name, coalesce(r.capabilities, c.capabilities) AS capabilities, coalesce(r.runtime_source, c.runtime_source) AS runtime_source,
    coalesce(r.route_prefix, c.route_prefix) AS route_prefix, coalesce(r.last_seen_at) AS last_seen_at,
    c.desired_status, c.observed_status, c.health_status, c.status,
    CASE WHEN r.name IS NOT NULL THEN c.desired_status = 'running' AND c.{ALIVE.replace(' AND health', ' AND c.health')}
         ELSE c.alive END AS alive,
    CASE WHEN r.name IS NOT NULL THEN 'catalog+runtime' ELSE 'catalog' END AS source
  FROM catalog c LEFT JOIN runtime r ON r.name = c.name
  UNION ALL
  SELECT name, capabilities, runtime_source, coalesce(route_prefix, '/' || name), coalesce(last_seen_at, {NOW_MS}), 'running',
    CASE WHEN alive THEN 'ready' ELSE 'unknown' END, CASE WHEN alive THEN 'healthy' ELSE 'unknown' END,
    CASE WHEN alive THEN 'alive' ELSE 'unknown' END, alive, 'runtime'
  FROM runtime r WHERE NOT EXISTS (SELECT 1 FROM catalog c WHERE c.name = r.name))"""


def _overlay(spark, sf_dir):
    return fleet.overlay_live(catalog(spark, sf_dir), runtime(spark, sf_dir), str(NOW_MS)).select(
        "name", "capabilities", "runtime_source", "route_prefix", "last_seen_at", "desired_status", "observed_status",
        "health_status", "status", "alive", "source",
    )


@query("j04_live_overlay", f"{OVERLAY} SELECT * FROM overlay")
def overlay(spark, sf_dir):
    return _overlay(spark, sf_dir)


@query("u01_catalog_and_live_only", f"{OVERLAY} SELECT source, count(*) AS rows_, count(*) FILTER (WHERE alive) AS alive_rows FROM overlay GROUP BY source")
def overlay_counts(spark, sf_dir):
    return _overlay(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("rows_"), F.count_if("alive").alias("alive_rows"))


@query("u02_all_names", f"WITH {CATALOG}, {RUNTIME} SELECT name FROM catalog UNION SELECT name FROM runtime")
def all_names(spark, sf_dir):
    return catalog(spark, sf_dir).select("name").union(runtime(spark, sf_dir).select("name")).distinct()


ALIVE_REPLICAS = "up AS (SELECT name, count(*) AS alive_replicas FROM replicas WHERE state = 'RUNNING' AND id % 4 <> 0 GROUP BY name)"


def _actors(spark, sf_dir):
    """Replica rows as actors; every fourth running one is not seen alive, every fifth has no application."""
    reps = replicas(spark, sf_dir)
    alive = (F.col("state") == "RUNNING") & (F.col("id") % 4 != 0)
    return reps.select(
        F.when(F.col("state") == "DEAD", "DEAD").when(alive, "ALIVE").otherwise("PENDING").alias("state"),
        F.when(F.col("state") == "RUNNING", F.col("name")).alias("app_name"),
    )


CLASSIFIED = f"""{REPLICAS}, {APPLICATIONS}, {ALIVE_REPLICAS},
flags AS (
  SELECT a.name, a.app_status, a.running, a.unhealthy, coalesce(u.alive_replicas, 0) AS alive,
    app_status = 'DEPLOYING' OR list_contains(deployment_states, 'UPDATING') AS rec,
    app_status = 'DELETING' AS del, app_status = 'UNHEALTHY' OR list_contains(deployment_states, 'UNHEALTHY') AS deg,
    app_status IN ('RUNNING', 'HEALTHY', 'DEPLOYING', '') AS ok
  FROM applications a LEFT JOIN up u ON u.name = a.name),
eff AS (SELECT *, CASE WHEN running > 0 AND ok THEN running WHEN running > 0 THEN least(running, alive) ELSE alive END AS live FROM flags),
classified AS (
  SELECT *, CASE WHEN del THEN 'missing' WHEN rec AND live <= 0 THEN 'recovering' WHEN live > 0 AND (unhealthy > 0 OR rec OR deg) THEN 'degraded'
      WHEN live > 0 AND ok THEN 'ready' WHEN running > 0 AND alive <= 0 AND NOT rec THEN 'missing' WHEN deg THEN 'degraded' ELSE 'unknown' END AS obs,
    CASE WHEN del THEN 'offline' WHEN rec AND live <= 0 THEN 'degraded' WHEN live > 0 AND (unhealthy > 0 OR rec OR deg) THEN 'degraded'
      WHEN live > 0 AND ok THEN 'healthy' WHEN running > 0 AND alive <= 0 AND NOT rec THEN 'offline' WHEN deg THEN 'degraded' ELSE 'unknown' END AS hea,
    CASE WHEN del THEN 'idle' WHEN rec AND live <= 0 THEN 'recovering' WHEN live > 0 AND (unhealthy > 0 OR rec OR deg OR ok) THEN 'idle'
      WHEN running > 0 AND alive <= 0 AND NOT rec THEN 'idle' WHEN deg THEN 'failed' ELSE 'idle' END AS reco,
    CASE WHEN del THEN 'being deleted or stopped' WHEN rec AND live <= 0 THEN NULL WHEN live > 0 AND (unhealthy > 0 OR rec OR deg OR ok) THEN NULL
      WHEN running > 0 AND alive <= 0 AND NOT rec THEN 'reported without live replicas' WHEN deg THEN 'reported in a degraded state' END AS why
  FROM eff)"""


def _classified(spark, sf_dir):
    return fleet.classify_applications(applications(spark, sf_dir), fleet.alive_replicas(_actors(spark, sf_dir)))


@query(
    "p13_application_states",
    f"""WITH {CLASSIFIED} SELECT name, app_status, live AS running_replicas, running AS reported_running_replicas, alive AS alive_replicas,
      unhealthy AS unhealthy_replicas, obs AS observed_status, hea AS health_status, reco AS recovery_state,
      CASE WHEN why IS NOT NULL THEN 'Application ''' || name || ''' is ' || why || '.' END AS failure_reason FROM classified""",
)
def application_states(spark, sf_dir):
    return _classified(spark, sf_dir)


@query(
    "j06_replica_cross_check",
    f"WITH {REPLICAS}, {APPLICATIONS}, {ALIVE_REPLICAS} SELECT a.name, a.running, coalesce(u.alive_replicas, 0) AS alive_replicas FROM applications a LEFT JOIN up u USING (name)",
)
def cross_check(spark, sf_dir):
    alive = fleet.alive_replicas(_actors(spark, sf_dir))
    return applications(spark, sf_dir).join(alive, "name", "left").select(
        "name", "running", F.coalesce("alive_replicas", F.lit(0)).alias("alive_replicas")
    )


@query(
    "g13_actor_counts",
    f"""WITH {REPLICAS} SELECT count(*) FILTER (WHERE state = 'RUNNING' AND id % 4 <> 0) AS alive,
        count(*) FILTER (WHERE state = 'DEAD') AS dead FROM replicas""",
)
def actor_counts(spark, sf_dir):
    return fleet.actor_state_counts(_actors(spark, sf_dir))


RECONCILED = f"""{CATALOG}, {CLASSIFIED},
joined AS (
  SELECT 'app' || CAST(c.id AS VARCHAR) AS name, c.managed, c.desired_status, c.recovery_state AS was, c.last_action_type = 'respawn' AS resp,
    {NOW_MS} - c.last_reconciled_ms <= 60000 AS fresh, s.name IS NOT NULL AS has_app, s.obs, s.hea, s.reco,
    CASE WHEN s.why IS NOT NULL THEN 'Application ''' || s.name || ''' is ' || s.why || '.' END AS why,
    coalesce(s.live, 0) AS alive_count, coalesce(s.unhealthy, 0) AS dead_count,
    CASE WHEN length(s.name) % 2 = 0 THEN '/live/' || s.name WHEN c.id % 4 <> 0 THEN c.route_prefix END AS route_prefix,
    CASE WHEN c.id % 3 = 0 THEN 'ns' || CAST(c.id % 10 AS VARCHAR) END AS runtime_namespace,
    '{{"id":' || CAST(c.id AS VARCHAR) || '}}' AS deployment_metadata
  FROM catalog c LEFT JOIN classified s ON s.name = 'app' || CAST(c.id AS VARCHAR)),
base AS (
  SELECT *, CASE WHEN desired_status <> 'running' THEN 'offline' WHEN has_app THEN obs WHEN was = 'recovering' THEN 'recovering' ELSE 'missing' END AS o1,
    CASE WHEN desired_status <> 'running' THEN 'offline' WHEN has_app THEN hea WHEN was = 'recovering' THEN 'degraded' ELSE 'offline' END AS h1,
    CASE WHEN desired_status <> 'running' THEN 'idle' WHEN has_app THEN reco WHEN was = 'recovering' THEN 'recovering' ELSE 'idle' END AS r1,
    CASE WHEN desired_status <> 'running' THEN NULL WHEN has_app THEN why WHEN was = 'recovering' THEN NULL
         ELSE 'Deployment ''' || name || ''' is absent from live state.' END AS w1,
    CASE WHEN desired_status <> 'running' THEN '{fleet.NOTES["stopped"]}' WHEN has_app THEN '{fleet.NOTES["live"]}'
         WHEN was = 'recovering' THEN '{fleet.NOTES["started"]}' ELSE '{fleet.NOTES["absent"]}' END AS n1 FROM joined),
stage2 AS (
  SELECT *, was = 'recovering' AND coalesce(resp, FALSE) AND o1 <> 'ready' AS respawn,
    CASE WHEN o1 IN ('recovering', 'unknown', 'stale') THEN CASE WHEN has_app THEN 'degraded' ELSE 'missing' END ELSE o1 END AS late FROM base),
settled AS (
  SELECT name, managed, desired_status,
    CASE WHEN respawn AND fresh THEN 'recovering' WHEN respawn THEN late ELSE o1 END AS observed_status,
    CASE WHEN respawn AND fresh THEN 'degraded' WHEN respawn THEN CASE WHEN late IN ('missing', 'offline') THEN 'offline' ELSE 'degraded' END ELSE h1 END AS health_status,
    CASE WHEN respawn AND fresh THEN 'recovering' WHEN respawn THEN 'failed' ELSE r1 END AS recovery_state,
    CASE WHEN respawn AND fresh THEN NULL WHEN respawn THEN coalesce(w1, '''' || name || ''' was started again and did not come back in time.') ELSE w1 END AS last_failure_reason,
    CASE WHEN respawn AND fresh THEN '{fleet.NOTES["waiting"]}' WHEN respawn THEN '{fleet.NOTES["expired"]}' ELSE n1 END AS reconcile_notes,
    route_prefix, runtime_namespace, deployment_metadata, alive_count, dead_count FROM stage2),
reconciled AS (SELECT *, desired_status = 'running' AND {ALIVE} AS alive FROM settled)"""


def _reconciled(spark, sf_dir):
    """Every fourth entry has no route of its own, every third a namespace, and every other application a live route."""
    number = F.col("id").cast("string")
    entries = catalog(spark, sf_dir).withColumns({
        "app_name": F.concat(F.lit("app"), number),
        "route_prefix": F.when(F.col("id") % 4 != 0, F.col("route_prefix")),
        "runtime_namespace": F.when(F.col("id") % 3 == 0, F.concat(F.lit("ns"), (F.col("id") % 10).cast("string"))),
        "deployment_metadata": F.concat(F.lit('{"id":'), number, F.lit("}")),
    })
    apps = _classified(spark, sf_dir).withColumn("route_prefix", F.when(F.length("name") % 2 == 0, F.concat(F.lit("/live/"), "name")))
    return fleet.reconcile(entries, apps, F.lit(NOW_MS))


@query("j05_reconciled_deployments", f"WITH {RECONCILED} SELECT * FROM reconciled")
def reconciled(spark, sf_dir):
    return _reconciled(spark, sf_dir)


@query(
    "g14_status_summary",
    f"""WITH {RECONCILED} SELECT count(*) AS total, count(*) FILTER (WHERE managed) AS managed,
      {', '.join(f"count(*) FILTER (WHERE observed_status = '{s}') AS {s}" for s in fleet.SUMMARY_STATES)} FROM reconciled""",
)
def status_summary(spark, sf_dir):
    return fleet.status_summary(_reconciled(spark, sf_dir))


@query(
    "g15_fleet_health",
    f"""WITH {RECONCILED} SELECT count(*) FILTER (WHERE managed AND desired_status = 'running' AND observed_status <> 'ready') = 0 AS healthy,
      count(*) FILTER (WHERE managed AND desired_status = 'running' AND observed_status <> 'ready') AS not_ready FROM reconciled""",
)
def fleet_health(spark, sf_dir):
    return fleet.fleet_health(_reconciled(spark, sf_dir))


@query(
    "g15_snapshot_health",
    """WITH s AS (SELECT date_trunc('day', ts) AS d, event_type, max(value) < 300 AS ok FROM events GROUP BY 1, 2),
    newest AS (SELECT max(d) AS d FROM s)
    SELECT CASE WHEN bool_and(ok) THEN 'healthy' ELSE 'degraded' END AS status, epoch_us(max(s.d)) // 1000 AS snapshot_ts, count(*) AS services
    FROM s JOIN newest USING (d)""",
)
def snapshot_health(spark, sf_dir):
    """Event types as services, one snapshot per day; a service is healthy if it stayed below 300."""
    e = table(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", F.col("ts").cast("timestamp")))
    services = e.groupBy(F.unix_millis("day").alias("snapshot_ts"), "event_type").agg((F.max("value") < 300).alias("healthy"))
    return fleet.snapshot_health(services)


@query(
    "j07_active_keys_of_active_users",
    """SELECT o_orderkey AS key_id, c_custkey AS user_id, c_name FROM orders JOIN customer ON c_custkey = o_custkey
       WHERE o_orderstatus <> 'F' AND c_acctbal > 0""",
)
def active_keys(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("key_id"), F.col("o_custkey").alias("user_id"), (F.col("o_orderstatus") != "F").alias("key_active")
    )
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name", (F.col("c_acctbal") > 0).alias("user_active"))
    return keys.filter("key_active").join(users.filter("user_active"), "user_id").select("key_id", "user_id", "c_name")


@query(
    "j08_portfolio_holdings",
    f"""SELECT s_suppkey AS portfolio_id, s_name, count(*) AS holdings, {r('sum(l_quantity * p_retailprice)', 2)} AS position_value
       FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2""",
)
def portfolio(spark, sf_dir):
    """Suppliers as portfolios, line items as holdings valued at the part price."""
    holdings = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("portfolio_id"), F.col("l_partkey").alias("partkey"), "l_quantity")
    prices = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("partkey"), "p_retailprice")
    portfolios = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("portfolio_id"), "s_name")
    per_part = holdings.groupBy("portfolio_id", "partkey").agg(F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n"))
    valued = per_part.join(prices, "partkey").join(portfolios, "portfolio_id")
    return valued.groupBy("portfolio_id", "s_name").agg(
        F.sum("n").alias("holdings"), F.round(F.round(F.sum(F.col("qty") * F.col("p_retailprice")), 10), 2).alias("position_value")
    )


def _capabilities(spark, sf_dir):
    """Parts as capabilities of their brand (the agent): id from the name, tags and alias from type and size."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_brand").alias("agent"),
        F.col("p_partkey").alias("position"),
        F.when(F.col("p_partkey") % 2 == 0, F.initcap("p_name")).otherwise(F.col("p_name")).alias("id"),
        F.array(F.lower("p_type"), F.concat(F.lit("size"), (F.col("p_size") % 5).cast("string"))).alias("tags"),
        F.array(F.concat(F.lit("alias"), (F.col("p_size") % 7).cast("string"))).alias("aliases"),
        F.when(F.col("p_size") % 2 == 0, "text").alias("input_type"),
        F.lit("score").alias("output_type"),
        F.when(F.col("p_size") % 3 == 0, "Chat").otherwise("invoke").alias("interaction_mode"),
        (F.col("p_retailprice") > 950).alias("alive"),
    )


@query(
    "j09_capability_match",
    """SELECT p_brand AS agent, p_partkey AS position FROM part
       WHERE p_retailprice > 950 AND p_size % 7 = 3 AND lower(p_type) = 'economy' AND p_size % 5 < 5 AND p_size % 3 <> 0""",
)
def capability_match(spark, sf_dir):
    return fleet.match_capabilities(
        _capabilities(spark, sf_dir), capability="Alias3", required_tags=[" ECONOMY "], interaction_mode="INVOKE", output_type="score"
    ).select("agent", "position")


@query(
    "j09_matching_agents",
    """WITH agents AS (SELECT DISTINCT p_brand AS agent, CAST(substr(p_brand, 7) AS INT) % 2 = 0 AS alive FROM part
         UNION ALL SELECT s_name, s_acctbal > 0 FROM supplier)
    SELECT 'all' AS asked, agent, p_partkey AS position FROM agents LEFT JOIN part ON p_brand = agent WHERE alive
    UNION ALL SELECT 'economy', agent, p_partkey FROM agents JOIN part ON p_brand = agent WHERE alive AND lower(p_type) = 'economy'""",
)
def matching_agents(spark, sf_dir):
    """Brands as agents with their parts' capabilities, suppliers as agents without any; once unconstrained, once by tag."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("agent")).distinct()
    agents = brands.withColumn("alive", F.substring("agent", 7, 10).cast("int") % 2 == 0).unionByName(
        table(spark, sf_dir, "supplier").select(F.col("s_name").alias("agent"), (F.col("s_acctbal") > 0).alias("alive"))
    )
    known = _capabilities(spark, sf_dir)
    every = fleet.matching_agents(agents, known).select(F.lit("all").alias("asked"), "agent", "position")
    tagged = fleet.matching_agents(agents, known, required_tags=["Economy "]).select(F.lit("economy").alias("asked"), "agent", "position")
    return every.unionByName(tagged)


@query(
    "g18_first_capability",
    """SELECT p_brand AS agent, lower(p_name) AS id_key, min(p_partkey) AS position FROM part GROUP BY 1, 2""",
)
def first_capability(spark, sf_dir):
    return fleet.first_capability(_capabilities(spark, sf_dir)).select("agent", F.lower("id").alias("id_key"), "position")


@query(
    "g19_capability_statistics",
    """SELECT count(DISTINCT lower(p_name)) FILTER (WHERE p_retailprice > 950) AS live_capabilities,
       count(DISTINCT p_brand) FILTER (WHERE p_retailprice > 950) AS live_agents, count(DISTINCT p_brand) AS agents, count(*) AS registrations FROM part""",
)
def capability_statistics(spark, sf_dir):
    return fleet.capability_statistics(_capabilities(spark, sf_dir))


@query(
    "p18_normalized_capabilities",
    """SELECT p_brand AS agent, p_partkey AS position, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE 'cap' || CAST(p_size AS VARCHAR) END AS id,
         CASE WHEN p_partkey % 3 = 2 THEN 'does ' || p_name WHEN p_partkey % 3 = 0 THEN p_name ELSE 'cap' || CAST(p_size AS VARCHAR) END AS description,
         CASE WHEN p_partkey % 3 = 0 THEN '' ELSE lower(p_type) END AS tags,
         CASE WHEN p_partkey % 3 = 2 THEN 'chat' ELSE 'invoke' END AS interaction_mode FROM part""",
)
def normalized_capabilities(spark, sf_dir):
    """Plain names, records with an id, records with a name; tags are lower-cased and blanks dropped."""
    p = table(spark, sf_dir, "part")
    kind, name = F.col("p_partkey") % 3, F.concat(F.lit("cap"), F.col("p_size").cast("string"))
    tags = F.array(F.concat(F.lit(" "), F.upper("p_type")), F.lit("  "))
    entry = (
        F.when(kind == 0, F.concat(F.lit(" "), "p_name", F.lit(" ")))
        .when(kind == 1, F.to_json(F.struct(F.lit("").alias("id"), name.alias("name"), tags.alias("tags"))))
        .otherwise(F.to_json(F.struct(name.alias("id"), F.concat(F.lit("does "), "p_name").alias("description"), tags.alias("tags"),
                                      F.lit("chat").alias("interaction_mode"))))
    )
    rows = fleet.normalize_capabilities(p.select(F.col("p_brand").alias("agent"), F.col("p_partkey").alias("position"), entry.alias("entry")))
    return rows.select("agent", "position", "id", "description", F.array_join("tags", ",").alias("tags"), "interaction_mode")


GRANTS = """grants AS (SELECT c_custkey AS user_id, 'role' || CAST(c_nationkey AS VARCHAR) AS role FROM customer),
policies AS (SELECT 'role' || CAST(n_nationkey AS VARCHAR) AS role, r_name AS policy FROM nation JOIN region ON n_regionkey = r_regionkey),
permissions AS (SELECT DISTINCT r_name AS policy, p_brand AS permission FROM part JOIN region ON p_size % 5 = r_regionkey)"""


def _grants(spark, sf_dir):
    """Customers' nations as roles, their regions as policies, and the brands of parts as a region's permissions."""
    role = lambda c: F.concat(F.lit("role"), F.col(c).cast("string")).alias("role")
    grants = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), role("c_nationkey"))
    regions = table(spark, sf_dir, "region")
    policies = table(spark, sf_dir, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(
        role("n_nationkey"), F.col("r_name").alias("policy")
    )
    permissions = (
        table(spark, sf_dir, "part")
        .join(regions, F.col("p_size") % 5 == F.col("r_regionkey"))
        .select(F.col("r_name").alias("policy"), F.col("p_brand").alias("permission"))
        .distinct()
    )
    return grants, policies, permissions


@query("j10_effective_permissions", f"WITH {GRANTS} SELECT DISTINCT user_id, permission FROM grants JOIN policies USING (role) JOIN permissions USING (policy)")
def permissions(spark, sf_dir):
    return fleet.effective_permissions(*_grants(spark, sf_dir))


@query(
    "j10_authorized_users",
    f"WITH {GRANTS} SELECT DISTINCT user_id FROM grants JOIN policies USING (role) JOIN permissions USING (policy) WHERE permission = 'Brand#17'",
)
def authorized(spark, sf_dir):
    return fleet.authorized(*_grants(spark, sf_dir), "Brand#17")


@query(
    "j11_conflict_skip",
    """SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders
       WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 5000) GROUP BY 1""",
)
def conflict_skip(spark, sf_dir):
    stored = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return skip_conflicts(rows, stored, ["o_custkey"], ["o_orderkey"])


# --- lag, rules, cooldown -----------------------------------------------------------------------------

OFFSETS = """offsets AS (SELECT l_returnflag || CAST(l_suppkey % 10 AS VARCHAR) AS topic, CAST(l_quantity AS BIGINT) AS high,
                    l_partkey % 60 - 1 AS committed FROM lineitem)"""
LAG = f"WITH {OFFSETS}, lag AS (SELECT topic, CAST(sum(greatest(high - greatest(committed, 0), 0)) AS BIGINT) AS lag FROM offsets GROUP BY topic)"


def _offsets(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat("l_returnflag", (F.col("l_suppkey") % 10).cast("string")).alias("topic"),
        F.col("l_quantity").cast("bigint").alias("high"), (F.col("l_partkey") % 60 - 1).alias("committed"),
    )


@query("g12_lag_by_topic", f"{LAG} SELECT * FROM lag")
def lag_by_topic(spark, sf_dir):
    return rules.lag_by_topic(_offsets(spark, sf_dir))


@query("g12_lag_totals", f"{LAG} SELECT CAST(sum(lag) AS BIGINT) AS total_lag, arg_max(topic, lag) AS worst_topic, max(lag) AS worst_lag FROM lag")
def lag_totals(spark, sf_dir):
    return rules.lag_totals(_offsets(spark, sf_dir))


@query(
    "r10_lag_actions",
    f"""WITH g AS (SELECT l_suppkey AS group_id, CAST(sum(greatest(CAST(l_quantity AS BIGINT) - l_partkey % 60, 0)) AS BIGINT) AS total_lag,
      count(*) FILTER (WHERE l_linestatus = 'F') AS alive FROM lineitem GROUP BY 1)
    SELECT CASE WHEN total_lag > 500 THEN 'scale_up' ELSE 'scale_down' END AS action, CASE WHEN total_lag > 500 THEN 2 ELSE 1 END AS count, total_lag
    FROM g JOIN supplier ON s_suppkey = group_id WHERE s_nationkey % 5 <> 0 AND s_acctbal > 0 AND (total_lag > 500 OR (total_lag <= 0 AND alive > 2))""",
)
def lag_actions(spark, sf_dir):
    """Every supplier as a consumer group; those of some nations have no health report, those in debt an unwell one."""
    li = table(spark, sf_dir, "lineitem")
    lag = rules.partition_lag(F.col("l_quantity").cast("bigint"), F.col("l_partkey") % 60)
    groups = li.groupBy(F.col("l_suppkey").alias("group_id")).agg(
        F.sum(lag).alias("total_lag"), F.count_if(F.col("l_linestatus") == "F").alias("alive")
    ).withColumns({"worst_topic": F.concat(F.lit("t"), F.col("group_id").cast("string")), "worst_lag": F.col("total_lag")})
    health = table(spark, sf_dir, "supplier").filter("s_nationkey % 5 <> 0").select(
        F.col("s_suppkey").alias("group_id"), (F.col("s_acctbal") > 0).alias("healthy")
    )
    reported = groups.join(health, "group_id", "left")
    actions = rules.lag_actions(reported, F.col("alive"), "worker", healthy=F.col("healthy"))
    return actions.select("action", "count", F.regexp_extract("reason", r"(?:^|Lag is )(\d+)", 1).cast("bigint").alias("total_lag"))


@query(
    "r11_cpu_actions",
    """WITH c AS (SELECT l_orderkey AS cluster, sum(l_quantity) AS used, count(*) AS n,
         CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE sum(l_quantity) / (count(*) * 50.0) * 100.0 END AS pct FROM lineitem GROUP BY 1)
    SELECT cluster, CASE WHEN pct > 85 THEN 'scale_up' ELSE 'scale_down' END AS action FROM c WHERE pct > 85 OR (pct < 20 AND n > 1)""",
)
def cpu_actions(spark, sf_dir):
    """Orders as clusters: quantity used of 50 per line; every ninth total is unreadable."""
    li = table(spark, sf_dir, "lineitem")
    clusters = li.groupBy(F.col("l_orderkey").alias("cluster")).agg(F.sum("l_quantity").alias("used"), F.count(F.lit(1)).alias("alive"))
    shaped = clusters.select(
        "cluster", F.col("used").cast("string").alias("cpu_used"),
        F.when(F.col("cluster") % 9 == 0, "n/a").otherwise((F.col("alive") * 50.0).cast("string")).alias("cpu_total"), "alive",
    )
    return rules.cpu_actions(shaped, "worker").select("cluster", "action")


@query(
    "r09_staleness_alerts",
    f"""WITH t AS (SELECT user_id, max(epoch_us(ts) // 1000) AS ms FROM events GROUP BY 1)
    SELECT 'lake/u' || CAST(user_id AS VARCHAR) AS agent, 'alert' AS action FROM t
    WHERE user_id % 10 <> 0 AND ({NOW_MS} - ms) / 1000.0 > 200000""",
)
def staleness(spark, sf_dir):
    """Users as tables, their last event as the last commit; every tenth table reports an error."""
    e = table(spark, sf_dir, "events")
    tables = e.groupBy("user_id").agg(F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("latest_commit_ms")).select(
        F.lit("lake").alias("service"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("table_name"),
        "latest_commit_ms", F.when(F.col("user_id") % 10 == 0, "unreadable").alias("error"),
    )
    return rules.staleness_actions(tables, F.lit(NOW_MS), 200_000).select("agent", "action")


def _healing(spark, sf_dir):
    deployments = _reconciled(spark, sf_dir).withColumns({
        "class_name": F.concat(F.lit("C"), F.right("name", F.lit(1))),
        "replication_mode": F.when(F.col("name").endswith("7"), "manual"),
    })
    classes = spark_classes(spark, sf_dir)
    return rules.healing_actions(deployments, classes)


def spark_classes(spark, sf_dir):
    """Managed classes from the nations: C0..C8."""
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("C"), (F.col("n_nationkey") % 9).cast("string")).alias("class_name")).distinct()


@query(
    "r12_healing_actions",
    f"""WITH {RECONCILED}
    SELECT name AS deployment_name, 'C' || right(name, 1) AS agent,
      CASE WHEN observed_status IN ('missing', 'offline') THEN 'respawn' ELSE 'alert' END AS action,
      coalesce(last_failure_reason, CASE WHEN observed_status IN ('missing', 'offline')
        THEN chr(39) || name || chr(39) || ' is ' || observed_status || ' and will be brought back as it was.'
        ELSE chr(39) || name || chr(39) || ' is degraded, please look at it.' END) AS reason,
      coalesce(runtime_namespace, '') AS runtime_namespace, coalesce(route_prefix, '/' || name) AS route_prefix, deployment_metadata
    FROM reconciled WHERE managed AND desired_status = 'running' AND right(name, 1) NOT IN ('7', '9') AND recovery_state <> 'recovering'
      AND (observed_status IN ('missing', 'offline', 'degraded') OR health_status = 'degraded')""",
)
def healing(spark, sf_dir):
    return _healing(spark, sf_dir).select(
        "deployment_name", "agent", "action", "reason", "runtime_namespace", "route_prefix", "deployment_metadata"
    )


def _candidates(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("k"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("event_id").alias("id")
    )


@query(
    "w09_cooldown",
    """WITH RECURSIVE e AS (SELECT event_type AS k, epoch_us(ts) // 1000 AS ts_ms, event_id AS id FROM events),
    fired(k, ts_ms) AS (
      SELECT k, min(ts_ms) FROM e GROUP BY k
      UNION ALL
      SELECT f.k, (SELECT min(ts_ms) FROM e WHERE e.k = f.k AND e.ts_ms >= f.ts_ms + 3600000) FROM fired f
      WHERE EXISTS (SELECT 1 FROM e WHERE e.k = f.k AND e.ts_ms >= f.ts_ms + 3600000))
    SELECT e.k, e.ts_ms, e.id, f.ts_ms IS NOT NULL AS fired FROM e LEFT JOIN fired f ON f.k = e.k AND f.ts_ms = e.ts_ms""",
)
def cooldown_events(spark, sf_dir):
    """Every event is a candidate; one hour must pass between two that fire."""
    return cooldown.mark_fired(_candidates(spark, sf_dir), "k", "ts_ms", "id", 3_600_000)


@query(
    "r13_action_log",
    """WITH RECURSIVE a AS (
      SELECT CASE event_type WHEN 'error' THEN 'respawn' WHEN 'view' THEN 'alert' ELSE 'scale_up' END AS action,
        'agent' || CAST(user_id % 5 AS VARCHAR) AS agent, event_type AS reason, epoch_us(ts) // 1000 AS ts_ms, event_id AS id, value < 200 AS ok
      FROM events),
    e AS (SELECT action || ':' || agent AS k, ts_ms FROM a WHERE action <> 'respawn'),
    fired(k, ts_ms) AS (
      SELECT k, min(ts_ms) FROM e GROUP BY k
      UNION ALL
      SELECT f.k, (SELECT min(ts_ms) FROM e WHERE e.k = f.k AND e.ts_ms >= f.ts_ms + 3600000) FROM fired f
      WHERE EXISTS (SELECT 1 FROM e WHERE e.k = f.k AND e.ts_ms >= f.ts_ms + 3600000))
    SELECT action, agent, '' AS deployment_name, reason, ts_ms, id, action || ':' || agent AS cooldown_key,
      CASE WHEN NOT ok THEN 'error' WHEN action IN ('respawn', 'alert') THEN 'warning' ELSE 'info' END AS level,
      CASE WHEN ok THEN 'succeeded' ELSE 'failed' END AS status, reason AS detail, 'runtime' AS target
    FROM a WHERE action = 'respawn' OR EXISTS (SELECT 1 FROM fired f WHERE f.k = action || ':' || agent AND f.ts_ms = a.ts_ms)""",
)
def action_log(spark, sf_dir):
    """Rules, cooldown and alert rows together, over the events as action requests."""
    e = table(spark, sf_dir, "events")
    actions = e.select(
        F.when(F.col("event_type") == "error", "respawn").when(F.col("event_type") == "view", "alert").otherwise("scale_up").alias("action"),
        F.lit("runtime").alias("target"), F.concat(F.lit("agent"), (F.col("user_id") % 5).cast("string")).alias("agent"),
        F.lit("").alias("deployment_name"), F.col("event_type").alias("reason"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("event_id").alias("id"),
        (F.col("value") < 200).alias("success"), F.lit(None).cast("string").alias("detail"), F.lit(None).cast("string").alias("error"),
    )
    fired = rules.with_cooldown(actions, 3_600_000).filter("fired").drop("fired")
    return rules.alert_rows(fired)


@query(
    "w10_recovery_window",
    f"WITH {CATALOG} SELECT name, CASE WHEN id % 10 = 0 THEN FALSE ELSE {NOW_MS} - last_reconciled_ms <= 60000 END AS in_window FROM catalog",
)
def recovery_window(spark, sf_dir):
    at = F.when(F.col("id") % 10 != 0, F.col("last_reconciled_ms"))
    return catalog(spark, sf_dir).select("name", fleet.in_recovery_window(at, F.lit(NOW_MS)).alias("in_window"))


# --- operational tables -----------------------------------------------------------------------------

INCOMING = f"""incoming AS (
  SELECT 'Customer#' || lpad(CAST(o_custkey + 100 AS VARCHAR), 9, '0') AS name, max(o_orderkey) AS k FROM orders GROUP BY o_custkey),
src AS (SELECT name, k AS id, 'seen' AS status, 'cap' || CAST(k % 3 AS VARCHAR) AS capabilities,
          CASE WHEN k % 2 = 0 THEN {NOW_MS} + k END AS registered_at FROM incoming)"""


def _incoming(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    name = F.concat(F.lit("Customer#"), F.lpad((F.col("o_custkey") + 100).cast("string"), 9, "0"))
    changes = o.select(name.alias("name"), F.col("o_orderkey").alias("k"))
    return mutation.last_change_per_key(changes, "name", ["k"])


@query(
    "m01_upsert",
    f"""WITH {CATALOG}, {INCOMING}
    SELECT coalesce(s.name, c.name) AS name, CASE WHEN c.name IS NOT NULL THEN c.id ELSE s.id END AS id,
      CASE WHEN s.name IS NOT NULL THEN s.status ELSE c.status END AS status,
      CASE WHEN s.name IS NOT NULL THEN s.capabilities ELSE c.capabilities END AS capabilities,
      coalesce(s.registered_at, c.registered_at) AS registered_at
    FROM catalog c FULL JOIN src s ON s.name = c.name""",
)
def upsert(spark, sf_dir):
    k = F.col("k")
    source = _incoming(spark, sf_dir).select(
        "name", k.alias("id"), F.lit("seen").alias("status"), F.concat(F.lit("cap"), (k % 3).cast("string")).alias("capabilities"),
        F.when(k % 2 == 0, F.lit(NOW_MS) + k).alias("registered_at"),
    )
    target = catalog(spark, sf_dir).select("name", "id", "status", "capabilities", "registered_at")
    return mutation.upsert(target, source)


@query(
    "m02_status_update",
    f"""WITH {CATALOG}, {INCOMING}
    SELECT c.name, CASE WHEN s.name IS NOT NULL THEN 'alive' ELSE c.status END AS status,
      CASE WHEN s.k % 2 = 0 THEN 'ready' ELSE c.observed_status END AS observed_status,
      CASE WHEN s.k % 3 = 0 THEN CASE WHEN s.k % 5 = 0 THEN NULL ELSE 'new reason' END ELSE c.last_failure_reason END AS last_failure_reason,
      CASE WHEN s.name IS NOT NULL THEN {NOW_MS} ELSE 0 END AS updated_at
    FROM catalog c LEFT JOIN incoming s ON s.name = c.name""",
)
def status_update(spark, sf_dir):
    k = F.col("k")
    text = F.lit(None).cast("string")
    changes = _incoming(spark, sf_dir).select(
        "name", F.lit("alive").alias("status"), F.when(k % 2 == 0, "ready").alias("observed_status"),
        text.alias("health_status"), text.alias("recovery_state"), F.lit(None).cast("bigint").alias("last_reconciled_at"),
        F.lit(None).cast("bigint").alias("last_seen_at"), F.lit(None).cast("bigint").alias("last_heartbeat_at"),
        (k % 3 == 0).alias("set_last_failure_reason"), F.when(k % 5 != 0, "new reason").alias("last_failure_reason"),
        F.lit(False).alias("set_last_action_type"), text.alias("last_action_type"),
        F.lit(False).alias("set_reconcile_notes"), text.alias("reconcile_notes"), F.lit(NOW_MS).alias("updated_at"),
    )
    target = catalog(spark, sf_dir).withColumn("updated_at", F.lit(0).cast("bigint"))
    return mutation.update_status(target, changes).select("name", "status", "observed_status", "last_failure_reason", "updated_at")


@query(
    "m03_control_update",
    f"""WITH {CATALOG}, {INCOMING}
    SELECT c.name, CASE WHEN s.k % 2 = 0 THEN FALSE ELSE c.managed END AS managed,
      CASE WHEN s.k % 7 = 0 THEN 'stopped' ELSE c.desired_status END AS desired_status,
      CASE WHEN s.k % 3 = 0 THEN 'note' END AS reconcile_notes
    FROM catalog c LEFT JOIN incoming s ON s.name = c.name""",
)
def control_update(spark, sf_dir):
    k = F.col("k")
    changes = _incoming(spark, sf_dir).select(
        "name", F.when(k % 2 == 0, F.lit(False)).alias("managed"), F.when(k % 7 == 0, "stopped").alias("desired_status"),
        (k % 3 == 0).alias("set_reconcile_notes"), F.lit("note").alias("reconcile_notes"), F.lit(NOW_MS).alias("updated_at"),
    )
    target = catalog(spark, sf_dir).withColumns({"reconcile_notes": F.lit(None).cast("string"), "updated_at": F.lit(0).cast("bigint")})
    return mutation.update_control(target, changes).select("name", "managed", "desired_status", "reconcile_notes")


@query("m04_delete", f"WITH {CATALOG}, {INCOMING} SELECT name, status FROM catalog WHERE name NOT IN (SELECT name FROM incoming WHERE k % 2 = 0)")
def delete(spark, sf_dir):
    keys = _incoming(spark, sf_dir).filter(F.col("k") % 2 == 0)
    remaining, _ = mutation.delete_keys(catalog(spark, sf_dir), keys)
    return remaining.select("name", "status")


@query("m04_delete_count", f"WITH {CATALOG}, {INCOMING} SELECT count(*) AS affected FROM catalog WHERE name IN (SELECT name FROM incoming WHERE k % 2 = 0)")
def delete_count(spark, sf_dir):
    keys = _incoming(spark, sf_dir).filter(F.col("k") % 2 == 0)
    return mutation.delete_keys(catalog(spark, sf_dir), keys)[1]


@query(
    "m05_listing",
    f"""WITH {CATALOG} SELECT name, runtime_source, is_enabled, id AS meta_id FROM catalog WHERE runtime_source = 'serve' AND is_enabled""",
)
def listed(spark, sf_dir):
    rows = catalog(spark, sf_dir).withColumn("metadata", F.to_json(F.struct("id")))
    return mutation.list_entries(rows, "serve", True, {"metadata": "id bigint"}).select(
        "name", "runtime_source", "is_enabled", F.col("metadata.id").alias("meta_id")
    )


STALE = f"last_heartbeat_at IS NOT NULL AND last_heartbeat_at < {NOW_MS - 500_000} AND status IN ('alive', 'unknown')"


def _stale(spark, sf_dir):
    return mutation.mark_stale(catalog(spark, sf_dir), F.lit(NOW_MS - 500_000), ["alive", "unknown"])


@query("m06_mark_stale", f"WITH {CATALOG} SELECT name, CASE WHEN {STALE} THEN 'stale' ELSE status END AS status FROM catalog")
def mark_stale(spark, sf_dir):
    return _stale(spark, sf_dir)[0].select("name", "status")


@query("m06_mark_stale_count", f"WITH {CATALOG} SELECT count(*) AS affected FROM catalog WHERE {STALE}")
def mark_stale_count(spark, sf_dir):
    return _stale(spark, sf_dir)[1]


@query(
    "m07_revoke",
    """SELECT o_orderkey AS key_id, o_custkey AS user_id,
       o_orderstatus <> 'F' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_partkey % 100 = o_custkey % 100) AS is_active FROM orders""",
)
def revoked(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("key_id"), F.col("o_custkey").alias("user_id"), (F.col("o_orderstatus") != "F").alias("is_active")
    )
    owners = keys.select("key_id", "user_id")
    requests = table(spark, sf_dir, "lineitem").join(owners, F.col("l_orderkey") == F.col("key_id")).filter(
        F.col("l_partkey") % 100 == F.col("user_id") % 100
    )
    return mutation.revoke(keys, requests.select("key_id", "user_id"))


OPS = """ops AS (
  SELECT event_id AS seq, 'ctx' || CAST(user_id AS VARCHAR) AS key,
    CASE event_type WHEN 'signup' THEN 'set' WHEN 'error' THEN CASE WHEN value > 60 THEN 'delete' ELSE 'append' END ELSE 'append' END AS op,
    CAST(event_id AS VARCHAR) AS value_json, event_type AS owner, CASE WHEN event_id % 3 = 0 THEN 86400 END AS ttl_s, epoch_us(ts) // 1000 AS ts_ms
  FROM events),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts_ms DESC, seq DESC) AS rn FROM ops),
live AS (SELECT * FROM ranked WHERE rn = 1 AND op <> 'delete' AND (ttl_s IS NULL OR ts_ms + ttl_s * 1000 > 1706572800000))"""
CONTEXT_NOW = 1_706_572_800_000  # 2024-01-30


def _ops(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = (
        F.when(F.col("event_type") == "signup", "set")
        .when((F.col("event_type") == "error") & (F.col("value") > 60), "delete")
        .otherwise("append")
    )
    return e.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("ctx"), F.col("user_id").cast("string")).alias("key"), kind.alias("op"),
        F.col("event_id").cast("string").alias("value_json"), F.col("event_type").alias("owner"),
        F.when(F.col("event_id") % 3 == 0, 86400).alias("ttl_s"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
    )


@query(
    "m08_context_entries",
    f"""WITH {OPS} SELECT key, op AS kind, CASE WHEN op = 'set' THEN value_json END AS value_json, owner, ts_ms AS created_ms,
      ts_ms + ttl_s * 1000 AS expires_ms FROM live""",
)
def context_entries(spark, sf_dir):
    return mutation.context_entries(_ops(spark, sf_dir), F.lit(CONTEXT_NOW))


@query(
    "m08_context_elements",
    f"""WITH {OPS}, lagged AS (SELECT *, CAST(ts_ms AS HUGEINT) * 1000000000 + seq AS at,
        lag(CASE WHEN op <> 'delete' THEN ts_ms + ttl_s * 1000 END) OVER (PARTITION BY key ORDER BY ts_ms, seq) AS gone_ms FROM ops),
    generations AS (SELECT *, sum(CASE WHEN op IN ('set', 'delete') OR gone_ms <= ts_ms THEN 1 ELSE 0 END)
        OVER (PARTITION BY key ORDER BY ts_ms, seq) AS generation FROM lagged),
    newest AS (SELECT key, max(generation) AS generation FROM generations GROUP BY key)
    SELECT g.key, g.ts_ms, g.seq, 0 AS pos, g.value_json FROM generations g JOIN newest USING (key, generation)
    WHERE g.op = 'append' AND g.key IN (SELECT key FROM live WHERE op = 'append')""",
)
def context_elements(spark, sf_dir):
    return mutation.context_elements(_ops(spark, sf_dir), F.lit(CONTEXT_NOW))


@query(
    "m09_thread_append",
    """SELECT conv_id, turn AS seq, role, text AS content, 'agent' || CAST(conv_id % 3 AS VARCHAR) AS sender FROM conversations
       UNION ALL SELECT conv_id, max(turn) + 1, 'assistant', 'noted', 'bot' FROM conversations GROUP BY conv_id""",
)
def thread_append(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    threads = c.select("conv_id", F.col("turn").alias("seq"), "role", F.col("text").alias("content"),
                       F.concat(F.lit("agent"), (F.col("conv_id") % 3).cast("string")).alias("sender"))
    replies = c.groupBy("conv_id").agg((F.max("turn") + 1).alias("seq")).select(
        "conv_id", "seq", F.lit("assistant").alias("role"), F.lit("noted").alias("content"), F.lit("bot").alias("sender")
    )
    return mutation.thread_append(threads, replies)


@query(
    "m10_conformed_columns",
    "SELECT c_custkey, c_name, 'running' AS desired_status, TRUE AS managed, 'unknown' AS health_status, CAST(NULL AS VARCHAR) AS route_prefix, '{}' AS deployment_metadata FROM customer",
)
def conformed(spark, sf_dir):
    return mutation.conform(table(spark, sf_dir, "customer")).select(
        "c_custkey", "c_name", "desired_status", "managed", "health_status", "route_prefix", "deployment_metadata"
    )


@query("t05_name_search", f"WITH {CATALOG} SELECT name, runtime_source FROM catalog WHERE lower(name) LIKE '%#00000012%'")
def name_search(spark, sf_dir):
    return listing.search_by_name(catalog(spark, sf_dir).select("name", "runtime_source"), "CUSTOMER#00000012")
