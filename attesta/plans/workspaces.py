"""Workspaces, revisions, gaps, analysis runs and checks over orders, customers, parts and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import derive
from attesta.operators import workspaces as ops
from attesta.sources.payloads import mapped
from attesta.sources.tables import table


def _governance(spark, d):
    """Orders as governed records: the priority is the workspace, the status the project."""
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("record_id"), F.col("o_orderpriority").alias("workspace"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("project"),
        F.col("o_custkey").alias("owner"), (F.col("o_custkey") + 1).alias("steward"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey") * 2).alias("custodian"), "o_totalprice",
    )


def _workspaces(spark, d):
    return table(spark, d, "orders").where("o_orderpriority <> '5-LOW'").select(F.col("o_orderpriority").alias("workspace"), F.lower("o_orderpriority").alias("workspace_name")).distinct()


def _people(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("principal"), F.col("c_name").alias("name"), "c_mktsegment", (F.col("c_acctbal") > 0).alias("active"))


def workspace_access(spark, d):
    projects = table(spark, d, "orders").select(F.col("o_orderstatus").alias("project"), F.concat(F.lit("project "), "o_orderstatus").alias("project_name")).distinct()
    return ops.record_access(_governance(spark, d), _workspaces(spark, d), projects, _people(spark, d)).select("record_id", "workspace_name", "project_name", "owner_name", "steward_name", "custodian_name")


def workspace_list(spark, d):
    members = table(spark, d, "orders").select(F.col("o_orderpriority").alias("workspace"), F.col("o_custkey").alias("principal"), (F.col("o_orderstatus") == "F").alias("active"))
    return ops.workspace_counts(_workspaces(spark, d), members, _governance(spark, d))


def workspace_records(spark, d):
    records = table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), "o_orderdate")
    return ops.visible(records, _governance(spark, d), "2-HIGH").select("record_id", "o_orderdate", "project", "owner")


def default_governance(spark, d):
    """Records whose order has a shipped line are governed already; all others get the defaults."""
    records = table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"))
    governed = table(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("record_id"))
    return ops.with_default_governance(records, governed, {"workspace": "workspace:default", "owner": "principal:system", "visibility": "private", "classification": "internal"})


def access_events(spark, d):
    log = table(spark, d, "events").select("event_id", F.col("event_type").alias("workspace"), F.col("user_id").alias("principal"), F.col("event_id").alias("record_id"), "value")
    return ops.events(log, _people(spark, d), workspace="click").select("event_id", "principal", "name", "value")


def workspace_manifest(spark, d):
    records = table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("state"))
    return ops.workspace_manifest(records, _governance(spark, d).select("record_id", "workspace"), "2-HIGH", ["state", "customer", "record_id"])


def revision_history(spark, d):
    revisions = table(spark, d, "events").select(F.col("event_id").alias("revision_id"), F.col("user_id").alias("record_id"), F.col("event_type").alias("action"))
    diffs = table(spark, d, "events").where("value >= 20").select(F.col("event_id").alias("revision_id"), F.col("value").alias("change"), F.col("props").alias("changes"))
    return ops.revision_history(revisions, diffs)


def open_gaps(spark, d):
    lines = table(spark, d, "lineitem")
    gaps = lines.select(F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("gap"), F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("resolved_at"), F.col("l_partkey").alias("indicator_id"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("entity_id"))
    entities = table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("entity"))
    indicators = table(spark, d, "part").select(F.col("p_partkey").alias("indicator_id"), F.col("p_name").alias("indicator"))
    return ops.open_gaps(gaps, orders, entities, indicators).select("record_id", "gap", "entity", "indicator")


def artifact_status(spark, d):
    """Customers as artifacts, orders as runs, lines as invalidations, returned ones resolved."""
    runs = table(spark, d, "orders").select(F.col("o_custkey").alias("artifact_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"))
    lines = table(spark, d, "lineitem").select((F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("invalidation_id"), F.col("l_orderkey").alias("run_id"), "l_returnflag")
    return ops.artifact_status(table(spark, d, "customer").select(F.col("c_custkey").alias("artifact_id")), runs, lines.drop("l_returnflag"), lines.where("l_returnflag = 'R'").select("invalidation_id").distinct())


def analysis_summary(spark, d):
    return ops.analysis_summary(table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").cast("double")), "l_suppkey", "l_quantity")


def table_counts(spark, d):
    return ops.table_counts({name: table(spark, d, name) for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")})


def frozen_positions(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("run"), "o_orderkey", "o_orderdate")
    return ops.frozen_positions(rows, "run", [F.desc("o_orderdate"), F.col("o_orderkey")]).drop("o_orderdate")


def identifier_resolution(spark, d):
    known = table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.lower("p_type").alias("scheme"), F.concat(F.lit("P-"), F.col("p_partkey")).alias("identifier"))
    asked = table(spark, d, "lineitem").select((F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("asked_id"), F.lit("economy").alias("scheme"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("P-"), "l_partkey")).otherwise(F.concat(F.lit("p "), "l_partkey")).alias("identifier"))
    return ops.resolve_identifiers(known, asked)


_FIRST = {"amount": {"source": "price", "transforms": ["float"], "required": True}, "grade": {"source": "priority", "transforms": ["float"]}}
_FIXED = _FIRST | {"grade": {"source": "priority", "transforms": [("split", {"delimiter": "-", "at": 0}), "integer"]}}


def quarantine_recovery(spark, d):
    """Rows that a mapping rejected, mapped again by its corrected version: resolved or still open."""
    price = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey").cast("string"))
    grade = F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).otherwise(F.substring("o_orderpriority", 1, 1))
    rows = table(spark, d, "orders").select("o_orderkey", F.create_map(F.lit("price"), price, F.lit("priority"), grade).alias("row"))
    rejected = mapped(rows, _FIRST, "row").where(F.size("errors") > 0).select("o_orderkey", "row", F.array_join("errors", ";").alias("was"))
    again = mapped(rejected, _FIXED, "row")
    return again.select("o_orderkey", "was", "grade", F.when(F.size("errors") == 0, "resolved").otherwise("open").alias("status"), F.array_join("errors", ";").alias("left_over"))


def derivation_check(spark, d):
    """Stored change and readiness of lines, some of them stale, against what they derive to."""
    change = derive.percent_change(F.col("l_quantity").cast("double"), F.col("l_quantity") + F.col("l_linenumber"))
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("line"), "l_quantity", "l_linenumber", "l_returnflag")
    rows = rows.withColumn("change", F.when(F.col("l_returnflag") == "R", F.lit(None).cast("double")).otherwise(change)).withColumn("sign", F.when(F.col("l_returnflag") == "A", "falling").otherwise("rising"))
    return ops.disagreements(rows, {"change": change, "sign": F.lit("rising")}, "line")


QUERIES = {
    q.__name__: q
    for q in (workspace_access, workspace_list, workspace_records, default_governance, access_events, workspace_manifest, revision_history, open_gaps, artifact_status, analysis_summary, table_counts, frozen_positions, identifier_resolution, quarantine_recovery, derivation_check)
}

SQL = {
    "workspace_access": """SELECT o_orderkey AS record_id, lower(o_orderpriority) AS workspace_name, CASE WHEN o_orderstatus <> 'P' THEN 'project ' || o_orderstatus END AS project_name, o.c_name AS owner_name, s.c_name AS steward_name, c.c_name AS custodian_name
        FROM orders LEFT JOIN customer o ON o.c_custkey = o_custkey LEFT JOIN customer s ON s.c_custkey = o_custkey + 1 LEFT JOIN customer c ON c.c_custkey = o_custkey * 2 AND o_orderkey % 4 <> 0 WHERE o_orderpriority <> '5-LOW'""",
    "workspace_list": "SELECT o_orderpriority AS workspace, lower(o_orderpriority) AS workspace_name, count(DISTINCT o_custkey) FILTER (o_orderstatus = 'F') AS member_count, count(DISTINCT o_orderkey) AS record_count FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1, 2",
    "workspace_records": "SELECT o_orderkey AS record_id, o_orderdate, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS project, o_custkey AS owner FROM orders WHERE o_orderpriority = '2-HIGH'",
    "default_governance": "SELECT o_orderkey AS record_id, 'workspace:default' AS workspace, 'principal:system' AS owner, 'private' AS visibility, 'internal' AS classification FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F')",
    "access_events": "SELECT event_id, user_id AS principal, c_name AS name, value FROM events LEFT JOIN customer ON c_custkey = user_id WHERE event_type = 'click'",
    "workspace_manifest": """SELECT o_orderkey AS record_id, sha256('{"customer":' || o_custkey || ',"record_id":' || o_orderkey || ',"state":"' || o_orderstatus || '"}') AS payload_sha256 FROM orders WHERE o_orderpriority = '2-HIGH'""",
    "revision_history": "SELECT event_id AS revision_id, user_id AS record_id, event_type AS action, CASE WHEN value >= 20 THEN value END AS change, CASE WHEN value >= 20 THEN props END AS changes FROM events",
    "open_gaps": "SELECT l_orderkey AS record_id, l_linenumber AS gap, c_name AS entity, p_name AS indicator FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'R'",
    "artifact_status": """WITH r AS (SELECT o_custkey, max(o_orderkey) AS k, arg_max(o_orderstatus, o_orderkey) AS s, count(*) AS n FROM orders GROUP BY 1),
        l AS (SELECT l_orderkey AS k, count(*) AS n FROM (SELECT *, l_orderkey * 1000 + l_linenumber AS i FROM lineitem) WHERE i NOT IN (SELECT l_orderkey * 1000 + l_linenumber FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1)
        SELECT c_custkey AS artifact_id, r.k AS latest_run_id, s AS latest_run_status, coalesce(r.n, 0) AS run_count, coalesce(l.n, 0) AS open_invalidation_count FROM customer LEFT JOIN r ON o_custkey = c_custkey LEFT JOIN l ON l.k = r.k""",
    "analysis_summary": "SELECT l_suppkey, count(l_quantity) AS input_count, min(l_quantity) AS minimum, max(l_quantity) AS maximum, avg(l_quantity) AS mean FROM lineitem GROUP BY 1",
    "table_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")),
    "frozen_positions": "SELECT o_custkey AS run, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS INT) AS position FROM orders",
    "identifier_resolution": "SELECT l_orderkey * 1000 + l_linenumber AS asked_id, p_partkey AS entity_id, max(l_linenumber % 2 = 0) AS exact FROM lineitem JOIN part ON p_partkey = l_partkey WHERE lower(p_type) = 'economy' GROUP BY 1, 2",
    "quarantine_recovery": """WITH q AS (SELECT o_orderkey, concat_ws(';', CASE WHEN o_orderstatus = 'O' THEN 'grade cannot be transformed' END, CASE WHEN o_orderkey % 7 = 0 THEN 'amount is required' END) AS was, split_part(o_orderpriority, '-', 1) AS grade FROM orders)
        SELECT o_orderkey, was, grade, CASE WHEN o_orderkey % 7 = 0 THEN 'open' ELSE 'resolved' END AS status, CASE WHEN o_orderkey % 7 = 0 THEN 'amount is required' ELSE '' END AS left_over FROM q WHERE was <> ''""",
    "derivation_check": """SELECT l_orderkey * 1000 + l_linenumber AS line, CASE WHEN l_returnflag = 'R' THEN 'change' ELSE 'sign' END AS differs FROM lineitem WHERE l_returnflag = 'A' OR (l_returnflag = 'R' AND l_quantity <> 0)""",
}
