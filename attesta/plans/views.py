"""Joined views: queues, dossiers, lineage summaries, statuses, exports and the batch forms of the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import history, review
from attesta.plans import registry_graph
from attesta.sources import exports
from attesta.sources.tables import table
from attesta.streaming import ingest


def review_queue(spark, d):
    """Open cases with their customer and the customer's latest order."""
    cases = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.max_by("role", "turn").alias("last_role"))
    latest = review.latest(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
    people = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    joined = cases.join(people, cases.conv_id == people.c_custkey).join(latest, F.col("c_custkey") == latest.o_custkey, "left")
    return joined.where("last_role <> 'system'").select("conv_id", "turns", "last_role", "c_name", "c_mktsegment", "o_orderkey", "o_orderstatus")


def lineage_summary(spark, d):
    """Three branches of a customer, each aggregated before the join, so that no count is multiplied."""
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.count_if(F.col("o_orderpriority") == "4-NOT SPECIFIED").alias("n_missing"))
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_distinct("l_partkey").alias("n_parts"), F.count_if(F.col("l_returnflag") == "R").alias("n_flagged"))
    events = table(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count_distinct("event_type").alias("n_types"))
    rows = table(spark, d, "customer").select("c_custkey").join(orders, "c_custkey", "left").join(lines, "c_custkey", "left").join(events, "c_custkey", "left")
    return rows.select("c_custkey", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_orders", "n_missing", "n_parts", "n_flagged", "n_types")))


#: Revisions in one row of a dossier.
TRAIL = 50


def record_dossier(spark, d):
    """A record's revisions in order, TRAIL of them a row, with how many revisions, events and open gaps it has in all."""
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    revised = history.revisions(rows.drop("value"), "user_id", "event_id", "event_type").withColumn("part", F.floor((F.col("revision") - 1) / TRAIL))
    trails = revised.groupBy("user_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("revision", "event_type"))), lambda x: x["event_type"]), ">").alias("trail"))
    counts = revised.groupBy("user_id").agg(F.max("revision").alias("n_revisions"))
    events = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("value") < 20).alias("n_gaps"))
    return trails.join(counts, "user_id").join(events, "user_id")


def observation_dimensions(spark, d):
    """Observations of a record with a map of their dimensions."""
    dims = table(spark, d, "lineitem").select("l_orderkey", F.explode(F.array(F.struct(F.lit("flag").alias("k"), F.col("l_returnflag").alias("v")), F.struct(F.lit("status").alias("k"), F.col("l_linestatus").alias("v")))).alias("x")).groupBy("l_orderkey", F.col("x.k").alias("k")).agg(F.min("x.v").alias("v"))
    maps = dims.groupBy("l_orderkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("m"))
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(maps, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_orderstatus", F.try_element_at("m", F.lit("flag")).alias("flag"), F.try_element_at("m", F.lit("status")).alias("status"))


def connector_status(spark, d):
    """Feeds with open alerts, quarantined rows and their latest run."""
    orders = table(spark, d, "orders")
    runs = orders.groupBy("o_orderpriority").agg(F.max("o_orderdate").alias("latest_run"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("o_totalprice") > 300000).alias("open_alerts"), F.count_if(F.col("o_orderstatus") == "P").alias("quarantined"))
    return runs.withColumn("health", F.when(F.col("quarantined") * 10 > F.col("n_rows"), "failing").when(F.col("open_alerts") > 0, "degraded").otherwise("healthy"))


def flat_export(spark, d):
    nested = table(spark, d, "orders").groupBy("o_custkey").agg(F.struct(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first")).alias("orders"), F.array_sort(F.collect_set("o_orderpriority")).alias("priorities"), F.array_sort(F.collect_set("o_orderkey")).alias("keys"))
    return exports.flatten_records(nested)


def jsonld_export(spark, d):
    return exports.jsonld_lines(registry_graph._nodes(spark, d), registry_graph._edges(spark, d), 1000)


def merged_stream(spark, d):
    """What the continuous upsert of events ends with."""
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return ingest.merged(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), "user_id", "event_id")


def late_events(spark, d):
    rows = table(spark, d, "events").select("event_id", "ts", (F.col("ts") + F.expr("make_dt_interval(0, 0, 0, event_id % 600)")).alias("arrived"))
    return ingest.flag_late(rows, "ts", "arrived", 300).select("event_id", "late")


QUERIES = {
    "review_queue": review_queue, "lineage_summary": lineage_summary, "record_dossier": record_dossier, "observation_dimensions": observation_dimensions, "connector_status": connector_status,
    "flat_export": flat_export, "jsonld_export": jsonld_export, "merged_stream": merged_stream, "late_events": late_events,
}

SQL = {
    "review_queue": """WITH c AS (SELECT conv_id, count(*) AS turns, arg_max(role, turn) AS last_role FROM conversations GROUP BY 1), l AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
        SELECT conv_id, turns, last_role, c_name, c_mktsegment, o_orderkey, o_orderstatus FROM c JOIN customer ON conv_id = c_custkey LEFT JOIN l ON o_custkey = c_custkey WHERE last_role <> 'system'""",
    "lineage_summary": """WITH o AS (SELECT o_custkey, count(*) AS n_orders, count(*) FILTER (o_orderpriority = '4-NOT SPECIFIED') AS n_missing FROM orders GROUP BY 1),
        l AS (SELECT o_custkey, count(DISTINCT l_partkey) AS n_parts, count(*) FILTER (l_returnflag = 'R') AS n_flagged FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1), e AS (SELECT user_id, count(DISTINCT event_type) AS n_types FROM events GROUP BY 1)
        SELECT c_custkey, coalesce(n_orders, 0) AS n_orders, coalesce(n_missing, 0) AS n_missing, coalesce(n_parts, 0) AS n_parts, coalesce(n_flagged, 0) AS n_flagged, coalesce(n_types, 0) AS n_types
        FROM customer LEFT JOIN o ON o.o_custkey = c_custkey LEFT JOIN l ON l.o_custkey = c_custkey LEFT JOIN e ON user_id = c_custkey""",
    "record_dossier": """WITH r AS (SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type)
        , t AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 50 AS part, count(*) OVER (PARTITION BY user_id) AS n_revisions FROM r), e AS (SELECT user_id, count(*) AS n_events, count(*) FILTER (value < 20) AS n_gaps FROM events GROUP BY 1)
        SELECT user_id, part, any_value(n_revisions) AS n_revisions, string_agg(event_type, '>' ORDER BY event_id) AS trail, any_value(n_events) AS n_events, any_value(n_gaps) AS n_gaps FROM t JOIN e USING (user_id) GROUP BY 1, 2""",
    "observation_dimensions": "SELECT o_orderkey, o_orderstatus, min(l_returnflag) AS flag, min(l_linestatus) AS status FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2",
    "connector_status": """WITH r AS (SELECT o_orderpriority, max(o_orderdate) AS latest_run, count(*) AS n_rows, count(*) FILTER (o_totalprice > 300000) AS open_alerts, count(*) FILTER (o_orderstatus = 'P') AS quarantined FROM orders GROUP BY 1)
        SELECT *, CASE WHEN quarantined * 10 > n_rows THEN 'failing' WHEN open_alerts > 0 THEN 'degraded' ELSE 'healthy' END AS health FROM r""",
    "flat_export": """SELECT o_custkey, count(*) AS orders_n, min(o_orderkey) AS orders_first, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ' | ') AS priorities, CAST(count(DISTINCT o_orderpriority) AS INT) AS priorities_count,
        replace(CAST(list_sort(list(DISTINCT o_orderkey)) AS VARCHAR), ' ', '') AS keys_json FROM orders GROUP BY 1""",
    "jsonld_export": f"""WITH {registry_graph._EDGES}, n AS (SELECT 'region:' || r_regionkey AS id, 'region' AS kind, r_name AS label FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name FROM nation
          UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name FROM supplier)
        (SELECT id, '{{"@id":"' || id || '","type":"' || kind || '","label":"' || label || '"}}' AS line, 'node' AS part, (SELECT count(*) FROM n) > 1000 AS truncated FROM n ORDER BY id LIMIT 1000)
        UNION ALL (SELECT edge_id, '{{"@id":"' || edge_id || '","subject":"' || source || '","predicate":"' || predicate || '","object":"' || target || '"}}', 'edge', (SELECT count(*) FROM edges) > 1000 FROM edges ORDER BY edge_id LIMIT 1000)""",
    "merged_stream": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1",
    "late_events": "SELECT event_id, CAST(floor(epoch(ts + to_seconds(event_id % 600))) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) > 300 AS late FROM events",
}
