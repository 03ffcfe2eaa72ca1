"""Catalog, entity registry, graph and access queries over the dimension tables, orders, events and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import derive
from attesta.operators import access, catalog, entities, graph
from attesta.sources.shared import stored
from attesta.sources.tables import table

AS_OF = "2024-02-20 00:00:00"


def _stamp():
    return F.lit(AS_OF).cast("timestamp")


def _entries(spark, d):
    events = table(spark, d, "events").withColumn("day", F.to_date("ts")).withColumn("at", F.col("ts").cast("timestamp"))
    orders = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate")).withColumn("at", F.col("o_orderdate").cast("timestamp"))
    docs = table(spark, d, "documents").withColumn("day", F.lit(None).cast("string")).withColumn("at", F.lit(None).cast("timestamp"))
    return catalog.entries(
        [catalog.series_profile(events, "events", ["event_type"], "day", "at"), catalog.series_profile(orders, "orders", ["o_orderpriority", "o_orderstatus"], "day", "at"), catalog.series_profile(docs, "documents", ["source", "lang"], "day", "at")], _stamp()
    )


def catalog_entries(spark, d):
    return _entries(spark, d).drop("latest")


def catalog_search(spark, d):
    found = catalog.search(_entries(spark, d), ["dataset_key", "tags"], "URGENT", {"provider": "orders"})
    return catalog.page(found.select("provider", "dataset_key", "n_rows"), [F.desc("n_rows"), F.col("dataset_key")], 10, 1)


def catalog_sync(spark, d):
    before = table(spark, d, "events").where("ts < '2024-01-20'").groupBy(F.concat_ws("/", "user_id", "event_type").alias("series")).agg(F.min(F.to_date("ts")).alias("first_seen"))
    after = table(spark, d, "events").where("ts >= '2024-01-20'").select(F.concat_ws("/", "user_id", "event_type").alias("series")).distinct()
    return catalog.sync(before, after, "series", F.lit("2024-02-01").cast("date"))


def empty_series(spark, d):
    known = table(spark, d, "nation").select(F.lit("sales").alias("provider"), F.col("n_nationkey").cast("string").alias("dataset_key"), "n_name")
    sales = table(spark, d, "customer").where("c_acctbal > 9500").withColumn("p", F.lit(None).cast("string")).withColumn("at", F.lit(None).cast("timestamp"))
    return catalog.with_empty_series(known, catalog.series_profile(sales, "sales", ["c_nationkey"], "p", "at")).select("dataset_key", "n_name", "n_rows")


def status_rollup(spark, d):
    return _entries(spark, d).groupBy("provider").agg(F.count(F.lit(1)).alias("n_series"), F.sum("n_rows").alias("n_rows"), F.count_if(F.col("freshness") == "stale").alias("n_stale"), F.max("last_period").alias("last_period"))


def _nations(spark, d):
    return table(spark, d, "nation").select("n_nationkey", "n_regionkey", "n_name")


def entity_registry(spark, d):
    return entities.register(_nations(spark, d), "country", "n_name", "n_nationkey").unionByName(entities.register(table(spark, d, "part"), "product", "p_name", "p_brand"))


def identifier_conflicts(spark, d):
    claims = table(spark, d, "part").select(F.lit("type").alias("namespace"), F.concat_ws("/", "p_brand", "p_type", "p_size").alias("identifier"), F.col("p_name").alias("entity_id"))
    ok, refused = entities.attach_identifiers(claims)
    return ok.select("identifier", F.lit("accepted").alias("outcome")).unionByName(refused.select("identifier", F.lit("rejected").alias("outcome")))


def entity_resolution(spark, d):
    nations = entities.register(_nations(spark, d), "country", "n_name", "n_nationkey")
    ids = _nations(spark, d).select(derive.short_id("country", F.col("n_nationkey"), F.col("n_name")).alias("entity_id"), F.concat(F.lit("Land-"), "n_nationkey").alias("alias"))
    asked = table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("nation "), "s_nationkey")).when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit("LAND "), "s_nationkey")).when(F.col("s_suppkey") % 4 == 2, F.concat(F.lit("ation "), "s_nationkey")).otherwise(F.lit("?!")).alias("query"))
    return entities.resolve(asked, nations, entities.attach_aliases(ids)).drop("entity_id")


def code_crosswalk(spark, d):
    codes = _nations(spark, d).select(F.lit("a2").alias("namespace"), F.concat(F.lit("N"), "n_nationkey").alias("identifier"), F.col("n_name").alias("entity_id")).where("n_nationkey < 15")
    codes = codes.unionByName(_nations(spark, d).select(F.lit("m49").alias("namespace"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("identifier"), F.col("n_name").alias("entity_id")).where("n_nationkey < 20"))
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("N"), "c_nationkey").alias("a2"), F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("m49"))
    return entities.crosswalk(rows, codes, ["a2", "m49"], ["a2", "m49"]).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))


def _nodes(spark, d):
    node = lambda df, kind, key, label: df.select(F.concat(F.lit(f"{kind}:"), key).alias("node_id"), F.lit(kind).alias("kind"), F.col(label).alias("label"))
    return graph.nodes([node(table(spark, d, "region"), "region", "r_regionkey", "r_name"), node(_nations(spark, d), "nation", "n_nationkey", "n_name"), node(table(spark, d, "customer"), "customer", "c_custkey", "c_name"), node(table(spark, d, "supplier"), "supplier", "s_suppkey", "s_name")])


def _edges(spark, d):
    edge = lambda df, a, ak, p, b, bk, c: df.select(F.concat(F.lit(f"{a}:"), ak).alias("source"), F.lit(p).alias("predicate"), F.concat(F.lit(f"{b}:"), bk).alias("target"), c.alias("confidence"))
    return graph.edges(
        [
            edge(_nations(spark, d), "nation", "n_nationkey", "part-of", "region", "n_regionkey", F.lit(1.0)), edge(table(spark, d, "customer"), "customer", "c_custkey", "represented-in", "nation", "c_nationkey", F.col("c_acctbal") / 10000),
            edge(table(spark, d, "supplier"), "supplier", "s_suppkey", "represented-in", "nation", "s_nationkey", F.lit(2.0)),
        ]
    )


def graph_edges(spark, d):
    return _edges(spark, d)


def graph_degrees(spark, d):
    return graph.degrees(_nodes(spark, d), _edges(spark, d))


def graph_search(spark, d):
    found = catalog.search(_nodes(spark, d), ["label"], "nation_1", {"kind": "nation"})
    return catalog.page(found, [F.col("node_id")], 500, 0)


def graph_neighbours(spark, d):
    return graph.neighbours(_edges(spark, d), F.col("node_id").startswith("nation:"))


def graph_paths(spark, d):
    starts = table(spark, d, "region").select(F.concat(F.lit("region:"), "r_regionkey").alias("node_id"))
    return graph.shortest_paths(stored(_edges(spark, d), "edges"), starts, 4, stored).select("start", "node_id", "depth", F.array_join(F.transform("path", lambda h: h["edge_id"]), " > ").alias("path"))


def graph_rebuild(spark, d):
    return graph.rebuild_events(_edges(spark, d).where("confidence < 0.9"), _edges(spark, d).where("confidence > 0.1"))


def graph_status(spark, d):
    return _edges(spark, d).groupBy("predicate").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("n_sources"), F.count_distinct("target").alias("n_targets"), F.max("confidence").alias("most"))


def federated_view(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderdate")
    return graph.newest_per_source(orders, "o_custkey", "o_orderpriority", [F.desc("o_orderdate"), F.desc("o_orderkey")], 2).select("o_custkey", "o_orderpriority", "o_orderkey", "total", "place")


def role_authorisation(spark, d):
    members = table(spark, d, "orders").select(F.col("o_custkey").alias("principal"), F.col("o_orderpriority").alias("workspace"), F.col("o_orderstatus").alias("role"), (F.col("o_orderkey") % 4 != 0).alias("active"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("expires_at"))
    permissions = spark.createDataFrame([("F", "read"), ("F", "write"), ("O", "read"), ("P", "*")], "role string, permission string")
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("principal"), F.lit("2-HIGH").alias("workspace"), F.explode(F.array(F.lit("read"), F.lit("write"), F.lit("admin"))).alias("permission"))
    return access.authorised(members, permissions, asked, F.lit("1999-01-01").cast("timestamp_ntz"))


def disposition(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "P").alias("legal_hold"), F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.date_add("o_orderdate", 365)).alias("due_date"))
    return access.disposition(rows, F.lit("1999-06-30").cast("date")).select("o_orderkey", "eligible", "reasons")


def assignments(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("workspace"), F.to_date("o_orderdate").alias("assigned_at"), (F.col("o_custkey") % 30).cast("int").alias("days"))
    changes = rows.where("o_orderkey % 6 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 12 == 0, F.lit("1-URGENT")).alias("workspace"), F.lit(None).cast("date").alias("assigned_at"), F.lit(90).alias("days"))
    now, moved = access.assign(rows, changes, "o_orderkey")
    return now.join(moved, "o_orderkey", "left").select("o_orderkey", "workspace", "due_date", "from_workspace")


def input_integrity(spark, d):
    orders = table(spark, d, "orders")
    frozen = orders.select("o_orderkey", (F.col("o_orderkey") % 10).alias("run"), F.col("o_orderstatus").alias("content"))
    current = orders.where("o_orderkey % 5 <> 0").select("o_orderkey", F.when(F.col("o_custkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("content"))
    known = orders.where("o_orderkey % 30 = 0").select((F.col("o_orderkey") % 10).alias("run"), "o_orderkey", F.lit("missing").alias("status"))
    return access.invalidations(access.integrity(frozen, current, "o_orderkey", "content"), known, "run", "o_orderkey")


def run_manifest(spark, d):
    return access.manifest(table(spark, d, "orders"), ["o_orderstatus"], ["o_orderkey", "o_custkey", "o_orderpriority"])


QUERIES = {
    "catalog_entries": catalog_entries, "catalog_search": catalog_search, "catalog_sync": catalog_sync, "empty_series": empty_series, "status_rollup": status_rollup, "entity_registry": entity_registry,
    "identifier_conflicts": identifier_conflicts, "entity_resolution": entity_resolution, "code_crosswalk": code_crosswalk, "graph_edges": graph_edges, "graph_degrees": graph_degrees, "graph_search": graph_search,
    "graph_neighbours": graph_neighbours, "graph_paths": graph_paths, "graph_rebuild": graph_rebuild, "graph_status": graph_status, "federated_view": federated_view, "role_authorisation": role_authorisation,
    "disposition": disposition, "assignments": assignments, "input_integrity": input_integrity, "run_manifest": run_manifest,
}

_ENTRIES = f"""p AS (
  SELECT 'events' AS provider, event_type AS dataset_key, count(*) AS n_rows, CAST(CAST(min(ts) AS DATE) AS VARCHAR) AS first_period, CAST(CAST(max(ts) AS DATE) AS VARCHAR) AS last_period, max(ts) AS latest FROM events GROUP BY 2
  UNION ALL SELECT 'orders', o_orderpriority || '/' || o_orderstatus, count(*), CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR), CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR), max(o_orderdate) FROM orders GROUP BY 2
  UNION ALL SELECT 'documents', coalesce(source, '') || '/' || coalesce(lang, ''), count(*), NULL, NULL, NULL FROM documents GROUP BY 2),
entries AS (
  SELECT provider, dataset_key, n_rows, first_period, last_period, 'dataset:' || substr(sha256(provider || '|' || dataset_key), 1, 32) AS entry_id,
         CASE WHEN latest IS NULL THEN 'unknown' WHEN age <= 30 THEN 'fresh' WHEN age <= 90 THEN 'aging' ELSE 'stale' END AS freshness,
         array_to_string(list_sort(list_distinct(list_transform(string_split(provider || '/' || dataset_key, '/'), lambda t: lower(trim(t))))), ',') AS tags
  FROM (SELECT *, floor((floor(epoch(TIMESTAMP '{AS_OF}')) - floor(epoch(latest))) / 86400) AS age FROM p))"""
_EDGES = """e AS (
  SELECT 'nation:' || n_nationkey AS source, 'part-of' AS predicate, 'region:' || n_regionkey AS target, 1.0::DOUBLE AS confidence FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'represented-in', 'nation:' || c_nationkey, greatest(0, least(1, c_acctbal / 10000)) FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'represented-in', 'nation:' || s_nationkey, 1.0 FROM supplier),
edges AS (SELECT *, source || '|' || predicate || '|' || target AS edge_id FROM e)"""

_PIECE = "CAST(sum(CAST('0x' || substr({0}, {1}, 12) AS BIGINT)) AS VARCHAR)"

SQL = {
    "catalog_entries": f"WITH {_ENTRIES} SELECT * FROM entries",
    "catalog_search": f"WITH {_ENTRIES} SELECT provider, dataset_key, n_rows FROM entries WHERE provider = 'orders' AND dataset_key ILIKE '%urgent%' ORDER BY n_rows DESC, dataset_key LIMIT 10 OFFSET 1",
    "catalog_sync": """WITH b AS (SELECT user_id || '/' || event_type AS series, min(CAST(ts AS DATE)) AS f FROM events WHERE ts < '2024-01-20' GROUP BY 1), a AS (SELECT DISTINCT user_id || '/' || event_type AS series FROM events WHERE ts >= '2024-01-20')
        SELECT coalesce(a.series, b.series) AS series, a.series IS NOT NULL AS active, coalesce(f, DATE '2024-02-01') AS first_seen FROM a FULL JOIN b ON a.series = b.series""",
    "empty_series": "SELECT CAST(n_nationkey AS VARCHAR) AS dataset_key, n_name, count(c_custkey) AS n_rows FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 9500) ON n_nationkey = c_nationkey GROUP BY 1, 2",
    "status_rollup": f"WITH {_ENTRIES} SELECT provider, count(*) AS n_series, CAST(sum(n_rows) AS BIGINT) AS n_rows, count(*) FILTER (freshness = 'stale') AS n_stale, max(last_period) AS last_period FROM entries GROUP BY 1",
    "entity_registry": """WITH r AS (SELECT 'country' AS kind, n_name AS name, CAST(n_nationkey AS VARCHAR) AS k FROM nation UNION SELECT 'product', p_name, p_brand FROM part)
        SELECT kind || ':' || substr(sha256(k || '|' || name), 1, 32) AS entity_id, kind, name, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS normal_name FROM r""",
    "identifier_conflicts": "SELECT p_brand || '/' || p_type || '/' || p_size AS identifier, CASE WHEN count(DISTINCT p_name) = 1 THEN 'accepted' ELSE 'rejected' END AS outcome FROM part GROUP BY 1",
    "entity_resolution": """WITH q AS (SELECT DISTINCT CASE s_suppkey % 4 WHEN 0 THEN 'nation ' || s_nationkey WHEN 1 THEN 'LAND ' || s_nationkey WHEN 2 THEN 'ation ' || s_nationkey ELSE '?!' END AS query FROM supplier),
        n AS (SELECT query, trim(regexp_replace(lower(query), '[^a-z0-9]+', ' ', 'g')) AS q FROM q), names AS (SELECT n_nationkey AS id, replace(lower(n_name), '_', ' ') AS x FROM nation), alias AS (SELECT n_nationkey AS id, 'land ' || n_nationkey AS x FROM nation),
        ex AS (SELECT query, id FROM n JOIN (SELECT * FROM names UNION SELECT * FROM alias) ON q = x), sub AS (SELECT query, id FROM n JOIN names ON contains(x, q) WHERE q <> '' AND query NOT IN (SELECT query FROM ex)),
        c AS (SELECT query, count(DISTINCT id) AS n_candidates, max(c) AS confidence FROM (SELECT *, 1.0::DOUBLE AS c FROM ex UNION ALL SELECT *, 0.65::DOUBLE FROM sub) GROUP BY 1)
        SELECT query, CASE WHEN n_candidates IS NULL THEN 'not-found' WHEN n_candidates = 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome, coalesce(n_candidates, 0) AS n_candidates, confidence FROM n LEFT JOIN c USING (query)""",
    "code_crosswalk": "SELECT CASE WHEN n_nationkey < 20 THEN n_name END AS entity_id, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "graph_edges": f"WITH {_EDGES} SELECT * FROM edges",
    "graph_degrees": f"""WITH {_EDGES}, n AS (SELECT 'region:' || r_regionkey AS node_id, 'region' AS kind FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'nation' FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'customer' FROM customer
        UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier' FROM supplier) SELECT node_id, kind, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree FROM n LEFT JOIN (SELECT target, count(*) AS i FROM edges GROUP BY 1) ON node_id = target
        LEFT JOIN (SELECT source, count(*) AS o FROM edges GROUP BY 1) ON node_id = source""",
    "graph_search": "SELECT 'nation:' || n_nationkey AS node_id, 'nation' AS kind, n_name AS label FROM nation WHERE contains(lower(n_name), 'nation_1')",
    "graph_neighbours": f"""WITH {_EDGES} SELECT source AS node_id, predicate, target AS neighbour, 'out' AS direction FROM edges WHERE starts_with(source, 'nation:')
        UNION ALL SELECT target, predicate, source, 'in' FROM edges WHERE starts_with(target, 'nation:')""",
    "graph_paths": f"""WITH {_EDGES}, b AS (SELECT source AS x, edge_id, target AS y FROM edges UNION ALL SELECT target, edge_id, source FROM edges)
        SELECT 'region:' || r_regionkey AS start, 'region:' || r_regionkey AS node_id, 0 AS depth, '' AS path FROM region
        UNION ALL SELECT x, y, 1, edge_id FROM b WHERE x LIKE 'region:%' UNION ALL SELECT p.x, q.y, 2, p.edge_id || ' > ' || q.edge_id FROM b p JOIN b q ON p.y = q.x WHERE p.x LIKE 'region:%' AND q.y <> p.x""",
    "graph_rebuild": f"WITH {_EDGES} SELECT edge_id, CASE WHEN confidence >= 0.9 THEN 'added' ELSE 'deactivated' END AS event FROM edges WHERE confidence >= 0.9 OR confidence <= 0.1",
    "graph_status": f"WITH {_EDGES} SELECT predicate, count(*) AS n, count(DISTINCT source) AS n_sources, count(DISTINCT target) AS n_targets, max(confidence) AS most FROM edges GROUP BY 1",
    "federated_view": """SELECT o_custkey, o_orderpriority, o_orderkey, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS total, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS place
        FROM orders QUALIFY place <= 2""",
    "role_authorisation": """WITH m AS (SELECT o_custkey, o_orderstatus AS s FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderkey % 4 <> 0 AND (o_orderkey % 3 = 0 OR o_orderdate > '1999-01-01')),
        g AS (SELECT o_custkey, bool_or(s = 'P') AS p, bool_or(s = 'F') AS f, bool_or(s = 'O') AS o FROM m GROUP BY 1)
        SELECT c_custkey AS principal, '2-HIGH' AS workspace, permission, coalesce(p OR (permission = 'read' AND (f OR o)) OR (permission = 'write' AND f), false) AS allowed
        FROM customer CROSS JOIN (VALUES ('read'), ('write'), ('admin')) t(permission) LEFT JOIN g ON c_custkey = o_custkey""",
    "disposition": """WITH r AS (SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus = 'P' THEN 'legal hold' END, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'no retention date' END,
        CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' AND CAST(o_orderdate AS DATE) + 365 > DATE '1999-06-30' THEN 'not due' END) AS reasons FROM orders) SELECT o_orderkey, reasons = '' AS eligible, reasons FROM r""",
    "assignments": """SELECT o_orderkey, CASE WHEN o_orderkey % 12 = 0 THEN '1-URGENT' ELSE o_orderpriority END AS workspace, CAST(o_orderdate AS DATE) + CAST(CASE WHEN o_orderkey % 6 = 0 THEN 90 ELSE o_custkey % 30 END AS INT) AS due_date,
        CASE WHEN o_orderkey % 12 = 0 AND o_orderpriority <> '1-URGENT' THEN o_orderpriority END AS from_workspace FROM orders""",
    "input_integrity": """SELECT o_orderkey % 10 AS run, o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'missing' ELSE 'changed' END AS status FROM orders
        WHERE (o_orderkey % 5 = 0 AND o_orderkey % 30 <> 0) OR (o_orderkey % 5 <> 0 AND o_custkey % 7 = 0 AND o_orderstatus <> 'X')""",
    "run_manifest": f"""WITH h AS (SELECT o_orderstatus, sha256(o_orderkey || '|' || o_custkey || '|' || o_orderpriority) AS h FROM orders)
        SELECT o_orderstatus, count(*) AS n, sha256({_PIECE.format("h", 1)} || ',' || {_PIECE.format("h", 13)} || ',' || {_PIECE.format("h", 25)}) AS sha256 FROM h GROUP BY 1""",
}
