"""Landed payloads, observations and scalar cleaning over orders, line items, events and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import derive
from attesta.sources import payloads
from attesta.sources.tables import table


def _packed(spark, d):
    """Orders of a customer as a header-row table, as the feeds land them."""
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.array(F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority"))).alias("r"))
    return rows.select("o_custkey", F.to_json(F.concat(F.array(F.array(F.lit("key"), F.lit("status"), F.lit("priority"))), F.col("r"))).alias("payload"))


def header_tables(spark, d):
    rows = payloads.header_table(_packed(spark, d), "payload", ["o_custkey"])
    return rows.select("o_custkey", F.col("record.key").cast("long").alias("o_orderkey"), F.col("record.status").alias("o_orderstatus"), F.col("record.priority").alias("o_orderpriority"))


def _named(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.when(F.col("event_id") % 11 == 0, F.array(F.col("event_id").cast("string"))).otherwise(F.array(F.col("event_id").cast("string"), "event_type")))).alias("r"))
    return rows.select("user_id", F.to_json(F.struct(F.struct(F.array(F.lit("id"), F.lit("kind")).alias("columnNames"), F.col("r").alias("rows")).alias("table"))).alias("payload"))


def named_tables(spark, d):
    rows = payloads.named_table(_named(spark, d), "payload", "table.columnNames", "table.rows", ["user_id"])
    return rows.select("user_id", F.col("record.id").cast("long").alias("event_id"), F.col("record.kind").alias("event_type"))


def envelopes(spark, d):
    """Two envelope shapes of nations; the records are found under a path and by the first list."""
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("items"))
    wrapped = rows.select("n_regionkey", F.to_json(F.struct(F.struct(F.array(F.struct("items")).alias("pages")).alias("result"))).alias("a"), F.to_json(F.struct(F.lit(1).alias("Total"), F.col("items").alias("Data"))).alias("b"))
    one = payloads.records_path(wrapped, "a", "result/pages.0.items", ["n_regionkey"]).withColumn("how", F.lit("path"))
    two = payloads.first_list(wrapped, "b", ["data", "Data", "observations", "items"], ["n_regionkey"]).withColumn("how", F.lit("first list"))
    return one.unionByName(two).select("n_regionkey", "how", F.get_json_object("record", "$.n_nationkey").cast("int").alias("n_nationkey"), F.get_json_object("record", "$.n_name").alias("n_name"))


def feature_events(spark, d):
    feature = F.struct(
        F.concat(F.lit("e"), "event_id").alias("id"), F.struct(F.round(F.col("value") / 100, 3).alias("mag"), F.col("event_type").alias("place"), F.unix_millis(F.col("ts").cast("timestamp")).alias("time")).alias("properties"),
        F.struct(F.array(F.col("user_id").cast("double"), (F.col("event_id") % 90).cast("double")).alias("coordinates")).alias("geometry"),
    )
    packed = table(spark, d, "events").groupBy("user_id").agg(F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("payload"))
    return payloads.feature_events(packed, "payload").where("magnitude >= 1").withColumn("millis", F.unix_millis("time")).drop("time")


def page_audit(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("run"), F.coalesce("html", F.lit("")).alias("html"))
    return payloads.page_audit(pages, "run", "page_id", "html")


def _observations(spark, d):
    lines = table(spark, d, "lineitem").select("l_suppkey", F.date_format("l_shipdate", "yyyy-MM").alias("period"), "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    a = payloads.to_observations(lines, "lines", "shipments", F.col("l_suppkey"), F.col("period"), {"quantity": F.col("l_quantity"), "price": F.col("l_extendedprice"), "discount": F.nullif(F.col("l_discount"), F.lit(0.0)), "tax": F.col("l_tax")})
    events = table(spark, d, "events").select("user_id", F.date_format("ts", "yyyy-MM").alias("period"), "value", F.get_json_object("props", "$.k").alias("k"))
    b = payloads.to_observations(events, "events", "clicks", F.col("user_id"), F.col("period"), {"value": F.col("value"), "k": derive.numeric_value(F.col("k"), "earth")})
    orders = table(spark, d, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("period"), "o_totalprice")
    c = payloads.to_observations(orders, "orders", "sales", F.col("o_custkey"), F.col("period"), {"total": F.col("o_totalprice")})
    return a.unionByName(b).unionByName(c)


def observation_profile(spark, d):
    """The union of all feeds, summed by provider and metric."""
    exact = F.sum(F.col("value_numeric").cast("decimal(28,4)")).cast("double")
    return _observations(spark, d).groupBy("provider", "dataset", "metric_code").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("geography_id").alias("n_places"), F.min("period").alias("first_period"), F.max("period").alias("last_period"), exact.alias("total"))


def observation_reads(spark, d):
    """Reads by provider, place and period range, newest first."""
    rows = _observations(spark, d).where("provider = 'orders' AND period BETWEEN '1997-01' AND '1998-06' AND geography_id IN ('1', '2', '4', '7', '10')")
    return rows.select("geography_id", "period", "metric_code", "value_numeric").orderBy(F.desc("period"), "geography_id", "value_numeric").limit(500)


def range_reads(spark, d):
    """Part of the range reads: by value and time, and by a text in several columns."""
    rows = table(spark, d, "events").where("value >= 50 AND ts >= '2024-01-05' AND ts < '2024-01-12'")
    return rows.where(F.concat_ws(" ", "event_type", "props").ilike("%a%")).select("event_id", "event_type", "value")


SPEC = {
    "name": {"source": "priority", "transforms": ["trim", "lower", ("replace", {"old": "-", "new": " "})], "required": True},
    "grade": {"source": "priority", "transforms": [("split", {"delimiter": "-", "at": 0}), "integer"]},
    "scaled": {"source": "price", "transforms": [("multiply", {"value": 100}), "integer"]},
    "flag": {"source": "status", "transforms": [("replace", {"old": "F", "new": "yes"}), "boolean"]},
    "note": {"source": "note", "default": "none", "transforms": ["upper"]},
    "owner": {"source": "owner", "required": True},
    "kind": {"constant": "order"},
}


def mapped_rows(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.create_map(F.lit("priority"), F.col("o_orderpriority"), F.lit("price"), F.col("o_custkey").cast("string"), F.lit("status"), F.col("o_orderstatus"), F.lit("owner"), F.when(F.col("o_orderkey") % 9 != 0, F.concat(F.lit("c"), "o_custkey"))).alias("row"))
    return payloads.mapped(rows, SPEC, "row").select("o_orderkey", "name", "grade", "scaled", "flag", "note", "kind", F.array_join("errors", ";").alias("errors"))


def cleaned_values(spark, d):
    """Number and text cleaning over texts made of part sizes and prices."""
    text = F.element_at(F.array(F.col("p_size").cast("string"), F.lit(" NA "), F.concat(F.lit("1,"), F.lpad((F.col("p_size") * 7).cast("string"), 3, "0")), F.lit("inf"), F.lit("--"), F.col("p_name")), (F.col("p_partkey") % 6 + 1).cast("int"))
    rows = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", text.alias("raw"))
    uri = F.concat(F.lit("https://x.example/api?q="), "p_partkey", F.lit("&api_key=s3cret"), "p_partkey", F.lit("#t"))
    return rows.select(
        "p_partkey", derive.numeric_value(F.col("raw"), "national").alias("national"), derive.text_value(F.col("raw"), "national").alias("national_text"), derive.numeric_value(F.col("raw"), "statistics").alias("statistics"),
        F.array_join(derive.text_list(F.concat("p_brand", F.lit("; "), "p_type", F.lit("| "), "p_brand")), "+").alias("listed"), derive.redact(uri).alias("uri"),
        derive.identity_key(F.create_map(F.lit("type"), F.col("p_type"), F.lit("brand"), F.col("p_brand"))).alias("identity"), derive.truthy(F.when(F.col("p_partkey") % 3 == 0, " Yes").otherwise("off"), "space").alias("truthy"),
        derive.convert_unit(F.col("p_partkey").cast("double"), F.lit(0.5), F.lit(10.0), F.lit(2.0), F.lit(0.0), F.col("p_partkey") % 2 == 0).alias("converted"),
    )


QUERIES = {
    "header_tables": header_tables, "named_tables": named_tables, "envelopes": envelopes, "feature_events": feature_events, "page_audit": page_audit, "observation_profile": observation_profile,
    "observation_reads": observation_reads, "range_reads": range_reads, "mapped_rows": mapped_rows, "cleaned_values": cleaned_values,
}

SQL = {
    "header_tables": "SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority FROM orders",
    "named_tables": "SELECT user_id, event_id, event_type FROM events WHERE event_id % 11 <> 0",
    "envelopes": "SELECT n_regionkey, how, n_nationkey, n_name FROM nation, (VALUES ('path'), ('first list')) t(how)",
    "feature_events": """SELECT 'e' || event_id AS event, round(value / 100, 3) AS magnitude, event_type AS place, CAST(user_id AS DOUBLE) AS longitude, CAST(event_id % 90 AS DOUBLE) AS latitude,
        CAST(NULL AS DOUBLE) AS depth, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS millis FROM events WHERE round(value / 100, 3) >= 1""",
    "page_audit": """SELECT run, count(*) AS n_pages, CAST(sum(strlen(html)) AS BIGINT) AS n_bytes, sha256(string_agg(h, '' ORDER BY page_id, h)) AS payload_sha256, arg_max(length(html), (page_id, h)) AS last_length
        FROM (SELECT *, sha256(html) AS h FROM (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS run, coalesce(html, '') AS html FROM pages)) GROUP BY run""",
    "observation_profile": """WITH o AS (
        SELECT 'lines' AS provider, 'shipments' AS dataset, l_suppkey AS g, strftime(l_shipdate, '%Y-%m') AS period, unnest(['quantity', 'price', 'discount', 'tax']) AS metric_code, unnest([l_quantity, l_extendedprice, nullif(l_discount, 0), l_tax]) AS v FROM lineitem
        UNION ALL SELECT 'events', 'clicks', user_id, strftime(ts, '%Y-%m'), unnest(['value', 'k']), unnest([value, CAST(json_extract_string(props, '$.k') AS DOUBLE)]) FROM events
        UNION ALL SELECT 'orders', 'sales', o_custkey, strftime(o_orderdate, '%Y-%m'), 'total', o_totalprice FROM orders)
        SELECT provider, dataset, metric_code, count(*) AS n, count(DISTINCT g) AS n_places, min(period) AS first_period, max(period) AS last_period, CAST(sum(CAST(v AS DECIMAL(28,4))) AS DOUBLE) AS total FROM o WHERE v IS NOT NULL GROUP BY 1, 2, 3""",
    "observation_reads": """SELECT CAST(o_custkey AS VARCHAR) AS geography_id, strftime(o_orderdate, '%Y-%m') AS period, 'total' AS metric_code, o_totalprice AS value_numeric FROM orders
        WHERE strftime(o_orderdate, '%Y-%m') BETWEEN '1997-01' AND '1998-06' AND o_custkey IN (1, 2, 4, 7, 10) ORDER BY 2 DESC, 1, 4 LIMIT 500""",
    "range_reads": "SELECT event_id, event_type, value FROM events WHERE value >= 50 AND ts >= '2024-01-05' AND ts < '2024-01-12' AND event_type || ' ' || props ILIKE '%a%'",
    "mapped_rows": """SELECT o_orderkey, replace(lower(trim(o_orderpriority)), '-', ' ') AS name, split_part(o_orderpriority, '-', 1) AS grade, CAST(o_custkey * 100 AS VARCHAR) AS scaled,
        CASE WHEN replace(o_orderstatus, 'F', 'yes') = 'yes' THEN 'true' ELSE 'false' END AS flag, 'NONE' AS note, 'order' AS kind, CASE WHEN o_orderkey % 9 = 0 THEN 'owner is required' ELSE '' END AS errors FROM orders""",
    "cleaned_values": """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size WHEN 2 THEN 1000 + p_size * 7 END::DOUBLE AS national, CASE p_partkey % 6 WHEN 3 THEN 'inf' WHEN 5 THEN p_name END AS national_text,
        CASE p_partkey % 6 WHEN 0 THEN p_size END::DOUBLE AS statistics, p_brand || '+' || p_type AS listed, 'https://x.example/api?q=' || p_partkey || '&api_key=REDACTED#t' AS uri,
        'brand:' || p_brand || ';type:' || p_type AS identity, p_partkey % 3 = 0 AS truthy, CASE WHEN p_partkey % 2 = 0 THEN round((p_partkey * 0.5::DOUBLE + 10) / 2, 12) END AS converted FROM part""",
}
