"""Versions, upserts and refreshes over events, orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import history, refresh, review
from attesta.sources.tables import table

AS_OF = "2024-03-01 00:00:00"


def _history(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", F.concat_ws(":", "event_type", F.floor(F.col("value") / 100)).alias("content"))


_HISTORY = "h AS (SELECT event_id, user_id, ts, event_type, event_type || ':' || CAST(floor(value / 100) AS BIGINT) AS content FROM events)"


def record_versions(spark, d):
    return history.versions(_history(spark, d), "user_id", "event_id", "content")


def record_revisions(spark, d):
    return history.revisions(_history(spark, d), "user_id", "event_id", "content").select("user_id", "event_id", "content", "revision", "action")


def event_chain(spark, d):
    return history.event_chain(_history(spark, d).select("user_id", "event_id"), "user_id", "event_id")


def _snapshot(spark, d, before: str):
    rows = _history(spark, d).where(F.col("ts") < before) if before else _history(spark, d)
    return history.last_write(rows.select("user_id", "event_id", "content"), ["user_id"], [F.col("event_id")])


def upsert_actions(spark, d):
    return history.upsert_actions(_snapshot(spark, d, "2024-01-10"), _snapshot(spark, d, "").where("user_id % 5 <> 0"), "user_id", "content")


def import_summary(spark, d):
    return upsert_actions(spark, d).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def dimension_upserts(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority", "o_orderstatus")
    return history.last_write(rows, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])


def seen_ranges(spark, d):
    return history.seen_range(table(spark, d, "events"), ["user_id", "event_type"], "ts")


def content_distinct(spark, d):
    return history.content_distinct(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_quantity"], "l_shipdate")


def fill_upsert(spark, d):
    rows = table(spark, d, "events")
    one = lambda c: rows.where(c).groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "click", F.col("event_id"))).alias("click"), F.max(F.when(F.col("event_type") != "click", F.col("event_id"))).alias("other"))
    return history.fill_upsert(one("ts < '2024-01-20'"), one("ts >= '2024-01-20'"), "user_id", ["click", "other"])


def latest_children(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("item"), F.year("o_orderdate").alias("version"), F.col("o_orderkey").alias("child"))
    return history.only_latest_children(rows, "item", "version")


def missing_derived(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("record"))
    return history.missing_derived(customers, table(spark, d, "orders").where("o_orderdate < '1998-01-01'").select(F.col("o_custkey").alias("record")), "record")


def gap_intervals(spark, d):
    gaps = _history(spark, d).where("event_type <> 'purchase'").select("user_id", F.to_date("ts").alias("day"), "event_type").distinct()
    return history.gap_intervals(gaps, "user_id", "day")


def _feed(spark, d):
    orders = table(spark, d, "orders")
    text = lambda price: F.concat_ws("|", "o_orderstatus", price.cast("decimal(18,2)"))
    old = orders.where("o_orderkey % 10 <> 0").select("o_orderkey", text(F.col("o_totalprice")).alias("content"))
    price = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return old, orders.where("o_orderkey % 7 <> 0").select("o_orderkey", text(price).alias("content"), "o_orderpriority")


_FEED = """
old AS (SELECT o_orderkey, o_orderstatus || '|' || CAST(o_totalprice AS DECIMAL(18,2)) AS c FROM orders WHERE o_orderkey % 10 <> 0),
new AS (SELECT o_orderkey, o_orderstatus || '|' || CAST(CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS DECIMAL(18,2)) AS c, o_orderpriority FROM orders WHERE o_orderkey % 7 <> 0),
refreshed AS (
  SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN n.c IS NULL THEN 'missing' WHEN o.c IS NULL THEN 'unexpected' WHEN o.c = n.c THEN 'matched' ELSE 'changed' END AS status,
         coalesce(o_orderpriority = '4-NOT SPECIFIED', false) AS quarantined, n.c IS NOT NULL AS active FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey)"""


def feed_refresh(spark, d):
    old, new = _feed(spark, d)
    return refresh.refresh(old, new, "o_orderkey", "content", F.col("o_orderpriority") == "4-NOT SPECIFIED")


def duplicate_rows(spark, d):
    keyed = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row_key"), F.struct("l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_extendedprice", "l_discount", "l_tax").alias("o"))
    return refresh.first_of_key(keyed, "row_key", "o").groupBy("duplicate").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_key").alias("n_keys"))


def _reconciled(spark, d):
    twice = duplicate_rows(spark, d).agg(F.coalesce(F.sum(F.when(F.col("duplicate"), F.col("n"))), F.lit(0)).alias("duplicates"))
    return refresh.reconciliation(feed_refresh(spark, d), twice, 0.1)


#: Seconds after which the feed of events is stale.
STALE_AFTER = 10 * 86400


def refresh_alerts(spark, d):
    """Alerts of the refresh of orders, watched with the age of the newest event and a restricted license."""
    newest = table(spark, d, "events").agg(F.max("ts").alias("ts"))
    age = F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    fresh = newest.select(F.when(age > STALE_AFTER, "stale").otherwise("current").alias("freshness"), F.lit("restricted").alias("license"))
    return refresh.alerts(_reconciled(spark, d).join(fresh))


def feed_freshness(spark, d):
    return refresh.staleness(table(spark, d, "events"), ["event_type"], "ts", F.lit(AS_OF).cast("timestamp"), 40 * 86400)


def schema_fingerprints(spark, d):
    return refresh.schema_fingerprint(table(spark, d, "events"), "event_type", "props")


def key_changes(spark, d):
    old, new = _feed(spark, d)
    return refresh.set_difference(old, new, "o_orderkey")


#: Where a decision leads, and which decisions a review state allows.
LEADS_TO = {
    "submitted": "submitted", "review_started": "in-review", "changes_requested": "changes-requested", "approved": "approved",
    "rejected": "rejected", "superseded": "superseded", "archived": "archived", "reopened": "draft",
}
ALLOWED = {
    "draft": ["submitted", "archived"],
    "submitted": ["review_started", "changes_requested", "rejected", "archived"],
    "in-review": ["changes_requested", "approved", "rejected", "archived"],
    "changes-requested": ["submitted", "review_started", "rejected", "archived"],
    "approved": ["superseded", "archived"],
    "rejected": ["submitted", "archived"],
    "superseded": ["archived"],
    "archived": ["reopened"],
}
MOVES = {state: {x: LEADS_TO[x] for x in decisions} for state, decisions in ALLOWED.items()}
_DECISIONS = (*LEADS_TO, "assigned")


def _decisions(spark, d):
    turns = table(spark, d, "conversations")
    place = (F.length(F.coalesce("text", F.lit(""))) + F.col("turn")) % len(_DECISIONS)
    return turns.select("conv_id", "turn", F.element_at(F.array(*map(F.lit, _DECISIONS)), (place + 1).cast("int")).alias("decision"))


def review_states(spark, d):
    return review.fold_decisions(_decisions(spark, d), "conv_id", "turn", "decision", MOVES, "draft")


_CASES = " ".join(f"WHEN state = '{s}' AND d.decision = '{x}' THEN '{to}'" for s, by in MOVES.items() for x, to in by.items())
_KNOWN = ", ".join(f"'{x}'" for x in sorted({x for by in MOVES.values() for x in by}))

QUERIES = {
    "record_versions": record_versions, "record_revisions": record_revisions, "event_chain": event_chain, "upsert_actions": upsert_actions, "import_summary": import_summary,
    "dimension_upserts": dimension_upserts, "seen_ranges": seen_ranges, "content_distinct": content_distinct, "fill_upsert": fill_upsert, "latest_children": latest_children,
    "missing_derived": missing_derived, "gap_intervals": gap_intervals, "feed_refresh": feed_refresh, "duplicate_rows": duplicate_rows, "feed_reconciliation": _reconciled, "refresh_alerts": refresh_alerts,
    "feed_freshness": feed_freshness, "schema_fingerprints": schema_fingerprints, "key_changes": key_changes, "review_states": review_states,
}

_ACTIONS = f"""{_HISTORY},
o AS (SELECT user_id, arg_max(content, event_id) AS c FROM h WHERE ts < '2024-01-10' GROUP BY 1), n AS (SELECT user_id, arg_max(content, event_id) AS c FROM h WHERE user_id % 5 <> 0 GROUP BY 1),
actions AS (SELECT coalesce(o.user_id, n.user_id) AS user_id, CASE WHEN o.user_id IS NULL THEN 'inserted' WHEN n.user_id IS NULL THEN 'kept' WHEN o.c = n.c THEN 'skipped' ELSE 'updated' END AS action,
            coalesce(n.c, o.c) AS content FROM o FULL JOIN n ON o.user_id = n.user_id)"""
_DUPLICATES = """numbered AS (SELECT l_orderkey || '-' || l_linenumber AS row_key, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_shipdate, l_extendedprice, l_discount, l_tax) > 1 AS duplicate FROM lineitem)"""
_RECONCILED = f"""{_FEED}, {_DUPLICATES},
s AS (SELECT count(*) FILTER (status <> 'unexpected') AS expected, count(*) FILTER (active) AS actual, count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'changed') AS changed,
      count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'unexpected') AS unexpected, count(*) FILTER (quarantined) AS quarantined,
      (SELECT count(*) FROM numbered WHERE duplicate) AS duplicates FROM refreshed),
run AS (SELECT *, round(missing / expected, 6) AS missing_ratio, round(missing / expected, 6) > 0.1 AS population_drift,
        CASE WHEN missing > 0 OR unexpected > 0 OR duplicates > 0 OR quarantined > 0 THEN 'warning' ELSE 'balanced' END AS status FROM s)"""

SQL = {
    "record_versions": f"""WITH {_HISTORY}, s AS (SELECT user_id, content, min(event_id) AS first_seen, max(event_id) AS last_seen FROM h GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first_seen) AS version, last_seen = max(last_seen) OVER (PARTITION BY user_id) AS is_latest FROM s""",
    "record_revisions": f"""WITH {_HISTORY}, c AS (SELECT * FROM (SELECT *, lag(content) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM h) WHERE b IS NULL OR b <> content),
        n AS (SELECT user_id, event_id, content, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS revision FROM c) SELECT *, CASE revision WHEN 1 THEN 'inserted' ELSE 'updated' END AS action FROM n""",
    "event_chain": "SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS previous_event_id FROM events",
    "upsert_actions": f"WITH {_ACTIONS} SELECT * FROM actions",
    "import_summary": f"WITH {_ACTIONS} SELECT action, count(*) AS n FROM actions GROUP BY 1",
    "dimension_upserts": "SELECT o_custkey, o_orderdate, o_orderkey, o_orderpriority, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "seen_ranges": "SELECT user_id, event_type, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM events GROUP BY 1, 2",
    "content_distinct": "SELECT sha256(l_linestatus || '|' || CAST(l_quantity AS VARCHAR) || '|' || l_returnflag) AS content_id, min(l_shipdate) AS first_seen, max(l_shipdate) AS fetched, count(*) AS n FROM lineitem GROUP BY 1",
    "fill_upsert": """WITH a AS (SELECT user_id, max(event_id) FILTER (event_type = 'click') AS click, max(event_id) FILTER (event_type <> 'click') AS other FROM events WHERE ts < '2024-01-20' GROUP BY 1),
        b AS (SELECT user_id, max(event_id) FILTER (event_type = 'click') AS click, max(event_id) FILTER (event_type <> 'click') AS other FROM events WHERE ts >= '2024-01-20' GROUP BY 1)
        SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(b.click, a.click) AS click, coalesce(b.other, a.other) AS other FROM a FULL JOIN b ON a.user_id = b.user_id""",
    "latest_children": "SELECT o_custkey AS item, year(o_orderdate) AS version, o_orderkey AS child FROM orders QUALIFY year(o_orderdate) = max(year(o_orderdate)) OVER (PARTITION BY o_custkey)",
    "missing_derived": "SELECT c_custkey AS record FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < '1998-01-01')",
    "gap_intervals": """WITH g AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, event_type FROM events WHERE event_type <> 'purchase'),
        s AS (SELECT user_id, day, lead(day) OVER (PARTITION BY user_id ORDER BY day) AS resolved_at FROM (SELECT DISTINCT user_id, day FROM g)) SELECT * FROM g JOIN s USING (user_id, day)""",
    "feed_refresh": f"WITH {_FEED} SELECT * FROM refreshed",
    "duplicate_rows": f"WITH {_DUPLICATES} SELECT duplicate, count(*) AS n, count(DISTINCT row_key) AS n_keys FROM numbered GROUP BY 1",
    "feed_reconciliation": f"WITH {_RECONCILED} SELECT * FROM run",
    "refresh_alerts": f"""WITH {_RECONCILED}, f AS (SELECT epoch(TIMESTAMP '{AS_OF}') - epoch(max(ts)) > {STALE_AFTER} AS stale FROM events)
        SELECT 'record-drift' AS alert, 'warning' AS severity FROM run WHERE missing > 0 OR unexpected > 0 UNION ALL SELECT 'quarantine', 'warning' FROM run WHERE quarantined > 0
        UNION ALL SELECT 'reconciliation', 'warning' FROM run WHERE status = 'warning' UNION ALL SELECT 'license', 'critical' FROM run UNION ALL SELECT 'freshness', 'warning' FROM f WHERE stale""",
    "feed_freshness": f"""WITH m AS (SELECT event_type, max(ts) AS newest FROM events GROUP BY 1), a AS (SELECT *, CAST(floor(epoch(TIMESTAMP '{AS_OF}')) - floor(epoch(newest)) AS BIGINT) AS age_seconds FROM m)
        SELECT *, CASE WHEN age_seconds IS NULL THEN 'unknown' WHEN age_seconds <= 3456000 THEN 'current' ELSE 'stale' END AS sla FROM a""",
    "schema_fingerprints": """WITH p AS (SELECT DISTINCT event_type, k || ':' || CASE WHEN regexp_full_match(v, '-?[0-9]+') THEN 'int' WHEN regexp_full_match(v, '-?[0-9.]+([eE][-+]?[0-9]+)?') THEN 'float'
          WHEN v IN ('true', 'false') THEN 'bool' WHEN regexp_matches(v, '^[\\[{]') THEN 'nested' ELSE 'str' END AS p
          FROM (SELECT event_type, k, json_extract_string(props, '$.' || k) AS v FROM (SELECT event_type, props, unnest(json_keys(props)) AS k FROM events)) WHERE v IS NOT NULL),
        j AS (SELECT event_type, string_agg(p, ',' ORDER BY p) AS paths FROM p GROUP BY 1) SELECT *, sha256(paths) AS fingerprint FROM j""",
    "key_changes": f"WITH {_FEED} SELECT o_orderkey, CASE status WHEN 'missing' THEN 'removed' ELSE 'added' END AS change FROM refreshed WHERE status IN ('missing', 'unexpected')",
    "review_states": f"""WITH RECURSIVE d AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, decision) AS i, decision FROM
          (SELECT conv_id, turn, list_extract(['{"', '".join(_DECISIONS)}'], CAST((length(coalesce(text, '')) + turn) % {len(_DECISIONS)} + 1 AS BIGINT)) AS decision FROM conversations)),
        f AS (SELECT conv_id, 0::BIGINT AS i, 'draft' AS state, 0 AS accepted, 0 AS rejected FROM (SELECT DISTINCT conv_id FROM d)
          UNION ALL SELECT f.conv_id, d.i, CASE {_CASES} ELSE state END, accepted + CASE {_CASES.replace("THEN '", "THEN 1 -- '").replace("WHEN", chr(10) + "WHEN")}
          ELSE 0 END, rejected + CASE WHEN d.decision NOT IN ({_KNOWN}) THEN 0 {_CASES.replace("THEN '", "THEN 0 -- '").replace("WHEN", chr(10) + "WHEN")}
          ELSE 1 END FROM f JOIN d ON f.conv_id = d.conv_id AND d.i = f.i + 1)
        SELECT conv_id, arg_max(state, i) AS state, arg_max(accepted, i) AS accepted, arg_max(rejected, i) AS rejected, max(i) AS n_decisions FROM f GROUP BY conv_id""",
}
