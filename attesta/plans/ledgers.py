"""Replayed feeds, snapshots of sources, re-derived records, frozen runs and lineage edges over the given tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from attesta.operators import ledger, refresh, studio
from attesta.plans import changes, star
from attesta.sources import versions
from attesta.sources.shared import scratch
from attesta.sources.tables import table


def replay_runs(spark, d):
    """A feed of orders run once and its landed payload replayed twice: what each run found, by whether it is a replay."""
    old, new = changes._feed(spark, d)
    old = old.withColumn("side", F.lit("old"))
    payload = old.unionByName(new.select("o_orderkey", "content", F.lit("new").alias("side")))

    def process(landed):
        side = lambda s: landed.where(F.col("side") == s).drop("side")
        return refresh.refresh(side("old"), side("new"), "o_orderkey", "content")

    root = scratch(spark, "replay")
    first = ledger.run(payload, root, "orders", process)
    again = [ledger.replay(spark, root, first, process) for _ in range(2)]
    runs = versions.read(spark, f"{root}/runs").select("run", F.col("parent").isNotNull().alias("is_replay"))
    results = [versions.read(spark, f"{root}/results", [r]).withColumn("run", F.lit(r)) for r in {first, *again}]
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    return found.join(F.broadcast(runs), "run").groupBy("is_replay", "status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("run").alias("n_runs"))


def source_snapshots(spark, d):
    """Snapshots of hosts from their pages, appended twice, and one event for every document linked to a host's snapshot."""
    pages = table(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("source_id"), "page_id", F.sha2("html", 256).alias("content_sha256"), "url")
    snapshots = pages.select("source_id", F.concat(F.lit("t"), F.col("page_id").cast("string")).alias("retrieved_at"), "content_sha256", F.col("url").alias("storage_uri"))
    known = pages.where("page_id % 5 <> 0").groupBy("source_id").agg(F.count(F.lit(1)).alias("version"))
    links = pages.select("source_id", (F.col("page_id") % 7).alias("record_id"))
    root = scratch(spark, "snapshots")
    ledger.append_snapshots(snapshots.where("length(content_sha256) = 64 AND substr(content_sha256, 1, 1) < '8'"), known, links, root)
    ledger.append_snapshots(snapshots, known, links, root)
    new, more = ledger.append_snapshots(snapshots, known, links, root)
    events = versions.read(spark, f"{root}/events").groupBy("source_id").agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("record_id").alias("n_records"))
    stored = versions.read(spark, f"{root}/snapshots").groupBy("source_id").agg(F.count(F.lit(1)).alias("n_snapshots"), F.max("version").alias("version"))
    return stored.join(events, "source_id", "left").withColumn("n_again", F.lit(new + more).cast("long"))


def rederived_records(spark, d):
    """Records of the star, some without their derived judgments, after those were derived in place."""
    full = star.records(spark, d).select("record_id", "baseline", "current", "confidence", "source_name", "direction", "percent_change", "evidence_status", "signal")
    lost = F.pmod(F.xxhash64("record_id"), F.lit(3)) == 0
    names = ("percent_change", "evidence_status", "signal")
    partial = full.select("record_id", "baseline", "current", "confidence", "source_name", "direction", *(F.when(~lost, F.col(n)).alias(n) for n in names), F.when(~lost, 2).otherwise(1).alias("rules"))
    path = scratch(spark, "records")
    ledger.store_records(partial, path, buckets=8)
    again = lambda rows: studio.with_derivations(rows).withColumn("rules", F.lit(2))
    n = ledger.rederive(spark, path, F.col("rules") < 2, again, scratch(spark, "aside"))
    left = ledger.rederive(spark, path, F.col("rules") < 2, again, scratch(spark, "aside"))
    rows = spark.read.parquet(path)
    return rows.select("record_id", *names, "rules", F.lit(n > 0).alias("some_stale"), F.lit(left).cast("long").alias("left_stale"))


def frozen_run(spark, d):
    """Comparisons of the rows of a frozen query run, read again, and whether its digest still holds."""
    root = scratch(spark, "frozen")
    run = ledger.freeze(studio.run_query(star.records(spark, d), star.STUDIO), json.dumps(star.STUDIO, sort_keys=True), root)
    rows, manifest = ledger.frozen(spark, root, run)
    return studio.comparisons(rows).withColumns({"intact": F.lit(manifest["intact"]), "n_frozen": F.lit(manifest["rows"])})


def derived_lineage(spark, d):
    """Edges from orders to the parts they were derived from, appended twice, counted for every order and part asked."""
    lines = table(spark, d, "lineitem").select(
        F.concat(F.lit("run-"), F.col("l_returnflag")).alias("run_id"), F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("derived_id"), F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("source_id"), F.lit("{}").alias("transformation"),
    )
    name, path = f"lineage_{uuid.uuid4().hex}", scratch(spark, "lineage")
    ledger.append_edges(lines.where("run_id <> 'run-N'"), name, path)
    ledger.append_edges(lines, name, path)
    again = ledger.append_edges(lines, name, path)
    asked = table(spark, d, "part").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("record_id")).unionByName(table(spark, d, "orders").select(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("record_id")))
    return ledger.edge_counts(spark, name, asked).withColumn("n_again", F.lit(again).cast("long"))


QUERIES = {"replay_runs": replay_runs, "source_snapshots": source_snapshots, "rederived_records": rederived_records, "frozen_run": frozen_run, "derived_lineage": derived_lineage}

_LIMITED = f"""{star.RECORDS}, limited AS (SELECT * FROM records WHERE {star.STUDIO_WHERE} ORDER BY {star.STUDIO_ORDER} LIMIT 200)"""

SQL = {
    "replay_runs": f"WITH {changes._FEED} SELECT is_replay, status, count(*) AS n, 1 AS n_runs FROM refreshed, (VALUES (false), (true)) v(is_replay) GROUP BY 1, 2",
    "source_snapshots": """WITH p AS (SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS source_id, page_id, url, sha256(html) AS c FROM pages), k AS (SELECT source_id, count(*) AS version FROM p WHERE page_id % 5 <> 0 GROUP BY 1),
        s AS (SELECT source_id, count(*) AS n_snapshots, any_value(version) AS version FROM (SELECT DISTINCT source_id, page_id, c, url FROM p) JOIN k USING (source_id) GROUP BY 1), l AS (SELECT source_id, count(DISTINCT page_id % 7) AS n_records FROM p GROUP BY 1)
        SELECT source_id, n_snapshots, version, n_snapshots * n_records AS n_events, n_records, 0 AS n_again FROM s JOIN l USING (source_id)""",
    "rederived_records": f"WITH {star.RECORDS} SELECT record_id, percent_change, evidence_status, signal, 2 AS rules, true AS some_stale, 0 AS left_stale FROM records",
    "frozen_run": f"WITH {_LIMITED}{star._PAIRS[len(star.RECORDS):].replace('FROM records', 'FROM limited', 1)} SELECT *, true AS intact, (SELECT count(*) FROM limited) AS n_frozen FROM pairs",
    "derived_lineage": """WITH e AS (SELECT DISTINCT l_returnflag AS r, 'order-' || l_orderkey AS o, 'part-' || l_partkey AS p FROM lineitem)
        SELECT o AS asked, 'derived' AS direction, count(*) AS n, count(DISTINCT p) AS n_others, min(p) AS first_other, 0 AS n_again FROM e WHERE o IN (SELECT 'order-' || o_orderkey FROM orders) GROUP BY 1
        UNION ALL SELECT p, 'source', count(*), count(DISTINCT o), min(o), 0 FROM e WHERE p IN (SELECT 'part-' || p_partkey FROM part) GROUP BY 1""",
}
