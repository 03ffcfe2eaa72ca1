"""Replays, snapshots, re-derivation, frozen runs and lineage edges."""

import pytest
from pyspark.sql import functions as F

from attesta.operators import ledger
from attesta.sources import versions


@pytest.fixture
def rows(spark):
    return spark.range(40).select(F.concat(F.lit("r"), F.col("id")).alias("record_id"), F.col("id").alias("value"))


def test_digest_ignores_order_and_partitions_but_no_value(rows):
    want = ledger.digest(rows)
    assert ledger.digest(rows.orderBy(F.desc("value")).repartition(5).select("value", "record_id")) == want
    assert ledger.digest(rows.unionByName(rows.limit(1))) != want
    assert ledger.digest(rows.withColumn("value", F.when(F.col("value") == 7, None).otherwise(F.col("value")))) != want
    assert ledger.digest(rows.limit(0)) == ledger.digest(rows.where("false"))


def test_replay_commits_once_and_has_a_parent(spark, rows, tmp_path):
    root, calls = str(tmp_path), []

    def process(payload):
        calls.append(1)
        return payload.withColumn("twice", F.col("value") * 2)

    first = ledger.run(rows, root, "c", process)
    assert ledger.run(rows.orderBy(F.desc("value")), root, "c", process) == first and len(calls) == 1
    again = ledger.replay(spark, root, first, process)
    assert ledger.replay(spark, root, first, process) == again and len(calls) == 2
    runs = {r.run: r for r in versions.read(spark, f"{root}/runs").collect()}
    assert (runs[first].parent, runs[again].parent, runs[again].rows) == (None, first, 40)
    assert len(versions.committed(spark, f"{root}/payloads")) == 1
    with pytest.raises(ValueError):
        ledger.replay(spark, root, "unknown", process)


def test_a_run_that_was_cut_off_is_done_again(spark, rows, tmp_path):
    root = str(tmp_path)
    name = ledger.land(rows, root)
    run = ledger.identity("run", "c", name, None)
    rows.limit(3).write.parquet(f"{root}/results/{run}")
    versions.remove(spark, f"{root}/results/{run}/_SUCCESS")
    assert ledger.run(rows, root, "c", lambda p: p) == run
    assert versions.read(spark, f"{root}/results").count() == 40


def test_snapshots_are_appended_once(spark, tmp_path):
    root = str(tmp_path)
    snaps = spark.createDataFrame([("a", "t1", "x", None), ("a", "t1", "x", None), ("b", "t1", None, "u"), ("none", "t1", None, None)], "source_id string, retrieved_at string, content_sha256 string, storage_uri string")
    known = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "source_id string, version int")
    links = spark.createDataFrame([("a", "r1"), ("a", "r2"), ("a", "r2"), ("none", "r3")], "source_id string, record_id string")
    assert ledger.append_snapshots(snaps, known, links, root) == (2, 2)
    assert ledger.append_snapshots(snaps, known, links, root) == (0, 0)
    later = snaps.limit(1).withColumn("retrieved_at", F.lit("t2"))
    assert ledger.append_snapshots(snaps.unionByName(later), known, links, root) == (1, 2)
    assert versions.read(spark, f"{root}/snapshots").where("source_id = 'a'").agg(F.max("version")).first()[0] == 2


def test_rederiving_leaves_other_folders_alone(spark, rows, tmp_path):
    path, aside = f"{tmp_path}/records", f"{tmp_path}/aside"
    ledger.store_records(rows.withColumn("derived", F.when(F.col("value") != 11, F.lit("old"))), path, buckets=8)
    before = versions.modified(spark, path)
    again = lambda r: r.withColumn("derived", F.lit("new"))
    assert ledger.rederive(spark, path, F.col("derived").isNull(), again, aside) == 1
    after = versions.modified(spark, path)
    folder = lambda files: {name.split("/")[0] for name in files}
    changed = {name for name in set(before) | set(after) if before.get(name) != after.get(name)}
    assert len(folder(changed)) == 1 and folder(before) == folder(after)
    found = spark.read.parquet(path)
    assert found.count() == 40 and [r.value for r in found.where("derived = 'new'").collect()] == [11]
    assert ledger.rederive(spark, path, F.col("derived").isNull(), again, aside) == 0 and versions.modified(spark, path) == after


def test_a_changed_frozen_file_is_found(spark, rows, tmp_path):
    root = str(tmp_path)
    run = ledger.freeze(rows, '{"limit": 40}', root)
    assert ledger.freeze(rows.repartition(3), '{"limit": 40}', root) == run
    assert ledger.frozen(spark, root, run)[1]["intact"]
    rows.withColumn("value", F.col("value") + F.when(F.col("value") == 3, 1).otherwise(0)).write.mode("overwrite").parquet(f"{root}/rows/{run}")
    assert not ledger.frozen(spark, root, run)[1]["intact"]


def test_edges_of_a_failed_append_are_made_up_for_and_counted_in_their_buckets(spark, tmp_path):
    edges = spark.createDataFrame([("r", "d1", "s1", "{}"), ("r", "d1", "s2", "{}"), ("q", "d1", "s1", "{}"), ("r", "d2", "s1", "{}")], "run_id string, derived_id string, source_id string, transformation string")
    name, path = "edges_failed_test", f"{tmp_path}/e"
    assert ledger.append_edges(edges.where("source_id = 's1'"), name, path) == 3
    spark.sql(f"DROP TABLE {name}_by_source")
    spark.createDataFrame([], spark.table(f"{name}_by_derived").schema).write.bucketBy(ledger.EDGE_BUCKETS, "source_id").sortBy("source_id").mode("overwrite").option("path", f"{path}/source").saveAsTable(f"{name}_by_source")
    assert ledger.append_edges(edges, name, path) == 4
    assert ledger.append_edges(edges, name, path) == 0
    assert {tuple(r) for r in spark.table(f"{name}_by_source").select("lineage_id", "derived_id").collect()} == {tuple(r) for r in spark.table(f"{name}_by_derived").select("lineage_id", "derived_id").collect()}
    assert {len(r.lineage_id) for r in spark.table(f"{name}_by_derived").collect()} == {48}
    asked = spark.createDataFrame([("s1",), ("d1",), ("d3",)], "record_id string")
    counted = ledger.edge_counts(spark, name, asked)
    assert {tuple(r) for r in counted.select("asked", "direction", "n", "n_others", "first_other").collect()} == {("s1", "source", 3, 2, "d1"), ("d1", "derived", 3, 2, "s1")}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ledger.edge_counts(spark, name, asked)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange") == 2  # the asked records, once for each side


def test_edges_are_kept_once_and_read_without_shuffling_them(spark, tmp_path):
    edges = spark.createDataFrame([("r", "d1", "s1", "{}"), ("r", "d1", "s2", "{}"), ("r", "d2", "s1", "{}"), ("r", "d1", "s1", "{}")], "run_id string, derived_id string, source_id string, transformation string")
    name = "edges_test"
    assert ledger.append_edges(edges, name, f"{tmp_path}/e") == 3
    assert ledger.append_edges(edges, name, f"{tmp_path}/e") == 0
    asked = spark.createDataFrame([("s1",), ("d1",), ("d1",)], "record_id string").distinct()
    found = {(r.asked, r.direction, r.other) for r in ledger.edges_of(spark, name, asked).collect()}
    assert found == {("s1", "source", "d1"), ("s1", "source", "d2"), ("d1", "derived", "s1"), ("d1", "derived", "s2")}
    asked.write.bucketBy(ledger.EDGE_BUCKETS, "record_id").sortBy("record_id").option("path", f"{tmp_path}/asked").saveAsTable("asked_test")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ledger.edges_of(spark, name, spark.table("asked_test"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
