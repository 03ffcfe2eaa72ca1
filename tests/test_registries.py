"""Name search against brute force, nested diffs, schema drift and registries by known answers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from attesta.functions import derive
from attesta.operators import comparability, entities, evidence, refresh, registries


def test_containing_equals_comparing_all(spark):
    r = random.Random(5)
    names = sorted({"".join(r.choice("abc 1") for _ in range(r.randrange(1, 9))).strip() for _ in range(150)} - {""})
    queries = sorted({"".join(r.choice("abc 1") for _ in range(r.randrange(1, 6))).strip() for _ in range(120)} - {""}) + ["zzzz", "q"]
    known = spark.createDataFrame([(f"e{i:03d}", n) for i, n in enumerate(names)], "entity_id string, normal_name string")
    asked = spark.createDataFrame([(q, q) for q in queries], "query string, q string")
    want = {}
    for q in queries:
        hits = [f"e{i:03d}" for i, n in enumerate(names) if q in n]
        if hits:
            want[q] = (len(hits), min(hits))
    found = entities.containing(asked, known)
    assert {r.query: (r.n, r.first_entity) for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize(
    "before, after, paths",
    [
        (None, {"a": 1}, ["$record"]),
        ({"a": {"b": {"c": 1, "d": 2}}}, {"a": {"b": {"c": 1, "d": 3}}}, ["a.b.d"]),
        ({"a": {"b": 1}}, {"a": 1}, ["a"]),
        ({"a": {"b": 1}}, {}, ["a"]),
        ({"a": [1, 2]}, {"a": [2, 1]}, ["a"]),
        ({"a": 1}, {"a": 1.0}, ["a"]),
        ({"a": None}, {}, ["a"]),
        ({"a": {}, "x": "1"}, {"a": {}, "x": 1}, ["x"]),
        ({"a": {"b": {}}}, {"a": {"b": {"c": {"d": 1}}}}, ["a.b.c"]),
        ({"a": 1}, {"a": 1}, []),
    ],
)
def test_nested_diff(spark, before, after, paths):
    row = spark.createDataFrame([(None if before is None else json.dumps(before), json.dumps(after))], "a string, b string")
    assert row.select(evidence.nested_diff(F.col("a"), F.col("b"))).first()[0] == paths


def test_schema_of_nested_objects(spark):
    rows = spark.createDataFrame([('{"a": {"b": [{"c": 1}, {"d": 2}], "e": null}, "f": true}',), ("[1]",), ("x",), (None,)], "j string")
    assert [r[0] for r in rows.select(derive.json_types("j")).collect()] == [["a.b:list", "a.b[].c:int", "a:object", "f:bool"], [], [], []]
    later = spark.createDataFrame([("g", '{"a": {"b": [{"c": 1.5}]}}'), ("g", '{"a": {"b": [{"c": "x"}]}}')], "g string, j string")
    drift = refresh.schema_drift(rows.withColumn("g", F.lit("g")), later, "g", "j").collect()
    assert {(r.path, r.was, r.now) for r in drift} == {("f", "bool", None), ("a.b[].c", "int", "float|str")}


def test_saved_queries_make_a_version_only_by_change(spark):
    saves = spark.createDataFrame([("q", "x", "ann", 1), ("q", "x", "bob", 2), ("q", "y", "bob", 3), ("q", "x", "ann", 4), ("r", "x", "ann", 1)], "name string, definition string, saved_by string, saved_at int")
    versions = registries.saved_versions(saves)
    assert sorted((r.name, r.version, r.definition, r.created_at) for r in versions.collect()) == [("q", 1, "x", 1), ("q", 2, "y", 3), ("q", 3, "x", 4), ("r", 1, "x", 1)]
    ids = {r.name: r.query_id for r in versions.collect()}
    runs = spark.createDataFrame([("r1", ids["q"]), ("r2", ids["q"]), ("r3", None)], "run_id string, query_id string")
    found = {r.name: (r.version_count, r.run_count, r.created_by, r.created_at, r.updated_at) for r in registries.saved_registry(versions, runs).collect()}
    assert found == {"q": (3, 2, "ann", 1, 4), "r": (1, 0, "ann", 1, 1)}
    exports = spark.createDataFrame([("r1",), ("r1",)], "run_id string")
    assert {r.run_id: (r.query_name, r.export_count) for r in registries.run_summary(runs, versions, exports).collect()} == {"r1": ("q", 2), "r2": ("q", 0), "r3": (None, 0)}


def test_replication_reviews_are_checked(spark):
    rows = spark.createDataFrame([("a", "confirmed", "x", None, None, 1), ("a", "great", "x", None, None, 2), ("z", "failed", "x", None, None, 3), ("a", "partial", "x", "{}", "z", 4), ("a", "partial", "x", "{}", "b", 5)], "run_id string, status string, reviewer string, evidence string, reproduced_run_id string, reviewed_at int")
    good, bad = registries.replication_reviews(rows, spark.createDataFrame([("a",), ("b",), ("b",)], "run_id string"))
    assert sorted(r.reviewed_at for r in good.collect()) == [1, 5] and good.select("replication_id").distinct().count() == 2
    assert {r.reviewed_at: r.reason for r in bad.collect()} == {2: "invalid replication status", 3: "run not found", 4: "reproduced run not found"}


def test_seed_rows_need_all_names(spark):
    seeds = spark.createDataFrame([(1, "e", "p"), (2, "e", "x"), (3, None, "p")], "value int, entity_name string, period_name string")
    dims = {"entity": spark.createDataFrame([(7, "e"), (8, "f")], "entity_id int, entity_name string"), "period": spark.createDataFrame([(9, "p")], "period_id int, period_name string")}
    assert [tuple(r) for r in registries.seeded(seeds, dims).collect()] == [(1, 7, 9)]


def test_history_counts_children_by_version(spark):
    versions = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, v int")
    children = spark.createDataFrame([("a", 1), ("a", 1), ("c", 1)], "k string, v int")
    found = {(r.k, r.v): (r.versions_behind, r.snapshot_count) for r in registries.history(versions, "k", "v", children).collect()}
    assert found == {("a", 1): (1, 2), ("a", 2): (0, 0), ("b", 1): (0, 0)}


def test_health_of_runs(spark):
    columns = "atomic boolean, inserted int, updated int, skipped int, quarantined int, expected int, missing int, license string, license_status string, age_seconds int, sla_seconds int, fingerprint string, last_fingerprint string"
    rows = [
        (False, 1, 0, 0, 0, 4, 1, "open", None, 5, 5, "f", "f"), (True, 1, 0, 0, 1, 4, 0, "open", None, None, 5, "f", None), (False, 0, 0, 0, 2, 0, 0, "", None, 6, 5, None, "f"), (False, 0, 0, 3, 1, 4, 2, "open", "restricted", 6, None, "f", "g"),
    ]
    found = refresh.run_states(spark.createDataFrame(rows, columns)).collect()
    assert [(r.status, r.license_state, r.freshness, r.drift, r.health) for r in found] == [
        ("succeeded", "compliant", "current", "stable", "healthy"), ("failed", "compliant", "unknown", "stable", "unhealthy"),
        ("quarantined", "missing", "stale", "unknown", "unhealthy"), ("partial", "restricted", "current", "changed", "degraded"),
    ]


def test_conversions_go_through_the_canonical_unit(spark):
    unit = "struct<dimension:string,canonical_unit_id:string,conversion_factor:double,conversion_offset:double>"
    f, k, kg, other = ("temperature", "k", 5 / 9, 255.3722222222), ("temperature", "k", 1.0, 0.0), ("mass", "kg", 1.0, 0.0), ("temperature", "r", 1.0, 0.0)
    rows = spark.createDataFrame([(212.0, f, k), (1.0, f, kg), (1.0, other, k), (None, k, k)], f"v double, a {unit}, b {unit}")
    found = [r[0] for r in rows.select(comparability.converted(F.col("v"), F.col("a"), F.col("b"))).collect()]
    assert abs(found[0].value - 373.15) < 1e-6
    assert [r.error for r in found] == [None, "units have incompatible dimensions", "units do not share a canonical conversion basis", "value must be finite"]


def test_measures_of_one_table_read_it_once(spark):
    rows = spark.range(10)
    found = registries.rollup("r", {"all": (rows, None), "even": (rows, F.col("id") % 2 == 0), "other": (spark.range(3), None)})
    assert {tuple(r) for r in found.collect()} == {("r", "all", 10), ("r", "even", 5), ("r", "other", 3)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 10") == 1
