"""Operators on small tables: the semantics that queries over the given tables don't reach."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from attesta.functions import derive
from attesta.operators import access, catalog, entities, evidence, graph, history, refresh, review, studio
from attesta.sources import exports, payloads


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'long' if isinstance(v, int) else 'string'}" for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize(("baseline", "current", "change"), [(62.0, 78.0, 25.81), (-10.0, -5.0, 50.0), (0.0, 5.0, None), (100.0, 100.001, 0.0)])
def test_percent_change(spark, baseline, current, change):
    assert one(spark, derive.percent_change(F.col("b"), F.col("c")), b=baseline, c=current) == change


def test_two_contracts_of_unchanged(spark):
    df = spark.createDataFrame([(100.0, 100.001, "higher")], "b double, c double, d string")
    change = derive.percent_change(F.col("b"), F.col("c"))
    assert df.select(derive.classify_signal(change, F.col("d"))).first()[0] == "unchanged"
    assert df.select(derive.classify_signal_raw(F.col("b"), F.col("c"), F.col("d"))).first()[0] == "improving"


@pytest.mark.parametrize(("confidence", "source", "want"), [(72.0, "a", "reviewable"), (68.0, "a", "reviewable with caution"), (39.9, "a", "needs evidence"), (99.0, " Unspecified source ", "missing source")])
def test_review_classes(spark, confidence, source, want):
    assert one(spark, derive.classify_review(F.col("c"), derive.source_is_missing(F.col("s"))), c=confidence, s=source) == want


@pytest.mark.parametrize(("text", "family", "want"), [("1,234.5", "national", 1234.5), ("1,234.5", "statistics", None), (" n/a ", "earth", None), ("inf", "earth", None), ("-2e3", "earth", -2000.0), ("--", "statistics", None)])
def test_numeric_value(spark, text, family, want):
    assert one(spark, derive.numeric_value(F.col("t"), family), t=text) == want


def test_texts(spark):
    assert one(spark, derive.slug(F.col("t")), t="  Été & CO!! ") == "t-co"
    assert one(spark, derive.slug(F.col("t")), t="!!") == "unspecified"
    assert one(spark, derive.normal_name(F.col("t")), t="Côte d’Ivoire (Straße)") == "cote d ivoire strasse"
    assert one(spark, derive.utc_seconds(F.col("t")), t="2024-01-02T03:04:05.9+02:00") == "2024-01-02T01:04:05Z"
    assert one(spark, derive.json_text(F.col("t")), t='{"title":"x"}') == "x"
    assert one(spark, derive.json_text(F.col("t")), t='["a","b"]') == "a; b"
    assert one(spark, derive.redact(F.col("t")), t="u?api_key=1&b=2") == "u?api_key=REDACTED&b=2"
    assert one(spark, derive.text_list(F.col("t")), t="a; b|a\nc;") == ["a", "b", "c"]


def test_query_definitions_are_checked():
    for bad in ({"filters": {"nope": 1}}, {"sort": [{"field": "nope"}]}, {"limit": 0}, {"limit": True}, {"limit": 1_000_001}):
        with pytest.raises(ValueError):
            studio.normalised(bad)
    assert studio.normalised({"filters": {"tags": []}})["filters"] == {}


def records(spark, rows):
    base = {"entity_id": "e", "indicator_id": "i", "dimension": "mass", "direction": "higher", "frequency": "annual", "methodology": "m", "factor": 1.0, "unit": "kg"}
    full = [base | r for r in rows]
    names = ["record_id", "start_date", "period_label", "current", *base]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], ", ".join(f"{n} {'double' if n in ('current', 'factor') else 'string'}" for n in names))


def test_comparisons(spark):
    rows = [
        {"record_id": "a", "period_label": "2020", "current": 60.0}, {"record_id": "b", "start_date": "2021", "period_label": "2021", "current": 75.0}, {"record_id": "c", "start_date": "2022", "period_label": "2022", "current": 0.1, "unit": "t", "factor": 1000.0},
        {"record_id": "d", "start_date": "2023", "period_label": "2023", "current": 5.0, "frequency": "monthly"}, {"record_id": "e", "start_date": "2024", "period_label": "2024", "current": 5.0, "direction": "lower"},
    ]
    got = {r.from_record: r for r in studio.comparisons(records(spark, rows)).collect()}
    assert (got["a"].percent_change, got["a"].comparability) == (25.0, "equivalent")
    assert (got["b"].to_value, got["b"].comparability) == (100.0, "convertible")
    assert (got["c"].to_value, got["c"].comparability, got["c"].reasons) == (5.0, "limited", "unit,frequency")
    assert (got["d"].absolute_change, got["d"].comparability, got["d"].reasons) == (None, "incompatible", "direction")


def test_versions_and_revisions_number_differently(spark):
    rows = spark.createDataFrame([("k", i, c) for i, c in enumerate("ABBA")], "k string, at long, c string")
    assert sorted((r.version, r.c, r.is_latest) for r in history.versions(rows, "k", "at", "c").collect()) == [(1, "A", True), (2, "B", False)]
    assert sorted((r.revision, r.c) for r in history.revisions(rows, "k", "at", "c").collect()) == [(1, "A"), (2, "B"), (3, "A")]


def test_importing_twice_skips_everything(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k long, c string")
    assert {r.action for r in history.upsert_actions(rows, rows, "k", "c").collect()} == {"skipped"}


def test_refresh_partitions_the_keys(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, c string")
    new = spark.createDataFrame([(2, "b"), (3, "x"), (4, "d")], "k long, c string")
    got = {r.k: (r.status, r.quarantined, r.active) for r in refresh.refresh(old, new, "k", "c", F.col("c") == "x").collect()}
    assert got == {1: ("missing", False, False), 2: ("matched", False, True), 3: ("changed", True, True), 4: ("unexpected", False, True)}


def test_illegal_decisions_change_nothing(spark):
    moves = {"draft": {"submit": "review"}, "review": {"approve": "approved"}}
    rows = spark.createDataFrame([("a", i, x) for i, x in enumerate(["approve", "submit", "noted", "submit", "approve"])], "k string, i long, x string")
    assert review.fold_decisions(rows, "k", "i", "x", moves, "draft").first()[1:] == ("approved", 2, 2, 5)


def test_payload_diff(spark):
    diff = lambda a, b: spark.range(1).select(evidence.payload_diff(a, b)).first()[0]
    m = lambda **k: F.create_map(*(F.lit(x) for kv in k.items() for x in kv))
    assert diff(m(a="1", b="2"), m(b="3", c="4")) == ["a", "b", "c"]
    assert diff(F.lit(None).cast("map<string,string>"), m(a="1")) == ["$record"]


def test_digest_does_not_depend_on_order(spark):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    assert catalog.order_free_digest(rows, "k").first() == catalog.order_free_digest(rows.orderBy(F.desc("k")).repartition(7), "k").first()
    assert catalog.order_free_digest(rows, "k").first() != catalog.order_free_digest(rows.where("k <> '7'"), "k").first()


def test_resolution_outcomes(spark):
    names = spark.createDataFrame([(1, "Nation_1"), (2, "NATION_10")], "id long, name string")
    known = entities.register(names, "country", "name", "id")
    asked = spark.createDataFrame([("nation 1",), ("ation",), ("--",), ("zzz",)], "query string")
    got = {r.query: (r.outcome, r.n_candidates) for r in entities.resolve(asked, known, entities.attach_aliases(known.select("entity_id", F.lit("").alias("alias")))).collect()}
    assert got == {"nation 1": ("resolved", 1), "ation": ("ambiguous", 2), "--": ("not-found", 0), "zzz": ("not-found", 0)}


def test_paths_break_ties_by_predicate_then_edge(spark):
    rows = spark.createDataFrame([("a", "z", "b", "1"), ("a", "y", "c", "2"), ("b", "a", "d", "3"), ("c", "a", "d", "4"), ("d", "p", "e", "5")], "source string, predicate string, target string, edge_id string")
    got = {r.node_id: (r.depth, [h.edge_id for h in r.path]) for r in graph.shortest_paths(rows, spark.createDataFrame([("a",)], "node_id string"), 3).collect()}
    assert got == {"a": (0, []), "b": (1, ["1"]), "c": (1, ["2"]), "d": (2, ["2", "4"]), "e": (3, ["2", "4", "5"])}


def test_role_needs_an_active_membership(spark):
    members = spark.createDataFrame([("p", "w", "admin", True, None), ("q", "w", "admin", False, None), ("r", "w", "admin", True, dt.datetime(2020, 1, 1))], "principal string, workspace string, role string, active boolean, expires_at timestamp")
    asked = spark.createDataFrame([(x, "w", "read") for x in "pqrs"], "principal string, workspace string, permission string")
    got = access.authorised(members, spark.createDataFrame([("admin", "*")], "role string, permission string"), asked, F.lit("2021-01-01").cast("timestamp"))
    assert {r.principal: r.allowed for r in got.collect()} == {"p": True, "q": False, "r": False, "s": False}


def test_files_of_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿entity_name,indicator_name,period_label,current,source_name,confidence,assumptions\nE,I,2024,5,S,70,x|y\n", "utf-8")
    nested = payloads.csv_to_record(payloads.read_records_csv(spark, str(tmp_path / "a.csv")))
    row = nested.first()
    assert (row.entity.name, row["values"].current, row.method.assumptions) == ("E", 5.0, ["x", "y"])
    assert "method_assumptions_count" in exports.flatten_records(nested).columns
    (tmp_path / "b.json").write_text('{"records": [{"a": 1}, {"a": 2}]}')
    assert sorted(r.a for r in payloads.read_records_json(spark, str(tmp_path / "b.json")).collect()) == [1, 2]
    with pytest.raises(ValueError):
        payloads.csv_to_record(spark.range(1))


def test_bundle_manifest_is_the_same_for_equal_rows(spark, tmp_path):
    rows = spark.range(50).withColumn("x", F.lit("a"))
    one_, two = (exports.export_bundle({"records": df}, str(tmp_path / n)).collect() for n, df in (("p", rows), ("q", rows.orderBy(F.desc("id")))))
    assert one_ == two


@pytest.mark.parametrize(
    ("quality", "state", "critical", "want"),
    [
        (70, "approved", False, ("external", "")),
        (69, "approved", False, ("internal", "overall quality score is below 70")),
        (90, "approved", True, ("internal", "critical evidence gaps remain open")),
        (90, "in-review", False, ("internal", "record has not been approved")),
        (49, "submitted", False, ("blocked", "record has not been approved; overall quality score is below 70")),
        (90, "draft", False, ("blocked", "record has not been approved")),
        (90, None, False, ("blocked", "record has not been approved")),
    ],
)
def test_publication_gate(spark, quality, state, critical, want):
    row = spark.createDataFrame([(quality, state, critical)], "q int, s string, c boolean")
    assert tuple(row.select(*evidence.publication_gate(F.col("q"), F.col("s"), F.col("c"))).first()) == want


def test_null_measures_have_no_class(spark):
    row = spark.createDataFrame([(None, None, 1.0)], "c double, d string, x double")
    assert row.select(derive.classify_review(F.col("c"), F.lit(False))).first()[0] is None
    assert row.select(derive.classify_signal(F.col("x"), F.col("d"))).first()[0] is None
    assert row.select(derive.classify_signal_raw(F.col("x"), F.col("x") + 1, F.col("d"))).first()[0] is None


def test_only_atomic_runs_fail(spark):
    rows = spark.createDataFrame([("a", "matched", True, True), ("b", "unexpected", False, True)], "k string, status string, quarantined boolean, active boolean")
    none = spark.createDataFrame([(0,)], "duplicates long")
    assert refresh.reconciliation(rows, none).first().status == "warning"
    assert refresh.reconciliation(rows, none, atomic=True).first().status == "failed"
    found = refresh.alerts(refresh.reconciliation(rows, none, atomic=True)).collect()
    assert [tuple(r) for r in found] == [("reconciliation", "critical"), ("quarantine", "warning"), ("record-drift", "warning")]


def test_page_audit_hashes_all_page_hashes_in_order(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [(r, i, f"{r} é {i * 7919 % 101}") for r in ("a", "b", None) for i in range(40)] + [("c", 1, ""), ("a", 7, "x"), ("a", None, "last")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        pages = spark.createDataFrame(rows, "run string, page long, html string").repartition(5)
        got = {r.run: tuple(r)[1:] for r in payloads.page_audit(pages, "run", "page", "html").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for run in ("a", "b", "c", None):
        own = sorted((p is None, p or 0, sha(h), h) for r, p, h in rows if r == run)
        assert got.pop(run) == (len(own), sum(len(o[3].encode()) for o in own), sha("".join(o[2] for o in own)), len(own[-1][3]))
    assert not got
