"""Canonical records, their validation and their import, by known answers."""

import copy
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from attesta.operators import imports, records, validation
from attesta.sources import versions

NOW = "2026-07-16T12:00:00Z"
AUTHORED = {
    "created_at": "2026-07-16T12:00:00Z",
    "entity": {"name": "Canopy Program", "type": "project", "external_ids": {"org.example.project": "canopy"}},
    "indicator": {"name": "Completeness score", "unit": "score", "direction": "higher", "framework": "Readiness"},
    "period": {"label": "2026-Q2", "start_date": "2026-04-01", "end_date": "2026-06-30"},
    "values": {"baseline": 62, "current": 78},
    "source": {"name": "Tracker", "type": "internal record", "publisher": "City", "license": "open", "retrieved_at": "2026-07-16T11:30:00Z", "citation": "Tracker 2026.", "checksum": "sha256:" + "7c" * 32},
    "confidence": {"score": 72, "basis": "field review"},
    "method": {"notes": "Counts sites.", "limitations": ["few sites"], "uncertainty": "some", "quality_flags": ["unverified"]},
    "evidence_chain": {"sources": [{"source": {"name": "Inventory", "license": "open", "citation": "Inventory.", "retrieved_at": "2026-01-01T01:00:00+01:00", "checksum": "sha256:" + "22" * 32}, "role": "supporting"}]},
}


def changed(**parts):
    row = copy.deepcopy(AUTHORED)
    for path, value in parts.items():
        *outer, last = path.split("__")
        place = row
        for name in outer:
            place = place[name]
        place[last] = value
    return row


def built(spark, rows):
    df = spark.createDataFrame([(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows)], "row_number long, js string")
    return records.canonical(records.from_json(df, "js", ["row_number"]), NOW, keep=["row_number"])


_LINEAGE = {"observations": [{"id": "observation:a:1", "batch_id": "batch:unknown:1", "role": "current", "value": 79, "quality_status": "valid", "dimensions": {"a": "b"}}]}
#: All variants are built and validated in one pass.
VARIANTS = {
    "sample": AUTHORED,
    "no baseline": changed(values__baseline=None),
    "zero baseline": changed(values__baseline=0, source__name="", confidence__score=95),
    "flags": changed(method__quality_flags=["stale", "conflicting", "unverified"]),
    "bare": changed(evidence_chain=None, source={"name": "Tracker", "access_notes": "Restricted"}, method__notes=" ", confidence__score=39),
    "bad unit": changed(indicator_governance={"unit": {"symbol": "score", "conversion_factor": 0, "conversion_offset": "x"}}),
    "odd unit": changed(indicator__unit="°C / m²"),
    "no object": "[1]",
    "score": changed(confidence__score=101),
    "direction": changed(indicator__direction="sideways"),
    "link": changed(evidence_chain={"sources": [{"source": {"name": "x", "url": "not a uri"}, "role": "mystery"}]}),
    "current": changed(values__current="many"),
    "updated": changed(updated_at="2020-01-01"),
    "period": changed(period__end_date="2026-01-01"),
    "lineage": changed(observation_lineage=_LINEAGE),
    "checksum": changed(source__checksum="md5:1"),
    "extension": changed(extensions={"Bad": "x"}),
    "approved": changed(review_workflow={"state": "approved"}),
    "method": changed(indicator_governance={"methodology": {"status": "approved"}}),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = built(spark, list(VARIANTS.values())).withColumn("kept", F.col("issues"))
    checked = validation.validated(rows).collect()
    return {name: next(r for r in checked if r.row_number == i) for i, name in enumerate(VARIANTS)}


@pytest.fixture(scope="module")
def sample(found):
    return found["sample"]


def test_derived_values(sample):
    assert (sample.measurement.percent_change, sample.review.status, sample.review.signal_status) == (25.81, "reviewable", "improving")
    assert sample.method.quality_flags == ["unverified"] and sample.indicator.version == "1.0" and sample.updated_at == NOW


def test_ids(sample):
    def twelve(*parts):
        return hashlib.sha256(json.dumps([p.lower() for p in parts], separators=(",", ":")).encode()).hexdigest()[:12]

    assert sample.entity.id == f"entity:project:{twelve('project', 'Canopy Program')}"
    assert sample.indicator.id == f"indicator:completeness-score:{twelve('Completeness score', 'score', 'higher')}"
    ids = (sample.entity.id, sample.indicator.id, sample.period.id, sample.source.id)
    assert sample.record_id == f"measurement:{sample.entity.id.replace(':', '-')}:{twelve(*ids)}"
    batch = sample.observation_lineage.batches[0]
    assert batch.id.rsplit(":", 1)[1] == hashlib.sha256(f"{sample.record_id}|{NOW}".lower().encode()).hexdigest()[:16]


def test_evidence_chain(sample):
    chain = sample.evidence_chain
    assert [x.role for x in chain.sources] == ["primary", "supporting"]
    assert chain.sources[0].supports == ["measurement.baseline", "measurement.current"] and chain.sources[1].supports == ["measurement.current"]
    assert chain.sources[1].source.retrieved_at == "2026-01-01T00:00:00Z"
    assert (chain.completeness_score, chain.gaps) == (100, [])


def test_lineage(sample):
    lineage = sample.observation_lineage
    assert lineage.completeness_score == 100
    assert [len(getattr(lineage, p)) for p in ("questions", "instruments", "datasets", "batches", "observations")] == [1, 1, 1, 1, 2]
    assert [(o.role, o.value, o.observed_at) for o in lineage.observations] == [("baseline", 62.0, "2026-04-01T00:00:00Z"), ("current", 78.0, "2026-06-30T00:00:00Z")]
    assert lineage.transformations[0].input_observation_ids == [o.id for o in lineage.observations]
    assert lineage.batches[0].dataset_id == lineage.datasets[0].id and lineage.instruments[0].type == "administrative"


def test_governance_and_review(sample):
    g, w = sample.indicator_governance, sample.review_workflow
    assert (g.unit.dimension, g.unit.conversion_factor, g.namespace, g.domain, g.framework_mappings[0].relationship) == ("score", 1.0, "sc", "Readiness", "exactMatch")
    q = w.quality
    assert (q.completeness, q.validity, q.consistency, q.timeliness, q.provenance, q.uncertainty, q.overall) == (100, 88, 92, 85, 100, 90, 92)
    assert (w.state, w.publication_gate.status, w.publication_gate.reasons, w.revision.number) == ("draft", "blocked", ["record has not been approved"], 1)


def test_only_a_current_observation_without_a_baseline(found):
    r = found["no baseline"]
    assert [o.role for o in r.observation_lineage.observations] == ["current"] and r.observation_lineage.batches[0].record_count == 1
    assert r.observation_lineage.transformations[0].operation == "identity"


def test_zero_baseline_and_missing_source(found):
    r = found["zero baseline"]
    assert (r.measurement.percent_change, r.source.name, r.review.status, r.review.signal_status) == (None, "Unspecified source", "missing source", "indeterminate")


def test_flags_lower_quality(found):
    q = found["flags"].review_workflow.quality
    assert (q.timeliness, q.consistency, q.validity) == (45, 57, 64)


def test_gaps_of_bare_evidence(found):
    r = found["bare"]
    assert [(g.code, g.severity) for g in r.evidence_chain.gaps] == [
        ("missing-citation", "warning"), ("missing-license", "warning"), ("missing-retrieval-date", "warning"), ("missing-checksum", "info"), ("missing-method", "warning"), ("low-confidence", "warning"), ("restricted-source", "warning"),
    ]
    assert r.evidence_chain.completeness_score == 25


def test_units(found):
    assert [tuple(i) for i in found["bad unit"].kept] == [("indicator_governance.unit.conversion_factor", "must be greater than zero"), ("indicator_governance.unit.conversion_offset", "must be a finite number")]
    assert found["odd unit"].indicator_governance.unit.dimension == "c_m"


PATHS = {
    "sample": [], "score": ["confidence.score"], "link": ["evidence_chain.sources.1.role", "evidence_chain.sources.1.source.url"], "updated": ["updated_at"], "period": ["period.end_date"],
    "lineage": ["observation_lineage.observations", "observation_lineage.observations.0.batch_id"], "checksum": ["source.checksum"], "extension": ["extensions"], "method": ["indicator_governance.methodology"],
}


@pytest.mark.parametrize("name", PATHS)
def test_errors_have_paths(found, name):
    assert [e.path for e in found[name].errors] == PATHS[name]


def test_first_errors(found):
    first = {name: (found[name].errors[0].path, found[name].errors[0].message.split(":")[0]) for name in ("no object", "direction", "current")}
    assert first == {"no object": ("record", "must be an object"), "direction": ("indicator.direction", "must be one of"), "current": ("measurement.current", "must be a finite number")}
    assert ("review_workflow.state", "approved needs an approval decision") in [tuple(e) for e in found["approved"].errors]


def test_rules_are_not_evaluated_inside_a_filter(spark, tmp_path):
    built(spark, [AUTHORED]).write.parquet(f"{tmp_path}/records")
    plan = validation.validated(spark.read.parquet(f"{tmp_path}/records"))._jdf.queryExecution().optimizedPlan().toString()
    assert "is no valid id" in plan and "filter(array(" not in plan and "filter(concat(" not in plan


def test_altered_derivations_are_found(spark):
    r = built(spark, [AUTHORED])
    r = r.withColumn("measurement", F.col("measurement").withField("percent_change", F.lit(999.0))).withColumn("evidence_chain", F.col("evidence_chain").withField("completeness_score", F.lit(4)))
    r = r.withColumn("source", F.col("source").withField("citation", F.lit("Changed.")))
    paths = [e.path for e in validation.validated(r).first().errors]
    assert paths == ["measurement.percent_change", "review.signal_status", "evidence_chain.completeness_score", "evidence_chain.sources"] or paths == ["measurement.percent_change", "evidence_chain.completeness_score", "evidence_chain.sources"]


def test_completing_fills_only_what_is_absent(spark):
    r = built(spark, [AUTHORED]).drop("issues")
    kept = r.withColumn("evidence_chain", F.col("evidence_chain").withField("completeness_score", F.lit(7))).withColumn("observation_lineage", F.lit(None).cast(r.schema["observation_lineage"].dataType))
    done = records.completed(kept).first()
    assert done.evidence_chain.completeness_score == 7
    assert done.observation_lineage == r.first().observation_lineage


FLAT = {"entity_name": "A", "indicator_name": "B", "unit": "t", "period_label": "2026", "current": "5", "baseline": "4", "source_name": "S", "confidence": "80", "assumptions": "x|y; x", "external_id_namespace": "ns", "external_id": "1"}


def flat(spark, rows):
    names = sorted({n for r in rows for n in r})
    return records.from_flat(spark.createDataFrame([(i, *(r.get(n) for n in names)) for i, r in enumerate(rows, 2)], "row_number long, " + ", ".join(f"{n} string" for n in names)), ["row_number"])


def test_flat_rows(spark):
    rows = [FLAT, FLAT | {"current": " "}, {"record_json": json.dumps(AUTHORED)}, {"record_json": "[]"}, FLAT | {"sources_json": '[{"name": "T", "role": "contextual"}]'}, FLAT | {"sources_json": "{}"}]
    found = records.canonical(flat(spark, rows), NOW, keep=["row_number"]).orderBy("row_number").collect()
    assert (found[0].measurement.percent_change, found[0].method.assumptions, found[0].entity.external_ids) == (25.0, ["x", "y"], {"ns": "1"})
    assert tuple(found[1].issues[0]) == ("record", "missing required columns: current")
    assert found[2].entity.name == "Canopy Program" and not found[2].issues
    assert tuple(found[3].issues[0]) == ("record_json", "must contain an object")
    assert [x.role for x in found[4].evidence_chain.sources] == ["primary", "contextual"]
    assert tuple(found[5].issues[0]) == ("sources_json", "must contain an array")


def test_import_is_all_or_nothing(spark, tmp_path):
    root = str(tmp_path)
    bad = flat(spark, [FLAT, FLAT | {"entity_name": "C"}, FLAT | {"current": "x"}])
    result = imports.run_import(bad, root, "r1", NOW)
    assert (result["status"], result["processed"], result["inserted"], result["failed"]) == ("failed", 3, 0, 1)
    assert imports.current(spark, root) is None and not versions.exists(spark, f"{root}/records") and not versions.children(spark, f"{root}/aside")
    lines = versions.read(spark, f"{root}/errors").collect()
    assert [(r.row_number, r.path) for r in lines] == [(4, "measurement.current")]
    result = imports.run_import(bad, root, "r2", NOW, atomic=False)
    assert (result["status"], result["inserted"], result["failed"]) == ("completed with errors", 2, 1)
    assert imports.current(spark, root).count() == 2


def test_import_is_idempotent(spark, tmp_path):
    root = str(tmp_path)
    rows = flat(spark, [FLAT, FLAT, FLAT | {"current": "6"}])
    dry = imports.run_import(rows, root, "r0", NOW, dry_run=True)
    assert (dry["status"], dry["inserted"], dry["skipped"], dry["updated"]) == ("dry run", 1, 1, 1) and not versions.exists(spark, f"{root}/records")
    first = imports.run_import(rows, root, "r1", NOW)
    assert imports.run_import(rows, root, "r1", NOW) == first
    again = imports.run_import(flat(spark, [FLAT | {"current": "6"}]), root, "r2", NOW)
    assert (again["inserted"], again["updated"], again["skipped"]) == (0, 0, 1)
    assert [r.measurement.current for r in imports.current(spark, root).collect()] == [6.0]
