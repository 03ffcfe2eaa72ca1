"""Comparing and converting governed measurements, and which records may be shown in public."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators.evidence import null, struct


def comparability(left_indicator: Column, left: Column, right_indicator: Column, right: Column) -> tuple[Column, Column, Column]:
    """Status, ordered reasons, and whether values can be converted, of two indicators with their governance.

    Another indicator, direction, dimension or conversion basis cannot be compared at all. Units of one basis are
    convertible; what else differs limits the comparison: frequency, aggregation, methodologies that neither declares
    equivalent, versions that are not declared comparable by both, required dimensions that not both have.
    """
    differs = lambda a, b: ~a.eqNullSafe(b)
    unit_a, unit_b = left["unit"], right["unit"]
    way_a, way_b = left["methodology"]["id"], right["methodology"]["id"]
    fit_a, fit_b = left["compatibility"], right["compatibility"]
    none = F.array().cast("array<string>")
    hard = (
        F.when(differs(left_indicator["id"], right_indicator["id"]), "indicator IDs differ")
        .when(differs(left_indicator["direction"], right_indicator["direction"]), "indicator directions differ")
        .when(differs(unit_a["dimension"], unit_b["dimension"]) | differs(unit_a["canonical_unit_id"], unit_b["canonical_unit_id"]), "unit dimensions or canonical bases differ")
    )
    equal = F.array_union(F.coalesce(fit_a["methodology_equivalence"], none), F.coalesce(fit_b["methodology_equivalence"], none))
    declared = F.array_contains(equal, way_a) & F.array_contains(equal, way_b)
    mutual = F.coalesce(F.array_contains(fit_a["comparable_versions"], right_indicator["version"]) & F.array_contains(fit_b["comparable_versions"], left_indicator["version"]), F.lit(False))
    required = F.array_union(F.coalesce(fit_a["required_dimensions"], none), F.coalesce(fit_b["required_dimensions"], none))
    shared = F.array_intersect(F.coalesce(left["disaggregation_dimensions"], none), F.coalesce(right["disaggregation_dimensions"], none))
    missing = F.array_sort(F.array_except(required, shared))
    limits = F.array_compact(
        F.array(
            F.when(differs(left["frequency"], right["frequency"]), "measurement frequencies differ"),
            F.when(differs(left["aggregation"], right["aggregation"]), "aggregation methods differ"),
            F.when(differs(way_a, way_b) & ~F.coalesce(declared, F.lit(False)), "methodologies are not declared equivalent"),
            F.when(~mutual, "indicator versions are not mutually declared comparable"),
            F.when(F.size(missing) > 0, F.concat(F.lit("required dimensions are not shared: "), F.array_join(missing, ", "))),
        )
    )
    other_unit = differs(unit_a["id"], unit_b["id"])
    status = F.when(hard.isNotNull(), "incompatible").when(F.size(limits) > 0, "limited").when(other_unit, "convertible").otherwise("equivalent")
    soft = F.concat(F.when(other_unit, F.array(F.lit("units differ but share a conversion basis"))).otherwise(none), limits)
    reasons = F.when(hard.isNotNull(), F.array(hard)).when(F.size(soft) == 0, F.array(F.lit("governance definitions are equivalent"))).otherwise(soft)
    return status, reasons, status.isin("equivalent", "convertible")


def converted(value: Column, unit: Column, to: Column) -> Column:
    """value (in the other unit, twelve places) and error of a conversion through the canonical unit."""
    error = (
        F.when(~unit["dimension"].eqNullSafe(to["dimension"]), "units have incompatible dimensions")
        .when(~unit["canonical_unit_id"].eqNullSafe(to["canonical_unit_id"]), "units do not share a canonical conversion basis")
        .when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), "value must be finite")
    )
    canonical = value * unit["conversion_factor"] + unit["conversion_offset"]
    return struct(value=F.when(error.isNull(), F.round((canonical - to["conversion_offset"]) / to["conversion_factor"], 12)), error=error)


def public_records(records: DataFrame, governance: DataFrame) -> DataFrame:
    """Approved records with an external gate whose governance is public in visibility and classification, made safe.

    ``records`` are canonical, ``governance`` has record_id, visibility and classification. Access notes and reviewers are
    blanked; datasets that are not public go, and with them their batches and what was observed in those.
    """
    open_ = governance.where("visibility = 'public' AND classification = 'public'").select("record_id").distinct()
    w = F.col("review_workflow")
    shown = records.where((w["state"] == "approved") & (w["publication_gate"]["status"] == "external")).join(open_, "record_id", "left_semi")
    lineage = F.col("observation_lineage")
    datasets = F.filter(lineage["datasets"], lambda d: d["access"] == "public")
    shown = shown.withColumn("_datasets", F.transform(datasets, lambda d: d["id"]))
    batches = F.filter(lineage["batches"], lambda b: F.array_contains("_datasets", b["dataset_id"]))
    shown = shown.withColumn("_batches", F.transform(batches, lambda b: b["id"]))
    seen = F.filter(lineage["observations"], lambda o: F.array_contains("_batches", o["batch_id"]))
    links = F.transform(F.col("evidence_chain.sources"), lambda x: x.withField("source", x["source"].withField("access_notes", null("string"))))
    decisions = F.transform(w["decisions"], lambda d: d.withField("actor", F.lit("reviewer")))
    return shown.withColumns(
        {
            "source": F.col("source").withField("access_notes", null("string")), "evidence_chain": F.col("evidence_chain").withField("sources", links),
            "observation_lineage": lineage.withField("datasets", datasets).withField("batches", batches).withField("observations", seen),
            "review_workflow": w.withField("assigned_reviewers", F.array().cast("array<string>")).withField("decisions", decisions),
        }
    ).drop("_datasets", "_batches")
