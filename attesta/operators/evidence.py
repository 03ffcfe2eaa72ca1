"""Evidence chains, quality scores and publication gates, as expressions over nested columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import derive
from attesta.operators import contracts

def clean(text: Column) -> Column:
    """Without white space around it; null if nothing is left."""
    return F.nullif(F.btrim(text, F.lit(" \t\n\r\f\u000b")), F.lit(""))


def struct(**fields: Column) -> Column:
    return F.struct(*(column.alias(name) for name, column in fields.items()))


def empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def present(*items: tuple[Column, Column]) -> Column:
    """The items of (test, item) whose test holds, in order, as an array.

    Compiled as a whole, unlike a filter of an array, whose items are all evaluated without compiled code.
    """
    return F.flatten(F.array(*(F.when(test, F.array(item)).otherwise(F.array()) for test, item in items)))


def digest_id(kind: str, *parts: Column) -> Column:
    """kind:20 digits, by the JSON list of the trimmed, lower-cased parts; null parts count as empty."""
    plain = [F.lower(F.coalesce(clean(p.cast("string")), F.lit(""))) for p in parts]
    return F.concat_ws(":", F.lit(kind), F.substring(F.sha2(F.to_json(F.array(*plain)), 256), 1, 20))


def normal_source(source: Column) -> Column:
    """A source with trimmed texts, its name, type and id filled in and its retrieval time in UTC."""
    name = F.coalesce(clean(source["name"]), F.lit(derive.MISSING_SOURCE))
    texts = {f: clean(source[f]) for f in ("url", "publisher", "license", "citation", "checksum", "access_notes")}
    key = digest_id("source", name, texts["publisher"], texts["url"])
    fields = {
        "id": F.coalesce(clean(source["id"]), key), "name": name, "type": F.coalesce(clean(source["type"]), F.lit("unspecified")), "url": texts["url"], "publisher": texts["publisher"], "license": texts["license"],
        "retrieved_at": derive.utc_seconds(clean(source["retrieved_at"])), "citation": texts["citation"], "checksum": texts["checksum"], "access_notes": texts["access_notes"],
    }
    return struct(**fields)


def normal_links(raw: Column, primary: Column) -> Column:
    """Links with the primary source, one for each (source id, role), the first of equals.

    ``raw`` is an array of RAW_LINK, ``primary`` a normal source. The first link to the primary source becomes the
    primary link; without one, a primary link comes first.
    """
    claimed = lambda x: F.array_distinct(F.filter(F.transform(F.coalesce(x["supports"], F.array(F.lit("measurement.current"))), clean), lambda s: s.isNotNull()))
    flat = lambda x: struct(**{f: x[f] for f in SOURCE_FIELDS})
    locator = lambda x: struct(**{f: clean(x["locator"][f]) for f in ("page", "section", "quote", "fragment")})
    link = lambda x: struct(role=F.coalesce(clean(x["role"]), F.lit("supporting")), source=normal_source(F.coalesce(x["source"], flat(x))), locator=locator(x), supports=claimed(x), notes=clean(x["notes"]))
    links = F.transform(F.coalesce(raw, empty(contracts.RAW_LINK)), link).cast(f"array<{contracts.LINK}>")
    nowhere = struct(page=null("string"), section=null("string"), quote=null("string"), fragment=null("string"))
    head = struct(role=F.lit("primary"), source=primary, locator=nowhere, supports=F.array(F.lit("measurement.baseline"), F.lit("measurement.current")), notes=null("string"))

    def placed(some: Column) -> Column:
        at = F.array_position(F.transform(some, lambda x: x["source"]["id"]), primary["id"])
        return F.when(at == 0, F.concat(F.array(head.cast(contracts.LINK)), some)).otherwise(
            F.transform(some, lambda x, i: F.when(i + 1 == at, x.withField("role", F.lit("primary")).withField("source", primary.cast(contracts.SOURCE))).otherwise(x))
        )

    def distinct(some: Column) -> Column:
        key = lambda x: F.concat_ws("|", x["role"], x["source"]["id"])
        return F.filter(some, lambda x, i: F.array_position(F.transform(some, key), key(x)) == i + 1)

    alone = F.array(head.cast(contracts.LINK))
    return F.when(F.size(F.coalesce(raw, empty(contracts.RAW_LINK))) == 0, alone).otherwise(_once(_once(links, placed), distinct))


def _once(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), 0)


SOURCE_FIELDS = ("id", "name", "type", "url", "publisher", "license", "retrieved_at", "citation", "checksum", "access_notes")


def gaps(links: Column, notes: Column, confidence: Column) -> Column:
    """What the evidence lacks: code, severity and description, in a fixed order."""
    lacks = lambda field: F.exists(links, lambda x: x["source"][field].isNull())
    has = lambda role: F.exists(links, lambda x: x["role"] == role)
    restricted = F.exists(links, lambda x: F.coalesce(F.lower(x["source"]["access_notes"]), F.lit("")).contains("restricted"))
    rules = [
        (~has("primary"), "missing-source", "critical", "No primary source is identified."),
        (lacks("citation"), "missing-citation", "warning", "One or more linked sources lack a citation."),
        (lacks("license"), "missing-license", "warning", "One or more linked sources lack license metadata."),
        (lacks("retrieved_at"), "missing-retrieval-date", "warning", "One or more linked sources lack a retrieval timestamp."),
        (lacks("checksum"), "missing-checksum", "info", "One or more linked sources lack a content checksum."),
        (clean(notes).isNull(), "missing-method", "warning", "The measurement has no method description."),
        (F.coalesce(confidence, F.lit(0)) < derive.NEEDS_EVIDENCE, "low-confidence", "warning", "Confidence is below the evidence-readiness threshold."),
        (has("conflicting"), "conflicting-evidence", "warning", "The evidence chain includes conflicting evidence."),
        (restricted, "restricted-source", "warning", "The evidence chain includes a restricted source."),
    ]
    gap = lambda code, severity, text: struct(code=F.lit(code), severity=F.lit(severity), description=F.lit(text))
    nothing = F.array(gap("missing-source", "critical", "No source is linked to the measurement."))
    return F.when(F.size(F.coalesce(links, empty(contracts.LINK))) == 0, nothing).otherwise(present(*((rule, gap(*texts)) for rule, *texts in rules)))


def completeness(links: Column, notes: Column, confidence: Column) -> Column:
    """0 to 100: primary source 20, all sources cited 15, licensed 10, dated 10, with checksum 10, method 15, confidence 10, more than one 5, no conflict 5."""
    has = lambda role: F.exists(links, lambda x: x["role"] == role)
    all_have = lambda field: F.forall(links, lambda x: x["source"][field].isNotNull())
    points = [
        (has("primary"), 20), (all_have("citation"), 15), (all_have("license"), 10), (all_have("retrieved_at"), 10), (all_have("checksum"), 10),
        (clean(notes).isNotNull(), 15), (F.coalesce(confidence, F.lit(0)) >= derive.NEEDS_EVIDENCE, 10), (F.size(links) > 1, 5), (~has("conflicting"), 5),
    ]
    return F.when(F.size(F.coalesce(links, empty(contracts.LINK))) == 0, 0).otherwise(sum(F.when(test, p).otherwise(0) for test, p in points))


def lineage_completeness(lineage: Column) -> Column:
    """0 to 100: questions, instruments, datasets, batches and transformations 15 each, observations 20, all of them with dimensions 5."""
    some = lambda part: F.coalesce(F.size(lineage[part]), F.lit(0)) > 0
    points = [(some(part), 15) for part in ("questions", "instruments", "datasets", "batches", "transformations")] + [(some("observations"), 20)]
    placed = some("observations") & F.forall(lineage["observations"], lambda o: F.coalesce(F.size(o["dimensions"]), F.lit(0)) > 0)
    return sum(F.when(F.coalesce(test, F.lit(False)), p).otherwise(0) for test, p in [*points, (placed, 5)])


def quality_dimensions(evidence: Column, lineage: Column, flags: Column, observations: Column, status: Column, uncertainty: Column, limitations: Column) -> dict[str, Column]:
    """Six scores from 0 to 100; ``evidence`` and ``lineage`` are their completeness."""
    flagged = lambda name: F.coalesce(F.array_contains(flags, name), F.lit(False))
    of = lambda *kinds: F.coalesce(F.size(F.filter(observations, lambda o: o["quality_status"].isin(*kinds))), F.lit(0))
    lost = 12 * F.coalesce(F.size(F.array_distinct(flags)), F.lit(0)) + 12 * of("outlier", "rejected") + 5 * of("missing")
    stated = F.when(clean(uncertainty).isNotNull(), 85).otherwise(55)
    return {
        "completeness": F.least(F.lit(100), F.greatest(F.lit(0), F.bround((evidence + lineage) / 2).cast("int"))),
        "validity": F.greatest(F.lit(25), 100 - lost),
        "consistency": F.greatest(F.lit(25), 92 - F.when(flagged("conflicting"), 35).otherwise(0) - F.when(status.eqNullSafe(F.lit("active")), 0).otherwise(15)),
        "timeliness": F.when(flagged("stale"), 45).otherwise(85),
        "provenance": evidence,
        "uncertainty": F.when(F.coalesce(F.size(limitations), F.lit(0)) > 0, F.least(F.lit(100), stated + 5)).otherwise(stated),
    }


def quality_overall(scores: list[Column]) -> Column:
    """Mean of the dimensions, half to even."""
    return F.bround(sum(scores) / len(scores)).cast("int")


def publication_gate(quality: Column, state: Column, critical: Column) -> tuple[Column, Column]:
    """External, internal or blocked by review state, overall quality and open critical gaps; and the reasons against more."""
    reasons = present(
        (~state.eqNullSafe(F.lit("approved")), F.lit("record has not been approved")),
        (quality < 70, F.lit("overall quality score is below 70")),
        (critical, F.lit("critical evidence gaps remain open")),
    )
    known = state.isin("submitted", "in-review", "changes-requested", "approved") & (quality >= 50)
    return F.when(F.size(reasons) == 0, "external").when(known, "internal").otherwise("blocked"), F.array_join(reasons, "; ")


def payload_diff(old: Column, new: Column) -> Column:
    """Sorted paths that differ between two path-to-value maps; no earlier payload differs as a whole."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(old, empty), F.coalesce(new, empty)
    paths = F.array_union(F.map_keys(a), F.map_keys(b))
    return F.when(old.isNull(), F.array(F.lit("$record"))).otherwise(F.array_sort(F.filter(paths, lambda p: ~F.try_element_at(a, p).eqNullSafe(F.try_element_at(b, p)))))


def nested_diff(before: Column, after: Column) -> Column:
    """Sorted dotted paths where two JSON objects differ; no earlier object differs as a whole.

    A path is named where the two are of another kind, where one lacks it, or where its values differ; what lies below a
    named path is not named as well. Lists are compared whole.
    """
    kind = "map<string,string>"

    def paths(both: Column) -> Column:
        a, b = both["a"], both["b"]
        top = lambda p: F.substring_index(p, ".", -1) == p
        parent = lambda p: F.substring(p, F.lit(1), F.length(p) - F.length(F.substring_index(p, ".", -1)) - 1)
        inside = lambda p: top(p) | (F.try_element_at(a, parent(p)).eqNullSafe(F.lit(derive.OBJECT)) & F.try_element_at(b, parent(p)).eqNullSafe(F.lit(derive.OBJECT)))
        every = F.array_union(F.map_keys(a), F.map_keys(b))
        return F.array_sort(F.filter(every, lambda p: ~F.try_element_at(a, p).eqNullSafe(F.try_element_at(b, p)) & inside(p)))

    none = F.create_map().cast(kind)
    both = struct(a=F.coalesce(derive.json_entries(before), none), b=F.coalesce(derive.json_entries(after), none))
    return F.when(before.isNull(), F.array(F.lit("$record"))).otherwise(_once(both, paths))


def distinct_mappings(mappings: Column) -> Column:
    """Framework mappings, the first of each lower-cased (framework, code, relationship)."""
    key = lambda m: F.concat_ws("|", F.lower(m["framework"]), F.lower(m["code"]), F.lower(m["relationship"]))
    keys = F.transform(mappings, key)
    return F.filter(mappings, lambda m, i: F.array_position(keys, key(m)) == i + 1)


def public_projection(records: DataFrame) -> DataFrame:
    """Approved external records without access notes, reviewers and what belongs to non-public datasets."""
    open_ = F.filter("datasets", lambda x: x["access"] == "public")
    ids = F.transform(open_, lambda x: x["id"])
    return records.where("publication_status = 'external'").withColumns(
        {"datasets": open_, "observations": F.filter("observations", lambda o: F.array_contains(ids, o["dataset"])), "access_notes": F.lit(None).cast("string"), "reviewers": F.transform("reviewers", lambda r: F.lit(""))}
    )
