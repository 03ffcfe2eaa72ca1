"""Canonical measurement records from authored ones.

An authored row becomes a record in layers that depend on each other: names and ids, derived judgments, governance of the
indicator, evidence chain, lineage of the observations, review. Each layer is a projection of columns, so a table of any
size becomes records in one pass without a shuffle. What is not authored gets a default that refers to the others by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions import derive
from attesta.operators import contracts
from attesta.operators.evidence import clean, completeness, digest_id, empty, gaps, lineage_completeness, normal_links, normal_source, null, present, publication_gate, quality_dimensions, quality_overall, struct

PRODUCER, CUSTODIAN = "attesta", "unassigned"
RECORD = ("schema_version", "record_id", "record_type", "created_at", "updated_at", "producer", "entity", "indicator", "period", "measurement", "source", "confidence", "review", "method", "extensions", *contracts.DERIVED)
_ISSUE = "struct<path:string,message:string>"


def conformed(column: Column, have: T.DataType, want: T.DataType) -> Column:
    """``column`` in another nested type: what it lacks is null, what the type does not know is left out."""
    if isinstance(want, T.StructType):
        if not isinstance(have, T.StructType):
            return null(want.simpleString())
        known = {f.name: f.dataType for f in have.fields}
        parts = [(conformed(column[f.name], known[f.name], f.dataType) if f.name in known else null(f.dataType.simpleString())).alias(f.name) for f in want.fields]
        return F.when(column.isNotNull(), F.struct(*parts))
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        return F.transform(column, lambda x: conformed(x, have.elementType, want.elementType))
    if isinstance(want, T.ArrayType) and isinstance(have, T.StringType):
        return derive.text_list(column)
    return null(want.simpleString()) if isinstance(have, T.NullType) else column.cast(want)


def authored(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns of an authored record by contracts.AUTHORING, after those of ``keep``; missing ones are null."""
    known = {f.name: f.dataType for f in df.schema.fields}
    parse = lambda kind: T._parse_datatype_string(f"x {kind}").fields[0].dataType
    return df.select(*(keep or []), *((conformed(F.col(n), known[n], parse(kind)) if n in known else null(kind)).alias(n) for n, kind in contracts.AUTHORING.items()))


def from_json(df: DataFrame, text: str, keep: list[str] | None = None) -> DataFrame:
    """Authored records of a column of JSON objects; ``issues`` tells where there is none."""
    kind = "struct<" + ",".join(f"{n}:{k}" for n, k in contracts.AUTHORING.items()) + ",_corrupt:string>"
    parsed = df.withColumn("_parsed", F.from_json(F.col(text), kind, {"columnNameOfCorruptRecord": "_corrupt"}))
    broken = F.col("_parsed").isNull() | F.col("_parsed._corrupt").isNotNull()
    issues = F.when(broken, F.array(_issue("record", F.lit("must be an object")))).otherwise(empty(_ISSUE))
    return parsed.select(*(keep or []), issues.alias("issues"), *(f"_parsed.{n}" for n in contracts.AUTHORING))


#: Columns of a flat row that must not be blank.
REQUIRED = ("entity_name", "indicator_name", "period_label", "current", "source_name", "confidence")


def from_flat(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Authored records of flat rows of texts, and ``issues`` that keep a row from being one.

    ``record_json`` takes the place of all other columns. ``evidence_chain_json``, ``sources_json`` (a list of sources, if
    there is no chain), ``indicator_governance_json``, ``observation_lineage_json`` and ``review_workflow_json`` hold parts.
    """
    column = lambda n: F.nullif(F.col(n).cast("string"), F.lit("")) if n in df.columns else null("string")
    parts = {
        "indicator_governance": ("indicator_governance_json", contracts.RAW_GOVERNANCE), "evidence_chain": ("evidence_chain_json", contracts.RAW_CHAIN),
        "observation_lineage": ("observation_lineage_json", contracts.RAW_LINEAGE), "review_workflow": ("review_workflow_json", contracts.RAW_WORKFLOW),
    }
    whole = column("record_json")
    missing = F.array_join(F.array_compact(F.array(*(F.when(clean(column(n)).isNull(), n) for n in REQUIRED))), ", ")
    issues = [F.when(whole.isNull() & (missing != ""), _issue("record", F.concat(F.lit("missing required columns: "), missing)))]
    for name in ("record_json", *(n for n, _ in parts.values())):
        is_object = clean(column(name)).startswith("{") & F.try_parse_json(column(name)).isNotNull()
        issues.append(F.when(column(name).isNotNull() & ~F.coalesce(is_object, F.lit(False)), _issue(name, F.lit("must contain an object"))))
    some = column("sources_json")
    is_list = clean(some).startswith("[") & F.try_parse_json(some).isNotNull()
    issues.append(F.when(some.isNotNull() & column("evidence_chain_json").isNull() & ~F.coalesce(is_list, F.lit(False)), _issue("sources_json", F.lit("must contain an array"))))
    links = F.from_json(some, f"array<{contracts.RAW_LINK}>")
    bare = F.when(links.isNotNull(), struct(sources=links, relationships=null(f"array<{contracts.RELATIONSHIP}>"), transformations=null(f"array<{contracts.EVIDENCE_STEP}>"), gaps=null(f"array<{contracts.GAP}>")))
    external = F.when(column("external_id_namespace").isNotNull() & column("external_id").isNotNull(), F.create_map(column("external_id_namespace"), column("external_id"))).otherwise(F.create_map().cast(contracts.MAP))
    flat = {
        "record_id": column("record_id"), "created_at": column("created_at"), "updated_at": column("updated_at"),
        "entity": struct(id=column("entity_id"), name=column("entity_name"), type=column("entity_type"), external_ids=external),
        "indicator": struct(id=column("indicator_id"), name=column("indicator_name"), unit=F.coalesce(column("unit"), F.lit("unspecified")), direction=column("direction"), framework=column("framework"), version=column("indicator_version")),
        "period": struct(id=column("period_id"), label=column("period_label"), start_date=column("start_date"), end_date=column("end_date")),
        "values": struct(baseline=column("baseline"), current=column("current")),
        "source": struct(id=column("source_id"), name=column("source_name"), type=column("source_type"), url=column("source_url"), publisher=column("publisher"), license=column("license"), retrieved_at=column("retrieved_at"), citation=column("citation"), checksum=column("checksum"), access_notes=column("access_notes")),
        "confidence": struct(score=column("confidence"), basis=column("confidence_basis")),
        "method": struct(notes=column("method_notes"), assumptions=derive.text_list(column("assumptions")), limitations=derive.text_list(column("limitations")), uncertainty=column("uncertainty"), quality_flags=derive.text_list(column("quality_flags"))),
        "reviewer_notes": column("reviewer_notes"), "extensions": F.create_map().cast(contracts.MAP),
        **{name: F.coalesce(F.from_json(column(of), kind), bare) if name == "evidence_chain" else F.from_json(column(of), kind) for name, (of, kind) in parts.items()},
    }
    given = F.from_json(whole, "struct<" + ",".join(f"{n}:{k}" for n, k in contracts.AUTHORING.items()) + ">")
    rows = df.select(*(keep or []), F.array_compact(F.array(*issues)).alias("issues"), whole.isNotNull().alias("_whole"), given.alias("_given"), *(flat[n].cast(k).alias(n) for n, k in contracts.AUTHORING.items()))
    return rows.select(*(keep or []), "issues", *(F.when(F.col("_whole"), F.col(f"_given.{n}")).otherwise(F.col(n)).alias(n) for n in contracts.AUTHORING))


def _issue(path: Column | str, message: Column) -> Column:
    return struct(path=F.lit(path) if isinstance(path, str) else path, message=message)


def _number(text: Column) -> Column:
    """A finite number in a text, else null."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def lineage_id(kind: str, *parts: Column) -> Column:
    """kind:slug:16 digits, by the trimmed, lower-cased parts joined by bars; the slug is that of the first part with a text."""
    plain = [F.coalesce(clean(p.cast("string")), F.lit("")) for p in parts]
    anchor = F.coalesce(*(F.nullif(p, F.lit("")) for p in plain), F.lit(kind))
    return F.concat_ws(":", F.lit(kind), derive.slug(anchor), F.substring(F.sha2(F.lower(F.concat_ws("|", *plain)), 256), 1, 16))


def with_core(df: DataFrame, keep: list[str], now: str, producer: str, component: str) -> DataFrame:
    """Names, ids, derived judgments and ``issues`` of authored rows, whose derived parts are renamed to ``raw_*``."""
    c = F.col
    first = {
        "_name": clean(c("entity.name")), "_type": F.coalesce(clean(c("entity.type")), F.lit("other")), "_indicator": clean(c("indicator.name")), "_unit": clean(c("indicator.unit")),
        "_direction": F.coalesce(clean(c("indicator.direction")), F.lit("neutral")), "_label": clean(c("period.label")), "_baseline": _number(c("values.baseline")), "_current": _number(c("values.current")),
        "_score": F.when(c("confidence").isNull(), F.lit(0.0)).otherwise(_number(c("confidence.score"))), "_source": F.coalesce(clean(c("source.name")), F.lit(derive.MISSING_SOURCE)),
        "_created": F.coalesce(derive.utc_seconds(clean(c("created_at"))), F.lit(now)),
    }
    not_a_time = lambda n: clean(c(n)).isNotNull() & derive.utc_seconds(clean(c(n))).isNull()
    parts = lambda n: F.array_distinct(F.filter(F.transform(F.coalesce(c(f"method.{n}"), empty("string")), clean), lambda x: x.isNotNull()))
    issues = [
        (c("_name").isNull(), "entity.name", "is required"), (c("_indicator").isNull(), "indicator.name", "is required"), (c("_unit").isNull(), "indicator.unit", "is required"), (c("_label").isNull(), "period", "is required"),
        (clean(c("values.baseline")).isNotNull() & c("_baseline").isNull(), "measurement.baseline", "must be a finite number"), (c("_current").isNull(), "measurement.current", "must be a finite number"),
        (c("_score").isNull(), "confidence.score", "must be a finite number"), (not_a_time("created_at"), "created_at", "must be an ISO 8601 date-time"), (not_a_time("updated_at"), "updated_at", "must be an ISO 8601 date-time"),
    ]
    raw = {f"raw_{n}": c(n) for n in contracts.DERIVED}
    df = df.withColumns(first).withColumns(raw).drop(*contracts.DERIVED)
    change = derive.percent_change(c("_baseline"), c("_current"))
    kept_type = F.coalesce(clean(c("source.type")), F.lit("unspecified"))
    source = {f: clean(c(f"source.{f}")) for f in ("url", "publisher", "license", "retrieved_at", "citation", "checksum", "access_notes")}
    df = df.withColumns(
        {
            "entity": struct(id=F.coalesce(clean(c("entity.id")), derive.stable_id("entity", c("_type"), c("_name"))), name=c("_name"), type=c("_type"), external_ids=F.coalesce(c("entity.external_ids"), F.create_map().cast(contracts.MAP))),
            "indicator": struct(id=F.coalesce(clean(c("indicator.id")), derive.stable_id("indicator", c("_indicator"), c("_unit"), c("_direction"))), name=c("_indicator"), unit=c("_unit"), direction=c("_direction"), framework=clean(c("indicator.framework")), version=F.coalesce(clean(c("indicator.version")), F.lit("1.0"))),
            "period": struct(id=F.coalesce(clean(c("period.id")), derive.stable_id("period", c("_label"))), label=c("_label"), start_date=clean(c("period.start_date")), end_date=clean(c("period.end_date"))),
            "source": struct(id=F.coalesce(clean(c("source.id")), derive.stable_id("source", c("_source"), source["publisher"], source["url"])), name=c("_source"), type=F.when(kept_type.isin(*contracts.SOURCE_TYPES), kept_type).otherwise("other"), **source),
            "confidence": struct(score=c("_score"), scale=F.lit("0-100"), basis=clean(c("confidence.basis"))),
            "method": struct(notes=F.coalesce(clean(c("method.notes")), F.lit("")), assumptions=parts("assumptions"), limitations=parts("limitations"), uncertainty=clean(c("method.uncertainty")), quality_flags=parts("quality_flags")),
            "measurement": struct(baseline=c("_baseline"), current=c("_current"), percent_change=change),
            "created_at": c("_created"), "updated_at": F.coalesce(derive.utc_seconds(clean(c("updated_at"))), c("_created")),
            "producer": struct(name=F.lit(producer), component=F.lit(component)),
            "extensions": F.coalesce(c("extensions"), F.create_map().cast(contracts.MAP)),
            "schema_version": F.lit(contracts.RECORD), "record_type": F.lit("measurement"),
            "_issues": present(*((test, _issue(path, F.lit(message))) for test, path, message in issues)),
        }
    )
    return df.withColumns(
        {
            "record_id": F.coalesce(clean(c("record_id")), derive.stable_id("measurement", c("entity.id"), c("indicator.id"), c("period.id"), c("source.id"))),
            "review": struct(status=derive.classify_review(c("_score"), derive.source_is_missing(c("_source"))), signal_status=derive.classify_signal(change, c("_direction")), reviewer_notes=F.coalesce(clean(c("reviewer_notes")), F.lit(""))),
            "issues": F.concat(c("issues") if "issues" in df.columns else empty(_ISSUE), c("_issues")),
        }
    ).drop(*first, "_issues", "values", "reviewer_notes")


def normal_unit(raw: Column, symbol: Column) -> tuple[Column, Column]:
    """A unit with its dimension inferred from the symbol, factor and offset; and what is wrong with it.

    ``raw`` is a RAW_UNIT or null, ``symbol`` the indicator's unit. A factor that is no positive number is 1 in the unit
    and named in the issues.
    """
    sign = F.coalesce(clean(raw["symbol"]), symbol)
    word = F.regexp_replace(F.regexp_replace(F.lower(sign), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    dimension = F.coalesce(clean(raw["dimension"]), F.nullif(word, F.lit("")), F.lit("unspecified"))
    key = F.coalesce(clean(raw["id"]), digest_id("unit", dimension, sign))
    factor, offset = (_number(F.coalesce(clean(raw[n]), F.lit(d))) for n, d in (("conversion_factor", "1"), ("conversion_offset", "0")))
    issues = [
        (factor.isNull(), _issue("unit.conversion_factor", F.lit("must be a finite number"))),
        (factor <= 0, _issue("unit.conversion_factor", F.lit("must be greater than zero"))),
        (offset.isNull(), _issue("unit.conversion_offset", F.lit("must be a finite number"))),
    ]
    unit = struct(
        id=key, symbol=sign, name=F.coalesce(clean(raw["name"]), sign), dimension=dimension, canonical_unit_id=F.coalesce(clean(raw["canonical_unit_id"]), key),
        conversion_factor=F.when(factor > 0, factor).otherwise(1.0), conversion_offset=F.coalesce(offset, F.lit(0.0)),
    )
    return unit, present(*issues)


def _distinct(texts: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.coalesce(texts, empty("string")), clean), lambda x: x.isNotNull()))


def with_governance(df: DataFrame, custodian: str = CUSTODIAN) -> DataFrame:
    """indicator_governance by ``raw_indicator_governance`` and defaults; units that cannot be used join ``issues``."""
    c, raw = F.col, F.col("raw_indicator_governance")
    unit, wrong = normal_unit(raw["unit"], c("indicator.unit"))
    code = F.coalesce(clean(raw["code"]), F.regexp_replace(c("indicator.id"), "^[^:]*:", ""))
    title = F.coalesce(clean(raw["methodology"]["title"]), F.concat(c("indicator.name"), F.lit(" methodology")))
    way = raw["methodology"]
    methodology = struct(
        id=F.coalesce(clean(way["id"]), digest_id("method", c("indicator.id"), title)), version=F.coalesce(clean(way["version"]), c("indicator.version")), title=title,
        description=F.coalesce(clean(way["description"]), clean(c("method.notes")), F.lit("")), formula=clean(way["formula"]), references=_distinct(way["references"]),
        status=F.coalesce(clean(way["status"]), F.lit("draft")), approved_by=clean(way["approved_by"]), approved_at=clean(way["approved_at"]), revision_notes=clean(way["revision_notes"]),
    )
    mapping = lambda m: struct(framework=clean(m["framework"]), code=clean(m["code"]), relationship=F.coalesce(clean(m["relationship"]), F.lit("relatedMatch")), notes=clean(m["notes"]))
    df = df.withColumns({"_unit": unit, "_wrong": wrong, "_code": code, "_method": methodology, "_mappings": F.transform(F.coalesce(raw["framework_mappings"], empty(contracts.MAPPING)), mapping)})
    key = lambda m: F.concat_ws("|", F.lower(m["framework"]), F.lower(m["code"]), m["relationship"])
    distinct = F.filter("_mappings", lambda m, i: F.array_position(F.transform("_mappings", key), key(m)) == i + 1)
    own = F.array(struct(framework=c("indicator.framework"), code=c("_code"), relationship=F.lit("exactMatch"), notes=null("string")))
    part = lambda n: F.when(raw[n].isNotNull(), struct(**{f: clean(raw[n][f]) for f in ("name", "unit_id", "description")}))
    fit = raw["compatibility"]
    or_else = lambda given, default: F.when(F.size(_distinct(given)) > 0, _distinct(given)).otherwise(F.array(default))
    governance = struct(
        schema_version=F.lit(contracts.GOVERNANCE), namespace=F.lower(F.coalesce(clean(raw["namespace"]), F.lit("sc"))), code=c("_code"), domain=F.coalesce(clean(raw["domain"]), c("indicator.framework"), F.lit("general")),
        custodian=F.coalesce(clean(raw["custodian"]), F.lit(custodian)), status=F.coalesce(clean(raw["status"]), F.lit("active")), aliases=_distinct(raw["aliases"]), definition=F.coalesce(clean(raw["definition"]), c("indicator.name")),
        frequency=F.coalesce(clean(raw["frequency"]), F.lit("annual")), aggregation=F.coalesce(clean(raw["aggregation"]), F.lit("point-estimate")), disaggregation_dimensions=_distinct(raw["disaggregation_dimensions"]),
        numerator=part("numerator"), denominator=part("denominator"), unit=c("_unit"), methodology=c("_method"), framework_mappings=F.when((F.size("_mappings") == 0) & c("indicator.framework").isNotNull(), own).otherwise(distinct),
        compatibility=struct(comparable_versions=or_else(fit["comparable_versions"], c("indicator.version")), required_dimensions=_distinct(fit["required_dimensions"]), methodology_equivalence=or_else(fit["methodology_equivalence"], c("_method.id")), notes=clean(fit["notes"])),
    )
    inside = F.when(F.size("_wrong") == 0, empty(_ISSUE)).otherwise(F.transform("_wrong", lambda x: x.withField("path", F.concat(F.lit("indicator_governance."), x["path"]))))
    issues = F.concat("issues", inside).cast(f"array<{_ISSUE}>")
    return df.withColumns({"indicator_governance": governance.cast(contracts.GOVERNED), "issues": issues}).drop("_unit", "_wrong", "_code", "_method", "_mappings", "raw_indicator_governance")


def with_evidence(df: DataFrame) -> DataFrame:
    """evidence_chain by ``raw_evidence_chain``: the record's source comes first or is the primary one of the links."""
    c, raw = F.col, F.col("raw_evidence_chain")
    df = df.withColumn("_primary", normal_source(c("source")).cast(contracts.SOURCE))
    df = df.withColumn("_links", normal_links(raw["sources"], c("_primary")))
    df = df.withColumn("_gaps", gaps(c("_links"), c("method.notes"), c("confidence.score")))
    relation = lambda r: struct(**{f: clean(r[f]) for f in ("subject_source_id", "predicate", "object_source_id", "notes")})
    known = F.transform("_gaps", lambda g: g["code"])
    valid = F.filter(F.coalesce(raw["gaps"], empty(contracts.GAP)), lambda g: g["code"].isin(*contracts.GAP_CODES) & g["severity"].isin(*contracts.GAP_SEVERITIES) & clean(g["description"]).isNotNull() & ~F.array_contains(known, g["code"]))
    df = df.withColumn("_more", valid)
    more = F.filter("_more", lambda g, i: F.array_position(F.transform("_more", lambda x: x["code"]), g["code"]) == i + 1)

    def step(t: Column, i: Column) -> Column:
        operation, text = clean(t["operation"]), clean(t["description"])
        return struct(
            id=F.coalesce(clean(t["id"]), digest_id("transformation", operation, text, i + 1)), operation=operation, description=text, software=clean(t["software"]),
            parameters=F.coalesce(t["parameters"], F.create_map().cast(contracts.MAP)), occurred_at=F.coalesce(derive.utc_seconds(clean(t["occurred_at"])), c("updated_at")),
        )

    chain = struct(
        schema_version=F.lit(contracts.EVIDENCE), sources=c("_links"), relationships=F.transform(F.coalesce(raw["relationships"], empty(contracts.RELATIONSHIP)), relation),
        transformations=F.transform(F.coalesce(raw["transformations"], empty(contracts.EVIDENCE_STEP)), step), gaps=F.concat("_gaps", more.cast(f"array<{contracts.GAP}>")),
        completeness_score=completeness(c("_links"), c("method.notes"), c("confidence.score")),
    )
    return df.withColumn("evidence_chain", chain.cast(contracts.CHAIN)).drop("_primary", "_links", "_gaps", "_more", "raw_evidence_chain")


def with_lineage(df: DataFrame) -> DataFrame:
    """observation_lineage by ``raw_observation_lineage``: question, instrument, dataset, batch, observations and the step from them to the measurement."""
    c, raw = F.col, F.col("raw_observation_lineage")
    given = lambda part, default: F.when(F.size(F.coalesce(raw[part], F.array().cast(raw_kind(part)))) > 0, raw[part]).otherwise(default.cast(raw_kind(part)))
    kinds = {"questions": contracts.QUESTION, "instruments": contracts.INSTRUMENT, "datasets": contracts.DATASET, "batches": contracts.BATCH, "observations": contracts.OBSERVATION, "transformations": contracts.LINEAGE_STEP}
    raw_kind = lambda part: f"array<{kinds[part]}>"
    unit, way = c("indicator_governance.unit.id"), c("indicator_governance.methodology")
    text = F.lit
    no = null("string")
    field = lambda name, kind, described, last, of=None: struct(name=text(name), data_type=text(kind), unit_id=no if of is None else of, description=described, **last)
    question = struct(
        id=lineage_id("question", c("entity.id"), c("indicator.id")),
        text=F.concat(text("What is the value of "), c("indicator.name"), text(" for "), c("entity.name"), text(" during "), c("period.label"), text("?")),
        type=text("monitoring"), decision_context=no, status=text("active"), owner=c("producer.name"),
    )
    instrument = struct(
        id=lineage_id("instrument", c("source.id"), c("source.type")), name=F.concat(c("source.name"), text(" collection instrument")),
        type=F.coalesce(F.element_at(F.create_map(*(text(x) for pair in contracts.INSTRUMENTS.items() for x in pair)), c("source.type")), text("other")), version=text("1.0"),
        description=F.coalesce(c("source.access_notes"), F.concat(text("Collection instrument associated with "), c("source.name"), text("."))),
        protocol=F.coalesce(clean(way["description"]), clean(c("method.notes"))), provider=c("source.publisher"), calibration=no,
        fields=F.array(field("value", "number", c("indicator.name"), {"required": text(True)}, unit), field("observed_at", "datetime", text("Observation timestamp"), {"required": text(True)})),
    )
    never = {"nullable": text(False)}
    dataset = struct(
        id=lineage_id("dataset", c("source.id"), c("indicator.id")), name=c("source.name"), version=F.coalesce(c("source.checksum"), c("source.retrieved_at"), text("1.0")),
        description=F.coalesce(c("source.citation"), F.concat(text("Dataset supporting "), c("indicator.name"), text("."))), license=c("source.license"),
        access=F.when(F.array_contains("method.quality_flags", "restricted"), "restricted").otherwise("public"), checksum=c("source.checksum"),
        fields=F.array(field("value", "number", c("indicator.name"), never, unit), field("entity_id", "string", text("Canonical entity identifier"), never), field("period_id", "string", text("Canonical reporting period identifier"), never)),
    )
    df = df.withColumns({"_questions": given("questions", F.array(question)), "_instruments": given("instruments", F.array(instrument)), "_datasets": given("datasets", F.array(dataset))})
    day = lambda n: F.coalesce(F.concat(c(f"period.{n}"), text("T00:00:00Z")), c("updated_at"))
    compared = c("measurement.baseline").isNotNull()
    batch = struct(
        id=lineage_id("batch", c("record_id"), c("updated_at")), dataset_id=F.get("_datasets", 0)["id"], instrument_id=F.get("_instruments", 0)["id"], collected_at=day("end_date"),
        received_at=F.coalesce(c("source.retrieved_at"), c("updated_at")), collector=F.coalesce(c("source.publisher"), c("producer.name")), protocol=clean(c("method.notes")), record_count=F.when(compared, 2).otherwise(1), notes=no,
    )
    df = df.withColumn("_batches", given("batches", F.array(batch)))

    def observation(role: str, at: str) -> Column:
        value = c(f"measurement.{role}")
        return struct(
            id=lineage_id("observation", c("record_id"), text(role)), batch_id=F.get("_batches", 0)["id"], role=text(role), observed_at=day(at), value=value, value_text=no, unit_id=unit,
            quality_status=F.when(value.isNull(), "missing").otherwise("valid"), missing_reason=F.when(value.isNull(), "baseline not supplied"), censoring=no, outlier=text(False), imputation=no,
            dimensions=F.create_map(text("entity_id"), c("entity.id"), text("period_id"), c("period.id")), raw_payload=F.create_map().cast(contracts.MAP),
        )

    df = df.withColumn("_observations", given("observations", present((compared, observation("baseline", "start_date")), (text(True), observation("current", "end_date")))))
    step = struct(
        id=lineage_id("transformation", c("record_id"), way["id"], way["version"]), operation=F.when(F.size("_observations") == 1, "identity").otherwise("baseline-current comparison"),
        description=F.coalesce(clean(c("method.notes")), text("Map governed observations to the canonical measurement.")), software=c("producer.name"),
        parameters=F.create_map(text("methodology_id"), way["id"], text("methodology_version"), way["version"]), input_observation_ids=F.transform("_observations", lambda o: o["id"]),
        output_measurement_fields=F.array(*map(text, ("measurement.baseline", "measurement.current", "measurement.percent_change"))), occurred_at=c("updated_at"),
    )
    df = df.withColumn("_transformations", given("transformations", F.array(step)))
    lineage = struct(schema_version=text(contracts.LINEAGE), **{p: c(f"_{p}") for p in kinds})
    df = df.withColumn("_lineage", lineage)
    whole = struct(schema_version=text(contracts.LINEAGE), **{p: c(f"_{p}") for p in kinds}, completeness_score=lineage_completeness(c("_lineage")))
    return df.withColumn("observation_lineage", whole.cast(contracts.LINEAGE_TYPE)).drop("_lineage", "raw_observation_lineage", *(f"_{p}" for p in kinds))


#: What each dimension of quality rests on.
BASIS = {
    "completeness": "Average of evidence-chain and observation-lineage completeness.",
    "validity": "Derived from method quality flags and observation quality states.",
    "consistency": "Derived from indicator governance status and conflicting-data flags.",
    "timeliness": "Reduced when the record is explicitly marked stale.",
    "provenance": "Equal to evidence-chain completeness.",
    "uncertainty": "Higher when uncertainty and limitations are explicitly documented.",
}


def with_workflow(df: DataFrame) -> DataFrame:
    """review_workflow by ``raw_review_workflow``: six scores of quality, the publication gate and the first revision."""
    c, raw = F.col, F.col("raw_review_workflow")
    scores = quality_dimensions(
        c("evidence_chain.completeness_score"), c("observation_lineage.completeness_score"), c("method.quality_flags"), c("observation_lineage.observations"),
        c("indicator_governance.status"), c("method.uncertainty"), c("method.limitations"),
    )
    own, who = raw["quality"], c("producer.component")
    df = df.withColumns({f"_{n}": F.when(own.isNotNull(), own[n]).otherwise(score) for n, score in scores.items()})
    overall = quality_overall([c(f"_{n}") for n in scores])
    basis = F.create_map(*(F.lit(x) for pair in BASIS.items() for x in pair))
    quality = struct(
        **{n: c(f"_{n}") for n in scores}, overall=F.coalesce(own["overall"], overall), basis=F.coalesce(own["basis"], F.when(own.isNull(), basis), F.create_map().cast(contracts.MAP)),
        assessed_by=F.coalesce(own["assessed_by"], who), assessed_at=F.coalesce(own["assessed_at"], c("updated_at")),
    )
    df = df.withColumns({"_quality": quality, "_state": F.coalesce(raw["state"], F.lit("draft"))})
    critical = F.exists("evidence_chain.gaps", lambda g: g["severity"] == "critical")
    status, reasons = publication_gate(c("_quality.overall"), c("_state"), critical)
    gate = struct(status=status, reasons=F.when(reasons == "", empty("string")).otherwise(F.split(reasons, "; ")), approved_by=null("string"), approved_at=null("string"))
    revision = struct(number=F.lit(1), action=F.lit("inserted"), change_summary=F.lit("Initial governed record revision."), reason=F.lit("Initial repository registration."), changed_by=who, compared_to_sha256=null("string"))
    workflow = struct(
        schema_version=F.lit(contracts.WORKFLOW), state=c("_state"), priority=F.coalesce(raw["priority"], F.lit("normal")), assigned_reviewers=_distinct(raw["assigned_reviewers"]), quality=c("_quality"),
        publication_gate=F.coalesce(raw["publication_gate"], gate.cast(contracts.GATE)), revision=F.coalesce(raw["revision"], revision.cast(contracts.REVISION)),
        decisions=F.coalesce(raw["decisions"], empty(contracts.DECISION)), comments=F.coalesce(raw["comments"], empty(contracts.COMMENT)),
    )
    return df.withColumn("review_workflow", workflow.cast(contracts.WORKFLOW_TYPE)).drop(*(f"_{n}" for n in scores), "_quality", "_state", "raw_review_workflow")


def canonical(df: DataFrame, now: str, producer: str = PRODUCER, component: str = "python-engine", custodian: str = CUSTODIAN, keep: list[str] | None = None) -> DataFrame:
    """Records of authored rows (see ``authored``, ``from_json``, ``from_flat``), with ``keep`` and ``issues``.

    Rows that cannot be records keep their place: ``issues`` names the path and what is wrong with it. ``now`` (ISO 8601)
    is the creation time where none is authored. Store the records before they are filtered by derived parts or joined:
    a filter would be pushed down through all layers and repeat them.
    """
    keep = keep or []
    core = with_core(df, keep, now, producer, component)
    built = with_workflow(with_lineage(with_evidence(with_governance(core, custodian))))
    return built.select(*keep, *RECORD, "issues")


def completed(records: DataFrame, custodian: str = CUSTODIAN) -> DataFrame:
    """Canonical records whose absent (null) derived parts are filled in; parts that are there stay as they are."""
    extra = [n for n in records.columns if n not in RECORD]
    df = records.withColumns({f"had_{n}": F.col(n) for n in contracts.DERIVED}).withColumn("issues", empty(_ISSUE))
    layers = {"indicator_governance": lambda d: with_governance(d, custodian), "evidence_chain": with_evidence, "observation_lineage": with_lineage, "review_workflow": with_workflow}
    raws = {"indicator_governance": contracts.RAW_GOVERNANCE, "evidence_chain": contracts.RAW_CHAIN, "observation_lineage": contracts.RAW_LINEAGE, "review_workflow": contracts.RAW_WORKFLOW}
    for name, layer in layers.items():
        df = layer(df.withColumn(f"raw_{name}", null(raws[name])))
        df = df.withColumn(name, F.coalesce(f"had_{name}", name))
    return df.select(*extra, *RECORD)
