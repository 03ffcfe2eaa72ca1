"""Fixed values of the record contract and the types of its nested parts."""

from __future__ import annotations

RECORD, EVIDENCE, GOVERNANCE, LINEAGE, WORKFLOW = "record/1.0", "evidence-chain/1.0", "indicator-governance/1.0", "observation-lineage/1.0", "review-workflow/1.0"

# What the enumerated fields of a record may hold.
ENTITY_TYPES = ("country", "organization", "project", "program", "site", "policy", "persona", "experiment", "dataset", "other")
SOURCE_TYPES = ("internal record", "third-party dataset", "survey", "public registry", "model estimate", "publication", "sensor", "api", "other", "unspecified")
COMPONENTS = ("python-engine", "browser-demo", "migration-tool", "external", "import-service", "repository-service", "connector-service")
DIRECTIONS = ("higher", "lower", "neutral")
QUALITY_FLAGS = ("estimated", "incomplete", "outlier", "imputed", "stale", "conflicting", "restricted", "unverified")
EVIDENCE_ROLES = ("primary", "supporting", "conflicting", "derived", "contextual")
RELATIONSHIPS = ("corroborates", "conflicts_with", "derived_from", "supersedes", "duplicates", "contextualizes")
GAP_SEVERITIES = ("info", "warning", "critical")
GAP_CODES = ("missing-source", "missing-citation", "missing-license", "missing-retrieval-date", "missing-checksum", "missing-method", "low-confidence", "conflicting-evidence", "restricted-source", "stale-source")
INDICATOR_STATUSES = ("draft", "active", "deprecated", "replaced", "archived")
FREQUENCIES = ("continuous", "daily", "weekly", "monthly", "quarterly", "annual", "irregular", "event", "custom")
AGGREGATIONS = ("sum", "mean", "median", "minimum", "maximum", "count", "ratio", "index", "point-estimate", "cumulative", "custom")
METHOD_STATUSES = ("draft", "in-review", "approved", "deprecated", "archived")
MAPPINGS = ("exactMatch", "closeMatch", "broaderMatch", "narrowerMatch", "relatedMatch")
QUESTION_TYPES = ("research", "decision", "monitoring", "evaluation")
QUESTION_STATUSES = ("draft", "active", "answered", "archived")
INSTRUMENT_TYPES = ("survey", "sensor", "form", "api", "administrative", "model", "manual", "other")
ACCESS_LEVELS = ("public", "internal", "restricted", "confidential")
OBSERVATION_ROLES = ("baseline", "current", "supporting", "derived")
OBSERVATION_STATUSES = ("valid", "missing", "censored", "outlier", "imputed", "rejected")
REVIEW_STATES = ("draft", "submitted", "in-review", "changes-requested", "approved", "rejected", "superseded", "archived")
PRIORITIES = ("low", "normal", "high", "critical")
DECISIONS = ("submitted", "review_started", "changes_requested", "approved", "rejected", "superseded", "archived", "reopened", "quality_assessed", "publication_gate_updated", "assigned", "unassigned", "commented")
VISIBILITIES = ("internal", "public")
GATES = ("blocked", "internal", "external")
QUALITY_DIMENSIONS = ("completeness", "validity", "consistency", "timeliness", "provenance", "uncertainty")
ID_PATTERN = "^[a-z][a-z0-9._:-]{2,255}$"
EXTENSION_PATTERN = "^[a-z][a-z0-9]*([.-][a-z0-9-]+)+$"
CHECKSUM_PATTERN = "^sha256:[0-9a-f]{64}$"
NAMESPACE_PATTERN = "^[a-z][a-z0-9.-]{1,63}$"
INSTRUMENTS = {"survey": "survey", "sensor": "sensor", "api": "api", "model estimate": "model", "public registry": "administrative", "internal record": "administrative", "third-party dataset": "administrative", "publication": "manual"}


def texts(*names: str) -> str:
    return ",".join(f"{n}:string" for n in names)


MAP = "map<string,string>"
_SOURCE = texts("id", "name", "type", "url", "publisher", "license", "retrieved_at", "citation", "checksum", "access_notes")
SOURCE = f"struct<{_SOURCE}>"
LOCATOR = f"struct<{texts('page', 'section', 'quote', 'fragment')}>"
LINK = f"struct<role:string,source:{SOURCE},locator:{LOCATOR},supports:array<string>,notes:string>"
#: A link as authored: its source nested, or the source's fields beside the role.
RAW_LINK = f"struct<role:string,source:{SOURCE},locator:{LOCATOR},supports:array<string>,notes:string,{_SOURCE}>"
RELATIONSHIP = f"struct<{texts('subject_source_id', 'predicate', 'object_source_id', 'notes')}>"
EVIDENCE_STEP = f"struct<{texts('id', 'operation', 'description', 'software')},parameters:{MAP},occurred_at:string>"
GAP = f"struct<{texts('code', 'severity', 'description')}>"
RAW_CHAIN = f"struct<sources:array<{RAW_LINK}>,relationships:array<{RELATIONSHIP}>,transformations:array<{EVIDENCE_STEP}>,gaps:array<{GAP}>>"
CHAIN = f"struct<schema_version:string,sources:array<{LINK}>,relationships:array<{RELATIONSHIP}>,transformations:array<{EVIDENCE_STEP}>,gaps:array<{GAP}>,completeness_score:int>"

UNIT = f"struct<{texts('id', 'symbol', 'name', 'dimension', 'canonical_unit_id')},conversion_factor:double,conversion_offset:double>"
RAW_UNIT = f"struct<{texts('id', 'symbol', 'name', 'dimension', 'canonical_unit_id', 'conversion_factor', 'conversion_offset')}>"
METHODOLOGY = f"struct<{texts('id', 'version', 'title', 'description', 'formula')},references:array<string>,{texts('status', 'approved_by', 'approved_at', 'revision_notes')}>"
MAPPING = f"struct<{texts('framework', 'code', 'relationship', 'notes')}>"
COMPATIBILITY = "struct<comparable_versions:array<string>,required_dimensions:array<string>,methodology_equivalence:array<string>,notes:string>"
_COMPONENT = f"struct<{texts('name', 'unit_id', 'description')}>"
_GOVERNED = (
    f"{texts('namespace', 'code', 'domain', 'custodian', 'status')},aliases:array<string>,{texts('definition', 'frequency', 'aggregation')},disaggregation_dimensions:array<string>,"
    f"numerator:{_COMPONENT},denominator:{_COMPONENT},unit:%s,methodology:{METHODOLOGY},framework_mappings:array<{MAPPING}>,compatibility:{COMPATIBILITY}>"
)
RAW_GOVERNANCE = "struct<" + _GOVERNED % RAW_UNIT
GOVERNED = "struct<schema_version:string," + _GOVERNED % UNIT

QUESTION = f"struct<{texts('id', 'text', 'type', 'decision_context', 'status', 'owner')}>"
_FIELD = texts("name", "data_type", "unit_id", "description")
INSTRUMENT = f"struct<{texts('id', 'name', 'type', 'version', 'description', 'protocol', 'provider', 'calibration')},fields:array<struct<{_FIELD},required:boolean>>>"
DATASET = f"struct<{texts('id', 'name', 'version', 'description', 'license', 'access', 'checksum')},fields:array<struct<{_FIELD},nullable:boolean>>>"
BATCH = f"struct<{texts('id', 'dataset_id', 'instrument_id', 'collected_at', 'received_at', 'collector', 'protocol')},record_count:int,notes:string>"
OBSERVATION = f"struct<{texts('id', 'batch_id', 'role', 'observed_at')},value:double,{texts('value_text', 'unit_id', 'quality_status', 'missing_reason', 'censoring')},outlier:boolean,imputation:string,dimensions:{MAP},raw_payload:{MAP}>"
LINEAGE_STEP = f"struct<{texts('id', 'operation', 'description', 'software')},parameters:{MAP},input_observation_ids:array<string>,output_measurement_fields:array<string>,occurred_at:string>"
RAW_LINEAGE = f"struct<questions:array<{QUESTION}>,instruments:array<{INSTRUMENT}>,datasets:array<{DATASET}>,batches:array<{BATCH}>,observations:array<{OBSERVATION}>,transformations:array<{LINEAGE_STEP}>>"
LINEAGE_TYPE = RAW_LINEAGE.replace("struct<questions", "struct<schema_version:string,questions", 1)[:-1] + ",completeness_score:int>"

QUALITY = f"struct<{','.join(f'{d}:int' for d in QUALITY_DIMENSIONS)},overall:int,basis:{MAP},assessed_by:string,assessed_at:string>"
GATE = "struct<status:string,reasons:array<string>,approved_by:string,approved_at:string>"
REVISION = f"struct<number:int,{texts('action', 'change_summary', 'reason', 'changed_by', 'compared_to_sha256')}>"
DECISION = f"struct<{texts('id', 'type', 'actor', 'reason', 'notes', 'occurred_at')}>"
COMMENT = f"struct<{texts('id', 'actor', 'body', 'visibility', 'occurred_at')}>"
RAW_WORKFLOW = f"struct<state:string,priority:string,assigned_reviewers:array<string>,quality:{QUALITY},publication_gate:{GATE},revision:{REVISION},decisions:array<{DECISION}>,comments:array<{COMMENT}>>"
WORKFLOW_TYPE = RAW_WORKFLOW.replace("struct<state", "struct<schema_version:string,state", 1)

#: Columns of an authored record; numbers as texts, so that what is no number can be told.
AUTHORING = {
    "record_id": "string", "created_at": "string", "updated_at": "string",
    "entity": f"struct<{texts('id', 'name', 'type')},external_ids:{MAP}>",
    "indicator": f"struct<{texts('id', 'name', 'unit', 'direction', 'framework', 'version')}>",
    "period": f"struct<{texts('id', 'label', 'start_date', 'end_date')}>",
    "values": f"struct<{texts('baseline', 'current')}>",
    "source": SOURCE,
    "confidence": f"struct<{texts('score', 'basis')}>",
    "method": "struct<notes:string,assumptions:array<string>,limitations:array<string>,uncertainty:string,quality_flags:array<string>>",
    "reviewer_notes": "string", "extensions": MAP,
    "indicator_governance": RAW_GOVERNANCE, "evidence_chain": RAW_CHAIN, "observation_lineage": RAW_LINEAGE, "review_workflow": RAW_WORKFLOW,
}
#: The four parts of a record that are derived where they are not authored, in the order in which they depend on each other.
DERIVED = {"indicator_governance": GOVERNED, "evidence_chain": CHAIN, "observation_lineage": LINEAGE_TYPE, "review_workflow": WORKFLOW_TYPE}
