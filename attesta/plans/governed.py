"""Canonical records, their validation and their evidence over orders and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import contracts, records, validation
from attesta.operators.evidence import null, struct
from attesta.sources.tables import table

NOW = "2026-01-01T00:00:00Z"


def authored_orders(spark, d):
    """One authored record an order: the order's value for its customer in a year, by a ledger that often lacks something."""
    o, c = F.col, table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    rows = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    k = o("o_orderkey")
    every = lambda n, value, at=0: F.when(k % n == at, value)
    but = lambda n, value: F.when(k % n != 0, value)
    text = F.lit
    year = F.date_format("o_orderdate", "yyyy")
    source = struct(
        id=null("string"), name=but(7, F.concat(text("Ledger "), o("o_orderpriority"))), type=every(3, text("survey")), url=F.concat(text("https://ledger.example/"), k.cast("string")), publisher=but(2, o("c_mktsegment")),
        license=but(3, text("open")), retrieved_at=but(4, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")), citation=but(5, text("Ledger of orders.")), checksum=but(2, F.concat(text("sha256:"), F.sha2(k.cast("string"), 256))),
        access_notes=every(11, text("Restricted to staff")),
    )
    other = struct(**{n: null("string") for n in ("id",)}, name=o("c_name"), type=text("internal record"), url=null("string"), publisher=null("string"), license=text("open"), retrieved_at=null("string"), citation=text("Customer file."), checksum=null("string"), access_notes=null("string"))
    link = lambda role: struct(role=text(role), source=other, locator=null(contracts.LOCATOR), supports=null("array<string>"), notes=null("string"))
    links = F.array_compact(F.array(every(3, link("supporting"), 1), every(3, link("supporting"), 1), every(13, link("conflicting"))))
    return rows.select(
        k.alias("row_number"),
        struct(name=o("c_name"), type=every(5, text("organization"))).alias("entity"),
        struct(name=F.concat(text("Order value "), o("o_orderstatus")), unit=F.when(o("o_orderstatus") == "F", "USD").when(o("o_orderstatus") == "O", " k EUR "), direction=F.when(o("o_orderpriority") == "1-URGENT", "higher").when(o("o_orderpriority") == "2-HIGH", "lower"), framework=F.when(o("o_orderstatus") == "F", "SDG")).alias("indicator"),
        struct(label=year, start_date=every(3, F.concat(year, text("-01-01"))), end_date=every(2, F.concat(year, text("-12-31")))).alias("period"),
        struct(baseline=but(4, F.floor(o("o_totalprice") * 0.8).cast("string")), current=F.floor("o_totalprice").cast("string")).alias("values"),
        source.alias("source"), struct(score=(k % 103).cast("string")).alias("confidence"),
        struct(notes=but(6, text("Booked amounts.")), uncertainty=every(2, text("Late bookings.")), limitations=F.array_compact(F.array(every(3, text("No refunds.")))), quality_flags=F.array_compact(F.array(every(8, text("stale")), every(9, text("conflicting"))))).alias("method"),
        struct(sources=links).alias("evidence_chain"),
    )


def _built(spark, d):
    return records.canonical(records.authored(authored_orders(spark, d), ["row_number"]), NOW, keep=["row_number"])


def canonical_records(spark, d):
    """Ids, judgments and scores of the canonical record of every order."""
    r, q = _built(spark, d), "review_workflow.quality"
    first = lambda part: F.get(f"observation_lineage.{part}", 0)["id"]
    joined = lambda part, field: F.array_join(F.transform(part, lambda x: x[field]), " ")
    return r.select(
        "row_number", "record_id", F.col("entity.id").alias("entity_id"), F.col("indicator.id").alias("indicator_id"), F.col("period.id").alias("period_id"), F.col("source.id").alias("source_id"),
        F.col("measurement.percent_change").alias("percent_change"), F.col("review.status").alias("status"), F.col("review.signal_status").alias("signal"),
        F.col("indicator_governance.unit.id").alias("unit_id"), F.col("indicator_governance.unit.dimension").alias("dimension"), F.col("indicator_governance.methodology.id").alias("method_id"), F.size("indicator_governance.framework_mappings").alias("n_mappings"),
        joined("evidence_chain.sources", "role").alias("roles"), joined("evidence_chain.gaps", "code").alias("gaps"), joined("evidence_chain.gaps", "severity").alias("severities"), F.col("evidence_chain.completeness_score").alias("evidence_score"),
        first("questions").alias("question_id"), first("instruments").alias("instrument_id"), F.get("observation_lineage.instruments", 0)["type"].alias("instrument_type"), first("datasets").alias("dataset_id"), first("batches").alias("batch_id"),
        F.get("observation_lineage.batches", 0)["record_count"].alias("n_in_batch"), joined("observation_lineage.observations", "id").alias("observation_ids"), joined("observation_lineage.observations", "observed_at").alias("observed"),
        first("transformations").alias("transformation_id"), F.col("observation_lineage.completeness_score").alias("lineage_score"),
        F.concat_ws(" ", *(F.col(f"{q}.{n}").cast("string") for n in contracts.QUALITY_DIMENSIONS)).alias("quality"), F.col(f"{q}.overall").alias("overall"), F.col("review_workflow.publication_gate.status").alias("gate"),
    )


def record_errors(spark, d):
    """How many records of orders break a rule, by path and message; and how many break none."""
    checked = validation.validated(_built(spark, d))
    found = checked.select("row_number", F.explode_outer("errors").alias("e"))
    return found.groupBy(F.coalesce("e.path", F.lit("")).alias("path"), F.coalesce("e.message", F.lit("valid")).alias("message")).agg(F.count(F.lit(1)).alias("n"), F.min("row_number").alias("first_row"))


def lineage_references(spark, d):
    """Broken references in the lineage of records whose batches and steps were altered by order."""
    r = _built(spark, d).where(F.size("issues") == 0)
    k, lineage = F.col("row_number"), F.col("observation_lineage")
    lost = F.transform(lineage["observations"], lambda o: o.withField("batch_id", F.when(k % 10 == 3, F.lit("batch:lost:1")).otherwise(o["batch_id"])))
    steps = F.transform(lineage["transformations"], lambda t: t.withField("input_observation_ids", F.when(k % 15 == 4, F.array(F.lit("observation:lost:1"))).otherwise(t["input_observation_ids"])))
    batches = F.transform(lineage["batches"], lambda b: b.withField("dataset_id", F.when(k % 6 == 5, F.lit("dataset:lost:1")).otherwise(b["dataset_id"])))
    twice = F.when(k % 21 == 1, F.concat(lineage["questions"], lineage["questions"])).otherwise(lineage["questions"])
    altered = r.withColumn("observation_lineage", lineage.withField("observations", lost).withField("transformations", steps).withField("batches", batches).withField("questions", twice))
    found = altered.select("row_number", F.explode(validation.reference_errors()).alias("e"))
    return found.groupBy("e.path", "e.message").agg(F.count(F.lit(1)).alias("n"), F.min("row_number").alias("first_row"))


def _list(*parts):
    return "'[' || " + " || ',' || ".join(f"""'"' || lower(trim(coalesce({p}, ''))) || '"'""" for p in parts) + " || ']'"


def _slug(part):
    return f"substr(regexp_replace(regexp_replace(lower({part}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 64)"


def _stable(kind, anchor, *parts):
    return f"'{kind}:' || {_slug(anchor)} || ':' || substr(sha256({_list(*parts)}), 1, 12)"


def _digest(kind, *parts):
    return f"'{kind}:' || substr(sha256({_list(*parts)}), 1, 20)"


def _line(kind, anchor, *parts):
    return f"'{kind}:' || {_slug(anchor)} || ':' || substr(sha256(lower(concat_ws('|', {', '.join(f'coalesce({p}, {chr(39) * 2})' for p in parts)}))), 1, 16)"


_WORD = _slug("unit").replace("'-'", "'_'").replace("'^-+|-+$'", "'^_+|_+$'")

_BUILT = f"""
a AS (
  SELECT o_orderkey AS k, c_name AS name, CASE WHEN o_orderkey % 5 = 0 THEN 'organization' ELSE 'other' END AS etype, 'Order value ' || o_orderstatus AS indicator,
    CASE o_orderstatus WHEN 'F' THEN 'USD' WHEN 'O' THEN 'k EUR' END AS unit, CASE o_orderpriority WHEN '1-URGENT' THEN 'higher' WHEN '2-HIGH' THEN 'lower' ELSE 'neutral' END AS direction,
    CASE WHEN o_orderstatus = 'F' THEN 'SDG' END AS framework, strftime(o_orderdate, '%Y') AS label, o_orderkey % 3 = 0 AS starts, o_orderkey % 2 = 0 AS ends,
    CASE WHEN o_orderkey % 4 <> 0 THEN floor(o_totalprice * 0.8) END AS baseline, floor(o_totalprice) AS cur,
    CASE WHEN o_orderkey % 7 <> 0 THEN 'Ledger ' || o_orderpriority ELSE 'Unspecified source' END AS source, CASE WHEN o_orderkey % 3 = 0 THEN 'survey' ELSE 'unspecified' END AS stype,
    'https://ledger.example/' || o_orderkey AS url, CASE WHEN o_orderkey % 2 <> 0 THEN c_mktsegment END AS publisher, o_orderkey % 103 AS score, o_orderkey % 6 <> 0 AS noted,
    o_orderkey % 3 = 1 AS supported, o_orderkey % 13 = 0 AS conflict, o_orderkey % 8 = 0 AS stale, o_orderkey % 9 = 0 AS conflicting
  FROM orders JOIN customer ON o_custkey = c_custkey),
b AS (
  SELECT *, {_stable("entity", "etype", "etype", "name")} AS entity_id, CASE WHEN unit IS NULL THEN {_stable("indicator", "indicator", "indicator", "''", "direction")} ELSE {_stable("indicator", "indicator", "indicator", "unit", "direction")} END AS indicator_id,
    {_stable("period", "label", "label")} AS period_id, {_stable("source", "source", "source", "publisher", "url")} AS source_id, round((cur - baseline) / abs(baseline) * 100, 2) AS change,
    {_digest("unit", f"coalesce({_WORD}, 'unspecified')", "unit")} AS unit_id, {_WORD} AS dimension
  FROM a),
c AS (
  SELECT *, {_stable("measurement", "entity_id", "entity_id", "indicator_id", "period_id", "source_id")} AS record_id, {_digest("method", "indicator_id", "indicator || ' methodology'")} AS method_id,
    1 + supported::INT + conflict::INT AS links FROM b),
d AS (
  SELECT *, concat_ws(' ', 'primary', CASE WHEN supported THEN 'supporting' END, CASE WHEN conflict THEN 'conflicting' END) AS roles,
    list_filter([CASE WHEN k % 5 = 0 THEN 'missing-citation/warning' END, CASE WHEN k % 3 = 0 THEN 'missing-license/warning' END, CASE WHEN k % 4 = 0 OR links > 1 THEN 'missing-retrieval-date/warning' END,
      CASE WHEN k % 2 = 0 OR links > 1 THEN 'missing-checksum/info' END, CASE WHEN NOT noted THEN 'missing-method/warning' END, CASE WHEN score < 40 THEN 'low-confidence/warning' END, CASE WHEN conflict THEN 'conflicting-evidence/warning' END,
      CASE WHEN k % 11 = 0 THEN 'restricted-source/warning' END], lambda g: g IS NOT NULL) AS gaps,
    20 + 15 * (k % 5 <> 0)::INT + 10 * (k % 3 <> 0)::INT + 10 * (k % 4 <> 0 AND links = 1)::INT + 10 * (k % 2 <> 0 AND links = 1)::INT + 15 * noted::INT + 10 * (score >= 40)::INT + 5 * (links > 1)::INT + 5 * (NOT conflict)::INT AS evidence_score,
    CASE WHEN starts THEN label || '-01-01T00:00:00Z' ELSE '{NOW}' END AS started, CASE WHEN ends THEN label || '-12-31T00:00:00Z' ELSE '{NOW}' END AS ended,
    {_line("batch", "record_id", "record_id", f"'{NOW}'")} AS batch_id, {_line("observation", "record_id", "record_id", "'baseline'")} AS was, {_line("observation", "record_id", "record_id", "'current'")} AS is_
  FROM c),
e AS (
  SELECT *, CAST(round_even((evidence_score + 100) / 2.0, 0) AS INT) AS q1, greatest(25, 100 - 12 * (stale::INT + conflicting::INT)) AS q2, greatest(25, 92 - 35 * conflicting::INT) AS q3, CASE WHEN stale THEN 45 ELSE 85 END AS q4, evidence_score AS q5,
    CASE WHEN k % 2 = 0 THEN 85 ELSE 55 END + 5 * (k % 3 = 0)::INT AS q6 FROM d)
"""

_STATUS = "CASE WHEN source = 'Unspecified source' THEN 'missing source' WHEN score < 40 THEN 'needs evidence' WHEN score < 70 THEN 'reviewable with caution' ELSE 'reviewable' END"
_SIGNAL = "CASE WHEN change IS NULL THEN 'indeterminate' WHEN change = 0 THEN 'unchanged' WHEN direction = 'neutral' THEN 'descriptive' WHEN (direction = 'higher') = (change > 0) THEN 'improving' ELSE 'declining' END"

QUERIES = {"canonical_records": canonical_records, "record_errors": record_errors, "lineage_references": lineage_references}

SQL = {
    "canonical_records": f"""WITH {_BUILT}
        SELECT k AS row_number, record_id, entity_id, indicator_id, period_id, source_id, change AS percent_change, {_STATUS} AS status, {_SIGNAL} AS signal, unit_id, coalesce(dimension, 'unspecified') AS dimension, method_id, (framework IS NOT NULL)::INT AS n_mappings, roles,
          array_to_string(list_transform(gaps, lambda g: split_part(g, '/', 1)), ' ') AS gaps, array_to_string(list_transform(gaps, lambda g: split_part(g, '/', 2)), ' ') AS severities, evidence_score,
          {_line("question", "entity_id", "entity_id", "indicator_id")} AS question_id, {_line("instrument", "source_id", "source_id", "stype")} AS instrument_id, CASE stype WHEN 'survey' THEN 'survey' ELSE 'other' END AS instrument_type,
          {_line("dataset", "source_id", "source_id", "indicator_id")} AS dataset_id, batch_id, CASE WHEN baseline IS NULL THEN 1 ELSE 2 END AS n_in_batch, concat_ws(' ', CASE WHEN baseline IS NOT NULL THEN was END, is_) AS observation_ids,
          concat_ws(' ', CASE WHEN baseline IS NOT NULL THEN started END, ended) AS observed, {_line("transformation", "record_id", "record_id", "method_id", "'1.0'")} AS transformation_id, 100 AS lineage_score,
          concat_ws(' ', q1, q2, q3, q4, q5, q6) AS quality, CAST(round_even((q1 + q2 + q3 + q4 + q5 + q6) / 6.0, 0) AS INT) AS overall, 'blocked' AS gate FROM e""",
    "record_errors": f"""WITH {_BUILT}, x AS (
          SELECT k, unnest(list_concat(list_filter([CASE WHEN unit IS NULL THEN 'indicator.unit: is required' END, CASE WHEN unit IS NULL THEN 'indicator_governance.unit.symbol: must match indicator.unit' END,
            CASE WHEN score > 100 THEN 'confidence.score: must be a finite number between 0 and 100' END], lambda m: m IS NOT NULL), CASE WHEN unit IS NOT NULL AND score <= 100 THEN [': valid'] ELSE [] END)) AS m FROM e)
        SELECT split_part(m, ': ', 1) AS path, split_part(m, ': ', 2) AS message, count(*) AS n, min(k) AS first_row FROM x GROUP BY 1, 2""",
    "lineage_references": f"""WITH {_BUILT}, y AS (SELECT k, baseline IS NOT NULL AS two FROM e WHERE unit IS NOT NULL), x AS (
          SELECT k, unnest(list_filter([CASE WHEN k % 21 = 1 THEN 'questions: must have unique ids' END, CASE WHEN k % 6 = 5 THEN 'batches.0.dataset_id: is no dataset of the record' END, CASE WHEN k % 10 = 3 THEN 'observations.0.batch_id: is no batch of the record' END,
            CASE WHEN k % 10 = 3 AND two THEN 'observations.1.batch_id: is no batch of the record' END, CASE WHEN k % 15 = 4 THEN 'transformations.0.input_observation_ids: has unknown observations' END], lambda m: m IS NOT NULL)) AS m FROM y)
        SELECT 'observation_lineage.' || split_part(m, ': ', 1) AS path, split_part(m, ': ', 2) AS message, count(*) AS n, min(k) AS first_row FROM x GROUP BY 1, 2""",
}
