"""Evidence, quality, gates, validation and diffs over documents, labels, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import contracts, evidence, validation
from attesta.operators.evidence import null, struct
from attesta.sources.tables import table


def _chains(spark, d):
    """Documents as records: the crawled source is primary, a label of good quality supports it, one of toxicity conflicts."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    labels = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    text, n = F.lit, F.col("n")
    none = null("string")
    source = lambda **known: struct(**{f: known.get(f, none) for f in evidence.SOURCE_FIELDS})
    label = lambda name: source(name=name, license=text("open"), retrieved_at=text("2026-01-01"), citation=text("Labels."), checksum=text("sum"))
    first = source(
        name=F.col("source"), license=F.when(F.col("lang") == "en", "open"), retrieved_at=F.when(n % 2 == 0, "2026-01-01T00:00:00Z"), citation=F.when(n % 5 != 0, "Crawl."), checksum=F.when(F.col("quality") == 1, "sum"),
        access_notes=F.when(n % 11 == 0, "RESTRICTED use"),
    )
    link = lambda role, source: struct(role=role, source=source, locator=null(contracts.LOCATOR), supports=null("array<string>"), notes=none)
    good, bad = F.col("quality") == 1, F.col("toxic") == 1
    links = F.array_compact(
        F.array(
            F.when(good, link(text("supporting"), label(F.col("lang")))),
            F.when(good, link(none, label(F.col("lang")))),
            F.when(bad, link(text("conflicting"), label(text("labels")))),
            F.when(n % 3 == 0, link(text("supporting"), first)),
        )
    )
    rows = docs.join(labels, "doc_id", "left").withColumn("primary", evidence.normal_source(first).cast(contracts.SOURCE))
    raw = F.transform(links, lambda x: struct(**{f: x[f] for f in ("role", "source", "locator", "supports", "notes")}, **dict.fromkeys(evidence.SOURCE_FIELDS, none)))
    rows = rows.withColumn("chain", evidence.normal_links(raw, F.col("primary")))
    return rows.withColumns({"confidence": (n % 101).cast("double"), "method": F.when(n % 7 != 0, text("crawl"))})


_CHAINS = """c AS (
  SELECT doc_id, lang, source, n, n % 101 AS confidence, n % 7 <> 0 AS has_method, coalesce(quality = 1, false) AS q, coalesce(toxic = 1, false) AS t, 1 + coalesce(quality = 1, false)::INT + coalesce(toxic = 1, false)::INT AS links,
    n % 5 <> 0 AS cited, lang = 'en' AS licensed, n % 2 = 0 AS dated, coalesce(quality = 1, false) AS summed
  FROM (SELECT doc_id, lang, source, length(coalesce(text, '')) AS n FROM documents) LEFT JOIN labels USING (doc_id)),
s AS (SELECT *, 20 + 15 * cited::INT + 10 * coalesce(licensed, false)::INT + 10 * dated::INT + 10 * summed::INT + 15 * has_method::INT + 10 * (confidence >= 40)::INT + 5 * (links > 1)::INT + 5 * (NOT t)::INT AS score FROM c)"""


def evidence_summary(spark, d):
    """Links by role, open gaps, completeness, revisions and events of every document; turns of a conversation are its events."""
    rows = _chains(spark, d)
    of = lambda role: F.size(F.filter("chain", lambda x: x["role"] == role))
    found = evidence.gaps(F.col("chain"), F.col("method"), F.col("confidence"))
    events = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("role") == "assistant").alias("n_revisions"))
    return rows.join(events, "doc_id", "left").select(
        "doc_id", F.size("chain").alias("n_links"), of("primary").alias("n_primary"), of("supporting").alias("n_supporting"), of("conflicting").alias("n_conflicting"),
        F.array_join(F.transform(found, lambda g: F.concat_ws("/", g["code"], g["severity"])), ",").alias("gaps"), evidence.completeness(F.col("chain"), F.col("method"), F.col("confidence")).alias("completeness"),
        F.coalesce("n_revisions", F.lit(0)).alias("n_revisions"), F.coalesce("n_events", F.lit(0)).alias("n_events"),
    )


def evidence_roles(spark, d):
    """Links by role, from the chains of all records."""
    links = _chains(spark, d).select("lang", F.explode("chain").alias("x"))
    of = lambda role: F.count_if(F.col("x.role") == role)
    return links.groupBy("lang").agg(of("primary").alias("n_primary"), of("supporting").alias("n_supporting"), of("conflicting").alias("n_conflicting"))


#: The states of a review.
REVIEW_STATES = ("draft", "submitted", "in-review", "changes-requested", "approved", "rejected", "superseded", "archived")


def publication_gates(spark, d):
    """Gates of documents by the six dimensions of quality, a review state by length, and whether a critical gap is open."""
    n, text = F.col("n"), F.lit
    flags = F.array_compact(F.array(F.when(n % 10 == 0, "stale"), F.when(n % 7 == 1, "conflicting"), F.when(n % 4 == 2, "unverified")))
    observed = F.array(struct(quality_status=F.when(n % 9 == 0, "missing").when(n % 9 == 1, "outlier").otherwise("valid")), struct(quality_status=F.when(n % 13 == 0, "rejected").otherwise("valid")))
    score = evidence.completeness(F.col("chain"), F.col("method"), F.col("confidence"))
    rows = _chains(spark, d).withColumns({"score": score, "lineage": F.when(n % 3 == 0, 85).otherwise(100), "flags": flags, "observed": observed, "status": F.when(n % 5 != 0, "active").otherwise("draft")})
    limits = F.array_compact(F.array(F.when(n % 2 == 0, "sampled")))
    scores = evidence.quality_dimensions(F.col("score"), F.col("lineage"), F.col("flags"), F.col("observed"), F.col("status"), F.when(n % 3 != 0, text("crawl")), limits)
    states = F.array(*map(F.lit, REVIEW_STATES))
    graded = rows.withColumns(scores).withColumn("overall", evidence.quality_overall([F.col(s) for s in scores])).withColumn("state", F.get(states, (n % len(REVIEW_STATES)).cast("int")))
    critical = F.exists(evidence.gaps(F.col("chain"), F.col("method"), F.col("confidence")), lambda g: g["severity"] == "critical")
    gate, reasons = evidence.publication_gate(F.col("overall"), F.col("state"), critical)
    return graded.select("doc_id", *scores, "overall", gate.alias("gate"), reasons.alias("reasons"))


def payload_diffs(spark, d):
    """What changed from each order of a customer to the next."""
    from pyspark.sql import Window

    fields = F.create_map(F.lit("amount.total"), F.floor(F.col("o_totalprice") / 50000).cast("string"), F.lit("priority"), F.col("o_orderpriority"), F.lit("status"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", fields.alias("payload"))
    before = F.lag("payload").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return rows.withColumn("before", before).select("o_orderkey", F.array_join(evidence.payload_diff(F.col("before"), F.col("payload")), ",").alias("paths"))


def validation_report(spark, d):
    rules = {
        "confidence": F.col("o_totalprice").between(1000, 400000), "priority": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"), "id": F.col("o_orderkey").cast("string").rlike("^[0-9]*[02-9]$"),
        "period_order": F.col("o_orderdate") < "2001-01-01", "status": F.nullif(F.col("o_orderstatus"), F.lit("P")).isin("O", "F"),
    }
    broken = validation.errors([(name, holds, "does not hold") for name, holds in rules.items()])
    checked = table(spark, d, "orders").withColumn("errors", F.transform(broken, lambda e: e["path"]))
    return checked.select(F.explode_outer("errors").alias("error"), "o_orderkey").groupBy(F.coalesce("error", F.lit("valid")).alias("error")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_order"))


def distinct_mappings(spark, d):
    item = lambda a, b, c: F.struct(a.alias("framework"), b.alias("code"), c.alias("relationship"))
    parts = table(spark, d, "part").select("p_partkey", F.array(item(F.lit("SDG"), F.col("p_brand"), F.lit("exact")), item(F.lit("sdg"), F.upper("p_brand"), F.lit("Exact")), item(F.lit("GRI"), F.col("p_type"), F.lit("broad")), item(F.lit("GRI"), F.lower("p_type"), F.when(F.col("p_partkey") % 2 == 0, "BROAD").otherwise("narrow"))).alias("m"))
    kept = parts.withColumn("m", evidence.distinct_mappings(F.col("m")))
    return kept.select("p_partkey", F.array_join(F.transform("m", lambda x: F.concat_ws("/", x["framework"], x["code"], x["relationship"])), " ").alias("mappings"))


def public_projection(spark, d):
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "public").otherwise("restricted").alias("access")))).alias("datasets"),
        F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("dataset"), F.year("o_orderdate").alias("y")))).alias("observations"),
    )
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_acctbal") > 0, "external").otherwise("internal").alias("publication_status"), F.col("c_name").alias("access_notes"), F.array("c_name", "c_mktsegment").alias("reviewers"))
    shown = evidence.public_projection(orders.join(people, "o_custkey"))
    return shown.select("o_custkey", F.size("datasets").alias("n_datasets"), F.array_join(F.transform("observations", lambda o: o["dataset"].cast("string")), ",").alias("observed"), "access_notes", F.array_join("reviewers", "|").alias("reviewers"))


QUERIES = {
    "evidence_summary": evidence_summary, "evidence_roles": evidence_roles, "publication_gates": publication_gates, "payload_diffs": payload_diffs, "validation_report": validation_report,
    "distinct_mappings": distinct_mappings, "public_projection": public_projection,
}

SQL = {
    "evidence_summary": f"""WITH {_CHAINS}, v AS (SELECT conv_id AS doc_id, count(*) AS n_events, count(*) FILTER (role = 'assistant') AS n_revisions FROM conversations GROUP BY 1)
        SELECT doc_id, links AS n_links, 1 AS n_primary, q::INT AS n_supporting, t::INT AS n_conflicting, concat_ws(',', CASE WHEN NOT cited THEN 'missing-citation/warning' END, CASE WHEN licensed IS NOT TRUE THEN 'missing-license/warning' END,
          CASE WHEN NOT dated THEN 'missing-retrieval-date/warning' END, CASE WHEN NOT summed THEN 'missing-checksum/info' END, CASE WHEN NOT has_method THEN 'missing-method/warning' END, CASE WHEN confidence < 40 THEN 'low-confidence/warning' END,
          CASE WHEN t THEN 'conflicting-evidence/warning' END, CASE WHEN n % 11 = 0 THEN 'restricted-source/warning' END) AS gaps, score AS completeness, coalesce(n_revisions, 0) AS n_revisions, coalesce(n_events, 0) AS n_events FROM s LEFT JOIN v USING (doc_id)""",
    "evidence_roles": f"""WITH {_CHAINS} SELECT lang, count(*) AS n_primary, count(*) FILTER (q) AS n_supporting, count(*) FILTER (t) AS n_conflicting FROM c GROUP BY lang""",
    "publication_gates": f"""WITH {_CHAINS}, g AS (SELECT doc_id, n, list_extract(['{"', '".join(REVIEW_STATES)}'], CAST(n % 8 + 1 AS BIGINT)) AS s, CAST(round_even((score + CASE WHEN n % 3 = 0 THEN 85 ELSE 100 END) / 2.0, 0) AS INT) AS completeness,
          greatest(25, 100 - 12 * ((n % 10 = 0)::INT + (n % 7 = 1)::INT + (n % 4 = 2)::INT + (n % 9 = 1)::INT + (n % 13 = 0)::INT) - 5 * (n % 9 = 0)::INT) AS validity, greatest(25, 92 - 35 * (n % 7 = 1)::INT - 15 * (n % 5 = 0)::INT) AS consistency,
          CASE WHEN n % 10 = 0 THEN 45 ELSE 85 END AS timeliness, score AS provenance, CASE WHEN n % 3 <> 0 THEN 85 ELSE 55 END + 5 * (n % 2 = 0)::INT AS uncertainty FROM s),
        o AS (SELECT *, CAST(round_even((completeness + validity + consistency + timeliness + provenance + uncertainty) / 6.0, 0) AS INT) AS overall FROM g)
        SELECT doc_id, completeness, validity, consistency, timeliness, provenance, uncertainty, overall, CASE WHEN s = 'approved' AND overall >= 70 THEN 'external' WHEN s IN ('submitted', 'in-review', 'changes-requested', 'approved') AND overall >= 50 THEN 'internal' ELSE 'blocked' END AS gate,
        concat_ws('; ', CASE WHEN s <> 'approved' THEN 'record has not been approved' END, CASE WHEN overall < 70 THEN 'overall quality score is below 70' END) AS reasons FROM o""",
    "payload_diffs": """WITH f AS (SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice / 50000) AS BIGINT) AS a, o_orderpriority AS p, nullif(o_orderstatus, 'P') AS s FROM orders),
        l AS (SELECT *, lag(a) OVER w AS a0, lag(p) OVER w AS p0, lag(s) OVER w AS s0, row_number() OVER w AS i FROM f WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
        SELECT o_orderkey, CASE WHEN i = 1 THEN '$record' ELSE concat_ws(',', CASE WHEN a <> a0 THEN 'amount.total' END, CASE WHEN p <> p0 THEN 'priority' END, CASE WHEN s IS DISTINCT FROM s0 THEN 'status' END) END AS paths FROM l""",
    "validation_report": """WITH e AS (SELECT o_orderkey, list_filter([CASE WHEN NOT o_totalprice BETWEEN 1000 AND 400000 THEN 'confidence' END, CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') THEN 'priority' END,
          CASE WHEN o_orderkey % 10 = 1 THEN 'id' END, CASE WHEN o_orderdate >= '2001-01-01' THEN 'period_order' END, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'status' END], lambda x: x IS NOT NULL) AS errors FROM orders)
        SELECT error, count(*) AS n, min(o_orderkey) AS first_order FROM (SELECT o_orderkey, unnest(CASE WHEN len(errors) = 0 THEN ['valid'] ELSE errors END) AS error FROM e) GROUP BY 1""",
    "distinct_mappings": """SELECT p_partkey, concat_ws(' ', 'SDG/' || p_brand || '/exact', 'GRI/' || p_type || '/broad', CASE WHEN p_partkey % 2 <> 0 THEN 'GRI/' || lower(p_type) || '/narrow' END) AS mappings FROM part""",
    "public_projection": """SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS n_datasets, coalesce(string_agg(CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey AS VARCHAR) END, ',' ORDER BY o_orderkey), '') AS observed,
        CAST(NULL AS VARCHAR) AS access_notes, '|' AS reviewers FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY 1""",
}
