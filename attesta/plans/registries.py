"""Registries, histories and statuses; diffs, drift, name search and stream deltas over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attesta.functions import derive
from attesta.operators import comparability, entities, evidence, refresh, validation
from attesta.operators import registries as ops
from attesta.operators.evidence import null, struct
from attesta.plans import governed, providers, registry_graph
from attesta.sources.shared import scratch, stored
from attesta.sources.tables import table
from attesta.streaming import ingest


def unit_registry(spark, d):
    """Units of parts, some with a dimension and factors that cannot be used."""
    k = F.col("p_partkey")
    unit = struct(
        id=null("string"), symbol=F.when(k % 2 == 0, F.concat(F.lit(" "), "p_brand")), name=null("string"), dimension=F.when(k % 3 == 0, "mass"), canonical_unit_id=F.when(k % 5 == 0, "unit:kg"),
        conversion_factor=F.when(F.col("p_size") % 4 == 0, "0").when(F.col("p_size") % 4 == 1, "ten").when(F.col("p_size") % 4 == 2, "2.5"), conversion_offset=F.when(F.col("p_size") % 7 == 0, "NaN"),
    )
    rows = table(spark, d, "part").select(F.concat_ws("/", "p_type", F.col("p_size").cast("string")).alias("symbol"), F.when(k % 9 != 0, unit).alias("unit"))
    return ops.unit_registry(rows).drop("canonical_unit_id", "conversion_factor", "name")


def _saves(spark, d):
    return table(spark, d, "orders").select(F.concat(F.lit("Query "), F.col("o_custkey").cast("string")).alias("name"), F.concat(F.lit('{"priority":"'), "o_orderpriority", F.lit('"}')).alias("definition"), F.col("o_orderstatus").alias("saved_by"), F.col("o_orderkey").alias("saved_at"))


def _runs(spark, d):
    key = F.concat(F.lit("query:"), F.substring(F.sha2(F.concat(F.lit("query "), F.col("user_id").cast("string")), 256), 1, 24))
    return table(spark, d, "events").select(F.col("event_id").alias("run_id"), key.alias("query_id"), F.col("event_type"))


def saved_queries(spark, d):
    return ops.saved_registry(ops.saved_versions(_saves(spark, d)), _runs(spark, d))


def query_runs(spark, d):
    exports = table(spark, d, "conversations").select(F.col("conv_id").alias("run_id"))
    return ops.run_summary(_runs(spark, d), ops.saved_versions(_saves(spark, d)), exports)


def replication_reviews(spark, d):
    """Reviews from turns of conversations: appended ones by status, refused ones by reason."""
    turn = F.col("turn")
    status = F.when(F.col("role") == "user", "confirmed").when(F.col("role") == "assistant", F.when(turn % 4 == 1, "partial").otherwise("maybe")).otherwise("pending")
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("run_id"), status.alias("status"), F.col("role").alias("reviewer"), F.col("text").alias("evidence"), F.when(turn % 3 == 0, F.col("conv_id") + turn).alias("reproduced_run_id"), turn.alias("reviewed_at"))
    runs = table(spark, d, "conversations").where("conv_id % 10 <> 9").select(F.col("conv_id").alias("run_id"))
    good, bad = ops.replication_reviews(rows, runs)
    count = lambda df, kind, by: df.groupBy(F.lit(kind).alias("outcome"), F.col(by).alias("status")).agg(F.count(F.lit(1)).alias("n"), F.min("run_id").alias("first_run"))
    return count(good, "appended", "status").unionByName(count(bad, "refused", "reason"))


def source_history(spark, d):
    """Yearly versions of suppliers as sources, newest first, with the snapshots (lines) of each."""
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.year("l_shipdate").alias("version"), "l_quantity")
    versions = lines.groupBy("source_id", "version").agg(F.max("l_quantity").alias("payload"))
    return ops.history(versions, "source_id", "version", lines.where("l_quantity > 25"))


def seeded_measurements(spark, d):
    """Orders as seed rows that name their customer, nation's region and segment, some of them unknown."""
    people = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    seeds = table(spark, d, "orders").join(people, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("c_name")).alias("entity_name"), F.when(F.col("o_orderkey") % 7 != 0, F.col("n_name")).otherwise("NOWHERE").alias("place_name"), F.year("o_orderdate").cast("string").alias("period_name"),
    )
    years = table(spark, d, "orders").select(F.year("o_orderdate").alias("period_id")).distinct().withColumn("period_name", F.col("period_id").cast("string"))
    dims = {
        "entity": table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("entity_name")),
        "place": table(spark, d, "nation").select(F.col("n_nationkey").alias("place_id"), F.col("n_name").alias("place_name")), "period": years,
    }
    return ops.seeded(seeds, dims)


#: Rollups of the provider tables, and measures with a condition.
ROLLUPS = {
    "statistics": ["world_bank_countries", "world_bank_indicators", "world_bank_observations", "un_sdg_geoareas", "un_sdg_goals", "un_sdg_indicators", "un_sdg_observations"],
    "us-data": ["census_observations", "bls_series", "bls_observations", "bea_observations", "eia_observations", "epa_records", "usgs_water"],
    "earth": ["ncei_observations", "erddap_observations", "erddap_datasets", "ioos_datasets"],
    "space": ["space_weather", "small_bodies", "close_approaches", "exoplanets"],
    "archive": ["archive_items", "archive_files", "wayback_captures"],
}


def status_rollups(spark, d):
    """How many rows the tables of every family of providers have; of small bodies also those near the earth."""
    found = None
    for name, tables in ROLLUPS.items():
        read = {t: (providers.QUERIES[f"provider_{t}"](spark, d), None) for t in tables}
        if name == "space":
            read |= {"near_earth": (read["small_bodies"][0], F.col("is_neo")), "hazardous": (read["small_bodies"][0], F.col("is_pha"))}
        part = ops.rollup(name, read)
        found = part if found is None else found.unionByName(part)
    return found


def entity_status(spark, d):
    """The entity registry of nations and suppliers: counts, and a digest of its rows in any order."""
    known = entities.register(table(spark, d, "nation"), "country", "n_name", "n_nationkey").unionByName(entities.register(table(spark, d, "supplier"), "organization", "s_name", "s_suppkey"))
    row = F.sha2(F.concat_ws("|", "entity_id", "kind", "name", "normal_name"), 256)
    sums = [F.sum(F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(2)]
    return known.agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("kind") == "country").alias("countries"), F.count_distinct("kind").alias("kinds"), F.count_distinct("normal_name").alias("names"), F.concat_ws(":", *sums).alias("digest"))


def entity_series(spark, d):
    """Series of three providers by place, from their normalised tables."""
    read = lambda name: providers.QUERIES[f"provider_{name}"](spark, d)
    return ops.entity_series(
        [
            ("world-bank", read("world_bank_observations"), F.col("country_code"), F.col("indicator_code"), F.col("period")),
            ("un-sdg", read("un_sdg_observations"), F.col("geo_area_code"), F.col("series_code"), F.col("period")),
            ("census", read("census_observations"), F.col("geography"), F.concat_ws(":", "dataset", "metric_code"), F.col("year")),
        ]
    )


def record_derivations(spark, d):
    """Canonical records whose derived parts were altered by order, and which of them no longer follow from the values."""
    r, k = governed._built(spark, d).where(F.size("issues") == 0), F.col("row_number")
    chain, lineage, flow = F.col("evidence_chain"), F.col("observation_lineage"), F.col("review_workflow")
    altered = r.withColumns(
        {
            "measurement": F.col("measurement").withField("percent_change", F.when(k % 5 == 1, F.lit(-987654.0)).otherwise(F.col("measurement.percent_change"))),
            "evidence_chain": chain.withField("completeness_score", F.when(k % 7 == 2, F.lit(101)).otherwise(chain["completeness_score"])).withField("gaps", F.when(k % 11 == 3, F.slice(chain["gaps"], 1, 0)).otherwise(chain["gaps"])),
            "observation_lineage": lineage.withField("transformations", F.when(k % 4 == 3, F.slice(lineage["transformations"], 1, 0)).otherwise(lineage["transformations"])),
            "review_workflow": flow.withField("quality", flow["quality"].withField("overall", F.when(k % 6 == 5, F.lit(1)).otherwise(flow["quality"]["overall"]))),
        }
    )
    found = altered.select("row_number", F.explode(validation.derived_errors()).alias("e")).where("NOT e.path LIKE 'review.%'")
    return found.groupBy("e.path", "e.message").agg(F.count(F.lit(1)).alias("n"), F.min("row_number").alias("first_row"))


def lineage_counts(spark, d):
    """Distinct parts of the lineage of every record of an order, and its missing and flagged observations."""
    lineage = F.col("observation_lineage")
    n = lambda part: F.size(F.array_distinct(F.transform(lineage[part], lambda x: x["id"])))
    state = lambda *kinds: F.size(F.filter(lineage["observations"], lambda o: o["quality_status"].isin(*kinds)))
    parts = {"questions": "question_count", "instruments": "instrument_version_count", "datasets": "dataset_version_count", "batches": "batch_count", "observations": "observation_count", "transformations": "transformation_count"}
    return governed._built(spark, d).select("row_number", *(n(p).alias(name) for p, name in parts.items()), state("missing").alias("missing_observation_count"), state("outlier", "rejected").alias("flagged_observation_count"))


def _nested(spark, d):
    """Orders as JSON objects of mixed depth."""
    k = F.col("o_orderkey")
    deep = F.struct(F.struct(F.struct(F.floor(F.col("o_totalprice") / 50000).cast("long").alias("c")).alias("b")).alias("a"), F.col("o_orderpriority").alias("p"))
    whole = F.struct(F.when(k % 4 != 0, deep).alias("deep"), F.when(k % 4 == 0, "flat").alias("kind"), F.array(F.col("o_orderstatus"), (k % 3).cast("string")).alias("list"))
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.to_json(whole).alias("payload"))


def nested_diffs(spark, d):
    """Paths in which each order's payload differs from the customer's one before."""
    before = F.lag("payload").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return _nested(spark, d).withColumn("before", before).select("o_orderkey", F.array_join(evidence.nested_diff(F.col("before"), F.col("payload")), ",").alias("paths"))


def schema_drift(spark, d):
    """Drift from the payloads of orders as they are to those of a later run, in which finished ones lost and changed nested fields."""
    old = _nested(spark, d)
    renamed = F.regexp_replace(F.regexp_replace("payload", '"c":([0-9]+)', '"c":$1.5'), '"p":', '"q":')
    new = old.withColumn("payload", F.when(F.col("o_orderstatus") == "F", renamed).otherwise(F.col("payload")))
    return refresh.schema_drift(old, new, "o_orderstatus", "payload")


def name_search(spark, d):
    """Names of customers searched for by parts of any length; whole names are left to the resolution by equality."""
    known = entities.register(table(spark, d, "customer"), "person", "c_name", "c_custkey")
    part = table(spark, d, "orders").select(F.concat(F.when(F.col("o_orderkey") % 3 == 0, "omer ").when(F.col("o_orderkey") % 3 == 1, "r ").otherwise(""), (F.col("o_custkey") % 500).cast("string")).alias("query")).distinct()
    asked = part.withColumn("q", derive.normal_name("query"))
    return entities.containing(asked, known).select("query", "n")


def stream_deltas(spark, d):
    """The last event of every user after three batches written as deltas, with a compaction in between."""
    path = scratch(spark, "deltas")
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type")
    for number in range(3):
        ingest.write_delta(rows.where(F.col("event_id") % 3 == number), path, number, "user_id", "event_id")
        if number == 1:
            ingest.compact(spark, path, "user_id", "event_id")
    return ingest.state_of(spark, path, "user_id", "event_id")[1]


def _governed(spark, d):
    """Parts with an indicator and its governance."""
    k, size, text = F.col("p_partkey"), F.col("p_size"), F.lit
    texts = lambda *items: F.array_compact(F.array(*items)).cast("array<string>")
    indicator = struct(id=F.col("p_type"), direction=F.when(size % 9 == 0, "lower").otherwise("higher"), version=F.when(size % 4 == 0, "2").otherwise("1"))
    governance = struct(
        unit=struct(id=F.col("p_brand"), dimension=F.when(size % 11 == 0, "time").otherwise("mass"), canonical_unit_id=F.when(size % 13 == 0, "s").otherwise("kg"), conversion_factor=(size % 7 + 1).cast("double"), conversion_offset=(size % 3).cast("double")),
        frequency=F.when(size % 5 == 0, "daily").otherwise("annual"), aggregation=F.when(size % 6 == 0, "mean").otherwise("sum"), methodology=struct(id=F.concat(text("m"), (size % 3).cast("string"))),
        compatibility=struct(comparable_versions=texts(text("1"), F.when(k % 2 == 0, "2")), methodology_equivalence=texts(text("m0"), F.when(k % 3 == 0, "m1")), required_dimensions=texts(F.when(size % 8 == 0, "sex"), F.when(k % 17 == 0, "age"))),
        disaggregation_dimensions=texts(text("sex"), F.when(k % 2 == 1, "age")),
    )
    return table(spark, d, "part").select("p_partkey", "p_type", F.col("p_retailprice").cast("double").alias("value"), indicator.alias("i"), governance.alias("g"))


def governed_comparisons(spark, d):
    """Every part with the next one of its type: comparability, reasons, and the converted value or why there is none."""
    after = lambda c: F.lead(c).over(Window.partitionBy("p_type").orderBy("p_partkey"))
    pairs = _governed(spark, d).withColumns({"other": after("p_partkey"), "i2": after("i"), "g2": after("g")}).where("other IS NOT NULL")
    status, reasons, can = comparability.comparability(F.col("i"), F.col("g"), F.col("i2"), F.col("g2"))
    moved = comparability.converted(F.col("value"), F.col("g.unit"), F.col("g2.unit"))
    return pairs.select("p_partkey", "other", status.alias("status"), F.array_join(reasons, "; ").alias("reasons"), can.alias("convertible"), moved.alias("moved")).select("*", "moved.value", "moved.error").drop("moved")


def run_health(spark, d):
    """States of runs, one for each customer's orders of a priority."""
    of = lambda s: F.count_if(F.col("o_orderstatus") == s)
    k = F.col("o_custkey")
    runs = table(spark, d, "orders").groupBy("o_orderpriority", "o_custkey").agg(of("F").alias("inserted"), of("O").alias("updated"), F.lit(0).alias("skipped"), of("P").alias("quarantined"), F.count(F.lit(1)).alias("expected"), F.count_if(F.col("o_totalprice") > 300000).alias("missing"), F.max("o_orderdate").alias("at"))
    runs = runs.withColumns(
        {
            "atomic": k % 4 == 0, "license": F.when(k % 5 != 0, "open"), "license_status": F.when(k % 11 == 0, "restricted"), "age_seconds": F.when(k % 3 != 0, F.datediff(F.lit("2001-12-31").cast("date"), F.to_date("at")) * 86400),
            "sla_seconds": F.when(k % 6 != 0, 400 * 86400), "fingerprint": F.when(k % 13 != 0, "f"), "last_fingerprint": F.when(k % 17 == 0, "g").when(k % 2 == 0, "f"),
        }
    )
    return refresh.run_states(runs).select("o_orderpriority", "o_custkey", "status", "license_state", "freshness", "drift", "health")


def public_records(spark, d):
    """Canonical records of orders, some approved and governed as public, as they may be shown."""
    k, w = F.col("row_number"), F.col("review_workflow")
    lineage = F.col("observation_lineage")
    access = F.when(k % 7 == 2, "internal").otherwise("public")
    rows = stored(governed._built(spark, d).where(F.size("issues") == 0), "records").withColumns(
        {
            "review_workflow": w.withField("state", F.when(k % 2 == 0, "approved").otherwise("draft")).withField("publication_gate", w["publication_gate"].withField("status", F.when(k % 3 == 0, "internal").otherwise("external"))).withField("assigned_reviewers", F.array(F.lit("ann"))),
            "observation_lineage": lineage.withField("datasets", F.transform(lineage["datasets"], lambda x: x.withField("access", access))),
        }
    )
    rules = rows.select("record_id", F.when(k % 5 == 1, "private").otherwise("public").alias("visibility"), F.when(k % 11 == 5, "internal").otherwise("public").alias("classification"))
    shown = comparability.public_records(rows, rules)
    return shown.select("row_number", "source.access_notes", F.size("observation_lineage.datasets").alias("n_datasets"), F.size("observation_lineage.batches").alias("n_batches"), F.size("observation_lineage.observations").alias("n_observations"), F.size("review_workflow.assigned_reviewers").alias("n_reviewers"))


QUERIES = {
    q.__name__: q
    for q in (unit_registry, saved_queries, query_runs, replication_reviews, source_history, seeded_measurements, status_rollups, entity_status, entity_series, record_derivations, lineage_counts, nested_diffs, schema_drift, name_search, stream_deltas, governed_comparisons, run_health, public_records)
}

_WORD = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
_SAVED = """s AS (SELECT 'Query ' || o_custkey AS name, sha256('{"priority":"' || o_orderpriority || '"}') AS sha, o_orderstatus AS by_, o_orderkey AS at_ FROM orders),
    v AS (SELECT *, 'query:' || substr(sha256(lower(name)), 1, 24) AS query_id, row_number() OVER (PARTITION BY name ORDER BY at_) AS version FROM (SELECT *, lag(sha) OVER (PARTITION BY name ORDER BY at_) AS was FROM s) WHERE sha IS DISTINCT FROM was),
    r AS (SELECT event_id AS run_id, 'query:' || substr(sha256('query ' || user_id), 1, 24) AS query_id, event_type FROM events)"""

SQL = {
    "unit_registry": f"""WITH u AS (SELECT p_partkey % 9 = 0 AS bare, p_type || '/' || p_size AS own, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 9 <> 0 THEN p_brand ELSE p_type || '/' || p_size END AS symbol, CASE WHEN p_partkey % 9 <> 0 AND p_partkey % 3 = 0 THEN 'mass' END AS dim,
          CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_size % 4 = 0 THEN 'unit.conversion_factor: must be greater than zero' WHEN p_size % 4 = 1 THEN 'unit.conversion_factor: must be a finite number' END AS i1,
          CASE WHEN p_partkey % 9 <> 0 AND p_size % 7 = 0 THEN 'unit.conversion_offset: must be a finite number' END AS i2, CASE WHEN p_partkey % 9 = 0 THEN 1.0 WHEN p_size % 4 = 2 THEN 2.5 ELSE 1.0 END AS factor, p_partkey % 5 = 0 AND p_partkey % 9 <> 0 AS canon FROM part),
        w AS (SELECT *, coalesce(dim, {_WORD.format('symbol')}) AS dimension FROM u), x AS (SELECT *, 'unit:' || substr(sha256('["' || dimension || '","' || lower(symbol) || '"]'), 1, 20) AS unit_id FROM w),
        y AS (SELECT *, count(*) OVER (PARTITION BY unit_id) AS n, row_number() OVER (PARTITION BY unit_id ORDER BY symbol, dimension, CASE WHEN canon THEN 'unit:kg' ELSE unit_id END, factor, i1 IS NOT NULL OR i2 IS NOT NULL, coalesce(i1, i2), i1 IS NOT NULL AND i2 IS NOT NULL) AS k FROM x)
        SELECT unit_id, symbol, dimension, 0.0::DOUBLE AS conversion_offset, concat_ws('; ', i1, i2) AS issues, n FROM y WHERE k = 1""",
    "saved_queries": f"""WITH {_SAVED}, c AS (SELECT query_id, count(*) AS run_count FROM r GROUP BY 1)
        SELECT query_id, arg_max(name, version) AS name, arg_max(sha, version) AS definition_sha256, arg_min(by_, version) AS created_by, min(at_) AS created_at, arg_max(at_, version) AS updated_at, max(version) AS version_count, coalesce(any_value(run_count), 0) AS run_count FROM v LEFT JOIN c USING (query_id) GROUP BY query_id""",
    "query_runs": f"""WITH {_SAVED}, e AS (SELECT conv_id AS run_id, count(*) AS export_count FROM conversations GROUP BY 1) SELECT run_id, r.query_id, event_type, query_name, coalesce(export_count, 0) AS export_count
        FROM r LEFT JOIN (SELECT query_id, any_value(name) AS query_name FROM v GROUP BY 1) q ON q.query_id = r.query_id LEFT JOIN e USING (run_id)""",
    "replication_reviews": """WITH t AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'confirmed' WHEN 'assistant' THEN CASE WHEN turn % 4 = 1 THEN 'partial' ELSE 'maybe' END ELSE 'pending' END AS status, CASE WHEN turn % 3 = 0 THEN conv_id + turn END AS again FROM conversations),
        k AS (SELECT DISTINCT conv_id AS run FROM conversations WHERE conv_id % 10 <> 9),
        x AS (SELECT *, CASE WHEN status = 'maybe' THEN 'invalid replication status' WHEN conv_id NOT IN (SELECT run FROM k) THEN 'run not found' WHEN again IS NOT NULL AND again NOT IN (SELECT run FROM k) THEN 'reproduced run not found' END AS reason FROM t)
        SELECT CASE WHEN reason IS NULL THEN 'appended' ELSE 'refused' END AS outcome, coalesce(reason, status) AS status, count(*) AS n, min(conv_id) AS first_run FROM x GROUP BY 1, 2""",
    "source_history": """SELECT l_suppkey AS source_id, year(l_shipdate) AS version, max(l_quantity) AS payload, row_number() OVER (PARTITION BY l_suppkey ORDER BY year(l_shipdate) DESC) - 1 AS versions_behind, count(*) FILTER (l_quantity > 25) AS snapshot_count FROM lineitem GROUP BY 1, 2""",
    "seeded_measurements": """SELECT o_orderkey, c_custkey AS entity_id, n_nationkey AS place_id, year(o_orderdate) AS period_id FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0""",
    "status_rollups": " UNION ALL ".join(
        [f"SELECT '{r}' AS rollup, '{t}' AS measure, count(*) AS value FROM ({providers.SQL[f'provider_{t}']})" for r, tables in ROLLUPS.items() for t in tables]
        + [f"SELECT 'space', '{m}', count(*) FILTER ({c}) FROM ({providers.SQL['provider_small_bodies']})" for m, c in (("near_earth", "is_neo"), ("hazardous", "is_pha"))]
    ),
    "entity_status": """WITH e AS (SELECT 'country' AS kind, n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT 'organization', s_suppkey, s_name FROM supplier),
        f AS (SELECT kind, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS x, sha256(kind || ':' || substr(sha256(k || '|' || name), 1, 32) || '|' || kind || '|' || name || '|' || trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'))) AS h FROM e)
        SELECT count(*) AS entities, count(*) FILTER (kind = 'country') AS countries, count(DISTINCT kind) AS kinds, count(DISTINCT x) AS names, sum(('0x' || substr(h, 1, 12))::HUGEINT)::VARCHAR || ':' || sum(('0x' || substr(h, 13, 12))::HUGEINT)::VARCHAR AS digest FROM f""",
    "entity_series": f"""SELECT 'world-bank' AS provider, country_code AS geo, indicator_code AS dataset_key, count(*) AS observation_count, min(period) AS temporal_start, max(period) AS temporal_end FROM ({providers.SQL['provider_world_bank_observations']}) GROUP BY 2, 3
        UNION ALL SELECT 'un-sdg', geo_area_code, series_code, count(*), min(period), max(period) FROM ({providers.SQL['provider_un_sdg_observations']}) GROUP BY 2, 3
        UNION ALL SELECT 'census', geography, dataset || ':' || metric_code, count(*), min(year), max(year) FROM ({providers.SQL['provider_census_observations']}) GROUP BY 2, 3""",
    "record_derivations": f"""WITH {governed._BUILT}, y AS (SELECT * FROM e WHERE unit IS NOT NULL), x AS (
          SELECT k, unnest(list_filter([CASE WHEN k % 5 = 1 THEN 'measurement.percent_change: is not the change of the values' END, CASE WHEN k % 7 = 2 THEN 'evidence_chain.completeness_score: is not that of the sources' END,
            CASE WHEN k % 11 = 3 AND len(gaps) > 0 THEN 'evidence_chain.gaps: omits a derived gap' END, CASE WHEN k % 4 = 3 THEN 'observation_lineage.completeness_score: is not that of its parts' END,
            CASE WHEN k % 6 = 5 THEN 'review_workflow.quality.overall: is not the mean of the dimensions' END], lambda m: m IS NOT NULL)) AS m FROM y)
        SELECT split_part(m, ': ', 1) AS path, split_part(m, ': ', 2) AS message, count(*) AS n, min(k) AS first_row FROM x GROUP BY 1, 2""",
    "lineage_counts": f"""WITH {governed._BUILT} SELECT k AS row_number, 1 AS question_count, 1 AS instrument_version_count, 1 AS dataset_version_count, 1 AS batch_count, CASE WHEN baseline IS NULL THEN 1 ELSE 2 END AS observation_count, 1 AS transformation_count,
        CASE WHEN cur IS NULL THEN 1 ELSE 0 END AS missing_observation_count, 0 AS flagged_observation_count FROM e""",
    "nested_diffs": """WITH f AS (SELECT o_custkey, o_orderkey, o_orderkey % 4 <> 0 AS deep, CAST(floor(o_totalprice / 50000) AS BIGINT) AS c, o_orderpriority AS p, o_orderstatus || o_orderkey % 3 AS l FROM orders),
        x AS (SELECT *, lag(deep) OVER w AS deep0, lag(c) OVER w AS c0, lag(p) OVER w AS p0, lag(l) OVER w AS l0, row_number() OVER w AS i FROM f WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
        SELECT o_orderkey, CASE WHEN i = 1 THEN '$record' ELSE concat_ws(',', CASE WHEN deep <> deep0 THEN 'deep' END, CASE WHEN deep AND deep0 AND c <> c0 THEN 'deep.a.b.c' END, CASE WHEN deep AND deep0 AND p <> p0 THEN 'deep.p' END,
          CASE WHEN deep <> deep0 THEN 'kind' END, CASE WHEN l <> l0 THEN 'list' END) END AS paths FROM x""",
    "schema_drift": """SELECT s AS o_orderstatus, path, was, now FROM (SELECT DISTINCT o_orderstatus AS s FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 4 <> 0), (VALUES ('deep.a.b.c', 'int', 'float'), ('deep.p', 'str', NULL), ('deep.q', NULL, 'str')) v(path, was, now)""",
    "name_search": """WITH q AS (SELECT DISTINCT CASE o_orderkey % 3 WHEN 0 THEN 'omer ' WHEN 1 THEN 'r ' ELSE '' END || o_custkey % 500 AS query FROM orders), n AS (SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS x FROM customer)
        SELECT query, count(DISTINCT c_custkey) AS n FROM q JOIN n ON contains(x, query) GROUP BY 1""",
    "stream_deltas": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1",
    "governed_comparisons": """WITH p AS (SELECT p_partkey AS k, p_type AS t, CAST(p_retailprice AS DOUBLE) AS v, p_size AS s, p_brand AS u, lead(p_partkey) OVER w AS k2, lead(p_size) OVER w AS s2, lead(p_brand) OVER w AS u2 FROM part WINDOW w AS (PARTITION BY p_type ORDER BY p_partkey)),
        x AS (SELECT *, CASE WHEN (s % 9 = 0) <> (s2 % 9 = 0) THEN 'indicator directions differ' WHEN (s % 11 = 0) <> (s2 % 11 = 0) OR (s % 13 = 0) <> (s2 % 13 = 0) THEN 'unit dimensions or canonical bases differ' END AS hard,
          list_filter([CASE WHEN (s % 5 = 0) <> (s2 % 5 = 0) THEN 'measurement frequencies differ' END, CASE WHEN (s % 6 = 0) <> (s2 % 6 = 0) THEN 'aggregation methods differ' END,
            CASE WHEN s % 3 <> s2 % 3 AND NOT (s % 3 <> 2 AND s2 % 3 <> 2 AND (k % 3 = 0 OR k2 % 3 = 0)) THEN 'methodologies are not declared equivalent' END,
            CASE WHEN (s2 % 4 = 0 AND k % 2 <> 0) OR (s % 4 = 0 AND k2 % 2 <> 0) THEN 'indicator versions are not mutually declared comparable' END,
            CASE WHEN (k % 17 = 0 OR k2 % 17 = 0) AND NOT (k % 2 = 1 AND k2 % 2 = 1) THEN 'required dimensions are not shared: age' END], lambda r: r IS NOT NULL) AS limits FROM p WHERE k2 IS NOT NULL),
        y AS (SELECT *, CASE WHEN hard IS NOT NULL THEN 'incompatible' WHEN len(limits) > 0 THEN 'limited' WHEN u <> u2 THEN 'convertible' ELSE 'equivalent' END AS status FROM x)
        SELECT k AS p_partkey, k2 AS other, status, CASE WHEN hard IS NOT NULL THEN hard WHEN u = u2 AND len(limits) = 0 THEN 'governance definitions are equivalent' ELSE array_to_string(list_concat(CASE WHEN u <> u2 THEN ['units differ but share a conversion basis'] ELSE [] END, limits), '; ') END AS reasons,
          status IN ('equivalent', 'convertible') AS convertible, CASE WHEN (s % 11 = 0) = (s2 % 11 = 0) AND (s % 13 = 0) = (s2 % 13 = 0) THEN round((v * (s % 7 + 1) + s % 3 - s2 % 3) / (s2 % 7 + 1), 12) END AS value,
          CASE WHEN (s % 11 = 0) <> (s2 % 11 = 0) THEN 'units have incompatible dimensions' WHEN (s % 13 = 0) <> (s2 % 13 = 0) THEN 'units do not share a canonical conversion basis' END AS error FROM y""",
    "run_health": """WITH r AS (SELECT o_orderpriority, o_custkey, count(*) FILTER (o_orderstatus = 'P') AS q, count(*) FILTER (o_orderstatus <> 'P') AS done, count(*) AS n, count(*) FILTER (o_totalprice > 300000) AS lost, date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2001-12-31') AS age FROM orders GROUP BY 1, 2),
        s AS (SELECT *, CASE WHEN o_custkey % 4 = 0 AND q > 0 THEN 'failed' WHEN q > 0 AND done > 0 THEN 'partial' WHEN q > 0 THEN 'quarantined' ELSE 'succeeded' END AS status, CASE WHEN o_custkey % 11 = 0 THEN 'restricted' WHEN o_custkey % 5 <> 0 THEN 'compliant' ELSE 'missing' END AS license_state,
          CASE WHEN o_custkey % 3 = 0 THEN 'unknown' WHEN o_custkey % 6 <> 0 AND age > 400 THEN 'stale' ELSE 'current' END AS freshness, CASE WHEN (o_custkey % 17 = 0 AND o_custkey % 13 <> 0) OR lost::DOUBLE / n > 0.25 THEN 'changed' WHEN o_custkey % 13 <> 0 THEN 'stable' ELSE 'unknown' END AS drift FROM r)
        SELECT o_orderpriority, o_custkey, status, license_state, freshness, drift, CASE WHEN status = 'succeeded' AND freshness <> 'stale' AND drift <> 'changed' AND license_state = 'compliant' THEN 'healthy' WHEN status IN ('failed', 'quarantined') THEN 'unhealthy' ELSE 'degraded' END AS health FROM s""",
    "public_records": f"""WITH {governed._BUILT}, v AS (SELECT record_id FROM e WHERE unit IS NOT NULL AND k % 5 <> 1 AND k % 11 <> 5)
        SELECT k AS row_number, CAST(NULL AS VARCHAR) AS access_notes, (k % 7 <> 2)::INT AS n_datasets, (k % 7 <> 2)::INT AS n_batches, CASE WHEN k % 7 = 2 THEN 0 WHEN baseline IS NULL THEN 1 ELSE 2 END AS n_observations, 0 AS n_reviewers
        FROM e WHERE unit IS NOT NULL AND k % 2 = 0 AND k % 3 <> 0 AND record_id IN (SELECT record_id FROM v)""",
}
