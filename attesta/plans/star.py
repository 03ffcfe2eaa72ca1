"""Measurement records derived from orders: nation x market segment x year, and queries over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.functions import derive
from attesta.operators import review, studio
from attesta.sources.tables import table


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Revenue of a nation's segment in a year against the year before; odd years are in thousands."""
    orders = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"), "o_orderstatus")
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    sums = orders.join(customers, orders.o_custkey == customers.c_custkey).groupBy("c_nationkey", "c_mktsegment", "y").agg(F.sum("price").cast("double").alias("usd"), F.round(F.count_if(F.col("o_orderstatus") == "F") * 100 / F.count(F.lit(1))).alias("confidence"))
    before = F.lag("usd").over(Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("y"))
    factor = F.when(F.col("y") % 2 == 0, 1.0).otherwise(1000.0)
    return sums.withColumn("prior", before).select(
        F.concat_ws(":", F.lit("rec"), "c_nationkey", "c_mktsegment", "y").alias("record_id"),
        F.col("c_nationkey").alias("entity_id"), F.col("c_mktsegment").alias("indicator_id"), F.col("y").alias("period_id"),
        F.when((F.col("c_nationkey") + F.col("y")) % 7 != 0, F.col("c_nationkey") % 5).alias("source_id"),
        F.round(F.col("usd") / factor, 6).alias("value"), F.round(F.col("prior") / factor, 6).alias("baseline"), "confidence", factor.alias("factor"),
    )


FACTS = """
sums AS (
  SELECT c_nationkey, c_mktsegment, year(o_orderdate) AS y, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS usd,
         round(count(*) FILTER (o_orderstatus = 'F') * 100.0::DOUBLE / count(*)) AS confidence
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
facts AS (
  SELECT 'rec:' || c_nationkey || ':' || c_mktsegment || ':' || y AS record_id, c_nationkey AS entity_id, c_mktsegment AS indicator_id, y AS period_id,
         CASE WHEN (c_nationkey + y) % 7 <> 0 THEN c_nationkey % 5 END AS source_id,
         round(usd / factor, 6) AS value, round(prior / factor, 6) AS baseline, confidence, factor
  FROM (SELECT *, CASE WHEN y % 2 = 0 THEN 1.0::DOUBLE ELSE 1000.0::DOUBLE END AS factor,
               lag(usd) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY y) AS prior FROM sums))
"""


def _direction(segment):
    return F.when(segment == "BUILDING", "higher").when(segment == "MACHINERY", "lower").otherwise("neutral")


_DIRECTION = "CASE indicator_id WHEN 'BUILDING' THEN 'higher' WHEN 'MACHINERY' THEN 'lower' ELSE 'neutral' END"


def measurement_review(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("entity_id"), F.col("n_name").alias("entity_name"))
    known = facts(spark, d)
    indicators = table(spark, d, "customer").select(F.col("c_mktsegment").alias("indicator_id")).distinct().withColumn("direction", _direction(F.col("indicator_id")))
    periods = table(spark, d, "orders").select(F.year("o_orderdate").alias("period_id")).distinct()
    sources = table(spark, d, "region").select(F.col("r_regionkey").alias("source_id"), F.col("r_name").alias("source_name"))
    return review.measurement_review(known, nations, indicators, periods, sources).select("record_id", "entity_name", "value", "baseline", "confidence", "source_name", "percent_change", "review_status", "signal")


_REVIEW = f"""
reviewed AS (
  SELECT record_id, n_name AS entity_name, value, baseline, confidence, r_name AS source_name,
         CASE WHEN baseline <> 0 THEN round((value - baseline) / abs(baseline) * 100, 2) END AS percent_change,
         CASE WHEN source_id IS NULL THEN 'missing source' WHEN confidence < 40 THEN 'needs evidence'
              WHEN confidence < 70 THEN 'reviewable with caution' ELSE 'reviewable' END AS review_status,
         CASE WHEN baseline IS NULL OR baseline = 0 THEN 'indeterminate' WHEN value = baseline THEN 'unchanged'
              WHEN {_DIRECTION} = 'neutral' THEN 'descriptive'
              WHEN ({_DIRECTION} = 'higher' AND value > baseline) OR ({_DIRECTION} = 'lower' AND value < baseline) THEN 'improving' ELSE 'declining' END AS signal
  FROM facts JOIN nation ON entity_id = n_nationkey LEFT JOIN region ON source_id = r_regionkey)
"""


def records(spark: SparkSession, d: str) -> DataFrame:
    """The star as flat records with governance and quality columns."""
    f = facts(spark, d)
    nations = table(spark, d, "nation").select("n_nationkey", "n_name")
    full = f.join(nations, f.entity_id == nations.n_nationkey).select(
        "record_id", F.col("n_nationkey").cast("string").alias("entity_id"), F.col("n_name").alias("entity_name"), "indicator_id",
        F.concat(F.lit("Revenue "), F.lower("indicator_id")).alias("indicator_name"), F.col("period_id").cast("string").alias("period_label"),
        F.when(F.col("period_id") % 5 != 0, F.concat(F.col("period_id"), F.lit("-01-01"))).alias("start_date"),
        F.when(F.col("period_id") % 4 != 0, F.concat(F.col("period_id"), F.lit("-12-31"))).alias("end_date"),
        F.col("value").alias("current"), "baseline", "confidence", "factor",
        F.when(F.col("period_id") % 2 == 0, "USD").otherwise("kUSD").alias("unit"), F.lit("currency").alias("dimension"), _direction(F.col("indicator_id")).alias("direction"),
        F.when((F.col("indicator_id") == "HOUSEHOLD") & (F.col("period_id") % 3 == 0), "fiscal").otherwise("annual").alias("frequency"), F.lit("sum").alias("methodology"),
        F.when(F.col("source_id").isNotNull(), F.concat(F.lit("Source "), F.col("source_id"))).alias("source_name"),
        F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("even"), F.lower("indicator_id"))).otherwise(F.array(F.lower("indicator_id"))).alias("tags"),
        F.when(F.col("confidence") < 45, "blocked").otherwise("internal").alias("publication_status"),
        (F.col("confidence") + F.col("n_nationkey")).alias("quality"), F.col("period_id").alias("updated_at"), F.lit("core").alias("framework"), F.lit(None).cast("string").alias("notes"),
    )
    return studio.with_derivations(full)


RECORDS = (
    FACTS
    + f""", records AS (
  SELECT *, CASE WHEN source_name IS NULL THEN 'missing source' WHEN confidence < 40 THEN 'needs evidence' WHEN confidence < 70 THEN 'reviewable with caution' ELSE 'reviewable' END AS evidence_status,
         CASE WHEN percent_change IS NULL THEN 'indeterminate' WHEN percent_change = 0 THEN 'unchanged' WHEN direction = 'neutral' THEN 'descriptive'
              WHEN (direction = 'higher') = (percent_change > 0) THEN 'improving' ELSE 'declining' END AS signal
  FROM (SELECT record_id, CAST(n_nationkey AS VARCHAR) AS entity_id, n_name AS entity_name, indicator_id, 'Revenue ' || lower(indicator_id) AS indicator_name,
         CAST(period_id AS VARCHAR) AS period_label, CASE WHEN period_id % 5 <> 0 THEN period_id || '-01-01' END AS start_date,
         CASE WHEN period_id % 4 <> 0 THEN period_id || '-12-31' END AS end_date, value AS current, baseline, confidence, factor,
         CASE WHEN period_id % 2 = 0 THEN 'USD' ELSE 'kUSD' END AS unit, {_DIRECTION} AS direction,
         CASE WHEN indicator_id = 'HOUSEHOLD' AND period_id % 3 = 0 THEN 'fiscal' ELSE 'annual' END AS frequency,
         CASE WHEN source_id IS NOT NULL THEN 'Source ' || source_id END AS source_name,
         n_nationkey % 2 = 0 AS even, CASE WHEN confidence < 45 THEN 'blocked' ELSE 'internal' END AS publication_status,
         confidence + n_nationkey AS quality, period_id AS updated_at,
         CASE WHEN baseline <> 0 THEN round((value - baseline) / abs(baseline) * 100, 2) END AS percent_change
  FROM facts JOIN nation ON entity_id = n_nationkey))"""
)

_PERIOD = {"confidence_min": 30, "quality_min": 40, "period_from": "1996-01-01", "period_to": "2000-12-31", "tags": ["even"]}
_SORT = [{"field": "source_name", "direction": "desc"}, {"field": "current"}]

#: The query of ``studio_query``; every record's indicator name has the searched word.
STUDIO_QUERY = {"filters": {**_PERIOD, "search": "revenue"}, "sort": _SORT, "limit": 200}

#: A narrower one, which is frozen as a run.
STUDIO = {"filters": {**_PERIOD, "search": "nation_1", "publication_status": ["internal", "external"]}, "sort": _SORT, "limit": 200}

#: The same filters and order for the comparison.
STUDIO_QUERY_WHERE = "confidence >= 30 AND quality >= 40 AND coalesce(start_date, '') >= '1996-01-01' AND coalesce(end_date, '9999-12-31') <= '2000-12-31' AND even"
STUDIO_WHERE = f"{STUDIO_QUERY_WHERE} AND entity_name LIKE '%NATION_1%' AND publication_status IN ('internal', 'external')"
STUDIO_ORDER = "lower(source_name) DESC NULLS FIRST, current ASC NULLS LAST, updated_at DESC, record_id"

_PAIRS = (
    RECORDS
    + """, led AS (
  SELECT entity_id, indicator_id, record_id, current, unit, factor, frequency, direction, lead(record_id) OVER w AS r2, lead(current) OVER w AS c2,
         lead(unit) OVER w AS u2, lead(factor) OVER w AS f2, lead(frequency) OVER w AS q2 FROM records
  WINDOW w AS (PARTITION BY entity_id, indicator_id ORDER BY coalesce(start_date, ''), period_label, record_id)),
conv AS (
  SELECT *, CASE WHEN frequency <> q2 THEN 'limited' WHEN unit <> u2 THEN 'convertible' ELSE 'equivalent' END AS comparability,
         concat_ws(',', CASE WHEN unit <> u2 THEN 'unit' END, CASE WHEN frequency <> q2 THEN 'frequency' END) AS reasons FROM led WHERE r2 IS NOT NULL),
pairs AS (
  SELECT entity_id, indicator_id, record_id AS from_record, r2 AS to_record, v AS to_value, round(v - current, 12) AS absolute_change,
         CASE WHEN current <> 0 THEN round((v - current) / abs(current) * 100, 4) END AS percent_change, comparability, reasons
  FROM (SELECT *, CASE WHEN comparability = 'convertible' THEN round(c2 * f2 / factor, 12) ELSE c2 END AS v FROM conv))"""
)


def studio_query(spark: SparkSession, d: str) -> DataFrame:
    return studio.run_query(records(spark, d), STUDIO_QUERY).select("record_id", "entity_name", "current", "source_name", "confidence", "percent_change", "signal")


def studio_comparisons(spark: SparkSession, d: str) -> DataFrame:
    return studio.comparisons(records(spark, d))


def studio_warnings(spark: SparkSession, d: str) -> DataFrame:
    own = records(spark, d)
    return studio.warnings(own, studio.comparisons(own))


def studio_summary(spark: SparkSession, d: str) -> DataFrame:
    own = records(spark, d)
    return studio.summary(own, studio.comparisons(own))


def review_worklist(spark: SparkSession, d: str) -> DataFrame:
    return review.worklist(records(spark, d).select("record_id", "confidence", "evidence_status"), 100)


def provenance_gaps(spark: SparkSession, d: str) -> DataFrame:
    own = records(spark, d).withColumn("method", F.when(F.col("indicator_id") != "FURNITURE", F.col("methodology")))
    return review.provenance_gaps(own).select("record_id", "gaps", "confidence")


def governance_review(spark: SparkSession, d: str) -> DataFrame:
    versions = records(spark, d).groupBy("indicator_id", "period_label").agg(F.count(F.lit(1)).alias("n")).where("indicator_id <> 'AUTOMOBILE'")
    current = review.latest(versions, ["indicator_id"], [F.col("n"), F.col("period_label")]).select("indicator_id", F.when(F.col("period_label") > "1998", "approved").otherwise("draft").alias("version_state"))
    return review.governance_review(records(spark, d), current).groupBy("indicator_id", "governance_status").agg(F.count(F.lit(1)).alias("n"))


def record_ids(spark: SparkSession, d: str) -> DataFrame:
    own = records(spark, d)
    return own.select(
        "record_id", derive.slug(F.concat("entity_name", F.lit(" / "), "indicator_name")).alias("slug"), derive.stable_id("entity", F.col("entity_name"), F.col("entity_id")).alias("stable_id"),
        derive.short_id("node", F.col("entity_id"), F.col("source_name")).alias("node_id"), derive.period_type(F.col("period_label")).alias("period_type"), derive.source_is_missing(F.col("source_name")).alias("no_source"),
    )


QUERIES = {
    "measurement_review": measurement_review, "review_worklist": review_worklist, "provenance_gaps": provenance_gaps, "governance_review": governance_review, "record_ids": record_ids,
    "studio_query": studio_query, "studio_comparisons": studio_comparisons, "studio_warnings": studio_warnings, "studio_summary": studio_summary,
}

SQL = {
    "measurement_review": f"WITH {FACTS}, {_REVIEW} SELECT * FROM reviewed",
    "review_worklist": f"WITH {RECORDS} SELECT record_id, confidence, evidence_status FROM records ORDER BY confidence, record_id LIMIT 100",
    "provenance_gaps": f"""WITH {RECORDS} SELECT record_id, concat_ws(',', CASE WHEN source_name IS NULL THEN 'source' END, CASE WHEN confidence < 40 THEN 'confidence' END,
        CASE WHEN indicator_id = 'FURNITURE' THEN 'method' END) AS gaps, confidence FROM records WHERE source_name IS NULL OR confidence < 40 OR indicator_id = 'FURNITURE'""",
    "governance_review": f"""WITH {RECORDS}, v AS (SELECT indicator_id, arg_max(period_label, (n, period_label)) AS p FROM
        (SELECT indicator_id, period_label, count(*) AS n FROM records WHERE indicator_id <> 'AUTOMOBILE' GROUP BY ALL) GROUP BY 1)
        SELECT indicator_id, CASE WHEN p IS NULL THEN 'missing' WHEN p > '1998' THEN 'governed' ELSE 'review required' END AS governance_status, count(*) AS n
        FROM records LEFT JOIN v USING (indicator_id) GROUP BY ALL""",
    "record_ids": f"""WITH {RECORDS} SELECT record_id, substr(trim(regexp_replace(lower(entity_name || ' / ' || indicator_name), '[^a-z0-9]+', '-', 'g'), '-'), 1, 64) AS slug,
        'entity:' || trim(regexp_replace(lower(entity_name), '[^a-z0-9]+', '-', 'g'), '-') || ':' || substr(sha256('["' || lower(trim(entity_name)) || '","' || lower(trim(entity_id)) || '"]'), 1, 12) AS stable_id,
        'node:' || substr(sha256(entity_id || '|' || coalesce(source_name, '')), 1, 32) AS node_id, 'year' AS period_type, source_name IS NULL AS no_source FROM records""",
    "studio_query": f"""WITH {RECORDS} SELECT record_id, entity_name, current, source_name, confidence, percent_change, signal FROM records
        WHERE {STUDIO_QUERY_WHERE} ORDER BY {STUDIO_ORDER} LIMIT 200""",
    "studio_comparisons": f"WITH {_PAIRS} SELECT * FROM pairs",
    "studio_warnings": f"""WITH {_PAIRS} SELECT record_id, 'publication_blocked' AS warning FROM records WHERE publication_status = 'blocked'
        UNION ALL SELECT record_id, 'low_quality' FROM records WHERE quality < 70 UNION ALL SELECT record_id, 'evidence_status' FROM records WHERE evidence_status <> 'reviewable'
        UNION ALL SELECT to_record, comparability || '_comparison' FROM pairs WHERE comparability = 'limited'""",
    "studio_summary": f"""WITH {_PAIRS} SELECT count(*) AS n_records, count(DISTINCT entity_id) AS n_entities, count(DISTINCT indicator_id) AS n_indicators, count(DISTINCT period_label) AS n_periods,
        min(current) AS min_value, max(current) AS max_value, round(CAST(sum(CAST(current AS DECIMAL(28,6))) AS DOUBLE) / count(current), 6) AS mean_value,
        count(*) FILTER (publication_status = 'blocked') AS n_blocked, (SELECT count(*) FROM pairs) AS n_pairs,
        (SELECT round(CAST(sum(CAST(percent_change AS DECIMAL(28,6))) AS DOUBLE) / count(percent_change), 6) FROM pairs) AS mean_change FROM records""",
}
