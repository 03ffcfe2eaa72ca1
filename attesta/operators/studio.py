"""Query studio: filters, stable sort, consecutive comparisons, warnings and summaries of records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import derive

MEMBERSHIP = ("record_id", "entity_id", "entity_name", "indicator_id", "indicator_name", "framework", "code", "period_id", "period_label", "source_id", "source_name", "review_state", "publication_status", "evidence_status")
OTHER = ("period_from", "period_to", "quality_min", "confidence_min", "tags", "search")
SORTS = ("record_id", "entity_name", "entity_id", "indicator_name", "indicator_id", "period_label", "start_date", "end_date", "current", "baseline", "percent_change", "confidence", "quality", "source_name", "review_state", "publication_status", "updated_at")
MOST_ROWS = 1_000_000
SEARCHED = ("record_id", "entity_name", "indicator_name", "period_label", "source_name", "framework", "notes")


def normalised(definition: dict) -> dict:
    """Checks a query definition and fills what it leaves out; unknown filters, sorts and limits raise ValueError."""
    filters = dict(definition.get("filters") or {})
    if unknown := set(filters) - {*MEMBERSHIP, *OTHER}:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    sort = [{"field": s["field"], "direction": s.get("direction", "asc")} for s in definition.get("sort") or []]
    if any(s["field"] not in SORTS or s["direction"] not in ("asc", "desc") for s in sort):
        raise ValueError("unknown sort")
    limit = definition.get("limit", 1000)
    if not isinstance(limit, int) or isinstance(limit, bool) or not 1 <= limit <= MOST_ROWS:
        raise ValueError("limit out of range")
    return {"filters": {k: v for k, v in filters.items() if v not in (None, [], "")}, "sort": sort, "limit": limit}


def predicate(filters: dict) -> Column:
    """All filters as one condition; missing numbers count as 0, a missing end as the end of time."""
    terms = [F.lit(True)]
    for name, value in filters.items():
        if name in MEMBERSHIP:
            terms.append(F.coalesce(F.col(name).isin(*(value if isinstance(value, list) else [value])), F.lit(False)))
        elif name == "period_from":
            terms.append(F.coalesce(F.col("start_date"), F.lit("")) >= value)
        elif name == "period_to":
            terms.append(F.coalesce(F.col("end_date"), F.lit("9999-12-31")) <= value)
        elif name in ("quality_min", "confidence_min"):
            terms.append(F.coalesce(F.col(name[:-4]), F.lit(0)) >= value)
        elif name == "tags":
            terms.append(F.size(F.array_except(F.array(*map(F.lit, value)), F.coalesce("tags", F.array().cast("array<string>")))) == 0)
        elif name == "search":
            terms.append(F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in SEARCHED))).contains(value.lower()))
    return reduce(Column.__and__, terms)


def ordering(sort: list[dict]) -> list[Column]:
    """Missing values last ascending and first descending, text without case; ties by newest update, then record."""
    keys = []
    for s in sort:
        value = F.lower(s["field"]) if s["field"] not in ("current", "baseline", "percent_change", "confidence", "quality", "updated_at") else F.col(s["field"])
        keys.append(value.asc_nulls_last() if s["direction"] == "asc" else value.desc_nulls_first())
    return [*keys, F.col("updated_at").desc(), F.col("record_id").asc()]


def run_query(records: DataFrame, definition: dict) -> DataFrame:
    """Filter, sort and limit."""
    spec = normalised(definition)
    return records.where(predicate(spec["filters"])).orderBy(*ordering(spec["sort"])).limit(spec["limit"])


def compatibility(a: str, b: str) -> tuple[Column, Column]:
    """Status and ordered reasons of comparing two record structs of one indicator.

    Other direction, dimension or basis cannot be compared; another unit of the dimension is convertible; what else
    differs limits the comparison, and then nothing is converted.
    """
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    differs = lambda c: ~x(c).eqNullSafe(y(c))
    hard = F.when(differs("direction"), "direction").when(differs("dimension"), "unit dimension")
    limits = F.array_compact(F.array(F.when(differs("frequency"), "frequency"), F.when(differs("methodology"), "methodology")))
    unit = F.when(differs("unit"), F.array(F.lit("unit"))).otherwise(F.array().cast("array<string>"))
    status = F.when(hard.isNotNull(), "incompatible").when(F.size(limits) > 0, "limited").when(differs("unit"), "convertible").otherwise("equivalent")
    return status, F.when(hard.isNotNull(), F.array(hard)).otherwise(F.concat(unit, limits))


COMPARED = ("record_id", "start_date", "period_label", "current", "unit", "factor", "dimension", "direction", "frequency", "methodology")


def comparisons(records: DataFrame) -> DataFrame:
    """Every record with the next one of its entity and indicator: converted value, change and comparability."""
    order = Window.partitionBy("entity_id", "indicator_id").orderBy(F.coalesce("start_date", F.lit("")), F.coalesce("period_label", F.lit("")), "record_id")
    own = F.struct(*COMPARED)
    pairs = records.select("entity_id", "indicator_id", own.alias("x"), F.lead(own).over(order).alias("y")).where("y IS NOT NULL")
    status, reasons = compatibility("x", "y")
    pairs = pairs.withColumns({"comparability": status, "reasons": F.array_join(reasons, ",")})
    converted = F.when(F.col("comparability") == "convertible", F.round(F.col("y.current") * F.col("y.factor") / F.col("x.factor"), 12)).otherwise(F.col("y.current"))
    change = F.when(F.col("comparability") != "incompatible", converted - F.col("x.current"))
    percent = F.when(F.col("x.current") != 0, F.round(change / F.abs("x.current") * 100, 4))
    return pairs.select(
        "entity_id", "indicator_id", F.col("x.record_id").alias("from_record"), F.col("y.record_id").alias("to_record"),
        converted.alias("to_value"), F.round(change, 12).alias("absolute_change"), percent.alias("percent_change"), "comparability", "reasons",
    )


def warnings(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per warning: blocked publication, quality below 70, weak evidence, pairs of limited use."""
    own = F.array_compact(
        F.array(
            F.when(F.col("publication_status") == "blocked", "publication_blocked"),
            F.when(F.coalesce("quality", F.lit(0)) < 70, "low_quality"),
            F.when(~F.col("evidence_status").eqNullSafe(F.lit("reviewable")), "evidence_status"),
        )
    )
    single = records.select("record_id", F.explode(own).alias("warning"))
    pair = pairs.where(F.col("comparability").isin("limited", "incompatible"))
    return single.unionByName(pair.select(F.col("to_record").alias("record_id"), F.concat(F.col("comparability"), F.lit("_comparison")).alias("warning")))


def summary(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: counts, distinct names (a missing one counts once), range and mean of values, mean percent change."""
    distinct = lambda c: F.count_distinct(F.coalesce(c, F.lit("\0")))
    left = records.agg(
        F.count(F.lit(1)).alias("n_records"),
        distinct("entity_id").alias("n_entities"),
        distinct("indicator_id").alias("n_indicators"),
        distinct("period_label").alias("n_periods"),
        F.min("current").alias("min_value"),
        F.max("current").alias("max_value"),
        F.round(F.sum(F.col("current").cast("decimal(28,6)")).cast("double") / F.count("current"), 6).alias("mean_value"),
        F.count_if(F.col("publication_status") == "blocked").alias("n_blocked"),
    )
    right = pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.sum(F.col("percent_change").cast("decimal(28,6)")).cast("double") / F.count("percent_change"), 6).alias("mean_change"))
    return left.join(right)


def with_derivations(records: DataFrame) -> DataFrame:
    """Derived judgments of records, recomputed: percent change, evidence status and signal."""
    change = derive.percent_change(F.col("baseline"), F.col("current"))
    return records.withColumn("percent_change", change).withColumns(
        {
            "evidence_status": derive.classify_review(F.col("confidence"), derive.source_is_missing(F.col("source_name"))),
            "signal": derive.classify_signal(F.col("percent_change"), F.col("direction")),
        }
    )
