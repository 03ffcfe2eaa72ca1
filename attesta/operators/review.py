"""Measurement review over a star of facts and dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import derive


def measurement_review(facts: DataFrame, entities: DataFrame, indicators: DataFrame, periods: DataFrame, sources: DataFrame) -> DataFrame:
    """Facts with their names, percent change, review class and signal; a fact without a source stays."""
    joined = facts.join(entities, "entity_id").join(indicators, "indicator_id").join(periods, "period_id").join(sources, "source_id", "left")
    missing = F.col("source_id").isNull()
    return joined.withColumns(
        {
            "percent_change": derive.percent_change(F.col("baseline"), F.col("value")),
            "review_status": derive.classify_review(F.col("confidence"), missing),
            "signal": derive.classify_signal_raw(F.col("baseline"), F.col("value"), F.col("direction")),
        }
    )


def governance_review(review: DataFrame, current_versions: DataFrame) -> DataFrame:
    """Governed, review required or missing, by the indicator's current version."""
    status = F.when(F.col("version_state").isNull(), "missing").when(F.col("version_state") == "approved", "governed").otherwise("review required")
    return review.join(current_versions, "indicator_id", "left").withColumn("governance_status", status)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of every key that comes last in an order that leaves no ties."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def provenance_gaps(records: DataFrame, low: float = derive.NEEDS_EVIDENCE) -> DataFrame:
    """Records without a source or a method, or with a confidence below ``low``; with the reasons."""
    reasons = F.array_compact(
        F.array(
            F.when(derive.source_is_missing(F.col("source_name")), "source"),
            F.when(F.col("confidence") < low, "confidence"),
            F.when(F.trim(F.coalesce("method", F.lit(""))) == "", "method"),
        )
    )
    return records.withColumn("gaps", F.array_join(reasons, ",")).where("gaps <> ''")


def worklist(records: DataFrame, limit: int) -> DataFrame:
    """The least confident records first."""
    return records.orderBy("confidence", "record_id").limit(limit)


def fold_decisions(decisions: DataFrame, key: str, order: str, decision: str, moves: dict[str, dict[str, str]], start: str) -> DataFrame:
    """Final state, accepted and rejected decisions of every key.

    ``moves`` maps a state to the decisions allowed in it and the states they lead to. A decision that a state doesn't
    allow is rejected and changes nothing, so the fold is sequential within a key; decisions that occur in no move append only.
    """
    table = F.create_map(*(F.lit(x) for s, by in moves.items() for d, to in by.items() for x in (f"{s}|{d}", to)))
    known = sorted({d for by in moves.values() for d in by})
    history = F.array_sort(F.collect_list(F.struct(order, decision)))

    def step(acc: Column, item: Column) -> Column:
        to = F.try_element_at(table, F.concat_ws("|", acc["state"], item[decision]))
        counts = item[decision].isin(*known)
        return F.struct(
            F.when(to.isNotNull(), to).otherwise(acc["state"]).alias("state"),
            (acc["accepted"] + to.isNotNull().cast("int")).alias("accepted"),
            (acc["rejected"] + (to.isNull() & counts).cast("int")).alias("rejected"),
        )

    first = F.struct(F.lit(start).alias("state"), F.lit(0).alias("accepted"), F.lit(0).alias("rejected"))
    return decisions.groupBy(key).agg(F.aggregate(history, first, step).alias("f"), F.count(F.lit(1)).alias("n_decisions")).select(key, "f.*", "n_decisions")
