"""Versions, revisions, event chains and idempotent upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def versions(history: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """One numbered version for each distinct content of a key, by first appearance; the latest is the one seen last."""
    seen = history.groupBy(key, content).agg(F.min(order).alias("first_seen"), F.max(order).alias("last_seen"))
    by = Window.partitionBy(key)
    return seen.withColumn("version", F.row_number().over(by.orderBy("first_seen"))).withColumn("is_latest", F.col("last_seen") == F.max("last_seen").over(by))


def revisions(history: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """One numbered revision for each change of content; a return to earlier content is a change."""
    by = Window.partitionBy(key).orderBy(order)
    changed = history.withColumn("_before", F.lag(content).over(by)).where(~F.col(content).eqNullSafe(F.col("_before")) | F.col("_before").isNull()).drop("_before")
    return changed.withColumn("revision", F.row_number().over(by)).withColumn("action", F.when(F.col("revision") == 1, "inserted").otherwise("updated"))


def event_chain(events: DataFrame, key: str, order: str) -> DataFrame:
    """Every event with the one before it of the same key."""
    return events.withColumn("previous_event_id", F.lag(order).over(Window.partitionBy(key).orderBy(order)))


def upsert_actions(current: DataFrame, incoming: DataFrame, key: str, content: str) -> DataFrame:
    """Full outer join of stored and incoming rows: inserted, updated, skipped, or kept if nothing came in."""
    old, new = current.select(key, F.col(content).alias("_old"), F.lit(1).alias("_had")), incoming.select(key, F.col(content).alias("_new"), F.lit(1).alias("_has"))
    action = F.when(F.col("_had").isNull(), "inserted").when(F.col("_has").isNull(), "kept").when(F.col("_old").eqNullSafe(F.col("_new")), "skipped").otherwise("updated")
    return old.join(new, key, "full").select(key, action.alias("action"), F.when(F.col("_has").isNotNull(), F.col("_new")).otherwise(F.col("_old")).alias(content))


def last_write(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Dimension upsert: of rows with one key the last stays."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def fill_upsert(current: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Upsert that never overwrites a value with null."""
    old = current.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    return old.join(incoming.select(key, *columns), key, "full").select(key, *(F.coalesce(c, f"_{c}").alias(c) for c in columns))


def seen_range(rows: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min(stamp).alias("first_seen"), F.max(stamp).alias("last_seen"), F.count(F.lit(1)).alias("n"))


def content_distinct(rows: DataFrame, columns: list[str], stamp: str) -> DataFrame:
    """One row for each content, addressed by its hash."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(columns)))
    return rows.groupBy(F.sha2(text, 256).alias("content_id")).agg(F.min(stamp).alias("first_seen"), F.max(stamp).alias("fetched"), F.count(F.lit(1)).alias("n"))


def only_latest_children(children: DataFrame, parent: str, version: str) -> DataFrame:
    """Child rows of their parent's latest version."""
    last = children.groupBy(parent).agg(F.max(version).alias(version))
    return children.join(last, [parent, version], "left_semi")


def missing_derived(records: DataFrame, derived: DataFrame, key: str) -> DataFrame:
    """Records that have no derived row yet."""
    return records.join(derived, key, "left_anti")


def gap_intervals(gaps: DataFrame, key: str, order: str) -> DataFrame:
    """Gaps found at a revision stay open until the next one."""
    last = Window.partitionBy(key).orderBy(order)
    spans = gaps.select(key, order).distinct().withColumn("resolved_at", F.lead(order).over(last))
    return gaps.join(spans, [key, order])
