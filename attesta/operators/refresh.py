"""Feed refresh: what came in against what was there, reconciled and watched for drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import derive


def first_of_key(payload: DataFrame, key: str, order: str) -> DataFrame:
    """``duplicate`` marks all rows of a key but the first."""
    return payload.withColumn("duplicate", F.row_number().over(Window.partitionBy(key).orderBy(order)) > 1)


def refresh(previous: DataFrame, payload: DataFrame, key: str, content: str, failed: Column | None = None) -> DataFrame:
    """One row per key: matched, changed, missing or unexpected, with ``quarantined`` for rows whose mapping failed.

    ``previous`` holds the active keys. A failed row still counts as seen. The payload has one row per key.
    """
    old = previous.select(key, F.col(content).alias("_old"), F.lit(1).alias("_had"))
    new = payload.select(key, F.col(content).alias("_new"), F.lit(1).alias("_has"), (failed if failed is not None else F.lit(False)).alias("quarantined"))
    status = F.when(F.col("_has").isNull(), "missing").when(F.col("_had").isNull(), "unexpected").when(F.col("_old").eqNullSafe(F.col("_new")), "matched").otherwise("changed")
    return old.join(new, key, "full").select(key, status.alias("status"), F.coalesce("quarantined", F.lit(False)).alias("quarantined"), F.coalesce("_has", F.lit(0)).cast("boolean").alias("active"))


def reconciliation(refreshed: DataFrame, n_duplicates: DataFrame, threshold: float = 0.25, atomic: bool = False) -> DataFrame:
    """One row: expected, actual and what differs; drift if too large a share of the expected keys is gone.

    Anything out of place is a warning; only an atomic run fails by its quarantined rows. Keys are unexpected only where
    some were expected.
    """
    of = lambda s: F.count_if(F.col("status") == s)
    sums = refreshed.agg(
        F.count_if(F.col("status").isin("matched", "changed", "missing")).alias("expected"), F.count_if("active").alias("actual"), of("matched").alias("matched"), of("changed").alias("changed"),
        of("missing").alias("missing"), of("unexpected").alias("unexpected"), F.count_if("quarantined").alias("quarantined"),
    ).join(n_duplicates)
    sums = sums.withColumn("unexpected", F.when(F.col("expected") > 0, F.col("unexpected")).otherwise(0))
    ratio = F.when(F.col("expected") > 0, F.round(F.col("missing") / F.col("expected"), 6)).otherwise(0.0)
    uneven = (F.col("missing") > 0) | (F.col("unexpected") > 0) | (F.col("duplicates") > 0) | (F.col("quarantined") > 0)
    state = F.when(F.lit(atomic) & (F.col("quarantined") > 0), "failed").when(uneven, "warning").otherwise("balanced")
    return sums.withColumns({"missing_ratio": ratio, "population_drift": ratio > threshold, "status": state})


def alerts(run: DataFrame) -> DataFrame:
    """(alert, severity) rows of reconciliation rows, critical ones first.

    The run may have freshness, license and schema_changed; without such a column there is no alert of that kind.
    """
    has = lambda name, test: test if name in run.columns else F.lit(False)
    tests = [
        ("freshness", "warning", has("freshness", F.col("freshness") == "stale")),
        ("license", "warning", has("license", F.col("license") == "missing")),
        ("license", "critical", has("license", F.col("license") == "restricted")),
        ("schema-drift", "critical", has("schema_changed", F.col("schema_changed"))),
        ("record-drift", "warning", (F.col("missing") > 0) | (F.col("unexpected") > 0)),
        ("quarantine", "warning", F.col("quarantined") > 0),
        ("reconciliation", "critical", F.col("status") == "failed"),
        ("reconciliation", "warning", F.col("status") == "warning"),
    ]
    found = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(alert).alias("alert"), F.lit(severity).alias("severity"))) for alert, severity, test in tests)))
    return run.select(F.inline(found)).orderBy(F.col("severity") != "critical", "alert")


def run_states(runs: DataFrame, threshold: float = 0.25) -> DataFrame:
    """Status, license, freshness, drift and health of connector runs.

    ``runs`` has atomic, inserted, updated, skipped, quarantined, expected, missing, license, license_status (a governed
    restriction), age_seconds, sla_seconds, fingerprint and last_fingerprint. A run without an age is of unknown
    freshness, one without a fingerprint of unknown drift; no agreed age is never exceeded.
    """
    c, done = F.col, F.col("inserted") + F.col("updated") + F.col("skipped")
    status = F.when(c("atomic") & (c("quarantined") > 0), "failed").when((c("quarantined") > 0) & (done > 0), "partial").when(c("quarantined") > 0, "quarantined").otherwise("succeeded")
    license_ = F.when(c("license_status").eqNullSafe(F.lit("restricted")), "restricted").when(F.coalesce(c("license"), F.lit("")) != "", "compliant").otherwise("missing")
    fresh = F.when(c("age_seconds").isNull(), "unknown").when(F.coalesce(c("age_seconds") > c("sla_seconds"), F.lit(False)), "stale").otherwise("current")
    other = c("last_fingerprint").isNotNull() & c("fingerprint").isNotNull() & (c("last_fingerprint") != c("fingerprint"))
    ratio = F.when(c("expected") > 0, c("missing") / c("expected")).otherwise(0.0)
    drift = F.when(other | (ratio > threshold), "changed").when(c("fingerprint").isNotNull(), "stable").otherwise("unknown")
    rows = runs.withColumns({"status": status, "license_state": license_, "freshness": fresh, "drift": drift})
    sound = (c("status") == "succeeded") & (c("freshness") != "stale") & (c("drift") != "changed") & (c("license_state") == "compliant")
    return rows.withColumn("health", F.when(sound, "healthy").when(c("status").isin("failed", "quarantined"), "unhealthy").otherwise("degraded"))


def schema_paths(rows: DataFrame, keys: list[str], json_column: str) -> DataFrame:
    """Distinct path:type of all JSON objects of every key, nested ones included; a table of the schemas' size."""
    return rows.select(*keys, F.explode(derive.json_types(json_column)).alias("path")).distinct()


def schema_fingerprint(rows: DataFrame, group: str, json_column: str) -> DataFrame:
    """Hash of the paths and types of all JSON objects of a group; null values have no type."""
    paths = schema_paths(rows, [group], json_column)
    return paths.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("paths")).withColumn("fingerprint", F.sha2("paths", 256))


def schema_drift(before: DataFrame, after: DataFrame, group: str, json_column: str) -> DataFrame:
    """Paths that a group's objects gained or lost from one run to the next, or whose type is another now.

    One row for each path: group, path, was, now. Several types of one path are joined by bars. Groups of one run alone
    have all their paths.
    """

    def types(rows: DataFrame, name: str) -> DataFrame:
        parts = schema_paths(rows, [group], json_column).select(group, F.substring_index("path", ":", -1).alias("type"), F.expr("substring(path, 1, length(path) - length(substring_index(path, ':', -1)) - 1)").alias("path"))
        return parts.groupBy(group, "path").agg(F.array_join(F.array_sort(F.collect_list("type")), "|").alias(name))

    joined = types(before, "was").join(types(after, "now"), [group, "path"], "full")
    return joined.where(~F.col("was").eqNullSafe(F.col("now")))


def staleness(rows: DataFrame, keys: list[str], stamp: str, as_of: Column, sla_seconds: int) -> DataFrame:
    """Age of the newest row of every key against the agreed one."""
    newest = rows.groupBy(*keys).agg(F.max(stamp).alias("newest"))
    age = F.unix_seconds(as_of) - F.unix_seconds(F.col("newest").cast("timestamp"))
    return newest.withColumn("age_seconds", age).withColumn("sla", F.when(F.col("age_seconds").isNull(), "unknown").when(F.col("age_seconds") <= sla_seconds, "current").otherwise("stale"))


def set_difference(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys that were added or removed."""
    a, b = before.select(key, F.lit(1).alias("_a")), after.select(key, F.lit(1).alias("_b"))
    return a.join(b, key, "full").where("_a IS NULL OR _b IS NULL").select(key, F.when(F.col("_a").isNull(), "added").otherwise("removed").alias("change"))
