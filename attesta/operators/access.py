"""Access and retention: who may do what, and what may go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def authorised(memberships: DataFrame, permissions: DataFrame, asked: DataFrame, as_of: Column) -> DataFrame:
    """``asked`` (principal, workspace, permission) with ``allowed``: by an active membership whose role grants it or ``*``."""
    live = memberships.where(F.col("active") & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of)))
    granted = live.join(permissions, "role").select("principal", "workspace", F.col("permission").alias("_p")).distinct()
    grants = granted.groupBy("principal", "workspace").agg(F.collect_set("_p").alias("_g"))  # bounded by the number of permissions
    allowed = F.coalesce(F.array_contains("_g", F.lit("*")) | F.array_contains("_g", F.col("permission")), F.lit(False))
    return asked.join(grants, ["principal", "workspace"], "left").withColumn("allowed", allowed).drop("_g")


def disposition(records: DataFrame, as_of: Column) -> DataFrame:
    """Whether records may be disposed of, and the reasons against: legal hold, no retention date, not due."""
    reasons = F.array_compact(F.array(F.when(F.col("legal_hold"), "legal hold"), F.when(F.col("due_date").isNull(), "no retention date"), F.when(F.col("due_date") > as_of, "not due")))
    return records.withColumn("reasons", F.array_join(reasons, ",")).withColumn("eligible", F.col("reasons") == "")


def assign(current: DataFrame, changes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Assignments with changes applied (null keeps the old value), and the transfers: records whose workspace changed."""
    old = current.select(key, F.col("workspace").alias("_w"), F.col("assigned_at").alias("_at"), F.col("days").alias("_d"))
    joined = old.join(changes.select(key, "workspace", "assigned_at", "days"), key, "full")
    rows = joined.select(key, F.col("_w").alias("from_workspace"), F.coalesce("workspace", "_w").alias("workspace"), F.coalesce("assigned_at", "_at").alias("assigned_at"), F.coalesce("days", "_d").alias("days"))
    rows = rows.withColumn("due_date", F.date_add("assigned_at", F.col("days").cast("int")))
    return rows.drop("from_workspace"), rows.where("from_workspace <> workspace").select(key, "from_workspace", F.col("workspace").alias("to_workspace"))


def integrity(frozen: DataFrame, current: DataFrame, key: str, content: str) -> DataFrame:
    """Frozen inputs against what is there now: current, changed or missing."""
    now = current.select(key, F.col(content).alias("_now"), F.lit(1).alias("_has"))
    status = F.when(F.col("_has").isNull(), "missing").when(F.col(content).eqNullSafe(F.col("_now")), "current").otherwise("changed")
    return frozen.join(now, key, "left").withColumn("status", status).drop("_now", "_has")


def invalidations(checked: DataFrame, known: DataFrame, run: str, key: str) -> DataFrame:
    """New (run, input, status) events of inputs that changed or are gone; events known before are not repeated."""
    return checked.where("status <> 'current'").select(run, key, "status").distinct().join(known, [run, key, "status"], "left_anti")


def manifest(rows: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """Rows and an order-free hash of all rows, per group: sums of row hashes, so that no task holds a group."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    parts = rows.select(*group, F.sha2(text, 256).alias("_h"))
    piece = lambda i: F.sum(F.conv(F.substring("_h", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    return parts.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws(",", piece(0), piece(1), piece(2)), 256).alias("sha256"))
