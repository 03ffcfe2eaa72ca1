"""Reads over workspaces, revisions, gaps and analysis runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import derive


def record_access(governance: DataFrame, workspaces: DataFrame, projects: DataFrame, people: DataFrame) -> DataFrame:
    """Governed records with the names of workspace, project, owner, steward and custodian; no workspace, no row."""
    rows = governance.join(workspaces.select("workspace", "workspace_name"), "workspace").join(projects.select("project", "project_name"), "project", "left")
    for role in ("owner", "steward", "custodian"):
        rows = rows.join(people.select(F.col("principal").alias(role), F.col("name").alias(f"{role}_name")), role, "left")
    return rows


def workspace_counts(workspaces: DataFrame, members: DataFrame, governance: DataFrame) -> DataFrame:
    """Active members and records of every workspace; both are counted before the join, so nothing multiplies."""
    people = members.where("active").groupBy("workspace").agg(F.count_distinct("principal").alias("member_count"))
    records = governance.groupBy("workspace").agg(F.count_distinct("record_id").alias("record_count"))
    return workspaces.join(people, "workspace", "left").join(records, "workspace", "left").na.fill(0, ["member_count", "record_count"])


def visible(records: DataFrame, governance: DataFrame, workspace: str) -> DataFrame:
    """The records of one workspace with their governance."""
    return governance.where(F.col("workspace") == workspace).join(records, "record_id")


def with_default_governance(records: DataFrame, governance: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """The governance rows that records without any get."""
    return records.select("record_id").join(governance, "record_id", "left_anti").distinct().select("record_id", *(F.lit(v).alias(k) for k, v in defaults.items()))


def events(log: DataFrame, people: DataFrame, workspace: str | None = None, record_id: int | None = None) -> DataFrame:
    """The access log, of a workspace or a record if asked, with the names of known principals."""
    for column, asked in (("workspace", workspace), ("record_id", record_id)):
        log = log if asked is None else log.where(F.col(column) == asked)
    return log.join(people.select("principal", "name"), "principal", "left")


def workspace_manifest(records: DataFrame, governance: DataFrame, workspace: str, columns: list[str]) -> DataFrame:
    """The records of a workspace with the SHA-256 of their JSON, columns sorted by name."""
    return visible(records, governance, workspace).select("record_id", F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256).alias("payload_sha256"))


def revision_history(revisions: DataFrame, diffs: DataFrame) -> DataFrame:
    """Every revision with the diff that led to it, if any."""
    return revisions.join(diffs, "revision_id", "left")


def open_gaps(gaps: DataFrame, measurements: DataFrame, entities: DataFrame, indicators: DataFrame) -> DataFrame:
    """Unresolved gaps with the names of entity and indicator."""
    return gaps.where("resolved_at IS NULL").join(measurements, "record_id").join(entities, "entity_id").join(indicators, "indicator_id")


def artifact_status(artifacts: DataFrame, runs: DataFrame, invalidations: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Artifacts with their runs, the latest one and its unresolved invalidations."""
    latest = runs.groupBy("artifact_id").agg(F.max(F.struct("run_id", "status")).alias("last"), F.count(F.lit(1)).alias("run_count"))
    latest = latest.select("artifact_id", "run_count", F.col("last.run_id").alias("run_id"), F.col("last.status").alias("latest_run_status"))
    left = invalidations.join(resolutions, "invalidation_id", "left_anti").groupBy("run_id").agg(F.count(F.lit(1)).alias("open_invalidation_count"))
    found = artifacts.join(latest, "artifact_id", "left").join(left, "run_id", "left").na.fill(0, ["run_count", "open_invalidation_count"])
    return found.withColumnRenamed("run_id", "latest_run_id")


def analysis_summary(inputs: DataFrame, run: str, value: str) -> DataFrame:
    """Count, least, greatest and mean value of the frozen inputs of every run."""
    return inputs.groupBy(run).agg(F.count(value).alias("input_count"), F.min(value).alias("minimum"), F.max(value).alias("maximum"), F.avg(value).alias("mean"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows")) for name, df in tables.items()]
    found = counts[0]
    for more in counts[1:]:
        found = found.unionByName(more)
    return found


def frozen_positions(rows: DataFrame, run: str, order: list[Column]) -> DataFrame:
    """The place of every row of a frozen run in the query's order; a run is bounded by the query's limit."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(run).orderBy(*order)))


def resolve_identifiers(identifiers: DataFrame, asked: DataFrame) -> DataFrame:
    """Entities of the asked identifiers of a scheme, as written or in the normal form of names (tokens keep apart)."""
    normal = derive.normal_name("identifier")
    known = identifiers.select("entity_id", "scheme", F.col("identifier").alias("known"), normal.alias("normal"))
    found = asked.withColumn("normal", normal).where("normal <> ''").join(known, ["scheme", "normal"])
    return found.withColumn("exact", F.col("identifier") == F.col("known")).groupBy("asked_id", "entity_id").agg(F.max("exact").alias("exact"))


def disagreements(records: DataFrame, expected: dict[str, Column], key: str) -> DataFrame:
    """Records whose derived columns differ from what they derive to, with the names of those columns."""
    wrong = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(e), c) for c, e in sorted(expected.items()))))
    return records.select(key, F.array_join(wrong, ",").alias("differs")).where("differs <> ''")
