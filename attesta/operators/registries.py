"""Registries over versioned tables: units, saved queries and their runs, reviews of replications, histories, statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.operators import contracts, records
from attesta.operators.evidence import clean


def unit_registry(units: DataFrame) -> DataFrame:
    """One row for each unit id of (symbol, unit): the unit's fields, ``n`` of rows, and ``issues`` as texts.

    ``unit`` is a RAW_UNIT or null. Of different units with one id the least in the order of their fields stays.
    """
    unit, issues = records.normal_unit(F.col("unit").cast(contracts.RAW_UNIT), clean(F.col("symbol")))
    rows = units.select(F.struct(unit.alias("u"), F.transform(issues, lambda x: F.concat_ws(": ", x["path"], x["message"])).alias("issues")).alias("row"))
    return rows.groupBy(F.col("row.u.id").alias("unit_id")).agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n")).select("unit_id", "row.u.*", F.array_join("row.issues", "; ").alias("issues"), "n").drop("id")


def saved_versions(saves: DataFrame) -> DataFrame:
    """Versions of saved queries: a save makes a new version only if its definition differs from the one before.

    ``saves`` has name, definition, saved_by and saved_at, unique within a name. Returns query_id, name, version,
    definition, definition_sha256, created_by and created_at.
    """
    sha = F.sha2("definition", 256)
    turn = Window.partitionBy("name").orderBy("saved_at")
    rows = saves.withColumn("definition_sha256", sha).withColumn("_before", F.lag("definition_sha256").over(turn))
    fresh = rows.where(~F.col("definition_sha256").eqNullSafe(F.col("_before")))
    query = F.concat(F.lit("query:"), F.substring(F.sha2(F.lower(F.trim("name")), 256), 1, 24))
    return fresh.select(query.alias("query_id"), "name", F.row_number().over(turn).alias("version"), "definition", "definition_sha256", F.col("saved_by").alias("created_by"), F.col("saved_at").alias("created_at"))


def saved_registry(versions: DataFrame, runs: DataFrame) -> DataFrame:
    """The current state of every saved query with its numbers of versions and runs, counted before they are joined."""
    rest = ("name", "definition_sha256", "created_at")
    last = versions.groupBy("query_id").agg(F.max_by(F.struct(*rest), "version").alias("l"), F.max("version").alias("version_count"), F.min_by("created_by", "version").alias("created_by"), F.min("created_at").alias("first_at"))
    counts = runs.groupBy("query_id").agg(F.count(F.lit(1)).alias("run_count"))
    return last.join(counts, "query_id", "left").select("query_id", "l.name", "l.definition_sha256", "created_by", F.col("first_at").alias("created_at"), F.col("l.created_at").alias("updated_at"), "version_count", F.coalesce("run_count", F.lit(0).cast("long")).alias("run_count"))


def run_summary(runs: DataFrame, versions: DataFrame, exports: DataFrame) -> DataFrame:
    """Runs with their query's current name and the number of their exports; runs of no saved query stay."""
    names = versions.groupBy("query_id").agg(F.max_by("name", "version").alias("query_name"))
    counts = exports.groupBy("run_id").agg(F.count(F.lit(1)).alias("export_count"))
    return runs.join(names, "query_id", "left").join(counts, "run_id", "left").withColumn("export_count", F.coalesce("export_count", F.lit(0).cast("long")))


# Outcomes of a replication.
REPLICATIONS = ("pending", "confirmed", "partial", "failed", "not-reproducible")


def replication_reviews(reviews: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviews that may be appended, with replication_id and the evidence's digest; and those refused, with the reason.

    ``reviews`` has run_id, status, reviewer, evidence, reproduced_run_id and reviewed_at; both runs must be known.
    """
    known = runs.select(F.col("run_id").alias("_known")).distinct()
    rows = reviews.join(known, F.col("run_id") == F.col("_known"), "left")
    again = known.select(F.col("_known").alias("_again"))
    rows = rows.join(again, F.col("reproduced_run_id") == F.col("_again"), "left")
    reason = F.when(~F.coalesce(F.col("status").isin(*REPLICATIONS), F.lit(False)), "invalid replication status").when(F.col("_known").isNull(), "run not found").when(F.col("reproduced_run_id").isNotNull() & F.col("_again").isNull(), "reproduced run not found")
    sha = F.sha2(F.coalesce("evidence", F.lit("{}")), 256)
    key = F.concat_ws("|", "run_id", "status", "reviewer", sha, F.col("reviewed_at").cast("string"))
    named = rows.withColumns({"reason": reason, "evidence_sha256": sha, "replication_id": F.concat(F.lit("replication:"), F.substring(F.sha2(key, 256), 1, 32))}).drop("_known", "_again")
    return named.where("reason IS NULL").drop("reason"), named.where("reason IS NOT NULL")


def history(versions: DataFrame, key: str, version: str, children: DataFrame | None = None, child: str = "snapshot_count") -> DataFrame:
    """Versions of a registry with how far each lies behind the newest, and the number of their children.

    ``children`` has the key and the version that each child belongs to.
    """
    behind = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version))) - 1
    rows = versions.withColumn("versions_behind", behind)
    if children is None:
        return rows
    counts = children.groupBy(key, version).agg(F.count(F.lit(1)).alias(child))
    return rows.join(counts, [key, version], "left").withColumn(child, F.coalesce(child, F.lit(0).cast("long")))


def seeded(seeds: DataFrame, dimensions: dict[str, DataFrame]) -> DataFrame:
    """Seed rows whose names all dimensions know, with the ids instead of the names.

    ``dimensions`` maps a prefix to (prefix_id, prefix_name); the seeds have prefix_name. A name of several ids gives a
    row for each.
    """
    for prefix, table in dimensions.items():
        seeds = seeds.join(table.select(f"{prefix}_id", f"{prefix}_name"), f"{prefix}_name").drop(f"{prefix}_name")
    return seeds


def rollup(name: str, tables: dict[str, tuple[DataFrame, Column | None]]) -> DataFrame:
    """(rollup, measure, value): for every table how many of its rows hold the condition; measures of one table read it once."""
    by_table = {}
    for measure, (df, condition) in tables.items():
        by_table.setdefault(id(df), (df, {}))[1][measure] = F.lit(True) if condition is None else condition
    found = None
    for df, measures in by_table.values():
        counts = df.agg(*(F.count_if(condition).alias(f"_{measure}") for measure, condition in measures.items()))
        values = F.array(*(F.struct(F.lit(measure).alias("measure"), F.col(f"_{measure}").alias("value")) for measure in measures))
        part = counts.select(F.lit(name).alias("rollup"), F.inline(values))
        found = part if found is None else found.unionByName(part)
    return found


def entity_series(tables: list[tuple[str, DataFrame, Column, Column, Column]]) -> DataFrame:
    """Observations, first and last period of every (provider, geo, dataset_key); each table with its geo, key and period."""
    found = None
    for provider, df, geo, key, period in tables:
        rows = df.select(F.lit(provider).alias("provider"), geo.cast("string").alias("geo"), key.cast("string").alias("dataset_key"), period.cast("string").alias("period")).where("dataset_key IS NOT NULL")
        part = rows.groupBy("provider", "geo", "dataset_key").agg(F.count(F.lit(1)).alias("observation_count"), F.min("period").alias("temporal_start"), F.max("period").alias("temporal_end"))
        found = part if found is None else found.unionByName(part)
    return found
