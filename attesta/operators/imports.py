"""Bulk import of authored records: errors by row, all or nothing or the good rows alone.

A run writes its records aside and only then its row in ``runs``; readers take records of completed runs. A run that
fails leaves no records, and leaves its row and its errors. Running the same run again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.operators import contracts, records, validation
from attesta.sources import versions

RUN = "run string, number long, status string, atomic boolean, processed long, inserted long, updated long, skipped long, failed long"


def content_hash() -> F.Column:
    """Of what is recorded, without the times of recording."""
    parts = [n for n in records.RECORD if n not in ("created_at", "updated_at", "producer", *contracts.DERIVED)]
    return F.sha2(F.to_json(F.struct(*sorted(parts)), {"ignoreNullFields": "false"}), 256)


def runs(spark: SparkSession, root: str) -> DataFrame:
    found = versions.read(spark, f"{root}/runs")
    return spark.createDataFrame([], RUN) if found is None else found


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The last version of every record of completed runs, with run_number and row_number; None before the first."""
    done = {r.run: r.number for r in runs(spark, root).where("status <> 'failed'").collect()}  # one row a run
    found = versions.read(spark, f"{root}/records", list(done))
    if found is None:
        return None
    last = F.struct("run_number", "row_number")
    kept = found.groupBy("record_id").agg(F.max_by(F.struct(*[c for c in found.columns if c != "record_id"]), last).alias("_r"))
    return kept.select("record_id", "_r.*").select(*found.columns)


def with_actions(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """inserted, updated or skipped of valid rows (record_id, content, row_number), against ``known`` and the rows before."""
    before = F.lag("content").over(Window.partitionBy("record_id").orderBy("row_number"))
    rows = rows.withColumn("_before", before)
    if known is not None:
        old = known.select("record_id", F.col("content").alias("_old"))
        rows = rows.join(old, "record_id", "left").withColumn("_before", F.coalesce("_before", "_old")).drop("_old")
    action = F.when(F.col("_before").isNull(), "inserted").when(F.col("_before") == F.col("content"), "skipped").otherwise("updated")
    return rows.withColumn("action", action).drop("_before")


def checked(authored: DataFrame, now: str) -> DataFrame:
    """Canonical records of authored rows with their row_number and errors."""
    return validation.validated(records.canonical(authored, now, component="import-service", keep=["row_number"]))


def run_import(authored: DataFrame, root: str, run: str, now: str, atomic: bool = True, dry_run: bool = False) -> dict:
    """Imports authored rows with row_number; returns the counts and, of failed rows, where their errors are.

    ``atomic`` publishes nothing if any row has errors; otherwise the good rows are published. A dry run counts only.
    The errors are written to ``root/errors/run`` (row_number, record_id, path, message) in either case.
    """
    spark = authored.sparkSession
    before = runs(spark, root).where(F.col("run") == run).collect()
    if before:
        return before[0].asDict()
    aside = f"{root}/aside/{run}"
    if not versions.exists(spark, f"{aside}/{versions.MARKER}"):
        checked(authored, now).withColumn("content", content_hash()).write.mode("overwrite").parquet(aside)
    rows = spark.read.parquet(aside)
    good, bad = validation.split(rows)
    acted = with_actions(good, current(spark, root))
    counts = {r.action: r.n for r in acted.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}  # three rows at most
    failed = bad.count()
    done = {n: counts.get(n, 0) for n in ("inserted", "updated", "skipped")}
    number = (runs(spark, root).agg(F.max("number")).first()[0] or 0) + 1
    result = {"run": run, "number": number, "status": "failed" if failed and atomic else "completed with errors" if failed else "completed", "atomic": atomic, "processed": sum(done.values()) + failed, **done, "failed": failed}
    if dry_run:
        versions.remove(spark, aside)
        return result | {"status": "dry run"}
    if failed:
        lines = bad.select("row_number", "record_id", F.explode("errors").alias("e")).select("row_number", "record_id", "e.path", "e.message")
        versions.write_once(lines, f"{root}/errors", run)
    if result["status"] != "failed":
        fresh = acted.where("action <> 'skipped'").drop("errors", "action").withColumn("run_number", F.lit(number).cast("long"))
        versions.write_once(fresh, f"{root}/records", run)
    else:
        result |= dict.fromkeys(done, 0)
    versions.write_once(spark.createDataFrame([tuple(result.values())], RUN).coalesce(1), f"{root}/runs", run)
    versions.remove(spark, aside)
    return result
