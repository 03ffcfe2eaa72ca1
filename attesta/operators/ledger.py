"""Landed payloads and their runs, source snapshots, re-derivation, frozen runs and lineage edges: tables that only grow.

Everything is kept below a folder that driver and executors share, as versions that are written once (``sources.versions``),
so doing a step twice, or again after a failure, gives what doing it once gives.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.sources import versions


def digest(df: DataFrame) -> str:
    """SHA-256 over the number of rows and two sums of their hashes: the same for any order and partitioning of the rows."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    sums = [F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string") for h in (F.xxhash64(row), F.xxhash64(F.lit(1), row), F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10))]
    return df.agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)), *sums), 256).alias("digest")).first().digest


def identity(kind: str, *parts: str | None) -> str:
    import hashlib

    return f"{kind}-{hashlib.sha256('|'.join(p or '' for p in parts).encode()).hexdigest()[:24]}"


def land(payload: DataFrame, root: str) -> str:
    """Stores a payload under its content's digest, once; returns that digest."""
    name = digest(payload)
    versions.write_once(payload, f"{root}/payloads", name)
    return name


RUN = "run string, parent string, connector string, payload string, rows long, status string"


def _run(spark: SparkSession, root: str, connector: str, payload: str, parent: str | None, process: Callable[[DataFrame], DataFrame]) -> str:
    run = identity("run", connector, payload, parent)
    if run in versions.committed(spark, f"{root}/runs"):
        return run
    versions.write_once(process(versions.read(spark, f"{root}/payloads", [payload])), f"{root}/results", run)
    n = versions.read(spark, f"{root}/results", [run]).count()
    line = spark.createDataFrame([(run, parent, connector, payload, n, "completed")], RUN)
    versions.write_once(line.coalesce(1), f"{root}/runs", run)
    return run


def run(payload: DataFrame, root: str, connector: str, process: Callable[[DataFrame], DataFrame]) -> str:
    """Lands a payload and processes what landed; the same payload of a connector is one run."""
    return _run(payload.sparkSession, root, connector, land(payload, root), None, process)


def replay(spark: SparkSession, root: str, parent: str, process: Callable[[DataFrame], DataFrame]) -> str:
    """Processes the landed payload of a run again, as a run whose parent that one is; a second replay changes nothing."""
    found = versions.read(spark, f"{root}/runs", [parent])
    if found is None:
        raise ValueError(f"no run {parent}")
    of = found.first()
    return _run(spark, root, of.connector, of.payload, parent, process)


def _append(rows: DataFrame, folder: str, key: str) -> int:
    """Appends rows whose key is not there yet, one for each key, as a version named by them; returns how many."""
    spark = rows.sparkSession
    rows = rows.dropDuplicates([key])
    known = versions.read(spark, folder)
    fresh = rows if known is None else rows.join(known.select(key), key, "left_anti")
    n, name = fresh.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64(key).cast("decimal(38,0)")), F.lit(0)).cast("string")).first()
    if n:
        versions.write_once(fresh, folder, identity("part", str(n), name))
    return n


def append_snapshots(snapshots: DataFrame, source_versions: DataFrame, links: DataFrame, root: str) -> tuple[int, int]:
    """Appends new snapshots of sources, and of each one event for every record that is linked to its source.

    ``snapshots`` has source_id, retrieved_at, content_sha256 and storage_uri; ``source_versions`` source_id and version
    (the latest counts); ``links`` source_id and record_id. Snapshots of unknown sources are left out. Returns the numbers
    of new snapshots and events; events of a snapshot that is there but was not finished are made up for.
    """
    spark = snapshots.sparkSession
    latest = source_versions.groupBy("source_id").agg(F.max("version").alias("version"))
    key = F.concat_ws("|", "source_id", F.col("version").cast("string"), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("retrieved_at", "content_sha256", "storage_uri")))
    named = snapshots.join(latest, "source_id").withColumn("snapshot_id", F.concat(F.lit("snapshot:"), F.substring(F.sha2(key, 256), 1, 24)))
    n = _append(named, f"{root}/snapshots", "snapshot_id")
    known = versions.read(spark, f"{root}/snapshots")
    if known is None:
        return 0, 0
    events = known.join(links.select("source_id", "record_id").distinct(), "source_id").select(
        F.concat(F.lit("event:"), F.substring(F.sha2(F.concat_ws("|", "record_id", "snapshot_id"), 256), 1, 24)).alias("event_id"), "record_id", "source_id", "snapshot_id", F.lit("source_snapshot_added").alias("event_type"), F.col("retrieved_at").alias("occurred_at"),
    )
    return n, _append(events, f"{root}/events", "event_id")


BUCKET = "bucket"


def store_records(records: DataFrame, path: str, key: str = "record_id", buckets: int = 64) -> None:
    """Records in folders by a hash of their key; with more records, more buckets."""
    placed = records.withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    placed.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def rederive(spark: SparkSession, path: str, stale: Column, derive: Callable[[DataFrame], DataFrame], aside: str) -> int:
    """Derives stale records again and overwrites only the folders that have some; returns how many records were stale.

    The new folders are written aside first and then put in place, so a failure in between is mended by another call. The
    list of stale folders is at most the number of buckets.
    """
    rows = spark.read.parquet(path)
    found = rows.where(stale).groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n")).collect()
    if not found:
        return 0
    touched = rows.where(F.col(BUCKET).isin([r[BUCKET] for r in found])).withColumn("_stale", F.coalesce(stale, F.lit(False)))
    kept = touched.where(~F.col("_stale")).drop("_stale")
    again = derive(touched.where("_stale").drop("_stale")).select(*kept.columns)
    kept.unionByName(again).write.mode("overwrite").parquet(aside)
    fresh = spark.read.schema(kept.schema).parquet(aside)
    fresh.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    versions.remove(spark, aside)
    return sum(r.n for r in found)


FROZEN = "run string, definition string, definition_sha256 string, result_sha256 string, rows long"


def freeze(result: DataFrame, definition: str, root: str) -> str:
    """Writes the rows of a query run, in any partitioning, with the digests of definition and result; returns the run.

    The same definition with the same rows is the same run.
    """
    import hashlib

    spark, sha = result.sparkSession, hashlib.sha256(definition.encode()).hexdigest()
    value = digest(result)
    run = identity("frozen", sha, value)
    versions.write_once(result, f"{root}/rows", run)
    n = versions.read(spark, f"{root}/rows", [run]).count()
    versions.write_once(spark.createDataFrame([(run, definition, sha, value, n)], FROZEN).coalesce(1), f"{root}/manifests", run)
    return run


def frozen(spark: SparkSession, root: str, run: str) -> tuple[DataFrame, dict]:
    """The frozen rows of a run, and its manifest with ``intact``: whether they still have the digest they were frozen with."""
    found = versions.read(spark, f"{root}/manifests", [run])
    if found is None:
        raise ValueError(f"no run {run}")
    manifest = found.first().asDict()
    rows = versions.read(spark, f"{root}/rows", [run])
    return rows, manifest | {"intact": digest(rows) == manifest["result_sha256"]}


EDGE_BUCKETS = 16


EDGE_ID = "derived-lineage:"


def append_edges(edges: DataFrame, table: str, path: str) -> int:
    """Appends edges (run_id, derived_id, source_id, transformation) that are not there yet to two bucketed tables.

    ``table``_by_derived and ``table``_by_source hold the same edges, bucketed and sorted by either end, so that lookups
    by a table bucketed alike read both directions without a shuffle. New edges are found and stored once and then written
    to both, unless the two differ after a failure. Returns how many were new.
    """
    spark, key = edges.sparkSession, "_key"  # 16 bytes: ids begin alike, which makes them slow to sort
    names = {f"{table}_by_{side}": (side, f"{side}_id") for side in ("derived", "source")}
    there = [name for name in names if spark.catalog.tableExists(name)]
    sha = F.sha2(F.concat_ws("|", "run_id", "derived_id", "source_id"), 256)
    rows = edges.withColumn(key, F.unhex(F.substring(sha, 1, 32))).dropDuplicates([key])
    known = lambda name: spark.table(name).select(F.unhex(F.substring("lineage_id", len(EDGE_ID) + 1, 32)).alias(key))
    alike = not there or len(there) == len(names) and len({_edges_digest(spark, name) for name in names}) == 1
    counts = []
    for group in [list(names)] if alike else [[name] for name in names]:
        fresh = rows.join(known(group[0]), key, "left_anti") if group[0] in there else rows
        kept = [F.col(c) for c in edges.columns]
        fresh = fresh.select(*kept, F.concat(F.lit(EDGE_ID), F.lower(F.hex(key))).alias("lineage_id"))
        aside = f"{path}/new-{uuid.uuid4().hex}"
        fresh.write.parquet(aside)
        new = spark.read.schema(fresh.schema).parquet(aside)
        counts.append(new.count())
        for name in group if counts[-1] else ():
            side, column = names[name]
            new.write.mode("append").bucketBy(EDGE_BUCKETS, column).sortBy(column).option("path", f"{path}/{side}").saveAsTable(name)
        versions.remove(spark, aside)
    return max(counts)


def _edges_digest(spark: SparkSession, name: str) -> tuple:
    """The number of edges and two sums of their ids' hashes: equal for tables of the same edges."""
    sums = (F.sum(h.cast("decimal(38,0)")).cast("string") for h in (F.xxhash64("lineage_id"), F.xxhash64(F.lit(1), "lineage_id")))
    return tuple(spark.table(name).agg(F.count(F.lit(1)), *sums).first())


def _edge_sides(spark: SparkSession, table: str, asked: DataFrame, record: str) -> list[DataFrame]:
    ids = asked.select(F.col(record).alias("asked"))
    up = ids.join(spark.table(f"{table}_by_derived"), F.col("asked") == F.col("derived_id")).select("asked", F.lit("derived").alias("direction"), "lineage_id", F.col("source_id").alias("other"), "run_id")
    down = ids.join(spark.table(f"{table}_by_source"), F.col("asked") == F.col("source_id")).select("asked", F.lit("source").alias("direction"), "lineage_id", F.col("derived_id").alias("other"), "run_id")
    return [up, down]


def edges_of(spark: SparkSession, table: str, asked: DataFrame, record: str = "record_id") -> DataFrame:
    """Edges at either end of the asked records: asked, direction (derived or source), lineage_id, the other end and the run."""
    up, down = _edge_sides(spark, table, asked, record)
    return up.unionByName(down)


def edge_counts(spark: SparkSession, table: str, asked: DataFrame, record: str = "record_id") -> DataFrame:
    """Of the edges of ``edges_of`` by asked record and direction: how many, how many other ends, and the least of those.

    Either side is counted within its buckets before the two are put together, so the joined edges are not shuffled.
    """
    counted = [
        rows.groupBy("asked", "direction", "other").agg(F.count(F.lit(1)).alias("_n")).groupBy("asked", "direction").agg(F.sum("_n").alias("n"), F.count("other").alias("n_others"), F.min("other").alias("first_other"))
        for rows in _edge_sides(spark, table, asked, record)
    ]
    return counted[0].unionByName(counted[1])
