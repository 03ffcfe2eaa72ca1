"""Landed payloads to rows: envelopes, header tables, named tables, features; and files of records."""

from __future__ import annotations

import hashlib
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

STRINGS = "array<string>"
TABLE = "array<array<string>>"


def records_path(df: DataFrame, payload: str, path: str, keep: list[str]) -> DataFrame:
    """One row per element of the list at a dotted or slashed path (numbers index arrays); an object is one element."""
    json_path = "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.replace("/", ".").split(".") if p)
    found = F.get_json_object(payload, json_path)
    items = F.when(found.startswith("{"), F.array(found)).otherwise(F.from_json(found, STRINGS))
    return df.select(*keep, F.posexplode(items).alias("position", "record"))


def first_list(df: DataFrame, payload: str, keys: list[str], keep: list[str]) -> DataFrame:
    """One row per element of the first list found: the payload itself, or under one of the keys."""
    whole = F.when(F.col(payload).startswith("["), F.from_json(payload, STRINGS))
    lists = [F.when(F.get_json_object(payload, f"$.{k}").startswith("["), F.from_json(F.get_json_object(payload, f"$.{k}"), STRINGS)) for k in keys]
    return df.select(*keep, F.posexplode(F.coalesce(whole, *lists)).alias("position", "record"))


def header_table(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """A list of lists whose first one names the columns: one map per further list of the same length."""
    table = df.select(*keep, F.from_json(payload, TABLE).alias("_t"))
    rows = table.select(*keep, F.get("_t", F.lit(0)).alias("_h"), F.posexplode("_t").alias("position", "_r")).where("position > 0")
    return rows.where(F.size("_r") == F.size("_h")).select(*keep, "position", F.map_from_arrays("_h", "_r").alias("record"))


def named_table(df: DataFrame, payload: str, names: str, rows: str, keep: list[str]) -> DataFrame:
    """Column names and rows under two paths; rows of another length go."""
    table = df.select(*keep, F.from_json(F.get_json_object(payload, f"$.{names}"), STRINGS).alias("_h"), F.posexplode(F.from_json(F.get_json_object(payload, f"$.{rows}"), TABLE)).alias("position", "_r"))
    return table.where(F.size("_r") == F.size("_h")).select(*keep, "position", F.map_from_arrays("_h", "_r").alias("record"))


FEATURES = "struct<features:array<struct<id:string,properties:struct<mag:double,place:string,time:bigint>,geometry:struct<coordinates:array<double>>>>>"


def feature_events(df: DataFrame, payload: str) -> DataFrame:
    """A GeoJSON collection to one row per event: time from epoch milliseconds, longitude, latitude, depth."""
    f = df.select(F.explode(F.from_json(payload, FEATURES)["features"]).alias("f"))
    at = lambda i: F.get(F.col("f.geometry.coordinates"), F.lit(i))
    return f.select(F.col("f.id").alias("event"), F.col("f.properties.mag").alias("magnitude"), F.col("f.properties.place").alias("place"), F.timestamp_millis("f.properties.time").alias("time"), at(0).alias("longitude"), at(1).alias("latitude"), at(2).alias("depth"))


def page_audit(pages: DataFrame, run: str, order: str, payload: str) -> DataFrame:
    """Pages, bytes, a hash of all page hashes in order, and the last page's length, per run.

    Missing places come last, and pages of one place are ordered by their hashes. Only hashes and lengths are dealt by run
    and sorted; they are read in order, batch by batch, so that no task holds a run.
    """
    hashed = pages.select(F.col(run), F.col(order).alias("place"), F.sha2(payload, 256).alias("hash"), F.octet_length(payload).alias("bytes"), F.length(payload).alias("length"))
    ordered = hashed.repartition(run).sortWithinPartitions(run, F.col("place").asc_nulls_last(), "hash")
    return ordered.select(run, "hash", "bytes", "length").mapInArrow(_audited, StructType([pages.schema[run], *_AUDIT]))


_AUDIT = StructType().add("n_pages", "long").add("n_bytes", "long").add("payload_sha256", "string").add("last_length", "integer")


def _audited(batches):
    """One row for each run of (run, hash, bytes, length), whose rows follow one another; missing payloads add nothing."""
    run, n, size, digest, last = None, 0, 0, hashlib.sha256(), 0

    def row(key):
        columns = zip((run, n, size, digest.hexdigest(), last), (key.type, pa.int64(), pa.int64(), pa.string(), pa.int32()), strict=True)
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in columns], names=[key.name, *_AUDIT.names])

    for batch in batches:
        key = batch.schema.field(0)
        for name, rows in groupby(zip(*(c.to_pylist() for c in batch.columns), strict=True), itemgetter(0)):
            if n and name != run:
                yield row(key)
                n, size, digest = 0, 0, hashlib.sha256()
            _, hashes, sizes, lengths = zip(*rows, strict=True)
            run, n, size, last = name, n + len(hashes), size + sum(filter(None, sizes)), lengths[-1]
            digest.update("".join(filter(None, hashes)).encode())
    if n:
        yield row(key)


def to_observations(rows: DataFrame, provider: str, dataset: str, geography: Column, period: Column, metrics: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """Wide to long: one observation per row and metric, null values left out."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric_code"), v.cast("double").alias("value_numeric")) for m, v in metrics.items()))
    return rows.select(F.lit(provider).alias("provider"), F.lit(dataset).alias("dataset"), geography.cast("string").alias("geography_id"), period.alias("period"), *(keep or []), F.inline(pairs)).where("value_numeric IS NOT NULL")


def mapped(rows: DataFrame, spec: dict[str, dict], source: str) -> DataFrame:
    """Config-driven mapping of a map column: per target its source key, default, transforms and whether it is required.

    Adds ``errors``: required targets that came out empty, and targets whose value a transform could not take.
    """
    from attesta.functions.derive import transformed

    columns, failed = {}, []
    for target, rule in spec.items():
        value = F.try_element_at(F.col(source), F.lit(rule["source"])) if "source" in rule else F.lit(rule.get("constant")).cast("string")
        if "default" in rule:
            value = F.when(F.coalesce(F.trim(value), F.lit("")) == "", F.lit(str(rule["default"]))).otherwise(value)
        columns[target] = transformed(value, rule.get("transforms", ()))
        failed.append(F.when((F.coalesce(F.trim(value), F.lit("")) != "") & columns[target].isNull(), f"{target} cannot be transformed"))
    empty = [F.when(F.coalesce(F.trim(columns[t]), F.lit("")) == "", f"{t} is required") for t, r in spec.items() if r.get("required")]
    errors = F.array_compact(F.array(*failed, *empty).cast("array<string>"))
    return rows.withColumns(columns | {"errors": errors})


def read_records_csv(spark: SparkSession, path: str) -> DataFrame:
    """Flat authoring rows as text; a byte-order mark before the header is ignored."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    first = rows.columns[0]
    return rows.withColumnRenamed(first, first.lstrip("﻿"))


def read_records_json(spark: SparkSession, path: str) -> DataFrame:
    """An object, an array of objects, or an envelope with ``records``."""
    rows = spark.read.json(path, multiLine=True)
    return rows.select(F.explode("records").alias("r")).select("r.*") if rows.columns == ["records"] else rows


def csv_to_record(rows: DataFrame) -> DataFrame:
    """Flat authoring columns to the nested shape; lists are split at bars, missing optional columns are null."""
    from attesta.functions.derive import text_list

    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    required = ("entity_name", "indicator_name", "period_label", "current", "source_name", "confidence")
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"missing columns: {missing}")
    return rows.select(
        F.struct(F.col("entity_name").alias("name"), has("entity_type").alias("type")).alias("entity"),
        F.struct(F.col("indicator_name").alias("name"), has("unit").alias("unit"), has("direction").alias("direction"), has("framework").alias("framework")).alias("indicator"),
        F.struct(F.col("period_label").alias("label"), has("start_date").alias("start_date"), has("end_date").alias("end_date")).alias("period"),
        F.struct(has("baseline").try_cast("double").alias("baseline"), F.col("current").try_cast("double").alias("current")).alias("values"),
        F.struct(F.col("source_name").alias("name"), has("source_url").alias("url"), has("license").alias("license")).alias("source"),
        F.struct(F.col("confidence").try_cast("double").alias("score"), has("confidence_basis").alias("basis")).alias("confidence"),
        F.struct(has("method_notes").alias("notes"), text_list(has("assumptions")).alias("assumptions"), text_list(has("limitations")).alias("limitations")).alias("method"),
    )
