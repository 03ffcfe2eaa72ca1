"""Sinks: flat and JSON exports, run bundles with a manifest, and JSON-LD lines of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.operators.access import manifest


def flatten_records(records: DataFrame, separator: str = " | ") -> DataFrame:
    """Nested records as flat columns: structs by their path, lists of text joined with their counts, the rest as JSON."""
    out = []

    def visit(column, name, kind):
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                visit(column[f.name], f"{name}_{f.name}", f.dataType)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            out.extend([F.array_join(column, separator).alias(name), F.size(F.coalesce(column, F.array().cast("array<string>"))).alias(f"{name}_count")])
        elif isinstance(kind, (T.ArrayType, T.MapType)):
            out.append(F.to_json(column).alias(f"{name}_json"))
        else:
            out.append(column.alias(name))

    for field in records.schema.fields:
        visit(F.col(field.name), field.name, field.dataType)
    return records.select(*out)


def export_records(records: DataFrame, path: str, kind: str) -> None:
    """Writes Parquet or JSON as is, CSV flat."""
    if kind == "csv":
        flatten_records(records).write.csv(path, header=True, escape='"')
    elif kind in ("json", "parquet"):
        getattr(records.write, kind)(path)
    else:
        raise ValueError(f"unknown export: {kind}")


def export_bundle(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes every table of a run below ``path`` and a manifest of their row counts and order-free hashes."""
    parts = None
    for name, df in sorted(tables.items()):
        df.write.parquet(f"{path}/{name}")
        own = manifest(df.sparkSession.read.parquet(f"{path}/{name}").withColumn("table", F.lit(name)), ["table"], sorted(df.columns))
        parts = own if parts is None else parts.unionByName(own)
    parts.write.json(f"{path}/manifest")
    return parts


def jsonld_lines(nodes: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """(id, line) of at most ``limit`` nodes and as many edges in JSON-LD shape, with a flag for what was cut."""
    shape = lambda df, id_col, **fields: df.orderBy(id_col).limit(limit + 1).select(F.col(id_col).alias("id"), F.to_json(F.struct(F.col(id_col).alias("@id"), *(F.col(c).alias(f"{name}") for name, c in fields.items()))).alias("line"))
    rows = shape(nodes, "node_id", type="kind", label="label").withColumn("part", F.lit("node")).unionByName(shape(edges, "edge_id", subject="source", predicate="predicate", object="target").withColumn("part", F.lit("edge")))
    from pyspark.sql import Window

    by = Window.partitionBy("part")
    numbered = rows.withColumn("truncated", F.count(F.lit(1)).over(by) > limit).withColumn("n", F.row_number().over(by.orderBy("id")))
    return numbered.where(F.col("n") <= limit).drop("n")
