"""Property graph: nodes and edges as tables, degrees, neighbours and bounded shortest paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nodes(parts: list[DataFrame]) -> DataFrame:
    """(node_id, kind, label) from several sources, one row per node."""
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("node_id").agg(F.min("kind").alias("kind"), F.min("label").alias("label"))


def edges(parts: list[DataFrame]) -> DataFrame:
    """(edge_id, source, predicate, target, confidence in 0 to 1), one row per edge."""
    rows = reduce(DataFrame.unionByName, parts)
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.max("confidence")))
    return rows.groupBy("source", "predicate", "target").agg(clamped.alias("confidence")).withColumn("edge_id", F.concat_ws("|", "source", "predicate", "target"))


def degrees(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """All nodes with in- and out-degree; a hub's edges are counted in parts."""
    count = lambda c, name: edge_rows.groupBy(F.col(c).alias("node_id")).agg(F.count(F.lit(1)).alias(name))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return node_rows.join(count("target", "in_degree"), "node_id", "left").join(count("source", "out_degree"), "node_id", "left").select("node_id", "kind", zero("in_degree"), zero("out_degree"))


def neighbours(edge_rows: DataFrame, of: Column, predicate: str | None = None) -> DataFrame:
    """In- and out-neighbours of the nodes that ``of`` selects (a condition on node_id)."""
    rows = edge_rows.where(F.col("predicate") == predicate) if predicate else edge_rows
    out = rows.select(F.col("source").alias("node_id"), "predicate", F.col("target").alias("neighbour"), F.lit("out").alias("direction"))
    back = rows.select(F.col("target").alias("node_id"), "predicate", F.col("source").alias("neighbour"), F.lit("in").alias("direction"))
    return out.where(of).unionByName(back.where(of))


def shortest_paths(edge_rows: DataFrame, starts: DataFrame, depth: int = 6, stored=None) -> DataFrame:
    """(start, node_id, depth, path) of every node within ``depth`` steps, edges followed both ways.

    ``starts`` has node_id. Of equally short paths the smallest sequence of (predicate, edge_id) wins. A start reaches
    itself in 0 steps. ``stored`` may cut the lineage of each level, as by writing a table and reading it.
    """
    step = edge_rows.select(F.col("source").alias("at"), F.struct("predicate", "edge_id").alias("hop"), F.col("target").alias("to")).unionByName(
        edge_rows.select(F.col("target").alias("at"), F.struct("predicate", "edge_id").alias("hop"), F.col("source").alias("to"))
    )
    empty = F.array().cast("array<struct<predicate:string,edge_id:string>>")
    reached = starts.select(F.col("node_id").alias("start"), "node_id", F.lit(0).alias("depth"), empty.alias("path")).distinct()
    frontier = reached
    for level in range(1, min(depth, 6) + 1):
        found = frontier.join(step, frontier.node_id == step["at"]).select("start", F.col("to").alias("node_id"), F.concat("path", F.array("hop")).alias("path"))
        fresh = found.join(reached.select("start", "node_id"), ["start", "node_id"], "left_anti")
        frontier = fresh.groupBy("start", "node_id").agg(F.min("path").alias("path")).select("start", "node_id", F.lit(level).alias("depth"), "path")
        if stored:
            frontier = stored(frontier, "frontier")
        reached = reached.unionByName(frontier)
    return reached


def rebuild_events(before: DataFrame, after: DataFrame) -> DataFrame:
    """(edge_id, event): what a rebuild added or deactivated."""
    a, b = before.select("edge_id", F.lit(1).alias("_a")), after.select("edge_id", F.lit(1).alias("_b"))
    event = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deactivated")
    return a.join(b, "edge_id", "full").select("edge_id", event.alias("event")).where("event IS NOT NULL")


def newest_per_source(rows: DataFrame, entity: str, source: str, order: list[Column], n: int) -> DataFrame:
    """The newest ``n`` rows of every source for each entity, with the total."""
    by = Window.partitionBy(entity, source)
    return rows.withColumn("total", F.count(F.lit(1)).over(by)).withColumn("place", F.row_number().over(by.orderBy(*order))).where(F.col("place") <= n)
