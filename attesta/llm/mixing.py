"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Every source has a weight; targets share the wanted total by weight. A source whose share exceeds ``max_epochs`` times
its own size is clamped there and the excess goes to the others by weight, until none is above. That fixed point has a
closed form: with sources ordered by size / weight, the water level is the largest (total - clamped sizes) / (weights
left) that does not drown the next source.

A source then repeats every document floor(target / size) times, and the fraction that is left is filled with its
documents in the order of a seeded hash. The order is cut in two steps, so that no source is ever sorted as a whole:
sums of hash bins (at most ``BINS`` per source) find the bin where the fraction ends, and only that bin is ordered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import attach_groups, read_table, stored, text_or_empty

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
BINS = 4096
SEED = "mix-1"
#: Sources whose plans (about 100 bytes each) are broadcast.
BROADCAST_SOURCES = 20_000


WORD = r"[^\x20\x09-\x0D]"


def word_count(column: str = "text") -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.regexp_count(text_or_empty(column), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _measured(docs: DataFrame, row: Column, seed: str = SEED) -> DataFrame:
    """``row`` of every document with its source (missing, name), its size in words, and its place in the seeded order."""
    order = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 15), 16, 10).cast("long")
    source = F.col("source").cast("string")
    named = docs.select(row.alias("row"), source.isNull().alias("missing"), F.coalesce(source, F.lit("")).alias("name"), F.col("text").rlike(WORD).alias("some"), word_count().alias("size"), order.alias("order"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("tie"))
    return named.withColumn("bin", F.floor(F.col("order") / (2**60 // BINS)).cast("int"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS, total: float | None = None) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row per source.

    Sources by code point take the weights in turn, null last. ``total`` is the wanted number of words, by default the
    sum of all sizes. If even ``max_epochs`` of everything falls short of it, every source is clamped.
    """
    names = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(names) - 1) % len(weights) + 1)
    weighted = sizes.withColumn("w", turn).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    wanted = F.lit(float(total)) if total is not None else F.sum("source_size").over(Window.partitionBy()).cast("double")
    level = (wanted - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    levels = weighted.withColumn("level", level).withColumn("level", F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level")))
    return levels.withColumn("water", F.coalesce(F.max("level").over(Window.partitionBy()), F.lit(float("inf")))).select(
        "source", "source_size", F.round(F.least("cap", F.col("w") * F.col("water")), 6).alias("target")
    )


def _plan(measured: DataFrame, weights, max_epochs: float, total: float | None) -> DataFrame:
    """One row per source, written: what a document's repetitions follow from."""
    key = ["missing", "name"]
    bins = stored(measured.groupBy(*key, "bin").agg(F.sum("size").alias("bin_size"), F.count(F.lit(1)).alias("bin_rows")), "bins")
    sizes = bins.groupBy(*key).agg(F.sum("bin_size").alias("source_size")).select(F.when(~F.col("missing"), F.col("name")).alias("source"), "source_size")
    rows = bins.groupBy(*key).agg(F.sum("bin_rows").alias("source_rows"))
    targets = source_targets(sizes, weights, max_epochs, total).withColumns({"missing": F.col("source").isNull(), "name": F.coalesce("source", F.lit(""))}).drop("source")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = stored(targets.join(rows, key).withColumn("whole", whole).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    before = Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        bins.withColumn("base", F.coalesce(F.sum("bin_size").over(before), F.lit(0)))
        .join(targets, key)
        .where((F.col("base") <= F.col("left")) & (F.col("base") + F.col("bin_size") > F.col("left")))
        .select(*key, F.col("bin").alias("cut_bin"), F.col("base").alias("cut_base"))
    )
    return stored(targets.join(cut, key, "left"), "plan")


def _dealt(measured: DataFrame, plan: DataFrame, max_epochs: float) -> DataFrame:
    """``measured`` with its source's plan and ``times``, how often the mix takes the row.

    The plan is broadcast where it is counted to be small; otherwise only the plans of hot sources are.
    """
    key = ["missing", "name"]
    if plan.count() <= BROADCAST_SOURCES:
        joined = measured.join(F.broadcast(plan), key)
    else:
        joined = attach_groups(measured, plan, key, "source_rows", plan.agg(F.sum("source_rows")).first()[0] or 0)
    inside = joined.where(F.col("bin") == F.col("cut_bin"))
    outside = joined.where(F.col("cut_bin").isNull() | (F.col("bin") != F.col("cut_bin")))
    order = Window.partitionBy(*key).orderBy("order", "id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.col("cut_base") + F.coalesce(F.sum("size").over(order), F.lit(0))
    inside = inside.withColumn("extra", ((2 * reached + F.col("size") <= 2 * F.col("left")) & (F.col("size") > 0)).cast("int"))
    below = F.when(F.col("cut_bin").isNull(), F.col("left") > 0).otherwise(F.col("bin") < F.col("cut_bin"))
    outside = outside.withColumn("extra", (below & F.coalesce("some", F.lit(False))).cast("int"))
    return outside.unionByName(inside).withColumn("times", F.least(F.col("whole") + F.col("extra"), F.lit(math.ceil(max_epochs)).cast("long")))


def repetitions(docs: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS, total: float | None = None, seed: str = SEED) -> DataFrame:
    """Every row of ``docs`` with how often the mix takes it.

    Returns doc_id, source, size, source_size, target and times (0 to ``max_epochs``, rounded up where it is a fraction). Null text and text without words
    have size 0 and are never taken in a fraction. Null sources form one source. The order is by a hash of the
    identifier, then of the text, so reruns and other partitionings give the same mix; rows that repeat an identifier, or
    have none, are ordered next to each other and decided each. No rows give no rows; other columns are ignored.
    """
    measured = stored(_measured(docs, F.struct(F.col("doc_id")), seed), "sized")
    dealt = _dealt(measured, _plan(measured, weights, max_epochs, total), max_epochs)
    return dealt.select("row.doc_id", F.when(~F.col("missing"), F.col("name")).alias("source"), "size", "source_size", "target", "times")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = repetitions(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS, total: float | None = None, seed: str = SEED) -> DataFrame:
    """``docs`` with every row repeated as the mix takes it, see ``repetitions``; rows taken 0 times go.

    Whole rows are carried along, so null or repeated identifiers and columns of any name come through.
    """
    measured = _measured(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)), seed)
    dealt = _dealt(measured, _plan(measured, weights, max_epochs, total), max_epochs)
    return dealt.where("times > 0").select("row", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))).select("row.*")


SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{SEED}'), 1, 15) AS BIGINT) AS ord
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         source_size * 3.0::DOUBLE AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM sizes),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted),
water AS (SELECT max(level) AS water FROM levels WHERE level <= cap / w),
targets AS (
  SELECT source, source_size, round(least(cap, w * coalesce((SELECT water FROM water), 'inf'::DOUBLE)), 6) AS target FROM levels),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
placed AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS lft,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached
  FROM sized d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(least(whole + CASE WHEN 2 * reached + size <= 2 * lft AND size > 0 THEN 1 ELSE 0 END, 3) * size AS BIGINT) AS taken
FROM placed
"""
