"""Continuous ingestion with Structured Streaming: idempotent upserts, duplicate suppression, late rows flagged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attesta.sources import versions


def merged(state: DataFrame | None, batch: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of every key over state and batch."""
    rows = batch if state is None else state.unionByName(batch)
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, F.to_json(F.struct(*rest)))).alias("_row")).select(key, "_row.*")


def _numbered(spark: SparkSession, path: str, kind: str) -> dict[int, str]:
    """Committed folders of a kind by their number."""
    return {int(name.split("=")[1]): name for name in versions.committed(spark, path) if name.startswith(f"{kind}=")}


def write_delta(batch: DataFrame, path: str, number: int, key: str, order: str) -> bool:
    """Writes the last row of every key of a batch, and nothing of the state; a batch that was written is not again."""
    return versions.write_once(merged(None, batch, key, order), path, f"delta={number:012d}")


def state_of(spark: SparkSession, path: str, key: str, order: str) -> tuple[int, DataFrame | None]:
    """The number of the last batch, and the last row of every key over the newest base and the deltas after it."""
    bases, deltas = _numbered(spark, path, "base"), _numbered(spark, path, "delta")
    base = max(bases, default=-1)
    later = [name for number, name in sorted(deltas.items()) if number > base]
    names = ([bases[base]] if bases else []) + later
    if not names:
        return -1, None
    rows = spark.read.parquet(*(f"{path}/{n}" for n in names))
    return max([base, *deltas]), merged(None, rows, key, order) if later else rows


def compact(spark: SparkSession, path: str, key: str, order: str, share: float = 1.0) -> bool:
    """Folds the deltas into a new base once they hold ``share`` of the base's rows; what they replace is removed.

    So all compactions together write a constant times what came in. The base before stays for readers that have begun.
    """
    bases, deltas = _numbered(spark, path, "base"), _numbered(spark, path, "delta")
    base = max(bases, default=-1)
    later = {n: name for n, name in deltas.items() if n > base}
    if not later:
        return False
    waiting = spark.read.parquet(*(f"{path}/{name}" for name in later.values())).count()
    if bases and waiting < share * spark.read.parquet(f"{path}/{bases[base]}").count():
        return False
    number, state = state_of(spark, path, key, order)
    versions.write_once(state, path, f"base={number:012d}")
    for n, name in [*bases.items(), *deltas.items()]:
        if n < base or (name in deltas.values() and n <= base):
            versions.remove(spark, f"{path}/{name}")
    return True


def continuous_upsert(source: DataFrame, path: str, checkpoint: str, key: str, order: str) -> StreamingQuery:
    """Writes every micro-batch as a delta, so bytes written follow the batch, and compacts when the deltas have grown.

    A batch that is run again finds its delta and writes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        write_delta(batch, path, number, key, order)
        compact(batch.sparkSession, path, key, order)

    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def without_repeats(source: DataFrame, stamp: str, columns: list[str], delay: str = "1 hour") -> DataFrame:
    """Drops rows whose columns were seen within the watermark's delay."""
    return source.withWatermark(stamp, delay).dropDuplicatesWithinWatermark(columns)


def flag_late(source: DataFrame, event: str, arrived: str, sla_seconds: int) -> DataFrame:
    """Adds ``late`` instead of dropping what came after the agreed delay."""
    delay = F.unix_seconds(F.col(arrived).cast("timestamp")) - F.unix_seconds(F.col(event).cast("timestamp"))
    return source.withColumn("late", F.coalesce(delay > sla_seconds, F.lit(True)))
