"""Dataset catalog: one entry per series of every feed, rebuilt by aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import derive


def series_profile(rows: DataFrame, provider: str, keys: list[str], period: str, stamp: str) -> DataFrame:
    """(provider, dataset_key, n_rows, first and last period, latest stamp) of every series."""
    key = F.concat_ws("/", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    return rows.groupBy(F.lit(provider).alias("provider"), key.alias("dataset_key")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(F.col(period).cast("string")).alias("first_period"), F.max(F.col(period).cast("string")).alias("last_period"), F.max(stamp).alias("latest")
    )


def with_empty_series(metadata: DataFrame, profile: DataFrame) -> DataFrame:
    """Known series without observations stay, with a count of 0."""
    return metadata.join(profile, ["provider", "dataset_key"], "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0).cast("long")))


def entries(profiles: list[DataFrame], as_of: Column) -> DataFrame:
    """The catalog: an id, freshness and sorted tags for every series."""
    rows = reduce(DataFrame.unionByName, profiles)
    tags = F.array_sort(F.array_distinct(F.transform(F.split(F.concat_ws("/", "provider", "dataset_key"), "/"), lambda t: F.lower(F.trim(t)))))
    return rows.withColumns({"entry_id": derive.short_id("dataset", F.col("provider"), F.col("dataset_key")), "freshness": derive.freshness(F.col("latest"), as_of), "tags": F.array_join(tags, ",")})


def sync(previous: DataFrame, derived: DataFrame, key: str, now: Column) -> DataFrame:
    """Rebuild of an active flag: what was derived is active, what wasn't stays inactive; first_seen is kept."""
    old = previous.select(key, F.col("first_seen").alias("_first"))
    new = derived.select(key, F.lit(True).alias("_now"))
    return old.join(new, key, "full").select(key, F.coalesce("_now", F.lit(False)).alias("active"), F.coalesce("_first", now).alias("first_seen"))


def order_free_digest(rows: DataFrame, key: str) -> DataFrame:
    """(n, digest): a hash of a set of ids in any order, from sums of their hashes, so that no task holds all ids."""
    part = lambda i: F.sum(F.conv(F.substring(F.sha2(key, 256), 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws(",", *(F.coalesce(part(i), F.lit("0")) for i in range(3))), 256).alias("digest"))


def search(rows: DataFrame, columns: list[str], text: str, equal: dict[str, object] | None = None) -> DataFrame:
    """Rows with a literal text in any of the columns, without regard to case."""
    found = reduce(Column.__or__, (F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(text.lower())) for c in columns))
    for name, value in (equal or {}).items():
        found = found & (F.col(name) == value)
    return rows.where(found)


def page(rows: DataFrame, order: list[Column], limit: int, offset: int, most: int = 500) -> DataFrame:
    """A page; the limit is clamped to 1 and ``most``, the offset to 0."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), most))
