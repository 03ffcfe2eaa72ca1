"""Folders of written versions: every version is one Spark job's output and counts once the job has committed it.

A version is complete when Spark has left its success marker; what lacks the marker is invisible to readers and is
overwritten by a retry. So writing is repeatable, nothing is renamed, and any store that Spark writes to will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MARKER = "_SUCCESS"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    store, place = _place(spark, path)
    return store.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    store, place = _place(spark, path)
    store.delete(place, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder; none if it does not exist."""
    store, place = _place(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(place)) if store.exists(place) else []


def modified(spark: SparkSession, path: str) -> dict[str, int]:
    """Time of every file below a folder, by its path from there."""
    store, place = _place(spark, path)
    found, files = {}, store.listFiles(place, True)
    base = store.makeQualified(place).toString()
    while files.hasNext():
        f = files.next()
        name = f.getPath().toString()[len(base) + 1 :]
        if not name.rsplit("/", 1)[-1].startswith(("_", ".")):
            found[name] = f.getModificationTime()
    return found


def committed(spark: SparkSession, folder: str) -> list[str]:
    return [name for name in children(spark, folder) if exists(spark, f"{folder}/{name}/{MARKER}")]


def write_once(df: DataFrame, folder: str, version: str) -> bool:
    """Writes a version unless it is there already; tells whether it wrote."""
    path = f"{folder}/{version}"
    if exists(df.sparkSession, f"{path}/{MARKER}"):
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def read(spark: SparkSession, folder: str, versions: list[str] | None = None) -> DataFrame | None:
    """All rows of committed versions (or of the named ones); None if there are none."""
    names = [v for v in committed(spark, folder) if versions is None or v in versions]
    return spark.read.parquet(*(f"{folder}/{v}" for v in names)) if names else None
