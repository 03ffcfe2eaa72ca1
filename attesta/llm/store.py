"""Intermediate tables in the folder that driver and executors share.

Work that is used twice, and the state of iterative jobs, is written as Parquet below ``spark.checkpoint.dir`` and read
back. That cuts the lineage, so a lost executor costs a reread and never a recomputation of earlier rounds.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode, where there is one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="attesta-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Rows of an Arrow batch in what is stored; a batch is held by the JVM and by a Python worker at once.
ARROW_ROWS = 1000
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and returns what was written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_ARROW)
    spark.conf.set(_ARROW, min(int(before), ARROW_ROWS) if int(before) > 0 else ARROW_ROWS)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_ARROW, before)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A group is hot if it holds more than 1 / HOT_SHARE of all rows, so there are fewer than HOT_SHARE hot groups.
HOT_SHARE = 1000


def attach_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Left join of rows to one row per group, where a group may hold any share of all rows.

    ``groups`` has ``keys``, ``size`` (the rows of the group) and what is to be attached; ``total`` is the sum of all
    sizes. Fewer than HOT_SHARE groups can be hot, so these are broadcast; every other group is small enough for the
    shuffled join. ``groups`` should be a stored table, since it is read twice.
    """
    extra = [c for c in groups.columns if c not in keys]
    hot = groups.where(F.col(size) * HOT_SHARE > F.lit(total))
    cold = groups.where(F.col(size) * HOT_SHARE <= F.lit(total))
    first = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    done = first.where("_hot").drop("_hot")
    rest = first.where("_hot IS NULL").drop("_hot", *extra).join(cold, keys, "left")
    return done.unionByName(rest)


#: Keys of rows are broadcast up to this number (16 bytes each), and shuffled beyond it.
BROADCAST_IDS = 200_000


def small_enough(ids: DataFrame) -> DataFrame:
    """A stored table of keys, with a broadcast hint if its counted size allows that."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def settled(docs: DataFrame, decided: DataFrame, once: bool = False) -> DataFrame:
    """The rows of ``docs`` that stay, by (doc_id, text_key, stays) of every row.

    A row is known by its identifier (null is one, too) and a hash of its text, so rows that share an identifier are told
    apart. Rows that agree in both share their fate; if only some of them stay, or with ``once``, one does. All columns
    of ``docs`` are kept, whatever their names.
    """
    fates = decided.groupBy("doc_id", "text_key").agg(F.max("stays").alias("stays"), F.min("stays").alias("all_stay"), F.count(F.lit(1)).alias("n"))
    fates = stored(fates.where("NOT all_stay OR n > 1" if once else "NOT all_stay").select("doc_id", "text_key", "stays"), "fates")
    d, f = docs.alias("d"), small_enough(fates).alias("f")
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("f.doc_id")) & (F.xxhash64(F.col("d.text")) == F.col("f.text_key"))
    rest = d.join(f, same, "left_anti")
    some = fates.where("stays")
    if not some.limit(1).count():
        return rest
    return rest.unionByName(d.join(small_enough(some).alias("f"), same, "left_semi").dropDuplicates(["doc_id", "text"]))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))
