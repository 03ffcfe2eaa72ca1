"""Exact deduplication: sorted digest runs merged in rounds, the kept identifier verified at every level.

Each input partition becomes a run of (digest, identifier, count) entries, already reduced to one entry per text, so that
a text that fills a third of the table costs one entry per partition. Runs are then merged ``fan_in`` at a time, round
after round, until one is left: in round r the runs whose numbers agree but for their last r digits exchange their
entries by digest, and a task merges its stretch of them in sorted order. Entries of one text come to stand together, at
most one of each merging run; the first of them, which has the identifier that stays, is retained with the sum of their
counts. Digests count as equal only if a second hash and the length verify it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import attach_groups, read_table, settled, stored, text_or_empty

RUNS = 16
FAN_IN = 4


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its run, its SHA-256 digest, a second hash that verifies it, and a key of the stored text."""
    text = text_or_empty(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text_col).alias("text_key"),
        (F.spark_partition_id() % RUNS).alias("run"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.xxhash64(text, F.length(text)).alias("check"),
    )


def merge_runs(rows: DataFrame, keep: str = "max", runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """Merges the runs of ``digest_rows`` into one: (digest, check, keep_id, group_size).

    Equal digests with different check hashes would stay apart, so no text can stand in for another. ``keep`` is
    ``max`` or ``min``. Null identifiers count as rows and lose against any other.
    """
    best = {"max": F.max, "min": F.min}[keep]
    merged = rows.groupBy("run", "digest", "check").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    first = F.col("keep_id").desc_nulls_last() if keep == "max" else F.col("keep_id").asc_nulls_last()
    while runs > 1:
        merged = merged.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        together = Window.partitionBy("run", "digest", "check").orderBy(first)
        whole = together.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        merged = merged.select("run", "digest", "check", "keep_id", F.sum("group_size").over(whole).alias("group_size"), F.row_number().over(together).alias("place")).where("place = 1").drop("place")
        runs = -(-runs // fan_in)
    return merged.drop("run")


def exact_rows(docs: DataFrame, keep: str = "max", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, digest, keep_id, group_size and stays of every row."""
    rows = stored(digest_rows(docs, id_col, text_col), "digests")
    groups = stored(merge_runs(rows, keep).where("group_size > 1"), "groups")
    joined = attach_groups(rows, groups, ["digest", "check"], "group_size", rows.count())
    alone = F.col("group_size").isNull()
    stays = alone | F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return joined.select("doc_id", "text_key", "digest", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), stays.alias("stays"))


def exact_groups(docs: DataFrame, keep: str = "max", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with the identifier that stays of its equal texts.

    Null text counts as empty; texts are compared unchanged. Rows that repeat an identifier are rows like others: each
    is returned, and counts in ``group_size``. A null identifier stays only where its texts have no other. No rows give
    no rows; other columns of ``docs`` are ignored.
    """
    return exact_rows(docs, keep, id_col, text_col).select("doc_id", "keep_id", "group_size", F.col("stays").alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, keep: str = "max") -> DataFrame:
    """The documents that stay, with all their columns; of rows that repeat both identifier and text one stays.

    Null and empty texts are equal texts; of a group with null identifiers only, one row stays. Rows that share an
    identifier but no text are decided each by its own.
    """
    return settled(docs, exact_rows(docs, keep), once=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       coalesce(doc_id = max(doc_id) OVER w, max(doc_id) OVER w IS NULL) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
