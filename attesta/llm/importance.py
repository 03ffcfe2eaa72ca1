"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Texts are cut into words and signs; unigrams and bigrams are hashed into ``BUCKETS`` buckets, a word that repeats the one
before it counting as one common symbol. The raw model is fitted on all documents, the target model on labelled good
ones. A document's log importance weight is the sum of log(target / raw) over its n-grams, scaled down to ``SPAN`` n-grams
where it has more: n-grams of one document are no independent draws, and unscaled sums grow with the length until no
noise matters. Adding standard Gumbel noise, seeded by identifier and text, and keeping the k largest samples k documents
without replacement in proportion to their weights.

How many are kept is a parameter (``k``, or ``share`` of all rows). By default it is the estimated mass of the target in
the raw text: with labelled bad documents the number of good ones among all documents, by a logistic curve of the mean log
ratio fitted on the labelled ones with balanced classes, whose prior expectation maximisation then fits to all documents;
without them the sum of min(1, weight).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import read_table, settled, stored
from .textvec import buffers, mix64, slices, word_hashes

BUCKETS = 1 << 14
#: N-grams that a document counts for, at most.
SPAN = 40
#: Labelled documents of either kind that are learned from, at most; those with the smallest hashed identifiers.
TARGET_ROWS = 20_000
SEED = 1
#: Ranges that keys are counted in at once, and rows of a range that are ordered.
BINS, EDGE = 4096, 10_000

_REPEAT = np.uint64(0x5851F42D4C957F2D)


def _buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows and buckets of all unigrams, rows and buckets of all bigrams."""
    words, starts = word_hashes(*buffers(column), punctuation=True)
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    inside = row[1:] == row[:-1]
    unigram = words.copy()
    unigram[1:][inside & (words[1:] == words[:-1])] = _REPEAT
    bigram = mix64(unigram[:-1] * np.uint64(3) + unigram[1:] * np.uint64(7919))[inside]
    return row, (unigram % np.uint64(BUCKETS)).astype(np.int64), row[1:][inside], (bigram % np.uint64(BUCKETS)).astype(np.int64)


def ngram_counts(docs: DataFrame) -> DataFrame:
    """(gram, bucket, raw, target) over all rows of (text, target): counts of each kind of n-gram."""

    def work(batches):
        counts = np.zeros((2, 2, BUCKETS))
        for batch in slices(batches):
            good = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
            row1, one, row2, two = _buckets(batch.column(0))
            for gram, (row, bucket) in enumerate(((row1, one), (row2, two))):
                counts[gram, 0] += np.bincount(bucket, minlength=BUCKETS)
                counts[gram, 1] += np.bincount(bucket[good[row]], minlength=BUCKETS)
        gram, bucket = np.nonzero(counts[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int32)), pa.array(bucket.astype(np.int32)), *(pa.array(counts[gram, k, bucket].astype(np.int64)) for k in (0, 1))], names=["gram", "bucket", "raw", "target"])

    parts = docs.select("text", "target").mapInArrow(work, "gram int, bucket int, raw long, target long")
    return parts.groupBy("gram", "bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """log(target / raw) of every bucket, add-one smoothed; the counts are at most 2 x BUCKETS rows."""
    table = np.zeros((2, 2, BUCKETS))
    for r in counts.toLocalIterator():
        table[r.gram, :, r.bucket] = r.raw, r.target
    table += 1
    logs = np.log(table / table.sum(axis=2, keepdims=True))
    return logs[:, 1] - logs[:, 0]


def _scorer(ratios: np.ndarray) -> Callable:
    """Sums of log ratios and numbers of n-grams."""

    def work(batches):
        for batch in slices(batches):
            row1, one, row2, two = _buckets(batch.column(2))
            n = batch.num_rows
            total = np.bincount(row1, ratios[0][one], minlength=n) + np.bincount(row2, ratios[1][two], minlength=n)
            grams = np.bincount(row1, minlength=n) + np.bincount(row2, minlength=n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total.astype(float)), pa.array(grams.astype(np.int64))], names=["doc_id", "text_key", "total", "grams"])

    return work


def gumbel(seed: int, *of: str) -> Column:
    """Standard Gumbel noise that depends on the named columns and the seed alone."""
    unit = (F.shiftrightunsigned(F.xxhash64(*of, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(unit))


def top_k(keys: DataFrame, k: int) -> DataFrame:
    """``keys`` with ``kept`` for the k largest values of ``key``; rows of the k-th key share their fate.

    Counts of BINS equal ranges find the one where the k-th key lies, and it is divided again until it holds at most EDGE
    rows, which are ordered, or a single value; so no task orders more.
    """
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k <= 0 or k >= n:
        return keys.withColumn("kept", F.lit(k > 0) & F.col("key").isNotNull())
    left = k  # the rank of the wanted key within the range
    while n > EDGE and low < high:
        width = (high - low) / BINS
        place = F.least(F.floor((F.col("key") - low) / F.lit(width)), F.lit(BINS - 1)) if width > 0 else F.lit(0)
        inside = keys.where(F.col("key").between(low, high)).groupBy(place.alias("bin"))
        found = sorted(inside.agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("key").alias("n")).collect(), key=lambda r: -r.low)
        for r in found:  # at most BINS rows
            low, high, n = r.low, r.high, r.n
            if left <= n:
                break
            left -= n
    line = low if low == high else keys.where(F.col("key").between(low, high)).orderBy(F.desc("key")).offset(left - 1).limit(1).first().key
    return keys.withColumn("kept", F.coalesce(F.col("key") >= line, F.lit(False)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-6) -> tuple[float, float]:
    """Slope and offset of P(y | x), classes balanced, by Newton's method with a small ridge on the standardised slope."""
    centre, scale = x.mean(), max(x.std(), 1e-9)
    z = np.stack([(x - centre) / scale, np.ones(len(x))], axis=1)
    weight = np.where(y, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z / len(x) + ridge * np.eye(2), z.T @ (weight * (p - y)) / len(x) + ridge * w)
        w -= np.clip(step, -5, 5)
    return float(w[0] / scale), float(w[1] - w[0] * centre / scale)


def prior(logits: np.ndarray, n: np.ndarray, rounds: int = 200) -> float:
    """The share of the target among ``n`` rows by balanced logit: expectation maximisation of the prior alone."""
    if not n.sum():
        return 0.0
    share = 0.5
    for _ in range(rounds):
        odds = np.exp(logits) * share / (1 - share)
        share = float(np.clip((n * (odds / (1 + odds))).sum() / n.sum(), 1e-9, 1 - 1e-9))
    return share


def _some(ids: DataFrame, rows: int) -> DataFrame:
    return ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def target_mass(scored: DataFrame, good: DataFrame, bad: DataFrame | None) -> int:
    """How many of the rows of (doc_id, total, grams, log_weight) the target accounts for; good and bad are bounded."""
    mean = F.col("total") / F.greatest("grams", F.lit(1))
    if bad is not None:
        marks = good.withColumn("good", F.lit(True)).unionByName(bad.join(good, "doc_id", "left_anti").withColumn("good", F.lit(False)))
        known = scored.where("grams > 0").join(F.broadcast(marks), "doc_id").groupBy("doc_id", "good").agg(F.min(mean).alias("mean")).orderBy("doc_id").toPandas()
        if known.good.nunique() == 2:
            slope, offset = logistic(known["mean"].to_numpy(), known.good.to_numpy(bool))
            logit = F.when(F.col("grams") > 0, F.round(16 * F.greatest(F.lit(-30.0), F.least(F.lit(30.0), mean * slope + offset)))).cast("int")
            bins = scored.groupBy(logit.alias("logit")).agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most 962 rows
            spoken = bins[bins.logit.notna()].sort_values("logit")
            share = prior(spoken.logit.to_numpy(float) / 16, spoken.n.to_numpy(float))
            return round(share * spoken.n.sum()) + int(bins.n[bins.logit.isna()].sum())
    return round(scored.agg(F.sum(F.least(F.lit(1.0), F.exp("log_weight")))).first()[0] or 0)


def weights(docs: DataFrame, good: DataFrame) -> DataFrame:
    """(doc_id, text_key, total, grams, log_weight) of every row, written; ``good`` is bounded."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text"))
    marked = rows.join(F.broadcast(good.withColumn("target", F.lit(True))), "doc_id", "left").withColumn("target", F.coalesce("target", F.lit(False)))
    counts = stored(ngram_counts(marked), "ngrams")
    ratios = log_ratios(counts)
    if not counts.where("target > 0").limit(1).count():
        ratios[:] = 0
    scored = rows.mapInArrow(_scorer(ratios), "doc_id long, text_key long, total double, grams long")
    return stored(scored.withColumn("log_weight", F.col("total") * F.least(F.lit(1.0), F.lit(float(SPAN)) / F.greatest("grams", F.lit(1)))), "weights")


def sampled(docs: DataFrame, good: DataFrame, bad: DataFrame | None = None, k: int | None = None, share: float | None = None, seed: int = SEED, target_rows: int = TARGET_ROWS) -> DataFrame:
    """doc_id, text_key, log_weight and kept of every row of ``docs``."""
    good = stored(_some(good, target_rows), "good")
    bad = None if bad is None else stored(_some(bad, target_rows), "bad")
    scored = weights(docs, good)
    if k is None:
        k = target_mass(scored, good, bad) if share is None else round(share * scored.count())
    return top_k(scored.withColumn("key", F.col("log_weight") + gumbel(seed, "doc_id", "text_key")), k).select("doc_id", "text_key", "log_weight", "kept")


def resample(docs: DataFrame, good: DataFrame, bad: DataFrame | None = None, **options) -> DataFrame:
    """Every document with its log importance weight and whether the sample keeps it: doc_id, log_weight, kept.

    ``good`` and ``bad`` have doc_ids of labelled documents. Null and empty texts weigh 0 (log), as does everything if no
    target document is known; texts without n-grams count as target mass. Rows that share an identifier are weighed each
    by its own text, those that share both share their fate; no rows give no rows; other columns are ignored. Null
    identifiers are scored like others.
    """
    return sampled(docs, good, bad, **options).select("doc_id", "log_weight", "kept")


def labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The doc_ids of good and of bad documents."""
    labels = read_table(spark, sf_dir, "labels")
    return labels.where("quality = 1").select("doc_id"), labels.where("quality = 0").select("doc_id")


def keep_quality(docs: DataFrame, good: DataFrame, bad: DataFrame | None = None, **options) -> DataFrame:
    """The documents that the sample keeps, with all their columns; rows that share an identifier are decided each."""
    return settled(docs, sampled(docs, good, bad, **options).withColumnRenamed("kept", "stays"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), *labelled(spark, sf_dir))
