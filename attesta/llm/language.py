"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Windows of 1 to 3 bytes, A-Z as a-z, are hashed into ``BUCKETS`` buckets. Document frequencies come from all documents
that may be learned from; the weights from a sample of them, by follow-the-regularised-leader with per-coordinate rates
and an elastic net, which leaves most weights at exactly zero. The sample is drawn by language, at most an even share of
``TRAIN_ROWS`` (``LEAST_ROWS`` if that is more) each, so every language there is can be learned, however rare. A fifth of
each language's sample sets the temperature that makes the winning probability a calibrated score; it counts every
language by its share of the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import read_table, stored
from .textvec import buffers, ngrams

BUCKETS = 4096
WIDTHS = (1, 2, 3)
#: Labelled documents that the weights are fitted on, dealt evenly to the languages; of each, those with the smallest
#: hashed identifiers. With many languages each still has LEAST_ROWS.
TRAIN_ROWS = 4000
LEAST_ROWS = 20
ROWS_AT_ONCE = 256
ALPHA, BETA, L1, L2, EPOCHS, STEP = 0.3, 1.0, 0.1, 0.5, 4, 32
UNKNOWN = "und"


def held_out(id_col: str = "doc_id"):
    """Documents that nothing is learned from: crc32 of the identifier as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, BUCKETS) n-gram counts, dense; for few rows at once."""
    n = len(offsets) - 1
    out = np.zeros(n * BUCKETS)
    for width in WIDTHS:
        for row, hashes in ngrams(data, offsets, width):
            out += np.bincount(row * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64), minlength=n * BUCKETS)
    return out.reshape(n, BUCKETS)


def _chunks(column: pa.Array):
    data, offsets = buffers(column)
    for lo in range(0, len(offsets) - 1, ROWS_AT_ONCE):
        own = offsets[lo : lo + ROWS_AT_ONCE + 1]
        yield lo, data[own[0] : own[-1]], own - own[0]


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    wide = data >= 128
    sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
    found = sums(letter) > 0
    for i in np.flatnonzero(~found & (sums(wide) > 0)):
        found[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def weighed(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(tf) * idf
    return (x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)).astype(np.float32)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (BUCKETS + 1, languages); the last row is the bias
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[:-1] + self.weights[-1]

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        p = softmax(self.logits(weighed(counts(data, offsets), self.idf)) / self.temperature)
        best = p.argmax(axis=1)
        known = _has_letter(data, offsets)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, p[np.arange(len(p)), best], 0.0)


def ftrl(x: np.ndarray, y: np.ndarray, classes: int, seed: int = 0) -> np.ndarray:
    """Follow-the-regularised-leader (proximal) on the softmax loss; returns weights with the bias in the last row."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    z, n = np.zeros((x.shape[1], classes)), np.zeros((x.shape[1], classes))
    order = np.random.default_rng(seed)
    penalty = np.full((x.shape[1], 1), L1)
    penalty[-1] = 0

    def leader():
        return np.where(np.abs(z) <= penalty, 0.0, (np.sign(z) * penalty - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        deal = order.permutation(len(x))
        for lo in range(0, len(x), STEP):
            rows = deal[lo : lo + STEP]
            w = leader()
            p = softmax(x[rows] @ w)
            p[np.arange(len(rows)), y[rows]] -= 1
            g = x[rows].T @ p
            z += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
            n += g * g
    return leader()


def temperature_of(logits: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> float:
    """The temperature of the smallest (weighted) log loss, by golden-section search on its logarithm."""
    loss = lambda t: -np.average(np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-12)), weights=weight)
    a, b, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many of all rows of (text) have each bucket, and how many rows there are."""

    def work(batches):
        seen, rows = np.zeros(BUCKETS + 1, np.int64), 0
        for batch in batches:
            for _, data, offsets in _chunks(batch.column(0)):
                seen[:-1] += (counts(data, offsets) > 0).sum(axis=0)
            rows += batch.num_rows
        seen[-1] = rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 1, dtype=np.int32)), pa.array(seen)], names=["bucket", "n"])

    out = np.zeros(BUCKETS + 1, np.int64)
    for r in docs.select("text").mapInArrow(work, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out[:-1], int(out[-1])


def sampled(labelled: DataFrame, train_rows: int) -> tuple[DataFrame, dict[str, int]]:
    """(doc_id, lang) to learn from, stored, and the rows of every language.

    No language is sorted as a whole: only hashes up to a cut that about twice the share lies below are ranked.
    """
    hashed = labelled.where("doc_id IS NOT NULL").select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    found = hashed.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least")).collect()
    share = max(train_rows // max(len(found), 1), min(LEAST_ROWS, train_rows))
    cut = lambda r: max(r.least, -(2**63) + min(2**64 * (2 * share + 100) // r.n, 2**64) - 1)
    cuts = labelled.sparkSession.createDataFrame([(r.lang, cut(r)) for r in found], "lang string, cut long")
    few = hashed.join(F.broadcast(cuts), "lang").where("h <= cut").select("doc_id", "lang", "h").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    return stored(few.withColumn("rank", rank).where(F.col("rank") <= share).select("doc_id", "lang"), "chosen"), {r.lang: r.n for r in found}


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model | None:
    """Learns from (doc_id, text, lang) rows with a language; None if there are none."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    chosen, sizes = sampled(labelled, train_rows)
    one = ["doc_id", "lang"]
    sample = labelled.join(F.broadcast(chosen), one, "left_semi").select("doc_id", "text", "lang").dropDuplicates(one).toArrow().sort_by([(c, "ascending") for c in one])
    if not sample.num_rows:
        return None
    seen, rows = document_frequencies(labelled)
    idf = np.log((1 + rows) / (1 + seen)) + 1
    langs = sorted(sizes)
    y = np.array([langs.index(v) for v in sample.column("lang").to_pylist()])
    x = np.vstack([weighed(counts(data, offsets), idf) for _, data, offsets in _chunks(sample.column("text").combine_chunks())])
    last = np.zeros(len(y), bool)
    for k in range(len(langs)):
        last[np.flatnonzero(y == k)[4::5]] = True
    model = Model(langs, idf, ftrl(x[~last], y[~last], len(langs)).astype(np.float32))
    if last.any():
        held = np.bincount(y[last], minlength=len(langs))
        model.temperature = temperature_of(model.logits(x[last]), y[last], np.array([sizes[v] for v in langs])[y[last]] / held[y[last]])
    return model


def identify(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; learned from the rows that aren't held out.

    Null texts and texts without a letter are ``und`` with score 0, as is everything if nothing can be learned.
    Repeated rows are predicted each; no rows give no rows; other columns are ignored.
    """
    model = train(docs.where(~held_out()), train_rows)

    def work(batches):
        for batch in batches:
            langs, scores = [], []
            for _, data, offsets in _chunks(batch.column(2)):
                own, score = model.predict(data, offsets) if model else ([UNKNOWN] * (len(offsets) - 1), np.zeros(len(offsets) - 1))
                langs += own
                scores += score.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))
