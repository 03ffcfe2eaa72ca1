"""Toxicity: logistic regression on hashed character windows, regularised by counterfactuals.

Features are the presence of 5-byte windows, A-Z as a-z, hashed into ``BUCKETS`` buckets; the ``FEATURES`` of them whose
presence differs most between the classes are learned on. Labelled texts that name a group are copied with the term
swapped for another of its kind, and the loss adds the squared difference of the two scores (before the sigmoid), so
that naming a group moves the score as little as the labels allow.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .language import held_out
from .store import read_table, stored
from .textvec import buffers, ngrams

BUCKETS = 1 << 18
WIDTH = 5
FEATURES = 2048
#: Labelled documents that the model is fitted on, at most: so many of either class, with the smallest hashed identifiers.
TRAIN_ROWS = 3000
THRESHOLD = 0.7
STEPS, LASSO, RIDGE, FAIRNESS = 400, 3e-4, 1e-5, 1.0

#: Terms that name a group, by kind; each may stand for the others of its kind.
IDENTITIES = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("disabled", "blind", "deaf", "elderly", "young"),
)
_KIND = {term: (kind, i) for kind in IDENTITIES for i, term in enumerate(kind)}
_TERMS = re.compile(r"(?i)\b(" + "|".join(sorted(_KIND, key=len, reverse=True)) + r")\b")


def counterfactual(text: str) -> str:
    """The text with every identity term swapped for the next of its kind; case of the first letter stays."""

    def swap(m: re.Match) -> str:
        kind, i = _KIND[m[0].lower()]
        other = kind[(i + 1) % len(kind)]
        return other.capitalize() if m[0][0].isupper() else other

    return _TERMS.sub(swap, text)


@dataclass
class Model:
    place: np.ndarray  # of every bucket among the learned features, -1 for none
    weights: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities, one for each text; only windows of learned features are looked at closely."""
        n = len(offsets) - 1
        rows, hits = [], []
        for row, hashes in ngrams(data, offsets, WIDTH):
            found = self.place[(hashes % np.uint64(BUCKETS)).astype(np.int64)]
            hit = found >= 0
            rows.append(row[hit])
            hits.append(found[hit])
        width = len(self.weights)
        present = np.unique(np.concatenate(rows) * width + np.concatenate(hits)) if rows else np.zeros(0, np.int64)
        logit = self.bias + np.bincount(present // width, self.weights[present % width], minlength=n)
        return 1 / (1 + np.exp(-logit))


def present(texts: pa.Array) -> list[np.ndarray]:
    """The distinct buckets of every text."""
    data, offsets = buffers(texts)
    rows, hits = [], []
    for row, hashes in ngrams(data, offsets, WIDTH):
        rows.append(row)
        hits.append((hashes % np.uint64(BUCKETS)).astype(np.int64))
    keys = np.unique(np.concatenate(rows) * BUCKETS + np.concatenate(hits)) if rows else np.zeros(0, np.int64)
    return np.split(keys % BUCKETS, np.searchsorted(keys // BUCKETS, np.arange(1, len(offsets) - 1)))


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    """Accelerated proximal gradient descent on balanced log loss, elastic net and counterfactual differences."""
    y = toxic.astype(float)
    buckets = [b for lo in range(0, len(texts), 256) for b in present(pa.array(texts[lo : lo + 256], pa.string()))]
    share = np.zeros((2, BUCKETS))
    for b, t in zip(buckets, toxic, strict=True):
        share[int(t), b] += 1
    share /= np.maximum([[(y == 0).sum()], [(y == 1).sum()]], 1)
    mean = share.mean(axis=0)
    gain = np.abs(share[1] - share[0]) / np.sqrt(mean * (1 - mean) + 0.01)
    chosen = np.sort(np.argsort(-gain, kind="stable")[:FEATURES])
    place = np.full(BUCKETS, -1, np.int32)
    place[chosen] = np.arange(FEATURES)

    def matrix(rows):
        out = np.zeros((len(rows), FEATURES), np.float32)
        for i, b in enumerate(rows):
            f = place[b]
            out[i, f[f >= 0]] = 1
        return out

    x = matrix(buckets)
    swapped = [i for i, t in enumerate(texts) if _TERMS.search(t)]
    moved = matrix(present(pa.array([counterfactual(texts[i]) for i in swapped], pa.string()))) - x[swapped] if swapped else np.zeros((0, FEATURES), np.float32)
    y = y.astype(np.float32)
    weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1)).astype(np.float32)
    pull = 2 * FAIRNESS / max(len(moved), 1)
    # a bound of the loss's curvature, by a few power iterations
    v = np.full(FEATURES + 1, (FEATURES + 1) ** -0.5, np.float32)
    for _ in range(20):
        u = 0.25 * weight * (x @ v[:-1] + v[-1])
        v = np.append(x.T @ u + pull * (moved.T @ (moved @ v[:-1])), u.sum()).astype(np.float32)
        curvature = np.sqrt(v @ v)
        v /= max(curvature, 1e-12)
    rate = np.float32(1 / (1.1 * curvature + RIDGE))
    w, vw, bias, vb = np.zeros(FEATURES, np.float32), np.zeros(FEATURES, np.float32), 0.0, 0.0
    for step in range(STEPS):
        momentum = np.float32(step / (step + 3))
        aw, ab = w + momentum * vw, bias + momentum * vb
        error = weight * (1 / (1 + np.exp(-np.clip(x @ aw + ab, -40, 40))) - y)
        nw = aw - rate * (x.T @ error + RIDGE * aw + pull * (moved.T @ (moved @ aw)))
        nw = (np.sign(nw) * np.maximum(np.abs(nw) - rate * LASSO, 0)).astype(np.float32)
        nb = ab - rate * error.sum()
        vw, vb, w, bias = nw - w, nb - bias, nw, nb
    return Model(place, w.astype(float), float(bias))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model | None:
    """Learns from the labelled among (doc_id, text); None unless both classes occur."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out())
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = stored(known.where("toxic = 1").orderBy(*order).limit(train_rows).unionByName(known.where("toxic = 0").orderBy(*order).limit(train_rows)), "chosen")
    sample = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")
    toxic = np.array(sample.column("toxic").to_pylist(), dtype=bool)
    return fit(sample.column("text").to_pylist(), toxic) if toxic.any() and not toxic.all() else None


def score(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; learned from labelled rows that aren't held out.

    Null counts as empty, which scores what the bias gives. Without both classes among the labels every score is 0.
    Several labels of one document count as toxic if any is. Repeated rows are scored each; no rows give no rows; other
    columns are ignored.
    """
    model = train(docs, labels, train_rows)

    def work(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            scores = [np.zeros(0)]
            for lo in range(0, batch.num_rows, 512):
                own = offsets[lo : lo + 513]
                scores.append(model.score(data[own[0] : own[-1]], own - own[0]) if model else np.zeros(len(own) - 1))
            out = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out), pa.array((out >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
