"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words, pairs of neighbours and pairs with one word between are hashed to 2 ** BITS features, present or not. FTRL keeps a rate for
each coordinate, and its L1 term leaves most weights at zero: the weights that remain are the broadcast model. L1 also draws all scores towards the middle; so the
log odds are calibrated on training documents scored by models that did not see them, with 0.7 at a stated share of false positives.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Alphabet, field, in_python, mix64, stash, text_words
from .learning import fold, labelled

BITS = 20
#: Words of letters, digits and apostrophes, lower case; all other ASCII characters part them.
LETTERS = Alphabet([b for b in range(128) if not (chr(b).isalnum() or b == 39)], lower=True)


def grams(h: np.ndarray) -> np.ndarray:
    """Feature numbers of a whole text from its words' hashes, repeats included: words, then pairs, then skip pairs."""
    mask = np.uint64((1 << BITS) - 1)
    mul = lambda x, c: (x * np.uint64(c)) >> np.uint64(40)
    one = mul(h, 0x9E3779B97F4A7C15)
    two = mul(h[:-1] * np.uint64(31) + h[1:], 0xD6E8FEB86659FD93)
    skip = mul(h[:-2] * np.uint64(37) + h[2:], 0xCA5A826395121157)
    return (np.concatenate([one, two, skip]) & mask).astype(np.int64)


@dataclass
class Weights:
    """Sorted feature numbers with their weights, the bias, and what calibration makes of the log odds."""

    at: np.ndarray
    w: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def table(self) -> np.ndarray:
        dense = np.zeros(1 << BITS, np.float32)
        dense[self.at] = self.w
        return dense


def log_odds(features: np.ndarray, table: np.ndarray, bias: float) -> float:
    w = table[features]
    some = np.unique(features[w != 0])
    return float(np.clip(bias + table[some].astype(np.float64).sum(), -40, 40))


def probability(features: np.ndarray, table: np.ndarray, bias: float, slope: float = 1.0, offset: float = 0.0) -> float:
    return float(1 / (1 + np.exp(-np.clip(slope * log_odds(features, table, bias) + offset, -40, 40))))


def train(rows: list[np.ndarray], y: np.ndarray, alpha: float = 2.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.1, epochs: int = 4, seed: int = 1) -> Weights:
    """Follow the regularized leader, a document at a time, in a seeded order. No rows: no weights, score one half."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = 0.0
    rng = np.random.default_rng(seed)

    def weights(zi, ni):
        return np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2), 0.0)

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            f = rows[k]
            zi, ni = z[f], n[f]
            w = weights(zi, ni)
            b = -zb / ((beta + np.sqrt(nb)) / alpha + l2)
            g = 1 / (1 + np.exp(-np.clip(b + w.sum(), -40, 40))) - y[k]
            grow = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[f], n[f] = zi + g - grow * w, ni + g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * b
            nb += g * g
    w = weights(z, n)
    at = np.flatnonzero(w)
    return Weights(at, w[at].astype(np.float32), float(-zb / ((beta + np.sqrt(nb)) / alpha + l2)))


#: Parts of the training rows of which each is scored by a model of the others, and how often they are drawn anew; the threshold, and the share of
#: training rows with label 0 that may lie above it.
PARTS, REPEATS, THRESHOLD, FALSE = 4, 2, 0.7, 0.005


def calibration(rows: list[np.ndarray], y: np.ndarray, false: float = FALSE, threshold: float = THRESHOLD, seed: int = 1, **options) -> tuple[float, float]:
    """Slope and offset for log odds. The slope is that of a logistic fit to the labels; the offset puts the threshold where at most the share `false` of the
    rows with label 0 score higher. Without both labels in numbers, log odds stay as they are."""
    if min(y.sum(), (1 - y).sum()) < 2 * PARTS:
        return 1.0, 0.0
    rng, odds, labels = np.random.default_rng(seed), [], []
    for _ in range(REPEATS):
        part = rng.permutation(len(rows)) % PARTS
        for k in range(PARTS):
            own = np.flatnonzero(part == k)
            model = train([rows[i] for i in np.flatnonzero(part != k)], y[part != k], **options)
            table = model.table()
            odds.append(np.array([log_odds(rows[i], table, model.bias) for i in own]))
            labels.append(y[own])
    z, t = np.concatenate(odds), np.concatenate(labels)
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * z + offset, -40, 40)))
        w = p * (1 - p)
        hessian = np.array([[(w * z * z).sum(), (w * z).sum()], [(w * z).sum(), w.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, np.array([((p - t) * z).sum(), (p - t).sum()]))
        slope, offset = slope - step[0], offset - step[1]
    slope = float(slope) if np.isfinite(slope) and slope > 0 else 1.0
    clean = np.sort(z[t == 0])[::-1]
    below = clean[int(false * len(clean))]
    above = z[z > below]
    cut = (below + above.min()) / 2 if len(above) else below
    return slope, float(np.log(threshold / (1 - threshold)) - slope * cut)


#: Features (4 bytes each) of the sampled documents that reach the driver at most; a sample of long documents has fewer documents.
FEATURES = 16_000_000


def fit_on(docs: DataFrame, labels: DataFrame, bound: int = 6000, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", where=None, features: int = FEATURES, **options) -> Weights:
    """Fits on at most bound labelled documents with at most `features` distinct features together, the first by a hash of the id; of
    documents with one id, one is taken. The features are counted on the executors; only those of the sample reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(grams(h)).astype(np.int32).tobytes() for h in text_words(batch.column(1), LETTERS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["doc_id", "label", "features"])

    sample = labelled(docs, labels, label, bound, id_col, where, text_col).withColumn("doc_id", F.col("doc_id").cast("string"))
    rows = in_python(sample, run, "doc_id string, label int, features binary")
    rows = stash(rows.groupBy("doc_id").agg(F.min(F.struct("label", "features")).alias("r")).select("doc_id", "r.*"))
    sizes = rows.select("doc_id", (F.octet_length("features") / 4).alias("n")).collect()  # at most bound rows
    sizes.sort(key=lambda r: (int(mix64(np.array([zlib.crc32(r["doc_id"].encode())]))[0]), r["doc_id"]))
    total = np.cumsum([r["n"] for r in sizes])
    kept = [r["doc_id"] for r, upto in zip(sizes, total) if upto <= features]
    if len(kept) < len(sizes):
        rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in kept], "doc_id string")), "doc_id", "left_semi")
    rows = rows.orderBy("doc_id").toPandas()
    features, y = [np.frombuffer(b, np.int32) for b in rows["features"]], (rows["label"].to_numpy() > 0).astype(float)
    weights = train(features, y, **options)
    weights.slope, weights.offset = calibration(features, y, **options)
    return weights


def score(docs: DataFrame, weights: Weights, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score and predicted for every document; null and empty texts have the calibrated score of the bias. Empty table: no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = model.table()
        for batch in batches:
            s = np.array([probability(grams(h), table, model.bias, model.slope, model.offset) for h in text_words(batch.column(1), LETTERS)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [id_col, "score", "predicted"])

    return in_python(docs.select(F.col(id_col), F.col(text_col)), run, f"{field(docs, id_col)}, score double, predicted int")


def training_rows(id_col: str = "doc_id"):
    """The labels that may be learnt from: two thirds of the ids."""
    return fold(id_col, 3) != 1
