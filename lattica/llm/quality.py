"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network with calibrated probabilities.

Pass 1 goes over all texts: each word (hashed to two of `rows` rows) gathers the sparse random index vectors of its neighbours, and its
own count. A partition adds into one bounded matrix; Spark sums the rows. Pass 2 pools the vectors of each document (a word's vector is
the sum of its two rows, so that two words rarely share one); the network is fitted on a bounded labelled sample of such pools.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, in_python, mix64, text_words
from .learning import fold, labelled

ROWS, WIDTH, WINDOW, NONZERO = 1 << 15, 32, 2, 2
BLOCK = 100_000


def word_rows(hashes: np.ndarray, rows: int) -> np.ndarray:
    """The two rows of each word, words x 2."""
    return np.column_stack([hashes % np.uint64(rows), (hashes >> np.uint64(32)) % np.uint64(rows)]).astype(np.int64)


def index_vectors(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each word's NONZERO places and signs, from a scramble of its hash."""
    r = np.column_stack([mix64(hashes + np.uint64(k)) for k in range(1, NONZERO + 1)])
    return (r % np.uint64(width)).astype(np.int64), np.where((r >> np.uint64(40)) & np.uint64(1), 1, -1).astype(np.int32)


def contexts(hashes: np.ndarray, real: np.ndarray, into: np.ndarray) -> None:
    """Adds to into, rows x (width + 1): the sums of neighbours' index vectors, and in the last column the count, at both rows of each word. Only
    real places hold words; the others part documents."""
    rows, width = into.shape[0], into.shape[1] - 1
    at = word_rows(hashes, rows) * (width + 1)
    places, signs = index_vectors(hashes, width)
    n, cells = len(hashes), into.reshape(-1)
    for step in [k for k in range(-WINDOW, WINDOW + 1)]:
        a, b = slice(max(0, -step), n - max(0, step)), slice(max(0, step), n - max(0, -step))
        ok = real[a] & real[b]
        word, place, sign = at[a][ok], places[b][ok], signs[b][ok]
        for side in (0, 1):
            for k in range(NONZERO):
                np.add.at(cells, word[:, side] + place[:, k], sign[:, k])
    for side in (0, 1):
        np.add.at(cells, at[real, side] + width, 1)


def word_vectors(docs: DataFrame, rows: int = ROWS, width: int = WIDTH, text_col: str = "text") -> np.ndarray:
    """The summed matrix over all documents: rows x (width + 1), whatever the corpus. Partial sums are whole numbers, so that
    their order doesn't matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros((rows, width + 1), np.int32), [], 0
        gap = np.zeros(WINDOW, np.uint64)

        def add() -> None:
            nonlocal held, n
            if held:
                real = np.concatenate([np.full(len(h), h is not gap) for h in held])
                contexts(np.concatenate(held), real, total)
            held, n = [], 0

        for batch in batches:
            for words in text_words(batch.column(0)):
                held += [words, gap]
                n += len(words)
                if n > BLOCK:
                    add()
        add()
        used = np.flatnonzero(total[:, width])
        for at in range(0, len(used), 4096):
            part = used[at : at + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(total[part, k]) for k in range(width + 1))], ["row", *(f"s{k}" for k in range(width + 1))])

    sums = in_python(docs.select(text_col), run, "row long, " + ", ".join(f"s{k} int" for k in range(width + 1)))
    added = sums.groupBy("row").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(width + 1)])
    out = np.zeros((rows, width + 1))
    got = added.toPandas().to_numpy(np.float64).reshape(-1, width + 2)
    out[got[:, 0].astype(int)] = got[:, 1:]
    return out


def normalized(sums: np.ndarray) -> np.ndarray:
    """Unit rows weighted against frequent words, float32."""
    vectors, n = sums[:, :-1], sums[:, -1]
    share = n / max(1.0, n.sum())
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return (unit * (1e-2 / (1e-2 + share))[:, None]).astype(np.float32)


def pool(hashes: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of a document's word vectors, how much its words differ, and its length; zeros without words. Words are counted first, so
    that a very long text needs no more memory than its distinct words."""
    if not len(hashes):
        return np.zeros(2 * vectors.shape[1] + 2, np.float32)
    words, n = np.unique(hashes, return_counts=True)
    rows = word_rows(words, len(vectors))
    share = (n / n.sum())[:, None]
    v = (vectors[rows[:, 0]] + vectors[rows[:, 1]]).astype(np.float64)
    mean = (v * share).sum(0)
    spread = np.sqrt(((v - mean) ** 2 * share).sum(0))
    return np.concatenate([mean, spread, [min(len(words) / len(hashes) ** 0.8, 3.0), np.log1p(len(hashes)) / 10]]).astype(np.float32)


def pools(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    return np.array([pool(h, vectors) for h in text_words(column)], np.float64).reshape(len(column), 2 * vectors.shape[1] + 2)


@dataclass
class Network:
    """tanh layer, one output; inputs standardized; the output over the temperature is the log odds of label 1."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, rate: float = 0.01, decay: float = 1e-3, seed: int = 1) -> Network:
    """Adam on four fifths of the rows; the temperature minimizes the log loss of the last fifth. Rows of one label only, or
    none: a constant score, the share of label 1 smoothed by one row each."""
    rng = np.random.default_rng(seed)
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    p = (y.sum() + 1) / (len(y) + 2)
    net = Network(mean, scale, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(p / (1 - p))))
    if len(np.unique(y)) < 2 or len(y) < 20:
        return net
    net.w2 = rng.normal(0, hidden**-0.5, hidden)
    order = rng.permutation(len(y))
    held, fit = order[: len(y) // 5], order[len(y) // 5 :]
    z = np.clip((x - mean) / scale, -8, 8)
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v, t = [np.zeros_like(q) for q in params], [np.zeros_like(q) for q in params], 0
    for _ in range(epochs):
        rng.shuffle(fit)
        for at in range(0, len(fit), 128):
            rows = fit[at : at + 128]
            h = np.tanh(z[rows] @ params[0] + params[1])
            d = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40))) - y[rows]
            back = d[:, None] * params[2] * (1 - h * h)
            grads = [z[rows].T @ back / len(rows) + decay * params[0], back.mean(0), h.T @ d / len(rows) + decay * params[2], np.array([d.mean()])]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] = params[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    logits = net.logits(x[held])
    loss = lambda temp: float(np.mean(np.logaddexp(0, -np.where(y[held] > 0, 1, -1) * logits / temp)))
    net.temperature = min(np.geomspace(0.25, 4, 61), key=loss)
    return net


@dataclass
class Model:
    vectors: np.ndarray
    network: Network


def fit_on(docs: DataFrame, labels: DataFrame, bound: int = 6000, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", where=None) -> Model:
    """Vectors from all of docs, the network from at most bound labelled documents. Of documents with one id, one is taken."""
    vectors = normalized(word_vectors(docs, text_col=text_col))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # rows x width: bounded by parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(pools(batch.column(1), shared.value).tolist(), pa.list_(pa.float32()))], ["doc_id", "label", "pool"])

    sample = labelled(docs, labels, label, bound, id_col, where, text_col).withColumn("doc_id", F.col("doc_id").cast("string"))
    rows = in_python(sample, run, "doc_id string, label int, pool array<float>")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("label", "pool")).alias("r")).orderBy("doc_id").select("r.*").collect()
    shared.destroy()
    x = np.array([r["pool"] for r in rows], np.float64).reshape(len(rows), 2 * vectors.shape[1] + 2)
    return Model(vectors, train(x, np.array([r["label"] > 0 for r in rows], float)))


def score_of(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The score of a text as a column of docs: all other columns stay in the JVM. Null text is empty; an empty text has the score of an
    all-zero pool; equal texts have equal scores, whatever the batch. To be evaluated once a row, wherever it is used."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            m = shared.value
            yield pa.array(np.round(m.network.probabilities(pools(t, m.vectors)), 9) if len(t) else np.zeros(0))

    return scored.asNondeterministic()(F.col("`" + text_col.replace("`", "``") + "`"))


def score(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score and predicted for every document. Empty table: no rows."""
    scored = docs.select(F.col(id_col), score_of(docs, model, text_col).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def training_rows(id_col: str = "doc_id"):
    """The labels that may be learnt from: three quarters of the ids."""
    return fold(id_col, 4) != 2
