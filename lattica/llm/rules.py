"""Quality rules: counts over whole texts, and an isolation forest on the rule statistics.

Each tree of the forest is grown on its own draw of labelled rows; short average paths over random splits mark a document as anomalous, and the
threshold is set on all labelled rows. Everything else is a pass over the documents to count for the fit, and one to judge, a batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field, in_python, mix64, release, stash, text_words

BLANKS, SYMBOLS, CAPITALS = " \t\n\x0b\x0c\r", "#*$%&|<>", bytes(range(65, 91))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]
SPAN = 8


def repeated_words(hashes: np.ndarray, span: int = SPAN) -> int:
    """Words in windows of span words that the text holds at least twice, the first one included."""
    n = len(hashes) - span + 1
    if n < 2:
        return 0
    m, keys = mix64(hashes), np.zeros(n, np.uint64)
    for j in range(span):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + m[j : j + n]
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(keys, twice))
    edge = np.zeros(len(hashes) + 1, np.int64)
    edge[at] += 1
    np.add.at(edge, at + span, -1)
    return int((np.cumsum(edge) > 0).sum())


def counts(text: str | None, words: np.ndarray) -> tuple[int, ...]:
    """COUNTS of a whole text with the 64-bit hashes of its words; null counts as empty, for which all are 0."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode()
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            lines += 1
            dup += line in seen
        seen.add(line)
    return len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), dup, repeated_words(words), lines, len(raw) - len(raw.translate(None, CAPITALS))


def statistics(c: np.ndarray) -> np.ndarray:
    """Rows of COUNTS -> rule statistics: word length, symbols a word and a character, and redundancy (the greater share of repeated
    lines or words). All are ratios, so that length alone is no anomaly."""
    words, chars, lines = (np.maximum(c[:, k], 1) for k in (0, 1, 5))
    return np.column_stack([c[:, 1] / words, c[:, 2] / words, c[:, 2] / chars, np.maximum(c[:, 3] / lines, c[:, 4] / words)]).astype(float)


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Average depth of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays (tree, node): feature (-1: leaf), cut, left child, path length at a leaf; right child is left + 1."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    path: np.ndarray
    points: int
    threshold: float = np.inf

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly in 0..1 for each row: 2 ** -(average path / expected path)."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, left, path in zip(self.feature, self.cut, self.left, self.path):
            at = np.zeros(len(x), np.int64)
            for _ in range(64):
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                at = np.where(inner, left[at] + (x[rows, np.maximum(f, 0)] >= cut[at]), at)
            total += path[at]
        return 2.0 ** (-total / len(self.feature) / max(float(mean_path(self.points)), 1e-9))


def grow(x: np.ndarray, rng: np.random.Generator, depth: int) -> tuple[np.ndarray, ...]:
    feature, cut, left, path = [-1], [0.0], [0], [0.0]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        node, rows, level = todo.pop()
        low, high = x[rows].min(0), x[rows].max(0)
        open_ = np.flatnonzero(high > low)
        if level >= depth or len(rows) < 2 or not len(open_):
            path[node] = level + float(mean_path(len(rows)))
            continue
        f = int(rng.choice(open_))
        at = rng.uniform(low[f], high[f])
        right = x[rows, f] >= at
        if right.all():
            path[node] = level + float(mean_path(len(rows)))
            continue
        feature[node], cut[node], left[node] = f, at, len(feature)
        for part in (rows[~right], rows[right]):
            todo.append((len(feature), part, level + 1))
            feature.append(-1), cut.append(0.0), left.append(0), path.append(0.0)
    return np.array(feature), np.array(cut), np.array(left), np.array(path)


def fit(x: np.ndarray, good: np.ndarray, trees: int = 150, points: int = 256, contamination: float = 0.02, loss: float = 0.008, seed: int = 1) -> Forest:
    """Each tree is grown on points rows, of which the share contamination is drawn from rows labelled bad: anomalies have to be rare to
    be isolated early. The threshold is the lowest that rejects at most the share loss of good rows. Without rows of both
    labels there is no threshold, and nothing is rejected."""
    rng = np.random.default_rng(seed)
    clean, junk = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(clean) or not len(junk):
        return Forest(*(np.array([[v]]) for v in (-1, 0.0, 0, 0.0)), 1)
    n_junk = max(1, min(len(junk), round(points * contamination)))
    n_clean = min(len(clean), points - n_junk)
    depth = int(np.ceil(np.log2(max(points, 2)))) + 2
    grown = [grow(x[np.concatenate([rng.choice(clean, n_clean, False), rng.choice(junk, n_junk, False)])], rng, depth) for _ in range(trees)]
    size = max(len(t[0]) for t in grown)
    stacked = [np.stack([np.pad(t[k], (0, size - len(t[k])), constant_values=-1 if k == 0 else 0) for t in grown]) for k in range(4)]
    forest = Forest(*stacked, n_clean + n_junk)
    s = forest.scores(x)
    ordered = np.sort(s[good])
    bound = ordered[min(len(ordered) - 1, int(np.ceil(len(ordered) * (1 - loss))) - 1)]
    above = s[~good][s[~good] > bound]
    forest.threshold = float((bound + above.min()) / 2) if len(above) else float(np.nextafter(bound, 2))
    return forest


def _passes(c: np.ndarray) -> np.ndarray:
    return ~((c[:, 0] < 20) | (100 * c[:, 4] > 30 * c[:, 0]))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        texts = batch.column(1)
        yield batch, np.array([counts(t.as_py(), words) for t, words in zip(texts, text_words(texts))], np.int64).reshape(len(texts), len(COUNTS))


def order_statistic(df: DataFrame, column: str, k: int, bins: int = 1024) -> float:
    """The value at place k, from 0, of a column of finite numbers in ascending order, exactly: counts by bins, then by bins of the bin that holds the place, until that has one value. bins rows a round reach the driver."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    while low < high:
        part = F.least(F.lit(bins - 1), F.floor((F.col(column) - F.lit(low)) / F.lit((high - low) / bins)))
        inside = df.filter(F.col(column).between(low, high))
        for r in sorted(inside.groupBy(part.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect(), key=lambda r: r["bin"]):
            if k < r["n"]:
                low, high = r["low"], r["high"]
                break
            k -= r["n"]
    return low


def fit_on(docs: DataFrame, labels: DataFrame, bound: int = 4000, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", loss: float = 0.008, trees: int = 150, points: int = 256, **options) -> Forest:
    """The forest, with the threshold of fit over all labelled rows. Each tree is grown on its own draw of points rows, as the method has it; they are drawn from max(bound, trees x points) labelled rows, the first by a hash
    of the id, which are all that reaches the driver. Counts are taken before labels are joined, so that no text is dealt out."""

    def run(batches):
        for batch, c in _counted(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c[:, k]) for k in range(len(COUNTS)))], ["doc_id", *COUNTS])

    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("label"))
    counted = in_python(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"{field(docs, id_col, 'doc_id')}, " + ", ".join(f"{c} long" for c in COUNTS))
    rows = counted.join(known, F.col("doc_id") == F.col("_id")).groupBy("doc_id").agg(F.min(F.struct("label", *COUNTS)).alias("r"))
    rows = stash(rows.select("doc_id", "r.*"))
    pool = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max(bound, trees * points)).withColumn("doc_id", F.col("doc_id").cast("string")).orderBy("doc_id").drop("doc_id").toPandas()
    c = pool[COUNTS].to_numpy(np.int64).reshape(-1, len(COUNTS))
    passes = _passes(c)
    forest = fit(statistics(c)[passes], pool["label"].to_numpy()[passes] > 0, trees, points, loss=loss, **options)
    if np.isfinite(forest.threshold):
        forest.threshold = _threshold(rows, forest, loss)
    release(rows)
    return forest


def _threshold(rows: DataFrame, forest: Forest, loss: float) -> float:
    """The threshold of fit, from all rows (label, COUNTS) that pass the base."""
    model = rows.sparkSession.sparkContext.broadcast(forest)  # trees x nodes

    def run(batches):
        for batch in batches:
            c = np.column_stack([batch.column(name).to_numpy(zero_copy_only=False) for name in COUNTS]).astype(np.int64).reshape(-1, len(COUNTS))
            passes = _passes(c)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("label").to_numpy(zero_copy_only=False)[passes] > 0), pa.array(model.value.scores(statistics(c[passes])))], ["good", "score"])

    scored = stash(in_python(rows.select("label", *COUNTS), run, "good boolean, score double"))
    good = scored.filter("good")
    n = good.count()
    bound = order_statistic(good, "score", min(n - 1, int(np.ceil(n * (1 - loss))) - 1))
    above = scored.filter(~F.col("good") & (F.col("score") > bound)).agg(F.min("score")).first()[0]
    release(scored)
    return float(np.nextafter(bound, 2)) if above is None else (bound + above) / 2


def judge(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, anomaly.

    Null and empty texts have zero counts and fail the base. Repeated rows are judged alike. Empty table: no rows.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(forest)  # trees x nodes: bounded by the fit's parameters
    out = COUNTS[:5]

    def run(batches):
        for batch, c in _counted(batches):
            passes = _passes(c)
            score = model.value.scores(statistics(c)) if len(c) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c[:, k]) for k in range(5)), pa.array(~passes), pa.array(passes & (score < model.value.threshold)), pa.array(score)], [id_col, *out, "base_failed", "kept", "anomaly"])

    return in_python(docs.select(F.col(id_col), F.col(text_col).alias("text")), run, f"{field(docs, id_col)}, " + ", ".join(f"{c} long" for c in out) + ", base_failed boolean, kept boolean, anomaly double")
