"""Document fingerprints by consistent weighted sampling.

Terms are lower-case words, weighted by their count. For each of K samples a term draws its gamma and uniform variates from a hash of
(term, sample), and the term with the least key is the sample: two texts draw the same one with a probability equal to
the generalised Jaccard similarity of their weights. A signature is K values of 16 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLDED, PRIME, field, in_python, mix64, text_words

K = 64
NONE = np.full(K, 0xFFFF, np.uint16)


#: Terms for which keys are computed at once, so that a very long text needs no more memory than its words.
STEP = 4096


def variates(terms: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c with r, c ~ Gamma(2, 1), and beta ~ U(0, 1) of each (term, sample), from 64-bit hashes of it."""
    per_sample = mix64(np.arange(1, k + 1, dtype=np.uint64) * PRIME)[None, :]
    per_term = mix64(terms + np.uint64(0x51ED2701))[:, None]
    out = tuple(np.empty((len(terms), k), np.float32) for _ in range(3))
    for at in range(0, len(terms), STEP):
        draws = []
        for j in (1, 2, 3):
            x = mix64((per_term[at : at + STEP] ^ per_sample) + np.uint64((j * 0xD1342543DE82EF95) % 2**64))
            draws += [((x & np.uint64(0xFFFFFFFF)).astype(np.float32) + np.float32(0.5)) / np.float32(2**32), ((x >> np.uint64(32)).astype(np.float32) + np.float32(0.5)) / np.float32(2**32)]
        out[0][at : at + STEP] = np.maximum(-np.log(draws[0] * draws[1]), 1e-6)
        out[1][at : at + STEP] = np.log(np.maximum(-np.log(draws[2] * draws[3]), 1e-6))
        out[2][at : at + STEP] = draws[4]
    return out


def sample(at: np.ndarray, weights: np.ndarray, hashes: np.ndarray, tables: tuple[np.ndarray, ...]) -> np.ndarray:
    """The signature of one text: at are its terms' rows in the tables. No terms: all ones."""
    if not len(at):
        return NONE
    cols = np.arange(tables[0].shape[1])
    best, drawn = np.full(len(cols), np.inf, np.float32), np.zeros(len(cols), np.uint64)
    for k in range(0, len(at), STEP):
        rows = at[k : k + STEP]
        r, lnc, beta = (t[rows] for t in tables)
        t = np.floor(np.log(weights[k : k + STEP].astype(np.float32))[:, None] / r + beta)
        key = lnc - r * (t - beta) - r
        least = key.argmin(0)
        value = mix64(hashes[rows[least]] * PRIME + t[least, cols].astype(np.int64).astype(np.uint64))
        low = key[least, cols]
        drawn, best = np.where(low < best, value, drawn), np.minimum(low, best)
    return np.minimum(drawn & np.uint64(0xFFFF), np.uint64(0xFFFE)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples; 1 for two texts without words."""
    return float((a == b).mean())


def signatures(texts: list[str]) -> list[np.ndarray]:
    """Signatures of a bounded list of texts; the variates of each distinct word are drawn once."""
    counted = [np.unique(h, return_counts=True) for h in text_words(pa.array(texts, pa.string()), FOLDED)]
    terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *(w for w, _ in counted)]))
    tables = variates(terms)
    return [sample(np.searchsorted(terms, w), n, terms, tables) for w, n in counted]


#: Characters whose signatures are made at once: bounds the table of variates of a worker.
PORTION = 400_000


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    id_type = None

    def finish(rows: list[tuple]) -> pa.RecordBatch:
        # rows[-1] is only the successor of the last one
        texts = [r[2] for r in rows]
        edited = [(a[: len(a) - len(a) // 2] + b[: len(a) // 2]) if p == q else None for a, b, p, q in zip(texts, texts[1:], (r[0] for r in rows), (r[0] for r in rows[1:]))]
        own = signatures(texts + [e for e in edited if e is not None])
        changed = iter(own[len(texts) :])
        out = []
        for k, e in enumerate(edited):
            if e is None:
                continue
            s = next(changed)
            if not rows[k][3]:
                out.append((rows[k][1], len(texts[k]), hashlib.sha256(e.encode()).hexdigest(), own[k].astype(">u2").tobytes().hex(), s.astype(">u2").tobytes().hex(), likeness(own[k], s), likeness(own[k], own[k + 1])))
        types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    size = 0
    for batch in batches:
        id_type = batch.column(1).type
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            held.append(row)
            size += len(row[2])
            if size >= PORTION:
                yield finish(held)
                held, size = held[-1:], 0
    if len(held) > 1:
        yield finish(held)


#: Bytes of text in a block, about, up to so many blocks, which then grow (a block is sorted on disk and streamed, so that its size costs no memory); and sampled
#: rows for each block. The driver gets BLOCKS * SAMPLED ids and BLOCKS rows at most, at any size of input.
BLOCK_BYTES, BLOCKS, SAMPLED = 64 << 20, 8192, 32


def cut_ids(rows: DataFrame, blocks: int | None) -> tuple[list[int], dict[int, int], int]:
    """Descending ids at which blocks begin after the first, for ids that fill several blocks how many, and the number of blocks.

    Blocks have about equal bytes and are at least the session's shuffle partitions and at most BLOCKS. The cuts come from a sample of rows by a
    hash, some SAMPLED a block; its size is in step with the blocks."""
    total, n = rows.agg(F.sum(F.octet_length("text") + 16), F.count("*")).first()
    if not n:
        return [], {}, 0
    blocks = blocks or min(BLOCKS, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCK_BYTES)))
    one_in = max(1, n // (SAMPLED * blocks))
    some = rows.filter(F.pmod(F.xxhash64("_id", "_u"), F.lit(one_in)) == 0).groupBy("_id").agg(F.sum(F.octet_length("text") + 16).alias("bytes")).orderBy(F.desc("_id")).collect()
    each = sum(r["bytes"] for r in some) / blocks
    cuts, hot, upto = [], {}, 0
    for r in some:
        if r["bytes"] > each and blocks > 1:
            hot[r["_id"]] = int(np.ceil(r["bytes"] / each))
            cuts += [r["_id"], r["_id"] - 1]
            upto = 0
        elif upto + r["bytes"] > each:
            cuts.append(r["_id"])
            upto = r["bytes"]
        else:
            upto += r["bytes"]
    return sorted(set(c for c in cuts if c >= -(2**63)), reverse=True), hot, blocks


def fingerprints(docs: DataFrame, blocks: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every document.

    The next document is the one that follows by descending id, then by a hash of the text (null: empty); the first follows the last.
    Ids that are no integers are ordered by a hash of them. Ranges of ids with about equal bytes are dealt out, one a task; each also gets
    the first row of the next one, so that no row looks across. An id that fills several blocks is cut by the texts' hash. One document:
    it is its own successor. Repeated rows follow each other. Null ids come last. Empty table: no rows.
    """
    spark = docs.sparkSession
    whole = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    by = F.col(id_col).cast("long") if whole else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col))
    rows = docs.select(F.coalesce(by, F.lit(-(2**63))).alias("_id"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("_u", F.shiftrightunsigned(F.xxhash64("text"), 1))
    cuts, hot, blocks = cut_ids(rows, blocks)
    if cuts:
        # ids as doubles keep their order; ids of one double stay together
        splits = sorted({-float(c) for c in cuts})
        placed = Bucketizer(splits=[-np.inf, *splits, np.inf], inputCol="_at", outputCol="_block").transform(rows.withColumn("_at", -F.col("_id").cast("double")))
        rows = placed.select("_id", "_u", "doc_id", "text", F.col("_block").cast("int").alias("block"))
    else:
        rows = rows.withColumn("block", F.lit(0))
    if hot:  # at most as many as blocks
        parts = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in hot.items() for x in (k, v)]), F.col("_id")), F.lit(1))
        rows = rows.withColumn("part", F.shiftright(F.shiftright("_u", 31) * parts, 32).cast("int"))
    else:
        rows = rows.withColumn("part", F.lit(0))
    heads = rows.groupBy("block", "part").agg(F.max(F.struct("_id", (-F.col("_u")).alias("v"))).alias("first")).orderBy("block", "part").collect()  # a row per block
    number = {(r["block"], r["part"]): k for k, r in enumerate(heads)}
    order = "block int, part int, number int, _id long, _u long, into int"
    places = spark.createDataFrame([(r["block"], r["part"], k, r["first"]["_id"], -r["first"]["v"], (k - 1) % len(heads)) for k, r in enumerate(heads)], order)
    places = F.broadcast(places)  # as many rows as blocks
    rows = rows.join(places.select("block", "part", "number"), ["block", "part"])
    tails = docs_at(rows, places)
    both = rows.select("number", F.lit(False).alias("tail"), "_id", "_u", "doc_id", "text").unionByName(tails)
    dealt = both.repartitionById(max(1, len(number)), F.col("number")).sortWithinPartitions("number", "tail", F.desc("_id"), "_u", "text")
    schema = f"{field(docs, id_col, 'doc_id')}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_python(dealt.select("number", "doc_id", "text", "tail"), _run, schema)


def docs_at(rows: DataFrame, places: DataFrame) -> DataFrame:
    """The first row of each block, for the block before it."""
    found = rows.join(places.select("_id", "_u", "into"), ["_id", "_u"])
    firsts = found.groupBy("into", "_id", "_u").agg(F.min("text").alias("text"))
    return firsts.select(F.col("into").alias("number"), F.lit(True).alias("tail"), "_id", "_u", F.lit(None).cast(rows.schema["doc_id"].dataType).alias("doc_id"), "text")
