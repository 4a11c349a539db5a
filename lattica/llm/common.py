"""What several text operators share: reading, durable intermediates, salted ranks and word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word is a run of characters outside these six.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


#: The session's option for bytes in an Arrow batch, its default, and what the operators that hand texts to Python set it to.
BATCH_OPTION, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "2m"


def bounded_batches(spark: SparkSession) -> None:
    """Texts may be long: Python workers get batches of 2 MB instead of 64. A bound that the session sets itself is left alone."""
    if spark.conf.get(BATCH_OPTION) == BATCH_DEFAULT:
        spark.conf.set(BATCH_OPTION, BATCH_BYTES)


def in_python(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow over batches of bounded bytes."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def field(df: DataFrame, column: str, name: str | None = None) -> str:
    """A column of df for a schema text, its name quoted."""
    quoted = (name or column).replace("`", "``")
    return f"`{quoted}` {df.schema[column].dataType.simpleString()}"


@cache
def _own_folder(application: str) -> str:
    """An application's temporary folder, the same at each call: a running session takes no new spark.checkpoint.dir."""
    return "file://" + tempfile.mkdtemp(prefix="spark-shared-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local master gets a temporary folder (tests); a
    cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _own_folder(spark.sparkContext.applicationId)
    return found.rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stash = path
    return out


def release(*stashes: DataFrame | None) -> None:
    """Deletes the files of stashed tables that no later step reads."""
    for df in stashes:
        if df is not None and getattr(df, "_stash", None):
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(df._stash)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stowed(docs: DataFrame, own: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs as its own columns and one struct `_rest` of all others, so that no name of these meets a name of an operator; and what
    turns the operator's result back into the columns of docs, in their order."""
    names = docs.columns
    quoted = {c: "`" + c.replace("`", "``") + "`" for c in names}
    rest = [c for c in names if c not in own]
    packed = docs.select(*[F.col(quoted[c]) for c in names if c in own], F.struct(*[F.col(quoted[c]).alias(f"c{k}") for k, c in enumerate(rest)]).alias("_rest") if rest else F.lit(None).cast("int").alias("_rest"))

    def back(out: DataFrame, *extra: str) -> DataFrame:
        """extra: columns of out that are added, in place of those of the same name."""
        return out.select(*[F.col(quoted[c]) if c in own else F.col(f"_rest.c{rest.index(c)}").alias(c) for c in names if c not in extra], *extra)

    return packed, back


def dense_slots(df: DataFrame, group: list[str], sub: str, order: list[Column], name: str) -> DataFrame:
    """Adds name: the row's place, from 0 and gapless, in its group by (sub, order).

    sub splits every group into many small ones, so that no group meets in one task: places are counted inside
    (group, sub), and the counts before each sub come from one row per (group, sub).
    """
    keys = [*group, sub]
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy(sub).rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    placed = df.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    out = placed.join(base, on=same, how="inner")
    return out.withColumn(name, (F.col("_base") + F.col("_at") - 1).cast("long")).drop("_base", "_at", *[f"_k_{k}" for k in keys])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (constants of the public splitmix64 finalizer)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


PRIME = np.uint64(0x9E3779B97F4A7C15)
#: 64 random bits for each byte, and an odd base for positions.
BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * PRIME)
BASE = 0xD1342543DE82EF95


class Alphabet:
    """Which bytes part words, and the bits of each other byte; lower: A-Z count as a-z."""

    def __init__(self, parts, lower: bool = False) -> None:
        self.inside = ~np.isin(np.arange(256), list(parts))
        fold = np.arange(256)
        fold[65:91] += 32 * lower
        self.bits = np.where(self.inside, BYTES[fold], np.uint64(0))


SPACES = (9, 10, 11, 12, 13, 32)
PLAIN, FOLDED = Alphabet(SPACES), Alphabet(SPACES, lower=True)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, x, np.uint64)]), dtype=np.uint64) for x in (BASE, pow(BASE, -1, 2**64)))


#: Bytes of text that are hashed at once.
PORTION = 1 << 18


def word_hashes(b: np.ndarray, alphabet: Alphabet, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, first byte) of each word in the bytes b. A word's bytes are weighted by position, from one running sum; edges are
    the places where another text begins, which part words too."""
    power, inverse = _powers(PORTION << max(0, len(b).bit_length() - PORTION.bit_length() + 1))
    inside = alphabet.inside.take(b)
    weighted = alphabet.bits.take(b)
    weighted *= power[: len(b)]
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(weighted, out=sums[1:])
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = edges[(edges > 0) & (edges < len(b))]
    first[edges], last[edges - 1] = inside[edges], inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return mix64((sums[ends] - sums[starts]) * inverse[starts]), starts


def text_portions(column: pa.Array, alphabet: Alphabet) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, bounds) of a portion of texts: row k of the portion has the hashes from bounds[k] to bounds[k + 1]. Null
    is empty. Many short texts make one portion; a long text is hashed piece by piece, cut at parting bytes, and comes alone."""
    n = len(column)
    if not n:
        return
    _, raw, data = column.buffers()
    offsets = np.frombuffer(raw, np.int64 if column.type == pa.large_string() else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    none = np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False))
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PORTION, "right")) - 1)
        if len(none):  # a null's bytes, if any, belong to no text
            low = int(np.searchsorted(none, at))
            stop = int(none[low]) if low < len(none) else n
            if stop == at:
                yield at, np.zeros(0, np.uint64), np.zeros(2, np.int64)
                at += 1
                continue
            end = min(end, stop)
        p, q = int(offsets[at]), int(offsets[end])
        if q - p <= PORTION:
            edges = offsets[at : end + 1] - p
            hashes, starts = word_hashes(data[p:q], alphabet, edges)
            yield at, hashes, np.searchsorted(starts, edges)
        else:
            found = []
            while p < q:
                cut = min(p + PORTION, q)
                while cut < q and alphabet.inside[data[cut]]:
                    cut += 1
                found.append(word_hashes(data[p:cut], alphabet, np.zeros(0, np.int64))[0])
                p = cut
            hashes = np.concatenate(found)
            yield at, hashes, np.array([0, len(hashes)])
        at = end


def text_words(column: pa.Array, alphabet: Alphabet = PLAIN) -> Iterator[np.ndarray]:
    """The word hashes of each text in turn."""
    for _, hashes, bounds in text_portions(column, alphabet):
        for low, high in zip(bounds, bounds[1:]):
            yield hashes[low:high]


def words_of(text: str | None, alphabet: Alphabet = PLAIN) -> np.ndarray:
    return next(text_words(pa.array([text], pa.string()), alphabet))
