"""Substring dedup by repeated-phrase automata.

A window (WINDOW words) is named by its phrase: the PHRASE words in it whose hash is least, the first of equals. Equal windows have equal phrases, so that
only windows under a phrase which occurs twice can repeat. Consecutive windows under one occurrence of a phrase are a run.

1. Phrases are counted with the hashes of their runs. Where all runs of a phrase are the same, the run repeats or not as one; else its windows do, one by one.
2. These units are counted: what occurs twice anywhere is confirmed.
3. Documents are dealt into blocks of bounded bytes. A block gets the phrases and the confirmed units that occur in it; its phrases are compiled to
   one Aho-Corasick automaton over word numbers, and its documents are streamed through that. At each occurrence the units around it are looked up
   among the confirmed ones, and those found cover their words.

So the automata together grow with the input, and each stays small; no document meets the patterns of another block.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLAIN, PORTION, PRIME, _powers, field, in_python, mix64, stash, text_portions

#: The method's own length of phrases, for any window that is longer.
PHRASE = 8
#: Bits of the two maps of phrases (2 ** BITS / 8 bytes each): a fixed size, so that they pass more where more phrases repeat; what they pass in excess is settled by the counts.
BITS = 27
#: Bytes of text of a block, about.
BLOCK_BYTES = 4 << 20


class Runs:
    """Hashes of any runs of a text's words, from one running sum."""

    def __init__(self, words: np.ndarray) -> None:
        power, self.inverse = _powers(PORTION << max(0, len(words).bit_length() - PORTION.bit_length() + 1))
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * power[: len(words)], out=self.sums[1:])

    def of(self, first: np.ndarray, size) -> np.ndarray:
        return mix64((self.sums[first + size] - self.sums[first]) * self.inverse[first] + np.asarray(size).astype(np.uint64) * PRIME)


def phrases(runs: Runs, n: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text of n words: the places of its windows' phrases, their hashes, the first window of each run, and its windows."""
    if n < window:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    every = runs.of(np.arange(n - PHRASE + 1), PHRASE)
    least = (every >> np.uint64(32) << np.uint64(32)) | np.arange(len(every), dtype=np.uint64)
    width, have = window - PHRASE + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    at = place[first]
    return at, every[at], first, np.diff(np.append(first, len(place)))


def counted(docs: DataFrame, window: int, text_col: str) -> DataFrame:
    """(phrase, run, n): hashes of phrases and of their runs, with occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, hashes, bounds in text_portions(batch.column(0), PLAIN):
                found = []
                for low, high in zip(bounds, bounds[1:]):
                    if high - low >= window:
                        runs = Runs(hashes[low:high])
                        _, name, first, windows = phrases(runs, high - low, window)
                        found.append((name, runs.of(first, windows + window - 1)))
                if found:
                    name, whole = (np.concatenate(x) for x in zip(*found))
                    whole, where, times = np.unique(whole, return_index=True, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(name[where].view(np.int64)), pa.array(whole.view(np.int64)), pa.array(times)], ["phrase", "run", "n"])

    return in_python(docs.select(text_col), run, "phrase long, run long, n long")


def maps(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bit maps of the phrases that occur twice, and of those with different runs among them, by the leading bits of their hashes. At most
    2 ** (BITS - 6) rows reach the driver."""
    twice = found.groupBy("phrase").agg(F.sum("n").alias("n"), (F.min("run") != F.max("run")).alias("ragged")).filter("n > 1")
    place = F.shiftrightunsigned("phrase", 64 - BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    cells = twice.groupBy(F.shiftright(place, 6).alias("cell")).agg(F.bit_or(bit).alias("all"), F.bit_or(F.when(F.col("ragged"), bit).otherwise(F.lit(0).cast("long"))).alias("some")).toArrow()
    out = []
    for name in ("all", "some"):
        full = np.zeros(1 << (BITS - 6), np.uint64)
        full[cells["cell"].to_numpy()] = cells[name].to_numpy().view(np.uint64)
        out.append(full)
    return out[0], out[1]


def passes(bits: np.ndarray, name: np.ndarray) -> np.ndarray:
    place = name >> np.uint64(64 - BITS)
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def units(rows: DataFrame, bits: tuple[np.ndarray, np.ndarray], window: int) -> DataFrame:
    """rows(block, text) as (block, words, before, size) for each phrase that may repeat, its words as 32-bit numbers, with how many words its
    run begins before it, and the run's words (size 0: its windows count one by one), and (block, unit, n) for the hashes of units."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice, ragged = shared.value
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            for row, hashes, bounds in text_portions(batch.column(1), PLAIN):
                names, counts = [], []
                for k, (low, high) in enumerate(zip(bounds, bounds[1:])):
                    if high - low < window:
                        continue
                    runs = Runs(hashes[low:high])
                    at, name, first, windows = phrases(runs, high - low, window)
                    may = np.flatnonzero(passes(twice, name))
                    if not len(may):
                        continue
                    at, first, windows, fine = at[may], first[may], windows[may], passes(ragged, name[may])
                    size = windows + window - 1
                    words = numbers(hashes[low:high])[at[:, None] + np.arange(PHRASE)]
                    names.append((np.full(len(at), blocks[row + k]), words, np.where(fine, 0, at - first), np.where(fine, 0, size)))
                    single = np.repeat(first[fine] - np.cumsum(windows[fine]) + windows[fine], windows[fine]) + np.arange(windows[fine].sum())
                    unit = np.concatenate([runs.of(first[~fine], size[~fine]), runs.of(single, window)])
                    counts.append((np.full(len(unit), blocks[row + k]), unit))
                if names:
                    block, words, before, size = (np.concatenate(x) for x in zip(*names))
                    key = np.concatenate([block.astype(np.uint32)[:, None], words], 1)
                    where = np.unique(np.ascontiguousarray(key).view(f"V{4 * (PHRASE + 1)}").ravel(), return_index=True)[1]
                    yield _rows(block[where], words=words[where], before=before[where], size=size[where])
                    block, unit = (np.concatenate(x) for x in zip(*counts))
                    order = np.lexsort((unit, block))
                    new = np.flatnonzero(np.concatenate([[True], (np.diff(block[order]) != 0) | (unit[order][1:] != unit[order][:-1])]))
                    yield _rows(block[order][new], unit=unit[order][new], n=np.diff(np.append(new, len(order))))

    return in_python(rows, run, "block int, words binary, before int, size int, unit long, n int")


def _rows(block, words=None, before=None, size=None, unit=None, n=None) -> pa.RecordBatch:
    of = lambda x, kind: pa.array(x.astype(kind)) if x is not None else pa.nulls(len(block), pa.from_numpy_dtype(kind))
    text = pa.nulls(len(block), pa.binary()) if words is None else _pieces(words)
    return pa.RecordBatch.from_arrays([of(block, np.int32), text, of(before, np.int32), of(size, np.int32), pa.nulls(len(block), pa.int64()) if unit is None else pa.array(unit.view(np.int64)), of(n, np.int32)], ["block", "words", "before", "size", "unit", "n"])


def _pieces(words: np.ndarray) -> pa.Array:
    offsets = np.arange(len(words) + 1, dtype=np.int32) * (4 * PHRASE)
    return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(words, np.uint32))])


def numbers(hashes: np.ndarray) -> np.ndarray:
    """Words as the automaton's letters."""
    return (hashes & np.uint64(0x7FFFFFFF)).astype(np.uint32)


#: Words that pass through the automaton at once; and bits by which three words in a row are looked up before.
STREAM, TRIPLES = 1 << 16, 20


def triples(letters: np.ndarray) -> np.ndarray:
    """A number below 2 ** TRIPLES for each three words in a row, along the last axis."""
    a, b, c = (letters[..., k : letters.shape[-1] - 2 + k].astype(np.uint64) for k in range(3))
    with np.errstate(over="ignore"):
        return ((a * PRIME + b) * PRIME + c) * PRIME >> np.uint64(64 - TRIPLES)


class Shard:
    """A block's automaton and confirmed units."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.words: list[np.ndarray] = []
        self.spans: list[np.ndarray] = []
        self.units: list[np.ndarray] = []
        self.automaton = None
        self.known = np.zeros(0, bool)

    def add(self, batch: pa.RecordBatch) -> None:
        kind = batch.column(1).to_numpy()
        if (named := np.flatnonzero(kind == 0)).size:
            part = batch.take(pa.array(named))
            self.words.append(np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint32).reshape(-1, PHRASE))
            self.spans.append(np.stack([part.column(c).to_numpy() for c in (5, 6)], 1))
        if (sure := np.flatnonzero(kind == 1)).size:
            self.units.append(batch.column(7).take(pa.array(sure)).to_numpy().view(np.uint64))

    def compile(self) -> None:
        self.units = [np.unique(np.concatenate(self.units))] if self.units else []
        if not self.units or not self.words:
            return
        words = np.concatenate(self.words)
        where = np.unique(words.view(f"V{4 * PHRASE}").ravel(), return_index=True)[1]
        self.words, self.spans = [], [np.concatenate(self.spans)[where]]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for k, phrase in enumerate(words[where].tolist()):
            self.automaton.add_word(tuple(phrase), k)
        self.automaton.make_automaton()
        self.known = np.zeros(1 << TRIPLES, bool)
        self.known[triples(words[where])] = True

    def confirmed(self, found: np.ndarray) -> np.ndarray:
        near = np.minimum(np.searchsorted(self.units[0], found), len(self.units[0]) - 1)
        return self.units[0][near] == found

    def runs(self, letters: np.ndarray) -> list[list[int]]:
        """The stretches of words that can hold phrases, as each three words in a row are those of some phrase; all others need not be read by the automaton."""
        good = np.concatenate([[0], np.cumsum(self.known[triples(letters)])])
        starts = np.flatnonzero(good[PHRASE - 2 :] - good[: -(PHRASE - 2)] == PHRASE - 2)
        edge = np.zeros(len(letters) + 1, np.int64)
        edge[starts] += 1
        edge[starts + PHRASE] -= 1
        return np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(edge[:-1]) > 0, [0]]).astype(np.int8))).reshape(-1, 2).tolist()

    def covered(self, hashes: np.ndarray) -> np.ndarray | None:
        """Which words of a text are in a confirmed window; None if none is."""
        n = len(hashes)
        if self.automaton is None or n < self.window:
            return None
        letters = numbers(hashes)
        hits: list[tuple[int, int]] = []
        for first, last in self.runs(letters):
            for low in range(first, last, STREAM):
                begin = max(first, low - PHRASE + 1)
                hits.extend((begin + end, k) for end, k in self.automaton.iter(tuple(letters[begin : min(last, low + STREAM)].tolist())))
        if not hits:
            return None
        at, which = np.array(hits, np.int64).T
        at = at - PHRASE + 1
        before, size = self.spans[0][which].astype(np.int64).T
        runs = Runs(hashes)
        whole = (size > 0) & (at >= before) & (at - before + size <= n)
        first, length = (at - before)[whole], size[whole]
        sure = self.confirmed(runs.of(first, length))
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, first[sure], 1)
        np.add.at(edge, (first + length)[sure], -1)
        fine = at[size == 0]
        if len(fine):
            near = np.zeros(n + 2, np.int64)  # windows around these phrases
            np.add.at(near, np.clip(fine + PHRASE - self.window, 0, n - self.window + 1), 1)
            np.add.at(near, np.clip(fine + 1, 0, n - self.window + 1), -1)
            starts = np.flatnonzero(np.cumsum(near)[: n - self.window + 1])
            starts = starts[self.confirmed(runs.of(starts, self.window))]
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + self.window, -1)
        return np.cumsum(edge[:-1]) > 0


def located(rows: DataFrame, window: int) -> DataFrame:
    """rows(block, kind, id, text, words, before, size, unit), sorted by (block, kind), as (id, n_words, removed, kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard, ready = None, Shard(window), False
        for batch in batches:
            blocks, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            key = blocks.astype(np.int64) * 2 + (kinds == 2)
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                part = batch.slice(low, high - low)
                if blocks[low] != at:
                    at, shard, ready = blocks[low], Shard(window), False
                if kinds[low] != 2:
                    shard.add(part)
                    continue
                if not ready:
                    shard.compile()
                    ready = True
                yield _kept(part, shard)

    return in_python(rows, run, f"{field(rows, 'id')}, n_words long, removed array<struct<start: bigint, end: bigint>>, kept string")


def _kept(part: pa.RecordBatch, shard: Shard) -> pa.RecordBatch:
    n, spans, kept = [], [], []
    texts = part.column(3)
    for row, hashes, bounds in text_portions(texts, PLAIN):
        for k, (low, high) in enumerate(zip(bounds, bounds[1:])):
            words = (texts[row + k].as_py() or "").encode().split()  # at the six ASCII spaces
            gone = shard.covered(hashes[low:high])
            n.append(len(words))
            edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).reshape(-1, 2).tolist() if gone is not None else []
            spans.append([{"start": a, "end": b} for a, b in edges])
            ends = [0, *(x for e in edges for x in e), len(words)]
            kept.append(b" ".join([w for a, b in zip(ends[::2], ends[1::2]) for w in words[a:b]]).decode())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays([part.column(2), pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())], ["id", "n_words", "removed", "kept"])


def dedup(docs: DataFrame, window: int = 35, blocks: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, removed (ranges of words, ends exclusive) and kept (the other words, joined by one space) of every document.

    Removed is each word that is covered by a window of `window` (more than PHRASE) words of one document whose words, unchanged, also begin at another place,
    in the same document or elsewhere. Null, empty and short texts: nothing is removed. Repeated rows repeat each other's windows, as copies do.
    Empty table: no rows. Other columns play no part. Windows are compared by 64-bit hashes. Blocks of documents have about BLOCK_BYTES of text.
    """
    if window <= PHRASE:
        raise ValueError(f"windows have more than {PHRASE} words")
    spark = docs.sparkSession
    if blocks is None:
        total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        blocks = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCK_BYTES))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))
    found = stash(units(rows.select("block", "text"), maps(counted(docs, window, text_col)), window))
    known = found.filter(F.col("unit").isNotNull()).select("block", "unit", "n")
    twice = stash(known.groupBy("unit").agg(F.sum("n").alias("n")).filter("n > 1").select("unit"))
    sure = known.select("block", "unit").join(twice, "unit")
    empty = lambda name, kind: F.lit(None).cast(kind).alias(name)
    id_type = rows.schema["id"].dataType
    named = found.filter(F.col("words").isNotNull()).select("block", F.lit(0).alias("kind"), empty("id", id_type), empty("text", "string"), "words", "before", "size", empty("unit", "long"))
    sure = sure.select("block", F.lit(1).alias("kind"), empty("id", id_type), empty("text", "string"), empty("words", "binary"), empty("before", "int"), empty("size", "int"), "unit")
    texts = rows.select("block", F.lit(2).alias("kind"), "id", "text", empty("words", "binary"), empty("before", "int"), empty("size", "int"), empty("unit", "long"))
    dealt = named.unionByName(sure).unionByName(texts).repartition("block").sortWithinPartitions("block", "kind")
    return located(dealt, window).withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(id_col, "n_words", gone.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
