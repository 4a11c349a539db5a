"""Packing documents into fixed windows by minimum bin slack.

Texts are tokenized once into a table of pieces; full windows stand alone, and the remaining lengths (at most window - 1
distinct ones) are packed by their histogram: which multisets of lengths fill a window is planned on counts, then every
piece finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dense_slots, field, in_python, stash

END = 1
PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Bytes as the byte-level vocabulary spells them: printable ones as themselves, the others from U+0100 on.
SPELT = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
SPELT |= {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in SPELT)}
LETTERS_THEN_SIGNS = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-^`{-~]+)")


class WordIds(dict):
    """word -> its ids as little-endian 32-bit bytes. The vocabulary drops white space and joins nothing across it, so a
    text's ids are those of its words in turn; each distinct word is tokenized once (until LIMIT words are held).
    Letters followed by signs are two words to the vocabulary; plain Latin letters need no normalizing but lower case, and go straight
    to its merges. All else takes the tokenizer's whole way, and so do whole texts that hold an added token such as <|endoftext|>."""

    LIMIT = 700_000

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merges = self.tokenizer.model.tokenize

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.LIMIT:
            self.clear()
        if word.isalpha() and max(word) < "\u0250" and "\u0130" not in word:
            low = word.lower()
            if low != word:
                value = self[low]
            else:
                spelt = word if word.isascii() else "".join(map(SPELT.__getitem__, word.encode()))
                value = array("I", [t.id for t in self.merges(spelt)]).tobytes()
        elif (m := LETTERS_THEN_SIGNS.fullmatch(word)) and max(m[1]) < "\u0250":
            value = self[m[1]] + self[m[2]]
        else:
            value = self.whole(word)
        self[word] = value
        return value

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def of(self, text: str) -> bytes:
        if any(token in text for token in self.added):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.split(" ")))


@cache
def word_ids(path: str) -> WordIds:
    """One for each Python worker, kept from task to task."""
    return WordIds(path)


def pieces_of(batches: Iterator[pa.RecordBatch], vocabulary: str, window: int) -> Iterator[pa.RecordBatch]:
    words = word_ids(vocabulary)
    end, step = END.to_bytes(4, "little"), 4 * window
    for batch in batches:
        rows: list[tuple] = []
        for k, text in enumerate(batch.column(1)):
            ids = words.of((text.as_py() or "").replace("\n", " ")) + end
            rows += [(k, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4) for at in range(0, len(ids), step) for part in (ids[at : at + step],)]
        at, *columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])


def pieces(docs: DataFrame, vocabulary: str, window: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return in_python(docs.select(id_col, text_col), lambda it: pieces_of(it, vocabulary, window), f"{field(docs, id_col, 'doc_id')}, {PIECES}")


def fill_window(counts: dict[int, int], window: int) -> list[int]:
    """Lengths, as many of each as counts allow, that leave the least slack, the longest remaining length included.

    Bit s of a set says that sum s can be reached with the lengths so far (longest first; counts as powers of two). The walk stops when the
    window is full; the best sum is then traced back through the sets.
    """
    first = max(counts)
    room = window - first
    reach, trail = 1, []
    limit = (1 << (room + 1)) - 1
    for length in sorted((c for c in counts if c <= room), reverse=True):
        left = min(counts[length] - (length == first), room // length)
        k = 1
        while left > 0:
            take = min(k, left)
            trail.append((length, take, reach))
            reach |= (reach << (length * take)) & limit
            left -= take
            k *= 2
        if reach >> room & 1:
            break
    best, chosen = reach.bit_length() - 1, [first]
    for length, take, before in reversed(trail):
        if not before >> best & 1:
            chosen += [length] * take
            best -= length * take
    return chosen


def plan(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, copies in the pattern, first window, offset of its first copy) rows, for ranks on end.

    Each pattern is used as often as the counts allow, which uses up at least one length: there are at most as many patterns
    as distinct lengths, times the few that remainders add.
    """
    counts, ranks, rows, at = {k: v for k, v in counts.items() if v}, dict.fromkeys(counts, 0), [], 0
    while counts:
        chosen = fill_window(counts, window)
        need = {c: chosen.count(c) for c in chosen}
        times = min(counts[c] // n for c, n in need.items())
        offset = 0
        for c, n in need.items():
            rows.append((c, ranks[c], n, at, offset, times))
            ranks[c] += n * times
            offset += c * n
            counts[c] -= n * times
            if not counts[c]:
                del counts[c]
        at += times
    return rows


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and the end id, cut every window ids; null and empty texts are the end id alone. Repeated rows are
    packed each. Ids keep their type, null ids stay null. Pieces of a full window come first, then the planned windows; no piece is cut again.
    Empty table: no rows.
    """
    cut = stash(pieces(docs, vocabulary or default_vocabulary(), window, id_col, text_col))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most window rows
    whole = counts.pop(window, 0)
    spark = docs.sparkSession
    steps = spark.createDataFrame(plan(counts, window), "p_length long, p_rank long, p_copies long, p_first long, p_offset long, p_times long")
    keyed = cut.withColumn("_sub", F.pmod(F.xxhash64("doc_id", "start"), F.lit(1024)).cast("int"))
    order = [F.col(c) for c in ("doc_id", "start", "ids_crc32")]
    ranked = dense_slots(keyed, ["length"], "_sub", order, "_rank")
    full = ranked.filter(F.col("length") == window).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("_rank").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    inside = (F.col("length") == F.col("p_length")) & (F.col("_rank") >= F.col("p_rank")) & (F.col("_rank") < F.col("p_rank") + F.col("p_copies") * F.col("p_times"))
    k = F.col("_rank") - F.col("p_rank")
    rest = ranked.filter(F.col("length") < window).join(F.broadcast(steps), inside)  # steps: bounded by the window
    rest = rest.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.lit(whole) + F.col("p_first") + F.floor(k / F.col("p_copies"))).cast("long").alias("sequence_id"), (F.col("p_offset") + (k % F.col("p_copies")) * F.col("length")).cast("long").alias("offset"))
    return full.unionByName(rest)
