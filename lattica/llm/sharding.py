"""Sharding by histogram sort: splitters from exact byte counts, refined until they meet the tolerance, then one exchange."""

from __future__ import annotations

import os.path
from bisect import bisect_left
from collections import defaultdict
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dense_slots, stash

#: Hex digits by which a probe interval is refined in a round: 4,096 probes for each open splitter.
DIGITS = 3


def sort_key(text_col: str = "text", id_col: str = "doc_id"):
    """64 hex digits: equal texts are neighbours, and a group of equal texts is ordered by id, so that it can be cut."""
    part = lambda c: F.md5(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return F.concat(part(text_col), part(id_col))


def splitters(rows: DataFrame, n_shards: int, tolerance: int = 0) -> list[str]:
    """Keys above which shards 1, 2, ... begin, of rows(key, size).

    A round counts exact bytes and rows under each candidate prefix of the still open intervals (at most 4,096 a splitter
    reach the driver); a splitter closes when at most tolerance bytes, or one key, lie in its interval. Then a row
    is in shard floor(bytes before its key * n_shards / all bytes), up to the tolerance.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    done: dict[int, str] = {}
    at = {i: ("", 0) for i in range(1, n_shards)}
    while at:
        by_length = defaultdict(set)
        for prefix, _ in at.values():
            by_length[len(prefix)].add(prefix)
        probes = {}
        for length, prefixes in by_length.items():
            inside = rows.filter(F.substring("key", 1, length).isin(sorted(prefixes))) if length else rows
            for r in inside.groupBy(F.substring("key", 1, length + DIGITS).alias("bin")).agg(F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high")).collect():
                probes.setdefault(r["bin"][:length], []).append((r["bin"], r["bytes"], r["low"], r["high"]))
        sums = {p: (b := sorted(bins), list(accumulate(x[1] for x in b))) for p, bins in probes.items()}
        for i, (prefix, below) in list(at.items()):
            bins, upto = sums[prefix]
            # first bin whose end reaches the goal i * total / n_shards
            k = bisect_left(upto, -(-i * total // n_shards) - below)
            name, size, low, high = bins[k]
            reached = below + upto[k]
            if reached * n_shards == i * total or low == high or size <= tolerance:
                done[i] = high
                del at[i]
            else:
                at[i] = (os.path.commonprefix([low, high]), reached - size)
    return [done[i] for i in sorted(done)]


def shard_rows(rows: DataFrame, n_shards: int, tolerance: int = 0) -> DataFrame:
    """rows(key, size, ...) with shard (sizes near equal) and slot (gapless from 0 in each shard).

    Repeated rows (one key) stay together. A key group of any size is dealt by further digits of the key when slots are counted.
    """
    shard = F.lit(0)
    for s in splitters(rows, n_shards, tolerance):
        shard = shard + (F.col("key") > s).cast("int")
    rows = rows.withColumns({"shard": shard.cast("int"), "_sub": F.concat(F.substring("key", 1, 3), F.substring("key", 33, 2))})
    return dense_slots(rows, ["shard"], "_sub", [F.col("key"), F.col("size")], "slot").drop("_sub")


def shard(docs: DataFrame, n_shards: int = 40, tolerance: int = 0, overhead: int = 16, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, size (UTF-8 bytes plus overhead), text_crc32, law, shard, slot, grown_shard (null: only a key law grows).

    Null text: size is the overhead, the checksum that of no bytes. Null ids count as the empty id. Repeated rows lie in one shard.
    Empty table: no rows. The texts themselves are read once; rounds and exchange work on one short row a document.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), sort_key(text_col, id_col).alias("key"))
    out = shard_rows(stash(rows), n_shards, tolerance)
    return out.select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The checksum's remainders of half a byte.
NIBBLES = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]::BIGINT[]"
_LOW = f"xor(c >> 4, ({NIBBLES})[(xor(c, b % 16) & 15) + 1])"
_BYTE = f"xor(({_LOW}) >> 4, ({NIBBLES})[(xor({_LOW}, b // 16) & 15) + 1])"
CRC32 = f"xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT)), lambda c, b: {_BYTE}, 4294967295::BIGINT), 4294967295::BIGINT)"

ORACLE = rf"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS text, strlen(COALESCE(text, '')) + 16 AS size, md5(COALESCE(text, '')) || md5(COALESCE(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
r AS (SELECT *, SUM(size) OVER () AS total, SUM(size) OVER (ORDER BY k RANGE UNBOUNDED PRECEDING) - SUM(size) OVER (PARTITION BY k) AS start FROM d),
s AS (SELECT doc_id, text, size, k, CAST(floor(CAST(start * 40 AS BIGINT) // CAST(total AS BIGINT)) AS INTEGER) AS shard FROM r)
SELECT doc_id, size, {CRC32} AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY substr(k, 1, 3) || substr(k, 33, 2), k, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""
