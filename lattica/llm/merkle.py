"""Merkle dataset manifest by lag and lead windows, in DataFrame functions only.

Leaves are numbered without gaps in each group. A block of 2 ** BITS consecutive slots holds whole subtrees, so that one exchange by
(group, block) serves all its levels: on a level, the node that begins at a slot finds its sibling a fixed number of rows before or after it, masked by
the slot and the run's length, and the first child's row hashes the parent. The blocks' roots are the leaves of the next round; the rounds grow
with the logarithm of the rows. Siblings come down the same way, and a block's own path is joined to its rows once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stash

#: Levels of a block: 1,024 rows.
BITS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<sib: string, before: boolean>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts in a row."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def framed(value: Column) -> Column:
    """`-` for null, else UTF-8 byte count, colon, value; other types by their decimal text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*[framed(v) for v in values])


def numbered(leaves: DataFrame, order: list[Column]) -> DataFrame:
    """leaves(group, ...) with slot (from 0, gapless, in its group by order) and n (rows of the group).

    One exchange by ranges of (group, order), so that a group of any size lies over many tasks; a row's number in its task less that of its group's
    first row there, and the group's rows in earlier tasks, give the slot. order has to tell all rows apart, and to be the same each time."""
    dealt = leaves.repartitionByRange(F.col("group"), *order).sortWithinPartitions(F.col("group"), *order)
    rows = stash(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    runs = rows.groupBy("group", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy("group")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("group", "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("n"))
    return rows.join(runs, ["group", "_part"]).withColumn("slot", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def ascend(nodes: DataFrame, bits: int) -> DataFrame:
    """nodes(group, slot, n, hash) with block, for each level l its siblings' column s<l>, and the block's root in the first row's `hash`."""
    slot, n = F.col("slot"), F.col("n")
    run = Window.partitionBy("group", "block").orderBy("slot")
    out = nodes.withColumn("block", F.shiftright("slot", bits))
    for level in range(bits):
        step = 1 << level
        out = out.withColumns({"_next": F.lead("hash", step).over(run), "_last": F.lag("hash", step).over(run)})
        left, more = slot.bitwiseAND(F.lit(step)) == 0, n > step
        after = F.when(slot + step < n, F.col("_next"))
        node = (slot % step == 0) & more
        out = out.withColumns(
            {
                f"s{level}": F.when(node, F.when(left, after).otherwise(F.col("_last"))),
                "hash": F.when(slot % (2 * step) == 0, F.when(more, digest(F.col("hash"), F.coalesce(after, F.lit("")))).otherwise(F.col("hash"))),
            }
        )
    return out.drop("_next", "_last")


def heads(nodes: DataFrame, bits: int) -> DataFrame:
    """The blocks' roots as nodes of the next round."""
    size = 1 << bits
    first = ascend(nodes.select("group", "slot", "n", "hash"), bits).filter(F.col("slot") % size == 0)
    return first.select("group", F.col("block").alias("slot"), F.ceil(F.col("n") / size).cast("long").alias("n"), "hash")


def descend(nodes: DataFrame, bits: int) -> DataFrame:
    """nodes with block and path: the siblings from the node up to its block's root, each with whether it comes before; a level that has no
    sibling, but a parent, has a null one."""
    slot, n = F.col("slot"), F.col("n")
    run = Window.partitionBy("group", "block").orderBy("slot")
    none = F.array().cast(PATH)
    out = ascend(nodes.withColumn("_own", F.col("hash")), bits).withColumn("path", none)
    for level in reversed(range(bits)):
        step = 1 << level
        left = slot.bitwiseAND(F.lit(step)) == 0
        out = out.withColumn("_up", F.lag("path", step).over(run))
        rest = F.when(left, F.col("path")).otherwise(F.col("_up"))
        own = F.array(F.struct(F.col(f"s{level}").alias("sib"), (~left).alias("before"))).cast(PATH)
        out = out.withColumn("path", F.when(slot % step == 0, F.when(n > step, F.concat(own, rest)).otherwise(rest))).drop("_up", f"s{level}")
    return out.withColumn("hash", F.col("_own")).drop("_own")


def trees(nodes: DataFrame, bits: int) -> tuple[list[tuple[DataFrame, int]], DataFrame]:
    """The nodes of every round with its levels, and (group, slot 0, n 1, hash) with the roots."""
    rounds, size = [], nodes.agg(F.max("n")).first()[0] or 0
    while True:
        levels = min(bits, max(1, (size - 1).bit_length()))
        rounds.append((nodes, levels))
        nodes = stash(heads(nodes, levels))
        size = -(-size >> levels)
        if size <= 1:
            return rounds, nodes


def with_paths(rounds: list[tuple[DataFrame, int]], tops: DataFrame) -> DataFrame:
    """The first round's nodes with their whole path: that of the group's row of tops(group, slot, path, ...), after those of the rounds.
    Other columns of tops come along. A row of a round meets at most 2 ** BITS rows of the one below."""
    above = tops
    for nodes, bits in reversed(rounds):
        upper = above.select("group", F.col("slot").alias("block"), F.col("path").alias("_above"), *[c for c in above.columns if c not in ("group", "slot", "n", "hash", "path")])
        above = descend(nodes, bits).join(upper, ["group", "block"]).withColumn("path", F.concat("path", "_above")).drop("_above", "block")
    return above


def fold(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings on its path."""
    return F.aggregate(path, start, lambda acc, x: F.when(x["before"], digest(x["sib"], acc)).otherwise(digest(acc, F.coalesce(x["sib"], F.lit("")))))


def proof(path: Column) -> Column:
    """The digest of all siblings on a path."""
    return digest(F.array_join(F.transform(path, lambda x: x["sib"]), ""))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, by: str = "lang", id_col: str = "doc_id", also: dict[str, Column] | None = None, bits: int = BITS) -> DataFrame:
    """id, leaf, path, subroot, root for every row of docs, and the columns of `also`, computed from docs with the leaf.

    A leaf is the digest of the fields. Per value of `by` (null is a group of its own, the first) leaves ascend by id, null ids first, then by
    digest; repeated rows are leaves of their own. Subroots in the order of the groups' UTF-8 bytes make the root. A lone leaf is its
    subroot, a lone subroot the root. Empty table: no rows. Other columns of docs play no part. Texts are read once.
    """
    also = also or {}
    group = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit(""))  # null sorts before all values, the empty one too
    rows = docs.select(F.col(id_col).alias("_id"), group.alias("group"), leaf(*[F.col(c) for c in fields]).alias("hash"), F.monotonically_increasing_id().alias("_row"), *[c.alias(f"_also_{name}") for name, c in also.items()])
    leaves = stash(numbered(stash(rows), [F.col("_id").asc_nulls_first(), F.col("hash"), F.col("_row")]).drop("_row"))
    rounds, subroots = trees(leaves, bits)
    named = subroots.select(F.lit("").alias("group"), F.col("group").alias("_group"), "hash")
    groups = stash(numbered(named, [F.col("_group")]))
    upper, top = trees(groups, bits)
    top = top.select("group", "slot", F.array().cast(PATH).alias("path"), F.col("hash").alias("root"))
    tops = with_paths(upper, top).select(F.col("_group").alias("group"), F.lit(0).cast("long").alias("slot"), "path", F.col("hash").alias("subroot"), "root")
    out = with_paths(rounds, stash(tops))
    return out.select(F.col("_id").alias(id_col), F.col("hash").alias("leaf"), "path", "subroot", "root", *[F.col(f"_also_{name}").alias(name) for name in also])


def verify(docs: DataFrame, changed: Column, by: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """The manifest, checked against rows of which those that meet `changed` had 1 added to n_chars (nulls stay): the root that follows from
    the row as it is now and its path, and whether it is the manifest's. A null `changed` counts as false."""
    values = [F.col(c) + F.lit(1) if c == "n_chars" else F.col(c) for c in FIELDS]
    out = manifest(docs, FIELDS, by, id_col, {"_now": F.when(changed, leaf(*values))})
    folded = fold(F.coalesce(F.col("_now"), F.col("leaf")), F.col("path"))
    out = out.select(id_col, "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 0


def _levels(name: str, base: str, key: str) -> str:
    """SQL of a tree by lists of digests, one row a level."""
    return f"""{name} AS (SELECT {key} AS k, 0 AS level, hs FROM {base}
 UNION ALL SELECT k, level + 1, list_transform(range(0, CAST(len(hs) AS BIGINT), 2), lambda i: sha256(hs[i + 1] || COALESCE(hs[i + 2], ''))) FROM {name} WHERE len(hs) > 1)"""


def _framed(column: str) -> str:
    return f"COALESCE(strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR), '-')"


def _crc32(value: str) -> str:
    from .sharding import CRC32

    return CRC32.replace("encode(text)", f"encode({value})")


ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, COALESCE('=' || lang, '') AS g, sha256({" || ".join(map(_framed, FIELDS))}) AS leaf,
 CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN sha256({" || ".join(_framed("n_chars + 1" if c == "n_chars" else c) for c in FIELDS)}) END AS now FROM documents),
s AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS slot FROM d),
b AS (SELECT g, list(leaf ORDER BY slot) AS hs FROM s GROUP BY g),
{_levels("t", "b", "g")},
r AS (SELECT k AS g, hs[1] AS subroot, row_number() OVER (ORDER BY encode(k)) - 1 AS place FROM t WHERE len(hs) = 1),
c AS (SELECT list(subroot ORDER BY place) AS hs FROM r),
{_levels("u", "c", "0")},
steps AS (SELECT s.doc_id, level, CASE WHEN slot >> level & 1 = 1 THEN hs[(slot >> level)] ELSE hs[(slot >> level) + 2] END AS sib, slot >> level & 1 = 1 AS before FROM s JOIN t ON t.k = s.g AND len(hs) > 1
 UNION ALL SELECT s.doc_id, 1000 + level, CASE WHEN place >> level & 1 = 1 THEN hs[(place >> level)] ELSE hs[(place >> level) + 2] END, place >> level & 1 = 1 FROM s JOIN r USING (g) JOIN u ON len(hs) > 1),
p AS (SELECT doc_id, COALESCE(string_agg(sib, '' ORDER BY level), '') AS sibs, list({{'acc': '', 'sib': COALESCE(sib, ''), 'before': before}} ORDER BY level) AS path FROM steps GROUP BY doc_id),
f AS (SELECT s.doc_id, leaf, subroot, (SELECT hs[1] FROM u WHERE len(hs) = 1) AS root, sha256(COALESCE(sibs, '')) AS proof_sha256,
 list_reduce(list_prepend({{'acc': COALESCE(now, leaf), 'sib': '', 'before': false}}, COALESCE(path, [])), lambda a, x: {{'acc': CASE WHEN x.before THEN sha256(x.sib || a.acc) ELSE sha256(a.acc || x.sib) END, 'sib': '', 'before': false}}).acc AS folded_root
 FROM s JOIN r USING (g) LEFT JOIN p ON p.doc_id = s.doc_id)
SELECT *, folded_root = root AS verified FROM f
"""
