"""Ranked lexical search by multi-query common-subexpression evaluation.

Items are taken in blocks. Within a block, term sets that items share are mined pair by pair: the pair of operands (terms or sums found before) that
most items hold becomes one sum, which takes the pair's place in those items, until no pair is shared. The sums form a DAG over the terms. Documents
are streamed once a block: for a portion of them each sum is materialised once, as one vector over the portion, and the items' scores are put together from the
sums and the terms that are left over. Every task keeps the best k of each item; these are ranked by salted windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Alphabet, field, in_python, release, stash, text_portions

#: Terms are runs of ASCII letters and digits and of all characters beyond ASCII; A-Z count as a-z.
TERMS = Alphabet([b for b in range(128) if not chr(b).isalnum()], lower=True)
#: Operands (distinct terms of an item, copies of a repeated one included) of a block of items, of one mined family of pieces, and of one piece of a long item.
BLOCK, FAMILY, PIECE = 65_536, 2048, 512
#: Cells (8 bytes) of the accumulators that a task holds at once.
CELLS = 1 << 22
#: An item's candidates from many tasks are first ranked in so many parts.
SALTS = 64


def operands(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, term, copy): an item's distinct terms as 64-bit hashes; a term that occurs c times has copies 1 to c. Rows of one item with the same
    text count once, those with different texts make one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, hashes, bounds in text_portions(batch.column(1), TERMS):
                for k, (low, high) in enumerate(zip(bounds, bounds[1:])):
                    terms, counts = np.unique(hashes[low:high].view(np.int64), return_counts=True)
                    row = np.full(len(terms), at + k, np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(terms), pa.array(counts)], ["item", "term", "times"])

    rows = items.filter(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).distinct()
    found = in_python(rows, run, f"{field(rows, 'item')}, term long, times long")
    return found.groupBy("item", "term").agg(F.sum("times").alias("times")).select("item", "term", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy"))


def share(holds: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """holds (operands x pieces, 0 or 1) as sums of two operands each, in order, numbered after the operands, and what each piece
    then holds of operands and sums. A sum stands for a pair that at least two pieces hold; the one that most hold is taken first."""
    n, pieces = holds.shape
    most = 2 * n
    held = np.zeros((most, pieces), np.float32)
    held[:n] = holds
    pairs = np.zeros((most, most), np.uint16)
    pairs[:n, :n] = held[:n] @ held[:n].T
    np.fill_diagonal(pairs, 0)
    bound = pairs.max(1, initial=0)  # at least a row's greatest count: counts of pairs only fall
    sums: list[tuple[int, int]] = []
    size = n
    while size < most:
        a = int(bound.argmax())
        b = int(pairs[a].argmax())
        if bound[a] < 2:
            break
        if pairs[a, b] < bound[a]:
            bound[a] = pairs[a, b]
            continue
        both = held[a] * held[b]
        held[size] = both
        held[a] -= both
        held[b] -= both
        size += 1
        for r in (a, b, size - 1):
            pairs[r, :size] = pairs[:size, r] = held[:size] @ held[r]
            pairs[r, r] = 0
        bound = np.maximum(bound, pairs[size - 1])
        bound[size - 1] = pairs[size - 1].max()
        sums.append((a, b))
    return sums, held[:size] > 0


def _mine(rows: pd.DataFrame) -> pd.DataFrame:
    """The program of one family, in chunks of at most FAMILY operands: leaf rows (node, term in a),
    sums (node, operands in a and b), parts of items (item, node)."""
    out: list[tuple] = []
    chunk: list[pd.DataFrame] = []
    held, number = 0, 0

    def finish() -> None:
        nonlocal chunk, held, number
        part = pd.concat(chunk)
        family = int(part["family"].iloc[0])
        names, at = np.unique(part[["term", "copy"]].to_records(index=False), return_inverse=True)
        pieces, to = np.unique(part["piece_no"].to_numpy(), return_inverse=True)
        holds = np.zeros((len(names), len(pieces)), bool)
        holds[at, to] = True
        sums, left = share(holds)
        item = part.groupby("piece_no")["item"].first().loc[pieces].tolist()
        # no nulls, which pandas would make 64-bit numbers doubles for
        out.extend((family, number, "leaf", k, int(term), 0, item[0]) for k, (term, _) in enumerate(names))
        out.extend((family, number, "sum", len(names) + k, a, b, item[0]) for k, (a, b) in enumerate(sums))
        out.extend((family, number, "part", int(node), 0, 0, item[p]) for p in range(len(pieces)) for node in np.flatnonzero(left[:, p]))
        chunk, held, number = [], 0, number + 1

    rows = rows.assign(piece_no=rows.groupby(["item", "piece"], sort=True).ngroup())
    for _, piece in rows.groupby("piece_no", sort=True):
        if chunk and held + len(piece) > FAMILY:
            finish()
        chunk.append(piece)
        held += len(piece)
    finish()
    return pd.DataFrame(out, columns=["family", "chunk", "kind", "node", "a", "b", "item"])


@dataclass
class Program:
    """A block's shared evaluation. terms: sorted hashes, whose accumulators are the first rows; levels: (row of the first sum, left rows, right rows) in an order in
    which operands come first; items with their parts: rows, and where each item's begin."""

    terms: np.ndarray
    levels: list[tuple[int, np.ndarray, np.ndarray]]
    rows: int
    items: list
    parts: np.ndarray
    starts: np.ndarray

    def totals(self, leaves: np.ndarray) -> np.ndarray:
        """Items x documents from terms x documents, exact in 64 bits."""
        acc = np.empty((self.rows, leaves.shape[1]), np.int64)
        acc[: len(leaves)] = leaves
        for first, left, right in self.levels:
            np.add(acc[left], acc[right], out=acc[first : first + len(left)])
        return np.add.reduceat(acc[self.parts], self.starts, axis=0)


def program(mined: DataFrame) -> Program:
    """Put together on the driver from a block's rows, of which there are a few for each of its operands."""
    rows = mined.orderBy("family", "chunk", "node").collect()
    terms = np.unique(np.array([r["a"] for r in rows if r["kind"] == "leaf"], np.int64))
    place, depth, at = {}, {}, len(terms)
    by_depth: dict[int, list[tuple]] = {}
    for r in rows:
        key = (r["family"], r["chunk"], r["node"])
        if r["kind"] == "leaf":
            place[key], depth[key] = int(np.searchsorted(terms, r["a"])), 0
        elif r["kind"] == "sum":
            left, right = (key[:2] + (r[c],) for c in "ab")
            depth[key] = 1 + max(depth[left], depth[right])
            by_depth.setdefault(depth[key], []).append((key, left, right))
    levels = []
    for d in sorted(by_depth):
        for k, (key, _, _) in enumerate(by_depth[d]):
            place[key] = at + k
        levels.append((at, np.array([place[x] for _, x, _ in by_depth[d]]), np.array([place[y] for _, _, y in by_depth[d]])))
        at += len(by_depth[d])
    parts: dict = {}
    for r in rows:
        if r["kind"] == "part":
            parts.setdefault(r["item"], []).append(place[(r["family"], r["chunk"], r["node"])])
    sizes = [len(x) for x in parts.values()]
    return Program(terms, levels, at, list(parts), np.array([x for p in parts.values() for x in p], np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if parts else np.zeros(0, np.int64))


def postings(docs: DataFrame, terms: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(id, n, at, tf): all terms of a document counted, and its known terms, by their place in terms, with their occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            n, sizes, at, tf = [], [0], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, hashes, bounds in text_portions(batch.column(1), TERMS):
                words = hashes.view(np.int64)
                near = np.minimum(np.searchsorted(known, words), max(0, len(known) - 1))
                hit = np.flatnonzero(known[near] == words) if len(known) else np.zeros(0, np.int64)
                row = np.searchsorted(bounds, hit, "right") - 1
                cells, counts = np.unique(row * len(known) + near[hit], return_counts=True)
                n.extend(np.diff(bounds).tolist())
                sizes.extend(np.bincount(cells // max(1, len(known)), minlength=len(bounds) - 1).tolist())
                at.append(cells % max(1, len(known)))
                tf.append(counts)
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate(x).astype(np.int32))) for x in (at, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], ["id", "n", "at", "tf"])

    return in_python(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"{field(docs, id_col, 'id')}, n long, at array<int>, tf array<int>")


def best(found: DataFrame, plan: Program, weights: np.ndarray, docs: int, length: int, k: int, item_type: pa.DataType) -> DataFrame:
    """(item, id, score): the best k of each item in each task, with a score above 0."""
    shared = found.sparkSession.sparkContext.broadcast((plan, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, weights = shared.value
        kept: list[list[tuple]] = [[] for _ in plan.items]  # (-score, id is null, id) in order
        least = np.ones(len(plan.items), np.int64)
        width = max(1, CELLS // max(1, plan.rows))
        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            ids, n = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            order = sorted(range(len(ids)), key=lambda j: (ids[j] is None, ids[j]) if ids[j] is not None else (True,))
            bounds, at, tf = batch.column(2).offsets.to_numpy(), *(batch.column(c).values.to_numpy() for c in (2, 3))
            for low in range(0, len(order), width):
                rows = order[low : low + width]
                sizes = np.array([bounds[j + 1] - bounds[j] for j in rows])
                cells = np.repeat(np.array([bounds[j] for j in rows]) - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                m = np.array([25 + 75 * n[j] * docs // length for j in rows], np.int64)
                t = tf[cells].astype(np.int64)
                doc = np.repeat(np.arange(len(rows)), sizes)
                leaves = np.zeros((len(plan.terms), len(rows)), np.int64)
                leaves[at[cells], doc] = weights[at[cells]] * (10**9 * t // (1000 * t + 8 * m[doc]))
                totals = plan.totals(leaves)
                for i in np.flatnonzero(totals.max(1) >= least):
                    row = totals[i]
                    some = np.flatnonzero(row >= least[i])
                    top = some[np.argsort(-row[some], kind="stable")[:k]]  # ids ascend, so that ties do
                    new = [(-int(row[j]), ids[rows[j]] is None, ids[rows[j]]) for j in top]
                    kept[i] = sorted(kept[i] + new, key=lambda x: x[:2] + (x[2:] if not x[1] else ()))[:k]
                    if len(kept[i]) == k:
                        least[i] = -kept[i][-1][0]
        out = [(plan.items[i], x[2], -x[0]) for i, xs in enumerate(kept) for x in xs]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), (item_type, id_type, pa.int64()))], ["item", "id", "score"])

    return in_python(found.filter(F.size("at") > 0), run, f"item {_sql(item_type)}, {field(found, 'id')}, score long")


def _sql(kind: pa.DataType) -> str:
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(kind).simpleString()


def ranked(found: DataFrame, k: int) -> DataFrame:
    """rank from 1 within an item. An item's rows are ranked in parts first, so that no task gets those of all tasks."""
    order = [F.desc("score"), F.col("id").asc_nulls_last()]
    part = Window.partitionBy("item", "_part").orderBy(*order)
    some = found.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(SALTS))).withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= k)
    return some.drop("_part").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """item, rank, id, score: each item's k best documents, whole texts counted; equal scores by ascending id, null ids last.

    Null and empty texts have no terms; items without terms, and null items, have no rows; nor have documents without a score above 0.
    Repeated documents are ranked each. Empty tables: no rows. Other columns play no part. Each block of items (about `block` operands, at least
    an item) reads the texts once; what is broadcast and collected is a block's terms and sums.
    """
    asked = stash(operands(items, item_col, item_text))
    each = Window.partitionBy("item").orderBy(F.desc("_in"), "term", "copy")
    common = asked.join(asked.groupBy("term").agg(F.countDistinct("item").alias("_in")), "term").withColumn("piece", F.floor((F.row_number().over(each) - 1) / PIECE))
    size = asked.count()
    blocks = max(1, -(-size // block))
    families = max(1, -(-size // (blocks * FAMILY)))
    cut = common.select("item", "term", "copy", "piece", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block"), F.pmod(F.xxhash64(F.lit(1), "item", "piece"), F.lit(families)).cast("int").alias("family"))
    item_sql = asked.schema["item"].dataType.simpleString()
    mined = stash(cut.groupBy("block", "family").applyInPandas(_blocked, f"block int, family int, chunk int, kind string, node int, a long, b long, item {item_sql}"))
    whole, out = None, None
    for number in range(blocks):
        plan = program(mined.filter(F.col("block") == number))
        if not plan.items and out is not None:
            continue
        found = stash(postings(docs, plan.terms, id_col, text_col))
        whole = whole or found.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        counts = found.select(F.explode("at").alias("at")).groupBy("at").count().select("at", F.floor(1000 * F.log((2 * F.lit(whole[0]) + 2) / (2 * F.col("count") + 1))).alias("w")).collect()  # a row a term of the block
        weights = np.zeros(len(plan.terms), np.int64)
        for r in counts:
            weights[r["at"]] = r["w"]
        item_type = pa.array(plan.items).type if plan.items else pa.int64()
        some = stash(best(found, plan, weights, whole[0], max(1, whole[1]), k, item_type).select(F.col("item").cast(item_sql).alias("item"), "id", "score"))
        release(found)
        out = some if out is None else out.unionByName(some)
    return ranked(out, k).select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _blocked(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    out = _mine(rows)
    out.insert(0, "block", key[0])
    return out


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _terms_sql(text: str) -> str:
    return rf"unnest(regexp_extract_all(translate({text}, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"


ORACLE = f"""
WITH t AS (SELECT doc_id, {_terms_sql("text")} FROM documents),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM d),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, g GROUP BY term, docs),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_terms_sql("text")} FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)) GROUP BY item_id, term),
s AS (SELECT item_id, f.doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length)))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN w USING (term) JOIN d ON d.doc_id = f.doc_id, g GROUP BY item_id, f.doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""
