"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

DataFrame functions only. A source may hold any share of the rows: documents are dealt by (source, hash bucket), and
only one row per source and per (source, bucket) is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, stowed

OUT = ["size", "source_size", "target", "taken", "repeats"]


def word_count(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def fill(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """Targets of sources(source, source_size): shares of the total size by weight, clamped at max_epochs times a source.

    Weights repeat over the sources in code point order, null last. A source that would pass its clamp gets the clamp,
    and the excess goes to the others by weight, until none passes. Sources are walked by clamp over weight: as soon as one fits
    with all earlier ones clamped, all later ones fit, so that one pass reaches the fixed point. Sums are integers.
    Every source empty: all targets 0. No sources: no rows.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    s = sources.withColumn("_w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("_cap", F.col("source_size") * max_epochs)
    everything = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = everything.rowsBetween(Window.unboundedPreceding, -1)
    whole = everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0)
    s = s.withColumns({"_t": F.sum("source_size").over(whole), "_v": F.sum("_w").over(whole), "_c0": F.coalesce(F.sum("_cap").over(before), zero), "_v0": F.coalesce(F.sum("_w").over(before), zero)})
    s = s.withColumn("_clamped", (F.col("_t") - F.col("_c0")) * F.col("_w") > F.col("_cap") * (F.col("_v") - F.col("_v0")))
    s = s.withColumns({"_c1": F.sum(F.when(F.col("_clamped"), F.col("_cap")).otherwise(0)).over(whole), "_v1": F.sum(F.when(F.col("_clamped"), F.col("_w")).otherwise(0)).over(whole)})
    level = (F.col("_w") * (F.col("_t") - F.col("_c1"))).cast("double") / (F.col("_v") - F.col("_v1")).cast("double")
    return s.select("source", "source_size", F.when(F.col("_clamped"), F.col("_cap").cast("double")).otherwise(level).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: str = "mix-1", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with size (words), source_size, target of the source, taken (words the mix takes) and repeats (whole copies).

    Every document of a source is taken floor(target / source_size) times; the rest of the target goes, in the order of a
    seeded hash of the id, to further documents until it is used up, the last one in part. So a source's taken words are its
    target rounded, and no document is taken more than max_epochs times. repeats counts the part as a copy from half on.
    Null text: size 0. Null source: a source of its own. Null or repeated ids: rows with one hash follow by size, so the
    result is the same whatever the order of the input. Columns named as an output are replaced; all others stay. Empty: empty.
    """
    docs, back = stowed(docs, [id_col, text_col, source_col])
    docs = docs.withColumns({"size": word_count(text_col), "_key": F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))})
    docs = docs.withColumn("_bucket", F.substring("_key", 1, 3))
    cells = docs.groupBy(F.col(source_col).alias("source"), F.col("_bucket").alias("_b")).agg(F.sum("size").alias("_cell"))
    targets = fill(cells.groupBy("source").agg(F.sum("_cell").alias("source_size")), weights, max_epochs).withColumnRenamed("source", "_s")
    before = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_cell").over(before), F.lit(0)))
    cells = cells.join(targets, F.col("source").eqNullSafe(F.col("_s"))).select(F.col("source").alias("_s"), "_b", "_before", "source_size", "target")
    inside = Window.partitionBy(source_col, "_bucket").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = docs.withColumn("_end", F.sum("size").over(inside))
    out = placed.join(cells, F.col(source_col).eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    budget = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("cast(floor(target + 0.5D) as bigint) div source_size")).otherwise(F.lit(0)).cast("long")
    out = out.withColumns({"_whole": whole, "_left": budget - whole * F.col("source_size")})
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_left") - (F.col("_before") + F.col("_end") - F.col("size"))))
    out = out.withColumn("_part", part)
    copies = F.col("_whole") + F.when((F.col("_part") > 0) & (2 * F.col("_part") >= F.col("size")), 1).otherwise(0)
    out = out.withColumns({"taken": (F.col("_whole") * F.col("size") + F.col("_part")).cast("long"), "repeats": copies.cast("long")})
    return back(out, *OUT)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each document repeats times, with the columns of docs as they are, whatever their names."""
    packed, back = stowed(docs, [id_col, text_col, source_col])
    out = mix(packed, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    return back(out.filter(F.col("repeats") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
         md5('mix-1:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE (r - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS wt, 3 * source_size AS cap FROM s),
c AS (SELECT *, SUM(source_size) OVER () AS t, SUM(wt) OVER () AS v,
             COALESCE(SUM(cap) OVER (ORDER BY cap / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0,
             COALESCE(SUM(wt) OVER (ORDER BY cap / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS v0 FROM w),
f AS (SELECT *, (t - c0) * wt > cap * (v - v0) AS clamped FROM c),
g AS (SELECT *, SUM(CASE WHEN clamped THEN cap ELSE 0 END) OVER () AS c1, SUM(CASE WHEN clamped THEN wt ELSE 0 END) OVER () AS v1 FROM f),
p AS (SELECT source, source_size, CASE WHEN clamped THEN CAST(cap AS DOUBLE) ELSE CAST(wt * (t - c1) AS DOUBLE) / CAST(v - v1 AS DOUBLE) END AS target FROM g),
q AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS whole, CAST(floor(target + 0.5) AS BIGINT) AS want FROM p),
x AS (SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, q.source_size, q.target, q.whole, q.want - q.whole * q.source_size AS rest,
             CAST(SUM(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS start
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - start)) AS BIGINT) AS taken FROM x
"""
