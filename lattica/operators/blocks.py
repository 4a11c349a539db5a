"""Scans over long series, block by block.

A window over a whole series is one task for each series. Here a series is cut into blocks of frames; a block is reduced to its carry (one row), carries
are scanned over the blocks of a series, and each block is finished on its own with the carry from before it. All functions give the same rows for any block length.
The rows are written once, as they are read twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Frames of a block.
BLOCK = 65_536


def _block(order: str, block: int) -> Column:
    return F.floor(F.col(order) / F.lit(block)).cast("long")


def written(df: DataFrame, order: str, block: int) -> tuple[DataFrame, bool]:
    """df as a table with _blk, and whether it lies in one block, which then has no carry to wait for."""
    from .transforms import checkpointed

    rows = checkpointed(df)
    low, high = rows.agg(*[F.floor(f(order) / F.lit(block)) for f in (F.min, F.max)]).first()
    return rows.withColumn("_blk", _block(order, block)), low == high


def _back(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of their block's row of table; null keys are series too."""
    named = table.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], *[c for c in table.columns if c not in keys])
    return rows.join(named, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)])).drop(*[f"_k{n}" for n in range(len(keys))])


def scan(df: DataFrame, keys: list[str], order: str, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, previous: dict[str, Column] | None = None, following: str | None = None, block: int = BLOCK) -> DataFrame:
    """df with running sums (nulls count 0) and last values that are not null, up to and with each row by order, the values of the row before, and in
    `following` the order of the next row. Rows of one order within a series are taken in any order."""
    sums, lasts, previous = sums or {}, lasts or {}, previous or {}
    rows, alone = written(df, order, block)
    values = sums | lasts | previous
    rows = rows.withColumns({f"_v_{n}": c for n, c in values.items()})
    newest = {n: F.struct(order, f"_v_{n}") for n in previous} | {n: F.when(F.col(f"_v_{n}").isNotNull(), F.struct(order, f"_v_{n}")) for n in lasts}
    inside = Window.partitionBy(*keys, "_blk").orderBy(order)
    if not alone:
        # max_by of plain columns is taken in a hash table; the greatest struct would have all rows sorted first
        latest = lambda n, at: F.when(F.max(at).isNotNull(), F.struct(F.max(at).alias(order), F.max_by(f"_v_{n}", at).alias(f"_v_{n}")))
        known = lambda n: F.when(F.col(f"_v_{n}").isNotNull(), F.col(order))
        table = rows.groupBy(*keys, "_blk").agg(F.min(order).alias("_first"), *[F.sum(f"_v_{n}").alias(f"_c_{n}") for n in sums], *[latest(n, known(n)).alias(f"_c_{n}") for n in lasts], *[latest(n, F.col(order)).alias(f"_c_{n}") for n in previous])
        along = Window.partitionBy(*keys).orderBy("_blk")
        before = along.rowsBetween(Window.unboundedPreceding, -1)
        carried = [F.sum(f"_c_{n}").over(before).alias(f"_v_{n}") for n in sums] + [F.last(f"_c_{n}", True).over(before).alias(f"_c_{n}") for n in lasts] + [F.lag(f"_c_{n}").over(along).alias(f"_c_{n}") for n in previous]
        carries = table.select(*keys, "_blk", *carried, F.lead("_first").over(along).alias("_first"), F.lit(False).alias("_row"))
        # a carry is the first row of its block, so that rows are dealt out once and no join follows
        rows = rows.withColumn("_row", F.lit(True)).unionByName(carries, allowMissingColumns=True)
        newest = {n: F.when(F.col("_row"), s).otherwise(F.col(f"_c_{n}")) for n, s in newest.items()}
        inside = Window.partitionBy(*keys, "_blk").orderBy("_row", order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = {n: F.coalesce(F.sum(f"_v_{n}").over(upto), F.lit(0)) for n in sums}
    out |= {n: F.last(newest[n], True).over(upto)[f"_v_{n}"] for n in lasts}
    out |= {n: F.lag(newest[n]).over(inside)[f"_v_{n}"] for n in previous}
    if following:
        out |= {following: F.coalesce(F.lead(order).over(inside), *([] if alone else [F.first("_first").over(upto)]))}
    rows = rows.withColumns(out)
    return (rows if alone else rows.filter("_row")).drop("_blk", "_first", "_row", *[f"_{x}_{n}" for n in values for x in "vc"])


def runs(df: DataFrame, keys: list[str], a: str, b: str, gap: int = 0, block: int = BLOCK) -> DataFrame:
    """df with _run: the start of the run of intervals [a, b] that touch, or are at most gap frames apart, of which the row is one.

    A series' intervals don't overlap. Blocks find their own runs; a block whose first interval touches the one before it takes over
    the start of the run that is open there."""
    inside = Window.partitionBy(*keys, "_blk").orderBy(a, b)
    touches = lambda start, end: start - end <= 1 + gap
    rows, alone = written(df, a, block)
    rows = rows.withColumn("_new", F.when(touches(F.col(a), F.lag(b).over(inside)), None).otherwise(F.col(a)))
    rows = rows.withColumn("_run", F.last("_new", True).over(inside.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    if alone:
        return rows.drop("_blk")
    along = Window.partitionBy(*keys).orderBy("_blk")
    table = rows.groupBy(*keys, "_blk").agg(F.min(a).alias("_first"), F.max(b).alias("_end"), F.max("_run").alias("_last"))
    table = table.withColumn("_on", F.coalesce(touches(F.col("_first"), F.lag("_end").over(along)), F.lit(False)))
    table = table.withColumn("_open", F.last(F.when(~(F.col("_on") & (F.col("_last") == F.col("_first"))), F.col("_last")), True).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    table = table.select(*keys, "_blk", "_first", F.when(F.col("_on"), F.lag("_open").over(along)).alias("_from"))
    joined = _back(rows, table, [*keys, "_blk"])
    return joined.withColumn("_run", F.when(F.col("_run") == F.col("_first"), F.coalesce("_from", "_run")).otherwise(F.col("_run"))).drop("_blk", "_first", "_from")


def jumps(df: DataFrame, keys: list[str], order: str, steps: dict[str, tuple[str, float]], block: int = BLOCK) -> DataFrame:
    """df with, for each name of steps, the images to add: a step of column beyond +-limit of the row before adds one against it, from that row on.

    A block's carry is its first and last value and the sum of the jumps inside it; the jump into it follows from the block before."""
    inside = Window.partitionBy(*keys, "_blk").orderBy(order)
    jump = lambda now, last, limit: F.when(now - last > limit, -1).when(now - last < -limit, 1).otherwise(0)
    rows, alone = written(df, order, block)
    rows = rows.withColumns({f"_j_{n}": jump(F.col(c), F.lag(c).over(inside), limit) for n, (c, limit) in steps.items()})
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    if alone:
        return rows.withColumns({n: F.sum(f"_j_{n}").over(upto) for n in steps}).drop("_blk", *[f"_j_{n}" for n in steps])
    table = rows.groupBy(*keys, "_blk").agg(*[x for n, (c, _) in steps.items() for x in (F.min_by(c, order).alias(f"_a_{n}"), F.max_by(c, order).alias(f"_b_{n}"), F.sum(f"_j_{n}").alias(f"_s_{n}"))])
    along = Window.partitionBy(*keys).orderBy("_blk")
    table = table.withColumns({f"_e_{n}": jump(F.col(f"_a_{n}"), F.lag(f"_b_{n}").over(along), limit) for n, (_, limit) in steps.items()})
    carries = table.select(*keys, "_blk", *[(F.sum(F.col(f"_e_{n}") + F.col(f"_s_{n}")).over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col(f"_s_{n}")).alias(f"_c_{n}") for n in steps])
    out = {n: F.col(f"_c_{n}") + F.sum(f"_j_{n}").over(upto) for n in steps}
    return _back(rows, carries, [*keys, "_blk"]).withColumns(out).drop("_blk", *[f"_{x}_{n}" for n in steps for x in "jc"])
