"""Disc and sphere sums on a lattice by scan lines.

A point covers one interval of each lattice row (along gx) that its disc or sphere meets. The interval is written as a difference: the value at its first node,
and its negative behind the last. Differences are summed by node, also before they are dealt out, and a running sum along each row gives every node's total.
So a point makes some 2 r / cell rows (squared in 3D) instead of the square (cube) of that, and points that start at one node are one row. Points at one place
are one point with their number and the sums of their values, before any interval is made.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

if TYPE_CHECKING:
    from .lattice import Lattice

AXES = ("x", "y", "z")
#: 2 ** 27 + 1: parts a double into two halves of its bits.
SPLIT = 134217729.0


def halves(value: Column) -> tuple[Column, Column]:
    """A double as its upper 26 bits and the rest."""
    high = value * SPLIT - (value * SPLIT - value)
    return high, value - high


def even_mean(column: str) -> Column:
    """The mean of a column, as an aggregate that doesn't depend on the order of rows."""
    high, low = halves(F.col(column).cast("double"))
    return F.try_divide(F.sum(high) + F.sum(low), F.count(column)).alias(column)


def _reach(grid: Lattice, k: int, radius: float) -> Column:
    """The node numbers of axis k that may be within radius; null where there are none."""
    at = F.col(AXES[k])
    low = F.greatest(F.lit(0), F.floor((at - radius) / grid.cell) - 1).cast("int")
    high = F.least(F.lit(grid.n[k] - 1), F.ceil((at + radius) / grid.cell) + 1).cast("int")
    return F.when(low <= high, F.sequence(low, high))


def _interval(grid: Lattice, radius: float, across: list[Column]) -> tuple[Column, Column]:
    """First and last gx of the row at the nodes `across` (gy[, gz]) within radius (inclusive); null where there is none. The root only proposes
    the ends; whether a node is inside is the same comparison as for a single node."""
    x = F.col("x")
    gaps = [node * grid.cell - F.col(axis) for node, axis in zip(across, AXES[1:])]

    def inside(i: Column) -> Column:
        d = i * grid.cell - x
        d2, near = d * d, F.abs(d) <= radius
        for gap in gaps:
            d2, near = d2 + gap * gap, near & (F.abs(gap) <= radius)
        return near & (F.sqrt(d2) <= radius)

    rest = F.lit(radius * radius)
    for gap in gaps:
        rest = rest - gap * gap
    half = F.sqrt(F.greatest(rest, F.lit(0.0)))

    def end(guess: Column, outward: int) -> Column:
        guess = guess.cast("int")
        return F.coalesce(*[F.when(inside(guess + F.lit(step)), guess + F.lit(step)) for step in (outward, 0, -outward)])

    low, high = end(F.ceil((x - half) / grid.cell), -1), end(F.floor((x + half) / grid.cell), 1)
    low = F.when(low.isNotNull(), F.greatest(low, F.lit(0)))
    high = F.when(high.isNotNull(), F.least(high, F.lit(grid.n[0] - 1)))
    return low, high


def intervals(points: DataFrame, grid: Lattice, radius: float) -> DataFrame:
    """points with gy[, gz], _low, _high: one row for each lattice row that a point covers a part of."""
    for k in range(1, len(grid.n)):
        points = points.withColumn(grid.keys[k], F.explode(_reach(grid, k, radius))).filter(F.abs(F.col(grid.keys[k]) * grid.cell - F.col(AXES[k])) <= radius)
    low, high = _interval(grid, radius, [F.col(k) for k in grid.keys[1:]])
    return points.withColumns({"_low": low, "_high": high}).filter(F.col("_low") <= F.col("_high"))


def _weights(values: tuple[str, ...]) -> dict[str, Column]:
    """What a point adds at each node it covers: 1, and for each value the halves of its bits, whether it is not null, and whether it is no finite number."""
    out = {"n": F.lit(1)}
    for v in values:
        value = F.col(v).cast("double")
        odd = F.isnan(value) | (F.abs(value) == float("inf"))
        high, low = halves(F.when(odd, 0.0).otherwise(F.coalesce(value, F.lit(0.0))))
        out |= {v: high, f"_low_{v}": low, f"n_{v}": F.when(value.isNotNull(), 1).otherwise(0), f"_odd_{v}": F.when(odd, 1).otherwise(0)}
    return out


def merged(points: DataFrame, keys: tuple[str, ...], values: tuple[str, ...] = (), copies: Column | None = None) -> DataFrame:
    """(keys, n, and the sums of the values' parts): points that agree in keys as one row. Copies of a place are stamped once, whatever their number.
    copies: how many points a row stands for."""
    return points.groupBy(*keys).agg(*[F.sum(c if copies is None else c * copies).alias(name) for name, c in _weights(values).items()])


def totals(points: DataFrame, grid: Lattice, radius: float, by: tuple[str, ...] = (), values: tuple[str, ...] = ()) -> DataFrame:
    """(by, gx, gy[, gz], n, and for each value v: v, n_v): of the points (by, x, y[, z], values) within radius of each node, their number, and
    the sum and number of values that are not null; nodes without a point have no row.

    A value that is no finite number makes the sum NaN at the nodes it covers, and nowhere else. Values are summed in two halves of their bits, so that adding and
    taking away again leaves nothing behind: the sums don't depend on an order, as long as values are within some 10^5 times each other."""
    return summed(intervals(merged(points, (*by, *AXES[: len(grid.n)]), values), grid, radius), grid, by, values)


def summed(found: DataFrame, grid: Lattice, by: tuple[str, ...] = (), values: tuple[str, ...] = ()) -> DataFrame:
    """The totals of intervals(by, gy[, gz], _low, _high) of merged points."""
    keys, sums = [*by, *grid.keys[1:]], list(_weights(values))
    ends = F.explode(F.array(F.struct(F.col("_low").alias("gx"), F.lit(1).alias("_s")), F.struct((F.col("_high") + 1).alias("gx"), F.lit(-1).alias("_s")))).alias("_e")
    edges = found.select(*keys, *sums, ends).select(*keys, *sums, "_e.gx", "_e._s")
    steps = edges.groupBy(*keys, "gx").agg(*[F.sum(F.col(c) * F.col("_s")).alias(c) for c in sums])
    row = Window.partitionBy(*keys).orderBy("gx")
    runs = steps.select(*keys, "gx", F.lead("gx").over(row).alias("_next"), *[F.sum(c).over(row).alias(c) for c in sums]).filter("n > 0")
    out = [F.when(F.col(f"_odd_{v}") > 0, float("nan")).when(F.col(f"n_{v}") > 0, F.col(v) + F.col(f"_low_{v}")).alias(v) for v in values]
    counts = [F.col(f"n_{v}") for v in values]
    return runs.select(*by, F.explode(F.sequence("gx", F.col("_next") - 1)).alias("gx"), *grid.keys[1:], "n", *out, *counts)


def means(points: DataFrame, grid: Lattice, radius: float, by: tuple[str, ...] = (), values: tuple[str, ...] = ("value",)) -> DataFrame:
    """(by, gx, gy[, gz], values, n): the mean of each value at each node, nulls left out, and the number of points."""
    sums = totals(points, grid, radius, by, values)
    return sums.select(*by, *grid.keys, *[(F.col(v) / F.col(f"n_{v}")).alias(v) for v in values], "n")
