"""Projection on lattices: definition, stamps, means, masks, errors, densities (L1-L10). dims are 2 (gx, gy) or 3 (gx, gy, gz)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scanline
from .scanline import AXES


@dataclass(frozen=True)
class Lattice:
    """Nodes at i * cell; n nodes a side."""

    cell: float
    n: tuple[int, ...]

    @classmethod
    def of_box(cls, aps: float, *box: float, extra: int = 1) -> Lattice:
        """cell = sqrt(aps); n = ceil(box / cell) + extra. A lattice that follows each frame's box has extra 0."""
        cell = math.sqrt(aps)
        return cls(cell, tuple(math.ceil(b / cell) + extra for b in box))

    @property
    def keys(self) -> list[str]:
        return [f"g{a}" for a in AXES[: len(self.n)]]

    def over(self, df: DataFrame) -> DataFrame:
        """Each row of df at every node; no join, so that neither side is copied to all machines."""
        for key, n in zip(self.keys, self.n):
            df = df.withColumn(key, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        return df

    def nodes(self, spark: SparkSession) -> DataFrame:
        """All nodes; generated on executors."""
        total = math.prod(self.n)
        df, rest = spark.range(total), F.col("id")
        out = []
        for key, n in zip(self.keys, self.n):
            out.append((rest % n).cast("int").alias(key))
            rest = F.floor(rest / n)
        return df.select(*out)


def _spread(points: DataFrame, grid: Lattice, radius: float) -> DataFrame:
    """Each point with the nodes within radius (inclusive) of it; nodes outside the lattice don't exist; no periodic wrap."""
    d2: Column | None = None
    for axis, key, n in zip(AXES, grid.keys, grid.n):
        low = F.greatest(F.lit(0), F.floor((F.col(axis) - radius) / grid.cell) - 1).cast("int")
        high = F.least(F.lit(n - 1), F.ceil((F.col(axis) + radius) / grid.cell) + 1).cast("int")
        points = points.withColumn(key, F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))))
        d = F.col(key) * grid.cell - F.col(axis)
        points = points.filter(F.abs(d) <= radius)
        d2 = d * d if d2 is None else d2 + d * d
    return points.filter(F.sqrt(d2) <= radius)


def stamp(points: DataFrame, grid: Lattice, radius: float) -> DataFrame:
    """Disc or sphere stamp: every other column of points at every node within radius of (x, y[, z])."""
    return _spread(points, grid, radius)


def stamp_unless(points: DataFrame, grid: Lattice, radius: float, mask: DataFrame) -> DataFrame:
    """Stamp only where mask (a table of nodes) has no node."""
    return _spread(points, grid, radius).join(mask.select(*grid.keys), grid.keys, "left_anti")


def paint(points: DataFrame, grid: Lattice, radius: float, order: str, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Assign instead of add: at each node the value of the point that comes last by order."""
    return _spread(points, grid, radius).groupBy(*keys, *grid.keys).agg(F.max_by("value", order).alias("value"))


def grid_keys(df: DataFrame) -> list[str]:
    return [k for k in ("gx", "gy", "gz") if k in df.columns]


def stamp_counts(points: DataFrame, grid: Lattice, radius: float, by: tuple[str, ...] = ("frame",)) -> DataFrame:
    """(by, nodes, n): how many points cover each node; nodes that none covers have no row."""
    return scanline.totals(points, grid, radius, by)


def frame_mean(points: DataFrame, grid: Lattice, radius: float, by: tuple[str, ...] = (), values: tuple[str, ...] = ("value",)) -> DataFrame:
    """Mean of the points that cover a node in a frame; nulls are left out."""
    return scanline.means(points, grid, radius, (*by, "frame"), values).drop("n")


def time_mean(points: DataFrame, grid: Lattice, radius: float, by: tuple[str, ...] = (), values: tuple[str, ...] = ("value",)) -> DataFrame:
    """Mean in each frame, then the unweighted mean over the frames in which a node was hit; rho counts these frames."""
    return frame_mean(points, grid, radius, by, values).groupBy(*by, *grid.keys).agg(*[scanline.even_mean(v) for v in values], F.count("*").alias("rho"))


def sample_mean(points: DataFrame, grid: Lattice, radius: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean over all samples of a node; rho counts samples. Frames need no rows of their own."""
    return scanline.means(points, grid, radius, by).withColumnRenamed("n", "rho")


def exclude(values: DataFrame, grid: Lattice, cutoff: float, rho: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """The full lattice; value is null where rho <= cutoff * mean(rho), the mean over all nodes, empty ones included.

    rho: counts of another table (gx, gy, rho) instead of the values' own. The mean is one number per lattice: a sum over a known number of nodes.
    """
    keys = grid.keys
    cells = grid.over(values.select(*by).distinct()) if by else grid.nodes(values.sparkSession)
    counts = (rho if rho is not None else values).select(*by, *keys, "rho")
    mean = counts.groupBy(*by).agg((F.sum("rho") / F.lit(float(math.prod(grid.n)))).alias("_mean"))
    full = cells.join(values.drop("rho"), [*by, *keys], "left").join(counts, [*by, *keys], "left").withColumn("rho", F.coalesce("rho", F.lit(0)))
    full = full.join(mean, list(by), "left") if by else full.crossJoin(F.broadcast(mean))
    vals = [c for c in values.columns if c not in (*by, *keys, "rho")]
    return full.select(*by, *keys, *[F.when(F.col("rho") > cutoff * F.col("_mean"), F.col(c)).alias(c) for c in vals], "rho")


def time_stdev(points: DataFrame, grid: Lattice, radius: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Standard deviation over frames (n - 1; null where rho is 1) and its standard error."""
    f = frame_mean(points, grid, radius, by)
    g = f.groupBy(*by, *grid.keys).agg(F.avg("value").alias("value"), F.stddev_samp("value").alias("sd"), F.count("*").alias("rho"))
    sd = F.when(F.col("rho") > 1, F.col("sd"))
    return g.select(*by, *grid.keys, "value", sd.alias("sd"), (sd / F.sqrt(F.col("rho").cast("double"))).alias("error"), "rho")


def density(points: DataFrame, grid: Lattice, radius: float, n_frames: int, atoms_per_molecule: str = "n_atoms", atom: tuple[str, ...] = ("frame", "atom_nr")) -> DataFrame:
    """Each atom spreads 1 / (nodes it covers * frames * atoms of its molecule): the lattice sums to the number of molecules.

    points need atom (the columns that name one) and atoms_per_molecule. Intervals are made once a place; its nodes are counted by them, and an atom off the lattice has none.
    An atom of one row needs no name beyond its place and its molecule's size, so that such atoms are summed by these before they are dealt out."""
    axes = AXES[: len(grid.n)]
    found = scanline.intervals(points.select(*axes).distinct(), grid, radius)
    nodes = found.groupBy(*axes).agg(F.sum(F.col("_high") - F.col("_low") + 1).alias("_nodes"))
    named = F.when(F.count(F.lit(1)).over(Window.partitionBy(*atom)) > 1, F.struct(*atom))
    sizes = F.col(atoms_per_molecule).alias("_size")
    rows = points.select(*axes, sizes, named.alias("_atom")).groupBy(*axes, "_size", "_atom").agg(F.count("*").alias("_copies")).join(nodes, list(axes))
    several = F.col("_atom").isNotNull()
    of_atom = Window.partitionBy("_atom", *[F.when(~several, F.col(c)) for c in (*axes, "_size")])  # an atom without a name is alone
    covered = F.when(several, F.sum(F.col("_nodes") * F.col("_copies")).over(of_atom)).otherwise(F.col("_nodes"))
    shares = rows.withColumn("value", 1.0 / (covered * F.lit(n_frames) * F.col("_size")))
    return scanline.summed(found.join(scanline.merged(shares, axes, ("value",), F.col("_copies")), list(axes)), grid, values=("value",)).select(*grid.keys, "value")


def per_frame(values: DataFrame, n_frames: int, column: str = "value") -> DataFrame:
    return values.withColumn(column, F.col(column) / F.lit(float(n_frames)))
