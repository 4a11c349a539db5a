"""Label tessellation by nearest site (L11-L13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lattice import Lattice, stamp
from .rangejoin import knn, near_places
from .transforms import checkpointed, images


def tessellate(sites: DataFrame, grid: Lattice, radius: float, box: tuple[float, float] | None = None, label: str = "res_nr") -> DataFrame:
    """(frame, gx, gy, label): each node takes the label of the nearest site within radius, else of the nearest of its frame's sites;
    ties go to the lower label. box: periodic images in x and y compete too. Nodes outside radius of all sites look further by rounds."""
    s = sites.select("frame", F.col(label).alias("_label"), "x", "y")
    if box:
        s = images(s, *box)
    near_ = stamp(s, grid, radius)
    dx, dy = F.col("gx") * grid.cell - F.col("x"), F.col("gy") * grid.cell - F.col("y")
    best = F.min(F.struct(F.sqrt(dx * dx + dy * dy).alias("d"), F.col("_label")))
    covered = near_.groupBy("frame", "gx", "gy").agg(best.alias("b"))
    covered = checkpointed(covered.select("frame", "gx", "gy", F.col("b._label").alias(label)))
    nodes = grid.over(s.select("frame").distinct())
    rest = nodes.join(covered.select("frame", "gx", "gy"), ["frame", "gx", "gy"], "left_anti").select("frame", "gx", "gy", (F.col("gx") * grid.cell).alias("x"), (F.col("gy") * grid.cell).alias("y"))
    far = knn(rest, s, 1, ["gx", "gy"], "_label", 2 * radius)
    return covered.unionByName(far.select("frame", F.col("a_gx").alias("gx"), F.col("a_gy").alias("gy"), F.col("b__label").alias(label)))


def frame_nodes(frames: DataFrame, aps: float) -> DataFrame:
    """Nodes of a lattice that follows each frame's box (frame, bx, by): ceil(box / cell) a side, without the extra node."""
    cell = aps**0.5
    side = lambda b: F.sequence(F.lit(0), (F.ceil(F.col(b) / cell) - 1).cast("int"))
    return frames.select("frame", F.explode(side("bx")).alias("gx"), "by").select("frame", "gx", F.explode(side("by")).alias("gy"))


def near_protein(protein: DataFrame, lipids: DataFrame, c_dist: float) -> DataFrame:
    """Protein atoms with a lipid atom nearer than c_dist whose abs(dz) is under c_dist / 2."""
    flat: Column = F.abs(F.col("a_z") - F.col("b_z")) < c_dist / 2
    return near_places(protein, lipids, c_dist, where=flat)
