"""Trajectory transforms (X1-X16). Each takes and returns atoms (frame, atom_nr, res_nr, .., x, y, z[, mass])."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.rotation import XYZ, turns

from .windows import unwrap



def scan_frames(df: DataFrame, b: int | None = None, e: int | None = None, stride: int = 1, renumber: bool = True) -> DataFrame:
    """Frames b <= i <= e with i % stride == 0 (absolute, not from b), then numbered 0, 1, ... The filter reaches the Parquet scan."""
    where = F.col("frame") % stride == 0
    where = where & (F.col("frame") >= b) if b is not None else where
    df = df.filter(where & (F.col("frame") <= e) if e is not None else where)
    if not renumber:
        return df
    from pyspark.sql.window import Window

    ids = df.select("frame").distinct().select("frame", (F.row_number().over(Window.orderBy("frame")) - 1).cast("int").alias("_new"))
    return df.join(F.broadcast(ids), "frame").withColumn("frame", F.col("_new")).drop("_new")


def group_center(df: DataFrame, group: Column, mass: bool = True) -> DataFrame:
    """(frame, cx, cy, cz) of the atoms in group."""
    m = F.col("mass") if mass else F.lit(1.0)
    rows = df.filter(group)
    return rows.groupBy("frame").agg(*[(F.sum(m * F.col(c)) / F.sum(m)).alias(f"c{c}") for c in XYZ])


def _shifted(df: DataFrame, per_frame: DataFrame) -> DataFrame:
    """Adds (sx, sy, sz) of a frame to its atoms; per_frame has a row a frame."""
    return df.join(per_frame, "frame").withColumns({c: F.col(c) + F.col(f"s{c}") for c in XYZ}).drop("sx", "sy", "sz")


def translate(df: DataFrame, group: Column, to: tuple[float, float, float]) -> DataFrame:
    """Moves each frame so that the group's geometric centre is at `to`."""
    return _shifted(df, group_center(df, group, False).select("frame", *[(F.lit(t) - F.col(f"c{c}")).alias(f"s{c}") for c, t in zip(XYZ, to)]))


def center_box(df: DataFrame, group: Column, box: tuple[float, float, float]) -> DataFrame:
    """Group centre to the middle of the box."""
    return translate(df, group, tuple(b / 2 for b in box))


def wrap(df: DataFrame, box: tuple[float, float, float], where: Column | None = None) -> DataFrame:
    """Shifts a residue by one box length where its centre of mass lies outside [0, box]; at most once."""
    c = df.groupBy("frame", "res_nr").agg(*[(F.sum(F.col("mass") * F.col(k)) / F.sum("mass")).alias(f"c{k}") for k in XYZ])
    move = c.select("frame", "res_nr", *[F.when(F.col(f"c{k}") > b, -b).when(F.col(f"c{k}") < 0, b).otherwise(0.0).alias(f"s{k}") for k, b in zip(XYZ, box)])
    j = df.join(move, ["frame", "res_nr"])
    return j.withColumns({k: F.col(k) + (F.col(f"s{k}") if where is None else F.when(where, F.col(f"s{k}")).otherwise(0.0)) for k in XYZ}).drop("sx", "sy", "sz")


def mend_residues(df: DataFrame, box: tuple[float, float, float]) -> DataFrame:
    """Makes residues whole: the atom with the largest summed squared distance to the others is the reference, and atoms more than half a
    box from it are shifted by one box."""
    a = df.select("frame", "res_nr", "atom_nr", *XYZ)
    b = df.select("frame", "res_nr", *[F.col(k).alias(f"o{k}") for k in XYZ])
    d2 = sum((F.col(k) - F.col(f"o{k}")) * (F.col(k) - F.col(f"o{k}")) for k in XYZ)
    far = a.join(b, ["frame", "res_nr"]).groupBy("frame", "res_nr", "atom_nr", *XYZ).agg(F.sum(d2).alias("d2"))
    ref = far.groupBy("frame", "res_nr").agg(F.max(F.struct(F.round("d2", 9).alias("d2"), (-F.col("atom_nr")).alias("k"), *XYZ)).alias("r"))
    ref = ref.select("frame", "res_nr", *[F.col(f"r.{k}").alias(f"r{k}") for k in XYZ])
    j = df.join(ref, ["frame", "res_nr"])
    return j.withColumns({k: F.col(k) + F.when(F.col(k) - F.col(f"r{k}") > l / 2, -l).when(F.col(k) - F.col(f"r{k}") < -l / 2, l).otherwise(0.0) for k, l in zip(XYZ, box)}).drop("rx", "ry", "rz")


def components(bonds: DataFrame) -> DataFrame:
    """Molecules of a bond table (a, b): (atom_nr, molecule), molecule the least atom number. Labels spread and jump, with a
    checkpoint a round, until nothing changes."""
    both = bonds.select("a", "b").union(bonds.select("b", "a")).distinct()
    now = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node")
    now = table = checkpointed(now)
    while True:
        near = both.join(now.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = now.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        far = now.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        new = checkpointed(step.join(far, "mid").select("node", "old", F.least("mid", "far").alias("label")))
        discard(table)
        table = new
        if not new.filter("label != old").limit(1).count():
            return new.select(F.col("node").alias("atom_nr"), F.col("label").alias("molecule"))
        now = new.select("node", "label")


@cache
def _own_folder(application: str) -> str:
    """An application's temporary folder, the same at each call: a running session takes no new spark.checkpoint.dir."""
    return "file://" + tempfile.mkdtemp(prefix="spark-shared-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local master gets a temporary one (tests); a cluster has
    to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if "cluster" in spark.sparkContext.master or not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _own_folder(spark.sparkContext.applicationId)
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder: the lineage ends there, and it is computed once."""
    path = f"{_tables(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def _tables(spark: SparkSession) -> str:
    """The folder of this application's tables."""
    return f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of checkpointed tables that no later step reads; other DataFrames are left alone."""
    for df in tables:
        if getattr(df, "_table", None):
            _delete(df.sparkSession, df._table)


def clear_tables(spark: SparkSession) -> None:
    """Deletes all checkpointed tables of this application. For long sessions: results that are not yet written or collected can't be computed any more."""
    _delete(spark, _tables(spark))


def forest(bonds: DataFrame) -> DataFrame:
    """(atom_nr, parent, depth) of a spanning forest of the bonds (a, b): breadth first from the least atom of each molecule; of several bonded atoms a level above,
    the least is the parent. Roots have no row. One molecule is one group: bonds are a part of the topology, and don't grow with the frames."""
    both = bonds.select("a", "b").union(bonds.select("b", "a")).distinct()
    named = both.join(components(bonds).select(F.col("atom_nr").alias("a"), "molecule"), "a").select("molecule", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))

    def walk(table: pa.Table) -> pa.Table:
        near: dict[int, list[int]] = {}
        for x, y in zip(table["a"].to_pylist(), table["b"].to_pylist()):
            near.setdefault(x, []).append(y)
        level, parent, depth = [min(near)], {min(near): None}, {min(near): 0}
        while level:
            for x in level:
                for y in near[x]:
                    if y not in parent:
                        parent[y], depth[y] = x, depth[x] + 1
            level = sorted(y for y in {y for x in level for y in near[x]} if depth[y] == depth[level[0]] + 1)
        rows = [(x, p, depth[x]) for x, p in parent.items() if p is not None]
        return pa.table([pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else ([], [], []), (pa.int64(), pa.int64(), pa.int32()))], ["atom_nr", "parent", "depth"])

    return named.groupBy("molecule").applyInArrow(walk, "atom_nr long, parent long, depth int")


def mend_bonds(df: DataFrame, bonds: DataFrame, box: tuple[float, float, float]) -> DataFrame:
    """Makes molecules whole along their bonds: from the least atom of a molecule on, an atom more than half a box from its parent is shifted by boxes.

    An atom's image is its parent's and what its own bond adds, so that images add up along the path to the root, and paths are doubled: a
    round adds what the atom 2 ** k steps above has summed up. Rounds grow with the logarithm of the depth, and pointers are the same in all frames.
    Only images other than 0, those of bonds across the box and what hangs on them, are written and dealt out in the rounds."""
    tree = checkpointed(forest(bonds))
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    at = df.select("frame", F.col("atom_nr").cast("long").alias("atom_nr"), *XYZ)
    up = at.select("frame", F.col("atom_nr").alias("parent"), *[F.col(k).alias(f"p{k}") for k in XYZ])
    add = {f"i{k}": -F.round((F.col(k) - F.col(f"p{k}")) / F.lit(l)) for k, l in zip(XYZ, box)}
    shifted = reduce(Column.__or__, [F.col(n) != 0 for n in add])
    sums = at.join(tree.select("atom_nr", "parent"), "atom_nr").join(up, ["frame", "parent"]).select("frame", "atom_nr", *[c.alias(n) for n, c in add.items()]).filter(shifted)
    pointer = tree.select("atom_nr", F.col("parent").alias("to"))
    reach, stale = 1, []
    while reach < deepest:
        sums = checkpointed(sums)
        discard(*stale)
        stale = [sums, pointer]
        below = sums.withColumnRenamed("atom_nr", "to").join(pointer, "to").select("frame", "atom_nr", *add)
        sums = sums.unionByName(below).groupBy("frame", "atom_nr").agg(*[F.sum(n).alias(n) for n in add]).filter(shifted)
        pointer = checkpointed(pointer.join(pointer.select(F.col("atom_nr").alias("to"), F.col("to").alias("next")), "to").select("atom_nr", F.col("next").alias("to")))
        reach *= 2
    moved = df.withColumn("_a", F.col("atom_nr").cast("long")).join(sums.withColumnRenamed("atom_nr", "_a"), ["frame", "_a"], "left")
    return moved.withColumns({k: F.col(k) + F.coalesce(f"i{k}", F.lit(0.0)) * l for k, l in zip(XYZ, box)}).drop("_a", *add).select(*df.columns)


def rotate(df: DataFrame, m: list[list[float]]) -> DataFrame:
    return df.withColumns({c: sum(F.col(k) * F.lit(float(v)) for k, v in zip(XYZ, row)) for c, row in zip(XYZ, m)})


def shift(df: DataFrame, by: tuple[float, float, float]) -> DataFrame:
    return df.withColumns({c: F.col(c) + F.lit(float(v)) for c, v in zip(XYZ, by)})


def recipe(df: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Applies steps in order."""
    return reduce(DataFrame.transform, steps, df)


def _wrapped_once(df: DataFrame, axis: str, length: float) -> DataFrame:
    return df.withColumn(axis, F.when(F.col(axis) > length, F.col(axis) - length).when(F.col(axis) < 0, F.col(axis) + length).otherwise(F.col(axis)))


def center_bilayer(df: DataFrame, membrane: Column, z: float, box_z: float) -> DataFrame:
    """Membrane mass centre to height z; each atom wrapped once."""
    c = group_center(df, membrane).select("frame", F.lit(0.0).alias("sx"), F.lit(0.0).alias("sy"), (F.lit(z) - F.col("cz")).alias("sz"))
    return _wrapped_once(_shifted(df, c), "z", box_z)


def place_midpoint(df: DataFrame, a: Column, b: Column, to: tuple[float, float, float], box: tuple[float, float, float]) -> DataFrame:
    """Midpoint of two groups' mass centres to `to`; each atom wrapped once."""
    ca, cb = group_center(df, a), group_center(df, b).select("frame", *[F.col(f"c{c}").alias(f"d{c}") for c in XYZ])
    move = ca.join(cb, "frame").select("frame", *[(F.lit(t) - (F.col(f"c{c}") + F.col(f"d{c}")) * 0.5).alias(f"s{c}") for c, t in zip(XYZ, to)])
    out = _shifted(df, move)
    for axis, l in zip(XYZ, box):
        out = _wrapped_once(out, axis, l)
    return out


def images(df: DataFrame, bx: float, by: float) -> DataFrame:
    """The nine xy images of each row, image 0 the row itself."""
    spark = df.sparkSession
    order = [(0, 0)] + [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
    table = spark.createDataFrame([(k, float(i), float(j)) for k, (i, j) in enumerate(order)], "image int, _i double, _j double")
    return df.crossJoin(F.broadcast(table)).withColumns({"x": F.col("x") + F.col("_i") * bx, "y": F.col("y") + F.col("_j") * by}).drop("_i", "_j")


def superpose(df: DataFrame, group: Column, ref: DataFrame, dims: int = 3) -> DataFrame:
    """Mass-weighted least-squares fit of each frame's group to ref (atom_nr, x, y, z of one frame), applied to all atoms.

    Nine weighted products a frame are summed, the rotation follows from them in columns, and frames' rotations are joined back. dims 2
    turns about z only."""
    r = ref.select("atom_nr", *[F.col(c).alias(f"r{c}") for c in XYZ])
    g = df.filter(group).join(r, "atom_nr")
    m = F.col("mass")
    centers = g.groupBy("frame").agg(*[(F.sum(m * F.col(f"{p}{c}")) / F.sum(m)).alias(f"{q}{c}") for p, q in (("", "c"), ("r", "o")) for c in XYZ])
    j = g.join(centers, "frame")
    sums = j.groupBy("frame").agg(*[F.sum(m * (F.col(a) - F.col(f"c{a}")) * (F.col(f"r{b}") - F.col(f"o{b}"))).alias(f"m{a}{b}") for a in XYZ for b in XYZ])

    turned = turns(sums, dims).drop(*[f"m{a}{b}" for a in XYZ for b in XYZ]).join(centers, "frame")
    j = df.join(turned, "frame")
    new = {a: sum(F.col(f"q{a}{b}") * (F.col(b) - F.col(f"c{b}")) for b in XYZ) + F.col(f"o{a}") for a in XYZ}
    return j.select(*[c for c in df.columns if c not in XYZ], *[e.alias(a) for a, e in new.items()])


def prepare(df: DataFrame, b=None, e=None, stride: int = 1, group: Column | None = None, ref: DataFrame | None = None) -> DataFrame:
    """Subsample, then fit if a group is given."""
    out = scan_frames(df, b, e, stride)
    return superpose(out, group, ref) if group is not None and ref is not None else out


def symmetrize(df: DataFrame, mapping: DataFrame, cycle: int, n: int, ref: DataFrame | None = None) -> DataFrame:
    """Coordinates of protomer i from protomer (i + cycle) % n. mapping: (atom_nr, protomer, slot); then a fit to ref, if given."""
    src = mapping.select(F.col("atom_nr").alias("_from"), F.col("protomer").alias("_p"), F.col("slot").alias("_s"))
    pairs = mapping.join(src, (F.col("_p") == (F.col("protomer") + cycle) % n) & (F.col("_s") == F.col("slot"))).select("atom_nr", "_from")
    other = df.select("frame", F.col("atom_nr").alias("_from"), *[F.col(c).alias(f"n{c}") for c in XYZ])
    out = df.join(pairs, "atom_nr").join(other, ["frame", "_from"]).withColumns({c: F.col(f"n{c}") for c in XYZ}).drop("nx", "ny", "nz", "_from")
    return superpose(out, F.lit(True), ref) if ref is not None else out


def broken(df: DataFrame, box: tuple[float, float, float]) -> DataFrame:
    """(frame, res_nr, broken): 1 if any two atoms of a residue are more than half a box side apart. Two atoms are that far apart
    exactly if the residue's extremes are."""
    far = reduce(Column.__or__, [(F.max(c) - F.min(c)) > l / 2 for c, l in zip(XYZ, box)])
    return df.groupBy("frame", "res_nr").agg(F.when(far, 1).otherwise(0).alias("broken"))


def unwrap_xy(df: DataFrame, bx: float, by: float, cutoff: float = 0.5) -> DataFrame:
    return unwrap(df, "xy", {"x": bx, "y": by}, cutoff=cutoff)


def unwrap_z(df: DataFrame, bz: float, not_solvent: Column, cutoff: float = 0.5) -> DataFrame:
    return unwrap(df, "z", {"z": bz}, cutoff=cutoff, where=not_solvent)
