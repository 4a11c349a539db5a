"""From atoms to molecules: centres, gyration, order, distances, dihedrals, tilt (A1-A9). One aggregation per (frame, residue)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions.geometry import arccos, dihedral_angle, length

KEYS = ("frame", "res_nr", "res_name", "leaflet")


def _keys(df: DataFrame) -> list[str]:
    return [k for k in KEYS if k in df.columns]


def _named(df: DataFrame, names) -> DataFrame:
    return df.filter(F.col("atom_name").isin(*names)) if names else df


def centers(df: DataFrame, names=None) -> DataFrame:
    """Mean position of the named atoms (all, if none are named) of each residue."""
    return _named(df, names).groupBy(*_keys(df)).agg(*[F.avg(c).alias(c) for c in "xyz"])


def com(df: DataFrame, names=None) -> DataFrame:
    """Mass-weighted centre of each residue, and its mass."""
    return _named(df, names).groupBy(*_keys(df)).agg(*[(F.sum(F.col("mass") * F.col(c)) / F.sum("mass")).alias(c) for c in "xyz"], F.sum("mass").alias("mass"))


def gyration(df: DataFrame, names=None) -> DataFrame:
    """Radius of gyration about the centre of mass; second pass against the first, for stability."""
    c = com(df, names).select(*_keys(df), *[F.col(k).alias(f"c{k}") for k in "xyz"])
    j = _named(df, names).join(c, _keys(df))
    r2 = sum((F.col(k) - F.col(f"c{k}")) * (F.col(k) - F.col(f"c{k}")) for k in "xyz")
    return j.groupBy(*_keys(df)).agg(F.sqrt(F.sum(F.col("mass") * r2) / F.sum("mass")).alias("rg"))


def pick(df: DataFrame, **atoms: str) -> DataFrame:
    """One row per residue with columns {label}x, {label}y, {label}z of the named atoms; residues that lack one are left out."""
    aggs = [F.max(F.when(F.col("atom_name") == name, F.col(c))).alias(f"{label}{c}") for label, name in atoms.items() for c in "xyz"]
    return df.filter(F.col("atom_name").isin(*atoms.values())).groupBy(*_keys(df)).agg(*aggs).dropna(subset=[f"{label}x" for label in atoms])


def order_parameter(df: DataFrame, pairs) -> DataFrame:
    """Residue means of P2 = (3 cos^2 - 1) / 2 and of theta (degrees to z) over atom pairs (a, b)."""
    labels = {f"p{k}{e}": name for k, pair in enumerate(pairs) for e, name in zip("ab", pair)}
    rows = pick(df, **labels)
    cos: list[Column] = []
    for k in range(len(pairs)):
        d = [F.col(f"p{k}b{c}") - F.col(f"p{k}a{c}") for c in "xyz"]
        cos.append(F.try_divide(d[2], length(*d)))
    n = float(len(pairs))
    p2 = sum((c * c * 3.0 - 1.0) * 0.5 for c in cos) / n
    return rows.select(*_keys(df), p2.alias("p2"), (sum(arccos(c) for c in cos) / n).alias("theta"))


def pair_distance(df: DataFrame, a: str, b: str, at: str) -> DataFrame:
    """Distance of atoms a and b of a residue, at the position of atom `at`."""
    rows = pick(df, a=a, b=b, m=at)
    return rows.select(*_keys(df), F.col("mx").alias("x"), F.col("my").alias("y"), F.col("mz").alias("z"), length(*[F.col(f"a{c}") - F.col(f"b{c}") for c in "xyz"]).alias("value"))


def pair_vector(df: DataFrame, a: str, b: str, at: str) -> DataFrame:
    """Vector from atom a to atom b of a residue, at the position of atom `at`."""
    rows = pick(df, a=a, b=b, m=at)
    return rows.select(*_keys(df), F.col("mx").alias("x"), F.col("my").alias("y"), F.col("mz").alias("z"), *[(F.col(f"b{c}") - F.col(f"a{c}")).alias(f"d{c}") for c in "xyz"])


def dihedral(df: DataFrame, i: str, j: str, k: str, m: str, previous: tuple[str, ...] = (), following: tuple[str, ...] = ()) -> DataFrame:
    """Signed dihedral of four atoms of a residue; atoms labelled (i, j, k, m) in previous or following come from the residue before
    or after, by residue number."""
    atoms = dict(zip("ijkm", (i, j, k, m)))
    aggs = [F.max(F.when(F.col("atom_name") == name, F.col(c))).alias(f"{label}{c}") for label, name in atoms.items() for c in "xyz"]
    rows = df.filter(F.col("atom_name").isin(*atoms.values())).groupBy(*_keys(df)).agg(*aggs)
    w = Window.partitionBy("frame").orderBy("res_nr")
    moved = {f"{s}{c}": F.lag(f"{s}{c}").over(w) for s in previous for c in "xyz"} | {f"{s}{c}": F.lead(f"{s}{c}").over(w) for s in following for c in "xyz"}
    rows = rows.withColumns(moved) if moved else rows
    return rows.dropna(subset=[f"{s}x" for s in atoms]).select(*_keys(df), dihedral_angle("i", "j", "k", "m").alias("angle"))


def tilt(df: DataFrame, upper: Column, lower: Column) -> DataFrame:
    """Per frame, from the mean position of the lower group to that of the upper: theta to z, phi to y unfolded to 0..360 by the sign of x."""
    mean = lambda w, c: F.avg(F.when(w, F.col(c)))
    v = df.groupBy("frame").agg(*[(mean(upper, c) - mean(lower, c)).alias(f"v{c}") for c in "xyz"])
    flat = length(F.col("vx"), F.col("vy"))
    phi = arccos(F.when(flat > 0, F.col("vy") / flat).otherwise(F.lit(1.0)))
    theta = arccos(F.try_divide(F.col("vz"), length(F.col("vx"), F.col("vy"), F.col("vz"))))
    return v.select("frame", theta.alias("theta"), F.when(F.col("vx") < 0, 360.0 - phi).otherwise(phi).alias("phi"))
