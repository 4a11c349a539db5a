"""Selections, membership flags and attribute edits (F1-F13)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Residues that are protein; residues that are solvent; lipid, head and tail of either chain.
PROTEIN = ("ALA", "ARG", "ASP", "ASN", "CYS", "GLU", "GLN", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL", "HIH", "GLH", "ASH", "HSP", "HSE", "HSD")
SOLVENT = ("W", "TIP3", "WF")
LEAFLET_CARDS = (
    ("POPE", "PO4", "C4A", "PO4", "C4B"),
    ("POPG", "PO4", "C4A", "PO4", "C4B"),
    ("POPC", "PO4", "C4A", "PO4", "C4B"),
    ("DLPE", "PO4", "C3A", "PO4", "C3B"),
    ("DLPG", "PO4", "C3A", "PO4", "C3B"),
    ("DLPC", "PO4", "C3A", "PO4", "C3B"),
    ("DFF2", "PO4", "C4A", "PO4", "C4B"),
    ("PVP2", "PO4", "C4A", "PO4", "C4B"),
    ("POP2", "PO4", "C4A", "PO4", "C4B"),
    ("CHOL", "ROH", "C2", "ROH", "C2"),
    ("POPC", "P", "C316", "P", "C218"),
    ("DLPC", "P", "C312", "P", "C212"),
)


def atom_id(*ranges: tuple[int, int]) -> Column:
    return reduce(Column.__or__, [F.col("atom_nr").between(a, b) for a, b in ranges])


def resi(*ranges: tuple[int, int]) -> Column:
    return reduce(Column.__or__, [F.col("res_nr").between(a, b) for a, b in ranges])


def atom(*names: str) -> Column:
    return F.col("atom_name").isin(*names)


def resn(*names: str) -> Column:
    return F.col("res_name").isin(*names)


def upper() -> Column:
    return F.col("leaflet") == 1


def lower() -> Column:
    return F.col("leaflet") == 2


def hydrogen() -> Column:
    return F.col("atom_name").startswith("H")


def is_protein(extra: tuple[str, ...] = ()) -> Column:
    return resn(*PROTEIN, *extra)


def is_solvent(extra: tuple[str, ...] = ()) -> Column:
    return resn(*SOLVENT, *extra)


def left_fold(first: Column, *rest: tuple[str, Column]) -> Column:
    """Terms joined by 'and' / 'or' strictly from left to right, without precedence."""
    return reduce(lambda acc, t: acc & t[1] if t[0] == "and" else acc | t[1], rest, first)


def assign_leaflets(ref: DataFrame, cards=LEAFLET_CARDS) -> DataFrame:
    """(res_nr, leaflet) of one reference frame: the head-tail dz of the larger absolute value; above 0 upper (1), else lower (2).

    cards: rows (res_name, head_1, tail_1, head_2, tail_2); of several cards of a lipid, the one whose atoms it has.
    """
    spark = ref.sparkSession
    known = spark.createDataFrame(list(cards), "res_name string, head_1 string, tail_1 string, head_2 string, tail_2 string")
    rows = ref.join(F.broadcast(known), "res_name")
    pick = lambda c: F.max(F.when(F.col("atom_name") == F.col(c), F.col("z")))
    per = rows.groupBy("res_nr", *known.columns).agg((pick("head_1") - pick("tail_1")).alias("d1"), (pick("head_2") - pick("tail_2")).alias("d2")).filter("d1 is not null and d2 is not null")
    dz = F.when(F.abs("d1") > F.abs("d2"), F.col("d1")).otherwise(F.col("d2"))
    return per.groupBy("res_nr").agg(F.max(F.when(dz > 0, 1).otherwise(2)).cast("int").alias("leaflet"))


def leaflet_view(df: DataFrame, leaf: int) -> DataFrame:
    """leaf 1 or 2; 0 is both."""
    return df if leaf == 0 else df.filter(F.col("leaflet") == leaf)


def opposing(leaf: int) -> int:
    """The other leaflet; the opposite of both is both."""
    return {0: 0, 1: 2, 2: 1}[leaf]


def census(df: DataFrame, *by: str) -> DataFrame:
    """Molecules and atoms per group."""
    return df.groupBy(*by).agg(F.countDistinct("res_nr").alias("n_molecules"), F.count("*").alias("n_atoms"))


def rect(tx: float, ty: float, rx: float, ry: float, invert: bool = False, x: str = "gx", y: str = "gy") -> Column:
    inside = (F.abs(F.col(x) - tx) <= rx) & (F.abs(F.col(y) - ty) <= ry)
    return ~inside if invert else inside


def in_shapes(df: DataFrame, shapes: DataFrame) -> DataFrame:
    """Rows inside any cylinder (cx, cy, cz, radius, height): r <= radius, and strictly abs(dz) < height / 2."""
    s = F.broadcast(shapes)
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    return df.join(s, (F.sqrt(dx * dx + dy * dy) <= F.col("radius")) & (F.abs(F.col("z") - F.col("cz")) < F.col("height") / 2), "left_semi")


def set_attrs(df: DataFrame, where: Column, **values) -> DataFrame:
    return df.withColumns({c: F.when(where, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def copy_beta(a: DataFrame, b: DataFrame) -> DataFrame:
    """a with the beta of b by atom_nr. Atom names have to agree: a mismatch fails the job when the row is read."""
    other = b.select("atom_nr", F.col("beta").alias("_beta"), F.col("atom_name").alias("_name"))
    j = a.drop("beta").join(other, "atom_nr")
    checked = F.when(F.col("atom_name") == F.col("_name"), F.col("_beta")).otherwise(F.raise_error(F.concat(F.lit("atom names differ at "), F.col("atom_nr"))).cast("double"))
    return j.withColumn("beta", checked).drop("_beta", "_name")


def stamp_grid(df: DataFrame, lattice: DataFrame) -> DataFrame:
    """Residue k takes node k of the lattice, counted y outer, x inner; a masked node gives beta 0 and coordinates 0.

    The residue numbers and the nodes are dimension tables, which is why they are numbered in one place.
    """
    nodes = lattice.select(F.row_number().over(Window.orderBy("gy", "gx")).alias("_k"), F.col("value").alias("_v"))
    residues = df.select("res_nr").distinct().select("res_nr", F.row_number().over(Window.orderBy("res_nr")).alias("_k"))
    j = df.join(residues.join(nodes, "_k"), "res_nr")
    masked = F.col("_v").isNull()
    return j.withColumns({"beta": F.coalesce("_v", F.lit(0.0)), **{c: F.when(masked, 0.0).otherwise(F.col(c)) for c in "xyz"}}).drop("_k", "_v")


def retime(df: DataFrame, dt: float, t0: float = 0.0) -> DataFrame:
    return df.withColumn("time", F.col("frame") * F.lit(dt) + F.lit(t0))
