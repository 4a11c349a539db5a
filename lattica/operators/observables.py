"""Lattice observables (G1, G3-G29). dims=2 or 3 is the length of the lattice's shape; hits are averaged in frames, then over frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions.geometry import arccos, length

from .lattice import Lattice, density, frame_mean, grid_keys, stamp, stamp_counts, time_mean
from .molecule import centers, gyration, order_parameter, pair_distance, pair_vector
from .rangejoin import classes, count_near, near, range_join
from .scanline import even_mean, totals
from .tessellate import tessellate
from .transforms import checkpointed


def at_atoms(values: DataFrame, atoms: DataFrame, mapping: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """Per-residue values at each of the residue's mapping atoms: points (frame, x, y, z, columns)."""
    at = atoms.filter(F.col("atom_name").isin(*mapping)).select("frame", "res_nr", "x", "y", "z")
    return values.select("frame", "res_nr", *columns).join(at, ["frame", "res_nr"]).select("frame", "x", "y", "z", *columns)


def mapped(points: DataFrame, grid: Lattice, radius: float, values: tuple[str, ...] = ("value",)) -> DataFrame:
    return time_mean(points, grid, radius, values=values)


def thickness(target: DataFrame, other: DataFrame, xy_cutoff: float, mapping: DataFrame, grid: Lattice, radius: float) -> DataFrame:
    """abs(dz) to the opposing lipid nearest in xy within xy_cutoff (ties: lower residue), at the target's mapping atoms; paired: the share of target lipids
    with a partner, per node."""
    places = target.select("frame", "x", "y").distinct()
    first = other.groupBy("frame", "x", "y").agg(F.min(F.struct("res_nr", "z")).alias("o"))
    near = range_join(places, first, xy_cutoff, dims="xy").groupBy("frame", F.col("a_x").alias("x"), F.col("a_y").alias("y")).agg(F.min(F.struct("dist", F.col("b_o.res_nr").alias("res_nr"), F.col("b_o.z").alias("z"))).alias("p"))
    pick = F.min(F.struct("p.dist", "p.res_nr", F.abs(F.col("z") - F.col("p.z")).alias("value"))).alias("m")
    found = target.join(near, ["frame", "x", "y"]).groupBy("frame", "res_nr").agg(pick).select("frame", "res_nr", "m.value")
    points = mapping.select("frame", "res_nr", "x", "y").join(found, ["frame", "res_nr"], "left").withColumn("paired", F.col("value").isNotNull().cast("double"))
    f = frame_mean(points, grid, radius, values=("value", "paired"))
    return f.groupBy(*grid.keys).agg(even_mean("value"), even_mean("paired"), F.count("value").alias("rho"))


def lipid_areas(sites: DataFrame, grid: Lattice, radius: float, box: tuple[float, float] | None) -> DataFrame:
    """(frame, res_nr, value): nodes of each residue's tessellation cell times the area of a node."""
    t = tessellate(sites, grid, radius, box)
    return t.groupBy("frame", "res_nr").agg((F.count("*") * F.lit(grid.cell * grid.cell)).alias("value"))


def area_per_lipid(sites: DataFrame, tess: Lattice, radius: float, box, mapping: DataFrame, grid: Lattice) -> DataFrame:
    points = mapping.select("frame", "res_nr", "x", "y", "z").join(lipid_areas(sites, tess, radius, box), ["frame", "res_nr"])
    return mapped(points, grid, radius)


def zcoord_lattice(atoms: DataFrame, target: str, mapping: str, grid: Lattice, radius: float) -> DataFrame:
    z = atoms.filter(F.col("atom_name") == target).select("frame", "res_nr", F.col("z").alias("value"))
    return mapped(at_atoms(z, atoms, (mapping,), ("value",)), grid, radius)


def p2_lattice(atoms: DataFrame, pairs, mapping: tuple[str, str], grid: Lattice, radius: float) -> DataFrame:
    return mapped(at_atoms(order_parameter(atoms, pairs), atoms, mapping, ("p2", "theta")), grid, radius, ("p2", "theta"))


def orientation_lattice(atoms: DataFrame, a: str, b: str, mapping: str, grid: Lattice, radius: float) -> DataFrame:
    """Mean vector a -> b per node, then its theta, phi, P2 and length."""
    g = mapped(pair_vector(atoms, a, b, mapping), grid, radius, ("dx", "dy", "dz"))
    x, y, z = F.col("dx"), F.col("dy"), F.col("dz")
    norm, flat = length(x, y, z), length(x, y)
    phi = arccos(F.when(flat > 0, y / flat).otherwise(F.lit(1.0)))
    cos = F.try_divide(z, norm)
    return g.select(*grid_keys(g), "rho", arccos(cos).alias("theta"), F.when(x < 0, 360.0 - phi).otherwise(phi).alias("phi"), ((cos * cos * 3.0 - 1.0) * 0.5).alias("p2"), norm.alias("length"))


def distance_lattice(atoms: DataFrame, a: str, b: str, mapping: str, grid: Lattice, radius: float) -> DataFrame:
    return mapped(pair_distance(atoms, a, b, mapping), grid, radius)


def gyration_lattice(atoms: DataFrame, mapping: tuple[str, ...], grid: Lattice, radius: float) -> DataFrame:
    return mapped(at_atoms(gyration(atoms).withColumnRenamed("rg", "value"), atoms, mapping, ("value",)), grid, radius)


def neighbor_counts(a: DataFrame, b: DataFrame, local: float, dims: str = "xyz") -> DataFrame:
    """(frame, res_nr, value): other residues of b with a centre nearer than local, 0 included."""
    return count_near(a.select("frame", "res_nr", *dims), b.select("frame", "res_nr", *dims), local, dims=dims, other="res_nr").select("frame", "res_nr", F.col("n").cast("double").alias("value"))


def neighbors_lattice(a: DataFrame, b: DataFrame, local: float, atoms: DataFrame, mapping: tuple[str, ...], grid: Lattice, radius: float) -> DataFrame:
    return mapped(at_atoms(neighbor_counts(a, b, local), atoms, mapping, ("value",)), grid, radius)


def contact_counts(a: DataFrame, b: DataFrame, cutoff: float, screen: float | None = None) -> DataFrame:
    """(frame, res_nr, value, molecules): atom contacts and contacted residues of each residue of a with other residues of b. Residues whose atoms lie at the same
    places are a class: one of each class is compared, a contact counts for all members, and the residue itself is taken away.

    screen: only residues whose centres are nearer than this are looked at; it can lose contacts of large residues."""
    cols = ["frame", "res_nr", "x", "y", "z"]
    ma, mb = checkpointed(classes(a, "res_nr")), checkpointed(classes(b, "res_nr"))
    ra, rb = (df.select(cols).join(m.filter("res_nr = rep").select("frame", "res_nr"), ["frame", "res_nr"], "left_semi") for df, m in ((a, ma), (b, mb)))
    pairs = range_join(ra, rb, cutoff)
    if screen is not None:
        close = range_join(centers(ra), centers(rb), screen).select("frame", "a_res_nr", "b_res_nr")
        pairs = pairs.join(close, ["frame", "a_res_nr", "b_res_nr"], "left_semi")
    sizes = mb.filter("res_nr = rep").select("frame", F.col("rep").alias("_b"), "size")
    met = checkpointed(pairs.groupBy("frame", F.col("a_res_nr").alias("rep"), F.col("b_res_nr").alias("_b")).agg(F.count("*").alias("_one")))
    per = met.join(sizes, ["frame", "_b"]).groupBy("frame", "rep").agg(F.sum(F.col("_one") * F.col("size")).alias("value"), F.sum("size").alias("molecules"))
    own = ma.join(mb.select("frame", "res_nr", F.col("rep").alias("_b")), ["frame", "res_nr"]).join(met, ["frame", "rep", "_b"]).select("frame", "res_nr", "_one")
    every = ma.select("frame", "res_nr", "rep").join(per, ["frame", "rep"], "left").join(own, ["frame", "res_nr"], "left")
    less = lambda c, one: (F.coalesce(c, F.lit(0)) - F.coalesce(one, F.lit(0))).cast("double").alias(c)
    return every.select("frame", "res_nr", less("value", F.col("_one")), less("molecules", F.when(F.col("_one").isNotNull(), 1)))


def contacts_lattice(a: DataFrame, b: DataFrame, cutoff: float, screen: float | None, mapping: tuple[str, ...], grid: Lattice, radius: float) -> DataFrame:
    points = at_atoms(contact_counts(a, b, cutoff, screen), a, mapping, ("value", "molecules"))
    return mapped(points, grid, radius, ("value", "molecules"))


def central(df: DataFrame, box: tuple[float, float], low: float = 0.15, high: float = 0.85) -> DataFrame:
    """Rows in the central part of the box in x and y."""
    return df.filter(F.col("x").between(low * box[0], high * box[0]) & F.col("y").between(low * box[1], high * box[1]))


def interleaflet_series(a: DataFrame, b: DataFrame, cutoff: float, heads: DataFrame, box: tuple[float, float]) -> DataFrame:
    """(frame, value): mean contacts of the lipids whose heads lie in the central part of the box."""
    mid = central(heads, box).select("frame", "res_nr")
    return contact_counts(a, b, cutoff).join(mid, ["frame", "res_nr"], "left_semi").groupBy("frame").agg(F.avg("value").alias("value"))


def interdigitation(tails: DataFrame, opposing: DataFrame, cutoff: float, ranks: DataFrame) -> DataFrame:
    """(frame, atom_nr, x, y, z, value): mean rank of opposing atoms within cutoff of a tail atom; atoms of rank 0 don't count; 0 where there is none. Places are compared, and the ranks of one are summed up first."""
    ranked = opposing.join(F.broadcast(ranks), ["res_name", "atom_name"]).filter("rank != 0").groupBy("frame", "x", "y", "z").agg(F.sum("rank").alias("rank"), F.count("*").alias("n"))
    pairs = range_join(tails.select("frame", "x", "y", "z").distinct(), ranked, cutoff).groupBy("frame", *[F.col(f"a_{c}").alias(c) for c in "xyz"]).agg((F.sum("b_rank") / F.sum("b_n")).alias("m"))
    return tails.select("frame", "atom_nr", "x", "y", "z").join(pairs, ["frame", "x", "y", "z"], "left").select("frame", "atom_nr", "x", "y", "z", F.coalesce("m", F.lit(0.0)).alias("value"))


def salt_bridges(a: DataFrame, b: DataFrame, cutoff: float) -> DataFrame:
    """(frame, res_nr, value): partners of opposite charge (column charge) nearer than cutoff; 0 included."""
    pairs = range_join(a.select("frame", "res_nr", "charge", "x", "y", "z"), b.select("frame", "res_nr", "charge", "x", "y", "z"), cutoff, where=F.col("a_charge") == -F.col("b_charge"))
    n = pairs.groupBy("frame", F.col("a_res_nr").alias("res_nr")).agg(F.count("*").alias("n"))
    return a.select("frame", "res_nr").join(n, ["frame", "res_nr"], "left").select("frame", "res_nr", F.coalesce("n", F.lit(0)).cast("double").alias("value"))


def enrichment_lattice(points: DataFrame, is_a: Column, is_b: Column, bulk: float, grid: Lattice, radius: float) -> DataFrame:
    """Frames visited by sets A and B per node, and ((A / B) - bulk) / bulk * 100; null where B is 0."""
    f = totals(points.withColumns({"a": is_a.cast("int"), "b": is_b.cast("int")}), grid, radius, ("frame",), ("a", "b"))
    f = f.select(*grid.keys, *[(F.col(c) > 0.5).cast("int").alias(c) for c in "ab"])
    g = f.groupBy(*grid.keys).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("rho"))
    return g.withColumn("value", F.when(F.col("b") > 0, (F.col("a") / F.col("b") - bulk) / bulk * 100.0))


def density_lattice(atoms: DataFrame, grid: Lattice, radius: float, n_frames: int) -> DataFrame:
    """Mass-conserving density: sums to the number of molecules whose discs lie inside."""
    molecule = Window.partitionBy("frame", "res_nr")
    sized = atoms.select("frame", "res_nr", "atom_nr", F.count("*").over(molecule).alias("n_atoms"), "x", "y", "z")
    return density(sized, grid, radius, n_frames, atom=("frame", "res_nr", "atom_nr"))


def density3(atoms: DataFrame, grid: Lattice, radius: float, n_frames: int, protein: DataFrame | None = None, within: float | None = None) -> DataFrame:
    """Stamps per frame in 3D, of atoms near the protein if within is given."""
    rows = atoms.select("frame", "x", "y", "z")
    rows = near(rows, protein.select("frame", "x", "y", "z"), within) if within is not None else rows
    return stamp_counts(rows, grid, radius, ()).select(*grid.keys, (F.col("n") / F.lit(float(n_frames))).alias("value"))


def mean_lipid_coords(atoms: DataFrame, mapping: str, grid: Lattice, radius: float) -> DataFrame:
    """Mean position of every atom name of the lipids stamped at a node: (node, atom_name, x, y, z, rho), frame means first."""
    at = atoms.filter(F.col("atom_name") == mapping).select("frame", "res_nr", "x", "y", "z")
    nodes = stamp(at, grid, radius).select("frame", "res_nr", *grid.keys)
    rows = nodes.join(atoms.select("frame", "res_nr", "atom_name", "x", "y", "z"), ["frame", "res_nr"])
    f = rows.groupBy("frame", "atom_name", *grid.keys).agg(*[F.avg(c).alias(c) for c in "xyz"])
    return f.groupBy("atom_name", *grid.keys).agg(*[F.avg(c).alias(c) for c in "xyz"], F.count("*").alias("rho"))


def lipid_spread(atoms: DataFrame, mapping: str, grid: Lattice, radius: float) -> DataFrame:
    """Second pass: mean distance of the lipids' atoms to the node's mean structure, and the RMSD after removing centres."""
    mean = mean_lipid_coords(atoms, mapping, grid, radius).select("atom_name", *grid.keys, *[F.col(c).alias(f"m{c}") for c in "xyz"])
    at = atoms.filter(F.col("atom_name") == mapping).select("frame", "res_nr", "x", "y", "z")
    nodes = stamp(at, grid, radius).select("frame", "res_nr", *grid.keys)
    rows = nodes.join(atoms.select("frame", "res_nr", "atom_name", "x", "y", "z"), ["frame", "res_nr"]).join(mean, ["atom_name", *grid.keys])
    d = [F.col(c) - F.col(f"m{c}") for c in "xyz"]
    per = rows.groupBy("frame", "res_nr", *grid.keys).agg(F.avg(length(*d)).alias("dist"), F.avg(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("d2"), *[F.avg(x).alias(f"s{c}") for x, c in zip(d, "xyz")])
    rmsd = F.sqrt(F.greatest(F.lit(0.0), F.col("d2") - F.col("sx") * F.col("sx") - F.col("sy") * F.col("sy") - F.col("sz") * F.col("sz")))
    return per.groupBy(*grid.keys).agg(F.avg("dist").alias("dist"), F.avg(rmsd).alias("rmsd"), F.count("*").alias("n"))


def lipid_tracks(atoms: DataFrame, grid: Lattice, radius: float) -> DataFrame:
    """Visits of each lipid's centre per node: (res_nr, node, visits)."""
    s = stamp(centers(atoms).select("frame", "res_nr", "x", "y", "z"), grid, radius)
    return s.groupBy("res_nr", *grid.keys).agg(F.count("*").alias("visits"))




def lipid_hbond_counts(bonds: DataFrame, atoms: DataFrame, side: str = "acceptor") -> DataFrame:
    """(frame, res_nr, value): hydrogen bonds of each residue's atoms on one side, 0 included: bonds as rows (frame, acceptor, donor, hydrogen), or the numbers n of the acceptors (hbond_counts)."""
    if "n" in bonds.columns:
        n = bonds.groupBy("frame", "res_nr").agg(F.sum("n").alias("n"))
    else:
        who = atoms.select("frame", F.col("atom_nr").alias(side), "res_nr")
        n = bonds.join(who, ["frame", side]).groupBy("frame", "res_nr").agg(F.count("*").alias("n"))
    return atoms.select("frame", "res_nr").distinct().join(n, ["frame", "res_nr"], "left").select("frame", "res_nr", F.coalesce("n", F.lit(0)).cast("double").alias("value"))


def hbond_types(counts: DataFrame, n_frames: int) -> DataFrame:
    """Per (donor name, acceptor name, lipid type of the acceptor): bonds a frame, and the acceptors' mean position, each as often as it has bonds. counts: acceptors with n and donor_name (hbond_counts)."""
    mean = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c)
    return counts.groupBy("donor_name", F.col("atom_name").alias("acceptor_name"), "res_name").agg((F.sum("n") / F.lit(float(n_frames))).alias("frequency"), *[mean(c) for c in "xyz"])
