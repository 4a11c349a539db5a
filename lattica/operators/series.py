"""Time series and protein observables (T1-T22)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions.geometry import length

from .molecule import tilt
from .rangejoin import allowed, classes, contacts, count_near, hbonds, knn, member_pairs, min_dist, near_places, range_join, unless
from .transforms import checkpointed, group_center, superpose
from .windows import majority_events, state_fold


def contact_pairs(a: DataFrame, b: DataFrame, cutoff: float) -> DataFrame:
    """(frame, i, j): atoms of a and b at distance <= cutoff."""
    cols = ["frame", "atom_nr", "x", "y", "z"]
    return contacts(a.select(cols), b.select(cols), cutoff, closed=True).select("frame", F.col("a_atom_nr").alias("i"), F.col("b_atom_nr").alias("j"))


def contact_series(pairs: DataFrame, frames: DataFrame) -> DataFrame:
    """(frame, n) with 0 for frames without contacts; pairs, or numbers n of them."""
    n = pairs.groupBy("frame").agg((F.sum("n") if "n" in pairs.columns else F.count("*")).alias("n"))
    return frames.join(n, "frame", "left").select("frame", F.coalesce("n", F.lit(0)).alias("n"))


def contact_frequency(pairs: DataFrame, n_frames: int) -> DataFrame:
    """(i, j, frequency), most frequent first."""
    return pairs.groupBy("i", "j").agg((F.countDistinct("frame") / F.lit(float(n_frames))).alias("frequency")).orderBy(F.desc("frequency"), "i", "j")


def contact_kinetics(pairs: DataFrame, bound: DataFrame, r: int) -> DataFrame:
    """(i, j, n, mean_dwell) of noise-filtered contacts of the bound lipid; bound: (frame, lipid_nr). A change of the bound lipid restarts a contact."""
    rows = pairs.join(bound.filter("lipid_nr >= 0"), "frame").select("i", "j", "frame", "lipid_nr")
    ev = majority_events(rows, r, keys=["i", "j"])
    return ev.groupBy("i", "j").agg(F.count("*").alias("n"), F.avg("dwell").alias("mean_dwell"))


def contact_rmsf(pairs: DataFrame, n_frames: int) -> DataFrame:
    """Per lipid atom i: RMS over frames of 1 - sum(min) / (sum(min) + sum(diff)) of its contact vector and its mean. A pair with a column n stands for n pairs.

    Vectors are sparse: with the mean m_j, an atom in contact adds min m_j and difference 1 - m_j, one out of contact difference m_j."""
    pairs = pairs if "n" in pairs.columns else pairs.withColumn("n", F.lit(1))
    mean = pairs.groupBy("i", "j").agg((F.count("*") / F.lit(float(n_frames))).alias("m"), F.max("n").alias("_n"))
    total = mean.groupBy("i").agg(F.sum(F.col("m") * F.col("_n")).alias("total"))
    per = pairs.join(mean.drop("_n"), ["i", "j"]).groupBy("i", "frame").agg(F.sum(F.col("m") * F.col("n")).alias("low"), F.sum("n").alias("n"))
    # sum of max = contacts + means of the atoms out of contact
    delta = 1.0 - F.col("low") / (F.col("n") + F.col("total") - F.col("low"))
    out = per.join(total, "i").groupBy("i").agg(F.sum(delta * delta).alias("s"), F.count("*").alias("k"))
    return out.select("i", F.sqrt((F.col("s") + (F.lit(n_frames) - F.col("k"))) / F.lit(float(n_frames))).alias("value"))


def paths(df: DataFrame, key: str = "atom_nr", places: tuple[str, ...] = ("x", "y", "z")) -> tuple[DataFrame, DataFrame]:
    """Rows of one key of each class of keys with the same path, i.e. the same places in all frames, and the members of the classes (key, rep, size)."""
    members = checkpointed(classes(df, key, (), ("frame", *places)))
    return df.join(members.filter(F.col(key) == F.col("rep")).select(key), key, "left_semi"), members


def of_pairs(found: DataFrame, members: tuple[DataFrame, DataFrame], first: Column | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """found (i, j, ..), rows of pairs of classes by their reps, for all pairs of members (key, rep, size); none of exclude(a, b)."""
    a, b = (m.toDF(c, rep, "size") for m, c, rep in zip(members, "ij", ("_i", "_j")))
    values = [c for c in found.columns if c not in ("i", "j")]
    sizes = [m.filter(F.col(c) == F.col(rep)).select(rep, F.col("size").alias(n)) for m, c, rep, n in ((a, "i", "_i", "a_n"), (b, "j", "_j", "b_n"))]
    links = found.withColumnsRenamed({"i": "_i", "j": "_j"}).join(sizes[0], "_i").join(sizes[1], "_j")
    takers = a.drop("size") if exclude is None else unless(exclude, a.drop("size"), "i")
    rows = member_pairs(links, takers, b.drop("size"), ["_i"], ["_j"], [F.col("a.i").alias("i"), F.col("b.j").alias("j"), *([] if exclude is None else ["a._no"]), *values], first)
    return rows if exclude is None else rows.filter(allowed("i", "j")).drop("_no")


def path_pairs(a: DataFrame, b: DataFrame, cutoff: float) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    """contact_pairs of one atom of each path, and the members of the paths of a and b."""
    (ra, ma), (rb, mb) = paths(a), paths(b)
    return contact_pairs(ra, rb, cutoff), (ma, mb)


def path_frequency(a: DataFrame, b: DataFrame, cutoff: float, n_frames: int) -> DataFrame:
    """contact_frequency of all contact_pairs, most frequent first: atoms of one path are compared once, and their pairs are made last."""
    found, members = path_pairs(a, b, cutoff)
    found = found.groupBy("i", "j").agg((F.countDistinct("frame") / F.lit(float(n_frames))).alias("frequency"))
    return of_pairs(found, members, F.desc("frequency"))


def path_kinetics(a: DataFrame, b: DataFrame, cutoff: float, bound: DataFrame, r: int) -> DataFrame:
    """contact_kinetics of all contact_pairs, as path_frequency."""
    found, members = path_pairs(a, b, cutoff)
    return of_pairs(contact_kinetics(found, bound, r), members)


def path_rmsf(a: DataFrame, b: DataFrame, cutoff: float, n_frames: int) -> DataFrame:
    """contact_rmsf of all contact_pairs; an atom of each path stands for those of its path."""
    found, (ma, mb) = path_pairs(a, b, cutoff)
    sized = checkpointed(found).join(mb.filter("atom_nr = rep").select(F.col("rep").alias("j"), F.col("size").alias("n")), "j")
    return ma.select(F.col("atom_nr").alias("i"), "rep").join(contact_rmsf(sized, n_frames).withColumnRenamed("i", "rep"), "rep").select("i", "value")


def hbond_kinetics(acceptors: DataFrame, donors: DataFrame, bonds: DataFrame, hydrogens: DataFrame, distance: float, angle: float, exclude: DataFrame | None, bound: DataFrame, r: int) -> DataFrame:
    """contact_kinetics of the acceptors i and donors j of all hbonds, as path_frequency; a donor's path is its own and those of its hydrogens."""
    taker, ma = paths(acceptors)
    sym = bonds.select(F.col("a").alias("atom_nr"), F.col("b").alias("_h")).union(bonds.select("b", "a")).distinct()
    ends = donors.select("frame", "atom_nr", *"xyz").join(sym, "atom_nr").join(hydrogens.select("frame", F.col("atom_nr").alias("_h"), *[F.col(c).alias(f"h{c}") for c in "xyz"]), ["frame", "_h"])
    mb = paths(ends, places=("x", "y", "z", "hx", "hy", "hz"))[1]
    giver = donors.join(mb.filter("atom_nr = rep").select("atom_nr"), "atom_nr", "left_semi")
    found = hbonds(taker, giver, bonds, hydrogens, distance, angle).select("frame", F.col("acceptor").alias("i"), F.col("donor").alias("j"))
    return of_pairs(contact_kinetics(found, bound, r), (ma, mb), exclude=exclude)


def distance_series(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """(frame, dist) of two groups' geometric centres."""
    ca = group_center(df, a, False)
    cb = group_center(df, b, False).select("frame", *[F.col(f"c{c}").alias(f"d{c}") for c in "xyz"])
    return ca.join(cb, "frame").select("frame", length(*[F.col(f"c{c}") - F.col(f"d{c}") for c in "xyz"]).alias("dist"))


def min_distance_series(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    cols = ["frame", "atom_nr", "x", "y", "z"]
    return min_dist(a.select(cols), b.select(cols), ["atom_nr"], radius).groupBy("frame").agg(F.min("dist").alias("dist"))


def deviations(df: DataFrame, ref: DataFrame) -> DataFrame:
    """d2 of each atom to ref(atom_nr, x, y, z)."""
    r = ref.select("atom_nr", *[F.col(c).alias(f"r{c}") for c in "xyz"])
    return df.join(r, "atom_nr").withColumn("d2", sum((F.col(c) - F.col(f"r{c}")) * (F.col(c) - F.col(f"r{c}")) for c in "xyz"))


def rmsd_series(df: DataFrame, fit: Column, measure: Column, ref: DataFrame) -> DataFrame:
    """(frame, rmsd) of the measured group after a fit of another group to ref."""
    return deviations(superpose(df, fit, ref).filter(measure), ref).groupBy("frame").agg(F.sqrt(F.avg("d2")).alias("rmsd"))


def rmsf(df: DataFrame, ref: DataFrame) -> DataFrame:
    return deviations(df, ref).groupBy("atom_nr").agg(F.sqrt(F.avg("d2")).alias("rmsf"))


def mean_coords(df: DataFrame) -> DataFrame:
    return df.groupBy("atom_nr").agg(*[F.avg(c).alias(c) for c in "xyz"])


def mean_coords_spread(df: DataFrame) -> DataFrame:
    """Mean position of each atom, and the mean and largest distance from it."""
    m = mean_coords(df)
    d = deviations(df.select("frame", "atom_nr", "x", "y", "z"), m).groupBy("atom_nr").agg(F.avg(F.sqrt("d2")).alias("mean_dist"), F.max(F.sqrt("d2")).alias("max_dist"))
    return m.join(d, "atom_nr")


def orientation_series(df: DataFrame, upper: Column, lower: Column) -> DataFrame:
    return tilt(df, upper, lower)


def contacts_per(a: DataFrame, b: DataFrame, cutoff: float, key: str, n_frames: int) -> DataFrame:
    """(key, value): mean contacts per frame with b of each atom or residue of a, 0 included."""
    cols = ["frame", key, "x", "y", "z"]
    return count_near(a.select(cols), b.select("frame", "x", "y", "z"), cutoff).groupBy(key).agg((F.sum("n") / F.lit(float(n_frames))).alias("value"))


def residue_enrichment(protein: DataFrame, lipids: DataFrame, cutoff: float, is_a: Column, is_b: Column, bulk: float) -> DataFrame:
    """(res_nr, a, b, value): different (frame, lipid) of sets A and B touching a residue, and their ratio against bulk; null if either is 0."""
    cols = ["frame", "res_nr", "x", "y", "z"]
    marked = lipids.withColumns({"in_a": is_a, "in_b": is_b}).select(*cols, "in_a", "in_b")
    ma, mb = checkpointed(classes(protein, "res_nr")), checkpointed(classes(marked, "res_nr", shape=("x", "y", "z", "in_a", "in_b")))
    one = lambda df, m: df.join(m.filter("res_nr = rep").select("frame", "res_nr", "size"), ["frame", "res_nr"])
    pairs = contacts(one(protein.select(cols), ma).drop("size"), one(marked, mb), cutoff)
    met = pairs.groupBy("frame", F.col("a_res_nr").alias("rep"), "b_res_nr").agg(*[F.max(F.when(F.col(f"b_in_{c}"), F.col("b_size")).otherwise(0)).alias(c) for c in "ab"])
    per = met.groupBy("frame", "rep").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    g = ma.select("frame", "res_nr", "rep").join(per, ["frame", "rep"]).groupBy("res_nr").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return g.withColumn("value", F.when((F.col("a") > 0) & (F.col("b") > 0), (F.col("a") / F.col("b") - bulk) / bulk * 100.0))


def surface_residues(protein: DataFrame, lipids: DataFrame, cutoff: float, z: float, n_frames: int, key: str = "res_nr") -> DataFrame:
    """Atoms (key) with the percent of frames they touch lipid, the floor(mean + z * sd) of highest percent; mean and sd of the number touching per frame."""
    pairs = checkpointed(near_places(protein.select("frame", key, "x", "y", "z"), lipids, cutoff).select("frame", key).distinct())
    per = pairs.groupBy("frame").agg(F.count("*").alias("n"))
    top = per.agg(F.floor(F.avg("n") + z * F.coalesce(F.stddev_samp("n"), F.lit(0.0))).alias("_top"))
    pct = pairs.groupBy(key).agg((F.count("*") * 100.0 / F.lit(n_frames)).alias("percent"))
    ranked = pct.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("percent"), key)))
    return ranked.crossJoin(F.broadcast(top)).filter("rank <= _top").drop("_top")


def lipid_protein_distance(lipids: DataFrame, protein: DataFrame, bound: DataFrame, cutoff: float, radius: float) -> DataFrame:
    """Per atom name of the bound lipid: mean least distance to the protein, contacts a frame, share of frames in contact. bound: (frame, res_nr)."""
    held = lipids.join(bound, ["frame", "res_nr"], "left_semi")
    d = min_dist(held.select("frame", "atom_nr", "atom_name", "x", "y", "z"), protein.select("frame", "x", "y", "z"), ["atom_nr", "atom_name"], radius)
    n = range_join(held.select("frame", "atom_nr", "x", "y", "z"), protein.select("frame", "x", "y", "z"), cutoff).groupBy("frame", F.col("a_atom_nr").alias("atom_nr")).agg(F.count("*").alias("n"))
    j = d.join(n, ["frame", "atom_nr"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return j.groupBy("atom_name").agg(F.avg("dist").alias("min_dist"), F.avg("n").alias("contacts"), F.avg(F.when(F.col("n") > 0, 1.0).otherwise(0.0)).alias("frequency"))


def flip_series(centers: DataFrame) -> DataFrame:
    """(res_nr, frame, z)."""
    return centers.select("res_nr", "frame", "z")


def _correlation(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """sum over t of a[t] b[t + lag], for each lag below size."""
    room = 1 << (2 * size - 1).bit_length()
    return np.fft.irfft(np.conj(np.fft.rfft(a, room)) * np.fft.rfft(b, room), room)[:size]


def _displacements(frames: np.ndarray, x: np.ndarray, y: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Lags above 0 that occur, and the mean square displacement of each, of one series in any order. (a - b)^2 is a^2 + b^2 - 2 a b, and each of these, and the
    number of pairs, is a correlation over frames, whatever frames are missing or repeated."""
    first = frames.min()
    step = max(1, int(np.gcd.reduce(frames - first)))
    at = (frames - first) // step
    size = int(at.max()) + 1
    put = lambda v: np.bincount(at, v, size)
    x, y = x - x.mean(), y - y.mean()
    n, sx, sy, sq = put(np.ones(len(at))), put(x), put(y), put(x * x + y * y)
    origin = np.arange(size) * step % stride == 0
    pairs = np.rint(_correlation(n * origin, n, size))
    total = _correlation(n * origin, sq, size) + _correlation(sq * origin, n, size) - 2 * (_correlation(sx * origin, sx, size) + _correlation(sy * origin, sy, size))
    lag = np.flatnonzero(pairs[1:] > 0) + 1
    return lag * step, np.maximum(total[lag], 0.0) / pairs[lag]


def msd_by_lipid(centers: DataFrame, max_lag: int | None = None, stride: int = 1) -> DataFrame:
    """(res_nr, lag, value): each lipid's xy mean square displacement over its time origins, which are every stride frames from its first on.

    By fast Fourier transforms, one lipid at a time: its series of frames is the group, and time grows as n log n in its frames. Rows without a frame
    or a position are left out; several rows of one frame all count."""
    def run(table: pa.Table) -> pa.Table:
        frames, x, y = (table[c].to_numpy() for c in ("frame", "x", "y"))
        lag, value = _displacements(frames.astype(np.int64), x, y, stride)
        keep = lag <= max_lag if max_lag is not None else np.ones(len(lag), bool)
        return pa.table([pa.repeat(table["res_nr"][0], int(keep.sum())), pa.array(lag[keep].astype(np.int32)), pa.array(value[keep])], ["res_nr", "lag", "value"])

    rows = centers.select("res_nr", "frame", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna(subset=["frame", "x", "y"])
    return rows.groupBy("res_nr").applyInArrow(run, f"res_nr {centers.schema['res_nr'].dataType.simpleString()}, lag int, value double")


def msd(centers: DataFrame, max_lag: int | None = None, stride: int = 1) -> DataFrame:
    """(lag, value, n): the mean over lipids of their mean square displacements, and the number of lipids that have the lag."""
    return msd_by_lipid(centers, max_lag, stride).groupBy("lag").agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def regions(ions: DataFrame, upper: DataFrame, lower: DataFrame, k: int, buffer: float, radius: float, key: str = "res_nr") -> DataFrame:
    """(key, frame, region): 0 above the upper leaflet, 1 in its buffer, 2 between, 3 in the lower buffer, 4 below; leaflet heights are means of the
    k lipids nearest in xy."""
    def height(side: DataFrame, name: str) -> DataFrame:
        near = knn(ions.select("frame", key, "x", "y"), side.select("frame", "res_nr", "x", "y", "z"), k, [key], "res_nr", radius)
        return near.groupBy("frame", F.col(f"a_{key}").alias(key)).agg(F.avg("b_z").alias(name))

    j = ions.join(height(upper, "zu"), ["frame", key]).join(height(lower, "zl"), ["frame", key])
    z = F.col("z")
    region = F.when(z > F.col("zu") + buffer, 0).when(z > F.col("zu") - buffer, 1).when(z >= F.col("zl") + buffer, 2).when(z >= F.col("zl") - buffer, 3).otherwise(4)
    return j.select(key, "frame", region.alias("region"))


def permeation(ions: DataFrame, upper: DataFrame, lower: DataFrame, k: int, buffer: float, radius: float, key: str = "res_nr") -> DataFrame:
    return state_fold(regions(ions, upper, lower, k, buffer, radius, key), key, "region")


def mixing(a: DataFrame, b: DataFrame, shell: float, r: int, n_b: int, stride: int, n_frames: int) -> DataFrame:
    """(frame, mean, sd): percent of B lipids ever majority-bound to an A lipid, over A lipids, every stride frames. Lipids with the same path in all frames are a class, of which
    one is followed; its events count for all members, and a lipid's own path is taken away."""
    ma, mb = (checkpointed(classes(df, "res_nr", (), ("frame", "x", "y"))) for df in (a, b))
    ra, rb = (df.select("frame", "res_nr", "x", "y").join(m.filter("res_nr = rep").select("res_nr"), "res_nr", "left_semi") for df, m in ((a, ma), (b, mb)))
    pairs = range_join(ra, rb, shell, dims="xy")
    rows = pairs.select(F.col("a_res_nr").alias("a"), F.col("b_res_nr").alias("b"), "frame", F.lit(1).alias("one"))
    ev = majority_events(rows, r, keys=["a", "b"], label="one")
    first = checkpointed(ev.groupBy(F.col("a").alias("rep"), F.col("b").alias("_b")).agg(F.ceil(F.min("bind_i") / stride).cast("int").alias("k")))
    sizes = mb.filter("res_nr = rep").select(F.col("rep").alias("_b"), "size")
    steps = first.join(sizes, "_b").groupBy("rep", "k").agg(F.sum("size").alias("n"))
    own = ma.join(mb.select("res_nr", F.col("rep").alias("_b")), "res_nr").join(first, ["rep", "_b"]).select("res_nr", "k", F.lit(1).alias("_own"))
    marks = a.sparkSession.range((n_frames + stride - 1) // stride).select(F.col("id").cast("int").alias("k"))
    full = ma.select("res_nr", "rep").crossJoin(F.broadcast(marks)).join(steps, ["rep", "k"], "left").join(own, ["res_nr", "k"], "left")
    w = Window.partitionBy("res_nr").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    pct = full.withColumn("p", F.sum(F.coalesce("n", F.lit(0)) - F.coalesce("_own", F.lit(0))).over(w) * 100.0 / F.lit(n_b))
    return pct.groupBy((F.col("k") * stride).alias("frame")).agg(F.avg("p").alias("mean"), F.stddev_samp("p").alias("sd"))


def circular_stats(angles: DataFrame, *by: str) -> DataFrame:
    """Plain mean and sd of degrees; circular mean atan2(mean sin, mean cos), and circular sd about it (n - 1, differences folded to +-180).
    Null angles are left out."""
    angles = angles.filter(F.col("angle").isNotNull())
    rad = F.radians("angle")
    m = angles.groupBy(*by).agg(F.avg("angle").alias("mean"), F.stddev_samp("angle").alias("sd"), F.degrees(F.atan2(F.avg(F.sin(rad)), F.avg(F.cos(rad)))).alias("circular_mean"))
    j = angles.join(m, list(by)) if by else angles.crossJoin(m)
    d = F.col("angle") - F.col("circular_mean")
    folded = d - 360.0 * F.round(d / 360.0)
    s = j.groupBy(*by).agg(F.sqrt(F.sum(folded * folded) / (F.count("*") - 1)).alias("circular_sd"))
    return m.join(s, list(by)) if by else m.crossJoin(s)


def to_beta(values: DataFrame, atoms: DataFrame) -> DataFrame:
    """Per-residue value on every atom of the residue, as beta; residues without one get 0."""
    v = values.select("res_nr", F.col("value").alias("_v"))
    return atoms.drop("beta").join(v, "res_nr", "left").withColumn("beta", F.coalesce("_v", F.lit(0.0))).drop("_v")


def bound_lipid_rmsf(lipids: DataFrame, bound: DataFrame) -> DataFrame:
    """(atom_name, rmsf) of the bound lipid's atoms about their mean over frames; bound: (frame, res_nr)."""
    held = lipids.join(bound, ["frame", "res_nr"], "left_semi").select("frame", F.col("atom_name").alias("atom_nr"), "x", "y", "z")
    return rmsf(held, mean_coords(held)).withColumnRenamed("atom_nr", "atom_name")


def contacts_by_bound(protein: DataFrame, lipids: DataFrame, bound: DataFrame, cutoff: float, n_frames: int) -> DataFrame:
    """(res_nr, bound, other): contacts a frame of each protein residue with the bound lipid, and with all others."""
    own = lipids.join(F.broadcast(bound), ["frame", "res_nr"], "left_semi")  # a row a frame
    rows = count_near(protein.select("frame", "res_nr", "x", "y", "z"), lipids.select("frame", "x", "y", "z"), cutoff).withColumnRenamed("n", "_all")
    n = count_near(rows, own.select("frame", "x", "y", "z"), cutoff).groupBy("res_nr").agg(*[(F.sum(c) / F.lit(float(n_frames))).alias(c) for c in ("_all", "n")])
    return n.select("res_nr", F.col("n").alias("bound"), (F.col("_all") - F.col("n")).alias("other"))
