"""Queries of 2.1-2.3: scans, selections, molecules."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import molecule as m
from lattica.operators import select as s
from lattica.operators.transforms import scan_frames

from .fixtures import Fixture
from .registry import query, r6, stamped

DIST = "sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))"
#: SQL for a residue's atoms side by side: PO4 (p), GL1 (g), C4A (c), C4B (d), GL2 (h).
WIDE = ", w AS (SELECT frame, res_nr, res_name, leaflet, " + ", ".join(f"max(CASE WHEN atom_name = '{n}' THEN {c} END) AS {p}{c}" for p, n in (("p", "PO4"), ("g", "GL1"), ("h", "GL2"), ("c", "C4A"), ("d", "C4B")) for c in "xyz") + " FROM fx1 GROUP BY frame, res_nr, res_name, leaflet)"
CARDS = [(t, "PO4", "C4A", "PO4", "C4B") for t in ("POPE", "POPG", "DLPE")]


@query("SELECT dense_rank() OVER (ORDER BY frame) - 1 AS frame, count(*) AS n FROM fx1 WHERE frame BETWEEN 3 AND 20 AND frame % 4 = 0 GROUP BY fx1.frame")
def s3_scan_frames(fx: Fixture):
    return scan_frames(fx.atoms, 3, 20, 4).groupBy("frame").agg(F.count("*").alias("n")).withColumn("frame", F.col("frame").cast("long"))


@query("SELECT res_nr, res_name, dense_rank() OVER (ORDER BY res_nr) AS ordinal, count(*) AS n_atoms, CAST(sum(mass) AS BIGINT) AS mass FROM fx1 WHERE frame = 0 GROUP BY res_nr, res_name")
def s4_topology(fx: Fixture):
    from lattica.sources.tables import load_topology

    t = load_topology(fx.atoms.filter("frame = 0"))
    return t.groupBy("res_nr", "res_name", "ordinal").agg(F.count("*").alias("n_atoms"), F.sum("mass").cast("long").alias("mass")).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("SELECT DISTINCT lipid_nr, res_nr, res_name FROM ev")
def s8_complete_set(fx: Fixture):
    from lattica.operators.events import complete_set

    return complete_set(fx.events)


@query("SELECT frame, atom_nr FROM fx1 WHERE (res_nr BETWEEN 2 AND 40 OR res_nr BETWEEN 90 AND 99) AND res_name IN ('POPE', 'DLPE') AND leaflet = 1 AND atom_name IN ('PO4', 'C4A')")
def f1_select_atoms(fx: Fixture):
    return fx.atoms.filter(s.resi((2, 40), (90, 99)) & s.resn("POPE", "DLPE") & s.upper() & s.atom("PO4", "C4A")).select("frame", "atom_nr")


@query("SELECT frame, atom_nr FROM fx1 WHERE ((atom_name = 'PO4' OR res_name = 'POPG') AND leaflet = 2) OR res_nr = 5")
def f2_selection_algebra(fx: Fixture):
    return fx.atoms.filter(s.left_fold(s.atom("PO4"), ("or", s.resn("POPG")), ("and", s.lower()), ("or", s.resi((5, 5))))).select("frame", "atom_nr")


@query(WIDE + " SELECT res_nr, CASE WHEN CASE WHEN abs(pz-cz) > abs(pz-dz) THEN pz-cz ELSE pz-dz END > 0 THEN 1 ELSE 2 END AS leaflet FROM w WHERE frame = 0")
def f3_assign_leaflets(fx: Fixture):
    return s.assign_leaflets(fx.atoms.filter("frame = 0"), CARDS)


@query("SELECT frame, count(*) AS n_target, (SELECT count(*) FROM fx1 b WHERE b.frame = a.frame AND b.leaflet = 2) AS n_opposing FROM fx1 a WHERE leaflet = 1 GROUP BY frame")
def f4_leaflet_views(fx: Fixture):
    a = s.leaflet_view(fx.atoms, 1).groupBy("frame").agg(F.count("*").alias("n_target"))
    b = s.leaflet_view(fx.atoms, s.opposing(1)).groupBy("frame").agg(F.count("*").alias("n_opposing"))
    return a.join(b, "frame")


@query("SELECT res_nr, res_name IN ('POPE') AS is_protein FROM fx1 WHERE frame = 0 AND atom_name = 'PO4'")
def f5_protein_flag(fx: Fixture):
    return fx.heads.filter("frame = 0").select("res_nr", s.is_protein(("POPE",)).alias("is_protein"))


@query("SELECT res_nr, res_name IN ('W', 'TIP3', 'WF', 'DLPE') AS is_solvent FROM fx1 WHERE frame = 0 AND atom_name = 'PO4'")
def f6_solvent_flag(fx: Fixture):
    return fx.heads.filter("frame = 0").select("res_nr", s.is_solvent(("DLPE",)).alias("is_solvent"))


@query("SELECT leaflet, res_name, count(DISTINCT res_nr) AS n_molecules, count(*) AS n_atoms FROM fx1 WHERE frame = 0 GROUP BY leaflet, res_name")
def f7_census(fx: Fixture):
    return s.census(fx.atoms.filter("frame = 0"), "leaflet", "res_name")


@query(f", s AS ({stamped('SELECT frame, x, y FROM hd WHERE leaflet = 1')}) SELECT frame, gx, gy, count(*) AS n FROM s WHERE NOT (abs(gx - 20) <= 6 AND abs(gy - 10) <= 4) GROUP BY frame, gx, gy")
def f8_rectangle(fx: Fixture):
    """Stamped heads of every frame outside of a window of nodes."""
    from lattica.operators.lattice import Lattice, stamp_counts

    points = fx.heads.filter("leaflet = 1").select("frame", "x", "y")
    return stamp_counts(points, Lattice.of_box(0.25, 20, 20), 0.6).filter(s.rect(20, 10, 6, 4, invert=True))


@query("SELECT frame, count(*) AS n FROM fx1 a WHERE EXISTS (SELECT 1 FROM (VALUES (6e0, 6e0, 3e0, 2.3e0, 3e0), (14e0, 9e0, 2e0, 1.7e0, 5e0)) t(cx, cy, cz, radius, height) WHERE sqrt((a.x-cx)*(a.x-cx) + (a.y-cy)*(a.y-cy)) <= radius AND abs(a.z-cz) < height/2) GROUP BY frame")
def f9_shapes(fx: Fixture):
    shapes = fx.spark.createDataFrame([(6.0, 6.0, 3.0, 2.3, 3.0), (14.0, 9.0, 2.0, 1.7, 5.0)], "cx double, cy double, cz double, radius double, height double")
    return s.in_shapes(fx.atoms, shapes).groupBy("frame").agg(F.count("*").alias("n"))


@query("SELECT atom_nr, CASE WHEN leaflet = 1 AND atom_name = 'GL1' THEN 'GLX' ELSE atom_name END AS atom_name, CASE WHEN leaflet = 1 AND atom_name = 'GL1' THEN 1e0 ELSE mass END AS mass FROM fx1 WHERE frame = 0")
def f10_set_attributes(fx: Fixture):
    return s.set_attrs(fx.atoms.filter("frame = 0"), s.upper() & s.atom("GL1"), atom_name="GLX", mass=1.0).select("atom_nr", "atom_name", "mass")


@query("SELECT a.atom_nr, round(b.z, 6) + 0.0 AS beta FROM fx1 a JOIN fx1 b ON a.atom_nr = b.atom_nr WHERE a.frame = 0 AND b.frame = 7")
def f11_copy_beta(fx: Fixture):
    out = s.copy_beta(fx.atoms.filter("frame = 0"), fx.atoms.filter("frame = 7").withColumn("beta", F.col("z")))
    return out.select("atom_nr", r6("beta"))


@query(", g AS (SELECT row_number() OVER (ORDER BY gy, gx) AS k, value FROM (SELECT c.gx, c.gy, l1.value FROM cells c LEFT JOIN l1 ON c.gx = l1.gx AND c.gy = l1.gy)), r AS (SELECT res_nr, row_number() OVER (ORDER BY res_nr) AS k FROM (SELECT DISTINCT res_nr FROM fx1)) SELECT f.atom_nr, round(COALESCE(g.value, 0), 6) + 0.0 AS beta, CASE WHEN g.value IS NULL THEN 0 ELSE round(f.x, 6) + 0.0 END AS x FROM fx1 f JOIN r ON f.res_nr = r.res_nr JOIN g ON r.k = g.k WHERE f.frame = 0")
def f12_stamp_grid(fx: Fixture):
    from lattica.operators.lattice import Lattice

    lat = Lattice.of_box(0.25, 20, 20).nodes(fx.spark).join(fx.grid(1), ["gx", "gy"], "left")
    return s.stamp_grid(fx.atoms.filter("frame = 0"), lat).select("atom_nr", r6("beta"), r6("x"))


@query("SELECT DISTINCT frame, frame * 2.5e0 + 10e0 AS time FROM fx1")
def f13_retime(fx: Fixture):
    return s.retime(fx.atoms.select("frame").distinct(), 2.5, 10.0)


@query("SELECT frame, res_nr, round(avg(x), 6) + 0.0 AS x, round(avg(y), 6) + 0.0 AS y, round(avg(z), 6) + 0.0 AS z FROM fx1 WHERE atom_name IN ('GL1', 'GL2') GROUP BY frame, res_nr")
def a1_centers(fx: Fixture):
    return m.centers(fx.atoms, ("GL1", "GL2")).select("frame", "res_nr", r6("x"), r6("y"), r6("z"))


@query("SELECT frame, res_nr, round(sum(mass*x)/sum(mass), 6) + 0.0 AS x, round(sum(mass*y)/sum(mass), 6) + 0.0 AS y, round(sum(mass*z)/sum(mass), 6) + 0.0 AS z FROM fx1 GROUP BY frame, res_nr")
def a2_com(fx: Fixture):
    return m.com(fx.atoms).select("frame", "res_nr", r6("x"), r6("y"), r6("z"))


@query("SELECT leaflet, frame, count(*) AS n, round(avg(z), 6) + 0.0 AS z FROM cen GROUP BY leaflet, frame")
def a3_class_centers(fx: Fixture):
    return fx.centers.groupBy("leaflet", "frame").agg(F.count("*").alias("n"), r6(F.avg("z"), "z"))


@query(", c AS (SELECT frame, res_nr, sum(mass*x)/sum(mass) AS cx, sum(mass*y)/sum(mass) AS cy, sum(mass*z)/sum(mass) AS cz FROM fx1 GROUP BY frame, res_nr) SELECT f.frame, f.res_nr, round(sqrt(sum(mass*((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz)))/sum(mass)), 6) + 0.0 AS rg FROM fx1 f JOIN c USING (frame, res_nr) GROUP BY f.frame, f.res_nr")
def a4_gyration(fx: Fixture):
    return m.gyration(fx.atoms).select("frame", "res_nr", r6("rg"))


P2 = WIDE + """, v AS (SELECT frame, res_nr, (cz-gz)/sqrt((cx-gx)*(cx-gx)+(cy-gy)*(cy-gy)+(cz-gz)*(cz-gz)) AS c1, (dz-hz)/sqrt((dx-hx)*(dx-hx)+(dy-hy)*(dy-hy)+(dz-hz)*(dz-hz)) AS c2 FROM w),
 p2 AS (SELECT frame, res_nr, ((c1*c1*3e0-1e0)*0.5e0 + (c2*c2*3e0-1e0)*0.5e0)/2e0 AS p2, (degrees(acos(least(1e0, greatest(-1e0, c1)))) + degrees(acos(least(1e0, greatest(-1e0, c2)))))/2e0 AS theta FROM v)"""


@query(P2 + " SELECT frame, res_nr, round(p2, 6) + 0.0 AS p2, round(theta, 6) + 0.0 AS theta FROM p2")
def a5_order_parameter(fx: Fixture):
    return m.order_parameter(fx.atoms, [("GL1", "C4A"), ("GL2", "C4B")]).select("frame", "res_nr", r6("p2"), r6("theta"))


@query(WIDE + " SELECT frame, res_nr, round(gx, 6) + 0.0 AS x, round(sqrt((px-cx)*(px-cx)+(py-cy)*(py-cy)+(pz-cz)*(pz-cz)), 6) + 0.0 AS value FROM w")
def a6_pair_distance(fx: Fixture):
    return m.pair_distance(fx.atoms, "PO4", "C4A", "GL1").select("frame", "res_nr", r6("x"), r6("value"))


@query(WIDE + " SELECT frame, res_nr, round(cx-px, 6) + 0.0 AS dx, round(cy-py, 6) + 0.0 AS dy, round(cz-pz, 6) + 0.0 AS dz FROM w")
def a7_pair_vector(fx: Fixture):
    return m.pair_vector(fx.atoms, "PO4", "C4A", "GL1").select("frame", "res_nr", r6("dx"), r6("dy"), r6("dz"))


DIHEDRAL = WIDE + """, q AS (SELECT *, lag(px) OVER k AS ix, lag(py) OVER k AS iy, lag(pz) OVER k AS iz, lead(cx) OVER k AS mx, lead(cy) OVER k AS my, lead(cz) OVER k AS mz FROM w WINDOW k AS (PARTITION BY frame ORDER BY res_nr)),
 b AS (SELECT frame, res_nr, res_name, ix-gx AS ax, iy-gy AS ay, iz-gz AS az, hx-gx AS bx, hy-gy AS by_, hz-gz AS bz, hx-mx AS cx, hy-my AS cy, hz-mz AS cz FROM q WHERE ix IS NOT NULL AND mx IS NOT NULL),
 n AS (SELECT *, ay*bz-az*by_ AS n1x, az*bx-ax*bz AS n1y, ax*by_-ay*bx AS n1z, by_*cz-bz*cy AS n2x, bz*cx-bx*cz AS n2y, bx*cy-by_*cx AS n2z FROM b),
 d0 AS (SELECT frame, res_nr, res_name, CASE WHEN n1x*n1x+n1y*n1y+n1z*n1z > 1e-9 AND n2x*n2x+n2y*n2y+n2z*n2z > 1e-9 THEN degrees(acos(least(1e0, greatest(-1e0, (n1x*n2x+n1y*n2y+n1z*n2z)/(sqrt(n1x*n1x+n1y*n1y+n1z*n1z)*sqrt(n2x*n2x+n2y*n2y+n2z*n2z)))))) * CASE WHEN ax*n2x+ay*n2y+az*n2z < 0 THEN -1e0 ELSE 1e0 END END AS angle FROM n),
 d AS (SELECT frame, res_nr, res_name, CASE WHEN angle < -179.999e0 THEN angle + 360e0 ELSE angle END AS angle FROM d0)"""


def dihedrals(fx: Fixture):
    """Signed, of all residues with neighbours; -180 is written as 180, and the angle is null where atoms lie on a line."""
    d = m.dihedral(fx.atoms, "PO4", "GL1", "GL2", "C4A", previous=("i",), following=("m",))
    return d.withColumn("angle", F.when(F.col("angle") < -179.999, F.col("angle") + 360.0).otherwise(F.col("angle")))


@query(DIHEDRAL + " SELECT frame, res_nr, round(angle, 3) + 0.0 AS angle FROM d")
def a8_dihedral(fx: Fixture):
    return dihedrals(fx).select("frame", "res_nr", (F.round("angle", 3) + 0.0).alias("angle"))


TILT = ", v AS (SELECT frame, avg(CASE WHEN leaflet = 1 THEN x END) - avg(CASE WHEN leaflet = 2 THEN x END) AS vx, avg(CASE WHEN leaflet = 1 THEN y END) - avg(CASE WHEN leaflet = 2 THEN y END) AS vy, avg(CASE WHEN leaflet = 1 THEN z END) - avg(CASE WHEN leaflet = 2 THEN z END) AS vz FROM fx1 GROUP BY frame), t AS (SELECT frame, degrees(acos(least(1e0, greatest(-1e0, vz/sqrt(vx*vx+vy*vy+vz*vz))))) AS theta, vx, degrees(acos(least(1e0, greatest(-1e0, vy/sqrt(vx*vx+vy*vy))))) AS p FROM v)"


@query(TILT + " SELECT frame, round(theta, 5) + 0.0 AS theta, round(CASE WHEN vx < 0 THEN 360e0 - p ELSE p END, 4) + 0.0 AS phi FROM t")
def a9_tilt(fx: Fixture):
    return m.tilt(fx.atoms, s.upper(), s.lower()).select("frame", (F.round("theta", 5) + 0.0).alias("theta"), (F.round("phi", 4) + 0.0).alias("phi"))
