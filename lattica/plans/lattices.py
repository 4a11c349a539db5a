"""Queries of 2.4 and 2.5: stamps, means, tessellation, observables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import lattice as la
from lattica.operators import observables as ob
from lattica.operators import select as s
from lattica.operators.lattice import Lattice
from lattica.operators.stats import free_energy
from lattica.operators.tessellate import frame_nodes, near_protein, tessellate

from .fixtures import Fixture
from .molecules import P2, WIDE
from .registry import mapped_sql, query, r6, stamped

G2, G3 = Lattice.of_box(0.25, 20.0, 20.0), Lattice.of_box(1.0, 20.0, 20.0, 6.0)
K2, K3 = ["gx", "gy"], ["gx", "gy", "gz"]
D3 = "sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))"
UP = "SELECT frame, x, y, z, z AS value FROM hd WHERE leaflet = 1"


def out(df, *values: str, dims: int = 2):
    return df.select(*(K2 if dims == 2 else K3), *[r6(v) for v in (values or ("value",))], "rho")


def points(fx: Fixture):
    return fx.heads.filter("leaflet = 1").select("frame", "x", "y", "z", F.col("z").alias("value"))


@query(", e AS (SELECT CAST(ceil(max(x)/0.5e0) AS BIGINT) + 1 AS nx, CAST(ceil(max(y)/0.5e0) AS BIGINT) + 1 AS ny FROM fx1) SELECT CAST(a.range AS INT) AS gx, CAST(b.range AS INT) AS gy FROM range((SELECT nx FROM e)) a CROSS JOIN range((SELECT ny FROM e)) b")
def l1_lattice(fx: Fixture):
    """The lattice over the extent of all atoms."""
    box = fx.atoms.agg(F.max("x"), F.max("y")).first()
    return Lattice.of_box(0.25, *box).nodes(fx.spark)


@query(f", s AS ({stamped(UP)}) SELECT frame, gx, gy, count(*) AS n FROM s GROUP BY frame, gx, gy")
def l2_disc_stamp(fx: Fixture):
    return la.stamp_counts(points(fx), G2, 0.6)


@query(f", s AS ({stamped(UP, 3)}) SELECT frame, gx, gy, gz, count(*) AS n FROM s GROUP BY frame, gx, gy, gz")
def l3_sphere_stamp(fx: Fixture):
    return la.stamp_counts(points(fx), G3, 1.1)


@query(f", s AS ({stamped('SELECT frame, res_nr, x, y, z AS value FROM hd WHERE leaflet = 1')}), m AS (SELECT gx, gy FROM cells WHERE abs(gx - 20) <= 5 AND abs(gy - 20) <= 5) SELECT frame, gx, gy, round(arg_max(value, res_nr), 6) + 0.0 AS value FROM s WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.gx = s.gx AND m.gy = s.gy) GROUP BY frame, gx, gy")
def l4_masked_paint(fx: Fixture):
    p = fx.heads.filter("leaflet = 1").select("frame", "res_nr", "x", "y", F.col("z").alias("value"))
    mask = G2.nodes(fx.spark).filter(s.rect(20, 20, 5, 5))
    kept = la.stamp_unless(p, G2, 0.6, mask).select("frame", "gx", "gy").distinct()
    return la.paint(p, G2, 0.6, "res_nr").join(kept, ["frame", *K2], "left_semi").select("frame", *K2, r6("value"))


@query(mapped_sql(UP))
def l5_time_mean(fx: Fixture):
    return out(ob.mapped(points(fx), G2, 0.6))


@query(f", s AS ({stamped(UP)}) SELECT gx, gy, round(avg(value), 6) + 0.0 AS value, count(*) AS rho FROM s GROUP BY gx, gy")
def l6_sample_mean(fx: Fixture):
    return out(la.sample_mean(points(fx), G2, 0.6))


@query(", m AS (SELECT sum(rho)/1681e0 AS m FROM l1) SELECT c.gx, c.gy, CASE WHEN COALESCE(rho, 0) > 0.9e0*m THEN round(value, 6) + 0.0 END AS value, COALESCE(rho, 0) AS rho FROM cells c CROSS JOIN m LEFT JOIN l1 ON c.gx = l1.gx AND c.gy = l1.gy")
def l7_exclude(fx: Fixture):
    return out(la.exclude(fx.grid(1), G2, 0.9))


@query("SELECT gx, gy, round(avg(v), 6) + 0.0 AS value, CASE WHEN count(*) > 1 THEN round(stddev_samp(v), 6) + 0.0 END AS sd, CASE WHEN count(*) > 1 THEN round(stddev_samp(v)/sqrt(count(*)), 6) + 0.0 END AS error, count(*) AS rho FROM fm WHERE leaflet = 1 GROUP BY gx, gy")
def l8_time_stdev(fx: Fixture):
    return out(la.time_stdev(points(fx), G2, 0.6), "value", "sd", "error")


DENSITY = f", s AS ({stamped('SELECT frame, atom_nr, x, y FROM fx1 WHERE leaflet = 1')}), k AS (SELECT frame, atom_nr, count(*) AS k FROM s GROUP BY frame, atom_nr) SELECT gx, gy, round(sum(1e0/(k*25*5)), 6) + 0.0 AS value FROM s JOIN k USING (frame, atom_nr) GROUP BY gx, gy"


@query(DENSITY)
def l9_density(fx: Fixture):
    a = fx.upper.select("frame", "atom_nr", "x", "y", F.lit(5).alias("n_atoms"))
    return la.density(a, G2, 0.6, 25).select(*K2, r6("value"))


@query(f", s AS ({stamped(UP)}) SELECT gx, gy, round(count(*)/25e0, 6) + 0.0 AS value FROM s GROUP BY gx, gy")
def l10_per_frame(fx: Fixture):
    n = la.stamp_counts(points(fx), G2, 0.6, ())
    return la.per_frame(n.withColumnRenamed("n", "value"), 25).select(*K2, r6("value"))


#: A coarse lattice, 11 x 11 nodes of 2.0; all upper heads are sites.
GT = Lattice(2.0, (11, 11))
SITES = "SELECT frame, res_nr, x, y FROM hd WHERE leaflet = 1"
TESS = f", sites AS ({SITES}), tn AS (SELECT a.i AS gx, b.i AS gy FROM nd a CROSS JOIN nd b WHERE a.i < 11 AND b.i < 11), tc AS (SELECT frame, gx, gy, res_nr, row_number() OVER (PARTITION BY frame, gx, gy ORDER BY sqrt((gx*2e0-x)*(gx*2e0-x)+(gy*2e0-y)*(gy*2e0-y)), res_nr) AS k FROM sites CROSS JOIN tn), t AS (SELECT frame, gx, gy, res_nr FROM tc WHERE k = 1)"


def sites(fx: Fixture):
    return fx.heads.filter("leaflet = 1").select("frame", "res_nr", "x", "y", "z")


@query(TESS + " SELECT frame, gx, gy, res_nr FROM t")
def l11_tessellate(fx: Fixture):
    return tessellate(sites(fx), GT, 0.7)


@query(", b AS (SELECT DISTINCT frame, 18e0 + frame % 5 AS bx, 19e0 + frame % 3 AS by_ FROM fx1) SELECT frame, a.i AS gx, c.i AS gy FROM b JOIN nd a ON a.i < ceil(bx/2e0) JOIN nd c ON c.i < ceil(by_/2e0)")
def l12_frame_nodes(fx: Fixture):
    frames = fx.atoms.select("frame").distinct().select("frame", (F.lit(18.0) + F.col("frame") % 5).alias("bx"), (F.lit(19.0) + F.col("frame") % 3).alias("by"))
    return frame_nodes(frames, 4.0)


@query("SELECT DISTINCT a.frame, a.res_nr FROM fx1p a JOIN hd b ON a.frame = b.frame WHERE abs(a.z-b.z) < 0.45e0 AND " + D3 + " < 0.9e0")
def l13_near_protein(fx: Fixture):
    return near_protein(fx.protein, fx.heads.select("frame", "x", "y", "z"), 0.9).select("frame", "res_nr")


THICK = f""", pr AS (SELECT a.frame, a.res_nr, a.x, a.y, abs(a.z-b.z) AS d, row_number() OVER (PARTITION BY a.frame, a.res_nr ORDER BY sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)), b.res_nr) AS k FROM hd a JOIN hd b ON a.frame = b.frame AND a.leaflet = 1 AND b.leaflet = 2 AND abs(a.x-b.x) < 0.7e0 WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) < 0.7e0),
 tp AS (SELECT h.frame, h.x, h.y, p.d AS value, CASE WHEN p.d IS NULL THEN 0e0 ELSE 1e0 END AS paired FROM hd h LEFT JOIN pr p ON p.frame = h.frame AND p.res_nr = h.res_nr AND p.k = 1 WHERE h.leaflet = 1)"""


@query(THICK + f", s AS ({stamped('SELECT * FROM tp')}), f AS (SELECT frame, gx, gy, avg(value) AS value, avg(paired) AS paired FROM s GROUP BY frame, gx, gy) SELECT gx, gy, round(avg(value), 6) + 0.0 AS value, round(avg(paired), 6) + 0.0 AS paired, count(value) AS rho FROM f GROUP BY gx, gy")
def g1_thickness(fx: Fixture):
    cols = ["frame", "res_nr", "x", "y", "z"]
    up, low = (fx.heads.filter(F.col("leaflet") == k).select(cols) for k in (1, 2))
    return out(ob.thickness(up, low, 0.7, up, G2, 0.6), "value", "paired")


@query(", h AS (SELECT CAST(floor(z/0.3e0) AS INT) AS bin, count(*) AS c FROM hd WHERE leaflet = 1 GROUP BY 1), n AS (SELECT sum(c) AS n, max(c) AS m FROM h), b AS (SELECT i AS bin FROM nd WHERE i < ceil((SELECT max(z) FROM hd WHERE leaflet = 1)/0.3e0)) SELECT b.bin, COALESCE(c, 0) AS count, round(-0.0083144621e0*310e0*ln(c/CAST(n AS DOUBLE)), 6) + 0.0 AS f, round(-0.0083144621e0*310e0*ln((c/CAST(n AS DOUBLE))/(m/CAST(n AS DOUBLE))), 6) + 0.0 AS f_shifted FROM b CROSS JOIN n LEFT JOIN h ON b.bin = h.bin")
def g2_free_energy(fx: Fixture):
    return free_energy(fx.heads.filter("leaflet = 1"), "z", 0.3, 310.0).select("bin", "count", r6("f"), r6("f_shifted"))


AREA = TESS + ", ar AS (SELECT t.frame, t.res_nr, count(*)*4e0 AS value FROM t GROUP BY t.frame, t.res_nr)"


@query(AREA + mapped_sql("SELECT h.frame, h.x, h.y, ar.value FROM hd h JOIN ar ON h.frame = ar.frame AND h.res_nr = ar.res_nr"))
def g3_area_per_lipid(fx: Fixture):
    return out(ob.mapped(sites(fx).join(ob.lipid_areas(sites(fx), GT, 0.7, None), ["frame", "res_nr"]), G2, 0.6))


@query(AREA + mapped_sql("SELECT h.frame, h.x, h.y, h.z, ar.value FROM hd h JOIN ar ON h.frame = ar.frame AND h.res_nr = ar.res_nr", dims=3))
def g4_area_per_lipid_3d(fx: Fixture):
    return out(ob.mapped(sites(fx).join(ob.lipid_areas(sites(fx), GT, 0.7, None), ["frame", "res_nr"]), G3, 1.1), dims=3)


@query(mapped_sql("SELECT a.frame, b.x, b.y, a.z AS value FROM fx1 a JOIN fx1 b ON a.frame = b.frame AND a.res_nr = b.res_nr WHERE a.atom_name = 'C4A' AND b.atom_name = 'GL1' AND a.leaflet = 1"))
def g5_zcoord(fx: Fixture):
    return out(ob.zcoord_lattice(fx.upper, "C4A", "GL1", G2, 0.6))


PTS_P2 = "SELECT p2.frame, a.x, a.y, a.z, p2.p2, p2.theta FROM p2 JOIN fx1 a ON a.frame = p2.frame AND a.res_nr = p2.res_nr WHERE a.atom_name IN ('GL1', 'GL2') AND a.leaflet = 1"


@query(P2 + mapped_sql(PTS_P2, ("p2", "theta")))
def g6_order_parameter(fx: Fixture):
    return out(ob.p2_lattice(fx.upper, [("GL1", "C4A"), ("GL2", "C4B")], ("GL1", "GL2"), G2, 0.6), "p2", "theta")


@query(P2 + mapped_sql(PTS_P2, ("p2", "theta"), 3))
def g7_order_parameter_3d(fx: Fixture):
    return out(ob.p2_lattice(fx.upper, [("GL1", "C4A"), ("GL2", "C4B")], ("GL1", "GL2"), G3, 1.1), "p2", "theta", dims=3)


def orient_sql(dims: int) -> str:
    k = "gx, gy" if dims == 2 else "gx, gy, gz"
    pts = "SELECT frame, gx AS x, gy AS y, gz AS z, cx-px AS dx, cy-py AS dy, cz-pz AS dz FROM w WHERE leaflet = 1"
    return WIDE + f""", s AS ({stamped(pts, dims)}), f AS (SELECT frame, {k}, avg(dx) AS dx, avg(dy) AS dy, avg(dz) AS dz FROM s GROUP BY frame, {k}),
 o AS (SELECT {k}, avg(dx) AS dx, avg(dy) AS dy, avg(dz) AS dz, count(*) AS rho FROM f GROUP BY {k}), q AS (SELECT *, sqrt(dx*dx+dy*dy+dz*dz) AS len, degrees(acos(least(1e0, greatest(-1e0, dy/sqrt(dx*dx+dy*dy))))) AS p FROM o)
 SELECT {k}, rho, round(degrees(acos(least(1e0, greatest(-1e0, dz/len)))), 5) + 0.0 AS theta, round(CASE WHEN dx < 0 THEN 360e0 - p ELSE p END, 5) + 0.0 AS phi, round((dz/len*(dz/len)*3e0 - 1e0)*0.5e0, 6) + 0.0 AS p2, round(len, 6) + 0.0 AS length FROM q"""


def orient(fx: Fixture, grid: Lattice, radius: float, keys):
    g = ob.orientation_lattice(fx.upper, "PO4", "C4A", "GL1", grid, radius)
    return g.select(*keys, "rho", (F.round("theta", 5) + 0.0).alias("theta"), (F.round("phi", 5) + 0.0).alias("phi"), r6("p2"), r6("length"))


@query(orient_sql(2))
def g8_orientation(fx: Fixture):
    return orient(fx, G2, 0.6, K2)


@query(orient_sql(3))
def g9_orientation_3d(fx: Fixture):
    return orient(fx, G3, 1.1, K3)


PTS_D = "SELECT frame, gx AS x, gy AS y, gz AS z, sqrt((px-cx)*(px-cx)+(py-cy)*(py-cy)+(pz-cz)*(pz-cz)) AS value FROM w WHERE leaflet = 1"


@query(WIDE + mapped_sql(PTS_D))
def g10_pair_distance(fx: Fixture):
    return out(ob.distance_lattice(fx.upper, "PO4", "C4A", "GL1", G2, 0.6))


@query(WIDE + mapped_sql(PTS_D, dims=3))
def g11_pair_distance_3d(fx: Fixture):
    return out(ob.distance_lattice(fx.upper, "PO4", "C4A", "GL1", G3, 1.1), dims=3)


@query(", c AS (SELECT frame, res_nr, sum(mass*x)/sum(mass) AS cx, sum(mass*y)/sum(mass) AS cy, sum(mass*z)/sum(mass) AS cz FROM fx1 WHERE leaflet = 1 GROUP BY frame, res_nr), rg AS (SELECT f.frame, f.res_nr, sqrt(sum(mass*((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz)))/sum(mass)) AS value FROM fx1 f JOIN c USING (frame, res_nr) GROUP BY f.frame, f.res_nr)" + mapped_sql("SELECT a.frame, a.x, a.y, rg.value FROM rg JOIN fx1 a ON a.frame = rg.frame AND a.res_nr = rg.res_nr WHERE a.atom_name IN ('GL1', 'GL2')"))
def g12_gyration(fx: Fixture):
    return out(ob.gyration_lattice(fx.upper, ("GL1", "GL2"), G2, 0.6))


NB = ", nb AS (SELECT a.frame, a.res_nr, CAST(count(b.res_nr) AS DOUBLE) AS value FROM cen a LEFT JOIN cen b ON a.frame = b.frame AND b.leaflet = 1 AND b.res_name = 'POPG' AND a.res_nr <> b.res_nr AND abs(a.x-b.x) < 0.9e0 AND abs(a.y-b.y) < 0.9e0 AND " + D3 + " < 0.9e0 WHERE a.leaflet = 1 GROUP BY a.frame, a.res_nr)"
PTS_NB = "SELECT h.frame, h.x, h.y, h.z, nb.value FROM nb JOIN hd h ON h.frame = nb.frame AND h.res_nr = nb.res_nr"


def neighbors(fx: Fixture, grid: Lattice, radius: float):
    c = fx.centers.filter("leaflet = 1")
    return ob.neighbors_lattice(c, c.filter("res_name = 'POPG'"), 0.9, fx.upper, ("PO4",), grid, radius)


@query(NB + mapped_sql(PTS_NB))
def g13_neighbors(fx: Fixture):
    return out(neighbors(fx, G2, 0.6))


@query(NB + mapped_sql(PTS_NB, dims=3))
def g14_neighbors_3d(fx: Fixture):
    return out(neighbors(fx, G3, 1.1), dims=3)


CT = ", pc AS (SELECT a.frame, a.res_nr, b.res_nr AS other, count(*) AS n FROM fx1 a JOIN fx1p b ON a.frame = b.frame AND a.res_nr <> b.res_nr AND abs(a.x-b.x) < 0.9e0 AND abs(a.y-b.y) < 0.9e0 WHERE " + D3 + " < 0.9e0 GROUP BY a.frame, a.res_nr, b.res_nr), ct AS (SELECT c.frame, c.res_nr, CAST(COALESCE(sum(n), 0) AS DOUBLE) AS value, CAST(count(n) AS DOUBLE) AS molecules FROM cen c LEFT JOIN pc ON c.frame = pc.frame AND c.res_nr = pc.res_nr GROUP BY c.frame, c.res_nr)"
PTS_CT = "SELECT h.frame, h.x, h.y, h.z, ct.value, ct.molecules FROM ct JOIN hd h ON h.frame = ct.frame AND h.res_nr = ct.res_nr"


@query(CT + mapped_sql(PTS_CT, ("value", "molecules")))
def g15_contacts(fx: Fixture):
    return out(ob.contacts_lattice(fx.atoms, fx.protein, 0.9, None, ("PO4",), G2, 0.6), "value", "molecules")


@query(CT + mapped_sql(PTS_CT, ("value", "molecules"), 3))
def g16_contacts_3d(fx: Fixture):
    return out(ob.contacts_lattice(fx.atoms, fx.protein, 0.9, None, ("PO4",), G3, 1.1), "value", "molecules", dims=3)


IL = ", pc AS (SELECT a.frame, a.res_nr, count(*) AS n FROM fx1 a JOIN fx1 b ON a.frame = b.frame AND a.leaflet = 1 AND b.leaflet = 2 AND a.atom_name = 'C4B' AND b.atom_name = 'C4B' AND abs(a.x-b.x) < 0.9e0 AND abs(a.y-b.y) < 0.9e0 WHERE " + D3 + " < 0.9e0 GROUP BY a.frame, a.res_nr), il AS (SELECT c.frame, c.res_nr, CAST(COALESCE(n, 0) AS DOUBLE) AS value FROM cen c LEFT JOIN pc ON c.frame = pc.frame AND c.res_nr = pc.res_nr WHERE c.leaflet = 1)"
PTS_IL = "SELECT h.frame, h.x, h.y, h.z, il.value FROM il JOIN fx1 h ON h.frame = il.frame AND h.res_nr = il.res_nr AND h.atom_name = 'C4B'"


def tails(fx: Fixture, leaflet: int):
    return fx.atoms.filter((F.col("leaflet") == leaflet) & (F.col("atom_name") == "C4B"))


@query(IL + mapped_sql(PTS_IL))
def g17_interleaflet(fx: Fixture):
    return out(ob.mapped(ob.at_atoms(ob.contact_counts(tails(fx, 1), tails(fx, 2), 0.9), tails(fx, 1), ("C4B",), ("value",)), G2, 0.6))


@query(IL + " SELECT il.frame, round(avg(value), 6) + 0.0 AS value FROM il JOIN hd h ON h.frame = il.frame AND h.res_nr = il.res_nr WHERE h.x BETWEEN 0.15e0*20e0 AND 0.85e0*20e0 AND h.y BETWEEN 0.15e0*20e0 AND 0.85e0*20e0 GROUP BY il.frame")
def g17_interleaflet_series(fx: Fixture):
    return ob.interleaflet_series(tails(fx, 1), tails(fx, 2), 0.9, fx.heads.filter("leaflet = 1"), (20.0, 20.0)).select("frame", r6("value"))


@query(IL + mapped_sql(PTS_IL, dims=3))
def g18_interleaflet_3d(fx: Fixture):
    return out(ob.mapped(ob.at_atoms(ob.contact_counts(tails(fx, 1), tails(fx, 2), 0.9), tails(fx, 1), ("C4B",), ("value",)), G3, 1.1), dims=3)


@query(", rk AS (SELECT a.frame, a.atom_nr, avg(CASE b.atom_name WHEN 'C4A' THEN 4e0 WHEN 'C4B' THEN 5e0 ELSE 2e0 END) AS m FROM fx1 a JOIN fx1 b ON a.frame = b.frame AND a.leaflet = 1 AND b.leaflet = 2 AND a.atom_name = 'C4A' AND b.atom_name IN ('C4A', 'C4B', 'GL2') AND b.res_name = 'POPE' AND abs(a.x-b.x) < 0.9e0 AND abs(a.y-b.y) < 0.9e0 WHERE " + D3 + " < 0.9e0 GROUP BY a.frame, a.atom_nr)" + mapped_sql("SELECT a.frame, a.x, a.y, COALESCE(rk.m, 0) AS value FROM fx1 a LEFT JOIN rk ON a.frame = rk.frame AND a.atom_nr = rk.atom_nr WHERE a.leaflet = 1 AND a.atom_name = 'C4A'"))
def g19_interdigitation(fx: Fixture):
    ranks = fx.spark.createDataFrame([("POPE", "C4A", 4.0), ("POPE", "C4B", 5.0), ("POPE", "GL2", 2.0), ("POPE", "PO4", 0.0)], "res_name string, atom_name string, rank double")
    return out(ob.mapped(ob.interdigitation(fx.upper.filter("atom_name = 'C4A'"), fx.lower, 0.9, ranks), G2, 0.6))


@query(", la AS (SELECT frame, res_nr, x, y, z, CASE WHEN res_name = 'POPG' THEN -1 ELSE 1 END AS q FROM hd), pa AS (SELECT frame, res_nr, x, y, z, CASE WHEN res_nr % 2 = 0 THEN 1 ELSE -1 END AS q FROM fx1p), sb AS (SELECT a.frame, a.res_nr, a.x, a.y, CAST(count(b.res_nr) AS DOUBLE) AS value FROM la a LEFT JOIN pa b ON a.frame = b.frame AND a.q = -b.q AND " + D3 + " < 0.9e0 GROUP BY a.frame, a.res_nr, a.x, a.y)" + mapped_sql("SELECT * FROM sb"))
def g20_salt_bridges(fx: Fixture):
    lip = fx.heads.select("frame", "res_nr", "x", "y", "z", F.when(F.col("res_name") == "POPG", -1).otherwise(1).alias("charge"))
    pro = fx.protein.select("frame", "res_nr", "x", "y", "z", F.when(F.col("res_nr") % 2 == 0, 1).otherwise(-1).alias("charge"))
    return out(ob.mapped(ob.salt_bridges(lip, pro, 0.9).join(lip.select("frame", "res_nr", "x", "y"), ["frame", "res_nr"]), G2, 0.6))


def enrich_sql(dims: int) -> str:
    k = "gx, gy" if dims == 2 else "gx, gy, gz"
    pts = "SELECT frame, x, y, z, CASE WHEN res_name = 'POPE' THEN 1 ELSE 0 END AS a, CASE WHEN res_name = 'POPG' THEN 1 ELSE 0 END AS b FROM hd WHERE leaflet = 1"
    return f", s AS ({stamped(pts, dims)}), f AS (SELECT frame, {k}, max(a_) AS a, max(b_) AS b FROM (SELECT frame, {k}, a AS a_, b AS b_ FROM s) GROUP BY frame, {k}), g AS (SELECT {k}, sum(a) AS a, sum(b) AS b, count(*) AS rho FROM f GROUP BY {k}) SELECT {k}, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CASE WHEN b > 0 THEN round((a/CAST(b AS DOUBLE) - 0.9e0)/0.9e0*100e0, 6) + 0.0 END AS value, rho FROM g"


def enrich(fx: Fixture, grid: Lattice, radius: float, keys):
    g = ob.enrichment_lattice(fx.heads.filter("leaflet = 1").select("frame", "res_name", "x", "y", "z"), s.resn("POPE"), s.resn("POPG"), 0.9, grid, radius)
    return g.select(*keys, "a", "b", r6("value"), "rho")


@query(enrich_sql(2))
def g22_enrichment(fx: Fixture):
    return enrich(fx, G2, 0.6, K2)


@query(enrich_sql(3))
def g23_enrichment_3d(fx: Fixture):
    return enrich(fx, G3, 1.1, K3)


@query(DENSITY)
def g24_lipid_density(fx: Fixture):
    return ob.density_lattice(fx.upper, G2, 0.6, 25).select(*K2, r6("value"))


@query(f", nr AS (SELECT * FROM hd a WHERE EXISTS (SELECT 1 FROM fx1p b WHERE a.frame = b.frame AND {D3} < 1.3e0)), s AS ({stamped('SELECT * FROM nr', 3)}) SELECT gx, gy, gz, round(count(*)/25e0, 6) + 0.0 AS value FROM s GROUP BY gx, gy, gz")
def g25_lipid_density_3d(fx: Fixture):
    return ob.density3(fx.heads, G3, 1.1, 25, fx.protein, 1.3).select(*K3, r6("value"))


@query(f", nr AS (SELECT * FROM fx1 a WHERE sqrt((x-10e0)*(x-10e0)+(y-10e0)*(y-10e0)) <= 4.3e0 AND abs(z-3e0) < 2e0 AND EXISTS (SELECT 1 FROM fx1p b WHERE a.frame = b.frame AND {D3} < 1.3e0)), s AS ({stamped('SELECT * FROM nr', 3)}) SELECT gx, gy, gz, round(count(*)/25e0, 6) + 0.0 AS value FROM s GROUP BY gx, gy, gz")
def g26_atomic_density_3d(fx: Fixture):
    shapes = fx.spark.createDataFrame([(10.0, 10.0, 3.0, 4.3, 4.0)], "cx double, cy double, cz double, radius double, height double")
    return ob.density3(s.in_shapes(fx.atoms, shapes), G3, 1.1, 25, fx.protein, 1.3).select(*K3, r6("value"))


def coords_sql(dims: int) -> str:
    k = "gx, gy" if dims == 2 else "gx, gy, gz"
    j = "s.gx, s.gy" if dims == 2 else "s.gx, s.gy, s.gz"
    return f", s AS ({stamped('SELECT frame, res_nr, x, y, z FROM hd WHERE leaflet = 1', dims)}), f AS (SELECT s.frame, a.atom_name, {j}, avg(a.x) AS x, avg(a.y) AS y, avg(a.z) AS z FROM s JOIN fx1 a ON a.frame = s.frame AND a.res_nr = s.res_nr GROUP BY s.frame, a.atom_name, {j}) SELECT atom_name, {k}, round(avg(x), 6) + 0.0 AS x, round(avg(y), 6) + 0.0 AS y, round(avg(z), 6) + 0.0 AS z, count(*) AS rho FROM f GROUP BY atom_name, {k}"


@query(coords_sql(2))
def g27_mean_lipid_coords(fx: Fixture):
    return ob.mean_lipid_coords(fx.upper, "PO4", G2, 0.6).select("atom_name", *K2, r6("x"), r6("y"), r6("z"), "rho")


SPREAD = f", s AS ({stamped('SELECT frame, res_nr, x, y FROM hd WHERE leaflet = 1')}), r AS (SELECT s.frame, s.res_nr, gx, gy, a.atom_name, a.x, a.y, a.z FROM s JOIN fx1 a ON a.frame = s.frame AND a.res_nr = s.res_nr), f AS (SELECT frame, gx, gy, atom_name, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM r GROUP BY frame, gx, gy, atom_name), m AS (SELECT gx, gy, atom_name, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM f GROUP BY gx, gy, atom_name), d AS (SELECT r.frame, r.res_nr, r.gx, r.gy, r.x - m.x AS dx, r.y - m.y AS dy, r.z - m.z AS dz FROM r JOIN m ON m.gx = r.gx AND m.gy = r.gy AND m.atom_name = r.atom_name), p AS (SELECT gx, gy, avg(sqrt(dx*dx + dy*dy + dz*dz)) AS dist, avg(dx*dx + dy*dy + dz*dz) AS d2, avg(dx) AS sx, avg(dy) AS sy, avg(dz) AS sz FROM d GROUP BY frame, res_nr, gx, gy)"


@query(SPREAD + " SELECT gx, gy, round(avg(dist), 6) + 0.0 AS dist, round(avg(sqrt(greatest(0e0, d2 - sx*sx - sy*sy - sz*sz))), 6) + 0.0 AS rmsd, count(*) AS n FROM p GROUP BY gx, gy")
def g27_lipid_spread(fx: Fixture):
    return ob.lipid_spread(fx.upper, "PO4", G2, 0.6).select(*K2, r6("dist"), r6("rmsd"), "n")


@query(coords_sql(3))
def g28_mean_lipid_coords_3d(fx: Fixture):
    return ob.mean_lipid_coords(fx.upper, "PO4", G3, 1.1).select("atom_name", *K3, r6("x"), r6("y"), r6("z"), "rho")


@query(f", s AS ({stamped('SELECT frame, res_nr, x, y FROM cen WHERE leaflet = 1')}) SELECT res_nr, gx, gy, count(*) AS visits FROM s GROUP BY res_nr, gx, gy")
def g29_lipid_tracks(fx: Fixture):
    return ob.lipid_tracks(fx.upper, G2, 0.6)
