"""Particle fixtures derived from the relational tables. The same SQL text runs in Spark and in the oracle."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATOMS = """
SELECT CAST(n_nationkey AS INT) AS frame, CAST(c_custkey * 5 + r_regionkey AS INT) AS atom_nr, CAST(c_custkey AS INT) AS res_nr,
 CASE c_custkey % 3 WHEN 0 THEN 'POPE' WHEN 1 THEN 'POPG' ELSE 'DLPE' END AS res_name,
 CASE r_regionkey WHEN 0 THEN 'PO4' WHEN 1 THEN 'GL1' WHEN 2 THEN 'GL2' WHEN 3 THEN 'C4A' ELSE 'C4B' END AS atom_name,
 CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END AS leaflet,
 CAST((c_custkey*37 + n_nationkey*(1 + c_custkey % 5)) % 400 + r_regionkey*3 AS DOUBLE)/CAST(21 AS DOUBLE) AS x,
 CAST((c_custkey*61 + n_nationkey*(1 + c_custkey % 7)) % 400 + r_regionkey*2 AS DOUBLE)/CAST(21 AS DOUBLE) AS y,
 CAST(CASE WHEN c_custkey % 2 = 0 THEN 84 + (c_custkey*13 + n_nationkey) % 20 - r_regionkey*6 ELSE 42 - (c_custkey*13 + n_nationkey) % 20 + r_regionkey*6 END AS DOUBLE)/CAST(21 AS DOUBLE) AS z,
 CAST(12 + r_regionkey AS DOUBLE) AS mass
FROM customer CROSS JOIN nation CROSS JOIN region"""

PROTEIN = """
SELECT CAST(n_nationkey AS INT) AS frame, CAST(s_suppkey AS INT) AS res_nr,
 CAST((s_suppkey*11 + n_nationkey) % 60 + 170 AS DOUBLE)/CAST(21 AS DOUBLE) AS x,
 CAST((s_suppkey*17 + n_nationkey) % 60 + 170 AS DOUBLE)/CAST(21 AS DOUBLE) AS y,
 CAST((s_suppkey*7) % 90 + 20 AS DOUBLE)/CAST(21 AS DOUBLE) AS z
FROM supplier CROSS JOIN nation"""

OCCUPANCY = """
SELECT CAST(n_nationkey AS INT) AS cell, CAST(c_custkey AS INT) AS frame,
 CAST(CASE WHEN (c_custkey*7 + n_nationkey*3) % 11 = 0 THEN (c_custkey*5 + n_nationkey) % 12
      WHEN (c_custkey*13 + n_nationkey) % 29 = 0 THEN -1
      ELSE (FLOOR(CAST(c_custkey AS DOUBLE)/CAST(6 + n_nationkey % 5 AS DOUBLE)) + n_nationkey) % 12 END AS INT) AS lipid_nr
FROM customer CROSS JOIN nation"""

#: The box, its lattice spacing and the stamping radius of the fixtures.
BOX, CELL, RADIUS, NODES, FRAMES = 20.0, 0.5, 0.6, 41, 25
#: Keys of a task: each is crossed with frames and atoms, 125 rows in all.
KEYS = 4096


class Fixture:
    """The fixtures over one folder of tables, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _sql(self, text: str) -> DataFrame:
        for name in ("customer", "nation", "region", "supplier"):
            self._dealt(name).createOrReplaceTempView(name)
        return self.spark.sql(text)

    def _dealt(self, name: str) -> DataFrame:
        """A table that rows are derived from by cross joins, in tasks of some KEYS keys: its file may be one row group, which is one task, whatever becomes of its rows."""
        table = self.table(name)
        tasks = -(-table.count() // KEYS) if name in ("customer", "supplier") else 1
        return table.repartition(tasks, table.columns[0]) if tasks > 1 else table

    @cached_property
    def atoms(self) -> DataFrame:
        return self._sql(ATOMS)

    @cached_property
    def protein(self) -> DataFrame:
        return self._sql(PROTEIN)

    @cached_property
    def occupancy(self) -> DataFrame:
        return self._sql(OCCUPANCY)

    @property
    def upper(self) -> DataFrame:
        return self.atoms.filter("leaflet = 1")

    @property
    def lower(self) -> DataFrame:
        return self.atoms.filter("leaflet = 2")

    @property
    def heads(self) -> DataFrame:
        return self.atoms.filter("atom_name = 'PO4'")

    @property
    def centers(self) -> DataFrame:
        from lattica.operators.molecule import centers

        return centers(self.atoms)

    def grid(self, leaflet: int) -> DataFrame:
        """Mean z of the heads of a leaflet on the lattice, with rho: (gx, gy, value, rho)."""
        from lattica.operators.lattice import Lattice, time_mean

        points = self.heads.filter(F.col("leaflet") == leaflet).select("frame", "x", "y", F.col("z").alias("value"))
        return time_mean(points, Lattice.of_box(CELL * CELL, BOX, BOX), RADIUS)

    @property
    def events(self) -> DataFrame:
        """Dwell intervals of the occupancy: cells are nodes of a 5 x 5 lattice."""
        from lattica.operators.windows import majority_events

        ev = majority_events(self.occupancy, 2, keys=["cell"])
        kind = F.when(F.col("lipid_nr") % 3 == 0, "POPE").when(F.col("lipid_nr") % 3 == 1, "POPG").otherwise("DLPE")
        return ev.select((F.col("cell") % 5).cast("int").alias("gx"), F.floor(F.col("cell") / 5).cast("int").alias("gy"), "lipid_nr", (F.col("lipid_nr") * 10 + 7).cast("int").alias("res_nr"), kind.alias("res_name"), "bind_i", "bind_f", "dwell")


#: Common table expressions of the oracle; each query uses those it needs.
CTE = f"""
fx1 AS ({ATOMS}), fx1p AS ({PROTEIN}), fx2 AS ({OCCUPANCY}),
cen AS (SELECT frame, res_nr, res_name, leaflet, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM fx1 GROUP BY frame, res_nr, res_name, leaflet),
hd AS (SELECT * FROM fx1 WHERE atom_name = 'PO4'),
nd AS (SELECT CAST(range AS INT) AS i FROM range(41)),
cells AS (SELECT a.i AS gx, b.i AS gy FROM nd a CROSS JOIN nd b),
st AS (SELECT h.frame, h.leaflet, h.res_nr, h.res_name, a.i AS gx, b.i AS gy, h.z AS v FROM hd h JOIN nd a ON abs(a.i*0.5e0 - h.x) <= 0.6e0 JOIN nd b ON abs(b.i*0.5e0 - h.y) <= 0.6e0
       WHERE sqrt((a.i*0.5e0 - h.x)*(a.i*0.5e0 - h.x) + (b.i*0.5e0 - h.y)*(b.i*0.5e0 - h.y)) <= 0.6e0),
fm AS (SELECT leaflet, frame, gx, gy, avg(v) AS v FROM st GROUP BY leaflet, frame, gx, gy),
lat AS (SELECT leaflet, gx, gy, avg(v) AS value, count(*) AS rho FROM fm GROUP BY leaflet, gx, gy),
l1 AS (SELECT gx, gy, value, rho FROM lat WHERE leaflet = 1), l2 AS (SELECT gx, gy, value, rho FROM lat WHERE leaflet = 2),
sw AS (SELECT cell, lipid_nr, f, CAST(sum(d) AS INT) AS d FROM (SELECT cell, lipid_nr, frame AS f, 1 AS d FROM fx2 WHERE lipid_nr >= 0 UNION ALL SELECT cell, lipid_nr, frame + 5 AS f, -1 AS d FROM fx2 WHERE lipid_nr >= 0) GROUP BY cell, lipid_nr, f),
sw2 AS (SELECT cell, lipid_nr, f, sum(d) OVER (PARTITION BY cell, lipid_nr ORDER BY f) AS n, lead(f) OVER (PARTITION BY cell, lipid_nr ORDER BY f) AS nf FROM sw),
sw3 AS (SELECT cell, lipid_nr, greatest(f, 4) AS a, least(nf - 1, (SELECT max(frame) FROM fx2)) AS b FROM sw2 WHERE n >= 3 AND nf IS NOT NULL),
sw4 AS (SELECT *, CASE WHEN a = lag(b) OVER (PARTITION BY cell, lipid_nr ORDER BY a) + 1 THEN 0 ELSE 1 END AS s FROM sw3 WHERE a <= b),
sw5 AS (SELECT *, sum(s) OVER (PARTITION BY cell, lipid_nr ORDER BY a) AS g FROM sw4),
ev0 AS (SELECT cell, lipid_nr, CAST(min(a) AS INT) AS bind_i, CAST(max(b) AS INT) AS bind_f, CAST(max(b) - min(a) + 1 AS INT) AS dwell FROM sw5 GROUP BY cell, lipid_nr, g),
ev AS (SELECT CAST(cell % 5 AS INT) AS gx, CAST(cell // 5 AS INT) AS gy, lipid_nr, CAST(lipid_nr*10 + 7 AS INT) AS res_nr, CASE lipid_nr % 3 WHEN 0 THEN 'POPE' WHEN 1 THEN 'POPG' ELSE 'DLPE' END AS res_name, bind_i, bind_f, dwell FROM ev0)
"""


def sql(body: str) -> str:
    """body with the common tables before it; a body may begin with tables of its own (', name AS (...) SELECT ...'), recursive ones
    among them."""
    return f"WITH RECURSIVE {CTE} {body}"
