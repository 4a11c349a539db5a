"""Registers queries over the fixtures, each with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import Fixture, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(body: str | None = None):
    """The decorated function takes a Fixture and returns the result; body is the oracle's SQL, None where SQL can't express it."""

    def register(f: Callable[[Fixture], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Fixture(spark, sf_dir))
        if body is not None:
            ORACLE_SQL[f.__name__] = sql(body)
        return f

    return register


def r6(column: str | Column, name: str | None = None) -> Column:
    """Rounded to 6 digits, without a negative zero."""
    c = F.col(column) if isinstance(column, str) else column
    return (F.round(c, 6) + F.lit(0.0)).alias(name or column)


def stamped(points: str, dims: int = 2) -> str:
    """SQL of the stamp of a points query with columns x, y[, z]: 41 x 41 nodes of 0.5 with radius 0.6, or 21 x 21 x 7 of 1.0 with radius 1.1."""
    if dims == 2:
        return f"SELECT p.*, a.i AS gx, b.i AS gy FROM ({points}) p JOIN nd a ON abs(a.i*0.5e0 - p.x) <= 0.6e0 JOIN nd b ON abs(b.i*0.5e0 - p.y) <= 0.6e0 WHERE sqrt((a.i*0.5e0 - p.x)*(a.i*0.5e0 - p.x) + (b.i*0.5e0 - p.y)*(b.i*0.5e0 - p.y)) <= 0.6e0"
    return f"SELECT p.*, a.i AS gx, b.i AS gy, c.i AS gz FROM ({points}) p JOIN nd a ON a.i < 21 AND abs(a.i*1e0 - p.x) <= 1.1e0 JOIN nd b ON b.i < 21 AND abs(b.i*1e0 - p.y) <= 1.1e0 JOIN nd c ON c.i < 7 AND abs(c.i*1e0 - p.z) <= 1.1e0 WHERE sqrt((a.i*1e0 - p.x)*(a.i*1e0 - p.x) + (b.i*1e0 - p.y)*(b.i*1e0 - p.y) + (c.i*1e0 - p.z)*(c.i*1e0 - p.z)) <= 1.1e0"


def mapped_sql(points: str, values: tuple[str, ...] = ("value",), dims: int = 2) -> str:
    """SQL of the frame mean and time mean of stamped points."""
    k = "gx, gy" if dims == 2 else "gx, gy, gz"
    inner = ", ".join(f"avg({v}) AS {v}" for v in values)
    outer = ", ".join(f"round(avg({v}), 6) + 0.0 AS {v}" for v in values)
    return f", s AS ({stamped(points, dims)}), f AS (SELECT frame, {k}, {inner} FROM s GROUP BY frame, {k}) SELECT {k}, {outer}, count(*) AS rho FROM f GROUP BY {k}"


def passages_sql(states: str, key: str, levels: int = 5) -> str:
    """SQL of ordered passages through the states (key, frame, state) of each entity, one row of an entity a step, in both directions."""
    top = levels - 1
    return f""", pst AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY frame) AS k FROM ({states})), pdir AS (SELECT CAST(range AS INT) AS d FROM range(2)),
 pwalk AS (SELECT key, d, CAST(0 AS BIGINT) AS k, -1 AS lv, CAST(NULL AS INT) AS since, CAST(NULL AS INT) AS s0, CAST(NULL AS INT) AS e FROM (SELECT DISTINCT key FROM pst) CROSS JOIN pdir
 UNION ALL SELECT key, d, k, CASE WHEN now = {top} THEN -1 ELSE now END, CASE WHEN now = {top} THEN NULL ELSE since END, CASE WHEN now = {top} THEN since END, CASE WHEN now = {top} THEN frame END
 FROM (SELECT key, d, k, frame, CASE WHEN i = 0 THEN frame ELSE since END AS since, CASE WHEN i = 0 THEN 0 WHEN lv >= 0 AND i = lv + 1 THEN i WHEN lv >= 0 AND i < lv THEN i WHEN lv >= 0 AND i > lv THEN -1 ELSE lv END AS now
 FROM (SELECT w.key, w.d, p.k, p.frame, w.lv, w.since, CASE w.d WHEN 0 THEN p.state ELSE {top} - p.state END AS i FROM pwalk w JOIN pst p ON p.key = w.key AND p.k = w.k + 1)))
 SELECT key AS {key}, CASE d WHEN 0 THEN 'down' ELSE 'up' END AS direction, s0 AS start, e AS "end", CAST(e - s0 AS INT) AS duration FROM pwalk WHERE e IS NOT NULL"""


def events_sql(rows: str, last: int = 24) -> str:
    """SQL of the majority events (r = 1) of rows (k1, k2, lipid_nr, frame)."""
    p = "PARTITION BY k1, k2, lipid_nr"
    return f""", mr AS ({rows}), m1 AS (SELECT k1, k2, lipid_nr, f, sum(d) AS d FROM (SELECT k1, k2, lipid_nr, frame AS f, 1 AS d FROM mr UNION ALL SELECT k1, k2, lipid_nr, frame + 3, -1 FROM mr) GROUP BY k1, k2, lipid_nr, f),
 m2 AS (SELECT *, sum(d) OVER ({p} ORDER BY f) AS n, lead(f) OVER ({p} ORDER BY f) AS nf FROM m1), m3 AS (SELECT k1, k2, lipid_nr, greatest(f, 2) AS a, least(nf - 1, (SELECT max(frame) FROM mr)) AS b FROM m2 WHERE n >= 2 AND nf IS NOT NULL),
 m4 AS (SELECT *, CASE WHEN a = lag(b) OVER ({p} ORDER BY a) + 1 THEN 0 ELSE 1 END AS s FROM m3 WHERE a <= b), m5 AS (SELECT *, sum(s) OVER ({p} ORDER BY a) AS g FROM m4),
 me AS (SELECT k1, k2, lipid_nr, min(a) AS bind_i, max(b) AS bind_f, max(b) - min(a) + 1 AS dwell FROM m5 GROUP BY k1, k2, lipid_nr, g)"""
