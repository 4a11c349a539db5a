"""Queries of 2.8-2.11: windows, events, lattice algebra, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import events as e
from lattica.operators import gridops as g
from lattica.operators import select as s
from lattica.operators import stats as h
from lattica.operators import windows as w
from lattica.operators.lattice import Lattice, frame_mean, stamp_counts

from .fixtures import Fixture
from .lattices import G2, GT, K2, TESS, points, sites
from .molecules import TILT
from .registry import events_sql, passages_sql, query, r6

EV = "gx, gy, lipid_nr, res_nr, res_name, bind_i, bind_f, dwell"
EVC = EV.split(", ")


def last_frame(fx: Fixture) -> int:
    """The last frame of the occupancy: one number, read from the table."""
    return fx.table("customer").agg(F.max("c_custkey")).first()[0]


@query("SELECT cell, lipid_nr, bind_i, bind_f, dwell FROM ev0")
def w1_majority_events(fx: Fixture):
    return w.majority_events(fx.occupancy, 2)


LAST = "(SELECT max(frame) FROM fx2)"
#: Events of a timeline (k1, k2, frame): runs, clipped at the last frame.
def islands_sql(tl: str, name: str = "isl", last: str = LAST) -> str:
    return f""", {name}0 AS (SELECT k1, k2, frame, frame - row_number() OVER (PARTITION BY k1, k2 ORDER BY frame) AS g FROM (SELECT DISTINCT k1, k2, frame FROM ({tl}))), {name}1 AS (SELECT k1, k2, min(frame) AS bind_i, CASE WHEN max(frame) = {last} THEN max(frame) - 1 ELSE max(frame) END AS bind_f FROM {name}0 GROUP BY k1, k2, g),
 {name} AS (SELECT k1, k2, CAST(bind_i AS INT) AS bind_i, CAST(bind_f AS INT) AS bind_f, CAST(bind_f - bind_i + 1 AS INT) AS dwell FROM {name}1 WHERE bind_i <= bind_f)"""


@query(islands_sql("SELECT cell AS k1, lipid_nr AS k2, frame FROM fx2 WHERE lipid_nr >= 0") + " SELECT k1 AS cell, k2 AS lipid_nr, bind_i, bind_f, dwell FROM isl")
def w2_islands(fx: Fixture):
    return w.islands(fx.occupancy.filter("lipid_nr >= 0"), ["cell", "lipid_nr"], last_frame(fx))


COUNTS = ", tc AS (SELECT frame, lipid_nr, count(*) AS n FROM fx2 WHERE lipid_nr >= 0 GROUP BY frame, lipid_nr), fr AS (SELECT DISTINCT frame FROM fx2), li AS (SELECT DISTINCT lipid_nr FROM fx2 WHERE lipid_nr >= 0), dn AS (SELECT fr.frame, li.lipid_nr, COALESCE(n, 0) AS n FROM fr CROSS JOIN li LEFT JOIN tc ON tc.frame = fr.frame AND tc.lipid_nr = li.lipid_nr)"


def dense(fx: Fixture):
    occ = fx.occupancy
    n = occ.filter("lipid_nr >= 0").groupBy("frame", "lipid_nr").agg(F.count("*").alias("n"))
    full = occ.select("frame").distinct().crossJoin(F.broadcast(occ.filter("lipid_nr >= 0").select("lipid_nr").distinct()))
    return full.join(n, ["frame", "lipid_nr"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query(COUNTS + " SELECT frame, lipid_nr, CASE WHEN count(*) OVER k = 5 AND 2*sum(CASE WHEN n >= 2 THEN 1 ELSE 0 END) OVER k > 5 THEN 1 ELSE 0 END AS occupied FROM dn WINDOW k AS (PARTITION BY lipid_nr ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def w3_window_vote(fx: Fixture):
    return w.window_vote(dense(fx), ["lipid_nr"], 2, 2).select("frame", "lipid_nr", "occupied")


@query(passages_sql("SELECT cell AS key, frame, CAST(CASE WHEN lipid_nr >= 0 THEN lipid_nr % 5 ELSE 2 END AS INT) AS state FROM fx2", "cell"))
def w4_state_fold(fx: Fixture):
    states = fx.occupancy.withColumn("state", F.when(F.col("lipid_nr") >= 0, F.col("lipid_nr") % 5).otherwise(2).cast("int"))
    return w.state_fold(states, "cell", "state")


@query(COUNTS + ", v AS (SELECT frame, lipid_nr, n/5e0 AS r FROM dn), dc AS (SELECT *, CASE WHEN r >= 0.7e0 THEN 1 WHEN r <= 0.3e0 THEN 0 END AS d FROM v) SELECT frame, lipid_nr, COALESCE(last_value(d IGNORE NULLS) OVER (PARTITION BY lipid_nr ORDER BY frame ROWS UNBOUNDED PRECEDING), 0) AS \"on\" FROM dc")
def w5_hysteresis(fx: Fixture):
    return w.hysteresis(dense(fx).withColumn("ratio", F.col("n") / 5.0), ["lipid_nr"], "ratio", 0.7, 0.3).select("frame", "lipid_nr", "on")


@query(", l AS (SELECT *, z - lag(z) OVER (PARTITION BY atom_nr ORDER BY frame) AS dz FROM hd) SELECT frame, atom_nr, round(CASE WHEN res_name <> 'DLPE' THEN z + 1.5e0*sum(CASE WHEN dz > 0.5e0*1.5e0 THEN -1 WHEN dz < -0.5e0*1.5e0 THEN 1 ELSE 0 END) OVER (PARTITION BY atom_nr ORDER BY frame) ELSE z END, 6) + 0.0 AS z FROM l")
def w6_unwrap_z(fx: Fixture):
    from lattica.operators.transforms import unwrap_z

    return unwrap_z(fx.heads, 1.5, F.col("res_name") != "DLPE").select("frame", "atom_nr", r6("z"))


@query("SELECT frame, res_nr, CASE WHEN count(*) OVER k = 5 THEN round(avg(z) OVER k, 6) + 0.0 END AS z_avg FROM hd WINDOW k AS (PARTITION BY res_nr ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def w7_running_average(fx: Fixture):
    return w.running_average(fx.heads, "z", 2, "frame", ("res_nr",)).select("frame", "res_nr", r6("z_avg"))


@query(", sh AS (SELECT cell, frame, 1 + (lipid_nr + 1) % 6 AS shell FROM fx2), c AS (SELECT cell, frame, " + ", ".join(f"sum(CASE WHEN shell = {k} THEN 1 ELSE 0 END) OVER k AS c{k}" for k in range(1, 7)) + " FROM sh WINDOW k AS (PARTITION BY cell ORDER BY frame ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) SELECT cell, frame, CASE greatest(c1, c2, c3, c4, c5, c6) " + " ".join(f"WHEN c{k} THEN {k}" for k in range(1, 7)) + " END AS voted FROM c")
def w8_shell_vote(fx: Fixture):
    return w.shell_vote(fx.occupancy.withColumn("shell", F.lit(1) + (F.col("lipid_nr") + 1) % 6), ["cell"], 7).select("cell", "frame", "voted")


@query(", l AS (SELECT *, abs(z - lag(z) OVER (PARTITION BY atom_nr ORDER BY frame)) AS dz FROM fx1) SELECT frame, res_nr, max(CASE WHEN dz > 0.6e0/2 THEN 1 ELSE 0 END) AS jumped FROM l GROUP BY frame, res_nr")
def w9_jump_flags(fx: Fixture):
    return w.jump_flags(fx.atoms, 0.6)


@query(TESS + events_sql("SELECT gx AS k1, gy AS k2, res_nr AS lipid_nr, frame FROM t") + " SELECT k1 AS gx, k2 AS gy, lipid_nr AS res_nr, CAST(bind_i AS INT) AS bind_i, CAST(bind_f AS INT) AS bind_f, CAST(dwell AS INT) AS dwell FROM me")
def k1_residence_2d(fx: Fixture):
    return e.kinetics2d(sites(fx), GT, 0.7, 1)


#: Merged events (gap frames), of ev: contained ones dropped, starts in (end, end + gap] joined.
def mend_sql(gap: int, src: str = "ev", name: str = "md", keys: str = "gx, gy") -> str:
    p = f"PARTITION BY {keys}, lipid_nr ORDER BY bind_i, bind_f DESC"
    return f""", {name}0 AS (SELECT * FROM (SELECT *, max(bind_f) OVER ({p} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx FROM {src}) WHERE mx IS NULL OR bind_f > mx), {name}1 AS (SELECT *, CASE WHEN bind_i > lag(bind_f) OVER ({p}) AND bind_i <= lag(bind_f) OVER ({p}) + {gap} THEN 0 ELSE 1 END AS s FROM {name}0), {name}2 AS (SELECT *, sum(s) OVER ({p} ROWS UNBOUNDED PRECEDING) AS g FROM {name}1),
 {name} AS (SELECT {keys}, lipid_nr, res_nr, res_name, min(bind_i) AS bind_i, max(bind_f) AS bind_f, CAST(max(bind_f) + 1 - min(bind_i) AS INT) AS dwell FROM {name}2 GROUP BY {keys}, lipid_nr, res_nr, res_name, g)"""


@query(mend_sql(9) + f" SELECT {EV} FROM md")
def k2_mend_events(fx: Fixture):
    return e.mend_events(fx.events, 9).select(EVC)


TL = ", tl AS (SELECT DISTINCT gx, gy, lipid_nr, res_nr, res_name, f.frame FROM ev JOIN (SELECT DISTINCT frame FROM fx2) f ON f.frame BETWEEN bind_i AND bind_f), sk AS (SELECT frame, lipid_nr, res_nr, res_name, CAST(count(*) AS INT) AS n FROM tl GROUP BY frame, lipid_nr, res_nr, res_name)"


@query(mend_sql(4) + f" SELECT {EV} FROM md")
def k3_fill_gaps(fx: Fixture):
    return e.fill_gaps(fx.events, 4).select(EVC)


@query(f"SELECT {EV} FROM ev WHERE dwell*2.5e0 >= 12.5e0")
def k4_screen(fx: Fixture):
    return e.screen(fx.events, 2.5, 12.5)


@query(f"SELECT gx, gy, lipid_nr, res_nr, res_name, greatest(bind_i, 30) AS bind_i, least(bind_f, 90) AS bind_f, dwell FROM ev WHERE bind_f >= 30 AND bind_i <= 90")
def k5_block(fx: Fixture):
    return e.block(fx.events, 30, 90).select(EVC)


@query(TL + " SELECT frame, lipid_nr, res_nr, res_name, n FROM sk")
def k6_stacked(fx: Fixture):
    return e.stacked(fx.events)


@query(TL + ", rk AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY n DESC, lipid_nr) AS k FROM sk), th AS (SELECT frame, max(CASE WHEN k = 3 THEN n END) AS t FROM rk GROUP BY frame) SELECT sk.frame, lipid_nr, n FROM sk JOIN th ON sk.frame = th.frame WHERE n >= COALESCE(t, 0)")
def k7_sweep(fx: Fixture):
    return e.sweep(e.stacked(fx.events), 3).select("frame", "lipid_nr", "n")


@query("SELECT gx, gy, CAST(dense_rank() OVER (ORDER BY res_nr) - 1 AS INT) AS lipid_nr, bind_i FROM ev")
def k8_renumber(fx: Fixture):
    return e.renumber(fx.events).select("gx", "gy", "lipid_nr", "bind_i")


@query(f"SELECT {EV}, count(*) OVER (PARTITION BY gx, gy, res_nr) - 1 AS repeats FROM ev")
def k9_order_events(fx: Fixture):
    return e.order_events(fx.events, "repeats").select(*EVC, "repeats")


REP = ", ro AS (SELECT *, bind_i - lag(bind_f) OVER (PARTITION BY gx, gy, res_nr ORDER BY bind_i, bind_f) AS off FROM ev), rv AS (SELECT gx, gy, lipid_nr, res_nr, res_name, CAST(count(*) - 1 AS INT) AS repeats, avg(dwell) AS mean_dwell, COALESCE(avg(off), 0) AS mean_off FROM ro GROUP BY gx, gy, lipid_nr, res_nr, res_name)"


@query(REP + " SELECT gx, gy, lipid_nr, repeats, round(mean_dwell, 6) + 0.0 AS mean_dwell, round(mean_off, 6) + 0.0 AS mean_off FROM rv")
def k10_repeat_visits(fx: Fixture):
    return e.repeat_visits(fx.events).select("gx", "gy", "lipid_nr", "repeats", r6("mean_dwell"), r6("mean_off"))


def koff_sql(src: str, keys: str = "gx, gy", name: str = "kf") -> str:
    return f", {name}0 AS (SELECT {keys}, dwell, count(*) AS n FROM {src} GROUP BY {keys}, dwell), {name}1 AS (SELECT {keys}, dwell*2.5e0 AS t, ln(CAST(sum(n) OVER (PARTITION BY {keys} ORDER BY dwell DESC) AS DOUBLE)/CAST(sum(n) OVER (PARTITION BY {keys}) AS DOUBLE)) AS y FROM {name}0), {name} AS (SELECT {keys}, CASE WHEN count(*) > 1 THEN -regr_slope(y, t) END AS koff, CASE WHEN count(*) > 1 THEN regr_r2(y, t) END AS r2 FROM {name}1 GROUP BY {keys})"


@query(mend_sql(2) + ", sc AS (SELECT * FROM md WHERE dwell*2.5e0 >= 5e0 AND res_name IN ('POPE', 'POPG'))" + koff_sql("sc") + " SELECT s.gx, s.gy, count(*) AS n, round(avg(dwell), 6) + 0.0 AS mean, round(stddev_samp(dwell), 6) + 0.0 AS sd, max(dwell) AS largest, round(max(koff), 6) + 0.0 AS koff, round(max(r2), 6) + 0.0 AS r2 FROM sc s JOIN kf ON s.gx = kf.gx AND s.gy = kf.gy GROUP BY s.gx, s.gy")
def k11_event_stats(fx: Fixture):
    return e.event_stats(fx.events, 2.5, 5.0, 2, ("POPE", "POPG")).select("gx", "gy", "n", r6("mean"), r6("sd"), "largest", r6("koff"), r6("r2"))


@query(koff_sql("ev") + " SELECT gx, gy, round(koff, 6) + 0.0 AS koff, round(r2, 6) + 0.0 AS r2 FROM kf")
def k12_off_rate(fx: Fixture):
    return e.koff(fx.events, 2.5).select("gx", "gy", r6("koff"), r6("r2"))


BLOCK = ", bl AS (SELECT gx, gy, lipid_nr, res_nr, res_name, greatest(bind_i, 20) AS bind_i, least(bind_f, 120) AS bind_f, dwell FROM ev WHERE bind_f >= 20 AND bind_i <= 120)"


@query(BLOCK + mend_sql(2, "bl") + ", hh AS (SELECT CAST(floor(dwell/1e0) AS INT) AS bin, count(*) AS count FROM md GROUP BY 1) SELECT i AS bin, COALESCE(hh.count, 0) AS count, round(COALESCE(hh.count, 0)/CAST((SELECT count(*) FROM md) AS DOUBLE), 6) + 0.0 AS p FROM nd LEFT JOIN hh ON nd.i = hh.bin WHERE i < (SELECT max(dwell) FROM md)")
def k13_dwell_histogram(fx: Fixture):
    return e.event_stats_single(fx.events, 20, 120, 2.5, 1.0, 2)[1].select("bin", "count", r6("p"))


@query(BLOCK + mend_sql(2, "bl") + ", k1 AS (SELECT 1 AS one, * FROM md)" + koff_sql("k1", "one") + " SELECT count(*) AS n, round(avg(dwell), 6) + 0.0 AS mean, round(stddev_samp(dwell), 6) + 0.0 AS sd, round(max(koff), 6) + 0.0 AS koff FROM k1 JOIN kf USING (one)")
def k13_event_stats_single(fx: Fixture):
    return e.event_stats_single(fx.events, 20, 120, 2.5, 1.0, 2)[0].select("n", r6("mean"), r6("sd"), r6("koff"))


@query(mend_sql(2) + f" SELECT {EV}, bind_i*2.5e0 AS t_i, dwell*2.5e0 AS t_dwell FROM md WHERE dwell*2.5e0 >= 10e0")
def k14_list_events(fx: Fixture):
    return e.list_events(fx.events, 2, 2.5, 10.0).select(*EVC, "t_i", "t_dwell")


@query(", e0 AS (SELECT * FROM ev WHERE dwell >= 3)" + mend_sql(3, "e0") + ", tx AS (SELECT m.gx*100 + m.gy AS k1, m.lipid_nr AS k2, f.frame FROM md m JOIN (SELECT DISTINCT frame FROM fx2) f ON f.frame BETWEEN bind_i AND bind_f WHERE m.res_nr <> 17 AND NOT (m.lipid_nr = 3 AND f.frame BETWEEN 40 AND 60))" + islands_sql("SELECT * FROM tx") + " SELECT CAST(k1 // 100 AS INT) AS gx, CAST(k1 % 100 AS INT) AS gy, k2 AS lipid_nr, bind_i, bind_f, dwell FROM isl")
def k15_extract(fx: Fixture):
    drop = fx.spark.createDataFrame([(17,)], "res_nr int")
    spans = fx.spark.createDataFrame([(3, 40, 60)], "lipid_nr int, b int, e int")
    return e.extract(fx.events, last_frame(fx), 3, 3, drop, spans).select("gx", "gy", "lipid_nr", "bind_i", "bind_f", "dwell")


@query(f"SELECT {EV} FROM ev WHERE gx <= 2 UNION ALL SELECT gx, gy, CAST(lipid_nr + (SELECT max(lipid_nr) + 1 FROM ev WHERE gx <= 2) AS INT), res_nr, res_name, bind_i, bind_f, dwell FROM ev WHERE gx > 2")
def k16_merge(fx: Fixture):
    return e.merge(fx.events.filter("gx <= 2"), fx.events.filter("gx > 2")).select(EVC)


@query(TL + " SELECT gx, gy, round(count(DISTINCT frame)/CAST((SELECT max(frame) + 1 FROM fx2) AS DOUBLE), 6) + 0.0 AS value FROM tl GROUP BY gx, gy")
def k17_occupancy(fx: Fixture):
    return e.occupancy(fx.events, last_frame(fx) + 1).select("gx", "gy", r6("value"))


@query(REP + " SELECT gx, gy, round(avg(repeats), 6) + 0.0 AS repeats, round(avg(mean_off), 6) + 0.0 AS off_time, count(*) AS lipids FROM rv GROUP BY gx, gy")
def k18_contributors(fx: Fixture):
    return e.contributors(fx.events).select("gx", "gy", r6("repeats"), r6("off_time"), "lipids")


@query(TL + ", c AS (SELECT frame, count(DISTINCT lipid_nr) AS n FROM tl GROUP BY frame), f AS (SELECT CAST(range AS INT) AS frame FROM range((SELECT max(frame) + 1 FROM fx2))) SELECT f.frame, COALESCE(n, 0) AS n FROM f LEFT JOIN c ON f.frame = c.frame")
def k19_bound_counts(fx: Fixture):
    return e.bound_counts(fx.events, last_frame(fx) + 1)


@query(TL + ", c AS (SELECT frame, count(DISTINCT lipid_nr) AS n FROM tl GROUP BY frame) SELECT round(count(*)*100e0/(SELECT max(frame) + 1 FROM fx2), 6) + 0.0 AS percent, round(avg(n), 6) + 0.0 AS mean_bound FROM c")
def k20_binding_timeline(fx: Fixture):
    return e.binding_timeline(fx.events, last_frame(fx) + 1).select(r6("percent"), r6("mean_bound"))


FL = TL + ", fl AS (SELECT frame, gx, gy, min(lipid_nr) AS lipid_nr FROM tl GROUP BY frame, gx, gy)"


@query(FL + " SELECT frame, gx, gy, CASE WHEN lipid_nr IN (2, 5) THEN -(lipid_nr + 1) ELSE lipid_nr END AS label FROM fl")
def k21_frame_labels(fx: Fixture):
    return e.frames_from_events(fx.events, fx.spark.createDataFrame([(2,), (5,)], "lipid_nr int"))


@query(", fv AS (SELECT gx, gy, lipid_nr, min(bind_i) AS t FROM ev WHERE dwell >= 4 GROUP BY gx, gy, lipid_nr), mk AS (SELECT CAST(range*25 AS BIGINT) AS frame FROM range((SELECT CAST(ceil((max(frame) + 1)/25e0) AS BIGINT) FROM fx2))), cl AS (SELECT DISTINCT gx, gy FROM ev) SELECT cl.gx, cl.gy, mk.frame, round(count(fv.t)*100e0/12, 6) + 0.0 AS percent FROM cl CROSS JOIN mk LEFT JOIN fv ON fv.gx = cl.gx AND fv.gy = cl.gy AND fv.t <= mk.frame GROUP BY cl.gx, cl.gy, mk.frame")
def k22_percent_visited(fx: Fixture):
    return e.percent_visited(fx.events, 12, last_frame(fx) + 1, 25, 4).select("gx", "gy", F.col("frame").cast("long").alias("frame"), r6("percent"))


from .timeseries import NX  # noqa: E402


@query(NX + ", c AS (SELECT CASE WHEN res_name = 'POPE' AND NOT (next_lipid = lipid_nr AND next_bind_i = bind_i) THEN 1 END AS hit, next_res_name FROM nx), d AS (SELECT hit, CASE WHEN hit = 1 AND next_res_name = 'POPG' THEN 1e0 ELSE 0e0 END AS c FROM c) SELECT count(hit) AS n, round(sum(c)/count(hit) - 0.25e0, 6) + 0.0 AS value, round(stddev_samp(c)/sqrt(count(*)), 6) + 0.0 AS error FROM d")
def k23_exchange(fx: Fixture):
    return e.exchange(fx.events, F.col("res_name") == "POPE", F.col("next_res_name") == "POPG", 0.25).select("n", r6("value"), r6("error"))


@query(NX + " SELECT next_bind_i - bind_f AS delay, count(*) AS n FROM nx WHERE NOT (next_lipid = lipid_nr AND next_bind_i = bind_i) GROUP BY 1")
def k23_exchange_delays(fx: Fixture):
    return e.exchange_delays(fx.events)


@query(FL + NX + ", ce AS (SELECT frame, lipid_nr, avg(gx) AS x, avg(gy) AS y FROM fl GROUP BY frame, lipid_nr) SELECT nx.gx, nx.gy, nx.lipid_nr, nx.bind_i, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))*0.5e0, 6) + 0.0 AS distance FROM nx JOIN ce a ON a.frame = nx.bind_f AND a.lipid_nr = nx.lipid_nr JOIN ce b ON b.frame = nx.next_bind_i AND b.lipid_nr = nx.next_lipid WHERE NOT (next_lipid = nx.lipid_nr AND next_bind_i = nx.bind_i)")
def k24_exchange_distances(fx: Fixture):
    return e.exchange_distances(fx.events, 0.5).select("gx", "gy", "lipid_nr", "bind_i", r6("distance"))


#: Bands on the 5 x 5 lattice around node (2, 2), a cell of 1.
BANDS5 = ", d5 AS (SELECT a.i AS gx, b.i AS gy, sqrt((a.i-2)*(a.i-2)*1e0 + (b.i-2)*(b.i-2)*1e0) AS dist FROM nd a CROSS JOIN nd b WHERE a.i < 5 AND b.i < 5), b5 AS (SELECT q.i AS q, gx, gy FROM d5 JOIN nd q ON q.i < 4 AND dist <> 0 AND dist > q.i*1e0 - 0.6e0 AND dist < q.i*1e0 + 0.6e0)"


def bands5(fx: Fixture):
    grid = Lattice(1.0, (5, 5)).nodes(fx.spark)
    return g.distance_bands(g.mask_distance(grid, grid.filter("gx = 2 and gy = 2"), 1.0), 4, 1.0, 0.6)


RATES = koff_sql("isq", "q") + " SELECT i.q, count(*) AS n, round(avg(i.dwell), 6) + 0.0 AS mean, round(max(koff), 6) + 0.0 AS koff FROM isq i JOIN kf ON i.q = kf.q GROUP BY i.q"
HELD = ", hc AS (SELECT b5.q, ev.lipid_nr, f.frame, count(*) AS n FROM b5 JOIN ev ON b5.gx = ev.gx AND b5.gy = ev.gy JOIN (SELECT DISTINCT frame FROM fx2) f ON f.frame BETWEEN bind_i AND bind_f GROUP BY b5.q, ev.lipid_nr, f.frame), fa AS (SELECT CAST(range AS INT) AS frame FROM range((SELECT max(frame) + 1 FROM fx2))), ha AS (SELECT k.q, k.lipid_nr, fa.frame, COALESCE(hc.n, 0) AS n FROM (SELECT DISTINCT q, lipid_nr FROM hc) k CROSS JOIN fa LEFT JOIN hc ON hc.q = k.q AND hc.lipid_nr = k.lipid_nr AND hc.frame = fa.frame)"


@query(BANDS5 + HELD + ", vt AS (SELECT q AS k1, lipid_nr AS k2, frame, CASE WHEN count(*) OVER k = 3 AND 2*sum(CASE WHEN n >= 1 THEN 1 ELSE 0 END) OVER k > 3 THEN 1 ELSE 0 END AS o FROM ha WINDOW k AS (PARTITION BY q, lipid_nr ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))" + islands_sql("SELECT k1, k2, frame FROM vt WHERE o = 1") + ", isq AS (SELECT k1 AS q, dwell FROM isl)" + RATES)
def k25_residence_by_distance(fx: Fixture):
    return g.residence_by_distance_window(fx.events, bands5(fx), last_frame(fx) + 1, 1, 1, 2.5).select("q", "n", r6("mean"), r6("koff"))


@query(BANDS5 + TL + HELD + ", ra AS (SELECT ha.q, ha.lipid_nr, ha.frame, COALESCE(ha.n/CAST(sk.n AS DOUBLE), 0) AS r FROM ha LEFT JOIN sk ON sk.frame = ha.frame AND sk.lipid_nr = ha.lipid_nr), dd AS (SELECT *, CASE WHEN r >= 0.5e0 THEN 1 WHEN r <= 0.2e0 THEN 0 END AS d FROM ra), hy AS (SELECT q AS k1, lipid_nr AS k2, frame, COALESCE(last_value(d IGNORE NULLS) OVER (PARTITION BY q, lipid_nr ORDER BY frame ROWS UNBOUNDED PRECEDING), 0) AS o FROM dd)" + islands_sql("SELECT k1, k2, frame FROM hy WHERE o = 1") + ", isq AS (SELECT k1 AS q, dwell FROM isl)" + RATES)
def k26_residence_by_share(fx: Fixture):
    return g.residence_by_distance_share(fx.events, bands5(fx), last_frame(fx) + 1, 0.5, 0.2, 2.5).select("q", "n", r6("mean"), r6("koff"))


def _shell_sql(k: int, border: str, seen: str) -> str:
    """Labels with a node within 2.1 of the border that no shell before holds, and their nodes as the next border."""
    return f", sh{k} AS MATERIALIZED (SELECT DISTINCT t.frame, t.res_nr FROM t JOIN {border} b ON b.frame = t.frame AND sqrt((t.gx-b.gx)*2e0*((t.gx-b.gx)*2e0) + (t.gy-b.gy)*2e0*((t.gy-b.gy)*2e0)) <= 2.1e0 WHERE (t.frame, t.res_nr) NOT IN ({seen})), bo{k} AS MATERIALIZED (SELECT t.frame, gx, gy FROM t JOIN sh{k} s ON s.frame = t.frame AND s.res_nr = t.res_nr)"


_SEEN = ["SELECT -1, -1", "SELECT frame, res_nr FROM sh1", "SELECT frame, res_nr FROM sh1 UNION ALL SELECT frame, res_nr FROM sh2"]
SHELLS = TESS + ", bo0 AS (SELECT f.frame, gx, gy FROM (SELECT DISTINCT frame FROM t) f CROSS JOIN tn WHERE abs(gx - 5) <= 1 AND abs(gy - 5) <= 1)" + "".join(_shell_sql(k, f"bo{k - 1}", _SEEN[k - 1]) for k in (1, 2, 3))


@query(SHELLS + ", ws AS (SELECT frame, res_nr, 1 AS shell FROM sh1 UNION ALL SELECT frame, res_nr, 2 FROM sh2 UNION ALL SELECT frame, res_nr, 3 FROM sh3) SELECT l.frame, CAST(COALESCE(ws.shell, 4) AS INT) AS shell, count(*) AS n FROM (SELECT DISTINCT frame, res_nr FROM t) l LEFT JOIN ws ON ws.frame = l.frame AND ws.res_nr = l.res_nr GROUP BY 1, 2")
def k27_solvation_shells(fx: Fixture):
    from lattica.operators.tessellate import tessellate

    labels = tessellate(sites(fx), GT, 0.7).withColumnRenamed("res_nr", "label")
    mask = GT.nodes(fx.spark).filter(s.rect(5, 5, 1, 1))
    return g.solvation_shells(labels, mask, (2.1, 2.1, 2.1), 2.0).groupBy("frame", "shell").agg(F.count("*").alias("n"))


#: Lattices of 2.10: values of either leaflet; mask: the nodes nearest to the protein's positions.
SEED = ", sd AS (SELECT DISTINCT CAST(floor(x/0.5e0 + 0.5e0) AS INT) AS gx, CAST(floor(y/0.5e0 + 0.5e0) AS INT) AS gy FROM fx1p)"
BAND = SEED + ", ds AS (SELECT c.gx, c.gy, min(sqrt((c.gx-sd.gx)*0.5e0*((c.gx-sd.gx)*0.5e0) + (c.gy-sd.gy)*0.5e0*((c.gy-sd.gy)*0.5e0))) AS dist FROM cells c CROSS JOIN sd GROUP BY c.gx, c.gy), bd AS (SELECT q.i AS q, gx, gy FROM ds JOIN nd q ON q.i < 8 AND dist <> 0 AND dist > q.i*1e0 - 0.7e0 AND dist < q.i*1e0 + 0.7e0)"


def seed(fx: Fixture):
    node = lambda c: F.floor(F.col(c) / 0.5 + 0.5).cast("int")
    return fx.protein.select(node("x").alias("gx"), node("y").alias("gy")).distinct()


def bands(fx: Fixture):
    return g.distance_bands(g.mask_distance(G2.nodes(fx.spark), seed(fx), 0.5), 8, 1.0, 0.7)


@query(BAND + " SELECT q, gx, gy FROM bd")
def d1_distance_bands(fx: Fixture):
    return bands(fx)


@query(BAND + " SELECT q, round(avg(value), 6) + 0.0 AS value, count(*) AS n FROM bd JOIN l1 ON bd.gx = l1.gx AND bd.gy = l1.gy GROUP BY q")
def d2_distance_profile(fx: Fixture):
    return g.distance_profile(fx.grid(1), bands(fx)).select("q", r6("value"), "n")


@query(BAND + " SELECT q, round((sum(l1.value)/sum(l2.value) - 2.5e0)/2.5e0*100e0, 6) + 0.0 AS value FROM bd JOIN l1 ON bd.gx = l1.gx AND bd.gy = l1.gy JOIN l2 ON bd.gx = l2.gx AND bd.gy = l2.gy GROUP BY q")
def d3_enrichment_profile(fx: Fixture):
    return g.enrichment_profile(fx.grid(1), fx.grid(2), bands(fx), 2.5).select("q", r6("value"))


@query(SEED + " SELECT round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) + 0.0 AS sd, count(value) AS n FROM l1 WHERE abs(gx - 20) <= 9 AND abs(gy - 20) <= 9 AND EXISTS (SELECT 1 FROM sd WHERE sd.gx = l1.gx AND sd.gy = l1.gy)")
def d4_integrate(fx: Fixture):
    return g.integrate(fx.grid(1), s.rect(20, 20, 9, 9), seed(fx)).select(r6("mean"), r6("sd"), "n")


@query("SELECT gx, gy, CASE WHEN abs(gx - 10) <= 3 AND abs(gy - 30) <= 4 THEN 1.5e0 ELSE round(value, 6) + 0.0 END AS value FROM l1")
def d5_edit(fx: Fixture):
    return g.edit(fx.grid(1), s.rect(10, 30, 3, 4), 1.5).select(*K2, r6("value"))


@query("SELECT gx, gy, round(value + 2.25e0, 6) + 0.0 AS value FROM l1")
def d6_add(fx: Fixture):
    return g.add(fx.grid(1), 2.25).select(*K2, r6("value"))


#: Masked lattices: nodes with few samples.
M12 = ", m1 AS (SELECT gx, gy, CASE WHEN rho > 0.9e0*(SELECT sum(rho)/1681e0 FROM l1) THEN value END AS value, rho FROM l1), m2 AS (SELECT gx, gy, CASE WHEN rho > 0.9e0*(SELECT sum(rho)/1681e0 FROM l2) THEN value END AS value, rho FROM l2)"


def masked(fx: Fixture, leaflet: int):
    lat = fx.grid(leaflet)
    return g.exclude_by(lat, lat, G2, 0.9).join(lat.select(*K2, "rho"), K2)


@query(M12 + " SELECT a.gx, a.gy, round(b.value - a.value, 6) + 0.0 AS value FROM m1 a JOIN m2 b ON a.gx = b.gx AND a.gy = b.gy")
def d7_delta(fx: Fixture):
    return g.delta(masked(fx, 1), masked(fx, 2)).select(*K2, r6("value"))


@query(M12 + " SELECT a.gx, a.gy, round((a.value + b.value)*0.5e0, 6) + 0.0 AS value FROM m1 a JOIN m2 b ON a.gx = b.gx AND a.gy = b.gy")
def d8_midplane(fx: Fixture):
    return g.midplane(masked(fx, 1), masked(fx, 2)).select(*K2, r6("value"))


@query(", j AS (SELECT a.gx, a.gy, (a.value*a.rho + b.value*b.rho)/(a.rho + b.rho) AS value, a.rho + b.rho AS rho FROM l1 a JOIN l2 b ON a.gx = b.gx AND a.gy = b.gy) SELECT gx, gy, CASE WHEN rho > 0.9e0*(SELECT sum(rho)/1681e0 FROM j) THEN round(value, 6) + 0.0 END AS value, rho FROM j")
def d9_leaflet_average(fx: Fixture):
    return g.leaflet_average(fx.grid(1), fx.grid(2), G2, 0.9).select(*K2, r6("value"), "rho")


@query("SELECT a.gx, a.gy, CASE WHEN COALESCE(b.rho, 0) > 0.95e0*(SELECT sum(rho)/1681e0 FROM l2) THEN round(a.value, 6) + 0.0 END AS value FROM l1 a LEFT JOIN l2 b ON a.gx = b.gx AND a.gy = b.gy")
def d10_exclude_by(fx: Fixture):
    return g.exclude_by(fx.grid(1), fx.grid(2), G2, 0.95).select(*K2, r6("value"))


@query("SELECT c.gx, c.gy, CASE WHEN COALESCE(rho, 0) <= 0.9e0*(SELECT sum(rho)/1681e0 FROM l1) THEN 1 ELSE 0 END AS mask FROM cells c LEFT JOIN l1 ON c.gx = l1.gx AND c.gy = l1.gy")
def d11_protein_mask(fx: Fixture):
    return g.protein_mask(fx.grid(1), G2, 0.9)


@query(", hs AS (SELECT DISTINCT frame, gx, gy FROM st WHERE leaflet = 1), em AS MATERIALIZED (SELECT f.frame, c.gx, c.gy FROM (SELECT DISTINCT frame FROM fx1) f CROSS JOIN cells c WHERE (f.frame, c.gx, c.gy) NOT IN (SELECT frame, gx, gy FROM hs)), rg AS (SELECT frame, CAST(min(gx * 41 + gy) // 41 AS INT) AS gx, CAST(min(gx * 41 + gy) % 41 AS INT) AS gy FROM em GROUP BY frame UNION SELECT e.frame, e.gx, e.gy FROM rg JOIN em e ON e.frame = rg.frame AND abs(e.gx - rg.gx) <= 1 AND abs(e.gy - rg.gy) <= 1) SELECT frame, gx, gy FROM rg")
def d12_grow(fx: Fixture):
    """Frames are lattices: nodes without a sample, grown from the corner."""
    hit = stamp_counts(points(fx), G2, 0.6).select("frame", *K2)
    empty = fx.atoms.select("frame").distinct().crossJoin(F.broadcast(G2.nodes(fx.spark))).join(hit, ["frame", *K2], "left_anti")
    seeds = empty.groupBy("frame").agg(F.min(F.struct(*K2)).alias("s")).select("frame", "s.gx", "s.gy")
    return g.grow(empty, seeds, ("frame",))


@query(M12 + ", mk AS MATERIALIZED (SELECT c.gx, c.gy FROM cells c LEFT JOIN m1 ON m1.gx = c.gx AND m1.gy = c.gy WHERE m1.value IS NULL), rg AS (SELECT CAST(min(gx * 41 + gy) // 41 AS INT) AS gx, CAST(min(gx * 41 + gy) % 41 AS INT) AS gy FROM mk HAVING count(*) > 0 UNION SELECT k.gx, k.gy FROM rg JOIN mk k ON abs(k.gx - rg.gx) <= 1 AND abs(k.gy - rg.gy) <= 1) SELECT gx, gy FROM rg")
def d13_nan_region(fx: Fixture):
    lat = G2.nodes(fx.spark).join(masked(fx, 1).select(*K2, "value"), K2, "left")
    return g.nan_region(lat, lat.filter("value is null").orderBy("gx", "gy").limit(1))


@query(", st2 AS (SELECT i*0.25e0 AS thickness, i*i*0.5e0 AS fe FROM nd), lk AS (SELECT gx, gy, fe, row_number() OVER (PARTITION BY gx, gy ORDER BY thickness DESC) AS k FROM l1 JOIN st2 ON round(value, 9) >= thickness) SELECT lk.gx, lk.gy, fe, round(fe*l2.value, 6) + 0.0 AS value FROM lk JOIN l2 ON lk.gx = l2.gx AND lk.gy = l2.gy WHERE k = 1")
def d14_free_energy_map(fx: Fixture):
    steps = fx.spark.range(41).select((F.col("id") * 0.25).alias("thickness"), (F.col("id") * F.col("id") * 0.5).alias("fe"))
    return g.free_energy_map(fx.grid(1), fx.grid(2), steps).select(*K2, "fe", r6("value"))


def frame_values(fx: Fixture):
    return frame_mean(points(fx), G2, 0.6)


@query(SEED + ", v AS (SELECT f.v FROM fm f JOIN sd ON f.gx = sd.gx AND f.gy = sd.gy WHERE leaflet = 1), hh AS (SELECT CAST(floor(round(v/0.2e0, 9)) AS INT) AS bin, count(*) AS count FROM v GROUP BY 1) SELECT i AS bin, COALESCE(hh.count, 0) AS count, round(COALESCE(hh.count, 0)/CAST((SELECT count(*) FROM v) AS DOUBLE), 6) + 0.0 AS p FROM nd LEFT JOIN hh ON nd.i = hh.bin WHERE i < ceil(round((SELECT max(v) FROM v)/0.2e0, 9))")
def d15_frame_distribution(fx: Fixture):
    return g.frame_distribution(frame_values(fx), seed(fx), 0.2).select("bin", "count", r6("p"))


@query(SEED + ", er AS (SELECT f.frame, sqrt(avg((f.v-l1.value)*(f.v-l1.value))) AS error FROM fm f JOIN sd ON f.gx = sd.gx AND f.gy = sd.gy JOIN l1 ON f.gx = l1.gx AND f.gy = l1.gy WHERE leaflet = 1 GROUP BY f.frame) SELECT frame, round(error, 6) + 0.0 AS error FROM er ORDER BY er.error, frame LIMIT 1")
def d16_closest_frame(fx: Fixture):
    return g.closest_frame(frame_values(fx), fx.grid(1), seed(fx)).select("frame", r6("error"))


@query("SELECT leaflet, round(avg(value), 6) + 0.0 AS mean, round(sum(value), 5) + 0.0 AS sum, count(value) AS n FROM lat GROUP BY leaflet")
def d17_grid_stats(fx: Fixture):
    both = fx.grid(1).withColumn("leaflet", F.lit(1)).unionByName(fx.grid(2).withColumn("leaflet", F.lit(2)))
    return g.grid_stats(both, "leaflet").select("leaflet", r6("mean"), (F.round("sum", 5) + 0.0).alias("sum"), "n")


@query(", v AS (SELECT z - 3e0 AS v FROM hd), hh AS (SELECT CAST(floor(v/0.3e0) AS INT) AS bin, count(*) AS count FROM v GROUP BY 1), r AS (SELECT CAST(floor(least(0e0, min(v))/0.3e0) AS INT) AS lo, CAST(ceil((greatest(0e0, max(v)) - least(0e0, min(v)))/0.3e0) AS INT) AS n FROM v) SELECT CAST(lo + i AS INT) AS bin, COALESCE(hh.count, 0) AS count, round(COALESCE(hh.count, 0)/CAST((SELECT count(*) FROM v) AS DOUBLE), 6) + 0.0 AS p FROM nd CROSS JOIN r LEFT JOIN hh ON hh.bin = lo + i WHERE i < n")
def h1_histogram(fx: Fixture):
    return h.histogram(fx.heads.withColumn("v", F.col("z") - 3.0), "v", 0.3).select("bin", "count", r6("p"))


@query("SELECT res_name, round(avg(z), 6) + 0.0 AS mean, round(stddev_samp(z), 6) + 0.0 AS sd, count(z) AS n FROM fx1 GROUP BY res_name")
def h2_moments(fx: Fixture):
    return h.moments(fx.atoms, "z", "res_name").select("res_name", r6("mean"), r6("sd"), "n")


@query("SELECT frame, round(regr_slope(z, x), 6) + 0.0 AS slope, round(regr_intercept(z, x), 6) + 0.0 AS intercept, round(regr_r2(z, x), 6) + 0.0 AS r2 FROM fx1 GROUP BY frame")
def h3_regression(fx: Fixture):
    return h.ols(fx.atoms, "x", "z", "frame").select("frame", r6("slope"), r6("intercept"), r6("r2"))


@query(TILT + ", a AS (SELECT theta*1e0 AS theta, CASE WHEN vx < 0 THEN 360e0 - p ELSE p END AS phi FROM t) SELECT CAST(floor(theta/0.5e0) AS INT) AS i_theta, CAST(floor(phi/30e0) AS INT) AS i_phi, count(*) AS count, round(100e0*count(*)/(SELECT count(*) FROM a), 6) + 0.0 AS percent FROM a GROUP BY 1, 2")
def h4_polar_histogram(fx: Fixture):
    from lattica.operators.molecule import tilt

    return h.polar_histogram(tilt(fx.atoms, s.upper(), s.lower()), 0.5, 30.0).select("i_theta", "i_phi", "count", r6("percent"))


@query("SELECT atom_nr AS pos, round(avg(x), 6) + 0.0 AS x, round(avg(z), 6) + 0.0 AS z FROM fx1 GROUP BY atom_nr")
def h5_average_tables(fx: Fixture):
    return h.average_tables([fx.atoms.select(F.col("atom_nr").alias("pos"), "x", "z")]).select("pos", r6("x"), r6("z"))
