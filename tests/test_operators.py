"""Hand-computed cases, properties, and comparisons with plain Python where SQL is no oracle."""

import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import events, gridops, lattice, molecule, observables, rangejoin, select, series, stats, transforms, windows
from lattica.operators.lattice import Lattice


def ring_buffer(labels, r):
    """The plain form of majority_events: the last 2r + 1 labels of one cell."""
    span, ring, open_, out = 2 * r + 1, deque(maxlen=2 * r + 1), None, []
    for f, label in enumerate(labels):
        ring.append(label)
        best = max((x for x in ring if x >= 0), key=lambda x: sum(y == x for y in ring), default=None)
        holder = best if best is not None and 2 * sum(y == best for y in ring) >= span and f >= 2 * r else None
        if open_ and open_[0] != holder:
            out.append(open_)
            open_ = None
        if holder is not None:
            open_ = (holder, open_[1] if open_ else f, f)
    return out, open_


def test_majority_events_equal_a_ring_buffer(spark):
    rng = random.Random(4)
    cells = {c: [rng.choice([-1, 0, 0, 1, 1, 2]) if rng.random() < 0.4 else (f // 7) % 3 for f in range(60)] for c in range(30)}
    occ = spark.createDataFrame([(c, f, x) for c, v in cells.items() for f, x in enumerate(v)], "cell int, frame int, lipid_nr int")
    got = {tuple(x) for x in windows.majority_events(occ, 2).collect()}
    closed = {tuple(x) for x in windows.majority_events(occ, 2, dump=False).collect()}
    want, kept = set(), set()
    for c, v in cells.items():
        done, open_ = ring_buffer(v, 2)
        kept |= {(c, *e, e[2] - e[1] + 1) for e in done}
        want |= {(c, *e, e[2] - e[1] + 1) for e in done + ([open_] if open_ else [])}
    assert got == want and closed == kept


def test_islands_clip_at_the_last_frame(spark):
    tl = spark.createDataFrame([(1, f) for f in (0, 1, 2, 5, 8, 9)] + [(2, 9)], "k int, frame int")
    assert sorted(map(tuple, windows.islands(tl, ["k"], 9).collect())) == [(1, 0, 2, 3), (1, 5, 5, 1), (1, 8, 8, 1)]
    assert sorted(map(tuple, windows.islands(tl, ["k"], 9, closed_end=True).collect())) == [(1, 0, 2, 3), (1, 5, 5, 1), (1, 8, 9, 2), (2, 9, 9, 1)]


def test_events_merge_within_a_gap_only(spark):
    ev = spark.createDataFrame([(0, 0, 1, 17, "A", b, f, f - b + 1) for b, f in ((0, 10), (2, 5), (12, 15), (14, 20), (40, 41))], "gx int, gy int, lipid_nr int, res_nr int, res_name string, bind_i int, bind_f int, dwell int")
    got = sorted((r["bind_i"], r["bind_f"], r["dwell"]) for r in events.mend_events(ev, 3).collect())
    # 2-5 is contained, 12 follows 10 within 3 frames, 14-20 overlaps in part and stays a break
    assert got == [(0, 15, 16), (14, 20, 7), (40, 41, 2)]


def test_single_visits_have_no_off_time(spark):
    ev = spark.createDataFrame([(0, 0, 1, 17, "A", 0, 3, 4), (0, 0, 1, 17, "A", 10, 13, 4), (0, 0, 2, 27, "B", 5, 6, 2)], "gx int, gy int, lipid_nr int, res_nr int, res_name string, bind_i int, bind_f int, dwell int")
    got = {r["lipid_nr"]: (r["repeats"], r["mean_dwell"], r["mean_off"]) for r in events.repeat_visits(ev).collect()}
    assert got == {1: (1, 4.0, 7.0), 2: (0, 2.0, 0.0)}


def test_histogram_includes_zero_and_can_drop_the_maximum(spark):
    got = {r["bin"]: r["count"] for r in stats.histogram(spark.createDataFrame([(1.5,), (2.0,), (3.0,)], "v double"), "v", 1.0).collect()}
    assert got == {0: 0, 1: 1, 2: 1}
    assert stats.histogram(spark.createDataFrame([], "v double"), "v", 1.0).count() == 0


def test_hysteresis_and_votes(spark):
    rows = [(1, f, x) for f, x in enumerate([0.0, 0.8, 0.5, 0.4, 0.2, 0.5, 0.9])]
    df = spark.createDataFrame(rows, "k int, frame int, ratio double")
    assert [r["on"] for r in windows.hysteresis(df, ["k"], "ratio", 0.7, 0.3).orderBy("frame").collect()] == [0, 1, 1, 1, 0, 0, 1]
    n = spark.createDataFrame([(1, f, x) for f, x in enumerate([1, 1, 0, 1, 1])], "k int, frame int, n int")
    assert [r["occupied"] for r in windows.window_vote(n, ["k"], 1, 1).orderBy("frame").collect()] == [0, 1, 1, 1, 0]


def test_selection_has_no_precedence(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (0, 1, 1)], "a int, b int, c int")
    t = {c: F.col(c) == 1 for c in "abc"}
    assert df.filter(select.left_fold(t["a"], ("or", t["b"]), ("and", t["c"]))).count() == 1


def test_leaflets_take_the_larger_distance(spark):
    rows = [(1, "POPE", "PO4", 2.0), (1, "POPE", "C4A", 2.5), (1, "POPE", "C4B", 1.0), (2, "CHOL", "ROH", 1.0), (2, "CHOL", "C2", 1.0)]
    got = dict(map(tuple, select.assign_leaflets(spark.createDataFrame(rows, "res_nr int, res_name string, atom_name string, z double")).collect()))
    assert got == {1: 1, 2: 2}


def test_mismatches_fail(spark):
    a = spark.createDataFrame([(1, "A", 0.5)], "atom_nr int, atom_name string, beta double")
    b = spark.createDataFrame([(1, "B", 0.7)], "atom_nr int, atom_name string, beta double")
    with pytest.raises(Exception, match="atom names differ"):
        select.copy_beta(a, b).collect()
    small, large = (Lattice(1.0, (n, n)).nodes(spark).withColumn("value", F.lit(1.0)) for n in (3, 4))
    with pytest.raises(Exception, match="shapes differ"):
        gridops.delta(small, large).collect()


def test_range_join_equals_all_pairs(spark):
    rng = np.random.default_rng(0)
    pts = [(int(f), k, *map(float, xyz)) for k, (f, xyz) in enumerate(zip(rng.integers(0, 3, 300), rng.uniform(-2, 3, (300, 3))))]
    df = spark.createDataFrame(pts, "frame int, id int, x double, y double, z double")
    got = {(r["a_id"], r["b_id"]) for r in rangejoin.range_join(df, df, 0.7).collect()}
    want = {(p[1], q[1]) for p in pts for q in pts if p[0] == q[0] and np.sqrt(sum((a - b) ** 2 for a, b in zip(p[2:], q[2:]))) < 0.7}
    assert got == want


def test_density_sums_to_molecules(spark):
    atoms = spark.createDataFrame([(f, 10 * m + a, m, 3.0 + m % 5 + 0.1 * a, 4.0 + m % 4, 0.0) for f in range(4) for m in range(12) for a in range(3)], "frame int, atom_nr int, res_nr int, x double, y double, z double")
    total = observables.density_lattice(atoms, Lattice.of_box(0.25, 12, 12), 0.8, 4).agg(F.sum("value")).first()[0]
    assert total == pytest.approx(12)


def test_stamp_edges(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0), (0, -5.0, 0.0)], "frame int, x double, y double")
    got = {(r["gx"], r["gy"]) for r in lattice.stamp(p, Lattice(1.0, (3, 3)), 1.0).collect()}
    assert got == {(0, 0), (1, 0), (0, 1)}


def rotation(rng):
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    return q * np.sign(np.linalg.det(q))


def test_superpose_undoes_a_rotation(spark):
    rng = np.random.default_rng(1)
    ref = rng.normal(size=(12, 3)) * 3
    rows = [(0, k, 1.0 + k % 3, *map(float, v)) for k, v in enumerate(ref)]
    for f in range(1, 5):
        moved = ref @ rotation(rng).T + rng.normal(size=3)
        rows += [(f, k, 1.0 + k % 3, *map(float, v)) for k, v in enumerate(moved)]
    df = spark.createDataFrame(rows, "frame int, atom_nr int, mass double, x double, y double, z double")
    got = series.rmsd_series(df, F.lit(True), F.lit(True), df.filter("frame = 0")).collect()
    assert len(got) == 5 and max(r["rmsd"] for r in got) < 1e-6


def test_flat_superpose_turns_about_z(spark):
    ref = np.array([[1.0, 0, 0], [0, 2.0, 1], [-1, -1, 2]])
    turn = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    rows = [(f, k, 1.0, *map(float, v)) for f, m in enumerate((ref, ref @ turn.T)) for k, v in enumerate(m)]
    df = spark.createDataFrame(rows, "frame int, atom_nr int, mass double, x double, y double, z double")
    got = {r["atom_nr"]: (r["x"], r["y"], r["z"]) for r in transforms.superpose(df, F.lit(True), df.filter("frame = 0"), 2).filter("frame = 1").collect()}
    assert np.allclose([got[k] for k in range(3)], ref)


def test_mended_residues_are_whole(spark):
    rows = [(0, k, k // 3, float(x), 1.0, 1.0, 1.0) for k, x in enumerate((9.8, 0.3, 0.1, 4.0, 4.2, 4.4))]
    df = spark.createDataFrame(rows, "frame int, atom_nr int, res_nr int, x double, y double, z double, mass double")
    box = (10.0, 10.0, 10.0)
    assert transforms.broken(df, box).agg(F.sum("broken")).first()[0] == 1
    assert transforms.broken(transforms.mend_residues(df, box), box).agg(F.sum("broken")).first()[0] == 0
    bonds = spark.createDataFrame([(0, 1), (1, 2), (3, 4), (4, 5)], "a int, b int")
    mended = transforms.mend_bonds(df, bonds, box)
    assert transforms.broken(mended, box).agg(F.sum("broken")).first()[0] == 0
    assert mended.count() == 6


def test_components(spark):
    bonds = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(60, 50), (50, 55)], "a int, b int")
    got = dict(map(tuple, transforms.components(bonds).collect()))
    assert got == {**dict.fromkeys(range(1, 41), 1), 50: 50, 55: 50, 60: 50}


def test_flood_fill(spark):
    rng = random.Random(3)
    nodes = {(k, x, y) for k in range(3) for x in range(8) for y in range(8) if rng.random() < 0.55}
    seeds = {(k, *min((x, y) for q, x, y in nodes if q == k)) for k in range(3)}
    want, todo = set(seeds), list(seeds)
    while todo:
        k, x, y = todo.pop()
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                n = (k, x + i, y + j)
                if n in nodes and n not in want:
                    want.add(n)
                    todo.append(n)
    make = lambda s: spark.createDataFrame(sorted(s), "k int, gx int, gy int")
    assert {tuple(r) for r in gridops.grow(make(nodes), make(seeds), ("k",)).collect()} == want


def test_state_fold_needs_the_order(spark):
    path = [0, 0, 1, 2, 1, 2, 3, 4, 4, 3, 2, 1, 0, 2, 4]
    df = spark.createDataFrame([(7, f, s) for f, s in enumerate(path)], "k int, frame int, state int")
    assert [tuple(r) for r in windows.state_fold(df, "k", "state").orderBy("start").collect()] == [(7, "down", 1, 7, 6), (7, "up", 8, 12, 4)]


def test_unwrap_and_wrap(spark):
    xs = [1.0, 9.0, 8.0, 9.5, 0.5, 1.5]
    df = spark.createDataFrame([(f, 1, x, 0.0) for f, x in enumerate(xs)], "frame int, atom_nr int, x double, y double")
    assert [r["x"] for r in transforms.unwrap_xy(df, 10.0, 10.0).orderBy("frame").collect()] == [1.0, -1.0, -2.0, -0.5, 0.5, 1.5]


def test_sweep_keeps_ties(spark):
    tl = spark.createDataFrame([(0, k, n) for k, n in ((1, 5), (2, 3), (3, 3), (4, 1))], "frame int, lipid_nr int, n int")
    assert sorted(r["lipid_nr"] for r in events.sweep(tl, 2).collect()) == [1, 2, 3]


def test_circular_mean_wraps(spark):
    m = series.circular_stats(spark.createDataFrame([(179.0,), (-179.0,)], "angle double")).first()
    assert abs(abs(m["circular_mean"]) - 180) < 1e-9 and m["circular_sd"] == pytest.approx(np.sqrt(2))


def test_dihedral_sign(spark):
    rows = [(0, 1, n, *v) for n, v in (("I", (1.0, 0.0, 0.0)), ("J", (0.0, 0.0, 0.0)), ("K", (0.0, 0.0, 1.0)), ("L", (0.0, 1.0, 1.0)))]
    df = spark.createDataFrame(rows, "frame int, res_nr int, atom_name string, x double, y double, z double")
    angle = molecule.dihedral(df, "I", "J", "K", "L").first()["angle"]
    flipped = molecule.dihedral(df.withColumn("y", -F.col("y")), "I", "J", "K", "L").first()["angle"]
    assert abs(angle) == pytest.approx(90) and flipped == pytest.approx(-angle)


def test_shells_grow_outwards(spark):
    labels = spark.createDataFrame([(0, x, 0, x) for x in range(10)], "frame int, gx int, gy int, label int")
    mask = spark.createDataFrame([(0, 0)], "gx int, gy int")
    got = {r["label"]: r["shell"] for r in gridops.solvation_shells(labels, mask, (1.0, 2.0), 1.0).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 2, **dict.fromkeys(range(4, 10), 3)}


def test_rounds_leave_only_the_tables_that_results_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(transforms, "shared_folder", lambda spark: f"file://{tmp_path}/shared")
    left = lambda: len(list((tmp_path / "shared").glob("tables-*/table-*")))
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    molecules = transforms.components(chain)
    assert left() == 1 and molecules.select("molecule").distinct().collect() == [(0,)] and molecules.count() == 201
    atoms = spark.range(201).select(F.lit(0).alias("frame"), F.col("id").alias("atom_nr"), (F.col("id") * 1.0 % 10).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    whole = transforms.mend_bonds(atoms, chain, (10.0, 10.0, 10.0))
    assert left() < 10 and [r["x"] for r in whole.orderBy("atom_nr").collect()] == [float(k) for k in range(201)]
    points = spark.range(60).select(F.lit(0).alias("frame"), F.col("id").alias("k"), (F.col("id") * F.col("id") * 1.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    near = rangejoin.min_dist(points.withColumn("x", F.col("x") + 0.25), points, ["k"], 0.1)
    far = rangejoin.min_dist(points.withColumn("x", -1000.0 * (F.col("k") + 1)), points, ["k"], 0.1)
    assert near.count() == 60 and {r["dist"] for r in near.collect()} == {0.25}
    assert {r["k"]: r["dist"] for r in far.collect()} == {k: 1000.0 * (k + 1) for k in range(60)}
    cells = spark.range(90).select(F.col("id").cast("int").alias("gx"), F.lit(3).alias("gy")).filter("gx != 70")
    assert gridops.grow(cells, cells.filter("gx = 2"), side=8).count() == 70
    transforms.clear_tables(spark)
    assert left() == 0
    transforms.clear_tables(spark)  # nothing there
