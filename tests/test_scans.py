"""Scan lines, blocked scans, parted joins, correlations, rotations, distance transforms and doubled paths against plain versions."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions.rotation import XYZ, turns
from lattica.operators import blocks, events, gridops, lattice, rangejoin, scanline, series, transforms, windows
from lattica.operators.lattice import Lattice


def cloud(rng, n, frames=3, side=7.0):
    """Points in and around the lattice, some on nodes, some equal, some without a value."""
    rows = [(rng.randrange(frames), rng.uniform(-2, side + 2), rng.uniform(-2, side + 2), rng.uniform(-1, 4), rng.choice([None, 1.5, -2.0, rng.random()])) for _ in range(n)]
    return rows + [(0, 3.0, 4.0, 1.0, 2.0)] * 3 + [(1, float(i), 2.0, 1.0, 1.0) for i in range(4)] + [(2, None, 1.0, 1.0, 1.0)]


@pytest.mark.parametrize("radius", [0.2, 1.0, 2.3])
@pytest.mark.parametrize("grid", [Lattice(0.5, (15, 15)), Lattice(1.0, (8, 6, 4))])
def test_scan_lines_give_what_single_nodes_give(spark, grid, radius):
    points = spark.createDataFrame(cloud(random.Random(2), 60), "frame int, x double, y double, z double, value double")
    want = defaultdict(list)
    for r in lattice.stamp(points, grid, radius).collect():
        want[(r["frame"], *(r[k] for k in grid.keys))].append(r["value"])
    got = {(r["frame"], *(r[k] for k in grid.keys)): r for r in scanline.totals(points, grid, radius, ("frame",), ("value",)).collect()}
    assert got.keys() == want.keys()
    for k, values in want.items():
        known = [v for v in values if v is not None]
        assert (got[k]["n"], got[k]["n_value"]) == (len(values), len(known))
        assert got[k]["value"] == (pytest.approx(sum(known)) if known else None)


def test_a_value_that_is_no_number_stays_where_it_is(spark):
    points = spark.createDataFrame([(0, 1.0, 1.0, float("nan")), (0, 3.0, 1.0, 5.0), (0, 5.0, 1.0, float("inf"))], "frame int, x double, y double, value double")
    got = {r["gx"]: r["value"] for r in scanline.means(points, Lattice(1.0, (8, 3)), 1.0, ("frame",)).collect() if r["gy"] == 1}
    assert got[3] == 5.0 and math.isnan(got[1]) and math.isnan(got[2]) and math.isnan(got[4]) and math.isnan(got[6]) and 7 not in got


def test_scan_lines_write_less_at_a_large_radius(spark):
    points = spark.createDataFrame(cloud(random.Random(3), 80), "frame int, x double, y double, z double, value double").select("frame", "x", "y")
    grid = Lattice(0.1, (80, 80))
    assert scanline.intervals(points, grid, 2.0).count() * 2 * 10 < lattice.stamp(points, grid, 2.0).count()


LENGTHS = [1, 2, 7, 1000]


@pytest.mark.parametrize("block", LENGTHS)
def test_blocked_scans_are_plain_scans(spark, block):
    rng = random.Random(4)
    rows = [(k, f, rng.choice([None, rng.randrange(-5, 6)])) for k in (1, 2, None) for f in sorted(rng.sample(range(60), 25))]
    df = spark.createDataFrame(rows, "k int, frame int, v int")
    out = blocks.scan(df, ["k"], "frame", sums={"total": F.col("v")}, lasts={"known": F.col("v")}, previous={"was": F.col("v")}, following="next", block=block)
    got = {(r["k"], r["frame"]): (r["v"], r["total"], r["known"], r["was"], r["next"]) for r in out.collect()}
    want = {}
    for k in (1, 2, None):
        own = [(f, v) for q, f, v in rows if q == k]
        total, known = 0, None
        for i, (f, v) in enumerate(own):
            total, known = total + (v or 0), known if v is None else v
            want[(k, f)] = (v, total, known, own[i - 1][1] if i else None, own[i + 1][0] if i + 1 < len(own) else None)
    assert got == want


@pytest.mark.parametrize("block", LENGTHS)
def test_window_operators_do_not_depend_on_the_block(spark, block):
    rng = random.Random(5)
    occ = spark.createDataFrame([(c, f, rng.choice([-1, 1, 1, 1, 2])) for c in range(3) for f in range(80)], "cell int, frame int, lipid_nr int")
    same = lambda f: Counter(map(tuple, f(block).collect())) == Counter(map(tuple, f(10**6).collect()))
    assert same(lambda b: windows.majority_events(occ, 2, block=b))
    assert same(lambda b: windows.islands(occ.filter("lipid_nr = 1"), ["cell"], 79, block=b))
    ratio = occ.select("cell", "frame", (F.col("lipid_nr") * 0.4).alias("ratio"))
    assert same(lambda b: windows.hysteresis(ratio, ["cell"], "ratio", 0.7, 0.3, block=b))
    path = spark.createDataFrame([(a, f, (a * 3.1 + f * 1.7) % 10, (f * f * 0.9) % 10) for a in range(3) for f in range(50)], "atom_nr int, frame int, x double, y double")
    whole = {(r["atom_nr"], r["frame"]): (r["x"], r["y"]) for r in windows.unwrap(path, "xy", {"x": 10.0, "y": 10.0}, block=10**6).collect()}
    got = {(r["atom_nr"], r["frame"]): (r["x"], r["y"]) for r in windows.unwrap(path, "xy", {"x": 10.0, "y": 10.0}, block=block).collect()}
    assert got == whole
    for a in range(3):
        assert all(abs(whole[a, f][0] - whole[a, f - 1][0]) <= 5.0 for f in range(1, 50))


def plain_runs(frames):
    out = []
    for f in sorted(frames):
        if out and f == out[-1][1] + 1:
            out[-1][1] = f
        else:
            out.append([f, f])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("block", LENGTHS)
def test_runs_across_blocks(spark, block):
    rng = random.Random(6)
    sets = {k: rng.sample(range(50), n) for k, n in ((1, 45), (2, 20), (3, 50), (4, 1))}
    df = spark.createDataFrame([(k, f) for k, v in sets.items() for f in v], "k int, frame int")
    got = {(r["k"], r["bind_i"], r["bind_f"]) for r in windows.islands(df, ["k"], 10**6, block=block).collect()}
    assert got == {(k, a, b) for k, v in sets.items() for a, b in plain_runs(v)}


def plain_passages(states, levels):
    out = []
    for direction, path in (("down", list(range(levels))), ("up", list(range(levels))[::-1])):
        at, start = -1, None
        for frame, s in states:
            if s == path[0]:
                at, start = 0, frame
            elif at >= 0 and s == path[at + 1]:
                at += 1
            elif at >= 0 and s != path[at]:
                at = path.index(s) if s in path and path.index(s) <= at else -1
            if at == levels - 1:
                out.append((direction, start, frame))
                at = -1
    return sorted(out)


@pytest.mark.parametrize("block", LENGTHS)
@pytest.mark.parametrize("levels", [2, 3, 5])
def test_passages_are_those_of_the_automaton(spark, block, levels):
    rng = random.Random(levels)
    series_, rows = {}, []
    for k in range(6):
        s, states = 0, []
        for f in range(120):
            s = min(levels - 1, max(0, s + rng.choice([-1, 0, 1, 1, -1]))) if rng.random() < 0.95 else rng.choice([None, *range(levels)])
            states.append((f, s))
            s = s or 0
        series_[k] = states
        rows += [(k, f, s) for f, s in states]
    out = windows.state_fold(spark.createDataFrame(rows, "k int, frame int, state int"), "k", "state", levels, block)
    got = defaultdict(list)
    for r in out.collect():
        assert r["duration"] == r["end"] - r["start"]
        got[r["k"]].append((r["direction"], r["start"], r["end"]))
    assert sum(map(len, got.values())) > 5
    assert {k: sorted(got[k]) for k in series_} == {k: plain_passages(s, levels) for k, s in series_.items()}
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("dims", ["xy", "xyz"])
@pytest.mark.parametrize("crowd", [3, 40, 10**6])
def test_crowded_cells_are_parted_with_the_same_pairs(spark, dims, crowd):
    rng = np.random.default_rng(7)
    spread, dense = rng.uniform(0, 12, (150, 3)), 4.2 + rng.uniform(0, 0.5, (150, 3))
    dense[:30] = dense[0]  # points that no halving tells apart
    p = np.concatenate([spread, dense])
    rows = [(0, k, *map(float, v)) for k, v in enumerate(p)]
    df = spark.createDataFrame(rows, "frame int, n int, x double, y double, z double")
    d = len(dims)
    far = np.sqrt(((p[:, None, :d] - p[None, :, :d]) ** 2).sum(2))
    want = {(i, j) for i, j in zip(*np.nonzero(far < 0.7))}
    got = [(r["a_n"], r["b_n"]) for r in rangejoin.range_join(df, df, 0.7, dims=dims, crowd=crowd).collect()]
    assert len(got) == len(want) and set(got) == want
    near = rangejoin.range_join(df, df.filter("n < 10"), 0.7, dims=dims, how="left_semi", crowd=crowd).collect()
    assert {r["n"] for r in near} == {i for i, j in want if j < 10} and len(near) == len({r["n"] for r in near})


def test_no_part_of_a_crowded_cell_holds_many_times_the_others(spark):
    rng = np.random.default_rng(8)
    p = np.concatenate([rng.uniform(0, 40, (2000, 2)), 10 + rng.uniform(0, 1, (2000, 2)) ** 2])
    df = spark.createDataFrame([(0, k, *map(float, v)) for k, v in enumerate(p)], "frame int, n int, x double, y double")
    left = rangejoin._prefixed(df, "a_", ("frame",)).withColumns({"_cx": F.floor(F.col("a_x")), "_cy": F.floor(F.col("a_y"))})
    parted, _, keys = rangejoin._parted(left, rangejoin._prefixed(df, "b_", ("frame",)).withColumns({"_cx": F.floor(F.col("b_x")), "_cy": F.floor(F.col("b_y"))}), 1.0, ("frame",), "xy", 64)
    sizes = [r["count"] for r in parted.groupBy("frame", "_cx", "_cy", *keys).count().collect()]
    assert max(sizes) <= 64 * 1.6 and sum(sizes) == 4000


@pytest.mark.parametrize("stride", [1, 3])
def test_displacements_are_those_of_all_pairs(spark, stride):
    rng = random.Random(9)
    rows = [(k, 5 + 2 * f, rng.uniform(0, 9), rng.uniform(100, 109)) for k in range(4) for f in range(30) if k == 0 or rng.random() < 0.8]
    rows += rows[:3] + [(9, 4, 1.0, 1.0), (8, 1, None, 2.0)]
    df = spark.createDataFrame(rows, "res_nr int, frame int, x double, y double")
    sums = defaultdict(list)
    for k, f, x, y in rows:
        first = min(g for q, g, *_ in rows if q == k)
        if (f - first) % stride == 0 and x is not None:
            for q, g, u, v in rows:
                if q == k and g > f:
                    sums[k, g - f].append((x - u) ** 2 + (y - v) ** 2)
    got = {(r["res_nr"], r["lag"]): r["value"] for r in series.msd_by_lipid(df, stride=stride).collect()}
    assert got == pytest.approx({k: sum(v) / len(v) for k, v in sums.items()}, abs=1e-9)
    assert max(lag for _, lag in got if lag <= 20) == max(r["lag"] for r in series.msd(df, 20, stride).collect())


def moved(rng, ref, noise=0.0):
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q = q * np.sign(np.linalg.det(q))
    return ref @ q.T + noise * rng.normal(size=ref.shape)


@pytest.mark.parametrize("kind", ["any", "flat", "line", "point", "mirror"])
def test_turns_fit_as_well_as_a_singular_value_decomposition(spark, kind):
    rng = np.random.default_rng(10)
    rows, want = [], []
    for frame in range(8):
        ref = rng.normal(size=(7, 3)) * (1e-3 if frame % 2 else 50.0)
        ref *= {"flat": [1, 1, 0], "line": [1, 0, 0], "point": [0, 0, 0]}.get(kind, [1, 1, 1])
        own = moved(rng, ref, 0.1 * np.abs(ref).max() if kind == "any" else 0.0)
        own = own * [1, 1, -1] if kind == "mirror" else own
        ref, own = ref - ref.mean(0), own - own.mean(0)
        m = own.T @ ref
        u, s, vt = np.linalg.svd(m)
        want.append((ref, own, s[0] + s[1] + s[2] * np.sign(np.linalg.det(u @ vt))))
        rows.append((frame, *map(float, m.reshape(-1))))
    df = spark.createDataFrame(rows, "frame int, " + ", ".join(f"m{a}{b} double" for a in XYZ for b in XYZ))
    for r in turns(df).collect():
        q = np.array([[r[f"q{a}{b}"] for b in XYZ] for a in XYZ])
        ref, own, best = want[r["frame"]]
        assert np.allclose(q @ q.T, np.eye(3), atol=1e-9) and np.linalg.det(q) == pytest.approx(1)
        assert ((own @ q.T) * ref).sum() == pytest.approx(best, rel=1e-6, abs=1e-12)


def test_distance_transform_of_many_lattices(spark):
    rng = random.Random(11)
    cells = [(k, x, y) for k in range(4) for x in range(9) for y in range(12) if (x + 3 * y + k) % 7]
    masks = [(k, x, y) for k, x, y in cells if k < 3 and rng.random() < 0.08] + [(0, 30, -4)]
    grid, mask = (spark.createDataFrame(v, "k int, gx int, gy int") for v in (cells, masks))
    out = gridops.mask_distance(grid, mask, 0.3, ("k",))
    got = {(r["k"], r["gx"], r["gy"]): r["dist"] for r in out.collect()}
    want = {(k, x, y): min(math.hypot((x - u) * 0.3, (y - v) * 0.3) for q, u, v in masks if q == k) for k, x, y in cells if k < 3}
    assert got == pytest.approx(want)
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_open_frames_without_a_timeline(spark):
    rng = random.Random(12)
    rows = [(rng.randrange(2), rng.randrange(2), rng.randrange(3), a, a + rng.randrange(6)) for a in rng.choices(range(30), k=25)]
    ev = spark.createDataFrame(rows, "gx int, gy int, lipid_nr int, bind_i int, bind_f int")
    frames = {(x, y): {f for p, q, _, a, b in rows if (p, q) == (x, y) for f in range(a, b + 1)} for x in (0, 1) for y in (0, 1)}
    got = {(r["gx"], r["gy"]): r["value"] for r in events.occupancy(ev, 40).collect()}
    assert got == pytest.approx({k: len(v) / 40 for k, v in frames.items() if v})
    counts = {r["frame"]: r["n"] for r in events.bound_counts(ev, 40).collect()}
    assert counts == {f: len({l for _, _, l, a, b in rows if a <= f <= b}) for f in range(40)}
    for out in (events.occupancy(ev, 40), events.bound_counts(ev, 40)):
        assert "sequence(" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_long_chain_is_mended_in_few_rounds(spark, monkeypatch):
    n, box = 700, (10.0, 10.0, 10.0)
    rng = random.Random(13)
    true, rows = [[0.0, 0.0, 0.0]], []
    for _ in range(n - 1):
        true.append([c + rng.uniform(-2, 2) for c in true[-1]])
    for frame in range(2):
        rows += [(frame, k, *[(c + frame) % 10.0 for c in p]) for k, p in enumerate(true)]
    df = spark.createDataFrame(rows, "frame int, atom_nr int, x double, y double, z double")
    bonds = spark.createDataFrame([(k + 1, k) for k in range(n - 1)], "a int, b int")
    written = []
    plain = transforms.checkpointed
    monkeypatch.setattr(transforms, "components", lambda b: spark.createDataFrame([(k, 0) for k in range(n)], "atom_nr int, molecule int"))
    monkeypatch.setattr(transforms, "checkpointed", lambda d: written.append(1) or plain(d))
    got = {(r["frame"], r["atom_nr"]): (r["x"], r["y"], r["z"]) for r in transforms.mend_bonds(df, bonds, box).collect()}
    assert len(written) <= 1 + 2 * math.ceil(math.log2(n))
    for frame in range(2):
        start = [(c + frame) % 10.0 for c in true[0]]
        for k in range(n):
            assert got[frame, k] == pytest.approx([s + t for s, t in zip(start, true[k])], abs=1e-6)


def snake(n):
    """A path one node wide that winds through an n x n lattice."""
    return [(x, y) for y in range(0, n, 2) for x in range(n)] + [(n - 1 if y % 4 == 1 else 0, y) for y in range(1, n - 1, 2)]


@pytest.mark.parametrize("side", [3, 8, 256])
def test_regions_are_those_of_a_walk(spark, side):
    rng = random.Random(14)
    cells = [(k, x, y) for k in range(3) for x in range(-5, 15) for y in range(20) if rng.random() < 0.42] + [(9, x, y) for x, y in snake(21)]
    left, groups = set(cells), []
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            k, x, y = todo.pop()
            seen.add((k, x, y))
            near = {(k, x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
            left -= near
            todo += near
        groups.append(frozenset(seen))
    df = spark.createDataFrame(cells, "k int, gx int, gy int")
    got = defaultdict(set)
    for r in gridops.regions(df, ("k",), side).collect():
        got[r["region"]].add((r["k"], r["gx"], r["gy"]))
    assert set(map(frozenset, got.values())) == set(groups)
    seeds = spark.createDataFrame([(9, 0, 0), (0, *cells[0][1:]), (1, 99, 99)], "k int, gx int, gy int")
    reached = {tuple(r) for r in gridops.grow(df, seeds, ("k",), side).collect()}
    assert reached == set().union(*(g for g in groups if (9, 0, 0) in g or cells[0] in g))


def test_rounds_of_a_long_walk_do_not_grow_with_its_side(spark, monkeypatch):
    written, plain = [], transforms.checkpointed
    monkeypatch.setattr(transforms, "checkpointed", lambda d: written.append(1) or plain(d))
    df = spark.createDataFrame(snake(61), "gx int, gy int")
    assert gridops.grow(df, df.filter("gx = 0 and gy = 0"), side=16).count() == len(snake(61))
    assert len(written) < 20  # a frontier would take some 1,900 rounds
