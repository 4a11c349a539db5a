"""Queries against plain Python over the whole of their tables."""

from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__  # noqa: F401  (registers the queries)
from lattica.plans import registry
from lattica.plans.fixtures import Fixture
from lattica.plans.lattices import sites


def test_occupancy_is_a_share_of_the_table_s_frames(spark):
    folder = "/root/testdata/sf0.01"
    fx, held = Fixture(spark, folder), defaultdict(set)
    for r in fx.events.collect():
        held[r["gx"], r["gy"]].update(range(r["bind_i"], r["bind_f"] + 1))
    frames = fx.table("customer").count()
    got = {(r["gx"], r["gy"]): r["value"] for r in registry.QUERIES["k17_occupancy"](spark, folder).collect()}
    assert got == pytest.approx({k: len(v) / frames for k, v in held.items()}, abs=1e-6) and max(got.values()) <= 1


def test_tessellation_takes_all_upper_heads(spark, small):
    fx, heads = Fixture(spark, small), defaultdict(list)
    for r in fx.heads.filter("leaflet = 1").collect():
        heads[r["frame"]].append((r["res_nr"], r["x"], r["y"]))
    assert Counter(r["frame"] for r in sites(fx).collect()) == {f: len(h) for f, h in heads.items()}
    want = {}
    for frame, found in heads.items():
        for gx in range(11):
            for gy in range(11):
                want[frame, gx, gy] = min((((gx * 2.0 - x) * (gx * 2.0 - x) + (gy * 2.0 - y) * (gy * 2.0 - y)) ** 0.5, n) for n, x, y in found)[1]
    got = {(r["frame"], r["gx"], r["gy"]): r["res_nr"] for r in registry.QUERIES["l11_tessellate"](spark, small).collect()}
    assert got == want


def test_merge_keeps_all_events(spark, small):
    cols = ["gx", "gy", "res_nr", "res_name", "bind_i", "bind_f", "dwell"]
    events = Fixture(spark, small).events.collect()
    got = registry.QUERIES["k16_merge"](spark, small).collect()
    assert Counter(tuple(r[c] for c in cols) for r in got) == Counter(tuple(r[c] for c in cols) for r in events)
    first = {r["lipid_nr"] for r in events if r["gx"] <= 2}
    moved = {r["lipid_nr"] for r in got if r["gx"] > 2}
    assert {r["lipid_nr"] for r in got if r["gx"] <= 2} == first and min(moved) > max(first)


def test_average_of_all_frames(spark, small):
    rows = defaultdict(list)
    for r in Fixture(spark, small).atoms.collect():
        rows[r["atom_nr"]].append((r["x"], r["z"]))
    got = {r["pos"]: (r["x"], r["z"]) for r in registry.QUERIES["h5_average_tables"](spark, small).collect()}
    assert got.keys() == rows.keys()
    for k, v in rows.items():
        assert got[k] == pytest.approx([sum(c) / len(v) for c in zip(*v)], abs=1e-6)


def test_rmsd_after_a_fit_of_another_group(spark, small):
    frames = defaultdict(dict)
    for r in Fixture(spark, small).heads.collect():
        frames[r["frame"]][r["atom_nr"]] = (r["res_nr"], r["leaflet"], r["mass"], r["x"], r["y"], r["z"])
    keys = sorted(frames[0])
    table = {f: np.array([rows[k] for k in keys]) for f, rows in frames.items()}
    fit, measured = table[0][:, 0] % 7 == 0, table[0][:, 1] == 1
    want = {}
    for f, t in table.items():
        m, a, b = t[fit, 2], t[:, 3:], table[0][:, 3:]
        ca, cb = np.average(a[fit], axis=0, weights=m), np.average(b[fit], axis=0, weights=m)
        u, _, vt = np.linalg.svd((a[fit] - ca).T @ ((b[fit] - cb) * m[:, None]))
        turned = (a - ca) @ u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt + cb
        want[f] = np.sqrt(((turned - b)[measured] ** 2).sum(axis=1).mean())
    got = {r["frame"]: r["rmsd"] for r in registry.QUERIES["t7_rmsd_series"](spark, small).collect()}
    assert got == pytest.approx(want, abs=2e-6) and max(got.values()) > 0.1
