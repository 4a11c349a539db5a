"""Copies of a place: the same results, from work that doesn't grow with their number."""

import pytest
from pyspark.sql import functions as F

from lattica.operators import lattice as la
from lattica.operators import observables as ob
from lattica.operators import rangejoin as rj
from lattica.operators import scanline
from lattica.operators.lattice import Lattice
from lattica.plans import fixtures
from lattica.plans.fixtures import Fixture

GRID = Lattice(0.5, (9, 9))
PLACES = [(0, 1.1, 1.3, 2.5), (0, 1.4, 1.3, -1.25), (1, 3.05, 2.2, None), (1, 3.0, 2.0, 7.0)]


def points(spark, copies):
    return spark.createDataFrame(PLACES, "frame int, x double, y double, value double").crossJoin(spark.range(copies).select(F.col("id").alias("_k"))).drop("_k")


def test_copies_are_stamped_once(spark):
    one = {tuple(r[k] for k in ("frame", "gx", "gy")): r for r in scanline.totals(points(spark, 1), GRID, 0.9, ("frame",), ("value",)).collect()}
    many = {tuple(r[k] for k in ("frame", "gx", "gy")): r for r in scanline.totals(points(spark, 1000), GRID, 0.9, ("frame",), ("value",)).collect()}
    assert many.keys() == one.keys() and len(one) > 20
    for k, r in one.items():
        assert (many[k]["n"], many[k]["n_value"]) == (1000 * r["n"], 1000 * r["n_value"])
        assert many[k]["value"] == (None if r["value"] is None else pytest.approx(1000 * r["value"], abs=1e-9))
    assert scanline.merged(points(spark, 1000), ("frame", "x", "y"), ("value",)).count() == len(PLACES)


def test_density_of_copies(spark):
    atoms = points(spark, 50).withColumns({"atom_nr": F.monotonically_increasing_id(), "n_atoms": F.lit(2)})
    total = la.density(atoms, GRID, 0.9, 2).agg(F.sum("value")).first()[0]
    assert total == pytest.approx(50 * len(PLACES) / (2 * 2))


def test_fixtures_are_dealt_to_tasks(spark, small, monkeypatch):
    monkeypatch.setattr(fixtures, "KEYS", 16)
    dealt, whole = Fixture(spark, small), 150 * 25 * 5
    assert dealt.atoms.count() == whole
    assert dealt.atoms.select(F.spark_partition_id()).distinct().count() > 4


def lipids(spark, copies):
    """Residues of two atoms at few places, copies of each."""
    rows = [(0, k * 10 + p, 0.5 * p + 0.3 * i, 0.2 * p, 0.7 * i) for k in range(copies) for p in range(4) for i in range(2)]
    return spark.createDataFrame(rows, "frame int, res_nr int, x double, y double, z double"), rows


def test_contacts_of_copies(spark):
    df, rows = lipids(spark, 5)
    got = {r["res_nr"]: (r["value"], r["molecules"]) for r in ob.contact_counts(df, df, 0.8).collect()}
    for n in {r[1] for r in rows}:
        met = [b[1] for a in rows for b in rows if a[1] == n != b[1] and sum((u - v) ** 2 for u, v in zip(a[2:], b[2:])) ** 0.5 < 0.8]
        assert got[n] == (len(met), len(set(met)))


def test_places_are_joined_not_rows(spark, monkeypatch):
    df, rows = lipids(spark, 40)
    joined, plain = [], rj.range_join
    monkeypatch.setattr(rj, "range_join", lambda a, b, *args, **kw: joined.append(plain(a, b, *args, **kw)) or joined[-1])
    got = {(r["res_nr"], r["x"], r["z"]): r["n"] for r in rj.count_near(df, df, 0.8, other="res_nr").collect()}
    assert joined[0].count() <= 8 * 8
    a = rows[9]
    assert got[a[1], a[2], a[4]] == sum(a[1] != b[1] and sum((u - v) ** 2 for u, v in zip(a[2:], b[2:])) ** 0.5 < 0.8 for b in rows)
    atoms = df.withColumns({"atom_nr": F.monotonically_increasing_id(), "atom_name": F.lit("P")})
    assert rj.plane_pair_counts(atoms, 0.5, 0.6).first()["n"] == plain_count(rj.plane_pairs(atoms, 0.5, 0.6))


def plain_count(df):
    return df.count()


def test_nearest_event_looks_ahead_in_one_pass(spark):
    events = spark.createDataFrame([(0, 0, 1, 17, "POPE", 0, 4, 5), (0, 0, 2, 27, "POPG", 6, 9, 4)], "gx int, gy int, lipid_nr int, res_nr int, res_name string, bind_i int, bind_f int, dwell int")
    found = rj.nearest_event(events)
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
    assert {r["lipid_nr"]: r["next_lipid"] for r in found.collect()} == {1: 2, 2: 2}


def molecules(spark, copies):
    """Residues of a donor, its hydrogen and an acceptor, at few places; copies of each."""
    rows = [(0, 3 * (k * 4 + p) + i, 0.4 * p + (0.0, 0.1, 0.3)[i], 0.05 * p * i, 0.1 * i) for k in range(copies) for p in range(4) for i in range(3)]
    atoms = spark.createDataFrame(rows, "frame int, atom_nr int, x double, y double, z double")
    ids = [3 * n for n in range(4 * copies)]
    bonds = spark.createDataFrame([(n, n + 1) for n in ids], "a int, b int")
    own = spark.createDataFrame([(n + 2, n) for n in ids], "a int, b int")
    part = lambda k: atoms.filter(F.col("atom_nr") % 3 == k)
    return part(2), part(0).withColumn("kind", F.lit("N")), bonds, part(1), 0.7, 60.0, own


def test_hydrogen_bonds_of_copies(spark):
    one = rj.hbonds(*molecules(spark, 1)).count()
    few, many = (molecules(spark, n) for n in (3, 30))
    pairs = {(r["acceptor"], r["donor"], r["hydrogen"]) for r in rj.hbonds(*few).collect()}
    rows = rj.hbond_groups(*few).collect()
    takers, givers = {}, {}
    for r in rows:
        if r["kind"] == "acceptor":
            takers.setdefault(r["acceptor"], []).append(r["member"])
        if r["kind"] == "donor":
            givers.setdefault((r["donor"], r["hydrogen"]), []).append((r["member"], r["member_hydrogen"]))
    not_bonds = {(r["acceptor"], r["donor"], r["hydrogen"]) for r in rows if r["kind"] == "excluded"}
    links = [r for r in rows if r["kind"] == "bonds"]
    assert {(a, *d) for r in links for a in takers[r["acceptor"]] for d in givers[r["donor"], r["hydrogen"]]} - not_bonds == pairs and not_bonds and len(pairs) > one
    assert sum(r["n"] for r in links) == len(pairs)
    counts = {r["atom_nr"]: r["n"] for r in rj.hbond_counts(*few, names=("kind",)).collect()}
    assert counts == {a: sum(p[0] == a for p in pairs) for a in {p[0] for p in pairs}}
    assert rj.hbond_groups(*many).count() < 4 * 30 * 4
    assert rj.hbonds(*many).count() > 4 * 30 * 30


def test_contacts_as_places_and_members(spark):
    df, rows = lipids(spark, 20)
    a, b = df.withColumn("atom_nr", F.col("res_nr") * 2), df
    got = rj.contact_groups(a, b, 0.8, "atom_nr", "res_nr").collect()
    met = sum(sum((u - v) ** 2 for u, v in zip(p[2:], q[2:])) ** 0.5 < 0.8 for p in rows for q in rows)
    assert sum(r["n"] or 0 for r in got) == met == rj.contacts(a, b, 0.8).count()
    assert sum(r["kind"] != "contacts" for r in got) == 2 * len(rows) and len(got) < met / 10
