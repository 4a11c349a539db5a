"""Results with a row for each pair: classes of copies are compared, and all pairs of their members are in the result."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lattica.operators import observables as ob
from lattica.operators import rangejoin as rj
from lattica.operators import series, tessellate, transforms

from test_copies import molecules


def cloud(spark, name, n, places, seed):
    """Rows of two frames at few places; some of a place are in one frame only."""
    rng = random.Random(seed)
    at = [[round(rng.uniform(0, 2), 2) for _ in range(3)] for _ in range(places)]
    rows = [(f, k, *at[(k + f * (k % 3)) % places]) for k in range(n) for f in (0, 1) if not (f == 1 and k % 7 == 0)]
    return spark.createDataFrame(rows, f"frame int, {name} int, x double, y double, z double"), rows


@pytest.mark.parametrize("chunk", [1024, 3])
def test_contact_rows_are_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(rj, "CHUNK", chunk)
    monkeypatch.setattr(rj, "PAIRS", 100)
    (a, ra), (b, rb) = cloud(spark, "atom_nr", 60, 5, 1), cloud(spark, "res_nr", 40, 4, 2)
    want = sorted((p[0], p[1], q[1]) for p in ra for q in rb if p[0] == q[0] and sum((u - v) ** 2 for u, v in zip(p[2:], q[2:])) ** 0.5 < 0.9)
    assert sorted(map(tuple, rj.contact_rows(a, b, 0.9, "atom_nr", "res_nr").collect())) == want and len(want) > 100


def test_contacts_are_a_row_a_pair(spark, small):
    assert __spark_entry__.queries()["j2_atom_contacts"](spark, small).columns == ["frame", "atom_nr", "res_nr"]


def test_hydrogen_bonds_are_a_row_a_bond(spark, small):
    assert __spark_entry__.queries()["j5_hydrogen_bonds"](spark, small).columns == ["frame", "acceptor", "donor", "hydrogen"]


@pytest.mark.parametrize("copies", [1, 3])
def test_hbond_rows_are_those_of_hbonds(spark, copies):
    given = molecules(spark, copies)
    plain, rows = (sorted(map(tuple, f(*given).collect())) for f in (rj.hbonds, rj.hbond_rows))
    assert rows == plain and len(rows) == len(set(rows)) > 0
    assert sorted(map(tuple, rj.hbond_rows(*given[:-1]).collect())) == sorted(map(tuple, rj.hbonds(*given[:-1]).collect()))
    assert rj.hbond_rows(given[0].union(given[0]), given[1].union(given[1]), *given[2:]).count() == len(rows)


def atoms(spark, n, places, seed):
    return cloud(spark, "atom_nr", n, places, seed)[0]


@pytest.fixture
def compared(monkeypatch):
    """Numbers of pairs that the joins by distance make."""
    seen, plain = [], rj.range_join
    counted = lambda *args, **kw: (out := plain(*args, **kw), seen.append(out.count()))[0]
    monkeypatch.setattr(rj, "range_join", counted)
    for module in (series, ob):
        monkeypatch.setattr(module, "range_join", counted)
    return seen


def same(got, want):
    plain = lambda df: {tuple(r)[:-1]: pytest.approx(tuple(r)[-1]) for r in df.collect()}
    return plain(got) == plain(want) and got.count() == want.count() > 20


def test_pairs_of_paths_stand_for_pairs_of_atoms(spark, compared):
    a, b = atoms(spark, 210, 5, 3), atoms(spark, 168, 4, 4)
    bound = spark.createDataFrame([(0, 1), (1, 1)], "frame int, lipid_nr int")
    freq = series.path_frequency(a, b, 0.9, 2)
    found = [r["frequency"] for r in freq.collect()]
    assert found == sorted(found, reverse=True)
    got = [freq, series.path_kinetics(a, b, 0.9, bound, 0), series.path_rmsf(a, b, 0.9, 2)]
    few, pairs = list(compared), series.contact_pairs(a, b, 0.9)
    want = [series.contact_frequency(pairs, 2), series.contact_kinetics(pairs, bound, 0), series.contact_rmsf(pairs, 2)]
    assert all(same(g, w) for g, w in zip(got, want))
    assert max(few) < pairs.count() / 10


@pytest.mark.parametrize("copies", [2, 40])
def test_bond_kinetics_of_paths(spark, compared, copies):
    acceptors, donors, bonds, hydrogens, *limits, own = molecules(spark, copies)
    bound = spark.createDataFrame([(0, 1)], "frame int, lipid_nr int")
    got = series.hbond_kinetics(acceptors, donors, bonds, hydrogens, *limits, own, bound, 0)
    few, p = list(compared), rj.hbonds(acceptors, donors, bonds, hydrogens, *limits, own).select("frame", F.col("acceptor").alias("i"), F.col("donor").alias("j"))
    want = series.contact_kinetics(p, bound, 0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 0
    assert max(few) <= 16


def test_contacts_by_bound_compare_places(spark, compared):
    (protein, rp), (lipids, rl) = cloud(spark, "res_nr", 60, 4, 5), cloud(spark, "res_nr", 200, 5, 6)
    bound = spark.createDataFrame([(0, 1), (1, 3)], "frame int, res_nr int")
    got = {r["res_nr"]: (r["bound"], r["other"]) for r in series.contacts_by_bound(protein, lipids, bound, 0.9, 2).collect()}
    met = [(p[1], (q[0], q[1]) in ((0, 1), (1, 3))) for p in rp for q in rl if p[0] == q[0] and sum((u - v) ** 2 for u, v in zip(p[2:], q[2:])) ** 0.5 < 0.9]
    assert got == {k: (met.count((k, True)) / 2, met.count((k, False)) / 2) for k in {r[1] for r in rp}}
    assert max(compared) <= 2 * 4 * 5


def within(p, q, cutoff):
    return p[0] == q[0] and sum((u - v) ** 2 for u, v in zip(p[2:], q[2:])) ** 0.5 < cutoff


def test_near_protein_compares_places(spark, compared):
    (protein, rp), (lipids, rl) = cloud(spark, "res_nr", 60, 4, 7), cloud(spark, "atom_nr", 200, 5, 8)
    got = sorted((r["frame"], r["res_nr"]) for r in tessellate.near_protein(protein, lipids, 0.8).collect())
    assert got == sorted(p[:2] for p in rp if any(within(p, q, 0.8) and abs(p[4] - q[4]) < 0.4 for q in rl)) and len(got) > 0
    assert max(compared) <= 2 * 4


def test_surface_residues_compare_places(spark, compared):
    (protein, rp), (lipids, rl) = cloud(spark, "res_nr", 60, 4, 9), cloud(spark, "atom_nr", 200, 5, 10)
    met = {p[:2] for p in rp if any(within(p, q, 0.9) for q in rl)}
    got = {r["res_nr"]: r["percent"] for r in series.surface_residues(protein, lipids, 0.9, 0.0, 2).collect()}
    assert got and all(v == 50.0 * sum(k == n for _, n in met) for k, v in got.items())
    assert max(compared) <= 2 * 4 * 5


def test_interdigitation_compares_places(spark, compared):
    (tails, rt), (other, ro) = cloud(spark, "atom_nr", 60, 4, 11), cloud(spark, "atom_nr", 200, 5, 12)
    named = other.withColumns({"res_name": F.lit("POPE"), "atom_name": F.concat(F.lit("C"), F.col("atom_nr") % 3)})
    ranks = spark.createDataFrame([("POPE", f"C{k}", 1.0 * k) for k in range(3)], "res_name string, atom_name string, rank double")
    got = {(r["frame"], r["atom_nr"]): r["value"] for r in ob.interdigitation(tails, named, 0.9, ranks).collect()}
    met = {p[:2]: [q[1] % 3 for q in ro if q[1] % 3 and within(p, q, 0.9)] for p in rt}
    assert got == {k: pytest.approx(sum(v) / len(v) if v else 0.0) for k, v in met.items()} and any(got.values())
    assert max(compared) <= 2 * 4 * 5


def test_rounds_of_mending_hold_shifted_atoms_only(spark, monkeypatch):
    rows = [(f, 8 * m + k, (9.0 if m == 0 else 1.0) + 0.3 * k - (10.0 if m == 0 and k > 3 else 0.0), 1.0, 1.0) for f in range(2) for m in range(10) for k in range(8)]
    df = spark.createDataFrame(rows, "frame int, atom_nr int, x double, y double, z double")
    bonds = spark.createDataFrame([(8 * m + k, 8 * m + k + 1) for m in range(10) for k in range(7)], "a int, b int")
    written, plain = [], transforms.checkpointed
    monkeypatch.setattr(transforms, "checkpointed", lambda t: written.append(t.count() if "ix" in t.columns else 0) or plain(t))
    got = {(r["frame"], r["atom_nr"]): r["x"] for r in transforms.mend_bonds(df, bonds, (10.0, 10.0, 10.0)).collect()}
    assert got == {(f, n): pytest.approx(x + (10.0 if 3 < n < 8 else 0.0)) for f, n, x, _, _ in rows}
    assert 0 < max(written) <= 2 * 4
