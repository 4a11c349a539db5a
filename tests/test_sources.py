"""Round trips of sources and sinks."""

from pyspark.sql import functions as F

from lattica.operators.lattice import Lattice
from lattica.sources import grids, structures, tables


def pdb(frame, shift):
    atom = "ATOM  {0:5d} {1:<4s} {2:<3s} {3}{4:4d}    {5:8.3f}{6:8.3f}{7:8.3f}{8:6.2f}{9:6.2f}          {10:>2s}"
    rows = [atom.format(k, "PO4", "POP", "A", k, 1.5 * k + shift, 2.0, -3.25, 1.0, 12.5, "P") for k in (1, 2)]
    return "\n".join([f"MODEL     {frame + 1:4d}", "CRYST1   20.000   21.000   22.000  90.00  90.00  90.00 P 1           1", *rows, "TER", "ENDMDL"])


def test_pdb(spark, tmp_path):
    (tmp_path / "a.pdb").write_text("\n".join(pdb(f, f * 0.5) for f in range(3)) + "\nEND\n")
    got = structures.read_pdb(spark, str(tmp_path / "a.pdb")).orderBy("frame", "atom_nr").collect()
    assert [(r["frame"], r["atom_nr"], r["x"]) for r in got] == [(f, k, 1.5 * k + 0.5 * f) for f in range(3) for k in (1, 2)]
    assert (got[0]["atom_name"], got[0]["res_name"], got[0]["chain"], got[0]["element"], got[0]["beta"], got[0]["z"], got[0]["by"]) == ("PO4", "POP", "A", "P", 12.5, -3.25, 21.0)


def test_gro(spark, tmp_path):
    def frame(f, velocity):
        lines = [f"{k:5d}{'POPE':<5s}{'PO4':>5s}{k:5d}{k + f:8.3f}{0.5:8.3f}{1.25:8.3f}" + (f"{0.1:8.4f}{0.2:8.4f}{0.3:8.4f}" if velocity else "") for k in (1, 2)]
        return "\n".join([f"frame {f}", "    2", *lines, "  10.0 11.0 12.0"])

    (tmp_path / "a.gro").write_text(frame(0, True) + "\n" + frame(1, False) + "\n")
    (tmp_path / "b.gro").write_text(frame(5, False) + "\n")
    got = structures.read_gro(spark, str(tmp_path / "*.gro")).collect()
    assert len(got) == 6
    a = sorted((r["frame"], r["atom_nr"], r["x"], r["vx"], r["bx"]) for r in got if r["file"].endswith("a.gro") and r["atom_nr"] == 1)
    assert a == [(0, 1, 1.0, 0.1, 10.0), (1, 1, 2.0, None, 10.0)]


def test_gro_boxes_and_counts(spark, tmp_path):
    import pytest

    atom = f"{1:5d}{'POPE':<5s}{'PO4':>5s}{1:5d}{1.0:8.3f}{0.5:8.3f}{1.25:8.3f}"
    (tmp_path / "t.gro").write_text(f"tilted t= 2.5 step= 7\n    1\n{atom}\n 9.0 8.0 7.0 0.1 0.2 0.3 0.4 0.5 0.6\n\n")
    got = structures.read_gro(spark, str(tmp_path / "t.gro")).collect()
    assert [[r[c] for c in ("time", "step", *structures.BOX)] for r in got] == [[2.5, 7, 9.0, 8.0, 7.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6]]
    (tmp_path / "u.gro").write_text(f"a\n    1\n{atom}\n 9 8 7\nb\n    2\n{atom}\n{atom}\n 9 8 7\n")
    with pytest.raises(Exception, match="number of atoms changes"):
        structures.read_gro(spark, str(tmp_path / "u.gro")).collect()


def test_lines_are_numbered_over_splits(spark, tmp_path):
    from lattica.sources.lines import numbered

    for name, n in (("a.txt", 500), ("b.txt", 300)):
        (tmp_path / name).write_text("\n".join(f"{name} {k}" for k in range(n)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        own = {r["value"]: r["line"] for r in numbered(spark, str(tmp_path)).collect()}
        across = {r["value"]: r["line"] for r in numbered(spark, str(tmp_path), across=True).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert own == {f"{name} {k}": k for name, n in (("a.txt", 500), ("b.txt", 300)) for k in range(n)}
    assert across == {f"{name} {k}": k + at for name, n, at in (("a.txt", 500, 0), ("b.txt", 300, 500)) for k in range(n)}


def test_grid_text(spark, tmp_path):
    lat = Lattice(0.5, (4, 3)).nodes(spark).withColumn("value", F.when(F.col("gx") != F.col("gy"), F.col("gx") + F.col("gy") / 10.0))
    want = sorted(map(str, lat.select("gx", "gy", "value").collect()))
    for fmt in ("matrix", "vector"):
        path = str(tmp_path / fmt)
        grids.write_grid(lat, path, fmt, 0.5)
        got = grids.read_grid(spark, path, fmt, 0.5)
        assert sorted(map(str, got.select("gx", "gy", "value").collect())) == want
    grids.write_grid(lat.withColumn("frame", F.lit(3)), str(tmp_path / "p"), by=("frame",))
    assert spark.read.parquet(str(tmp_path / "p")).filter("frame = 3").count() == 12


def test_volume(spark, tmp_path):
    lat = Lattice(1.0, (2, 2, 2)).nodes(spark).withColumn("value", F.when(F.col("gz") == 0, 1.5))
    grids.write_volume(lat, str(tmp_path / "v"), -1.0)
    assert spark.read.parquet(str(tmp_path / "v")).agg(F.sum("value")).first()[0] == 4 * 1.5 - 4
    grids.write_volume(lat, str(tmp_path / "t"), -1.0, text=True)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()].count("-1.0") == 4
    got = {(r["gx"], r["gy"], r["gz"]): r["value"] for r in grids.read_volume(spark, str(tmp_path / "t")).collect()}
    assert got == {(x, y, z): -1.0 if z else 1.5 for x in (0, 1) for y in (0, 1) for z in (0, 1)}
    (tmp_path / "w.dx").write_text("object 1 class gridpositions counts 1 2 2\norigin 1 2 3\ndelta 0.5 0 0\ndelta 0 0.5 0\ndelta 0 0 2\nobject 2 class gridconnections counts 1 2 2\nobject 3 class array type double rank 0 items 4 data follows\n1 2 3\n4\n")
    got = sorted((r["y"], r["z"], r["value"]) for r in grids.read_volume(spark, str(tmp_path / "w.dx")).collect())
    assert got == [(2.0, 3.0, 1.0), (2.0, 5.0, 2.0), (2.5, 3.0, 3.0), (2.5, 5.0, 4.0)]


def test_columns(spark, tmp_path):
    (tmp_path / "c.dat").write_text("# head\n# more\n1 2.5 NaN\n2 x 4\n")
    got = grids.read_columns(spark, str(tmp_path / "c.dat"), 2).orderBy("pos").collect()
    assert got[0]["tokens"] == ["1", "2.5", "NaN"] and got[1]["values"] == [2.0, None, 4.0] and [r["pos"] for r in got] == [0, 1]


def test_events_are_pruned_by_cell(spark, tmp_path):
    ev = spark.createDataFrame([(x, y, 1, 17, "A", 0, 4, 5) for x in range(3) for y in range(3)], "gx int, gy int, lipid_nr int, res_nr int, res_name string, bind_i int, bind_f int, dwell int")
    tables.write_events(ev, str(tmp_path / "ev"))
    df = tables.read_events(spark, str(tmp_path / "ev"), 1, 2)
    assert df.count() == 1 and "PartitionFilters: [isnotnull(gx" in df._jdf.queryExecution().executedPlan().toString()


def test_frames_stay_in_order(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 10).cast("int").alias("frame"), F.floor(F.col("id") / 10).cast("int").alias("atom_nr"), F.rand(1).alias("x"))
    tables.write_frames(df, str(tmp_path / "f"), 4)
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "f")).select("frame", "atom_nr").collect()]
    assert len(got) == 1000


def test_timeline_text(spark, tmp_path):
    tl = spark.createDataFrame([(0, 1), (2, 0), (2, 1)], "frame int, lipid_nr int")
    frames, lipids = (spark.range(n).select(F.col("id").cast("int").alias(c)) for n, c in ((3, "frame"), (2, "lipid_nr")))
    got = {r["frame"]: r["value"] for r in tables.timeline_text(tl, frames, lipids).collect()}
    assert got == {0: "0 1", 1: "0 0", 2: "1 1"}


def test_topology_has_to_know_all_atoms(spark):
    import pytest

    ref = spark.createDataFrame([(1, 5, "A"), (2, 9, "B")], "atom_nr int, res_nr int, res_name string")
    t = tables.load_topology(ref)
    assert {r["res_nr"]: r["ordinal"] for r in t.collect()} == {5: 1, 9: 2}
    with pytest.raises(Exception, match="no topology"):
        tables.with_topology(spark.createDataFrame([(3, 0.5)], "atom_nr int, x double"), t).collect()


def test_frames_that_lie_in_several_files(spark, tmp_path):
    rows = [(f, a, a, "POPE", "PO4", a / 8, f / 4, 1.5) for f in range(3) for a in range(9000)]
    df = spark.createDataFrame(rows, "frame int, atom_nr int, res_nr int, res_name string, atom_name string, x double, y double, z double")
    for fmt, read in (("pdb", structures.read_pdb), ("gro", structures.read_gro)):
        path = str(tmp_path / fmt)
        structures.write_text_frames(df, path, fmt, (20.0, 21.0, 22.0), partitions=8, whole=False)
        assert len([p for p in (tmp_path / fmt).iterdir() if p.name.startswith("part-") and p.stat().st_size]) > 3
        got = read(spark, path, across=True).select("frame", "atom_nr", "x", "y", "by").collect()
        assert {(r[0], r[1], r[2], r[3]) for r in got} == {(r[0], r[1], r[5], r[6]) for r in rows} and len(got) == len(rows) and {r["by"] for r in got} == {21.0}
    plan = structures.read_pdb(spark, str(tmp_path / "pdb"), across=True)._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan and "collect_list" not in plan  # lines aren't numbered by a sort, and no row holds a frame


def test_text_is_not_dealt_out_to_be_read(spark, tmp_path):
    rows = [(f, a, a, "POPE", "PO4", a / 8, f / 4, 1.5) for f in range(3) for a in range(500)]
    df = spark.createDataFrame(rows, "frame int, atom_nr int, res_nr int, res_name string, atom_name string, x double, y double, z double")
    structures.write_text_frames(df, str(tmp_path / "pdb"), "pdb", (20.0, 21.0, 22.0), partitions=4, whole=False)
    assert all(p.name.endswith(".gz") for p in (tmp_path / "pdb").glob("part-*"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = structures.read_pdb(spark, str(tmp_path / "pdb"), across=True)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        assert got.count() == len(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
