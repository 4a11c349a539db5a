"""Steps whose rows are to be dealt out once, and whose tasks are to hold a bounded part of a series."""

import random

import pytest
from pyspark.sql import functions as F

from lattica.operators import blocks, lattice, scanline, windows
from lattica.operators.lattice import Lattice


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def series(spark, n=200):
    rng = random.Random(5)
    return spark.createDataFrame([(k, f, rng.choice([None, rng.randrange(5)])) for k in (1, 2, None) for f in range(n)], "k int, frame int, v int")


def test_blocks_get_their_carry_as_a_row_and_not_by_a_join(spark):
    out = blocks.scan(series(spark), ["k"], "frame", sums={"total": F.col("v")}, lasts={"known": F.col("v")}, previous={"was": F.col("v")}, following="next", block=7)
    assert "Join" not in plan(out) and "SortAggregate" not in plan(out)
    assert out.count() == 600 and out.columns == ["k", "frame", "v", "total", "known", "was", "next"]


def test_carries_keep_values_that_are_null(spark):
    df = spark.createDataFrame([(1, 0, 4), (1, 6, None), (1, 7, 5), (1, 21, None)], "k int, frame int, v int")
    out = blocks.scan(df, ["k"], "frame", lasts={"known": F.col("v")}, previous={"was": F.col("v")}, following="next", block=7)
    assert [tuple(r)[1:] for r in out.orderBy("frame").collect()] == [(0, 4, 4, None, 6), (6, None, 4, 4, 7), (7, 5, 5, None, 21), (21, None, 5, 5, None)]


@pytest.mark.parametrize("block", [7, 1000])
def test_a_frame_is_one_row_of_the_scan_for_both_directions(spark, monkeypatch, block):
    sizes, plain = [], blocks.scan
    monkeypatch.setattr(blocks, "scan", lambda df, *a, **k: sizes.append(df.count()) or plain(df, *a, **k))
    out = windows.state_fold(series(spark).select("k", "frame", F.col("v").alias("state")), "k", "state", 2, block)
    assert sizes == [600] and {r["direction"] for r in out.collect()} == {"down", "up"}


def spread(rows, grid, radius, frames):
    """The density by single nodes: an atom's share goes to each node that any of its rows covers, as often as they do."""
    covers = lambda x, y: [(i, j) for i in range(grid.n[0]) for j in range(grid.n[1]) if ((i * grid.cell - x) ** 2 + (j * grid.cell - y) ** 2) ** 0.5 <= radius]
    nodes, out = {}, {}
    for frame, nr, x, y, _ in rows:
        nodes.setdefault((frame, nr), []).extend(covers(x, y))
    for frame, nr, x, y, size in rows:
        for node in covers(x, y):
            out[node] = out.get(node, 0.0) + 1 / (len(nodes[frame, nr]) * frames * size)
    return out


def test_atoms_of_one_place_are_summed_before_they_are_dealt_out(spark, monkeypatch):
    rng, grid = random.Random(6), Lattice(0.5, (13, 13))
    places = [(rng.uniform(-1, 7), rng.uniform(-1, 7)) for _ in range(6)]
    rows = [(nr % 3, nr, *places[nr % 6], 2 + nr % 2) for nr in range(300)]
    several = [(0, 900, *places[0], 2), (0, 900, *places[0], 2), (0, 900, *places[1], 3), (1, 900, *places[1], 2), (0, 901, 50.0, 50.0, 2), (0, 901, *places[2], 2)]
    sizes, plain = [], scanline.merged
    monkeypatch.setattr(scanline, "merged", lambda df, *a: sizes.append(df.count()) or plain(df, *a))
    for extra in ([], several):
        df = spark.createDataFrame(rows + extra, "frame int, atom_nr int, x double, y double, n_atoms int")
        got = {(r["gx"], r["gy"]): r["value"] for r in lattice.density(df, grid, 0.8, 3).collect()}
        want = spread(rows + extra, grid, 0.8, 3)
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert sizes[0] <= 2 * len(places) and sizes[1] <= 2 * len(places) + len(several)
