"""Means that lie on an edge, but for the last bits of their sums."""

from pyspark.sql import functions as F

from lattica.operators.rangejoin import lookup
from lattica.operators.stats import histogram

BELOW = 3.7499999999999996


def test_a_mean_on_a_step_reaches_it(spark):
    steps = spark.createDataFrame([(3.5, 1.0), (3.75, 2.0)], "thickness double, fe double")
    rows = spark.createDataFrame([(BELOW,), (3.75,), (3.7499,)], "value double")
    assert [r["fe"] for r in lookup(rows, steps, "value", "thickness", 9).orderBy(F.desc("value")).collect()] == [2.0, 2.0, 1.0]


def test_a_mean_on_an_edge_falls_into_the_bin_above(spark):
    rows = spark.createDataFrame([(BELOW,), (3.75,), (3.7499,)], "value double")
    counted = {r["bin"]: r["count"] for r in histogram(rows.union(spark.createDataFrame([(4.1,)], "value double")), "value", 0.25, digits=9).collect() if r["count"]}
    assert counted == {14: 1, 15: 2, 16: 1}
