"""Histograms, moments, regression, table averages (H1-H5), and the free-energy profile of a sample (G2)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GAS_CONSTANT = 0.0083144621


def histogram(values: DataFrame, column: str, width: float, low: float | None = None, high: float | None = None, digits: int | None = None) -> DataFrame:
    """(bin, left, count, p): half-open bins k * width from floor(min(0, data) / width), ceil(range / width) of them.

    The range includes 0, and the greatest value may fall beyond the last bin; p still divides by all samples. low and high force the range.
    digits: value / width is rounded to so many digits, so that means that lie on an edge fall into the bin above it, however they were summed up."""
    places = lambda c: c / width if digits is None else F.round(c / width, digits)
    ends = values.agg(F.least(F.lit(0.0), F.min(column)).alias("lo"), F.greatest(F.lit(0.0), F.max(column)).alias("hi"), F.count(column).alias("n"))
    if low is not None and high is not None:
        ends = ends.withColumns({"lo": F.lit(float(low)), "hi": F.lit(float(high))})
    ends = ends.filter("n > 0").select("n", F.floor(places(F.col("lo"))).cast("int").alias("first"), F.ceil(places(F.col("hi") - F.col("lo"))).cast("int").alias("bins"))
    bins = ends.filter("bins > 0").select("n", F.explode(F.expr("sequence(first, first + bins - 1)")).alias("bin"))
    counts = values.groupBy(F.floor(places(F.col(column))).cast("int").alias("bin")).agg(F.count(column).alias("count"))
    full = bins.join(counts, "bin", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return full.select("bin", (F.col("bin") * F.lit(width)).alias("left"), "count", (F.col("count") / F.col("n")).alias("p"))


def free_energy(values: DataFrame, column: str, width: float, temperature: float) -> DataFrame:
    """Histogram with f = -kT ln p (kJ/mol) and f shifted to 0 at the modal bin; null in empty bins."""
    h = histogram(values, column, width)
    kt = GAS_CONSTANT * temperature
    p = F.when(F.col("count") > 0, F.col("p"))
    most = h.agg(F.max("p").alias("_most"))
    return h.crossJoin(F.broadcast(most)).select("bin", "left", "count", "p", (-kt * F.log(p)).alias("f"), (-kt * F.log(p / F.col("_most"))).alias("f_shifted"))


def moments(values: DataFrame, column: str, *by: str) -> DataFrame:
    """Mean and standard deviation (n - 1)."""
    return values.groupBy(*by).agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"), F.count(column).alias("n"))


def ols(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def polar_histogram(angles: DataFrame, d_theta: float, d_phi: float) -> DataFrame:
    """Percent of samples in each occupied (theta, phi) cell, half-open."""
    total = Window.partitionBy()
    cells = angles.groupBy(F.floor(F.col("theta") / d_theta).cast("int").alias("i_theta"), F.floor(F.col("phi") / d_phi).cast("int").alias("i_phi")).agg(F.count("*").alias("count"))
    return cells.withColumn("percent", 100.0 * F.col("count") / F.sum("count").over(total))


def average_tables(tables: list[DataFrame], pos: str = "pos") -> DataFrame:
    """Cellwise mean of tables of one shape, by row position and column."""
    rows = reduce(DataFrame.unionByName, tables)
    return rows.groupBy(pos).agg(*[F.avg(c).alias(c) for c in rows.columns if c != pos])
