"""Lattice and column text sources and sinks (S5, S6, S9, S10). A lattice is (gx, gy, value), null as mask."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import numbered


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line) and the partition columns of text files; pos is the line's number in its file."""
    rows = numbered(spark, path).withColumnsRenamed({"line": "pos", "value": "line"}).drop("file")
    return rows.filter(F.trim("line") != "")


def _number(token):
    return F.when(F.lower(token) == "nan", None).otherwise(token.try_cast("double"))


def read_grid(spark: SparkSession, path: str, fmt: str = "matrix", cell: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """matrix: a line per gy with a value per gx; vector: lines of x y value, nodes at multiples of cell. NaN is null. by: partition columns
    of path, each lattice in a folder of its own."""
    tokens = _lines(spark, path).select(*by, "pos", F.split(F.trim("line"), r"\s+").alias("t"))
    if fmt == "matrix":
        rows = tokens.select(*by, F.col("pos").cast("int").alias("gy"), F.posexplode("t").alias("gx", "v"))
        return rows.select(*by, "gx", "gy", _number(F.col("v")).alias("value"))
    node = lambda k: F.round(F.col("t")[k].cast("double") / cell).cast("int")
    return tokens.select(*by, node(0).alias("gx"), node(1).alias("gy"), _number(F.col("t")[2]).alias("value"))


def read_columns(spark: SparkSession, path: str, headers: int = 0) -> DataFrame:
    """(pos, tokens, values) of column files after the header lines of each: tokens as they stand, values as numbers (null if none)."""
    rows = _lines(spark, path).filter(F.col("pos") >= headers)
    t = F.split(F.trim("line"), r"\s+")
    return rows.select((F.col("pos") - headers).alias("pos"), t.alias("tokens"), F.transform(t, lambda x: x.try_cast("double")).alias("values"))


def grid_text(lattice: DataFrame, fmt: str = "matrix", cell: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, gy, value) lines of a matrix, or (by, gy, gx, value) lines of a vector; masked nodes are NaN."""
    v = F.coalesce(F.col("value").cast("string"), F.lit("NaN"))
    if fmt == "vector":
        return lattice.select(*by, "gy", "gx", F.concat_ws(" ", F.col("gx") * cell, F.col("gy") * cell, v).alias("value"))
    line = F.array_sort(F.collect_list(F.struct("gx", v.alias("v"))))
    return lattice.groupBy(*by, "gy").agg(F.concat_ws(" ", F.transform(line, lambda c: c["v"])).alias("value"))


def write_grid(lattice: DataFrame, path: str, fmt: str = "parquet", cell: float = 1.0, by: tuple[str, ...] = ()) -> None:
    """parquet, matrix or vector, with a folder for each value of the columns in by (a frame, a run). Text lines are in order; a matrix names
    no nodes, so that one lattice is one file, and lattices are dealt to tasks by by."""
    if fmt == "parquet":
        w = lattice.write.mode("overwrite")
        (w.partitionBy(*by) if by else w).parquet(path)
        return
    keys = [*by, "gy", *(["gx"] if fmt == "vector" else [])]
    lines = grid_text(lattice, fmt, cell, by)
    lines = (lines.repartition(*by) if by else lines.coalesce(1)).sortWithinPartitions(*keys).select(*by, "value")
    w = lines.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).text(path)


def volume_text(lattice3: DataFrame, counts: tuple[int, int, int], cell: float, ex_val: float) -> DataFrame:
    """(part, gx, gy, gz, value): lines of a regular-positions field: its header with counts, origin and spacing, one value a line with gz
    fastest and ex_val for masked nodes, its closing lines. lattice3 has a row for every node."""
    nx, ny, nz = counts
    head = [f"object 1 class gridpositions counts {nx} {ny} {nz}", "origin 0.0 0.0 0.0", f"delta {cell} 0.0 0.0", f"delta 0.0 {cell} 0.0", f"delta 0.0 0.0 {cell}", f"object 2 class gridconnections counts {nx} {ny} {nz}", f"object 3 class array type double rank 0 items {nx * ny * nz} data follows"]
    tail = ['attribute "dep" string "positions"', 'object "regular positions regular connections" class field', 'component "positions" value 1', 'component "connections" value 2', 'component "data" value 3']
    ends = lattice3.sparkSession.createDataFrame([(0, 0, 0, 0, "\n".join(head)), (2, 0, 0, 0, "\n".join(tail))], "part int, gx int, gy int, gz int, value string")
    v = F.coalesce("value", F.lit(float(ex_val))).cast("string")
    return lattice3.select(F.lit(1).alias("part"), *[F.col(c).cast("int").alias(c) for c in ("gx", "gy", "gz")], v.alias("value")).unionByName(ends)


def write_volume(lattice3: DataFrame, path: str, ex_val: float, text: bool = False, counts: tuple[int, int, int] | None = None, cell: float = 1.0) -> None:
    """A 3D lattice with ex_val in masked nodes: Parquet, or the field's text in files that follow one another by name."""
    if not text:
        lattice3.withColumn("value", F.coalesce("value", F.lit(float(ex_val)))).write.mode("overwrite").parquet(path)
        return
    counts = counts or tuple(n + 1 for n in lattice3.agg(*[F.max(c) for c in ("gx", "gy", "gz")]).first())
    volume_text(lattice3, counts, cell, ex_val).orderBy("part", "gx", "gy", "gz").select("value").write.mode("overwrite").text(path)


def read_volume(spark: SparkSession, path: str) -> DataFrame:
    """(gx, gy, gz, x, y, z, value) of a field's text: counts, origin and spacing are its header's, values follow the line that says so, any
    number on a line. A folder's files are one text, in the order of their names."""
    rows = numbered(spark, path, across=True).select("line", F.trim("value").alias("value"))
    head = rows.filter(F.col("value").rlike("^(object 1 .*counts|origin|delta|object 3 .*data follows)"))
    found = [(r["line"], r["value"].split()) for r in head.orderBy("line").limit(6).collect()]
    counts = [int(n) for n in found[0][1][-3:]]
    origin = [float(v) for v in found[1][1][1:]]
    cell = [float(found[2 + k][1][1 + k]) for k in range(3)]
    nx, ny, nz = counts
    data = rows.filter((F.col("line") > found[5][0]) & F.col("value").rlike(r"^[-+0-9.]|^(?i:nan|inf)"))
    data = data.withColumn("t", F.split("value", r"\s+"))
    width = data.filter(F.col("line") == found[5][0] + 1).select(F.size("t")).first()
    data = data.select(((F.col("line") - found[5][0] - 1) * (width[0] if width else 1)).alias("first"), F.posexplode("t").alias("k", "v"))
    at = F.col("first") + F.col("k")
    nodes = {"gx": F.floor(at / (ny * nz)), "gy": F.floor(at / nz) % ny, "gz": at % nz}
    out = data.filter(at < nx * ny * nz).select(*[e.cast("int").alias(c) for c, e in nodes.items()], _number(F.col("v")).alias("value"))
    return out.select("gx", "gy", "gz", *[(F.col(f"g{c}") * cell[k] + origin[k]).alias(c) for k, c in enumerate("xyz")], "value")
