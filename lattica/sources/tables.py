"""Topology and trajectory tables (S3, S4, S7, S11, S12): Parquet, laid out for frame and cell access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .connectors import CELL_SCHEMA, register


def load_topology(ref: DataFrame) -> DataFrame:
    """Static atom table of one reference frame, with ordinal: residues numbered 1, 2, .. by res_nr. The roster of residues is numbered, then joined."""
    ids = ref.select("res_nr").distinct().select("res_nr", F.row_number().over(Window.orderBy("res_nr")).alias("ordinal"))
    return ref.join(ids, "res_nr")


def with_topology(atoms: DataFrame, topology: DataFrame) -> DataFrame:
    """atoms with the static columns of topology; atoms that topology lacks fail the job."""
    cols = [c for c in topology.columns if c == "atom_nr" or c not in atoms.columns]
    j = atoms.join(topology.select(*cols, F.lit(1).alias("_known")), "atom_nr", "left")
    return j.filter(F.when(F.col("_known") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no topology for atom "), F.col("atom_nr"))).cast("boolean"))).drop("_known")


def write_frames(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """Frames in order: ranges of frames a file, atoms in order in a frame, so that a frame filter skips row groups."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, "frame", "atom_nr").sortWithinPartitions("frame", "atom_nr").write.mode("overwrite").parquet(path)


def write_events(ev: DataFrame, path: str, meta: DataFrame | None = None) -> None:
    """Events partitioned by gx: a cell is found by partition pruning and row-group statistics. meta: the run's header, one row
    (ef_dt, ef_frames, num_lipids, num_g_x, num_g_y, aps), beside them."""
    ev.repartition("gx").sortWithinPartitions("gx", "gy", "bind_i").write.mode("overwrite").partitionBy("gx").parquet(f"{path}/events")
    if meta is not None:
        meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/run_meta")


def run_meta(ev: DataFrame, dt: float, frames: int, grid: tuple[int, int], aps: float) -> DataFrame:
    """The header of a run, with the number of lipids that its events name."""
    fixed = {"ef_dt": float(dt), "ef_frames": int(frames), "num_g_x": int(grid[0]), "num_g_y": int(grid[1]), "aps": float(aps)}
    return ev.agg(F.countDistinct("lipid_nr").cast("int").alias("num_lipids")).select("num_lipids", *[F.lit(v).alias(k) for k, v in fixed.items()])


def read_run_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/run_meta")


def read_events(spark: SparkSession, path: str, x: int | None = None, y: int | None = None) -> DataFrame:
    """All events, or those of a column or cell; only its partition is read."""
    ev = spark.read.parquet(f"{path}/events")
    ev = ev.filter(F.col("gx") == x) if x is not None else ev
    return ev.filter(F.col("gy") == y) if y is not None else ev


def write_cells(ev: DataFrame, path: str, meta: DataFrame) -> None:
    """Events in files of cell after cell, each with the run's header (meta, one row): a file a column, with an index of its cells beside it. Cells without events are written, too.

    One exchange by column; a column is one task, and spills. A cell is counted in a window, as its number of events stands before them."""
    register(ev.sparkSession)
    cells = meta.select("*", F.explode(F.sequence(F.lit(0), F.col("num_g_x") - 1)).alias("gx")).select("*", F.explode(F.sequence(F.lit(0), F.col("num_g_y") - 1)).alias("gy"))
    rows = ev.join(cells, ["gx", "gy"], "right").repartition("gx")
    n = F.count("lipid_nr").over(Window.partitionBy("gx", "gy")).cast("int").alias("num_events")
    names = [c.split()[0] for c in CELL_SCHEMA.split(", ")]
    rows.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in CELL_SCHEMA.split(", ")], n).sortWithinPartitions("gx", "gy", "bind_i", "lipid_nr").select(*names, "num_events").write.format("cell_events").mode("overwrite").save(path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Events with their run's header, from files of cells (CELL_SCHEMA); filters on gx and gy read only those cells. Cells without events have no row."""
    register(spark)
    return spark.read.format("cell_events").load(path)


def write_timeline(tl: DataFrame, path: str) -> None:
    """Sparse timeline; timeline_text gives the dense form."""
    tl.write.mode("overwrite").parquet(path)


def timeline_text(tl: DataFrame, frames: DataFrame, lipids: DataFrame) -> DataFrame:
    """(frame, value): one line of 0/1 per frame, lipids in order."""
    n = tl.select("frame", "lipid_nr").distinct().withColumn("v", F.lit("1"))
    dense = frames.select("frame").crossJoin(F.broadcast(lipids.select("lipid_nr"))).join(n, ["frame", "lipid_nr"], "left")
    line = F.array_sort(F.collect_list(F.struct("lipid_nr", F.coalesce("v", F.lit("0")).alias("v"))))
    return dense.groupBy("frame").agg(F.concat_ws(" ", F.transform(line, lambda c: c["v"])).alias("value"))
