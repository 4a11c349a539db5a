"""Text files as numbered lines: a file is read in splits, and the lines of a split are numbered on from those of the splits before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.operators.transforms import checkpointed


def numbered(spark: SparkSession, path: str, across: bool = False) -> DataFrame:
    """(file, line, value) and the partition columns of path: line counts from 0 in each file, or with across over all files in the order of
    their names. Lines stay where they are read: of each split only its count and the number of its first line, one row, meet the others."""
    raw = spark.read.text(path).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    before = (Window.orderBy("file", "_block") if across else Window.partitionBy("file").orderBy("_block")).rowsBetween(Window.unboundedPreceding, -1)
    counts = checkpointed(raw.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first")))
    counts = counts.select("file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # ids count on along the lines of a split
    return raw.join(F.broadcast(counts), ["file", "_block"]).withColumn("line", F.col("_before") + F.col("_id") - F.col("_first")).drop("_block", "_id", "_first", "_before")
