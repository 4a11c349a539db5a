"""Bounded labelled samples, shared by the operators that fit a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def labelled(docs: DataFrame, labels: DataFrame, label: str, bound: int, id_col: str = "doc_id", where: Column | None = None, text_col: str = "text") -> DataFrame:
    """(id, text, label) of at most bound labelled ids, the first by a hash of the id.

    A repeated label row counts once (the greatest label); null ids and labels are left out. The ids are at most bound, so they
    are broadcast; a document that is repeated comes back as often, for the caller to merge.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull())
    if where is not None:
        known = known.filter(where)
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(bound)
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col(id_col) == F.col("_id")).select(F.col(id_col).alias("doc_id"), "text", "label")
