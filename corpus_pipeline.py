"""A training corpus from raw documents: quality, near duplicates, secrets, mix, windows.

Each stage reads what its predecessor wrote; all but the last return the columns of documents. Columns beyond those that a stage
works on are carried as they are, whatever their names and types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import mixing, ngram_join, packing, quality, secrets
from lattica.llm.common import documents, labels, stash, stowed


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on their labels, takes for good; the others go."""
    model = quality.fit_on(docs, labels(spark, sf_dir))
    return docs.filter(quality.score_of(docs, model) >= 0.7)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the row with the least id, one without an id only where none has one, then by a hash of
    the whole row. Groups are of rows, by a key of all columns, as ids may be null or shared; whole rows that repeat are one."""
    packed, back = stowed(docs, ["doc_id", "text"])
    row = [F.col(c).cast("string") if c == "doc_id" else F.to_json(F.struct(c)) if c == "_rest" else F.col(c) for c in packed.columns]
    key = F.concat_ws(":", F.xxhash64(F.lit(1), *row), F.xxhash64(F.lit(2), *row))
    keyed = packed.withColumn("_id", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), key.alias("key")))
    chosen = ngram_join.join(keyed, "_id").select(F.col("component_id.key").alias("_key")).distinct()
    keyed = keyed.select("*", F.col("_id.key").alias("_key")).drop("_id")
    return back(keyed.join(stash(chosen), "_key", "left_semi").dropDuplicates(["_key"]))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with found secrets masked in text and n_chars counted anew."""
    packed, back = stowed(docs, ["doc_id", "text", "n_chars"])
    masked = secrets.redact(secrets.scan(packed))
    return back(masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their targets."""
    return mixing.mixed_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences."""
    return packing.pack(docs)


STAGES = [("quality_classifier", classify), ("ngram_jaccard_join", deduplicate), ("secret_scans", mask_secrets), ("source_mixing", mix_sources), ("packing", pack_windows)]

#: The classifier and the packing plan are no SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
