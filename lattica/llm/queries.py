"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, htmltext, merkle, mixing, ngram_join, packing, passages, quality, rules, search, secrets, sharding, toxicity
from .common import documents, labels


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op2_isolation_forest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return rules.judge(docs, rules.fit_on(docs, labels(spark, sf_dir)))


def op3_html_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return htmltext.extract(pages)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = quality.fit_on(docs, labels(spark, sf_dir), where=quality.training_rows())
    held = quality.fold("doc_id", 4) == 2
    return quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op5_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two increments: the older half of the ids as an earlier state of the table, then all of it, of which only unseen blobs are scanned;
    every row's findings come from the ledger."""
    docs, ledger = documents(spark, sf_dir).select("doc_id", "text"), secrets.Ledger(spark)
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is not None:
        secrets.record(docs.filter(F.col("doc_id") <= (low + high) // 2), ledger)
    return secrets.digest(secrets.scan(docs, ledger))


def op6_ngram_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir))


def op7_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir).select("doc_id", "text"))


def op8_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir).select("doc_id", "text"))


def op9_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    weights = toxicity.fit_on(docs, labels(spark, sf_dir), where=toxicity.training_rows())
    held = toxicity.fold("doc_id", 3) == 1
    return toxicity.score(docs, weights).select("doc_id", held.alias("held_out"), "score", "predicted")


def op10_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir).select("doc_id", "text"))


def op11_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.digest(passages.dedup(documents(spark, sf_dir).select("doc_id", "text")))


def op12_shared_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return search.search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(documents(spark, sf_dir), merkle.tampered())


QUERIES = {f.__name__: f for f in (op1_mixing, op2_isolation_forest_rules, op3_html_block_rules, op4_quality_classifier, op5_secret_ledger, op6_ngram_trie_join, op7_histogram_shards, op8_weighted_fingerprints, op9_ftrl_toxicity, op10_slack_packing, op11_phrase_automata, op12_shared_search, op13_merkle_manifest)}

ORACLE_SQL = {"op1_mixing": mixing.ORACLE, "op5_secret_ledger": secrets.ORACLE, "op6_ngram_trie_join": ngram_join.ORACLE, "op7_histogram_shards": sharding.ORACLE, "op12_shared_search": search.ORACLE, "op13_merkle_manifest": merkle.ORACLE}
