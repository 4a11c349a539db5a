"""Secret scans by an incremental blob ledger, in DataFrame functions only.

Each version of a text is addressed by the SHA-256 of its content; only blobs that the ledger does not hold for the current
rule version are scanned, once each; findings are then joined back to every path (document) with that content.
Copies meet in a map-side aggregate before they are dealt out, so that a group of copies of any size costs one scan.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_dir, stowed

#: Kind, pattern, pattern that every kept match also meets, group that is measured, its least length.
RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", r"[0-9a-f]{32,}", 0, 32),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)
BASE = ("assign", "access", "hex")
RULE_VERSION = "rules-1"


def address(text: str) -> Column:
    """Content address; null counts as the empty text."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def scan_blobs(blobs: DataFrame, rules=RULES, keep_clean: bool = False) -> DataFrame:
    """(blob, text) -> (blob, spans): spans sorted by start, then rule order; blobs without a finding have no row, or with keep_clean
    one with null spans.

    The text between matches (split) and the matches themselves give the offsets: their lengths are summed in a window per
    (blob, rule). Offsets count code points, ends are exclusive.
    """
    text = F.col("text")
    found = []
    for rank, (kind, pattern, needs, group, _) in enumerate(rules):
        lengths = lambda a: F.transform(a, lambda x: F.length(x))
        cell = F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.arrays_zip(lengths(F.split(text, pattern, -1)).alias("gap"), lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("len"), lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).alias("val")).alias("m"))
        found.append(F.when(text.rlike(needs), cell))
    explode, posexplode = (F.explode_outer, F.posexplode_outer) if keep_clean else (F.explode, F.posexplode)
    rows = blobs.select("blob", explode(F.array_compact(F.array(*found))).alias("f")).select("blob", "f.rank", "f.kind", posexplode("f.m").alias("pos", "m"))
    rows = rows.select("blob", "rank", "kind", "pos", "m.gap", "m.len", "m.val").filter(F.col("len").isNotNull() | F.col("rank").isNull())
    upto = Window.partitionBy("blob", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto).cast("long"))
    least = F.element_at(F.array(*[F.lit(r[4]) for r in rules]), F.col("rank") + 1)
    span = F.struct((F.col("end") - F.col("len")).alias("start"), "rank", "end", "kind")
    spans = F.array_sort(F.collect_list(F.when(F.col("val") >= least, span)))  # nulls are not collected
    rows = rows.groupBy("blob").agg(spans.alias("spans"))
    return rows.withColumn("spans", F.when(F.size("spans") > 0, F.col("spans"))) if keep_clean else rows.filter(F.size("spans") > 0)


class Ledger:
    """The table of scanned blobs: (blob, spans) by rule version, Parquet in a folder that all machines share. Every scanned blob has a row;
    spans is null where nothing was found. Increments append; a blob that two of them scanned at once counts once."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        """path: of an earlier ledger, or where a new one goes (by default a new folder in the shared one)."""
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
        spark.createDataFrame([], self.SCHEMA).write.mode("append").partitionBy("rule_version").parquet(self.path)

    SPANS = "array<struct<start: bigint, rank: int, end: bigint, kind: string>>"
    SCHEMA = f"blob string, spans {SPANS}, rule_version string"

    def append(self, scanned: DataFrame, rule_version: str) -> None:
        scanned.select("blob", F.col("spans").cast(self.SPANS).alias("spans"), F.lit(rule_version).alias("rule_version")).write.mode("append").partitionBy("rule_version").parquet(self.path)

    VERSIONS = "path string, version string, blob string"

    def note(self, versions: DataFrame) -> None:
        """Appends (path, version, blob) of an increment; what a path held earlier stays known."""
        versions.select(*[F.col(c).cast("string").alias(c) for c in ("path", "version", "blob")]).write.mode("append").parquet(f"{self.path}-versions")

    def versions(self) -> DataFrame:
        """Every recorded (path, version, blob), once each; none, where no increment named its paths."""
        self.spark.createDataFrame([], self.VERSIONS).write.mode("append").parquet(f"{self.path}-versions")
        return self.spark.read.schema(self.VERSIONS).parquet(f"{self.path}-versions").distinct()

    def read(self, rule_version: str) -> DataFrame:
        """(blob, spans) of one rule version; only its folder is read."""
        return self.spark.read.schema(self.SCHEMA).parquet(self.path).filter(F.col("rule_version") == rule_version).select("blob", "spans")


def record(versions: DataFrame, ledger: Ledger, rule_version: str = RULE_VERSION, rules=RULES, text_col: str = "text", path_col: str | None = None, version_col: str | None = None) -> None:
    """One increment: scans the blobs of versions that the ledger doesn't hold for the rule version, once each, and appends them to it. With path_col, the
    increment's paths, and versions (null without version_col), are kept beside the ledger.

    Copies, repeated rows and repeated paths share one scan. Blobs are merged before they are dealt out, and meet the ledger under the same
    key, so that texts travel once."""
    blobs = versions.select(address(text_col).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    unseen = blobs.join(ledger.read(rule_version).select("blob"), "blob", "left_anti")
    ledger.append(scan_blobs(unseen, rules, keep_clean=True), rule_version)
    if path_col:
        ledger.note(versions.select(F.col(path_col).alias("path"), (F.col(version_col) if version_col else F.lit(None)).alias("version"), address(text_col).alias("blob")))


def history(ledger: Ledger, rule_version: str = RULE_VERSION) -> DataFrame:
    """(path, version, blob, spans) of every version that any increment recorded with its path, handed in again or not; spans is null where
    nothing was found, or where the blob was not scanned under the rule version."""
    found = ledger.read(rule_version).filter("spans is not null").dropDuplicates(["blob"])
    return join_back(ledger.versions(), found)


def scan(versions: DataFrame, ledger: Ledger | None = None, rule_version: str = RULE_VERSION, rules=RULES, text_col: str = "text") -> DataFrame:
    """versions with blob and spans. An increment is recorded in the ledger (a new one if none is given), then findings are joined from
    the ledger back to every row.

    Null text is the empty text. Empty input: empty results. Columns blob and spans of the input are replaced; all others stay as they are.
    """
    ledger = ledger or Ledger(versions.sparkSession)
    record(versions, ledger, rule_version, rules, text_col)
    packed, back = stowed(versions, [text_col])
    found = ledger.read(rule_version).filter("spans is not null").dropDuplicates(["blob"])
    return back(join_back(packed.withColumn("blob", address(text_col)), found), "blob", "spans")


#: A content's paths are dealt over so many tasks when findings are joined back.
SALTS = 32


def join_back(versions: DataFrame, found: DataFrame) -> DataFrame:
    """versions with spans by blob. Only blobs with findings are on the right, copied for each salt; the salt of a version
    is its scan task's number, so that one content in any share of the rows is spread evenly."""
    salted = versions.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    copies = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["blob", "_salt"], "left").drop("_salt")


def joined(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of each span, comma-joined; null spans: the empty string."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.coalesce(F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","), F.lit(""))


def counted(spans: Column, kind: str) -> Column:
    return F.when(spans.isNull(), 0).otherwise(F.size(F.filter(spans, lambda s: s["kind"] == kind))).cast("long")


def digest(scanned: DataFrame) -> DataFrame:
    s = F.col("spans")
    return scanned.select("doc_id", *[counted(s, k).alias(f"n_{k}") for k in BASE], F.sha2(joined(s, BASE).cast("binary"), 256).alias("base_sha256"), joined(s).alias("spans"))


def redact(scanned: DataFrame, mask: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """Replaces each found span, overlapping ones together, by mask; clean texts stay as they are."""
    text, spans = F.col(text_col), F.col("spans")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        begin, end = F.greatest(acc["at"], s["start"]), F.greatest(acc["at"], s["end"])
        cut = text.substr((acc["at"] + 1).cast("int"), (begin - acc["at"]).cast("int"))
        new = F.concat(acc["out"], cut, F.when((s["start"] >= acc["at"]), F.lit(mask)).otherwise(F.lit("")))
        return F.struct(end.alias("at"), new.alias("out"))

    masked = F.aggregate(spans, start, step, lambda a: F.concat(a["out"], text.substr((a["at"] + 1).cast("int"), F.length(text))))
    return scanned.withColumn(text_col, F.when(F.size(spans) > 0, masked).otherwise(text))


def _found_sql(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    """SQL of one kind's spans: a match begins after the texts between matches and the matches before it."""
    p = "'" + pattern.replace("'", "''") + "'"
    lengths = lambda a: f"COALESCE(list_sum(list_transform({a}, lambda x: length(x))), 0)"
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, CAST({lengths("s[1:i]")} + {lengths("m[1:i-1]")} AS BIGINT) AS start, length(m[i]) AS size FROM
 (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, {p}, 0) AS m, regexp_extract_all(text, {p}, {group}) AS v, regexp_split_to_array(text, {p}) AS s FROM d)) WHERE length(v[i]) >= {least}"""


_BASE_SQL = ", ".join(f"'{k}'" for k in BASE)
ORACLE = f"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(_found_sql(k, r[0], r[1], r[3], r[4]) for k, r in enumerate(RULES))}),
t AS (SELECT *, kind || ':' || start || ':' || (start + size) AS item FROM f),
g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)}, string_agg(item, ',' ORDER BY start, rank) FILTER (kind IN ({_BASE_SQL})) AS base, string_agg(item, ',' ORDER BY start, rank) AS spans FROM t GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"COALESCE(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(COALESCE(base, '')) AS base_sha256, COALESCE(spans, '') AS spans FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""
