"""Secret scans by an incremental blob ledger.

Each version of a text is a blob named by its SHA-256. The ledger holds, as Parquet in a folder, which pairs of blob and
rule version have been scanned and what was found. Only pairs that it doesn't hold are scanned, each once however many
paths have the blob; findings join back to all paths, those of this run and of earlier ones alike. Native throughout."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm.common import materialise, null_safe, shared_dir, spread_join
from clausewright.llm.spans import Rule, matches, of_kind, plain, tagged, written

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""(?s)^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12,}$"""
_yes = lambda _: F.lit(True)

BASE = [
    Rule("assign", ASSIGN, lambda t: t.contains("=") | t.contains(":"), lambda v: v.rlike(ASSIGN_VALUE)),
    Rule("access", "AKIA[A-Z0-9]{14,}", lambda t: t.contains("AKIA"), _yes),
    Rule("hex", "[0-9a-f]{16,}+", _yes, _yes),
]
MORE = [
    Rule("github", "(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}", lambda t: t.contains("gh"), _yes),
    Rule("jwt", r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", lambda t: t.contains("eyJ"), _yes),
    Rule("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", lambda t: t.contains("PRIVATE KEY-----"), _yes),
]
RULES_VERSION = "2026-1"
SPANS = "array<struct<s:bigint,k:int,e:bigint,kind:string,v:string>>"
SCANNED, FOUND = "blob string, rules string", f"blob string, rules string, spans {SPANS}"


class Ledger:
    """The Parquet tables `scanned` (blob, rules) and `findings` (blob, rules, spans) under a folder that all executors see.

    A run appends findings before it appends what it scanned: one that breaks off between is done again, and findings
    that are there twice count once."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark).rstrip('/')}/clausewright-{uuid.uuid4().hex}/ledger"

    def read(self, name: str, shape: str) -> DataFrame:
        """A table of the ledger; an empty one if nothing has been written."""
        try:
            return self.spark.read.schema(shape).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], shape)

    def scanned(self, rules: str) -> DataFrame:
        return self.read("scanned", SCANNED).where(F.col("rules") == rules).select("blob")

    def findings(self, rules: str) -> DataFrame:
        return self.read("findings", FOUND).where(F.col("rules") == rules).select("blob", "spans").dropDuplicates(["blob"])

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/{name}")


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan_blobs(blobs: DataFrame, rules: list[Rule] = BASE + MORE) -> DataFrame:
    """(blob, spans) of the blobs (blob, text) that have a finding."""
    found = blobs.select("blob", plain(F.col("text")).alias("text"))
    found = found.select("blob", *[matches(F.col("text"), r).alias(r.kind) for r in rules])
    found = found.where(" OR ".join(f"size({r.kind}) > 0" for r in rules))
    return found.select("blob", tagged({r.kind: F.col(r.kind) for r in rules}).alias("spans"))


def scan(paths: DataFrame, path: str, text: str, ledger: Ledger, rules: list[Rule] = BASE + MORE, version: str = RULES_VERSION) -> DataFrame:
    """Scans what the ledger lacks, enters it, and returns (path, blob, spans): of each row of paths, its findings.

    paths has one row per version of a path; a null text is the empty blob, rows that repeat share a blob, and a null
    path is one like others. A blob's text is taken from the rows of its least path (null: last), so that a blob that a
    third of all rows share is not gathered in one task."""
    named = paths.select(F.col(path).alias("path"), F.col(text).alias("text")).withColumn("blob", blob_id(F.col("text")))
    one = named.groupBy("blob").agg(F.min(F.struct(F.col("path").isNull().alias("none"), "path")).alias("r"))
    new = one.join(ledger.scanned(version), "blob", "left_anti").select(F.col("blob").alias("b"), F.col("r.path").alias("p"))
    new = materialise(new, "unseen")
    unseen = named.join(new, null_safe("path", "p") & (F.col("blob") == F.col("b")), "left_semi")
    ledger.append("findings", scan_blobs(unseen, rules).dropDuplicates(["blob"]).select("blob", F.lit(version).alias("rules"), "spans"))
    ledger.append("scanned", new.select(F.col("b").alias("blob"), F.lit(version).alias("rules")))
    return spread_join(named.select("path", "blob"), ledger.findings(version), "blob").select("path", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def secrets(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_found.

    Null and empty texts have no spans. A ledger of earlier runs spares their blobs; without one, this run has its own.
    n_found counts all spans. Extra columns of docs are ignored; each row gives a row, whatever its doc_id."""
    found = scan(docs, "doc_id", "text", ledger or Ledger(docs.sparkSession))
    base = [r.kind for r in BASE]
    first = F.filter("spans", lambda x: x["kind"].isin(*base))
    return found.select(
        F.col("path").alias("doc_id"),
        *[of_kind(F.col("spans"), k).alias(f"n_{k}") for k in base],
        F.sha2(written(first).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_found"),
    )

