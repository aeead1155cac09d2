"""Secret scan with an incremental blob ledger (DataFrame functions only).

Every version of every path is addressed by its content (SHA-256 of the
UTF-8 text, the blob). The ledger is a parquet table of (rules, blob,
findings): one row per blob ever scanned under a rule version. Only blobs
without a row for the current version are scanned, once each, whatever
number of paths hold them; their findings are appended, and the ledger is
joined back to all paths.

The copies of a blob (a third of all rows may be one) meet as partial
aggregates of narrow rows. The text that is scanned joins on (blob, path),
so copies never gather in one task.

Defined cases: null and empty texts hold nothing; texts of any length and with any number of
matches are scanned whole; spans of different kinds may overlap and are all listed, by start and
then kind; an empty table gives an empty result and leaves the ledger as it is; rows that repeat a path and a text get the
same findings; a null path keeps its row; blanks in a table are texts like
any other; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, text_of
from .spans import fence_free, fenced, spans_in, written

# The kinds and patterns of the contract, then the added ones.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
VENDOR = r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"
PEM = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
KINDS = ["assign", "access", "hex", "vendor", "pem"]
PATTERNS = [ASSIGN, ACCESS, HEX, VENDOR, PEM]
BASE = 3

FINDINGS = "array<struct<start:int,kind:int,end:int>>"
LEDGER_SCHEMA = f"rules string, blob string, findings {FINDINGS}"


def rule_version(patterns: list[str] = PATTERNS) -> str:
    return hashlib.sha256("\n".join(patterns).encode()).hexdigest()


def findings_of(places: list[Column]) -> Column:
    """One array, by start and then kind, of the kinds' spans."""
    def tagged(kind: int):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))
    return F.sort_array(F.concat(*[F.transform(p, tagged(k)) for k, p in enumerate(places)]))


def scan(texts: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the findings of each whole text in column ``text``."""
    clean = texts.select(*keep, fence_free(F.col("text")).alias("text"))
    marked = clean.select(*keep, *[fenced(F.col("text"), p).alias(f"f{k}") for k, p in enumerate(PATTERNS)])
    places = [spans_in(F.col(f"f{k}")) for k in range(len(PATTERNS))]
    places[0] = F.filter(places[0], lambda s: F.length(F.regexp_extract(s["value"], ASSIGN_VALUE, 1)) >= 8)
    return marked.select(*keep, findings_of(places).alias("findings"))


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(LEDGER_SCHEMA).parquet(ledger) if there else spark.createDataFrame([], LEDGER_SCHEMA)


def secret_scan(versions: DataFrame, ledger: str, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(path, blob, findings) per row of ``versions``; appends newly scanned blobs to ``ledger``."""
    spark, rules = versions.sparkSession, rule_version()
    rows = versions.select(F.col(path_col).alias("path"), text_of(text_col).alias("text")).withColumn("blob", F.sha2("text", 256))
    narrow = stored(rows.select("path", "blob"), "blobs")
    blobs = stored(narrow.groupBy("blob").agg(F.min("path").alias("path")), "distinct-blobs")
    # only the ledger's rows of these blobs go on: an old ledger costs its scan, no shuffle of its history
    known = read_ledger(spark, ledger).filter(F.col("rules") == rules).join(blobs.select("blob"), "blob", "left_semi")
    unseen = blobs.join(known.select("blob"), "blob", "left_anti")
    one = rows.alias("r").join(unseen.alias("u"), F.expr("r.blob = u.blob and r.path <=> u.path"), "left_semi")
    found = scan(one, ["blob"]).groupBy("blob").agg(F.max("findings").alias("findings"))
    found.select(F.lit(rules).alias("rules"), "blob", "findings").write.mode("append").parquet(ledger)
    held = read_ledger(spark, ledger).filter(F.col("rules") == rules).join(blobs.select("blob"), "blob", "left_semi").groupBy("blob").agg(F.max("findings").alias("findings"))
    held = stored(held, "held")  # both sides of the join are exchanged: a hot blob's paths can be split
    return narrow.join(held, "blob").select("path", "blob", "findings")


def report(found: DataFrame, id_name: str = "doc_id") -> DataFrame:
    """Counts, base digest and all spans as text."""
    base = F.filter("findings", lambda s: s["kind"] < BASE)
    count = lambda k: F.size(F.filter("findings", lambda s: s["kind"] == k)).cast("long")
    return found.select(F.col("path").alias(id_name), *[count(k).alias(f"n_{KINDS[k]}") for k in range(BASE)],
                        F.sha2(written(base, KINDS), 256).alias("base_sha256"), written(F.col("findings"), KINDS).alias("spans"))
