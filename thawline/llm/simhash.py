"""SimHash near-duplicates by deletion-variant segment signatures.

Fingerprints link at ``MAX_BITS`` = 2 or fewer differing bits. A 64-bit
fingerprint is cut into two 32-bit segments (fewer than the three that equal
segments would need), so in a linked pair one segment differs by at most one
bit. Each distinct fingerprint is indexed under 66 keys: either segment as
it is, and either segment with one bit wild.

* Keys shared by up to ``BUCKET`` fingerprints: equality join on the key and
  verification of the bit distance.
* Keys shared by more: their fingerprints are indexed by the 65 values at
  distance 0 or 1. Two fingerprints differ in at most two bits exactly when
  they share such a value, so the holders of a value are linked to its
  smallest holder: every link is kept without emitting a group's pairs.

Components come from alternating large and small stars on the link table.
Copies collapse to one fingerprint before any of this.

Defined cases: null text is empty; a text without words has fingerprint
zero and links like any other; rows that repeat a doc_id are fingerprinted
one by one; rows with null doc_id belong to components, but never name
one unless all ids are null; texts of any length are read whole; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, stored, text_of

SHINGLE = 3
MAX_BITS = 2
BUCKET = 8


def fingerprint_udf(shingle: int = SHINGLE):
    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        from xxhash import xxh64_intdigest
        out = np.zeros(len(texts), dtype=np.uint64)
        for k, text in enumerate(texts):
            words = text.encode("utf-8", "surrogatepass").lower().split()
            if not words:
                continue
            if len(words) < shingle:
                parts = [b" ".join(words)]
            else:
                parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
            h = np.array([xxh64_intdigest(p, 42) for p in parts], dtype="<u8")
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[k] = np.packbits(2 * bits > len(h), bitorder="little").view("<u8")[0]
        return pd.Series(out.view(np.int64))
    return fingerprint


def _keys(fp: Column) -> Column:
    """66 keys: (segment, wild bit or 32 for none) above the masked segment."""
    low = F.lit(0xFFFFFFFF).cast("long")

    def key(k):
        segment, wild = F.floor(k / 33).cast("int"), k % 33
        value = F.when(segment == 0, fp.bitwiseAND(low)).otherwise(F.shiftrightunsigned(fp, 32))
        bit = F.when(wild == 32, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), wild))
        return F.call_function("shiftleft", k.cast("long"), F.lit(32)).bitwiseOR(value.bitwiseAND(F.bitwise_not(bit)))
    return F.transform(F.sequence(F.lit(0), F.lit(65)), key)


def links(prints: DataFrame, bucket: int = BUCKET, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) fingerprints, a < b, within ``max_bits``; connects all that link.

    ``prints`` has one column ``fp`` of distinct fingerprints.

    Joins are sorted merges at every size: Spark sizes exploded rows as the rows they come of (66
    and 65 keys of one here) and stored ones by their coded bytes, and would broadcast far more than its threshold.
    """
    # 66 rows come of one: deal the few bytes out first, in as many parts as a shuffle has
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    variants = prints.repartition(parts, "fp").select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    crowd = variants.groupBy("key").agg(F.count("*").alias("held")).filter("held > 1")
    members = stored(variants.hint("merge").join(crowd, "key").select("key", "fp", "held"), "simhash-members")
    small = members.filter(F.col("held") <= bucket)
    pairs = (small.alias("x").hint("merge").join(small.alias("y"), F.expr("x.key = y.key and x.fp < y.fp"))
             .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
             .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
    large = members.filter(F.col("held") > bucket).select("fp").distinct()
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)),
                        lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    balls = large.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("point"))
    heads = balls.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("held")).filter("held > 1").drop("held")
    if max_bits < 2:  # holders of a point may be two bits apart: only a flip that is a fingerprint links
        heads = large.select(F.col("fp").alias("point"), F.col("fp").alias("a"))
    stars = (balls.hint("merge").join(heads, "point").filter("a < fp").select("a", F.col("fp").alias("b"))
             .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root is the smallest node.

    Large and small stars in turn, each round a stored table; the loop ends
    when a round changes nothing. Minima are partial aggregates joined back,
    so a node with very many neighbours never is one group.
    """
    current = stored(edges.select("a", "b"), "links")
    before = None
    while True:
        both = current.select("a", "b").unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").distinct()
        # a < b throughout: the larger end looks at its smaller neighbours
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(low, "b")
        small = joined.filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(
            joined.select(F.col("m").alias("a"), "b")).distinct()
        after = stored(small, "links")
        mark = after.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        discard(current)
        current = after
        if mark == before:
            return current.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
                current.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        before = mark


def rooted(heads: DataFrame, bucket: int = BUCKET, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, head, root) of (fp, head), one row per fingerprint: root names the component."""
    roots = components(links(heads.select("fp"), bucket, max_bits))
    return heads.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "head", F.coalesce("root", "fp").alias("root"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, sha, held): one row per component, naming its row of ``docs`` by
    id and SHA-256 of the text (smallest id, nulls last, then smallest SHA);
    ``held`` rows of ``docs`` share both."""
    small_batches(docs.sparkSession)
    text = text_of(text_col)
    prints = stored(docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("sha"), fingerprint_udf(shingle)(text).alias("fp")), "simhash")
    rows = prints.groupBy("fp", "doc_id", "sha").agg(F.count("*").alias("held"))
    head = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "sha", "held")
    named = rooted(stored(rows.groupBy("fp").agg(F.min(head).alias("head")), "heads"), bucket, max_bits)
    return named.groupBy("root").agg(F.min("head").alias("head")).select("head.doc_id", "head.sha", "head.held")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  shingle: int = SHINGLE, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs``."""
    if max_bits > 2:
        raise ValueError("two segments with one wild bit find at most two differing bits")
    small_batches(docs.sparkSession)
    prints = stored(docs.select(F.col(id_col).alias("doc_id"), fingerprint_udf(shingle)(text_of(text_col)).alias("fp")), "simhash")
    heads = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("head")), "heads")
    named = rooted(heads, bucket, max_bits)
    names = named.groupBy("root").agg(F.min("head").alias("component_id"))
    of_print = stored(named.join(stored(names, "names"), "root").select("fp", "component_id"), "of-print")
    return prints.join(of_print, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
