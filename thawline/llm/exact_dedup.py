"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

A text is squeezed (runs of blanks to one space) and cut at content-defined
places: a chunk ends at the first sentence end after ``CHUNK_MIN``
characters, at ``CHUNK_MAX`` at the latest. Equal texts give equal chunk
lists, and a cut depends only on the characters since the last one.

1. recipes: per document the ordered 64-bit fingerprints of its chunks; a
   narrow table, written once;
2. verified identifiers: chunk contents are grouped by (fingerprint,
   content), so each distinct chunk moves once and is compared byte by byte.
   A fingerprint with one content is the chunk's identifier; where several
   contents share one, their rank in content order is put beside it;
3. documents are grouped by their ordered identifier list (partial
   aggregates, so a group holding a third of all rows arrives as one row per
   task) and joined back to the narrow table. No document text moves here.

Defined cases: null text is empty; empty texts are copies of each other; a
null doc_id is kept only when no copy has an id; rows that repeat a doc_id
and its text count one by one in ``group_size`` and share ``kept``; texts of
any length are chunked whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import squeezed, stored, text_of

CHUNK_MIN = 768
CHUNK_MAX = 4096


def chunk_pattern(least: int = CHUNK_MIN, most: int = CHUNK_MAX) -> str:
    return rf"(?s).{{{least},{most}}}?(?:[.!?] |\z)|.{{1,{most}}}"


def chunks_of(squeezed_text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(squeezed_text, F.lit(pattern), F.lit(0))


def _fingerprint(chunk: Column, bits: int) -> Column:
    h = F.xxhash64(chunk)
    return h if bits >= 64 else F.shiftrightunsigned(h, 64 - bits)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                least: int = CHUNK_MIN, most: int = CHUNK_MAX, fingerprint_bits: int = 64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, n_chunks) per row of ``docs``."""
    pattern = chunk_pattern(least, most)
    base = docs.select(F.col(id_col).alias("doc_id"), squeezed(text_of(text_col)).alias("body"))
    cut = base.select("doc_id", F.sha2("body", 256).alias("text_sha256"), chunks_of(F.col("body"), pattern).alias("chunks"))
    recipes = stored(cut.select("doc_id", "text_sha256",
                                F.transform("chunks", lambda c: _fingerprint(c, fingerprint_bits)).alias("recipe")), "recipes")
    contents = (base.select(F.explode(chunks_of(F.col("body"), pattern)).alias("chunk"))
                .select(_fingerprint(F.col("chunk"), fingerprint_bits).alias("fp"), "chunk").groupBy("fp", "chunk").agg(F.lit(1).alias("one")))
    shared = stored(contents.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp"), "shared-fp")
    if not shared.isEmpty():
        recipes = _ranked(base, pattern, recipes, shared, fingerprint_bits)
    # stored, so that both sides of the join are exchanged and a hot recipe's rows can be split
    groups = stored(recipes.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    return recipes.join(groups, "recipe").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256", F.size("recipe").alias("n_chunks"))


def _ranked(base: DataFrame, pattern: str, recipes: DataFrame, shared: DataFrame, bits: int) -> DataFrame:
    """Recipes whose shared fingerprints carry the rank of their content.

    The row key is (doc_id, text_sha256): rows equal in both have equal
    recipes, so one of them stands for all.
    """
    rows = base.select("doc_id", F.sha2("body", 256).alias("sha"), F.posexplode(chunks_of(F.col("body"), pattern)).alias("pos", "chunk"))
    rows = rows.select("doc_id", "sha", "pos", "chunk", _fingerprint(F.col("chunk"), bits).alias("fp")).join(shared, "fp", "left_semi")
    distinct = rows.groupBy("fp", "chunk").agg(F.lit(1).alias("one"))
    pairs = distinct.alias("a").join(distinct.alias("b"), F.expr("a.fp = b.fp and b.chunk <= a.chunk"))
    ranks = pairs.groupBy("a.fp", "a.chunk").agg(F.count("*").alias("rank"))
    marks = (rows.join(ranks, ["fp", "chunk"]).groupBy("doc_id", "sha")
             .agg(F.sort_array(F.collect_set(F.struct("pos", "rank"))).alias("marks")))
    full = recipes.alias("r").join(marks.alias("m"), F.expr("r.doc_id <=> m.doc_id and r.text_sha256 = m.sha"), "left")
    ranked = F.transform("recipe", lambda c, i: F.struct(
        c.alias("fp"), F.coalesce(F.element_at(F.filter("marks", lambda m: m["pos"] == i), 1)["rank"], F.lit(0)).alias("rank")))
    return full.select("r.doc_id", "r.text_sha256", ranked.alias("recipe"))
