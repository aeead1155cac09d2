"""The corpus pipeline: documents to packed training sequences.

Stages, in order: documents that the quality classifier rejects go, exact
copies go, one document of each near-duplicate component stays, personal data
are replaced by their kind, what is left is packed. Each stage's result is
written as Parquet and read again as the next one's documents; all but the last
return the columns of ``documents``.

Defined cases: null texts are empty texts; extra columns pass through
unharmed whatever their names; of each group of copies or near copies exactly
one row stays, also where ids are null or repeated (smallest id, null ids last,
then the smallest text hash, then the smallest row); an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thawline.llm import exact_dedup, packing, pii, quality, simhash
from thawline.llm.common import documents, squeezed, stored, text_of


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labels of ``docs``, does not reject."""
    rules = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows, names = quality.featured(docs.select(F.struct("*").alias("__row")), ["__row"], text_of("__row.text"))
    good = rules.score([F.col(n) for n in names]) >= quality.THRESHOLD
    # one element or none: a plain filter would be pushed below the statistics, which it
    # would then compute anew for every rule
    kept = rows.select("__row", F.explode(F.when(good, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>"))))
    return kept.select("__row.*")


def _one_each(docs: DataFrame, chosen: DataFrame, sha: Column) -> DataFrame:
    """One row of ``docs`` for each row (doc_id, sha, held) of ``chosen``; where
    ``held`` rows share id and ``sha``, the first in order of text and JSON."""
    chosen = stored(chosen, "chosen")
    rows = docs.select(F.struct("*").alias("__row"), sha.alias("__sha"))
    same = F.expr("__row.doc_id <=> doc_id and __sha = sha")
    out = rows.join(chosen.filter("held = 1"), same, "left_semi").select("__row")
    many = chosen.filter("held > 1")
    if not many.isEmpty():
        repeats = rows.join(many, same, "left_semi")
        # a ranked window: Spark applies its limit before the shuffle, so a hot group is one row per task
        place = F.row_number().over(Window.partitionBy("__sha", "__row.doc_id").orderBy("__row.text", F.to_json("__row")))
        out = out.unionByName(repeats.withColumn("__place", place).filter("__place = 1").select("__row"))
    return out.select("__row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of equal texts."""
    kept = exact_dedup.exact_dedup(docs).filter("kept").groupBy("doc_id", F.col("text_sha256").alias("sha")).agg(F.count("*").alias("held"))
    return _one_each(docs, kept, F.sha2(squeezed(text_of("text")), 256))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each SimHash component."""
    return _one_each(docs, simhash.representatives(docs), F.sha2(text_of("text"), 256))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every selected span of personal data replaced by its kind; n_chars follows."""
    model = pii.fit(docs)
    found = pii.find(docs.select(F.struct("*").alias("__row")), model, ["__row"], text_of("__row.text"))
    clean = F.when(F.col("__row.text").isNotNull(), pii.redacted(F.col("__row.text"), F.col("spans")))
    new = {"text": clean, "n_chars": F.when(F.size("spans") > 0, F.length(clean)).otherwise(F.col("__row.n_chars")).cast("long")}
    return found.select(*[new.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin and place of every piece."""
    return packing.pack(docs)


STAGES = [("quality", keep_good), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("pii", redact), ("packing", pack)]

#: The fitted models and the packing are not expressible in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
