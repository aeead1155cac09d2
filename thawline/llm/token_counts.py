"""Token counts through a digest cache.

The cache is a parquet table of (tokenizer, digest, n_tokens): the SHA-256
of the tokenizer's file (its version) and of the normalised content (UTF-8
bytes, null as empty). Contents whose pair of digests is stored are never
encoded again: the misses are one row per distinct digest, the library
encodes only these, and their counts are appended.

Duplicates of a content (a third of all rows may be one) meet as partial
aggregates of narrow rows; one of them, named by (digest, doc_id), is the
one whose text is encoded, and the text joins on both columns so that no
digest gathers its copies in one task.

Defined cases: null text is empty and has no tokens; rows that repeat a
doc_id or a text count alike; a null doc_id keeps its row; special strings
in a text are what the library makes of them by default; texts of any length are
counted whole; an empty table gives an empty result and leaves the cache as it is; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stored, text_of

CACHE_SCHEMA = "tokenizer string, digest string, n_tokens long"
#: Distinct words whose counts a task remembers before it starts afresh.
WORDS_KEPT = 400_000
#: Texts of only these characters are split here by the file's own pattern;
#: their classes are the same in every Unicode version. Others go whole to the library.
PLAIN = r"[\t\n\r\x20-\x7e\xa0-ɏ]*"


def tokenizer_version(path: str) -> str:
    import hashlib
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class Counter:
    """Counts of whole texts as ``tokenizers`` gives them, words remembered."""

    def __init__(self, path: str) -> None:
        import json
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        # words are independent only under the byte-level split without a normaliser
        self.by_word = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.words = regex.compile(PATTERN)
        self.plain = regex.compile(PLAIN)
        self.seen: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        whole, split = [], []
        for k, text in enumerate(texts):
            if self.by_word and self.plain.fullmatch(text) and not any(s in text for s in self.added):
                split.append((k, self.words.findall(text)))
            else:
                whole.append(k)
        if len(self.seen) > WORDS_KEPT:
            self.seen = {}
        new = list({w for _, words in split for w in words}.difference(self.seen))
        self.seen.update(zip(new, self._encode(new)))
        count = self.seen.__getitem__
        for k, words in split:
            out[k] = sum(map(count, words))
        for k, n in zip(whole, self._encode([texts[k] for k in whole])):
            out[k] = n
        return out

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch(texts, add_special_tokens=False)] if texts else []


def encode_counts(misses: DataFrame, tokenizer_file: str, at_once: int = 200) -> DataFrame:
    """(digest, n_tokens) of (digest, text) rows, the library in Arrow batches."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter(tokenizer_file)
        for frame in frames:
            for i in range(0, len(frame), at_once):
                part = frame.iloc[i:i + at_once]
                yield pd.DataFrame({"digest": part["digest"], "n_tokens": counter(part["text"].tolist())})
    return misses.select("digest", "text").mapInPandas(run, "digest string, n_tokens long")


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The cache table; empty where nothing has been stored yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache) if there else spark.createDataFrame([], CACHE_SCHEMA)


def token_counts(docs: DataFrame, tokenizer_file: str, cache: str, limit: int = 1024,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, digest) per row; appends misses to ``cache``."""
    spark = docs.sparkSession
    small_batches(spark)
    version = tokenizer_version(tokenizer_file)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("digest", F.sha2("text", 256))
    narrow = stored(rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    known = read_cache(spark, cache).filter(F.col("tokenizer") == version).select("digest", "n_tokens")
    # one row per unseen digest: the id that stands for it
    unseen = (narrow.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(known, "digest", "left_anti"))
    one = rows.alias("r").join(unseen.alias("u"), F.expr("r.digest = u.digest and r.doc_id <=> u.doc_id"), "left_semi")
    found = (encode_counts(one, tokenizer_file).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
             .select(F.lit(version).alias("tokenizer"), "digest", "n_tokens"))
    found.write.mode("append").parquet(cache)
    counts = (read_cache(spark, cache).filter(F.col("tokenizer") == version)
              .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))
    counts = stored(counts, "counts")  # both sides of the join are exchanged: a hot digest's rows can be split
    return narrow.join(counts, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "digest")
