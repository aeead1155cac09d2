"""Conflict-constrained best-fit packing.

Documents are cut into pieces of at most one bin; pieces that fill a bin get
one of their own. The others are dealt evenly to shards by a hash of (id,
piece) - never by source or cluster, so a hot source spreads over all shards
- and each shard packs its narrow rows (no text) by best fit, longest first.

A shard's open bins are ordered by residual room. Every bin carries two
bitmaps: the sources and the duplicate clusters it holds (a bit for each
value that occurs more than once in the shard). A piece starts at the
tightest bin that has room and walks its successors, in blocks of the
bitmaps, to the first compatible one; without one it opens a bin. No search
is cut short.

A bin never holds two pieces with the same source or the same cluster.
Defined cases: a null source or cluster conflicts with nothing; empty and
null texts are pieces of length zero; equal lengths are taken by id, then
piece; rows that repeat a doc_id are packed one by one; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import squeezed, stored, text_of

#: Bytes of a training sequence: 4,096 tokens at about four bytes a token.
CAPACITY = 16_384
#: Pieces a shard packs, about.
SHARD_ROWS = 8_192
BLOCK = 256
OUT = "doc_id long, piece long, start long, length long, bin_id long, bin_offset long, bin_used long"


class _Bitmaps:
    """One row of bits per bin, 64-bit words; values that occur once need no bit."""

    def __init__(self, values: np.ndarray, bins: int) -> None:
        codes, _ = pd.factorize(pd.Series(values, dtype="object"))
        held = np.bincount(codes[codes >= 0]) if (codes >= 0).any() else np.zeros(0, dtype=np.int64)
        bit = np.full(len(held), -1, dtype=np.int64)
        bit[held > 1] = np.arange(int((held > 1).sum()))
        self.bit = np.where(codes >= 0, bit[codes] if len(bit) else -1, -1)
        self.rows = np.zeros((bins, max(1, -(-int((held > 1).sum()) // 64))), dtype=np.uint64)

    def clashes(self, bins: np.ndarray, item: int) -> np.ndarray | None:
        b = self.bit[item]
        return None if b < 0 else (self.rows[bins, b >> 6] >> np.uint64(b & 63)) & np.uint64(1) != 0

    def add(self, bin_: int, item: int) -> None:
        if (b := self.bit[item]) >= 0:
            self.rows[bin_, b >> 6] |= np.uint64(1) << np.uint64(b & 63)


def best_fit(lengths: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int,
             block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, pieces taken in the given order."""
    n = len(lengths)
    maps = (_Bitmaps(sources, n), _Bitmaps(clusters, n))
    room = np.empty(n, dtype=np.int64)  # residuals of the open bins, ascending
    order = np.empty(n, dtype=np.int64)  # and the bins they belong to
    opened, bins, offsets = 0, np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for k in range(n):
        size = int(lengths[k])
        at, i = -1, int(np.searchsorted(room[:opened], size))
        while i < opened:
            near = order[i:i + block]
            near = near[:opened - i]
            clash = None
            for m in maps:
                if (c := m.clashes(near, k)) is not None:
                    clash = c if clash is None else clash | c
            free = 0 if clash is None else int(np.argmin(clash))
            if clash is None or not clash[free]:
                at = i + free
                break
            i += len(near)
        if at < 0:
            bin_, left, at = opened, capacity, opened
            opened += 1
        else:
            bin_, left = int(order[at]), int(room[at])
        bins[k], offsets[k] = bin_, capacity - left
        to = int(np.searchsorted(room[:at], left - size))  # the residual shrinks: it moves down
        room[to + 1:at + 1] = room[to:at]
        order[to + 1:at + 1] = order[to:at]
        room[to], order[to] = left - size, bin_
        for m in maps:
            m.add(bin_, k)
    return bins, offsets


def _pack_shard(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="mergesort", na_position="last").reset_index(drop=True)
        bins, offsets = best_fit(rows["length"].to_numpy(), rows["source"].to_numpy(), rows["cluster"].to_numpy(), capacity)
        used = np.bincount(bins, weights=rows["length"].to_numpy(), minlength=len(rows)).astype(np.int64)
        out = rows[["doc_id", "piece", "start", "length"]].copy()
        out["doc_id"] = out["doc_id"].astype("Int64")
        out["bin_id"] = (rows["shard"].to_numpy().astype(np.int64) << 32) + bins
        out["bin_offset"], out["bin_used"] = offsets, used[bins]
        return out
    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         length: Column | None = None, cluster: Column | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: its place in the document and in its bin.

    ``length`` defaults to UTF-8 bytes, ``cluster`` to a hash of the
    squeezed text (copies of a text).
    """
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        (F.octet_length(text) if length is None else length).cast("long").alias("size"),
        (F.xxhash64(squeezed(text)) if cluster is None else cluster).alias("cluster"))
    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("size") / capacity) - 1, F.lit(0).cast("long"))))
    pieces = (rows.withColumn("piece", cut).withColumn("start", F.col("piece") * capacity)
              .withColumn("length", F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("start"))).drop("size"))
    pieces = stored(pieces, "pieces")
    open_ = pieces.filter(F.col("length") < capacity)
    shards = max(1, -(-open_.count() // shard_rows))
    dealt = open_.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "start", "length"), F.lit(shards)).cast("int"))
    packed = dealt.groupBy("shard").applyInPandas(_pack_shard(capacity), OUT)
    # a full piece is a bin of its own, numbered above the shards
    own = F.shiftleft(F.lit(shards).cast("long"), 32) + F.monotonically_increasing_id()
    full = pieces.filter(F.col("length") == capacity).select(
        "doc_id", "piece", "start", "length", own.alias("bin_id"), F.lit(0).cast("long").alias("bin_offset"), F.col("length").alias("bin_used"))
    return packed.unionByName(full)
