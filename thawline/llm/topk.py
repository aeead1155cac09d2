"""Exact top-k inner products by MaxScore over sharded impact postings.

A vector component becomes floor(256 * x). Its terms are (dimension, sign):
the postings of a term are the vectors with that sign there, with their
impacts. A query matches one sign of each of its dimensions (positive
contributions) and pays for the other sign.

Vectors are dealt to shards by a hash of their id, queries to blocks; each
(shard, query block) is one group, so no group grows with the data. In it,
for every query:

1. a threshold: the k-th score among the strongest vectors of the query's
   terms with the largest bounds;
2. terms by bound (largest |impact| of the shard times the query's weight);
   the weakest ones whose bounds together stay below the threshold are
   non-essential: a vector in none of the essential postings scores less
   than the threshold;
3. essential postings are traversed, the vectors met are candidates;
4. the other dimensions are probed, largest bound first, and a candidate
   leaves when its score plus the bounds to come is below the threshold.

Only candidates strictly below the threshold leave, so ties stay exact.
Shards are merged by a ranked window whose limit Spark applies before the
shuffle.

Defined cases: vectors that are null, empty or hold null or non-finite
components take no part; a missing trailing component counts as zero;
a quantised component that no 64-bit integer holds, or a shard and block whose
sums could leave 64 bits, is an error; rows that
repeat a vec_id count one by one and a query skips all rows with its own
id; a null vec_id takes no part; equal scores go to the smaller id; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHARD_ROWS = 8_192
QUERY_ROWS = 1_024
OUT = "query_id long, vec_id long, score long"


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), dtype=np.int64)
    for i, v in enumerate(column):
        out[i, :len(v)] = v
    return out


class Shard:
    """Impact-ordered postings of the sign-split dimensions of one shard."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.rows = ids, rows
        self.columns = np.ascontiguousarray(rows.T)
        self.high = np.maximum(rows.max(axis=0), 0)
        self.low = np.minimum(rows.min(axis=0), 0)
        ranked = np.argsort(self.columns, axis=1, kind="stable")
        above = (self.columns > 0).sum(axis=1)
        below = (self.columns < 0).sum(axis=1)
        # strongest impact first
        self.up = [r[len(r) - a:][::-1] for r, a in zip(ranked, above)]
        self.down = [r[:b] for r, b in zip(ranked, below)]

    def best(self, query: np.ndarray, own: int, k: int, seeds: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and scores of at least the k best rows other than ``own``."""
        bound = np.where(query > 0, query * self.high, query * self.low)
        terms = np.argsort(-bound, kind="stable")
        postings = [self.up[d] if query[d] > 0 else self.down[d] for d in terms]
        first = np.unique(np.concatenate([p[:seeds] for p in postings[:4]])) if len(terms) else np.zeros(0, dtype=np.int64)
        first = first[self.ids[first] != own]
        floor = -np.inf
        if len(first) >= k:
            floor = np.partition(self.rows[first] @ query, len(first) - k)[len(first) - k]
        # weakest terms first: those whose bounds together stay under the threshold
        rest = np.cumsum(bound[terms][::-1])[::-1]
        essential = int((rest >= floor).sum())
        met = np.zeros(len(self.ids), dtype=bool)
        score = np.zeros(len(self.ids), dtype=np.int64)
        for d, posting in zip(terms[:essential], postings[:essential]):
            met[posting] = True
            if met.sum() > len(met) * 0.9:
                met[:] = True  # the postings to come would add little: take every vector
                break
        if essential == len(terms):
            met[:] = True  # a vector without any match may be among the k best
        met &= self.ids != own
        near = np.flatnonzero(met)
        score = np.zeros(len(near), dtype=np.int64)
        left = np.append(rest[1:], 0)
        for i, d in enumerate(terms):
            score += query[d] * self.columns[d][near]
            if i % 4 == 3 and len(near) > k:
                stay = score + left[i] >= floor
                near, score = near[stay], score[stay]
        return near, score


def _search(k: int):
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)
        if not len(vectors) or not len(queries):
            return empty
        width = max(max(map(len, vectors["v"])), max(map(len, queries["v"])))
        rows, asked = _matrix(vectors["v"], width), _matrix(queries["v"], width)
        most = lambda m: max(int(m.max(initial=0)), -int(m.min(initial=0)))
        if most(rows) * most(asked) * width >= 1 << 63:
            raise ValueError("top-k: the components are too large for exact scores of 64 bits")
        shard = Shard(vectors["vec_id"].to_numpy(), rows)
        out = []
        for own, query in zip(queries["vec_id"].to_numpy(), asked):
            near, score = shard.best(query, own, k)
            best = np.lexsort((shard.ids[near], -score))[:k]
            out.append(pd.DataFrame({"query_id": own, "vec_id": shard.ids[near[best]], "score": score[best]}))
        return pd.concat(out) if out else empty
    return run


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part; v is array<bigint>."""
    x = F.col(vector_col).cast("array<double>")
    fine = (F.col(id_col).isNotNull() & (F.size(x) > 0)
            & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    fits = lambda c: F.abs(c * 256.0) < F.lit(float(1 << 63))
    whole = F.transform(x, lambda c: F.when(fits(c), F.floor(c * 256.0)).otherwise(
        F.raise_error(F.lit("top-k: a component is too large for 64 bits")).cast("long")))
    return vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each id divisible by ``every``."""
    rows = stored(quantised(vectors, id_col, vector_col), "vectors")
    asked = rows.filter(F.col("vec_id") % every == 0)
    n, q = rows.count(), asked.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-q // query_rows))
    number = lambda m: F.sequence(F.lit(0), F.lit(m - 1))
    left = rows.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"), F.explode(number(blocks)).alias("block"))
    right = asked.distinct().select("vec_id", "v", F.pmod(F.xxhash64("v", "vec_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(number(shards)).alias("shard"))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(_search(k), OUT)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
