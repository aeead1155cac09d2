"""Hard negatives by Fagin's threshold algorithm over sharded sorted lists.

A vector component becomes floor(256 * x); a row's score for an anchor is the
integer inner product. An anchor's positives are its ``positives`` best other
rows of the same label; for each of them the ``negatives`` best rows of other
labels inside the window [LOW, HIGH] x positive score are returned.

Both searches run the same way on one shard of rows and one block of anchors.
Each dimension has the shard's rows sorted by their component. For an anchor

1. sorted access goes down every list from its top or its bottom, as the sign of
   the anchor's component says, to a depth that doubles from step to step,
2. rows met for the first time are scored exactly (random access),
3. the threshold is the score of a row with the components at the present depth:
   no row not yet met scores more. A window is closed when the threshold is
   strictly below its k-th score so far, or below its lower end; the search
   stops with its last window. Strictly, so that ties go to the smaller id.

Positives are searched among shards of the anchor's own label, negatives among
shards of all rows. The first negative shard is searched before the others: its
k-th scores close windows there early. Shards are merged by ranked windows, whose
limit Spark applies before the shuffle. A row meets ceil(anchors / ANCHOR_ROWS)
blocks and an anchor ceil(rows / SHARD_ROWS) shards, as an exact search needs; a
hot label is many shards.

Defined cases: rows with a null id, a null label, a null vector or a null or
non-finite component take no part; an empty vector scores 0, a missing trailing
component counts as zero; rows that repeat a vec_id are candidates one by one, an
anchor skips all rows with its own id, and rows that repeat id, label and vector
are one anchor; a positive with a negative score has no negatives; scores that
64 bits could not hold are an error; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHARD_ROWS = 8_192
ANCHOR_ROWS = 4_096
#: First depth of sorted access.
DEPTH = 32
FOUND = "anchor_id long, anchor_label int, twin long, p int, vec_id long, score long"


def prepared(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             flip_every: int = 7, labels: int = 10) -> DataFrame:
    """(vec_id, label, v) of the rows that take part; where ``flip_every`` divides the id, the label moves on by one."""
    x = F.col(vector_col).cast("array<double>")
    infinite = F.lit(float("inf"))
    fine = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < infinite), F.lit(False)))
    fits = lambda c: F.abs(c * 256.0) < F.lit(float(1 << 63))
    whole = F.transform(x, lambda c: F.when(fits(c), F.floor(c * 256.0)).otherwise(
        F.raise_error(F.lit("hard negatives: a component is too large for 64 bits")).cast("long")))
    vec_id, label = F.col(id_col).cast("long"), F.col(label_col).cast("int")
    moved = F.when(vec_id % flip_every == 0, (label + 1) % labels).otherwise(label) if flip_every else label
    return (vectors.filter(F.coalesce(vec_id.isNotNull() & label.isNotNull() & fine, F.lit(False)))
            .select(vec_id.alias("vec_id"), moved.cast("int").alias("label"), whole.alias("v")))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), dtype=np.int64)
    for i, v in enumerate(column):
        out[i, :len(v)] = v
    return out


class Lists:
    """The rows of a shard and, per dimension, their order by component."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, exact: type) -> None:
        self.ids, self.labels, self.rows = ids, labels, rows.astype(exact)
        columns = np.ascontiguousarray(rows.T)
        self.rising = np.argsort(columns, axis=1, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(columns, self.rising.astype(np.int64), axis=1)

    def search(self, query: np.ndarray, allowed: np.ndarray, low: list[int], high: list[int], floor: list[int | None], k: int) -> tuple[list, int]:
        """For each window [low, high], row numbers and scores of its k best allowed rows, and how many rows were scored.

        Where ``floor`` names a k-th score known from elsewhere, rows below it may be missing."""
        n = len(self.ids)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        weights, asked = query.tolist(), query.astype(self.rows.dtype)
        seen, score = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64)
        open_, depth = list(range(len(low))), 0
        while open_ and depth < n:
            upto = min(n, max(DEPTH, 2 * depth)) if len(up) + len(down) else n
            fresh = np.zeros(n, dtype=bool)
            fresh[self.rising[up, n - upto:n - depth].ravel()] = True
            fresh[self.rising[down, depth:upto].ravel()] = True
            if upto == n:
                fresh[:] = True
            fresh &= ~seen
            seen |= fresh
            new = np.flatnonzero(fresh & allowed)
            # numbers are whole and below the type's exact range, so the product is the integer score
            part = self.rows @ asked if len(new) > n // 2 else None
            score[new] = part[new] if part is not None else self.rows[new] @ asked
            depth = upto
            if depth == n:
                break
            threshold = sum(weights[d] * int(self.values[d, n - depth]) for d in up) + sum(weights[d] * int(self.values[d, depth - 1]) for d in down)
            met = score[seen & allowed]
            open_ = [w for w in open_ if not self._closed(met, threshold, low[w], high[w], floor[w], k)]
        rows = np.flatnonzero(seen & allowed)
        out = []
        for a, b in zip(low, high):
            inside = rows[(score[rows] >= a) & (score[rows] <= b)]
            best = np.lexsort((self.ids[inside], -score[inside]))[:k]
            out.append((inside[best], score[inside[best]]))
        return out, len(rows)

    @staticmethod
    def _closed(met: np.ndarray, threshold: int, low: int, high: int, floor: int | None, k: int) -> bool:
        if threshold < low or (floor is not None and threshold < floor):
            return True
        inside = met[(met >= low) & (met <= high)]
        return len(inside) >= k and threshold < int(np.partition(inside, len(inside) - k)[len(inside) - k])


def _search(k: int, same_label: bool):
    least, most = -(1 << 63), (1 << 63) - 1

    def run(vectors: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = {c.split(" ")[0]: [] for c in FOUND.split(", ")}
        if len(vectors) and len(anchors):
            width = max(max(map(len, vectors["v"])), max(map(len, anchors["v"])))
            rows, asked = _matrix(vectors["v"], width), _matrix(anchors["v"], width)
            size = lambda m: max(int(m.max(initial=0)), -int(m.min(initial=0)))
            bound = size(rows) * size(asked) * max(width, 1)
            if bound >= 1 << 63:
                raise ValueError("hard negatives: the components are too large for exact scores of 64 bits")
            exact = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
            lists = Lists(vectors["vec_id"].to_numpy(), vectors["label"].to_numpy(), rows, exact)
            for anchor, query in zip(anchors.itertuples(index=False), asked):
                if same_label:
                    places, low, high, floor = [0], [least], [most], [None]
                    allowed = lists.ids != anchor.anchor_id
                else:
                    allowed = lists.labels != anchor.anchor_label
                    # LOW and HIGH in whole numbers: 50 s <= 100 t <= 95 s
                    wanted = [(w["p"], -(-w["score"] // 2), 19 * w["score"] // 20, w["floor"]) for w in anchor.windows]
                    wanted = [w for w in wanted if w[1] <= w[2]]
                    places, low, high, floor = map(list, zip(*wanted)) if wanted else ([], [], [], [])
                for p, (found, score) in zip(places, lists.search(query, allowed, low, high, floor, k)[0]):
                    out["anchor_id"].extend([anchor.anchor_id] * len(found))
                    out["anchor_label"].extend([anchor.anchor_label] * len(found))
                    out["twin"].extend([anchor.twin] * len(found))
                    out["p"].extend([p] * len(found))
                    out["vec_id"].extend(lists.ids[found].tolist())
                    out["score"].extend(score.tolist())
        return pd.DataFrame({c: np.array(v, dtype=np.int64) for c, v in out.items()})
    return run


def _best(found: DataFrame, k: int, place: str) -> DataFrame:
    """The k best rows of each (anchor, p), numbered from 1 in ``place``."""
    order = Window.partitionBy("anchor_id", "anchor_label", "twin", "p").orderBy(F.desc("score"), "vec_id")
    return found.withColumn(place, F.row_number().over(order)).filter(F.col(place) <= k)


def _numbers(count: Column) -> Column:
    return F.sequence(F.lit(0).cast("long"), count - 1)


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, id_col: str = "vec_id", vector_col: str = "embedding",
                   label_col: str = "label", flip_every: int = 7, labels: int = 10, shard_rows: int = SHARD_ROWS, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each id divisible by ``every``."""
    rows = stored(prepared(vectors, id_col, vector_col, label_col, flip_every, labels), "vectors")
    anchors = stored(rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"),
                                                                      F.xxhash64("v").alias("twin"), "v").dropDuplicates(["anchor_id", "anchor_label", "twin"]), "anchors")
    pieces = lambda n, size: F.greatest(F.lit(1).cast("long"), F.ceil(n / size))

    # positives: shards and blocks of one label
    sizes = (rows.groupBy("label").agg(pieces(F.count("*"), shard_rows).alias("shards"))
             .join(anchors.groupBy(F.col("anchor_label").alias("label")).agg(pieces(F.count("*"), anchor_rows).alias("blocks")), "label"))
    sizes = stored(sizes, "label-sizes")
    left = (rows.join(sizes, "label").withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.col("shards")))
            .select("vec_id", "label", "v", "shard", F.explode(_numbers(F.col("blocks"))).alias("block")))
    right = (anchors.join(sizes, F.expr("anchor_label = label")).withColumn("block", F.pmod(F.xxhash64("anchor_id", "twin"), F.col("blocks")))
             .select("anchor_id", "anchor_label", "twin", "v", "label", "block", F.explode(_numbers(F.col("shards"))).alias("shard")))
    keys = ["label", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_search(positives, True), FOUND)
    best = stored(_best(found, positives, "place"), "positives")
    chosen = best.groupBy("anchor_id", "anchor_label", "twin").agg(
        F.collect_list(F.struct(F.col("place").alias("p"), "score", F.lit(None).cast("long").alias("floor"))).alias("windows"))
    asked = stored(anchors.join(chosen, ["anchor_id", "anchor_label", "twin"]), "asked")

    # negatives: shards of all rows, the first one ahead of the others
    shards, blocks = max(1, -(-rows.count() // shard_rows)), max(1, -(-asked.count() // anchor_rows))
    dealt_rows = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)))

    def search(some: DataFrame, ask: DataFrame, first: int, last: int) -> DataFrame:
        a = some.filter(F.col("shard").between(first, last)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        b = ask.withColumn("block", F.pmod(F.xxhash64("anchor_id", "twin"), F.lit(blocks)).cast("int")).withColumn(
            "shard", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))))
        return a.groupBy("shard", "block").cogroup(b.groupBy("shard", "block")).applyInPandas(_search(negatives, False), FOUND)
    some = stored(_best(search(dealt_rows, asked, 0, 0), negatives, "place"), "negatives-first")
    if shards > 1:
        known = some.filter(F.col("place") == negatives).groupBy("anchor_id", "anchor_label", "twin").agg(
            F.map_from_entries(F.collect_list(F.struct("p", "score"))).alias("known"))
        floors = F.transform("windows", lambda w: F.struct(w["p"].alias("p"), w["score"].alias("score"), F.try_element_at("known", w["p"]).alias("floor")))
        sharper = asked.join(known, ["anchor_id", "anchor_label", "twin"], "left").withColumn("windows", floors).drop("known")
        some = some.drop("place").unionByName(search(dealt_rows, sharper, 1, shards - 1))
        out = _best(some, negatives, "rank")
    else:
        out = some.withColumnRenamed("place", "rank")
    pairs = best.select("anchor_id", "anchor_label", "twin", F.col("place").alias("p"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return out.join(pairs, ["anchor_id", "anchor_label", "twin", "p"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
