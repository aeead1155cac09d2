"""M1-M8: bipartite graph, propagation and pair scoring as joins + vector sums.

Node ids: user u -> 2u, item i -> 2i+1 (bijective, no id offset to compute).
Vectors are rows ``(node, vec array<double>)``. A sparse-matrix product is
an equi-join of the edge table with the vector table on ``src`` followed by
a per-``dst`` vector sum (one ``sum`` per dimension: partial aggregation, so
a popular node is combined map-side before the shuffle).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import bce_with_logits, dot, hash_signed, sigmoid


def user_node(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c) * 2


def item_node(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c) * 2 + 1


def adjacency(train: DataFrame) -> DataFrame:
    """M1: edges(src, dst, w) from positive rows, both directions, duplicates
    summed, normalised w / sqrt(d_src * d_dst). Isolated nodes have no edge."""
    pos = train.where(F.col("label") > 0).select(user_node("uid").alias("a"), item_node("iid").alias("b"),
                                                 F.col("label").cast("double").alias("v"))
    one = pos.groupBy("a", "b").agg(F.sum("v").alias("v"))
    both = one.select(F.col("a").alias("src"), F.col("b").alias("dst"), "v").unionByName(
        one.select(F.col("b").alias("src"), F.col("a").alias("dst"), "v"))
    deg = both.groupBy("src").agg(F.sum("v").alias("d"))
    e = both.join(deg, "src").join(deg.select(F.col("src").alias("dst"), F.col("d").alias("d2")), "dst")
    w = F.when((F.col("d") > 0) & (F.col("d2") > 0), F.col("v") / F.sqrt(F.col("d") * F.col("d2"))).otherwise(0.0)
    return e.select("src", "dst", w.alias("w"))


def vec_sum(c: str, dim: int) -> list[Column]:
    return [F.sum(F.col(c)[k]).alias(f"_s{k}") for k in range(dim)]


def spmm(edges: DataFrame, vecs: DataFrame, dim: int) -> DataFrame:
    """One product A·V: (node, vec) for every node with an in-edge."""
    j = edges.join(vecs.select(F.col("node").alias("src"), "vec"), "src")
    j = j.select("dst", F.transform("vec", lambda x: x * F.col("w")).alias("_wv"))
    g = j.groupBy("dst").agg(*vec_sum("_wv", dim))
    return g.select(F.col("dst").alias("node"), F.array(*[F.col(f"_s{k}") for k in range(dim)]).alias("vec"))


def propagate(edges: DataFrame, emb: DataFrame, layers: int, dim: int, small: bool = False) -> DataFrame:
    """M2: mean of E_0, A E_0, ..., A^L E_0 (nodes without edges keep E_0/(L+1)).

    Horner's form E_0 + A (E_0 + A (...)): one product and one aggregate per
    layer, the sum with E_0 inside the aggregate. ``small``: the caller has
    counted the nodes, and their vectors may be broadcast to the edges."""
    near = F.broadcast if small else (lambda df: df)
    cur = emb
    for _ in range(layers):
        moved = edges.join(near(cur.withColumnRenamed("node", "src")), "src").select(F.col("dst").alias("node"), "vec", "w")
        both = emb.select("node", "vec", F.lit(1.0).alias("w")).unionByName(moved)
        g = both.groupBy("node").agg(*[F.sum(F.col("vec")[k] * F.col("w")).alias(f"_s{k}") for k in range(dim)])
        cur = g.select("node", F.array(*[F.col(f"_s{k}") for k in range(dim)]).alias("vec"))
    inv = 1.0 / (layers + 1)
    return cur.select("node", F.transform("vec", lambda v: v * inv).alias("vec"))


def hashed_embeddings(nodes: DataFrame, dim: int, seed: int = 11, scale: float = 0.1) -> DataFrame:
    """Deterministic initial vectors: md5(seed:node:k) in [-scale, scale]."""
    return nodes.select("node", F.array(*[hash_signed(seed, "node", k) * scale for k in range(dim)]).alias("vec"))


def graph_nodes(*pairs: DataFrame) -> DataFrame:
    """All user and item nodes of the given (uid, iid) tables."""
    out = None
    for p in pairs:
        n = p.select(user_node("uid").alias("node")).unionByName(p.select(item_node("iid").alias("node")))
        out = n if out is None else out.unionByName(n)
    return out.distinct()


def sides(z: DataFrame, user: str, item: str) -> tuple[DataFrame, DataFrame]:
    """The users' vectors as (_un, ``user``) and the items' as (_in, ``item``): a join of pairs moves
    its own kind of nodes only, and where one kind is small the rows stay where they are."""
    return (z.where(F.col("node") % 2 == 0).select(F.col("node").alias("_un"), F.col("vec").alias(user)),
            z.where(F.col("node") % 2 != 0).select(F.col("node").alias("_in"), F.col("vec").alias(item)))


def gather(pairs: DataFrame, z: DataFrame) -> DataFrame:
    """Attach user and item vectors to (uid, iid, ...) rows."""
    zu, zi = sides(z, "zu", "zi")
    x = pairs.withColumn("_un", user_node("uid")).withColumn("_in", item_node("iid"))
    # a pair without a vector keeps its row (null vector, null score)
    return x.join(zu, "_un", "left").join(zi, "_in", "left").drop("_un", "_in")


def score_pairs(pairs: DataFrame, z: DataFrame, with_sigmoid: bool = False) -> DataFrame:
    """M3 (+P11): logit = z_u . z_i, optional probability."""
    g = gather(pairs, z).withColumn("logit", dot("zu", "zi"))
    if with_sigmoid:
        g = g.withColumn("prob", sigmoid("logit"))
    return g.drop("zu", "zi")


def what_if_scores(edges: DataFrame, emb: DataFrame, pairs: DataFrame, layers: int, dim: int) -> DataFrame:
    """M4: sigmoid scores of ``pairs`` when the graph were ``edges``
    (``adjacency`` of other interactions), embeddings unchanged."""
    return score_pairs(pairs, propagate(edges, emb, layers, dim), with_sigmoid=True)


def bce_loss(scored: DataFrame, reduction: str = "mean") -> DataFrame:
    """M6: BCE with logits over a scored pair table."""
    agg = F.avg if reduction == "mean" else F.sum
    return scored.agg(agg(bce_with_logits("logit", "label")).alias(f"bce_{reduction}"))


def bpr_loss(triples: DataFrame, z: DataFrame, e0: DataFrame) -> DataFrame:
    """M7: mean log(1 + exp(neg - pos)) over (uid, pos_iid, neg_iid) and the
    L2 term: half the squared norms of the initial vectors of the three
    nodes, divided by the number of triples."""
    from ..functions.exprs import vec_norm2
    zu = z.select(F.col("node").alias("_u"), F.col("vec").alias("zu"))
    zp = z.select(F.col("node").alias("_p"), F.col("vec").alias("zp"))
    zn = z.select(F.col("node").alias("_n"), F.col("vec").alias("zn"))
    eu = e0.select(F.col("node").alias("_u"), F.col("vec").alias("eu"))
    ep = e0.select(F.col("node").alias("_p"), F.col("vec").alias("ep"))
    en = e0.select(F.col("node").alias("_n"), F.col("vec").alias("en"))
    t = triples.select(user_node("uid").alias("_u"), item_node("pos_iid").alias("_p"), item_node("neg_iid").alias("_n"))
    t = t.join(zu, "_u").join(zp, "_p").join(zn, "_n").join(eu, "_u").join(ep, "_p").join(en, "_n")
    diff = dot("zu", "zn") - dot("zu", "zp")
    soft = F.when(diff > 0, diff + F.log1p(F.exp(-diff))).otherwise(F.log1p(F.exp(diff)))
    reg = 0.5 * (vec_norm2("eu") + vec_norm2("ep") + vec_norm2("en"))
    return t.agg(F.avg(soft).alias("bpr_loss"), (F.sum(reg) / F.count(F.lit(1))).alias("reg_loss"))


def ncf_weights(dim: int, hidden: int, seed: int = 5):
    """Deterministic small MLP weights (python floats, md5-derived)."""
    import hashlib

    def h(*p):
        v = int(hashlib.md5(":".join(map(str, p)).encode()).hexdigest()[:8], 16) / 4294967295.0
        return (v * 2 - 1) * 0.3
    w1 = [[h(seed, "w1", j, k) for k in range(2 * dim)] for j in range(hidden)]
    b1 = [h(seed, "b1", j) for j in range(hidden)]
    w2 = [h(seed, "w2", j) for j in range(hidden)]
    b2 = h(seed, "b2")
    return w1, b1, w2, b2


def ncf_score(pairs: DataFrame, emb: DataFrame, weights) -> DataFrame:
    """M8: concat(user, item) -> linear -> ReLU -> linear, one matrix product
    per Arrow batch. The weights (2 * dim * hidden numbers) travel with the
    function. A pair without a vector has a null logit."""
    w1, b1, w2, b2 = (np.asarray(w, dtype=np.float64) for w in weights)

    @F.pandas_udf("double")
    def logit(x: pd.Series) -> pd.Series:
        known = x.notna()
        out = pd.Series(np.nan, index=x.index).astype("Float64")
        if known.any():
            hidden = np.maximum(np.stack(x[known].to_numpy()) @ w1.T + b1, 0.0)
            out[known] = hidden @ w2 + b2
        out[~known] = pd.NA
        return out
    g = gather(pairs, emb)
    return g.withColumn("logit", logit(F.concat("zu", "zi"))).drop("zu", "zi")
