import math
import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from helpers import SF001  # noqa: E402
from thawline.llm import hard_negatives, registry  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, label int, v string, shard string, p string, anchor_id string, twin string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA)


def brute(rows, every=50, k=5, m=3):
    part = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        part.append((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in v)))
    out = []
    for anchor in sorted({r for r in part if r[0] % every == 0}):
        scored = sorted(((-sum(a * b for a, b in zip(anchor[2], v)), i, label) for i, label, v in part if i != anchor[0]))
        for s, i, label in [r for r in scored if r[2] == anchor[1]][:k]:
            fine = [r for r in scored if r[2] != anchor[1] and -50 * s <= -100 * r[0] <= -95 * s][:m]
            out += [(anchor[0], i, rank, r[1], -s, -r[0]) for rank, r in enumerate(fine, 1)]
    return sorted(out)


def got(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def vectors(rng, n, width=6, labels=4, grid=8):
    """Few distinct components, so that scores tie; a third of the rows are copies of one vector."""
    draw = lambda: [np.float32(rng.randint(-grid, grid) / grid).item() for _ in range(width)]
    hot = draw()
    return [(k, hot if rng.random() < 0.33 else draw(), 1 if rng.random() < 0.33 else rng.randrange(labels)) for k in range(n)]


@pytest.mark.parametrize("limits", [{}, {"shard_rows": 37, "anchor_rows": 2}, {"shard_rows": 100}])
def test_equal_to_brute_force(spark, limits):
    rows = vectors(random.Random(1), 420)
    want = brute(rows, every=10)
    assert len(want) > 200
    assert got(hard_negatives.hard_negatives(frame(spark, rows), every=10, **limits)) == want


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(random.Random(2), 60, width=3)
    rows += [(None, [1.0, 1.0, 1.0], 1), (100, None, 1), (150, [1.0, None, 1.0], 1), (200, [1.0, nan, 1.0], 1), (250, [inf, 1.0, 1.0], 1),
             (300, [1.0, 1.0, 1.0], None), (350, [], 1), (400, [0.0, 0.0, 0.0], 2), (450, [1.0], 3), (500, [-1.0, -1.0, -1.0], 1)]
    rows += [(7, [0.5, 0.5, 0.5], 2), (50, [0.5, 0.25, 0.5], 2)] + rows[:9]  # repeated ids and rows
    assert got(hard_negatives.hard_negatives(frame(spark, rows), shard_rows=20)) == brute(rows)


def test_empty_and_lonely(spark):
    assert got(hard_negatives.hard_negatives(frame(spark, []))) == []
    assert got(hard_negatives.hard_negatives(frame(spark, [(50, [1.0], 1)]))) == []
    assert got(hard_negatives.hard_negatives(frame(spark, [(50, [1.0], 1), (51, [1.0], 1)]))) == []


def test_large_components_are_exact_or_an_error(spark):
    rows = [(50, [30000.0, 0.25], 1), (51, [30000.0, 0.5], 1), (52, [20000.0, 7.0], 2), (53, [20000.0, 7.5], 3)]
    assert got(hard_negatives.hard_negatives(frame(spark, rows))) == brute(rows)
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives.hard_negatives(frame(spark, [(50, [1e12], 1), (51, [1e12], 1)])).collect()


def test_sorted_access_stops_early():
    """On vectors with few strong rows the search scores a small part of the shard, and finds the best."""
    rng = np.random.default_rng(4)
    rows = rng.integers(-5, 6, size=(4000, 4))
    rows[::500] += 200
    lists = hard_negatives.Lists(np.arange(4000), np.zeros(4000, dtype=int), rows, np.int64)
    query = np.array([3, 2, 1, 4])
    (best,), scored = lists.search(query, np.ones(4000, dtype=bool), [-10**9], [10**9], [None], 3)
    order = np.lexsort((np.arange(4000), -(rows @ query)))[:3]
    assert best[0].tolist() == order.tolist() and scored < 500
    # a window above every row closes by its lower end, one with a known k-th score by that
    (none,), scored = lists.search(query, np.ones(4000, dtype=bool), [10**6], [10**7], [None], 3)
    assert not len(none[0]) and scored < 500
    (_,), scored = lists.search(query, np.ones(4000, dtype=bool), [-10**9], [100], [90], 3)
    assert scored < 4000


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()]
    assert got(registry.op13_hard_negatives(spark, SF001)) == brute(rows)
