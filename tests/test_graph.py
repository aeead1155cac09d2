"""M1 symmetric, M2 vs dense numpy, M12 vs finite differences, M13 convex case."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from thawline.operators import graph as M
from thawline.operators import influence as IF


def _train(spark):
    rows = [(0, 0, 1), (0, 1, 1), (1, 1, 1), (2, 2, 1), (1, 0, 0), (2, 0, 1), (0, 0, 1)]  # duplicate edge, a negative
    return spark.createDataFrame(rows, "uid long, iid long, label int")


def _dense(edges, nodes):
    idx = {n: k for k, n in enumerate(nodes)}
    A = np.zeros((len(nodes), len(nodes)))
    for r in edges.collect():
        A[idx[r.src], idx[r.dst]] = r.w
    return A, idx


def test_adjacency_and_propagation(spark):
    tr = _train(spark)
    e = M.adjacency(tr)
    nodes = sorted(r.node for r in M.graph_nodes(tr).collect()) + [99]  # 99: isolated node
    A, idx = _dense(e, nodes)
    assert np.allclose(A, A.T)
    assert A[idx[0], idx[1]] == pytest.approx(2 / np.sqrt(3 * 3))  # duplicate summed; d_u = d_i = 3
    emb = M.hashed_embeddings(spark.createDataFrame([(n,) for n in nodes], "node long"), 3)
    E0 = np.zeros((len(nodes), 3))
    for r in emb.collect():
        E0[idx[r.node]] = r.vec
    Z = M.propagate(e, emb, 2, 3)
    exp = (E0 + A @ E0 + A @ A @ E0) / 3
    for r in Z.collect():
        assert np.allclose(r.vec, exp[idx[r.node]], atol=1e-12)


def test_hvp_matches_finite_differences(spark):
    tr = _train(spark)
    e = M.adjacency(tr)
    nodes = spark.createDataFrame([(n,) for n in sorted(r.node for r in M.graph_nodes(tr).collect())], "node long")
    emb = M.hashed_embeddings(nodes, 3, scale=0.5)
    v = M.hashed_embeddings(nodes, 3, seed=99, scale=1.0)
    m = IF.Model(e, emb, 1, 3)

    def grad_at(eps):
        shifted = IF.vlin(emb, v, 1.0, eps, 3)
        g = IF.gradient(IF.Model(e, shifted, 1, 3), tr)
        return {r.node: np.array(r.vec) for r in g.collect()}
    h = 1e-5
    gp, gm = grad_at(h), grad_at(-h)
    hv = {r.node: np.array(r.vec) for r in IF.hvp(m, tr, v, damp=0.0).collect()}
    for n in gp:
        assert np.allclose((gp[n] - gm[n]) / (2 * h), hv.get(n, 0), atol=1e-7)


def test_cg_converges_on_convex_case(spark):
    tr = _train(spark).withColumn("label", F.lit(1))
    e = M.adjacency(tr)
    nodes = spark.createDataFrame([(n,) for n in sorted(r.node for r in M.graph_nodes(tr).collect())], "node long")
    m = IF.Model(e, M.hashed_embeddings(nodes, 2, scale=0.1), 0, 2)
    b = IF.gradient(m, tr)
    res = IF.conjugate_gradient(m, tr, b, damp=1.0, tol=1e-18, max_iter=30)
    assert res.status == "converged"
    ax = IF.hvp(m, tr, res.x, damp=1.0)
    diff = IF.vlin(ax, b, 1.0, -1.0, 2)
    assert IF.vdot(diff, diff) < 1e-16


def test_neural_scores_and_propagation_at_128_dimensions(spark):
    """The reference's size: 128 dimensions, 64 hidden units, two layers."""
    import numpy as np
    dim, hidden = 128, 64
    pairs = spark.createDataFrame([(u, i, int((u + i) % 3 == 0)) for u in range(8) for i in range(6)], "uid long, iid long, label int")
    nodes = M.graph_nodes(pairs)
    emb = M.hashed_embeddings(nodes, dim, 3)
    e = {r.node: np.array(r.vec) for r in emb.collect()}
    w1, b1, w2, b2 = M.ncf_weights(dim, hidden)
    unknown = pairs.unionByName(spark.createDataFrame([(99, 0, 0)], "uid long, iid long, label int"))
    for r in M.ncf_score(unknown, emb, (w1, b1, w2, b2)).collect():
        if r.uid == 99:
            assert r.logit is None
            continue
        x = np.concatenate([e[2 * r.uid], e[2 * r.iid + 1]])
        assert r.logit == pytest.approx(float(np.maximum(np.array(w1) @ x + b1, 0) @ np.array(w2) + b2), abs=1e-9)
    adj = M.adjacency(pairs)
    index = {n: k for k, n in enumerate(sorted(e))}
    a = np.zeros((len(e), len(e)))
    for r in adj.collect():
        a[index[r.dst], index[r.src]] = r.w
    e0 = np.stack([e[n] for n in sorted(e)])
    want = (e0 + a @ e0 + a @ a @ e0) / 3
    for r in M.propagate(adj, emb, 2, dim).collect():
        assert np.allclose(r.vec, want[index[r.node]], atol=1e-12)


def test_a_solve_that_does_not_converge_raises(spark):
    pairs = spark.createDataFrame([(u, i, int((u * i) % 2)) for u in range(5) for i in range(4)], "uid long, iid long, label int")
    nodes = M.graph_nodes(pairs)
    m = IF.Model(M.adjacency(pairs), M.hashed_embeddings(nodes, 2, scale=0.1), 1, 2)
    b = IF.gradient(m, pairs)
    with pytest.raises(RuntimeError):
        IF.solve(m, pairs, b, damp=1.0, tol=1e-30, max_iter=1)


def test_early_stop_returns_the_best_epoch(spark):
    pairs = spark.createDataFrame([(u, i, int((u + i) % 3 == 0)) for u in range(7) for i in range(6)], "uid long, iid long, label int")
    m = IF.Model(M.adjacency(pairs), M.hashed_embeddings(M.graph_nodes(pairs), 3, scale=0.2), 1, 3)
    best, log = IF.fit_early(m, pairs, pairs, max_epochs=6, patience=2, lr=4.0)
    values = [v for _, v in log]
    top = values.index(max(values))
    assert len(log) == min(6, top + 3) and [e for e, _ in log] == list(range(len(log)))
    same = IF.fit(m, pairs, epochs=top + 1, lr=4.0)
    a = {r.node: r.vec for r in best.emb.collect()}
    b = {r.node: r.vec for r in same.emb.collect()}
    assert a.keys() == b.keys() and all(a[n] == pytest.approx(b[n], abs=1e-12) for n in a)


def _small_model(spark, dim=3, scale=0.2):
    pairs = spark.createDataFrame([(u, i, int((u + i) % 3 == 0)) for u in range(7) for i in range(6)], "uid long, iid long, label int")
    return pairs, IF.Model(M.adjacency(pairs), M.hashed_embeddings(M.graph_nodes(pairs), dim, scale=scale), 1, dim)


def test_a_fit_ends_by_the_valid_auc_or_raises(spark):
    pairs, m = _small_model(spark)
    m = IF.Model(m.edges, m.emb, 0, m.dim)
    _, log = IF.fit_valid(m, pairs, pairs, patience=1, lr=4.0)
    assert len(log) == IF.best_epoch(log) + 2
    with pytest.raises(RuntimeError, match="ceiling"):
        IF.fit_valid(m, pairs, pairs, patience=1, lr=4.0, max_epochs=1)
    with pytest.raises(RuntimeError, match="no AUC"):
        IF.fit_valid(m, pairs, pairs.where("label = 1"), patience=1, lr=4.0)


def _chain(spark):
    pairs, _ = _small_model(spark)
    syn = pairs.withColumn("row_id", F.col("uid") * 6 + F.col("iid")).where("uid < 4")
    return pairs, syn


def test_a_run_goes_on_behind_its_last_committed_round(spark, tmp_path):
    """Rounds, a break in the middle of one, the rest of them: the same report as in one go; a second run changes nothing."""
    from dataclasses import replace

    from thawline.plans import iterate as C
    pairs, syn = _chain(spark)
    opts = C.IterOptions(rounds=2, dim=3, layers=0, patience=1, min_gain=0.2, min_item_num=1, ratio=0.2)
    run = lambda path, o=opts: sorted(map(tuple, C.iterated_selection(pairs, pairs, {"valid_0": pairs}, syn, o, str(tmp_path / path)).select(
        "round", "split", F.round("auc", 9), F.round("logloss", 9), "delete_ratio", "epochs", "best_epoch", "cg_steps").collect()))
    whole = run("a")
    assert [r[0] for r in whole] == [0, 1] and run("a") == whole
    run("b", replace(opts, rounds=1))
    rounds = C.Rounds(spark, str(tmp_path / "b"))
    broken = C.Rounds(spark, str(tmp_path / "a")).get("scores", 1).withColumn("score", F.col("score") * 0 + 7.0)
    rounds.put("scores", 1, broken.unionByName(broken))  # half a round: scores without its commit
    assert len(rounds.done()) == 1 and run("b") == whole
    scores = rounds.all("scores", 2)
    assert scores.groupBy("iter", "row_id").count().filter("count > 1").isEmpty() and scores.count() == syn.count()
    report = C.ensemble_inference(syn, scores.select("iter", "row_id", "score"), pairs, pairs, M.graph_nodes(pairs), {"valid_0": pairs}, opts).collect()
    assert len(report) == 1 and report[0].epochs >= report[0].best_epoch


def test_fits_end_by_the_valid_auc_and_go_on_from_vectors(spark):
    pairs, m = _small_model(spark)
    m = IF.Model(m.edges, m.emb, 0, m.dim)
    fit = IF.fit_adam(m, pairs, pairs, patience=1, lr=0.1, min_gain=0.1)
    assert len(fit.log) == fit.clock + 2
    again = IF.fit_adam(m, pairs, pairs, patience=1, lr=0.1, start=fit, min_gain=0.2)
    assert again.log[0][1] == pytest.approx(fit.log[fit.clock][1], abs=1e-9)
    with pytest.raises(RuntimeError, match="ceiling"):
        IF.fit_adam(m, pairs, pairs, patience=1, lr=0.1, max_epochs=1)
    with pytest.raises(RuntimeError, match="no AUC"):
        IF.fit_adam(m, pairs, pairs.where("label = 1"), patience=1)


def test_an_adam_step_of_the_propagated_model_equals_numpy(spark):
    pairs, m = _small_model(spark)
    zero = F.array_repeat(F.lit(0.0), m.dim)
    state = m.emb.select("node", "vec", zero.alias("m"), zero.alias("v"))
    g = {r.node: np.array(r.vec) for r in IF.gradient(m, pairs).collect()}
    e = {r.node: np.array(r.vec) for r in m.emb.collect()}
    for r in IF._adam(state, IF.gradient(m, pairs), 1, 0.1, 0.01, m.dim).collect():
        d = g.get(r.node, np.zeros(m.dim)) + 0.01 * e[r.node]
        assert np.allclose(r.vec, e[r.node] - 0.1 * d / (np.abs(d) + 1e-8), atol=1e-10)


def test_gauss_newton_solve_equals_a_dense_one(spark):
    """On a model whose Hessian is indefinite the Gauss-Newton solve converges to the dense solution."""
    pairs, m = _small_model(spark, scale=1.5)
    nodes = sorted(r.node for r in m.emb.collect())
    index = {n: k for k, n in enumerate(nodes)}
    a = np.zeros((len(nodes), len(nodes)))
    for r in m.edges.collect():
        a[index[r.dst], index[r.src]] = r.w
    p = (np.eye(len(nodes)) + a) / 2
    e = np.zeros((len(nodes), 3))
    for r in m.emb.collect():
        e[index[r.node]] = r.vec
    z, rows = p @ e, pairs.collect()
    g, b = np.zeros((z.size, z.size)), np.zeros_like(z)
    for r in rows:
        u, i = index[2 * r.uid], index[2 * r.iid + 1]
        s = 1 / (1 + np.exp(-z[u] @ z[i]))
        j = np.zeros_like(z)
        j[u], j[i] = z[i], z[u]
        j = (p @ j).ravel()
        g += s * (1 - s) / len(rows) * np.outer(j, j)
        b += ((s - r.label) / len(rows) * j).reshape(z.shape)
    want = np.linalg.solve(g + 0.05 * np.eye(z.size), b.ravel()).reshape(z.shape)
    res = IF.solve(m, pairs, IF.gradient(m, pairs), damp=0.05, tol=1e-14, gauss_newton=True)
    got = np.zeros_like(z)
    for r in res.x.collect():
        got[index[r.node]] = r.vec
    assert res.status == "converged" and np.allclose(got, want, atol=1e-5)


def test_top_items_equal_brute_force_and_prune(spark):
    from thawline.operators.topitems import top_items
    rng = np.random.default_rng(5)
    rows = [(2 * u, rng.normal(size=4).tolist()) for u in range(40)]
    rows += [(2 * i + 1, (rng.integers(-2, 3, size=4) * 10.0 ** -(i // 50)).tolist()) for i in range(300)]  # ties, and ever shorter vectors
    z = spark.createDataFrame(rows, "node long, vec array<double>")
    users = spark.createDataFrame([(u,) for u in range(41)], "uid long")  # one without a vector
    items = spark.createDataFrame([(i,) for i in range(300)], "iid long")
    v = {n: np.array(x) for n, x in rows}
    want = {}
    for u in range(40):
        s = sorted((-float(v[2 * u] @ v[2 * i + 1]), i) for i in range(300))[:7]
        want[u] = [(i, pytest.approx(-x, abs=1e-12)) for x, i in s]
    for sizes in ({}, {"user_rows": 7, "item_rows": 20}):
        log, got = [], {}
        for r in sorted(top_items(users, items, z, 7, log=log, **sizes).collect(), key=lambda r: (r.uid, r.rank)):
            got.setdefault(r.uid, []).append((r.iid, r.score))
        assert {u: [i for i, _ in x] for u, x in got.items()} == {u: [i for i, _ in x] for u, x in want.items()} and got == want
    met = sum(users_ * items_ for _, users_, items_, _ in log)
    assert met < log[0][3] * 15  # item blocks that no open user block met
    assert top_items(users, items.limit(0), z, 7).count() == 0


def test_a_solve_and_a_fit_hold_no_more_disk_after_more_steps(spark):
    import os

    from thawline.session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark).removeprefix("file:").rstrip("/") + "/tables"
    pairs = spark.createDataFrame([(u, i, (u * 3 + i) % 2) for u in range(6) for i in range(5)], "uid long, iid long, label int")
    m = IF.Model(M.adjacency(pairs), M.hashed_embeddings(M.graph_nodes(pairs), 2), 1, 2)
    b = IF.gradient(m, pairs)

    def left(job):
        before = set(os.listdir(base))
        job()
        return len(set(os.listdir(base)) - before)
    solve = lambda k: lambda: IF.conjugate_gradient(m, pairs, b, tol=0.0, max_iter=k, gauss_newton=True)
    assert left(solve(1)) == left(solve(3)) <= 3
    assert left(lambda: IF.fit(m, pairs, epochs=2)) == left(lambda: IF.fit(m, pairs, epochs=4))


def test_pairs_meet_only_their_own_kind_of_nodes(spark):
    z = spark.createDataFrame([(2 * k + s, [float(k + s)]) for k in range(4) for s in (0, 1)], "node long, vec array<double>")
    users, items = M.sides(z, "zu", "zi")
    assert sorted(r._un for r in users.collect()) == [0, 2, 4, 6]
    assert sorted(r._in for r in items.collect()) == [1, 3, 5, 7]
    pairs = spark.createDataFrame([(1, 2), (9, 1), (None, 3)], "uid long, iid long")
    assert {(r.uid, r.iid): r.logit for r in M.score_pairs(pairs, z).collect()} == {(1, 2): 3.0, (9, 1): None, (None, 3): None}


def test_early_fit_takes_the_auc_of_several_epochs_in_one_job(spark, monkeypatch):
    from thawline.operators import metrics
    calls, auc = [], metrics.auc
    monkeypatch.setattr(metrics, "auc", lambda *a, **k: calls.append(1) or auc(*a, **k))
    pairs, m = _small_model(spark)
    model, log = IF.fit_early(m, pairs, pairs, max_epochs=6, patience=9, lr=4.0)
    assert len(log) == 6 and len(calls) == 2
    alone = IF.fit(m, pairs, epochs=IF.best_epoch(log) + 1, lr=4.0)
    diff = IF.vlin(alone.emb, model.emb, 1.0, -1.0, m.dim)
    assert IF.vdot(diff, diff) < 1e-20
