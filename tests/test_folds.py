"""Means and models of all folds at once against one fit per fold."""

import numpy as np
import pandas as pd
import pytest
from test_numeric import cov_frame, mean_by_loop, spd

from trialframe.functions import kernels as K
from trialframe.operators import align as A
from trialframe.operators import classify as C
from trialframe.operators import foldwise as W


def jobs(spark, action):
    """Number of Spark jobs of an action."""
    sc = spark.sparkContext
    name = f"jobs-{np.random.default_rng().integers(1 << 60)}"
    sc.setJobGroup(name, name)
    try:
        out = action()
    finally:
        found = len(sc.statusTracker().getJobIdsForGroup(name))
        sc.setJobGroup("", "")
    return out, found


def spread(rng, n, d, decades):
    q = np.linalg.qr(rng.standard_normal((n, d, d)))[0]
    return np.einsum("nij,nj,nkj->nik", q, 10.0 ** rng.uniform(-decades, decades, (n, d)), q)


def test_means_of_spread_near_singular_and_plain_groups_settle(spark):
    rng = np.random.default_rng(31)
    near = spd(rng, 9, 4)
    near[:, :, 0] = near[:, :, 1]
    near[:, 0, :] = near[:, 1, :]  # singular but for rounding
    near += 1e-10 * np.eye(4)
    parts = [spread(rng, 7, 4, 2.0), spread(rng, 40, 4, 1.0), near, spd(rng, 30, 4), spd(rng, 1, 4)]
    c, g = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    out = A.riemannian_mean(cov_frame(spark, c, g=g), ["g"], 4).toPandas().set_index("g")
    for k, p in enumerate(parts):
        m = np.asarray(out.loc[k, "mean"]).reshape(4, 4)
        w = K.powm(m, -0.5)
        gradient = np.linalg.norm(K.logm(w @ p @ w).mean(axis=0))
        assert gradient < 1e-5 if k == 2 else gradient < 1e-8, (k, gradient)
        assert out.loc[k, "norm"] < 1e-6
        assert np.allclose(np.asarray(out.loc[k, "isqrt"]).reshape(4, 4) @ m @ np.asarray(out.loc[k, "isqrt"]).reshape(4, 4), np.eye(4), atol=1e-4)
    assert A.riemannian_mean(cov_frame(spark, c, g=g).filter("false"), ["g"], 4).count() == 0


def test_a_group_that_does_not_settle_comes_back_with_its_norm(spark):
    c = spread(np.random.default_rng(5), 7, 4, 2.5)
    assert A.riemannian_mean(cov_frame(spark, c, g=0), ["g"], 4, max_rounds=40).head()["norm"] < 1e-6
    bounded = A.riemannian_mean(cov_frame(spark, c, g=0), ["g"], 4, max_rounds=1).head()
    assert bounded["norm"] > 1e-9 and len(bounded["mean"]) == 16


def fold_data(rng, n=60, d=3, folds=4):
    y = np.arange(n) % 3
    centres = np.stack([np.diag(v) for v in ([4.0, 1, 1], [1, 4.0, 1], [1, 1, 4.0])])
    c = np.stack([K.powm(centres[k], 0.5) @ m @ K.powm(centres[k], 0.5) for k, m in zip(y, spd(rng, n, d))])
    return c, y, rng.integers(0, folds, n)


def test_train_means_of_every_fold_and_class(spark, monkeypatch):
    c, y, f = fold_data(np.random.default_rng(11))
    for state_bytes in (W.STATE_BYTES, 1):  # one block of states, and a block per state
        monkeypatch.setattr(W, "STATE_BYTES", state_bytes)
        rows = W.chunked(cov_frame(spark, c, y=y, fold=f), 8 * 9)
        out = A.train_means(rows, "fold", 3, "y").collect()
        assert len(out) == 12
        for r in out:
            assert np.allclose(np.asarray(r["mean"]).reshape(3, 3), mean_by_loop(c[(f != r["fold"]) & (y == r["y"])]), atol=1e-7)


def direct_logistic(x, y, k, xt, c=1.0):
    """Newton's method for one fold, the last class's intercept held at 0."""
    x, xt = (np.column_stack([v, np.ones(len(v))]) for v in (x, xt))
    m = x.shape[1]
    free = np.tile(np.r_[np.ones(m - 1), 0.0], k)
    t = np.zeros(k * m)
    hold = np.arange(k * m) != k * m - 1

    def objective(t):
        z = x @ t.reshape(k, m).T
        top = z.max(axis=1)
        return (np.log(np.exp(z - top[:, None]).sum(axis=1)) + top - z[np.arange(len(y)), y]).sum() + (t * t * free).sum() / (2 * c)

    for _ in range(200):
        z = x @ t.reshape(k, m).T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        grad = ((p - np.eye(k)[y]).T @ x).ravel() + free * t / c
        h = np.diag(free / c) + sum(np.kron(np.diag(q) - np.outer(q, q), np.outer(v, v)) for q, v in zip(p, x))
        step = np.zeros(k * m)
        step[hold] = np.linalg.solve(h[np.ix_(hold, hold)], grad[hold])
        a = 1.0
        while objective(t - a * step) > objective(t) and a > 1e-8:
            a /= 2
        t = t - a * step
    z = xt @ t.reshape(k, m).T
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def test_logistic_regression_of_all_folds_equals_one_fit_per_fold(spark):
    rng = np.random.default_rng(12)
    y, f = rng.integers(0, 3, 120), rng.integers(0, 5, 120)
    x = rng.standard_normal((120, 4)) * [1, 3, 0.1, 10] + 2.0 * np.eye(3, 4)[y]
    f[y == 2] = np.where(f[y == 2] == 4, 3, f[y == 2])
    y[(f != 4) & (y == 2)] = 1
    y[f == 4] = 2  # class 2 is only in fold 4: its model never sees it
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(120), "y": y, "fold": f, "f": x.tolist()}))
    p = W.logistic_folds(W.chunked(df, 32), "fold", 3, ["id", "y", "fold"], C._given(4), 4).toPandas().sort_values("id")
    got = np.stack(p["probs"])
    for k in range(5):
        train, test = f != k, f == k
        present = np.unique(y[train])
        want = np.zeros((test.sum(), 3))
        want[:, present] = direct_logistic(x[train], np.searchsorted(present, y[train]), len(present), x[test])
        assert np.abs(got[test] - want).max() < 1e-6


def test_separable_and_single_fold_rows(spark):
    x = np.r_[np.linspace(-9, -8, 10), np.linspace(8, 9, 10)][:, None]
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(20), "y": np.repeat([0, 1], 10), "fold": np.arange(20) % 2, "f": x.tolist()}))
    p = W.logistic_folds(W.chunked(df, 8), "fold", 2, ["id", "y"], C._given(1), 1).toPandas()
    assert all(r["probs"][r["y"]] > 0.9 for _, r in p.iterrows())
    one = W.logistic_folds(W.chunked(df.filter("fold = 0"), 8), "fold", 2, ["id"], C._given(1), 1).toPandas()
    assert one["probs"].isna().all() and len(one) == 10


def test_tangent_models_equal_one_fit_per_fold(spark):
    c, y, f = fold_data(np.random.default_rng(13))
    df = cov_frame(spark, c, y=y, fold=f)
    keep = ["id", "y", "fold"]
    tangent = C.riemann_folds(df, "fold", 3, 3, keep).toPandas().sort_values("id")
    nearest = C.mdm_folds(df, "fold", 3, 3, keep).toPandas().sort_values("id")
    projected = C.fgmdm_folds(df, "fold", 3, 3, keep).toPandas().sort_values("id")
    for k in range(4):
        train, test = f != k, f == k
        ref = K.powm(mean_by_loop(c[train]), -0.5)
        v = K.upper_vector(K.logm(ref @ c @ ref))
        assert np.abs(np.stack(tangent["probs"])[test] - direct_logistic(v[train], y[train], 3, v[test])).max() < 1e-6
        dist = lambda a, means: np.stack([(np.log(np.linalg.eigvalsh(K.powm(m, -0.5) @ a @ K.powm(m, -0.5))) ** 2).sum(axis=1) for m in means], axis=1)
        soft = lambda z: np.exp(z - z.max(axis=1, keepdims=True)) / np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)
        assert np.abs(np.stack(nearest["probs"])[test] - soft(-dist(c[test], [mean_by_loop(c[train & (y == j)]) for j in range(3)]))).max() < 1e-6
        within = np.concatenate([v[train & (y == j)] - v[train & (y == j)].mean(axis=0) for j in range(3)])
        coef = np.stack([v[train & (y == j)].mean(axis=0) for j in range(3)]) @ np.linalg.pinv(within.T @ within / train.sum())
        q = np.linalg.svd((coef - coef.mean(axis=0)).T, full_matrices=False)[0][:, :2]
        back = K.expm(K.from_upper_vector(v @ q @ q.T, 3))
        root = np.linalg.inv(ref)
        back = root @ back @ root
        assert np.abs(np.stack(projected["probs"])[test] - soft(-dist(back[test], [mean_by_loop(back[train & (y == j)]) for j in range(3)]))).max() < 1e-5


def test_the_number_of_jobs_does_not_depend_on_the_number_of_folds(spark):
    c, y, f = fold_data(np.random.default_rng(14), 200, 3, 50)
    rounds = []
    for folds in (5, 50):
        rows = W.chunked(cov_frame(spark, c, y=y, fold=f % folds), 72)
        refs = spark.createDataFrame([(k, K.powm(c.mean(axis=0), -0.5).ravel().tolist()) for k in range(folds)], "fold long, ref array<double>")
        _, n = jobs(spark, lambda: W.logistic_folds(rows, "fold", 3, ["id"], C._tangent(3), 6, refs, max_rounds=3).collect())
        rounds.append(n)
    assert abs(rounds[0] - rounds[1]) <= 0.25 * rounds[0], rounds


@pytest.mark.parametrize("name", ["rpa", "mdwm"])
def test_calibrated_transfer_recovers_a_turned_target(spark, name):
    rng = np.random.default_rng(15)
    c, y, _ = fold_data(rng, 90)
    t, yt, _ = fold_data(rng, 60)
    turn = np.linalg.qr(rng.standard_normal((3, 3)))[0] * 1.4
    t = turn @ t @ turn.T
    src, tgt = cov_frame(spark, c, y=y), cov_frame(spark, t, y=yt)
    p = C.calibrated_transfer(name, src, tgt.filter("id < 30"), tgt.filter("id >= 30"), 3, 3, ["id", "y"], lam=0.0).toPandas()
    assert len(p) == 30 and np.mean([np.argmax(r["probs"]) == r["y"] for _, r in p.iterrows()]) > 0.8
