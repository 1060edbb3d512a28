"""Kernels and model operators against brute force on small seeded data."""

import numpy as np
import pandas as pd
import pytest

from trialframe.functions import kernels as K
from trialframe.operators import align as A
from trialframe.operators import classify as C
from trialframe.operators import coupling as CO
from trialframe.operators import epoching as E
from trialframe.operators import metrics as M
from trialframe.operators import normalize as N
from trialframe.operators import retrieval as R
from trialframe.operators import spatial as SP

SF = "/root/testdata/sf0.001"


def spd(rng, n, d, scale=1.0):
    a = rng.standard_normal((n, d, 3 * d))
    return scale * a @ np.swapaxes(a, 1, 2) / (3 * d)


def cov_frame(spark, c, **cols):
    pdf = pd.DataFrame({"id": np.arange(len(c)), "cov": [m.reshape(-1).tolist() for m in c], **cols})
    return spark.createDataFrame(pdf).repartition(5)


def covs(df, d):
    pdf = df.orderBy("id").toPandas()
    return np.stack([np.asarray(x).reshape(d, d) for x in pdf["cov"]])


def mean_by_loop(c):
    m = c.mean(axis=0)
    for _ in range(200):
        root, inv = K.powm(m, 0.5), K.powm(m, -0.5)
        step = K.logm(inv @ c @ inv).mean(axis=0)
        m = root @ K.expm(step) @ root
        if np.linalg.norm(step) < 1e-12:
            break
    return m


# ---- time axis -------------------------------------------------------------------------------------------------

def test_bandpass_keeps_the_band_and_removes_the_rest():
    t = np.arange(3000) / 250
    kept, low, high = (np.cos(2 * np.pi * f * t + 0.3) for f in (21.0, 1.5, 95.0))
    y = K.bandpass(np.stack([kept + low + high, low, high]), 12, 36, 250)
    middle = slice(400, -400)
    assert np.allclose(y[0][middle], kept[middle], atol=0.02)
    assert np.abs(y[1:, middle]).max() < 0.02


def test_envelope_of_a_tone_is_its_amplitude():
    t = np.arange(1024) / 128
    assert np.allclose(K.envelope(3 * np.sin(2 * np.pi * 10 * t)[None], 8, 13, 128)[0][100:-100], 3, atol=0.05)


@pytest.mark.parametrize("n_out", [40, 64, 100, 128])
def test_fourier_resampling_of_a_band_limited_tone(n_out):
    x = np.cos(2 * np.pi * 3 * np.arange(64) / 64)
    assert np.allclose(K.resample_fft(x[None], n_out)[0], np.cos(2 * np.pi * 3 * np.arange(n_out) / n_out))


def test_welch_total_power_of_white_noise():
    x = np.random.default_rng(0).standard_normal((200, 512))
    f, p = K.welch_psd(x, 100.0, 64)
    assert abs(p.mean() * 50 - 1) < 0.05 and len(f) == 33


def test_bandpass_stream_equals_the_whole_recording(spark):
    x = np.random.default_rng(1).standard_normal(3000)
    s = spark.createDataFrame(pd.DataFrame({"rec": "a", "t": np.arange(3000), "v": x}))
    y = E.bandpass_stream(s, "v", 8, 30, 128, chunk=500, halo=250).orderBy("t").toPandas()
    assert y["t"].tolist() == list(range(3000))
    assert np.abs(y["y"].to_numpy() - K.bandpass(x, 8, 30, 128))[300:-300].max() < 1e-3


def test_ewm_equals_pandas_across_chunks(spark):
    rng = np.random.default_rng(2)
    x = {r: rng.standard_normal(n) + 2 for r, n in (("a", 1000), ("b", 333))}
    s = spark.createDataFrame(pd.concat([pd.DataFrame({"rec": r, "t": np.arange(len(v)), "v": v}) for r, v in x.items()]))
    got = N.ewm_standardize(s, "v", 0.02, 50, chunk=64).orderBy("rec", "t").toPandas()
    for r, v in x.items():
        d = v - pd.Series(v).ewm(alpha=0.02).mean().to_numpy()
        z = d / np.maximum(1e-4, np.sqrt(pd.Series(d * d).ewm(alpha=0.02).mean().to_numpy()))
        z[:50] = (v[:50] - v[:50].mean()) / v[:50].std()
        assert np.allclose(got[got["rec"] == r]["z"], z)


# ---- covariance ------------------------------------------------------------------------------------------------

def test_riemannian_mean_by_group(spark):
    rng = np.random.default_rng(3)
    c, g = spd(rng, 40, 4), np.arange(40) % 3
    m = A.riemannian_mean(cov_frame(spark, c, g=g), ["g"], 4).toPandas().set_index("g")
    for k in range(3):
        assert np.allclose(np.asarray(m.loc[k, "mean"]).reshape(4, 4), mean_by_loop(c[g == k]), atol=1e-7)


def test_mean_of_two_matrices_is_the_geodesic_middle(spark):
    c = spd(np.random.default_rng(4), 2, 3)
    m = A.riemannian_mean(cov_frame(spark, c, g=[0, 0]), ["g"], 3).head()
    assert np.allclose(np.asarray(m["mean"]).reshape(3, 3), A.geodesic(c[0], c[1], 0.5), atol=1e-8)


def test_recentering_brings_displaced_subjects_to_the_identity(spark):
    rng = np.random.default_rng(5)
    base = spd(rng, 25, 4)
    shift = [np.eye(4) + 0.4 * rng.standard_normal((4, 4)) for _ in range(3)]
    c = np.concatenate([s @ base @ s.T for s in shift])
    g = np.repeat([0, 1, 2], 25)
    out = covs(A.recenter_covariances(cov_frame(spark, c, g=g), ["g"], 4), 4)
    for k in range(3):
        assert np.allclose(mean_by_loop(out[g == k]), np.eye(4), atol=1e-6)


def test_dispersion_is_one_after_scaling(spark):
    c = spd(np.random.default_rng(6), 30, 4)
    out = covs(A.scale_dispersion(cov_frame(spark, c, g=0), ["g"], 4), 4)
    d2 = (np.log(np.linalg.eigvalsh(out)) ** 2).sum(axis=1).mean()
    assert abs(d2 - 1) < 1e-9


def test_noise_whitener_whitens_planted_noise(spark):
    rng = np.random.default_rng(7)
    mix = np.array([[2.0, 0, 0], [1.0, 1.0, 0], [0.5, 0.2, 0.3]])
    signal = rng.standard_normal((40, 3, 16)) * 5
    x = np.concatenate([signal + np.einsum("ij,njt->nit", mix, rng.standard_normal((40, 3, 16))) for _ in range(8)])
    cond = np.tile(np.arange(40), 8)
    pdf = pd.DataFrame({"s": "a", "cond": cond, "x": [e.tolist() for e in x]})
    df = spark.createDataFrame(pdf).repartition(4)
    w = A.noise_whitener(df, ["s"], "cond", 3)
    white = A.whiten_signals(df, w, ["s"]).toPandas()
    y = np.stack([np.stack([np.asarray(c) for c in e]) for e in white["x"]])
    res = y - np.stack([y[white["cond"] == k].mean(axis=0) for k in range(40)])[white["cond"]]
    cov = np.einsum("nct,ndt->cd", res, res) / (len(res) * 16)
    assert np.allclose(cov, np.eye(3), atol=0.05)


def test_whitener_of_a_subject_without_noise(spark):
    rows = [("a", k, [[float(k), 1.0], [2.0, 3.0]]) for k in range(3)] + [("b", 0, [[1.0, 4.0], [2.0, 0.0]]), ("b", 0, [[2.0, 1.0], [0.0, 5.0]])]
    df = spark.createDataFrame(rows, "s string, cond int, x array<array<double>>")
    said = {r["s"]: r["isqrt"] for r in A.noise_whitener(df, ["s"], "cond", 2, no_noise=float("inf")).collect()}
    assert said["a"] == [float("inf"), 0.0, 0.0, float("inf")] and np.isfinite(said["b"]).all()
    assert {r["s"]: r["isqrt"] for r in A.noise_whitener(df, ["s"], "cond", 2).collect()}["a"] == [1e6, 0.0, 0.0, 1e6]


def test_whitener_query_equals_its_sql_for_users_of_one_block(spark, tmp_path):
    from oracle_check import compare, duck

    from trialframe.plans.catalog import ORACLES, QUERIES
    con = duck(SF)
    con.execute(f"COPY (SELECT event_id, ts, event_id % 45 AS user_id, event_type, value, props FROM events) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got, want = QUERIES["noise_whitener"](spark, str(tmp_path)).toPandas(), duck(str(tmp_path)).execute(ORACLES["noise_whitener"]).fetchdf()
    assert np.isinf(want["w0"]).any() and np.isfinite(want["w0"]).any() and compare(got, want) is None


def test_unfitted_subject_raises(spark):
    df = spark.createDataFrame([("a", [[1.0]]), ("b", [[2.0]])], "s string, x array<array<double>>")
    w = spark.createDataFrame([("a", [1.0])], "s string, isqrt array<double>")
    with pytest.raises(Exception, match="no whitener"):
        A.whiten_signals(df, w, ["s"]).collect()


def test_rotation_recovers_a_planted_one(spark):
    rng = np.random.default_rng(8)
    y = np.arange(60) % 3
    dirs = [np.diag([1.5, 0.2, -0.5]), np.diag([-1.0, 1.2, 0.1]), np.diag([0.3, -0.9, 1.4])]
    c = K.expm(np.stack([dirs[k] for k in y]) + 0.01 * np.stack([(lambda a: a + a.T)(rng.standard_normal((3, 3))) for _ in y]))
    q, _ = np.linalg.qr(rng.standard_normal((3, 3)))
    r = A.rotation(cov_frame(spark, c, y=y), cov_frame(spark, q @ c @ q.T, y=y), "y", 3)
    back = r @ (q @ c @ q.T) @ r.T
    assert np.abs(K.logm(back) - K.logm(c)).max() < np.abs(K.logm(q @ c @ q.T) - K.logm(c)).max() / 5


def test_mdm_recovers_separated_classes(spark):
    rng = np.random.default_rng(9)
    y = np.arange(90) % 3
    centres = np.stack([np.diag(v) for v in ([4.0, 1, 1], [1, 4.0, 1], [1, 1, 4.0])])
    c = np.stack([K.powm(centres[k], 0.5) @ m @ K.powm(centres[k], 0.5) for k, m in zip(y, spd(rng, 90, 3))])
    df = cov_frame(spark, c, y=y)
    for p in (C.mdm(df, df, 3, 3, ["id", "y"]), C.fgmdm(df, df, 3, 3, ["id", "y"]), C.riemann(df, df, 3, 3, ["id", "y"])):
        assert M.predict_label(p).filter("yhat = y").count() > 75


# ---- discriminant ----------------------------------------------------------------------------------------------

def lw_direct(x):
    x = x - x.mean(axis=0)
    n, p = x.shape
    s = x.T @ x / n
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum() / p
    beta = sum(((np.outer(r, r) - s) ** 2).sum() for r in x) / (n * n * p)
    w = min(beta, delta) / delta
    return (1 - w) * s + w * mu * np.eye(p)


def lda_direct(x, y, xt, shrinkage, weights=1.0):
    m, sd = x.mean(axis=0), x.std(axis=0)
    x, xt = (x - m) / sd * weights, (xt - m) / sd * weights
    cov, means, prior = 0, [], []
    for k in np.unique(y):
        a = x[y == k]
        if shrinkage == "auto":
            s = a.std(axis=0)
            c = lw_direct((a - a.mean(axis=0)) / s) * np.outer(s, s)
        else:
            c = np.cov(a.T, bias=True)
            c = (1 - shrinkage) * c + shrinkage * np.trace(c) / len(c) * np.eye(len(c))
        cov = cov + len(a) / len(y) * c
        means.append(a.mean(axis=0))
        prior.append(len(a) / len(y))
    means = np.stack(means)
    coef = np.linalg.solve(cov, means.T).T
    s = xt @ coef.T - 0.5 * (means * coef).sum(axis=1) + np.log(prior)
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def lda_data(seed=10, n=150, d=5):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    x = rng.standard_normal((n, d)) @ rng.standard_normal((d, d)) + 100 + y[:, None] * np.array([1, 0, 0.5, 0, 0])
    return x, y, np.arange(n) % 4


@pytest.mark.parametrize("shrinkage", ["auto", 0.4])
def test_lda_from_statistics_equals_direct_fit_per_fold(spark, shrinkage):
    x, y, fold = lda_data()
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(y)), "y": y, "fold": fold, "f": x.tolist()})).repartition(5)
    got = C.shrinkage_lda(df, "fold", 3, shrinkage).orderBy("id").toPandas()
    for k in range(4):
        want = lda_direct(x[fold != k], y[fold != k], x[fold == k], shrinkage)
        assert np.allclose(np.stack(got[got["fold"] == k]["probs"]), want, atol=1e-6)


def test_weight_sweep_equals_direct_fits(spark):
    x, y, fold = lda_data(11)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "fold": fold, "f": x.tolist()})).repartition(3)
    fams = ["a", "b", "a", "c", "b"]
    grid = [{}, {"a": 2.0, "b": 0.3}, {"c": 0.0, "a": 1.5}]
    got = C.weight_sweep(df, "fold", fams, grid, 3).orderBy("trial").toPandas()["acc"].tolist()
    for g, t in zip(got, grid):
        w = np.array([t.get(f, 1.0) for f in fams])
        acc = [np.mean(lda_direct(x[fold != k], y[fold != k], x[fold == k], 0.4, w).argmax(axis=1) == y[fold == k]) for k in range(4)]
        assert abs(g - np.mean(acc)) < 1e-9


def test_csp_separates_two_variance_patterns(spark):
    rng = np.random.default_rng(12)
    y = np.arange(80) % 2
    mix = rng.standard_normal((4, 4))
    power = np.where(y[:, None] == 0, [5, 1, 1, 1], [1, 5, 1, 1])
    x = np.einsum("ij,njt->nit", mix, rng.standard_normal((80, 4, 100)) * np.sqrt(power)[:, :, None])
    df = cov_frame(spark, K.uncentred_cov(x), y=y)
    f = C.csp_features(df, C.csp_filters(df, 4, 2), 4).orderBy("id").toPandas()
    diff = np.stack(f["f"])
    diff = diff[:, 0] - diff[:, 1]
    assert abs(np.corrcoef(diff, y)[0, 1]) > 0.95


# ---- coupling --------------------------------------------------------------------------------------------------

def test_planted_lag_and_gain_are_recovered(spark):
    rng = np.random.default_rng(13)
    fs = 2.0
    rows = []
    for i in range(24):
        d = np.convolve(rng.standard_normal(200), np.ones(6) / 6, "same")
        r = -3.0 * np.convolve(d, K.response_kernels([6.0], [3.0], fs, 30.0)[0])[:200]
        rows.append((i % 3, d.tolist(), r.tolist()))
    df = spark.createDataFrame(rows, "s int, drive array<double>, resp array<double>").repartition(4)
    pooled = CO.estimate_coupling(df, [], fs).head()
    assert (pooled["lag"], pooled["decay"]) == (6.0, 1.5) and abs(pooled["beta"] + 3) < 1e-6
    per = CO.estimate_coupling(df, ["s"], fs).collect()
    assert [r["lag"] for r in per] == [6.0] * 3
    assert CO.pooled_vs_subject_lag(df, "s", fs).head()["verdict"] == "STABLE"


# ---- retrieval -------------------------------------------------------------------------------------------------

def bank_frame(spark, b):
    return spark.createDataFrame(pd.DataFrame({"concept": np.arange(len(b)), "v": b.tolist()}))


def test_blocks_of_the_bank_give_the_same_state_as_one_block(spark):
    rng = np.random.default_rng(14)
    bank, x, y = rng.standard_normal((23, 6)), rng.standard_normal((50, 6)), rng.integers(0, 23, 50)
    trials = spark.createDataFrame(pd.DataFrame({"trial": np.arange(50), "concept": y, "v": x.tolist()})).repartition(4)
    s = x @ bank.T
    rank = (s > s[np.arange(50), y][:, None]).sum(axis=1) + 1
    for block in (4096, 5):
        got = R.retrieval_state(trials, bank_frame(spark, bank), ["trial"], 2.0, block=block).orderBy("trial").toPandas()
        assert got["rank"].tolist() == rank.tolist()
        assert got["pred"].tolist() == s.argmax(axis=1).tolist()
        assert np.allclose(1 / got["z"], np.exp(2 * (s - s.max(axis=1, keepdims=True))).sum(axis=1) ** -1)
        assert np.allclose(got["total"], s.sum(axis=1))


def test_nearest_concepts_in_blocks(spark):
    bank = np.random.default_rng(15).standard_normal((17, 4))
    u = bank / np.linalg.norm(bank, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -np.inf)
    for block in (4096, 4):
        got = R.nearest_concepts(bank_frame(spark, bank), 3, block=block).orderBy("concept", "place").toPandas()
        assert got["neighbour"].to_numpy().reshape(17, 3).tolist() == np.argsort(-s, axis=1)[:, :3].tolist()


def test_pair_statistics_equal_the_pairs(spark):
    bank = np.random.default_rng(16).standard_normal((12, 5))
    u = bank / np.linalg.norm(bank, axis=1, keepdims=True)
    off = (u @ u.T)[~np.eye(12, dtype=bool)]
    got = R.bank_pair_stats(bank_frame(spark, bank)).head()
    assert abs(got["random_mean"] - off.mean()) < 1e-12 and abs(got["random_std"] - off.std(ddof=1)) < 1e-12


@pytest.mark.parametrize(("block", "true"), [(4096, 65_536), (3, 4)])
def test_pr_auc_with_ties_equals_all_pairs(spark, monkeypatch, block, true):
    rng = np.random.default_rng(20)
    x, m = rng.integers(-2, 3, (60, 3)).astype(float), rng.integers(-2, 3, (9, 3)).astype(float)
    y = rng.integers(0, 10, 60)  # the bank lacks concept 9
    s = x @ m.T
    hit = y[:, None] == np.arange(9)[None, :]
    want = sum(np.sum(hit & (s == v)) * np.sum(hit & (s >= v)) / np.sum(s >= v) for v in np.unique(s[hit])) / hit.sum()
    monkeypatch.setattr(R, "BLOCK", block)
    monkeypatch.setattr(R, "TRUE_SCORES", true)
    trials = spark.createDataFrame(pd.DataFrame({"concept": y, "v": x.tolist()})).repartition(3)
    bank = spark.createDataFrame(pd.DataFrame({"concept": np.arange(9), "v": m.tolist()}))
    assert abs(R.pr_auc(trials, bank).head()[0] - want) < 1e-12
    assert R.pr_auc(trials.filter("concept = 9"), bank).head()[0] is None
    assert R.pr_auc(trials.filter("false"), bank).head()[0] is None


def test_known_ranks(spark):
    bank = np.eye(5)
    trials = spark.createDataFrame([(0, 0, [0.9, 0.1, 0.2, 0.3, 0.0]), (1, 1, [0.9, 0.5, 0.8, 0.1, 0.0])],
                                   "trial int, concept int, v array<double>")
    m = R.retrieval_metrics(R.retrieval_state(trials, bank_frame(spark, bank), ["trial"]), []).head()
    assert (m["recall1"], m["recall5"], m["median_rank"]) == (0.5, 1.0, 2.0) and abs(m["mrr"] - (1 + 1 / 3) / 2) < 1e-12


# ---- shapes ----------------------------------------------------------------------------------------------------

def test_kernels_keep_ragged_epochs_apart(spark):
    rows = [(i, rng.tolist()) for i, rng in enumerate([np.ones((2, 4)), np.ones((2, 7)), np.ones((3, 4)), 2 * np.ones((2, 4))])]
    df = spark.createDataFrame(rows, "id int, x array<array<double>>")
    out = {r["id"]: r["cov"] for r in SP.trial_covariance(df, ["id"]).collect()}
    assert [len(out[i]) for i in range(4)] == [4, 4, 9, 4] and out[3] == [4.0] * 4


def test_temperature_of_sharp_wrong_logits_is_above_one(spark):
    rng = np.random.default_rng(17)
    y = rng.integers(0, 4, 200)
    shown = np.where(rng.random(200) < 0.4, (y + 1) % 4, y)
    z = 9.0 * np.eye(4)[shown]
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "y": y, "z": z.tolist()}))
    t = M.temperature_fit(df, ["g"], "z").head()
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 20001))
    nll = [np.mean(np.log(np.exp(z / g).sum(axis=1)) - z[np.arange(200), y] / g) for g in grid[::50]]
    assert t["temperature"] > 1 and t["nll"] <= min(nll) + 1e-6


def test_arrow_batches_and_partitions_do_not_change_results(spark):
    rng = np.random.default_rng(18)
    c = spd(rng, 30, 3)
    one, many = cov_frame(spark, c, g=0).repartition(1), cov_frame(spark, c, g=0).repartition(8)
    a, b = (np.asarray(A.riemannian_mean(d, ["g"], 3).head()["mean"]) for d in (one, many))
    assert np.allclose(a, b, atol=1e-10)
