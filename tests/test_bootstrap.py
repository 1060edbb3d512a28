"""Bootstrap by cells against the distribution it draws from and against resampled trials."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialframe.operators import bootstrap as B
from trialframe.operators import metrics as M


@pytest.mark.parametrize("n", [1, 5, 40, 63, 64, 100, 5000])
def test_weights_follow_a_poisson_distribution(spark, n):
    cell = spark.createDataFrame([(i, n) for i in range(20)], "k int, n bigint")
    w = np.array([r["w"] for r in B.draws(cell, ["k"], 1000).select("w").collect()])
    assert len(w) == 20_000 and w.min() >= 0
    assert abs(w.mean() - n) < 5 * math.sqrt(n / len(w)) and abs(w.var() / n - 1) < 0.06
    assert abs(((w - n) ** 3).mean() / n**1.5 - 1 / math.sqrt(n)) < 0.12  # skewness
    if n < 64:
        term, below = math.exp(-n), 0.0
        for k in range(2 * n + 3):
            below += term
            assert abs((w <= k).mean() - below) < 0.02
            term *= n / (k + 1)


def trials(seed=3, n=600):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    yhat = np.where(rng.random(n) < 0.7, y, rng.integers(0, 3, n))
    conf = rng.uniform(0.34, 1.0, n)
    return pd.DataFrame({"trial": np.arange(n), "y": y, "yhat": yhat, "conf": conf, "rank": rng.integers(1, 12, n)})


def numpy_metric(name, y, yhat, conf, rank, w):
    total = w.sum()
    acc = (w * (y == yhat)).sum() / total
    if name == "acc":
        return acc
    if name == "kappa":
        pe = sum((w * (y == k)).sum() * (w * (yhat == k)).sum() for k in range(3)) / total**2
        return (acc - pe) / (1 - pe)
    if name == "ece":
        b = np.ceil(conf * 15) - 1
        return sum(abs((w * (b == k) * ((y == yhat) - conf)).sum()) for k in range(15)) / total
    return (w * (rank <= 5)).sum() / total


CASES = {"acc": (B.accuracy, ["y", "yhat"], []), "kappa": (B.kappa(3), ["y", "yhat"], []),
         "ece": (B.calibration_error(), ["y", "yhat", "bin"], ["conf"]), "recall": (B.recall_at(5), ["rank"], [])}


@pytest.mark.parametrize("name", list(CASES))
def test_intervals_agree_with_resampled_trials(spark, name):
    t = trials()
    metric, discrete, means = CASES[name]
    df = spark.createDataFrame(t).withColumn("bin", M.conf_bin("conf", 15))
    got = B.bootstrap(df, metric, discrete, means).head()
    rng = np.random.default_rng(4)
    cols = [t[c].to_numpy() for c in ("y", "yhat", "conf", "rank")]
    assert abs(got["point"] - numpy_metric(name, *cols, np.ones(len(t)))) < 1e-9
    want = np.quantile([numpy_metric(name, *cols, rng.poisson(1, len(t))) for _ in range(4000)], [0.025, 0.975])
    wide = want[1] - want[0]
    assert abs(got["lo"] - want[0]) < 0.15 * wide and abs(got["hi"] - want[1]) < 0.15 * wide


def test_paired_arms_share_their_weights(spark):
    t = trials()
    worse = t.assign(yhat=np.where(t["trial"] % 10 == 0, (t["y"] + 1) % 3, t["yhat"]))
    a, b = spark.createDataFrame(worse), spark.createDataFrame(t)
    got = B.paired_bootstrap(a, b, "trial", B.kappa(3), ["y", "yhat"]).head()
    same = B.paired_bootstrap(b, b, "trial", B.kappa(3), ["y", "yhat"]).head()
    assert got["verdict"] == "REAL" and 0 < got["lo"] < got["point"] < got["hi"]
    assert (same["point"], same["lo"], same["hi"], same["verdict"]) == (0.0, 0.0, 0.0, "noise")
    assert B.paired_bootstrap(b, a, "trial", B.accuracy, ["y", "yhat"]).head()["verdict"] == "REVERSED"
    with pytest.raises(Exception, match="different trials"):
        B.paired_bootstrap(a, b.filter("trial < 599"), "trial", B.accuracy, ["y", "yhat"]).collect()


def test_mean_of_a_rate_and_degenerate_groups(spark):
    hits = spark.range(1000).select(F.col("id").alias("trial"), (F.col("id") < 200).cast("int").alias("hit"))
    r = B.bootstrap_ci(hits, "hit").head()
    assert r["point"] == 0.2 and 0.165 < r["lo"] < 0.185 and 0.215 < r["hi"] < 0.235
    same = B.bootstrap_ci(hits.withColumn("hit", F.lit(1)), "hit").head()
    assert (same["lo"], same["hi"]) == (1.0, 1.0)
    better = hits.withColumn("hit", (F.col("trial") < 400).cast("int"))
    assert B.paired_bootstrap_delta(hits, better, "trial", "hit").head()["verdict"] == "REAL"
    one = spark.createDataFrame([("g", 1, 1), ("h", 0, 1), ("h", 1, 1)], "fold string, y int, yhat int")
    out = {r["fold"]: r for r in B.bootstrap(one, B.kappa(2), ["y", "yhat"], by=["fold"]).collect()}
    assert out["g"]["point"] is None and out["g"]["lo"] is None and out["h"]["point"] == 0.0
    assert B.bootstrap(one.filter("false"), B.accuracy, ["y", "yhat"], by=["fold"]).count() == 0


def test_draws_cost_cells_not_trials(spark):
    """A million trials in four cells: the exploded rows are draws times cells."""
    big = spark.range(1_000_000).select((F.col("id") % 2).alias("y"), (F.col("id") % 4 > 1).cast("int").alias("yhat"))
    assert B.draws(B.cells(big, ["y", "yhat"]), ["y", "yhat"], 1000).count() == 4000
    r = B.bootstrap(big, B.accuracy, ["y", "yhat"]).head()
    assert abs((r["hi"] - r["lo"]) / (2 * 1.96 * 0.0005) - 1) < 0.1
