"""Spatial filters of all folds and bands in shared passes equal a fit per fold on band-passed epochs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialframe.functions import kernels
from trialframe.functions.columns import softmax
from trialframe.operators import classify as C
from trialframe.operators import foldcsp, methods
from trialframe.operators.epoching import bandpass_epochs
from trialframe.operators.spatial import trial_covariance

BANDS = [(0.5, 1.5), (1.5, 2.5), (2.5, 3.9)]


@pytest.mark.parametrize("t", [7, 16, 33])
def test_cross_spectra_give_the_covariances_of_filtered_epochs(t):
    x = np.random.default_rng(t).standard_normal((5, 3, t))
    gains = np.stack([kernels.butter_band_gain(t, lo, hi, 8.0, 4) for lo, hi in BANDS])
    got = foldcsp.cross_spectral_cov(x, gains)
    for b, (lo, hi) in enumerate(BANDS):
        assert np.allclose(got[:, b], kernels.uncentred_cov(kernels.bandpass(x, lo, hi, 8.0, 4)), atol=1e-12)


@pytest.fixture(scope="module")
def epochs(spark):
    rng = np.random.default_rng(4)
    rows = []
    for e in range(90):
        y, n = e % 3, 16 if e % 10 else 13
        x = rng.standard_normal((4, n)) * np.where(np.arange(4) == y, 2.5, 1.0)[:, None]
        rows.append((e, y, f"f{e % 7 % 3}", x.tolist()))
    rows = [r for r in rows if not (r[1] == 2 and r[2] != "f0")]     # one class lies in one fold alone
    return spark.createDataFrame(pd.DataFrame(rows, columns=["e", "y", "fold", "x"]), "e int, y int, fold string, x array<array<double>>").cache()


def per_fold(df, features):
    """The fit of every fold on its own training rows."""
    out = []
    for f in ("f0", "f1", "f2"):
        both = features(df, F.col("fold") != f).withColumn("g", (F.col("fold") != f).cast("int"))
        models = C.lda_models(both, "g", 3, "auto", F.col("g") == 1)
        p = C.linear_scores(both.filter("g = 0"), models, "g").select("e", softmax("scores").alias("probs"))
        out += [(r["e"], r["probs"]) for r in p.collect()]
    return dict(out)


def close(got, want):
    got = {r["e"]: r["probs"] for r in got.collect()}
    assert set(got) == set(want)
    assert max(np.abs(np.subtract(got[e], want[e])).max() for e in want) < 1e-6


def task(**k):
    return methods.Task(n_ch=4, n_samples=16, fs=8.0, n_classes=3, bands=(), csp_filters=3, fb_bands=tuple(BANDS), fb_features=4, keep=["e"], **k)


def test_csp_of_all_folds(epochs):
    def features(df, train):
        cov = trial_covariance(df, ["e", "y", "fold"], task().estimator)
        return C.csp_features(cov, C.csp_filters(cov.filter(train), 4, 3), 4)

    close(methods.csp_lda(epochs, task()), per_fold(epochs, features))


def bank_features(df, train):
    keep, parts = ["e", "y", "fold"], []
    for lo, hi in BANDS:
        cov = trial_covariance(bandpass_epochs(df.select(*keep, "x"), lo, hi, 8.0, task().fb_order), keep)
        parts.append(C.csp_features(cov, C.csp_filters(cov.filter(train), 4, 3), 4).withColumnRenamed("f", f"f{len(parts)}"))
    both = parts[0].join(parts[1], keep).join(parts[2], keep).select(*keep, F.concat("f0", "f1", "f2").alias("f"))
    rank = C.mutual_information_rank(both.filter(train).select("y", F.posexplode("f").alias("feature", "f")))
    chosen = [r["feature"] for r in rank.filter("place < 4").orderBy("place").collect()]
    return both.withColumn("f", F.array(*[F.col("f")[i] for i in chosen]))


def test_filter_bank_of_all_folds(epochs):
    close(methods.fbcsp(epochs, task()), per_fold(epochs, bank_features))


def test_filter_bank_features_in_one_pass(epochs):
    train = F.col("fold") != "f1"
    got = C.filter_bank_csp(epochs, train, 4, 8.0, BANDS, 3, 4, ["e", "y", "fold"], task().fb_order).orderBy("e").toPandas()
    want = bank_features(epochs, train).orderBy("e").toPandas()
    assert (got["e"] == want["e"]).all() and np.allclose(np.stack(got["f"]), np.stack(want["f"]), atol=1e-9)


def test_no_epochs(epochs):
    assert methods.csp_lda(epochs.filter("e < 0"), task()).count() == 0
