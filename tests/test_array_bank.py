"""Descriptors of arrays equal the aggregation of their samples, without a shuffle."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialframe.operators import descriptors as D
from trialframe.operators import methods


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def epochs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for e in range(40):
        n = int(rng.integers(1, 30))
        x = rng.standard_normal((3, n)).round(2)
        x[2] = 0.1                                       # constant
        x = [[None if e % 7 == 3 and rng.random() < 0.3 else float(v) for v in ch] for ch in x]
        rows.append((f"s{e % 4}", e, x))
    rows += [("s0", 100, None), ("s0", 101, [])]
    return spark.createDataFrame(rows, "subject string, blk int, x array<array<double>>").cache()


def by_samples(epochs, keys):
    e = epochs.select(*keys, F.posexplode("x").alias("ch", "_s"))
    return e.select(*keys, "ch", F.posexplode("_s").alias("i", "x"))


def test_array_bank_equals_the_aggregation(epochs):
    keys = ["subject", "blk"]
    got = D.bank_cells(D.array_bank(epochs, keys), keys, D.FAMILIES).orderBy("blk", "ch").toPandas()
    want = D.extract_bank(by_samples(epochs, keys), [*keys, "ch"]).orderBy("blk", "ch").toPandas()
    assert len(got) == len(want) == 120
    for f in D.FAMILIES:
        a, b = got[f].to_numpy(float), want[f].to_numpy(float)
        if f in ("skew", "kurtosis"):                    # of a constant: rounding of its mean decides in the aggregation
            a, b = a[got["ch"] != 2], b[got["ch"] != 2]
        assert np.allclose(a, b, atol=1e-9, equal_nan=True), f
    assert (got.loc[got["ch"] == 2, ["skew", "kurtosis"]] == 0).all(axis=None)


@pytest.mark.parametrize("length, hop", [(1, 1), (4, 2), (5, 7), (50, 3)])
def test_windows_equal_banks_of_slices(spark, epochs, length, hop):
    fams = ["mean", "slope", "peak", "late_slope", "final"]
    got = D.bank_cells(D.window_bank(epochs, ["blk"], length, hop, fams), ["blk", "win"], fams).orderBy("blk", "win", "ch").toPandas()
    cut = []
    for r in epochs.collect():
        for w in range(1 + max(0, len(r.x[0]) - length) // hop if r.x else 0):
            cut.append((r.blk, w, [c[w * hop:w * hop + length] for c in r.x]))
    cut = spark.createDataFrame(cut, "blk int, win int, x array<array<double>>")
    want = D.bank_cells(D.array_bank(cut, ["blk", "win"], fams), ["blk", "win"], fams).orderBy("blk", "win", "ch").toPandas()
    assert len(got) and np.array_equal(got[["blk", "win", "ch"]], want[["blk", "win", "ch"]])
    assert np.allclose(got[fams].to_numpy(float), want[fams].to_numpy(float), equal_nan=True)


def test_banks_do_not_shuffle(epochs):
    for df in (D.array_bank(epochs, ["blk"]), D.window_bank(epochs, ["blk"], 4, 2, ["mean"])):
        assert "Exchange" not in plan(df)


def test_channels_of_unequal_length(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0, 3.0, 4.0], [5.0, 7.0], None])], "k int, x array<array<double>>")
    got = [r["bank"] for r in D.window_bank(df, ["k"], 2, 2, ["mean", "slope"]).orderBy("win").collect()]
    assert got == [[[1.5, 1.0], [6.0, 2.0], [None, None]], [[3.5, 1.0], [None, None], [None, None]]]


def test_wrong_arguments(epochs):
    for call in (lambda: D.array_bank(epochs, ["blk"], ["nope"]), lambda: D.window_bank(epochs, ["blk"], 0, 1, ["mean"]), lambda: D.window_bank(epochs, ["blk"], 1, 0, ["mean"])):
        with pytest.raises(ValueError):
            call()
    assert D.array_bank(epochs.limit(0), ["blk"]).count() == 0


def test_windows_carry_their_position_unless_concatenated(spark):
    """A bump whose place tells the class: concatenated windows see it, and other windows carry their centre's place."""
    rng = np.random.default_rng(5)
    rows = []
    for s in range(4):
        for e in range(20):
            y = e % 2
            x = rng.standard_normal((1, 40)) * 0.05
            x[0, 30 * y:30 * y + 10] += 1.0
            rows.append((str(s), e, y, s % 2, x.tolist()))
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["subject", "blk", "y", "fold", "x"]), "subject string, blk int, y int, fold int, x array<array<double>>")
    task = lambda **k: methods.Task(n_ch=1, n_samples=40, fs=10.0, n_classes=2, win_s=1.0, hop_s=1.0, **k)
    p = methods.fnirs_windowed(df, task(pool="concat")).toPandas()
    assert len(p) == 80 and [int(np.argmax(q)) for q in p["probs"]] == list(p["y"])
    f = methods.window_features(df, task()).orderBy("subject", "blk", "win").toPandas()
    assert np.allclose([v[-1] for v in f["f"]], np.tile([0.125, 0.375, 0.625, 0.875], 80))
    plain = methods.window_features(df, task(add_position=False)).orderBy("subject", "blk", "win").toPandas()
    assert [list(v[:-1]) for v in f["f"]] == [list(v) for v in plain["f"]]
    assert len(methods.fnirs_windowed(df, task()).toPandas()) == 80
