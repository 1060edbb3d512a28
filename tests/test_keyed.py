"""Retrieval against key-dependent centroids, against a loop over trials."""

import numpy as np
import pandas as pd
import pytest

from trialframe.operators import retrieval as R

D = 4


def unit(x, eps=0.0):
    return x / (np.linalg.norm(x) + eps)


def by_loop(trials, train, arm):
    """trial → (s_true, rank, pred, best, total, n_cand); absent candidates score −2."""
    concepts = sorted(set(train["concept"]))
    vec = {(k, c): (np.stack(g["v"]).sum(axis=0), len(g)) for (k, c), g in train.groupby(["subject", "concept"])}
    out = {}
    for t in trials.itertuples():
        s = []
        for c in concepts:
            total, n = np.zeros(D), 0
            for k in set(train["subject"]):
                if ((k == t.subject) == (arm == "within")) and (k, c) in vec:
                    total, n = total + vec[k, c][0], n + vec[k, c][1]
            s.append(unit(t.v) @ unit(total / n, 1e-8) if n else -2.0)
        s = np.array(s)
        own = concepts.index(t.concept) if t.concept in concepts else None
        rank = None if own is None else 1 + sum(v > s[own] + 1e-12 for i, v in enumerate(s) if i != own)
        out[t.trial] = (None if own is None else s[own], rank, concepts[int(s.argmax())], s.max(), s.sum(), len(s), np.exp(s - s.max()).sum())
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(6)
    n = 160
    subject = np.where(rng.random(n) < 0.4, "hot", [f"s{i}" for i in rng.integers(0, 7, n)])
    concept = rng.integers(0, 11, n) * 3
    v = rng.standard_normal((n, D))
    df = pd.DataFrame({"trial": np.arange(n), "subject": subject, "concept": concept, "v": v.tolist()})
    df.loc[0, "concept"] = 1000  # a concept that only one subject has
    train = df[df["trial"] % 3 > 0]
    train = train[train["concept"] != 6]  # and one without any training row
    train.loc[train.index[5], "concept"] = 500
    twin = train[train["concept"] == 3].assign(concept=4)  # equal centroids tie
    return df, pd.concat([train, twin.assign(trial=twin["trial"] + 1000)])


@pytest.mark.parametrize(("block", "pack", "piece"), [(4096, 4096, 512), (3, 7, 2), (1, 1, 1)])
def test_states_equal_a_loop(spark, monkeypatch, data, block, pack, piece):
    for name, value in (("BLOCK", block), ("PACK", pack), ("SLICE", piece)):
        monkeypatch.setattr(R, name, value)
    df, train = data
    got = R.keyed_states(spark.createDataFrame(df), spark.createDataFrame(train), "subject", ("within", "cross"), ["trial"]).toPandas()
    assert len(got) == 2 * len(df)
    for arm, part in got.groupby("arm"):
        want = by_loop(df, train, arm)
        for r in part.itertuples():
            s, rank, pred, best, total, n, z = want[r.trial]
            assert (rank is None and pd.isna(r.rank)) or r.rank == rank, (arm, r)
            assert (s is None and pd.isna(r.s_true)) or abs(r.s_true - s) < 1e-9
            assert r.n_cand == n and abs(r.best - best) < 1e-9 and abs(r.total - total) < 1e-8 and abs(r.z - z) < 1e-8
            if pred != 3 and r.pred != 4:
                assert r.pred == pred


def test_many_concepts_and_keys_stay_in_small_rows(spark, monkeypatch):
    """3,000 concepts and 40 keys: nothing but counts reaches the driver, every bank row holds one vector."""
    from pyspark.sql import DataFrame
    rng = np.random.default_rng(7)
    n, concepts = 6000, 3000
    base = rng.standard_normal((concepts, D))
    concept = np.arange(n) % concepts
    df = spark.createDataFrame(pd.DataFrame({"trial": np.arange(n), "subject": rng.integers(0, 40, n), "concept": concept,
                                             "v": (base[concept] + 0.01 * rng.standard_normal((n, D))).tolist()})).repartition(6)
    monkeypatch.setattr(R, "BLOCK", 500)
    collected = []
    for name in ("collect", "toPandas"):
        real = getattr(DataFrame, name)
        monkeypatch.setattr(DataFrame, name, lambda self, real=real: collected.append(self.columns) or real(self))
    state = R.keyed_state(df, df, "subject")
    assert all(not {"v", "s"} & set(c) for c in collected)
    assert state.filter("rank is not null").count() == n
    near = state.filter("s_true > -2")
    assert near.filter("rank <= 5").count() > 0.9 * near.count() > 0


def test_empty_trials_or_training_rows(spark, data):
    df, train = (spark.createDataFrame(x) for x in data)
    assert R.keyed_state(df.filter("false"), train, "subject").count() == 0
    assert R.keyed_state(df, train.filter("false"), "subject").count() == 0
