"""Hot keys, partitioning and plans."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialframe.operators import retrieval as R
from trialframe.operators import sampling, splits
from trialframe.operators.ordinal import hash_ordinal, ordinal, time_bucket
from trialframe.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def hot(spark):
    """A third of all rows belong to one subject."""
    d = spark.range(30000).withColumn("subject", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")))
    d = d.withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.abs(F.hash("id")) % 2592000))
    return d.withColumnRenamed("id", "epoch").withColumn("label_id", (F.col("epoch") % 5).cast("int"))


def test_ordinal_of_a_hot_key_equals_a_plain_window(hot):
    got = ordinal(hot, ["subject"], ["ts", "epoch"], time_bucket("ts"), "pos", "n")
    w = W.partitionBy("subject").orderBy("ts", "epoch")
    want = hot.withColumn("pos", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("subject")))
    cols = ["epoch", "pos", "n"]
    assert got.select(*cols).exceptAll(want.select(*cols).select(*[F.col(c).cast(t) for c, t in got.select(*cols).dtypes])).count() == 0
    assert got.count() == 30000


def test_no_task_of_the_ordinal_holds_the_hot_key(hot):
    buckets = hot.groupBy("subject", time_bucket("ts").alias("b")).count()
    assert buckets.agg(F.max("count")).head()[0] < 100


@pytest.mark.parametrize("fn", [
    lambda d: hash_ordinal(d, ["subject"], 1, ["epoch"], "pos").select("epoch", "pos"),
    lambda d: splits.val_carve(d).select("epoch", "part"),
    lambda d: splits.within_subject(d).select("epoch", "part"),
    lambda d: sampling.stratified_batches(d, "label_id", "epoch", 64).select("epoch", "batch"),
    lambda d: sampling.balanced_batches(d, "label_id", "epoch", 2, 16).select("batch", "label_id", "slot", "epoch"),
])
def test_partitioning_does_not_change_results(hot, fn):
    a, b = fn(hot.repartition(1)), fn(hot.repartition(13, "epoch"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_null_keys_are_kept(spark):
    d = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v int")
    out = ordinal(d, ["k"], ["v"], F.floor(F.col("v") / 2), "pos").orderBy("v").collect()
    assert [r["pos"] for r in out] == [0, 1, 0]


def test_balanced_batches_are_balanced_and_without_repeats(hot):
    b = sampling.balanced_batches(hot, "label_id", "epoch", 3, 8)
    g = b.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label_id").alias("c"), F.count_distinct("epoch").alias("u")).collect()
    assert len(g) == 30000 // 24 and all((r["n"], r["c"], r["u"]) == (24, 3, 24) for r in g)


def test_scarce_concepts_repeat(spark):
    d = spark.createDataFrame([(0, 0), (0, 1), (1, 2)], "concept int, key int")
    b = sampling.balanced_batches(d, "concept", "key", 2, 2).toPandas()
    assert len(b) == 4 and b[b["concept"] == 1]["key"].tolist() == [2, 2] and set(b[b["concept"] == 0]["key"]) == {0, 1}


def test_hard_batches_hold_the_seed_and_its_neighbours(spark):
    d = spark.range(400).select((F.col("id") % 8).cast("int").alias("concept"), F.col("id").alias("key"))
    near = spark.createDataFrame([(c, p, (c + p + 1) % 8) for c in range(8) for p in range(2)], "concept int, place int, neighbour int")
    b = sampling.hard_batches(d, near, "concept", "key", 4, 3).toPandas()
    for _, g in b.groupby("batch"):
        have = set(g["concept"])
        assert len(g) == 12 and len(have) == 4
        assert any({(s + 1) % 8, (s + 2) % 8} <= have for s in have)


def test_keyed_retrieval_of_a_hot_key_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    n = 900
    key, y = np.where(np.arange(n) % 3 == 0, "hot", (np.arange(n) % 4).astype(str)), rng.integers(0, 6, n)
    x = rng.standard_normal((n, 5)) + np.eye(6, 5)[y]
    df = spark.createDataFrame(pd.DataFrame({"subject": key, "trial": np.arange(n), "concept": y, "v": x.tolist()})).repartition(6)
    got = R.keyed_state(df, df, "subject").orderBy("trial").toPandas()
    assert len(got) == n
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for k in np.unique(key):
        c = np.stack([x[(key != k) & (y == j)].mean(axis=0) for j in range(6)])
        s = unit[key == k] @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T
        assert got[got["subject"] == k]["pred"].tolist() == s.argmax(axis=1).tolist()
        rank = (s > s[np.arange(len(s)), y[key == k]][:, None]).sum(axis=1) + 1
        assert got[got["subject"] == k]["rank"].tolist() == rank.tolist()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


WRITES = {"build_cloud", "load_cloud", "load_cloud_subjects", "run_aggregates", "subject_manifest", "feature_cache", "events_tsv", "normalize_runs", "stream_standardize"}


@pytest.mark.parametrize("name", sorted(set(ORACLES) - WRITES))
def test_no_cross_join_in_any_plan(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["block_epochs", "extract_bank", "make_split_random_val", "evaluate_folds", "aggregation_sweep", "bootstrap_ci", "bootstrap_kappa",
                                  "cbsi", "detrend", "zscore_subject", "shift_scan", "balanced_batches", "band_powers_relational"])
def test_relational_operators_stay_on_the_jvm(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "Python" not in text and "MapIn" not in text


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(QUERIES["filter_criteria_long_list"](spark, sf_dir))
    assert "GreaterThan(c_acctbal,0.0)" in text
    acc = plan(QUERIES["accuracy"](spark, sf_dir))
    assert "o_custkey" not in acc.split("ReadSchema")[1]


def test_calibration_rows_are_not_gathered_by_fold(spark, sf_dir):
    plan = QUERIES["calibration_transfer"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 4 and plan.count("SortMergeJoin") <= 4


def test_temperature_is_the_same_by_shuffle(spark, sf_dir, monkeypatch):
    from trialframe import session
    from trialframe.operators import metrics as M
    from trialframe.plans.views import Views
    shipped = M.temperature_fit(Views(spark, sf_dir).preds, ["fold"], "za").orderBy("fold").collect()
    monkeypatch.setattr(session, "FEW_ROWS", 2)
    shuffled = M.temperature_fit(Views(spark, sf_dir).preds, ["fold"], "za").orderBy("fold").collect()
    assert [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in shipped] == [
        tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in shuffled]


def test_long_form_computes_its_arrays_once(spark):
    from trialframe.plans.signal_plans import long_epochs
    df = spark.createDataFrame([(1, [[1.0, 2.0], []]), (2, []), (3, None), (4, [None, [3.0]])], "id int, x array<array<double>>")
    out = long_epochs(df.withColumn("x", F.transform("x", lambda ch: F.transform(ch, lambda v: v + 1))), ["id"])
    assert "size(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [(1, 0, 0, 2.0), (1, 0, 1, 3.0), (4, 1, 0, 4.0)]


def test_stacking_sums_its_features_beside_no_other_python_worker(spark, sf_dir, monkeypatch):
    from trialframe.operators import classify
    plans, statistics = [], classify.lda_statistics

    def seen(df, *args, **kwargs):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return statistics(df, *args, **kwargs)

    monkeypatch.setattr(classify, "lda_statistics", seen)
    QUERIES["stacking"](spark, sf_dir)
    assert len(plans) == 3 and not any("InArrow" in p or "InPandas" in p for p in plans)


def test_temperature_losses_of_a_full_batch_stay_small():
    import tracemalloc

    from trialframe.operators import metrics as M
    n, rng = 10_000, np.random.default_rng(0)
    z = rng.normal(size=(n, 5))
    batch = pd.DataFrame({"g": np.arange(n) % 5, "_y": np.arange(n) % 5, "_z": list(z), "_lo": -3.0, "_hi": 3.0})
    tracemalloc.start()
    out = pd.concat(list(M._loss_sums(["g"], 32)([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20
    t = np.exp(-3.0 + 6.0 * np.arange(32) / 31)[:, None, None]
    want = (np.log(np.exp(z / t).sum(axis=-1)) - z[np.arange(n), batch["_y"]] / t[:, :, 0]).T
    assert np.allclose(np.stack(out.sort_values("g")["_s"]), [want[batch["g"] == g].sum(axis=0) for g in range(5)])
