"""Guards, boundaries and leakage."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialframe.operators import classify as C
from trialframe.operators import descriptors as D
from trialframe.operators import epoching as E
from trialframe.operators import fusion as FU
from trialframe.operators import coupling, joins, labels, metrics, normalize, retrieval, spectral, splits
from trialframe.operators import methods
from trialframe.sources import cloud, tables


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def recording(spark, values, rec="a"):
    return frame(spark, [(rec, i, [float(v)]) for i, v in enumerate(values)], "rec string, t bigint, c array<double>")


# ---- epoching --------------------------------------------------------------------------------------------------

def test_window_on_the_edge_is_kept_and_one_past_is_dropped(spark):
    onsets, n, length = (3, 27, 61, 66, 67, 70), 73, 7
    ev = frame(spark, [("a", i, o, "x") for i, o in enumerate(onsets)], "rec string, event int, onset bigint, label string")
    out = E.block_epochs(recording(spark, [2 * i for i in range(n)]), ev, 1.0, 0, length).orderBy("onset").collect()
    assert [r["onset"] for r in out] == [o for o in onsets if o + length <= n] == [3, 27, 61, 66]
    assert out[2]["x"] == [[2.0 * (61 + i) for i in range(length)]]


def test_baseline_is_the_head_of_the_window(spark):
    v = [7.0] * 31 + [5.5] * 30
    ev = frame(spark, [("a", 0, 31, "x")], "rec string, event int, onset bigint, label string")
    x = E.block_epochs(recording(spark, v), ev, 1.0, -3, 2, 3).head()["x"][0]
    assert x == [0.0] * 3 + [-1.5] * 2


def test_onsets_in_samples_raise(spark):
    ev = frame(spark, [("a", 0, 60.0, "x")], "rec string, event int, onset double, label string")
    with pytest.raises(Exception, match="onsets must be in seconds"):
        E.event_epochs(recording(spark, range(100)), ev, 2.0, 0, 1).collect()


def test_embedding_a_short_epoch_raises(spark):
    df = frame(spark, [(0, [[1.0, 2.0]])], "id int, x array<array<double>>")
    with pytest.raises(Exception, match="too short"):
        E.time_delay_embed(df, 3, 1).collect()


def test_trigger_edges_across_chunks(spark):
    code = [0, 2, 2, 0, 3, 0, 9, 1]
    s = frame(spark, [("a", i, c) for i, c in enumerate(code)], "rec string, t bigint, code int")
    from trialframe.operators.ordinal import with_previous
    small = with_previous(s, ["rec"], "t", ["code"], chunk=3).orderBy("t").collect()
    assert [r["prev_code"] for r in small] == [None, *code[:-1]]
    out = E.trigger_onsets(s, "code", 5).orderBy("onset").collect()
    assert [(r["onset"], r["code"]) for r in out] == [(1, 2), (4, 3)]


def test_linear_resampling_fills_zero_outside_and_keeps_the_last_sample(spark):
    s = frame(spark, [("a", 0, 1.5, 3.0), ("a", 1, 2.5, 5.0), ("a", 2, 4.0, 2.0)], "rec string, t bigint, sec double, v double")
    out = [r["v"] for r in E.resample_linear(s, 1.0, 7).orderBy("g").collect()]
    assert np.allclose(out, [0, 0, 4.0, 4.0, 2.0, 0, 0])


def test_roll_and_shift(spark):
    df = frame(spark, [([1.0, 2.0, 3.0, 4.0],)], "a array<double>")
    row = df.select(E.roll("a", 1).alias("r"), E.roll("a", -1).alias("l"), E.shift_fill("a", 2).alias("s"),
                    E.shift_fill("a", 9).alias("far")).head()
    assert row["r"] == [4, 1, 2, 3] and row["l"] == [2, 3, 4, 1] and row["s"] == [1, 1, 1, 2] and row["far"] == [1] * 4


# ---- descriptors -----------------------------------------------------------------------------------------------

def test_descriptors_of_constant_ramp_and_single_sample(spark):
    rows = [("flat", i, -2.5) for i in range(14)] + [("ramp", i, 1.0 - 0.5 * i) for i in range(60)] + [("one", 0, -2.0)]
    b = D.extract_bank(frame(spark, rows, "k string, i int, x double"), ["k"]).toPandas().set_index("k")
    c, p, o = b.loc["flat"], b.loc["ramp"], b.loc["one"]
    assert (c["mean"], c["variance"], c["range"], c["auc"], c["skew"], c["kurtosis"], c["slope"]) == (-2.5, 0, 0, -32.5, 0, 0, 0)
    assert (p["peak"], p["zero_crossings"]) == (-28.5, 1)
    assert np.allclose([p["slope"], p["early_slope"], p["late_slope"]], -0.5)
    assert o["peak"] == -2 and np.isnan(o["slope"]) and o["auc"] == 0


def test_peak_takes_the_first_of_equal_magnitudes(spark):
    rows = [("a", 0, 1.0), ("a", 1, -4.0), ("a", 2, 4.0)]
    b = D.extract_bank(frame(spark, rows, "k string, i int, x double"), ["k"], ["peak", "time_to_peak"]).head()
    assert b["peak"] == -4.0 and abs(b["time_to_peak"] - 1 / 3) < 1e-12


def test_unknown_names_raise(spark):
    df = frame(spark, [("a", 0, 1.0)], "k string, i int, x double")
    for call in (lambda: D.extract_bank(df, ["k"], ["nope"]), lambda: D.select_recipe(df, "nope"), lambda: spectral.clean_chain(df, ["nope"]),
                 lambda: methods.get_method("nope"), lambda: splits.folds_for(df, "nope"),
                 lambda: joins.channel_positions(["a"], ["b"]), lambda: C.windowed_pool(df, ["k"], "nope")):
        with pytest.raises(ValueError):
            call()


# ---- cleaning --------------------------------------------------------------------------------------------------

def test_cbsi_cancels_the_common_part_and_chain_order_matters(spark):
    t = np.arange(200)
    neural, common = np.sin(t / 5), 3 * np.sin(t / 17)
    df = frame(spark, [(0, [(neural + common).tolist(), (-neural + common).tolist()])], "id int, x array<array<double>>")
    x = spectral.cbsi(df).head()["x"]
    assert np.corrcoef(x[0], neural)[0, 1] > 0.99
    drift = frame(spark, [(0, [(0.5 * t + 2).tolist(), (t * 1.0).tolist()])], "id int, x array<array<double>>")
    assert np.allclose(spectral.detrend(drift).head()["x"], 0, atol=1e-9)
    a = spectral.clean_chain(df.select("id", F.transform("x", lambda r: F.transform(r, lambda v, i: v + i)).alias("x")), ["cbsi", "detrend"])
    b = spectral.clean_chain(df.select("id", F.transform("x", lambda r: F.transform(r, lambda v, i: v + i)).alias("x")), ["detrend", "cbsi"])
    assert not np.allclose(a.head()["x"], b.head()["x"])
    assert spectral.clean_chain(df, None) is df


# ---- labels and joins ------------------------------------------------------------------------------------------

def test_unknown_label_raises(spark):
    df = frame(spark, [("rest",), ("odd",)], "label string")
    with pytest.raises(Exception, match="unknown label: odd"):
        labels.remap_labels(df, {"rest": 0}).collect()


def test_overlapping_concepts_raise_when_strict(spark):
    a, b = (frame(spark, [(n,)], "name string") for n in ("00001_cat", "00077_cat"))
    assert labels.holdout_sets_disjoint(a, b).head()["overlap"] == 1
    with pytest.raises(Exception, match="overlap"):
        labels.holdout_sets_disjoint(a, b, strict=True).collect()


def test_mask_without_flag_columns_keeps_all(spark):
    df = frame(spark, [(1,), (2,)], "onset int")
    assert labels.event_mask(df).count() == 2


def test_empty_gather_and_misaligned_modalities_raise(spark):
    empty = frame(spark, [], "epoch int")
    with pytest.raises(ValueError):
        joins.gather(empty, empty, ["epoch"])
    a = frame(spark, [("s", 0, "x"), ("s", 1, "y")], "subject string, o int, label string")
    b = frame(spark, [("s", 0, "x"), ("s", 1, "x")], "subject string, o int, label string")
    assert joins.gather_aligned(a, a, F.lit(0), ["o"], strict=True).count() == 2
    with pytest.raises(Exception, match="misaligned"):
        joins.gather_aligned(a, b, F.lit(0), ["o"], strict=True).collect()
    with pytest.raises(Exception, match="misaligned"):
        joins.gather_aligned(a, b.limit(1), F.lit(0), ["o"], strict=True).collect()


def test_missing_embedding_raises_and_last_duplicate_wins(spark):
    bank = frame(spark, [("a", 1.0, 0), ("a", 2.0, 1)], "file string, vec double, o int")
    t = frame(spark, [("a",)], "file string")
    assert joins.embedding_lookup(t, bank, "file", "vec", "o").head()["vec"] == 2.0
    with pytest.raises(Exception, match="no vector for b"):
        joins.embedding_lookup(frame(spark, [("b",)], "file string"), bank, "file", "vec", "o").collect()


# ---- splits ----------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def cloud_rows(spark):
    rows = [(0, f"p{s:02d}", day, (s + e) % 2) for s in range(9) for day in ("mon", "tue", "wed") for e in range(5)]
    return spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], "epoch int, subject string, session string, label_id int")


def test_groups_are_whole_and_tested_once(spark, cloud_rows):
    f = splits.subject_folds(cloud_rows, 5).toPandas()
    assert sorted(f["subject"]) == [f"p{s:02d}" for s in range(9)] and set(f["fold"]) == set(range(5))
    order = sorted(f["subject"], reverse=True)
    assert f.set_index("subject").loc[order, "fold"].tolist() == [i % 5 for i in range(9)]
    g = splits.stratified_group_kfold(cloud_rows, "subject", "label_id", 3, (0, 1)).toPandas()
    assert len(g) == 18 and g.groupby("seed")["subject"].nunique().tolist() == [9, 9]


def test_loso_counts_and_parts(spark, cloud_rows):
    f = splits.leave_one_subject_out(cloud_rows).collect()
    assert all((r["n_test"], r["n_train"]) == (15, 120) for r in f) and len(f) == 9
    p = splits.fold_part(cloud_rows, "p03").groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in p} == {"test": 15, "train": 120}


def test_nested_folds_never_see_the_outer_test_subjects(spark, cloud_rows):
    n = splits.nested_group_folds(cloud_rows, 4, 3).toPandas()
    own = splits.subject_folds(cloud_rows, 4).toPandas().set_index("subject")["fold"]
    assert (n["fold"].to_numpy() != own.loc[n["subject"]].to_numpy()).all()


def test_calibration_slice_is_disjoint_and_labelled(spark, cloud_rows):
    d = splits.stratified_calibration(cloud_rows, 0.5, 1)
    g = d.filter("part = 'calib'").groupBy("subject", "label_id").count().collect()
    assert len(g) == 18 and {r["count"] for r in g} <= {3, 4, 5}


def test_single_row_validation(spark):
    one = frame(spark, [(0, "1", "a", 0)], "epoch int, subject string, session string, label_id int")
    assert splits.val_carve(one).head()["part"] == "val"


# ---- normalization leakage -------------------------------------------------------------------------------------

def test_scaler_uses_train_rows_only_and_weights_come_after(spark):
    rows = [("a", "train", v) for v in (-1.0, 1.0)] + [("a", "test", v) for v in (-5.0, 5.0)]
    df = frame(spark, rows, "family string, part string, f double")
    out = normalize.weighted_family_scaler(df, ["family"], "f", "family", {"a": 2.0}).filter("part = 'test'").toPandas()["f"]
    assert np.allclose(sorted(out), [-10, 10], atol=1e-6)
    assert normalize.compose_normalization(df, []) is df


def test_subject_zscore_of_a_constant_feature_is_zero(spark):
    df = frame(spark, [("a", 4.0), ("a", 4.0), ("b", 1.0), ("b", 3.0)], "subject string, f double")
    out = normalize.zscore_subject(df, ["subject"], "f").toPandas()
    assert out[out["subject"] == "a"]["f"].tolist() == [0.0, 0.0]


# ---- metrics ---------------------------------------------------------------------------------------------------

def preds(spark, y, p, conf):
    return frame(spark, [("f", int(a), int(b), float(c)) for a, b, c in zip(y, p, conf)], "fold string, y int, yhat int, conf double")


def test_one_class_kappa_is_null_and_bins_are_half_open(spark):
    c = metrics.contingency(preds(spark, [1, 1], [1, 1], [0.0, 1.0]), ["fold"])
    assert metrics.kappa(c, ["fold"]).head()["kappa"] is None
    r = metrics.reliability(c, ["fold"]).collect()
    assert [(x["bin"], x["weight"]) for x in r] == [(14, 0.5)]
    low = metrics.contingency(preds(spark, [1, 1], [1, 1], [0.0, 0.1]), ["fold"], 10, closed_low=True)
    assert [x["bin"] for x in metrics.reliability(low, ["fold"]).collect()] == [0]


def test_confusion_has_zero_cells(spark):
    c = metrics.confusion(metrics.contingency(preds(spark, [0, 2], [0, 1], [1, 1]), []), [], 3).toPandas()
    assert len(c) == 9 and c["n"].sum() == 2


def test_complementarity_closed_form(spark):
    df = frame(spark, [(True, True), (True, False), (False, True), (False, False)], "ca boolean, cb boolean")
    r = FU.complementarity(df, []).head()
    assert (r["oracle_either"], r["both_correct"], r["best_single"], r["err_corr"]) == (0.75, 0.25, 0.5, 0.0)
    flat = FU.complementarity(frame(spark, [(True, True), (True, False)], "ca boolean, cb boolean"), []).head()
    assert flat["err_corr"] is None


def test_invariants_strict(spark):
    s = "run string, k int, acc double, point double, lo double, hi double, chance double, a double, b double, delta double"
    good = frame(spark, [("r", 1, 0.4, 0.4, 0.3, 0.5, 0.1, 0.3, 0.4, 0.1)], s)
    assert metrics.check_invariants(good).count() == 0
    bad = frame(spark, [("r", 1, float("nan"), 0.4, 0.5, 0.6, 0.1, 0.3, 0.4, 0.2)], s)
    assert sorted(r["rule"] for r in metrics.check_invariants(bad).collect()) == ["bounded", "bracket", "delta"]
    with pytest.raises(Exception, match="invariant violated"):
        metrics.check_invariants(bad, strict=True).collect()


def test_stacking_with_enough_and_too_few_groups(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(60):
        for fold in range(2):
            y = i % 3
            pa = np.full(3, 0.1)
            pa[y] = 0.8
            pb = rng.dirichlet(np.ones(3))
            groups = 3 if fold == 0 else 2
            inner = None if i % 2 == fold else (i // 2) % groups
            rows.append((i, y, fold, inner, pa.tolist(), pb.tolist()))
    df = frame(spark, rows, "id int, y int, fold int, inner int, pa array<double>, pb array<double>")
    out = FU.stacking(df, "fold", "inner", 3, ["id"]).toPandas()
    assert len(out) == 60
    first = out[out["fold"] == 0]
    assert (np.stack(first["stacked"]).argmax(axis=1) == first["y"]).all()
    few = out[out["fold"] == 1]
    assert np.allclose(np.stack(few["stacked"]), (np.stack(few["pa"]) + np.stack(few["pb"])) / 2)
    assert np.allclose(np.stack(few["cal_a"]), np.stack(few["pa"]))


# ---- sources ---------------------------------------------------------------------------------------------------

def test_recipe_keys(spark):
    one = spark.range(1)
    lit = F.lit
    assert one.select(cloud.recipe_key(lit(8.0), lit(32.0), lit(0.0), lit(None).cast("double"), lit(128.0))).head()[0] == "b8p0-32p0_t0p0-full_r128p0"
    key = cloud.haemo_recipe_key(lit(0.01), lit(0.1), lit(-2.0), lit(28.0), lit(None).cast("double"), ["cbsi", "detrend"])
    assert one.select(key).head()[0] == "b0p01-0p1_tm2p0-28p0_rnative_ccbsi+detrend"


def test_cloud_is_built_once_and_rebuilt_on_request(spark, tmp_path):
    rows = [("d", "k", str(s), "a", "r", e % 2, "x", e) for s in (1, 2) for e in range(3)]
    df = frame(spark, rows, "dataset string, recipe string, subject string, session string, run string, label_id int, label string, epoch int")
    path = str(tmp_path / "cloud")
    assert cloud.build_cloud(df, path).count() == 6
    assert cloud.build_cloud(df, path).count() == 6
    assert cloud.build_cloud(df.withColumn("label", F.lit("y")), path, rebuild=True).filter("label = 'y'").count() == 6
    assert cloud.load_cloud(spark, path, ["d"], "k").count() == 6 and cloud.load_cloud(spark, path, ["d"], "z").count() == 0


def test_run_aggregates_of_both_layouts(spark, tmp_path):
    runs = {"csp_lda_within_bci": {"method": "csp_lda", "regime": "within", "n_classes": 4,
                                   "fold_mean": {"acc": 0.59761, "kappa": 0.4, "ece": 0.1}},
            "align_cross_subject_bci": {"acc_mean": 0.5, "kappa_mean": 0.25},
            "fusion_cross_subject_bci": {"fold_mean": {"acc": 0.6}, "per_role_mean": {"late": 0.58721, "x": 1.0},
                                         "complementarity": {"x": 0.25}},
            "broken_within_bci": {"note": "none"}}
    for name, agg in runs.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "aggregate.json").write_text(json.dumps(agg))
    raw = tables.read_run_aggregates(spark, str(tmp_path))
    out = tables.normalize_runs(raw, ["bci"]).toPandas().set_index("run")
    assert set(out.index) == set(runs) - {"broken_within_bci"}
    assert out.loc["csp_lda_within_bci", "acc"] == 0.5976
    assert tuple(out.loc["align_cross_subject_bci", ["method", "regime", "dataset"]]) == ("align", "cross_subject", "bci")
    assert dict(out.loc["fusion_cross_subject_bci", "extra"]) == {"late": 0.5872, "x": 0.25}


def test_events_tsv(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("onset\tobject\tstimname\tisteststim\tistarget\n0.5\tcat\tc1.jpg\t0\t0\n1.0\tdog\td1.jpg\t1\t0\n")
    ev = tables.read_events_tsv(spark, str(tmp_path / "e.tsv"))
    assert labels.event_mask(ev).collect()[0]["object"] == "cat" and labels.event_mask(ev, include_validation=True).count() == 2


def test_methods_decode_planted_classes(spark):
    """A separable cloud through folds, every fast method and the report."""
    rng = np.random.default_rng(1)
    rows = []
    for s in range(4):
        for e in range(24):
            y = e % 3
            x = rng.standard_normal((4, 16)) * np.where(np.arange(4) == y, 4.0, 1.0)[:, None] + 2.0 * y
            rows.append((str(s), e, y, s % 2, x.tolist()))
    df = frame(spark, rows, "subject string, blk int, y int, fold int, x array<array<double>>")
    task = methods.Task(n_ch=4, n_samples=16, fs=8.0, n_classes=3, bands=(("a", 0.5, 2.0), ("b", 2.0, 4.0)), csp_filters=3, win_s=1.0, task_dur=1.5)
    names = ["fnirs_lda", "fnirs_windowed", "csp_lda", "riemann_mdm", "eeg_bandpower"]
    rep = methods.matrix_report(methods.run_matrix(df, task, names)).toPandas().set_index("run")
    assert set(rep.index) == set(names) and (rep["n"] == 96).all()
    assert (rep["acc"] > 0.8).all(), rep


def test_windows_are_slices_of_pieces_and_events_named_twice_go(spark):
    v = [float(i * i % 17) for i in range(40)]
    gap = spark.createDataFrame([("g", t, [float(t)]) for t in range(20) if t != 9], "rec string, t bigint, c array<double>")
    onsets = [("r", k, k, "a") for k in range(-2, 42)] + [("r", 100, 12, "a"), ("r", 100, 20, "a")] + [("g", 200 + k, k, "b") for k in range(20)]
    ev = spark.createDataFrame(onsets, "rec string, event bigint, onset bigint, label string")
    out = E.block_epochs(recording(spark, v, "r").unionByName(gap), ev, 1.0, -1, 3)
    got = {(e["rec"], e["event"]): e["x"][0] for e in out.collect()}
    want = {("r", k): v[k - 1:k + 3] for k in range(1, 38)}
    want |= {("g", 200 + k): [float(t) for t in range(k - 1, k + 3)] for k in range(1, 18) if not k - 1 <= 9 < k + 3}
    assert got == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")      # nothing is gathered per window after the join


def test_series_of_all_bands_are_made_in_one_pass(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal((2, t)).tolist(), rng.standard_normal((4, t)).tolist()) for i, t in enumerate([8, 8, 2, 5, 11])]
    df = frame(spark, rows, "id int, xe array<array<double>>, xf array<array<double>>")
    bands = {"slow": (0.3, 0.9), "fast": (0.9, 1.8)}
    out = coupling.channel_series(df, 4.0, 4.0, -0.5, 4.0, 2.0, 0.25, bands)
    assert out.columns == ["id", "env_slow", "env_fast", "neural"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    for name, (lo, hi) in bands.items():
        want = coupling.regrid(E.band_envelope(df.select("id", F.col("xe").alias("x")), lo, hi, 4.0), "x", 0.0, 4.0, 0.25, 8)
        assert [r[0] for r in out.orderBy("id").select(f"env_{name}").collect()] == [r[0] for r in want.orderBy("id").select("x").collect()]
    x = np.array(coupling.regrid(df.select("id", F.col("xf").alias("x")), "x", -0.75, 4.0, 0.25, 8).orderBy("id").first()["x"])
    want = 0.5 * (x[:2] - x[:2].std(axis=1, keepdims=True) / (x[2:].std(axis=1, keepdims=True) + 1e-9) * x[2:])
    assert np.allclose(out.orderBy("id").first()["neural"], want, atol=1e-9)


def test_randomized_copies_read_the_epochs_once(spark):
    from trialframe.operators import sampling
    rows = [(k, p, [[float(k + t + 3 * c) for t in range(k + 1)] for c in range(4)]) for k, p in enumerate(["train", "test", None, "train"])]
    out = sampling.domain_randomize(frame(spark, rows, "id int, part string, x array<array<double>>"), ["id"], 4.0, 2, 5)
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["id"], r["copy"]): r["x"] for r in out.collect()}
    assert sorted(got) == [(0, 0), (0, 1), (0, 2), (1, 0), (2, 0), (3, 0), (3, 1), (3, 2)]
    assert all(got[(k, 0)] == x for k, _, x in rows)
    assert got[(3, 1)] != got[(3, 2)] and all(len(ch) == 4 for ch in got[(3, 1)])


def test_matrix_makes_covariances_once_and_predicts_as_each_method(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(str(e % 4), e // 4, e % 3, e % 2, (rng.standard_normal((3, 12)) * np.where(np.arange(3) == e % 3, 2.0, 1.0)[:, None]).tolist()) for e in range(60)]
    df = frame(spark, rows, "subject string, blk int, y int, fold int, x array<array<double>>")
    task = methods.Task(n_ch=3, n_samples=12, fs=8.0, n_classes=3, csp_filters=3)
    names, made, real = ["csp_lda", "riemann_mdm"], [], methods.trial_covariance
    alone = {n: methods.get_method(n)(df, task) for n in names}
    monkeypatch.setattr(methods, "trial_covariance", lambda *a: made.append(1) or real(*a))
    got = methods.run_matrix(df, task, names)
    assert len(made) == 1
    for n in names:
        a, b = (np.array([r["probs"] for r in d.orderBy("subject", "blk").collect()]) for d in (got.filter(F.col("run") == n), alone[n]))
        assert len(a) == 60 and np.allclose(a, b, atol=1e-9)


# ---- cases of the last review ----------------------------------------------------------------------------------

def test_unknown_concept_is_a_miss(spark):
    bank = frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])], "concept bigint, v array<double>")
    t = frame(spark, [(0, 1, [1.0, 0.1]), (1, 9, [1.0, 0.1])], "trial bigint, concept bigint, v array<double>")
    state = retrieval.retrieval_state(t, bank, ["trial"])
    rows = {r["trial"]: (r["rank"], r["hit1"]) for r in retrieval.retrieval_hits(state, (1,)).collect()}
    assert rows == {0: (1, 1), 1: (None, 0)}
    m = retrieval.retrieval_metrics(state, [], (1,)).head()
    assert (m["recall1"], m["mrr"]) == (0.5, 0.5)


def test_bank_blocks_agree_whatever_their_number(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((40, 5)).round(1)
    v[20:] = v[:20]  # ties
    bank = frame(spark, [(i, x.tolist()) for i, x in enumerate(v)], "concept bigint, v array<double>")
    t = frame(spark, [(i, i, rng.standard_normal(5).tolist()) for i in range(40)], "trial bigint, concept bigint, v array<double>")
    one, many = (sorted(tuple(r) for r in retrieval.retrieval_state(t, bank, ["trial"], block=b).select("trial", "rank", "pred").collect()) for b in (100, 7))
    assert one == many


def test_rebuild_keeps_other_subjects(spark, tmp_path):
    from trialframe.sources import cloud
    rows = [("d", "r", f"s{s}", e, float(s)) for s in range(40) for e in range(3)]
    schema = "dataset string, recipe string, subject string, epoch int, x double"
    cloud.build_cloud(frame(spark, rows, schema), str(tmp_path / "t"))
    out = cloud.build_cloud(frame(spark, [("d", "r", "s1", 0, -1.0)], schema), str(tmp_path / "t"), rebuild=True)
    assert out.count() == 118 and [r["x"] for r in out.filter("subject = 's1'").collect()] == [-1.0]


def test_criteria_join_keeps_sessions(spark):
    df = frame(spark, [("1", "a"), ("2", "b"), ("3", "c")], "subject string, session string")
    wanted = frame(spark, [("1",), ("1",)], "subject string")
    assert labels.filter_criteria(df, wanted, ["c"]).count() == 2 and labels.filter_criteria(df, wanted).count() == 1


def test_runs_without_a_paired_arm(spark):
    schema = "run string, k int, acc double, point double, lo double, hi double, chance double, a double, b double, delta double"
    df = frame(spark, [("x", 1, 0.7, 0.7, 0.6, 0.8, 0.5, None, None, None), ("y", 1, 0.7, 0.7, 0.6, 0.8, 0.5, 0.5, 0.6, None)], schema)
    assert [tuple(r) for r in metrics.check_invariants(df).select("run", "rule").collect()] == [("y", "delta")]


def test_one_strided_row(spark):
    from trialframe.operators.align import strided_sample
    df = frame(spark, [("a", i) for i in range(9)], "k string, o int")
    assert [r["o"] for r in strided_sample(df, ["k"], ["o"], F.floor(F.col("o") / 4), 1).collect()] == [0]


def test_filter_bank_keeps_a_band_that_ends_on_the_edge():
    from trialframe.operators.classify import filter_bank_bands
    assert len(filter_bank_bands(0.4, 1.0, 0.2)) == 3 and len(filter_bank_bands(4, 40, 4)) == 9 and len(filter_bank_bands(4, 39, 4)) == 8


@pytest.mark.parametrize("odd", [None, "x", "sub-1"])
def test_range_buckets_are_even_and_rise_whatever_the_names(spark, odd):
    from trialframe.operators.ordinal import ordinal, range_bucket
    names = spark.range(100_000).select(F.format_string("sub-%07d", F.col("id") * 17).alias("subject"))
    if odd:
        names = names.union(spark.createDataFrame([(odd,), ("",), ("y" * 1000,)], "subject string"))
    bucket = range_bucket(names, "subject")
    sizes = names.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.min("subject").alias("lo"), F.max("subject").alias("hi")).orderBy("lo").collect()
    assert len(sizes) > 15 and max(r["n"] for r in sizes) < 0.1 * 100_000
    assert [r["b"] for r in sizes] == sorted(r["b"] for r in sizes) and all(x["hi"] < y["lo"] for x, y in zip(sizes, sizes[1:]))
    got = ordinal(names, [], ["subject"], bucket, "pos").toPandas().sort_values("subject")
    assert got["pos"].tolist() == list(range(len(got)))
    few = spark.createDataFrame([(None,), ("b",), ("a",)], "subject string")
    assert ordinal(few, [], ["subject"], range_bucket(few, "subject"), "pos").orderBy("pos").toPandas()["subject"].tolist() == [None, "a", "b"]


def test_single_precision_epochs_keep_their_type(spark):
    from trialframe.operators import spatial
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal((2, 24)).tolist()) for i in range(3)]
    wide = frame(spark, rows, "id int, x array<array<double>>")
    for fn in (lambda d: E.bandpass_epochs(d, 2.0, 9.0, 32.0), lambda d: E.band_envelope(d, 2.0, 9.0, 32.0), lambda d: E.resample_fft(d, 12),
               lambda d: spatial.channel_mix(d, [[0.5, -0.5]])):
        narrow = fn(wide.withColumn("x", F.col("x").cast("array<array<float>>")))
        assert narrow.schema["x"].dataType.simpleString() == "array<array<float>>"
        a, b = ([r["x"] for r in d.orderBy("id").collect()] for d in (narrow, fn(wide)))
        assert np.allclose(a, b, atol=1e-5)


def test_run_matrix_query_runs_every_method(monkeypatch):
    from trialframe.plans import model_plans
    from trialframe.plans.catalog import QUERIES
    asked = []

    class Seen(Exception):
        pass

    def seen(epochs, task, names, run_prefix=""):
        asked.extend(names)
        raise Seen

    frame = type("Frame", (), {"select": lambda self, *c: self})()
    monkeypatch.setattr(model_plans, "model_epochs", lambda v: frame)
    monkeypatch.setattr(model_plans.ME, "run_matrix", seen)
    with pytest.raises(Seen):
        QUERIES["run_matrix"](None, "")
    assert asked == list(model_plans.ME.METHODS)


def test_held_out_concepts_are_remapped_row_by_row(spark):
    rows = [(t, c, [float(c or 0), 1.0]) for t, c in enumerate([7, 7, 40, 3, 3, 3, 12, None, 90, 51])]
    df = frame(spark, rows, "trial bigint, concept bigint, v array<double>")
    got = splits.concept_holdout_rows(df, frac=0.5).toPandas().sort_values("trial")
    assert len(got) == 9 and got["trial"].tolist() == [0, 1, 2, 3, 4, 5, 6, 8, 9]      # the row without a concept goes
    val = got[got["part"] == "val"]
    held = sorted(set(val["concept"]))
    assert len(held) == 3 and not set(held) & set(got.loc[got["part"] == "train", "concept"])
    assert val["val_label"].tolist() == [held.index(c) for c in val["concept"]]
    assert got.loc[got["part"] == "train", "val_label"].isna().all()
    proto = retrieval.validation_prototypes(splits.concept_holdout_rows(df, frac=0.5)).orderBy("val_label").toPandas()
    assert proto["concept"].tolist() == held
    for c, v in zip(proto["concept"], proto["v"]):
        assert np.allclose(v, np.array([c, 1.0]) / np.hypot(c, 1.0), atol=1e-6)
    assert splits.concept_holdout_rows(df.limit(0)).count() == 0
