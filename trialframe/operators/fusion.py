"""Output-space fusion of two modalities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.functions.columns import argmax0, safe_div, zip_mean, zip_product, zip_weighted

SWEEP = ["mean", "product", "conf_weight", "maxconf_pick", "stacking", "cal_mean", "cal_conf_weight"]


def late_fusion(df: DataFrame, a: str, b: str, name: str = "fused") -> DataFrame:
    return df.withColumn(name, zip_mean(a, b))


def combiner_labels(a: str, b: str, stacking: str, cal_a: str, cal_b: str) -> dict[str, Column]:
    top = F.array_max
    return {
        "mean": argmax0(zip_mean(a, b)),
        "product": argmax0(zip_product(a, b)),
        "conf_weight": argmax0(zip_weighted(top(a), a, top(b), b)),
        "maxconf_pick": F.when(top(a) >= top(b), argmax0(a)).otherwise(argmax0(b)),
        "stacking": argmax0(stacking),
        "cal_mean": argmax0(zip_mean(cal_a, cal_b)),
        "cal_conf_weight": argmax0(zip_weighted(top(cal_a), cal_a, top(cal_b), cal_b)),
    }


def aggregation_sweep(df: DataFrame, by: list[str], a: str, b: str, stacking: str, cal_a: str, cal_b: str) -> DataFrame:
    """Accuracy of every combiner and the confidence gap of both modalities, in one pass over the rows."""
    aggs = [F.avg((c == F.col("y")).cast("int")).alias(n) for n, c in
            combiner_labels(a, b, stacking, cal_a, cal_b).items()]
    for n, p in (("gap_a", a), ("gap_b", b)):
        hit = argmax0(p) == F.col("y")
        aggs.append((F.avg(F.when(hit, F.array_max(p))) - F.avg(F.when(~hit, F.array_max(p)))).alias(n))
    return df.groupBy(*by).agg(*aggs)


def complementarity(df: DataFrame, by: list[str], ca: str = "ca", cb: str = "cb") -> DataFrame:
    """Headroom of a perfect selector and the correlation of the two correctness flags (boolean columns)."""
    a, b = F.col(ca), F.col(cb)
    share = lambda c: F.avg(c.cast("int"))
    g = df.groupBy(*by).agg(share(a).alias("acc_a"), share(b).alias("acc_b"), share(a | b).alias("oracle_either"),
                            share(a & b).alias("both_correct"), share(a & ~b).alias("a_only"),
                            share(~a & b).alias("b_only"), share(~a & ~b).alias("both_wrong"))
    va, vb = F.col("acc_a") * (1 - F.col("acc_a")), F.col("acc_b") * (1 - F.col("acc_b"))
    phi = safe_div(F.col("both_correct") - F.col("acc_a") * F.col("acc_b"), F.sqrt(va * vb))
    return g.withColumns({"best_single": F.greatest("acc_a", "acc_b"), "err_corr": phi}).drop("acc_a", "acc_b")


def oracle_gap(sweep: DataFrame, comp: DataFrame, by: list[str]) -> DataFrame:
    """Best aggregator − best single modality."""
    return sweep.join(comp, by).select(*by, F.greatest(*SWEEP).alias("best_combined"), "best_single",
                                       (F.greatest(*SWEEP) - F.col("best_single")).alias("gain"),
                                       (F.col("oracle_either") - F.greatest(*SWEEP)).alias("oracle_gap"))


def block_report(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Per block: subject, truth and both predictions."""
    j = a.join(b, key)
    return j.withColumns({"ca": F.col("truth") == F.col("pred_a"), "cb": F.col("truth") == F.col("pred_b")})


def feature_fusion(fa: DataFrame, fb: DataFrame, key: list[str], fold: str, n_classes: int) -> DataFrame:
    """Concatenate both feature vectors per block and fit one discriminant per fold."""
    from trialframe.operators.classify import shrinkage_lda
    both = fa.withColumnRenamed("f", "_a").join(fb.select(*key, F.col("f").alias("_b")), key)
    f = both.withColumn("f", F.concat("_a", "_b")).drop("_a", "_b")
    return shrinkage_lda(f, fold, n_classes, "auto")


def stacking(base: DataFrame, fold: str, inner: str, n_classes: int, key: list[str], min_groups: int = 3) -> DataFrame:
    """Learned combiners from out-of-fold probabilities.

    ``base(key…, y, fold, inner, pa, pb)`` has one row per (block, outer fold): ``inner`` is NULL on the block's own
    test fold, where pa and pb come from the outer model, and the inner fold's number where they come from the model
    that left that inner fold out. Per outer fold a discriminant is fitted on the out-of-fold rows of its train blocks,
    and a temperature per modality; a fold with too few inner groups falls back to the plain mean.
    """
    from trialframe.functions.columns import let, softmax
    from trialframe.operators.classify import linear_scores
    from trialframe.operators.metrics import temperature_fit
    log = lambda p: F.transform(p, lambda v: F.log(v + 1e-12))
    oof = base.filter(F.col(inner).isNotNull())
    rows = base.withColumn("f", F.concat("pa", "pb"))
    groups = oof.groupBy(fold).agg(F.count_distinct(inner).alias("_groups"))
    models = stack_models(rows, fold, inner, n_classes)
    ta = temperature_fit(oof.withColumn("_l", log("pa")), [fold], "_l").select(fold, F.col("temperature").alias("_ta"))
    tb = temperature_fit(oof.withColumn("_l", log("pb")), [fold], "_l").select(fold, F.col("temperature").alias("_tb"))
    test = rows.filter(F.col(inner).isNull()).join(ta, fold).join(tb, fold).join(groups, fold)
    scored = linear_scores(test, models, fold)
    enough = F.col("_groups") >= min_groups
    cool = lambda p, t: let(F.transform(log(p), lambda v: v / t), lambda z: softmax(z))
    return scored.select(*key, "y", fold, "pa", "pb",
                         F.when(enough, softmax("scores")).otherwise(zip_mean("pa", "pb")).alias("stacked"),
                         F.when(enough, cool("pa", F.col("_ta"))).otherwise(F.col("pa")).alias("cal_a"),
                         F.when(enough, cool("pb", F.col("_tb"))).otherwise(F.col("pb")).alias("cal_b"))


def stack_models(rows: DataFrame, fold: str, inner: str, n_classes: int) -> DataFrame:
    """One meta-discriminant per outer fold from that fold's out-of-fold rows (statistics keyed by fold, solved in the
    tasks)."""
    import numpy as np
    import pandas as pd

    from trialframe.operators.classify import feature_mean, lda_statistics, solve_lda
    train = rows.filter(F.col(inner).isNotNull())
    centre = feature_mean(train)
    d = len(centre)
    stats = lda_statistics(train, [fold, "y"], centre)
    packed = stats.groupBy(fold).agg(F.collect_list(F.struct("y", "_s")).alias("own"))
    fold_type = rows.schema[fold].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            for k, own in zip(pdf[fold], pdf["own"]):
                classes, coef, offset = solve_lda({o["y"]: np.asarray(o["_s"]) for o in own}, d, "auto", standardize=False)
                w, b = np.zeros((n_classes, d)), np.full(n_classes, -1e30)
                w[classes], b[classes] = coef, offset - coef @ centre
                yield pd.DataFrame({fold: [k], "w": [list(w)], "b": [b]})

    return packed.mapInPandas(run, f"`{fold}` {fold_type}, w array<array<double>>, b array<double>")


def nested_probs(df: DataFrame, outer: DataFrame, nested: DataFrame, n_classes: int, shrinkage="auto") -> DataFrame:
    """Probabilities of every block in every outer fold: from the outer model on its test fold (``inner`` = −1), else from
    the model that left the block's inner group out. ``outer(subject, fold)``, ``nested(fold, subject, inner_fold)``.

    The features are summed once per (subject, class); all (outer, inner) models are sums of those statistics.
    """
    import numpy as np
    import pandas as pd

    from trialframe.functions.columns import softmax, vector_sum
    from trialframe.operators.classify import feature_mean, lda_statistics, linear_scores, solve_lda
    centre = feature_mean(df)
    d = len(centre)
    stats = lda_statistics(df, ["subject", "y"], centre, shrinkage == "auto")
    own = stats.join(nested, "subject").groupBy("fold", "inner_fold", "y").agg(vector_sum("_s").alias("_s"))
    packed = own.groupBy("fold").agg(F.collect_list(F.struct("inner_fold", "y", "_s")).alias("own"))

    def run(batches):
        for pdf in batches:
            for k, parts in zip(pdf["fold"], pdf["own"]):
                rows = []
                for left_out in sorted({p["inner_fold"] for p in parts}) + [-1]:
                    train: dict = {}
                    for p in parts:
                        if p["inner_fold"] != left_out:
                            train[p["y"]] = train.get(p["y"], 0.0) + np.asarray(p["_s"])
                    w, b = np.zeros((n_classes, d)), np.full(n_classes, -1e30)
                    if train:
                        classes, coef, offset = solve_lda(train, d, shrinkage)
                        w[classes], b[classes] = coef, offset - coef @ centre
                    rows.append((k, left_out, list(w), b))
                yield pd.DataFrame(rows, columns=["fold", "inner", "w", "b"])

    models = packed.mapInPandas(run, "fold int, inner int, w array<array<double>>, b array<double>")
    place = nested.select("subject", "fold", F.col("inner_fold").alias("inner")).unionByName(
        outer.select("subject", "fold", F.lit(-1).alias("inner")))
    scored = linear_scores(df.join(place, "subject").withColumn("_k", F.struct("fold", "inner")),
                           models.select(F.struct("fold", "inner").alias("_k"), "w", "b"), "_k")
    return scored.select(*[c for c in df.columns if c != "f"], "fold", "inner", softmax("scores").alias("probs"))
