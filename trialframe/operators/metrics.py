"""Evaluation metrics.

Predictions are reduced once to a contingency table (groups, y, ŷ, confidence bin → n, Σ confidence), a few hundred
rows per group. Accuracy, kappa, confusion and calibration error all read that table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialframe.functions.columns import argmax0, asum, edges_above, let, safe_div
from trialframe.operators.ordinal import ordinal
from trialframe.session import few_rows

# fixed values: verdict limits of the calibration transfer and the invariant tolerance
TRANSFER_LIMITED, TRANSFER_GOOD, TOLERANCE, EPS = 0.5, 1.2, 1e-6, 1e-6


def predict_label(df: DataFrame, probs: str = "probs") -> DataFrame:
    return df.withColumns({"yhat": argmax0(probs), "conf": F.array_max(probs)})


def bin_edges(bins: int) -> list[float]:
    return np.linspace(0.0, 1.0, bins + 1).tolist()


def conf_bin(conf: str, bins: int, closed_low: bool = False) -> Column:
    """Bin of (lo, hi]; confidence 0 is in none (−1), or in the first when ``closed_low``."""
    b = edges_above(conf, bin_edges(bins)) - 1
    return F.when(F.col(conf) == 0.0, F.lit(0)).otherwise(b) if closed_low else b


def contingency(pred: DataFrame, by: list[str], bins: int = 15, closed_low: bool = False) -> DataFrame:
    d = pred.withColumn("bin", conf_bin("conf", bins, closed_low))
    return d.groupBy(*by, "y", "yhat", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("conf").alias("sc"))


def accuracy(cont: DataFrame, by: list[str]) -> DataFrame:
    hit = F.sum(F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0))
    return cont.groupBy(*by).agg((hit / F.sum("n")).alias("acc"), F.sum("n").alias("n"))


def kappa(cont: DataFrame, by: list[str]) -> DataFrame:
    """(po − pe)/(1 − pe); NULL when undefined."""
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(zero)
    sides = F.array(F.struct(F.col("y").alias("cls"), F.col("n").alias("r"), zero.alias("k"), hit.alias("d")),
                    F.struct(F.col("yhat").alias("cls"), zero.alias("r"), F.col("n").alias("k"), zero.alias("d")))
    m = cont.select(*by, F.explode(sides).alias("s")).select(*by, "s.*")
    m = m.groupBy(*by, "cls").agg(F.sum("r").alias("r"), F.sum("k").alias("k"), F.sum("d").alias("d"))
    g = m.groupBy(*by).agg(F.sum(F.col("r").cast("double") * F.col("k")).alias("rk"), F.sum("d").alias("d"),
                           F.sum("r").alias("n"))
    po, pe = F.col("d") / F.col("n"), F.col("rk") / (F.col("n").cast("double") * F.col("n"))
    return g.select(*by, safe_div(po - pe, 1 - pe).alias("kappa"))


def confusion(cont: DataFrame, by: list[str], n_classes: int) -> DataFrame:
    """Dense counts, zeros included."""
    grid = F.sequence(F.lit(0), F.lit(n_classes - 1))
    keys = cont.groupBy(*by).agg(F.lit(1).alias("_one")) if by else cont.sparkSession.range(1)
    full = keys.select(*by, F.explode(grid).alias("y")).select("*", F.explode(grid).alias("yhat"))
    c = cont.groupBy(*by, "y", "yhat").agg(F.sum("n").alias("n"))
    return full.join(c, [*by, "y", "yhat"], "left").select(*by, "y", "yhat", F.coalesce("n", F.lit(0)).alias("n"))


def reliability(cont: DataFrame, by: list[str]) -> DataFrame:
    """Rows (bin, conf, acc, weight); the weight is a share of all rows, also of those in no bin."""
    hit = F.sum(F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0))
    g = cont.groupBy(*by, "bin").agg(F.sum("n").alias("_c"), F.sum("sc").alias("_s"), hit.alias("_h"))
    total = F.sum("_c").over(W.partitionBy(*(by or [F.lit(1)])))
    g = g.withColumn("_n", total).filter("bin >= 0")
    return g.select(*by, "bin", (F.col("_s") / F.col("_c")).alias("conf"), (F.col("_h") / F.col("_c")).alias("acc"),
                    (F.col("_c") / F.col("_n")).alias("weight"))


def ece(cont: DataFrame, by: list[str]) -> DataFrame:
    return reliability(cont, by).groupBy(*by).agg(
        F.sum(F.col("weight") * F.abs(F.col("acc") - F.col("conf"))).alias("ece"))


def evaluate(cont: DataFrame, by: list[str]) -> DataFrame:
    """acc, kappa, ece, mean confidence and n per group in one chain: every contingency row is dealt to its true class,
    its predicted class and its bin, and the group totals of those marginals give all metrics without a join."""
    n, zero, none = F.col("n"), F.lit(0).cast("bigint"), F.lit(0.0)
    hit = F.when(F.col("y") == F.col("yhat"), n).otherwise(zero)
    side = lambda kind, ident, r, k, h, s: F.struct(
        F.lit(kind).alias("kind"), ident.cast("bigint").alias("id"), r.alias("r"), k.alias("k"), h.alias("h"), s.alias("s"))
    sides = F.array(side(0, F.col("y"), n, zero, zero, none), side(0, F.col("yhat"), zero, n, zero, none),
                    side(1, F.col("bin"), zero, zero, hit, F.col("sc")))
    m = cont.select(*by, F.explode(sides).alias("e")).select(*by, "e.*")
    m = m.groupBy(*by, "kind", "id").agg(*[F.sum(c).alias(c) for c in ("r", "k", "h", "s")])
    binned = (F.col("kind") == 1) & (F.col("id") >= 0)
    g = m.groupBy(*by).agg(F.sum("r").alias("n"), F.sum("h").alias("_h"), F.sum("s").alias("_s"),
                           F.sum(F.col("r").cast("double") * F.col("k")).alias("_rk"),
                           F.sum(F.when(binned, F.abs(F.col("h") - F.col("s"))).otherwise(0.0)).alias("_gap"))
    po, pe = F.col("_h") / n, F.col("_rk") / (n.cast("double") * n)
    return g.select(*by, po.alias("acc"), safe_div(po - pe, 1 - pe).alias("kappa"), (F.col("_gap") / n).alias("ece"),
                    (F.col("_s") / n).alias("mean_conf"), "n")


def evaluate_folds(cont: DataFrame, fold: str = "fold") -> DataFrame:
    """Rows per fold, plus ``fold_mean`` (equal weight per fold) and ``pooled`` (equal weight per row)."""
    both = cont.withColumn(fold, F.explode(F.array(F.col(fold), F.lit("pooled"))))
    names = F.when(F.col(fold) == "pooled", F.array(fold)).otherwise(F.array(F.col(fold), F.lit("fold_mean")))
    per = evaluate(both, [fold]).withColumn(fold, F.explode(names))
    return per.groupBy(fold).agg(*[F.avg(c).alias(c) for c in ("acc", "kappa", "ece", "mean_conf")], F.sum("n").alias("n"))


def spread(rows: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or [])).agg(F.avg(key).alias("mean"), F.stddev_pop(key).alias("std"),
                                         F.min(key).alias("min"), F.max(key).alias("max"))


def worst_best_fold(rows: DataFrame, fold: str = "fold", key: str = "acc") -> DataFrame:
    by_fold = F.struct(key, fold)
    return rows.agg(F.min_by(fold, by_fold).alias("worst"), F.min(key).alias("worst_acc"),
                    F.max_by(fold, by_fold).alias("best"), F.max(key).alias("best_acc"))


def boundary_accuracy(conf: DataFrame, by: list[str]) -> DataFrame:
    """Three-class confusion: accuracy inside classes 1–2 and the leaks between class 0 and the rest, in percent."""
    s = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    y, p = F.col("y"), F.col("yhat")
    return conf.groupBy(*by).agg(
        safe_div(s((y > 0) & (y == p)), s((y > 0) & (p > 0))).alias("load_acc"),
        safe_div(100.0 * s((y == 0) & (p > 0)), s(y == 0)).alias("rest_to_load"),
        safe_div(100.0 * s((y > 0) & (p == 0)), s(y > 0)).alias("load_to_rest"))


# ---- temperature -----------------------------------------------------------------------------------------------

#: Scaled logits that a task holds at once.
LOSS_CELLS = 200_000


def _loss_sums(by: list[str], points: int):
    """Per batch and group: Σ −log softmax(z/T)[y] for every point of the group's grid."""
    grid = np.arange(points) / (points - 1)

    def losses(z, y, lo, hi):
        t = np.exp(lo[:, None] + (hi - lo)[:, None] * grid)
        top = np.log(np.exp(z[:, None, :] / t[:, :, None]).sum(axis=-1))
        return top - z[np.arange(len(y)), y][:, None] / t

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            z, y = np.stack(pdf["_z"]), pdf["_y"].to_numpy()
            lo, hi = pdf["_lo"].to_numpy(), pdf["_hi"].to_numpy()
            step = max(1, LOSS_CELLS // (points * z.shape[1]))
            loss = np.concatenate([losses(z[i:i + step], y[i:i + step], lo[i:i + step], hi[i:i + step])
                                   for i in range(0, len(y), step)])
            part = pd.DataFrame(loss).groupby([pdf[c].to_numpy() for c in [*by, "_lo", "_hi"]])
            sums = part.sum()
            keys = sums.index.to_frame(index=False)
            keys.columns = [*by, "_lo", "_hi"]
            yield keys.assign(_s=list(sums.to_numpy()), _c=part.size().to_numpy())

    return run


def temperature_fit(df: DataFrame, by: list[str], logits: str, y: str = "y", lo: float = 0.05, hi: float = 20.0,
                    points: int = 32, rounds: int = 3) -> DataFrame:
    """T minimizing the mean loss of every group at once: a log grid, then the bracket of its best point. A round sums
    the losses of the whole grid inside the Arrow batches and adds the partial sums per group; few groups are shipped to the rows."""
    d = df.select(*by, F.col(y).cast("int").alias("_y"),
                  let(F.array_max(logits), lambda m: F.transform(logits, lambda v: v - m)).alias("_z"))
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.select(*by).schema)
    schema = f"{keys}, _lo double, _hi double, _s array<double>, _c bigint"
    groups = d.select(*by).distinct()
    place = F.broadcast if few_rows(groups) else (lambda side: side)
    bracket = groups.withColumns({"_lo": F.lit(float(np.log(lo))), "_hi": F.lit(float(np.log(hi)))})
    for _ in range(rounds):
        part = d.join(place(bracket), by).mapInPandas(_loss_sums(by, points), schema)
        means = [F.sum(F.col("_s")[k]) / F.sum("_c") for k in range(points)]
        g = part.groupBy(*by, "_lo", "_hi").agg(F.array(*means).alias("_m"))
        best = F.array_position("_m", F.array_min("_m")) - 1
        step = (F.col("_hi") - F.col("_lo")) / (points - 1)
        g = g.withColumn("_at", F.col("_lo") + step * best).withColumn("_step", step)
        fit = g.select(*by, F.exp("_at").alias("temperature"), F.array_min("_m").alias("nll"))
        bracket = g.select(*by, (F.col("_at") - F.col("_step")).alias("_lo"), (F.col("_at") + F.col("_step")).alias("_hi"))
    return fit


def calibration_transfer(rows: DataFrame) -> DataFrame:
    """Mean temperature and errors over subjects; how much of the validation fix reaches the test session."""
    names = ["temperature", "val_ece_uncal", "val_ece_temp", "test_ece_uncal", "test_ece_temp"]
    m = rows.agg(*[F.avg(n).alias(n) for n in names], F.count(F.lit(1)).alias("n"))
    val, test = F.col("val_ece_uncal") - F.col("val_ece_temp"), F.col("test_ece_uncal") - F.col("test_ece_temp")
    m = m.withColumn("ratio", F.when(val > EPS, F.round(F.try_divide(test, val), 3)))
    verdict = (F.when(F.col("ratio").isNull(), "already calibrated").when(F.col("ratio") < TRANSFER_LIMITED, "limited")
               .when(F.col("ratio") < TRANSFER_GOOD, "partial").otherwise("transfers"))
    return m.withColumn("verdict", verdict)


# ---- run tables ------------------------------------------------------------------------------------------------

def mean_se(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    n = F.count(value)
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), (F.stddev_pop(value) / F.sqrt(n)).alias("se"), n.alias("n"))


def inflation_grid(rows: DataFrame, robust: str = "cross_single") -> DataFrame:
    """Mean accuracy per (cell, k) and its excess over the robust cell."""
    g = rows.groupBy("k", "cell").agg(F.avg("acc").alias("acc"))
    base = F.max(F.when(F.col("cell") == robust, F.col("acc"))).over(W.partitionBy("k"))
    return g.withColumn("inflation", F.col("acc") - base)


def check_invariants(runs: DataFrame, strict: bool = False) -> DataFrame:
    """Violated rules per run row; columns run, k, acc, point, lo, hi, chance, a, b, delta. An undefined number skips
    the rules it takes part in, but an undefined accuracy is itself a violation. The delta rule is for runs with a paired
    arm, those that have any of a, b and delta; there all three must be defined."""
    ok = lambda *cs: [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != F.lit(float("inf"))) for c in cs]

    def all_of(cs):
        out = F.lit(True)
        for c in cs:
            out = out & c
        return out

    acc, p = F.col("acc"), F.col("point")
    bounded = ~(all_of(ok("acc")) & (acc >= 0) & (acc <= 1))
    bracket = all_of(ok("point", "lo", "hi")) & ~((F.col("lo") <= p) & (p <= F.col("hi")))
    mean = all_of(ok("point", "acc")) & (F.abs(p - acc) > TOLERANCE)
    chance = (F.col("k") == 1) & all_of(ok("acc", "chance")) & (acc < F.col("chance"))
    paired = F.coalesce(F.col("delta"), F.col("a"), F.col("b")).isNotNull()
    delta = paired & ~(all_of(ok("delta", "a", "b")) & (F.abs(F.col("delta") - (F.col("b") - F.col("a"))) <= TOLERANCE))
    rules = [("bounded", bounded), ("bracket", bracket), ("ci_mean", mean), ("chance", chance), ("delta", delta)]
    named = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))
    out = runs.select("run", "k", F.explode(named).alias("rule"))
    if strict:
        out = out.withColumn("rule", F.raise_error(F.concat(F.lit("invariant violated: "), F.col("rule"))).cast("string"))
    return out


def prediction_report(pred: DataFrame, order: str, names: dict[int, str]) -> DataFrame:
    """First example of each class with its probabilities, next to the overall accuracy and chance."""
    name = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    first = pred.groupBy("y").agg(F.min_by(F.struct("yhat", "probs"), order).alias("e"), F.min(order).alias("example"))
    acc = pred.agg(F.round(F.avg((F.col("y") == F.col("yhat")).cast("int")), 3)).scalar()
    rounded = F.transform("e.probs", lambda v: F.round(v, 3))
    return first.select("example", name[F.col("y")].alias("truth"), name[F.col("e.yhat")].alias("pred"),
                        rounded.alias("probs"), (F.col("y") == F.col("e.yhat")).alias("correct"), acc.alias("acc"),
                        F.lit(round(1 / len(names), 3)).alias("chance"))


def importance_summary(trials: DataFrame, frac: float) -> DataFrame:
    """Mean weight per (study, family) over the max(1, int(frac·n)) best trials of each study."""
    per = trials.select("study", "trial", "value").distinct()
    rank = ordinal(per, ["study"], [F.desc("value"), F.asc("trial")], F.floor(-F.col("value") * 1024), "_pos", "_n")
    top = rank.filter(F.col("_pos") < F.greatest(F.lit(1), F.floor(F.col("_n") * frac))).select("study", "trial")
    return trials.join(top, ["study", "trial"], "left_semi").groupBy("study", "family").agg(
        F.avg("weight").alias("weight"))


def consensus(importance: DataFrame, topn: int) -> DataFrame:
    """Families by mean importance over the studies, with the mean Jaccard overlap of the studies' top sets. Studies and
    families are a few dozen, so the sets meet in one small row."""
    w = W.partitionBy("study").orderBy(F.desc("weight"), "family")
    top = importance.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= topn)
    sets = top.groupBy("study").agg(F.sort_array(F.collect_set("family")).alias("s"))
    one = sets.agg(F.sort_array(F.collect_list(F.struct("study", "s"))).alias("a"))
    jac = lambda x, y: F.size(F.array_intersect(x["s"], y["s"])) / F.size(F.array_union(x["s"], y["s"]))
    pairs = F.flatten(F.transform("a", lambda x, i: F.transform(F.slice("a", i + 2, F.size("a")), lambda y: jac(x, y))))
    overlap = one.select(F.coalesce(asum(pairs) / F.nullif(F.size(pairs), F.lit(0)), F.lit(1.0)).alias("j")).scalar()
    mean = importance.groupBy("family").agg(F.avg("weight").alias("weight"))
    order = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("weight"), "family"))
    return mean.select("family", "weight", order.alias("position"), overlap.alias("mean_jaccard"))


def effective_n(weights: Column, eps: float = 1e-9) -> Column:
    """exp of the entropy of the weights above eps."""
    return F.exp(-asum(F.transform(F.filter(weights, lambda w: w > eps), lambda w: w * F.log(w))))


def tradeoff_knee(points: DataFrame, by: list[str], order: str) -> DataFrame:
    """The point nearest to (best accuracy, least effective n) after min-max scaling."""
    lim = points.groupBy(*by).agg(F.min("acc").alias("_a0"), F.max("acc").alias("_a1"), F.min("eff_n").alias("_e0"),
                                  F.max("eff_n").alias("_e1"))
    j = points.join(lim, by)
    a = (F.col("acc") - F.col("_a0")) / (F.col("_a1") - F.col("_a0") + 1e-9)
    e = (F.col("eff_n") - F.col("_e0")) / (F.col("_e1") - F.col("_e0") + 1e-9)
    return j.groupBy(*by).agg(F.min_by(F.struct(order, "acc", "eff_n"), F.struct(F.hypot(1 - a, e), F.col(order))).alias("k")
                              ).select(*by, "k.*")


def cv_score(cont: DataFrame, by: list[str], seed: str = "seed", fold: str = "fold") -> DataFrame:
    per = evaluate(cont, [*by, seed, fold])
    return per.groupBy(*by).agg(F.avg("acc").alias("acc"), F.stddev_pop("acc").alias("acc_std"),
                                F.avg("kappa").alias("kappa"))


def arm_ablation(scores: DataFrame, first: str, arm: str = "arm", by: list[str] | None = None) -> DataFrame:
    """Score of every arm and its difference to the first arm."""
    base = F.max(F.when(F.col(arm) == first, F.col("acc"))).over(W.partitionBy(*(by or [F.lit(1)])))
    return scores.withColumn("delta", F.col("acc") - base)


def headroom(runs: DataFrame, by: list[str], flag: float = 0.02) -> DataFrame:
    """within − cross accuracy per group; below the flag there is no gap to close."""
    pick = lambda v: F.max(F.when(F.col("regime") == v, F.col("acc")))
    g = runs.groupBy(*by).agg(pick("within").alias("within"), pick("cross").alias("cross"))
    g = g.withColumn("headroom", F.col("within") - F.col("cross"))
    return g.withColumn("small", F.col("headroom") < flag)
