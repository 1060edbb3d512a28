"""Classifiers fitted from additive statistics.

A fold is a key on the rows that are *tested* in it; its training statistics are total − own, so one pass over the
features serves every fold. Features are ``f array<double>``, labels ``y`` = 0 … C−1, and every method returns
``(keep…, y, probs)``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.functions import kernels
from trialframe.functions.columns import dot, let, softmax, vector_sum
from trialframe.operators import align, foldwise
from trialframe.operators.align import map_cov


# ---- linear discriminant ---------------------------------------------------------------------------------------

def lda_statistics(df: DataFrame, keys: list[str], centre: np.ndarray, full: bool = True) -> DataFrame:
    """Per key: [n, Σx, Σxxᵀ, Σx²x²ᵀ, Σx²xᵀ] of x − centre, summed in the batches and then per key. ``full`` = False
    leaves out the two fourth-order blocks, which only automatic shrinkage needs."""
    schema = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in df.select(*keys).schema)

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack([np.asarray(v, dtype=float) for v in pdf["f"]]) - centre
            codes, uniques = pd.factorize(pd.MultiIndex.from_frame(pdf[keys]))
            rows = []
            for k in range(len(uniques)):
                a = x[codes == k]
                parts = [[len(a)], a.sum(axis=0), (a.T @ a).reshape(-1)]
                if full:
                    sq = a * a
                    parts += [(sq.T @ sq).reshape(-1), (sq.T @ a).reshape(-1)]
                rows.append(np.concatenate(parts))
            out = uniques.to_frame(index=False)
            out.columns = keys
            yield out.assign(_s=rows)

    part = df.select(*keys, "f").mapInPandas(run, f"{schema}, _s array<double>")
    return part.groupBy(*keys).agg(vector_sum("_s").alias("_s"))


def class_covariance(s: np.ndarray, d: int, shrinkage) -> tuple[float, np.ndarray, np.ndarray]:
    """(n, mean, shrunk covariance) of one class from its statistics."""
    n, x = s[0], s[1:1 + d]
    xx = s[1 + d:1 + d + d * d].reshape(d, d)
    m = x / n
    cov = xx / n - np.outer(m, m)
    if shrinkage != "auto":
        return n, m, (1 - shrinkage) * cov + shrinkage * np.trace(cov) / d * np.eye(d)
    q = s[1 + d + d * d:1 + d + 2 * d * d].reshape(d, d)
    r = s[1 + d + 2 * d * d:].reshape(d, d)
    m2, p = m * m, np.diag(xx)
    fourth = (q - 2 * r * m[None, :] - 2 * r.T * m[:, None] + np.outer(p, m2) + np.outer(m2, p)
              + 4 * np.outer(m, m) * xx - 2 * np.outer(x * m, m2) - 2 * np.outer(m2, x * m) + n * np.outer(m2, m2))
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    sd = np.where(sd > 1e-10, sd, 1.0)
    z = cov / np.outer(sd, sd)
    shrunk = kernels.shrink_lw(z, (fourth / np.outer(sd**2, sd**2)).sum(), n)
    return n, m, shrunk * np.outer(sd, sd)


def solve_lda(stats: dict[int, np.ndarray], d: int, shrinkage, standardize: bool = True, weights: np.ndarray | None = None):
    """Classes, coefficients [C, d] and offsets on the centred features, from per-class statistics. Features are scaled
    by the pooled deviation first (it matters for fixed shrinkage), then by optional weights."""
    classes = sorted(k for k, s in stats.items() if s[0] > 0)
    total = sum(stats[k][:1 + d + d * d] for k in classes)
    mean = total[1:1 + d] / total[0]
    sd = np.sqrt(np.maximum(np.diag(total[1 + d:].reshape(d, d)) / total[0] - mean**2, 0))
    scale = np.where(sd > 1e-10, sd, 1.0) if standardize else np.ones(d)
    g = (1.0 / scale) * (weights if weights is not None else 1.0)
    cov, means, priors = np.zeros((d, d)), [], []
    for k in classes:
        if shrinkage == "auto":
            n, m, c = class_covariance(stats[k], d, "auto")
            c = c * np.outer(g, g)
        else:
            n, m, c = class_covariance(stats[k], d, 0.0)
            c = c * np.outer(g, g)
            c = (1 - shrinkage) * c + shrinkage * np.trace(c) / d * np.eye(d)
        cov += n / total[0] * c
        means.append(m * g)
        priors.append(n / total[0])
    means = np.stack(means)
    coef = np.linalg.lstsq(cov, means.T, rcond=None)[0].T
    offset = -0.5 * np.einsum("kd,kd->k", means, coef) + np.log(priors)
    return classes, coef * g, offset


def feature_mean(df: DataFrame) -> np.ndarray:
    row = df.agg(vector_sum("f").alias("s"), F.count(F.lit(1)).alias("n")).head()
    if not row["n"]:
        raise ValueError("no rows to fit")
    return np.asarray(row["s"]) / row["n"]


def lda_models(df: DataFrame, fold: str, n_classes: int, shrinkage="auto", subset=None) -> DataFrame:
    """One model per fold (fold, w array<array>, b array): the folds are solved in the tasks, each from the totals minus
    its own sums. ``subset`` limits the rows that train."""
    centre = feature_mean(df)
    d = len(centre)
    rows = df if subset is None else df.filter(subset)
    stats = lda_statistics(rows, [fold, "y"], centre, shrinkage == "auto")
    totals = {r["y"]: np.asarray(r["_s"]) for r in stats.groupBy("y").agg(vector_sum("_s").alias("_s")).collect()}
    keys = df.select(fold).distinct()
    packed = stats.groupBy(fold).agg(F.collect_list(F.struct("y", "_s")).alias("own"))
    fold_type = df.schema[fold].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast((totals, centre))

    def run(batches):
        total, mu = shared.value
        for pdf in batches:
            rows = []
            for own in pdf["own"]:
                mine = {o["y"]: np.asarray(o["_s"]) for o in own} if own is not None else {}
                train = {k: t - mine.get(k, 0.0) for k, t in total.items()}
                train = {k: np.where(t[0] > 0.5, t, 0.0) for k, t in train.items()}
                w, b = np.zeros((n_classes, d)), np.full(n_classes, -1e30)
                if any(t[0] for t in train.values()):
                    classes, coef, offset = solve_lda(train, d, shrinkage)
                    w[classes], b[classes] = coef, offset - coef @ mu
                rows.append((list(w), b))
            yield pd.DataFrame({fold: pdf[fold], "w": [r[0] for r in rows], "b": [r[1] for r in rows]})

    return keys.join(packed, fold, "left").mapInPandas(run, f"`{fold}` {fold_type}, w array<array<double>>, b array<double>")


def linear_scores(df: DataFrame, models: DataFrame, fold: str) -> DataFrame:
    """Add ``scores`` = w·f + b of the row's fold."""
    j = df.join(models, fold)
    return j.withColumn("scores", F.zip_with("w", "b", lambda w, b: dot(w, "f") + b)).drop("w", "b")


def shrinkage_lda(df: DataFrame, fold: str, n_classes: int, shrinkage="auto", keep: list[str] | None = None) -> DataFrame:
    keep = keep or [c for c in df.columns if c != "f"]
    out = linear_scores(df, lda_models(df, fold, n_classes, shrinkage), fold)
    return out.select(*keep, softmax("scores").alias("probs"))


def weight_sweep(df: DataFrame, fold: str, families: list[str], trials: list[dict[str, float]], n_classes: int,
                 shrinkage: float = 0.4) -> DataFrame:
    """Mean fold accuracy of many family-weight vectors. A weight vector only rescales the statistics, so the features
    are summed once; all trials are solved per fold in the tasks and scored in one pass over the rows."""
    centre = feature_mean(df)
    d = len(centre)
    grid = np.array([[t.get(f, 1.0) for f in families] for t in trials])
    stats = lda_statistics(df, [fold, "y"], centre, False)
    totals = {r["y"]: np.asarray(r["_s"]) for r in stats.groupBy("y").agg(vector_sum("_s").alias("_s")).collect()}
    packed = stats.groupBy(fold).agg(F.collect_list(F.struct("y", "_s")).alias("own"))
    fold_type = df.schema[fold].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast((totals, centre, grid))

    def solve(batches):
        total, mu, weights = shared.value
        for pdf in batches:
            for k, own in zip(pdf[fold], pdf["own"]):
                mine = {o["y"]: np.asarray(o["_s"]) for o in own}
                train = {c: t - mine.get(c, 0.0) for c, t in total.items()}
                train = {c: np.where(t[0] > 0.5, t, 0.0) for c, t in train.items()}
                block = np.full((len(weights), n_classes, d + 1), 0.0)
                block[:, :, d] = -1e30
                for i, w in enumerate(weights):
                    classes, coef, offset = solve_lda(train, d, shrinkage, weights=w)
                    block[i, classes, :d], block[i, classes, d] = coef, offset - coef @ mu
                yield pd.DataFrame({fold: [k], "m": [block.reshape(-1)]})

    models = packed.mapInPandas(solve, f"`{fold}` {fold_type}, m array<double>")
    n = len(trials)

    def score(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            rows = []
            for k, part in pdf.groupby(fold):
                m = np.asarray(part["m"].iloc[0]).reshape(n, n_classes, d + 1)
                x = np.stack([np.asarray(v) for v in part["f"]])
                s = np.einsum("tcd,nd->ntc", m[:, :, :d], x) + m[None, :, :, d]
                hit = s.argmax(axis=2) == part["y"].to_numpy()[:, None]
                rows.append(pd.DataFrame({fold: k, "trial": np.arange(n), "hits": hit.sum(axis=0), "n": len(part)}))
            yield pd.concat(rows)

    hits = df.select(fold, "y", "f").join(models, fold).mapInPandas(
        score, f"`{fold}` {fold_type}, trial bigint, hits bigint, n bigint")
    per = hits.groupBy(fold, "trial").agg((F.sum("hits") / F.sum("n")).alias("acc"))
    return per.groupBy("trial").agg(F.avg("acc").alias("acc"))


# ---- covariance classifiers ------------------------------------------------------------------------------------

def tangent_lr(train: DataFrame, test: DataFrame, n_classes: int, keep: list[str], c: float = 1.0) -> DataFrame:
    """Multinomial logistic regression on tangent vectors ``f`` with an L2 penalty of strength 1/C."""
    cols = list(dict.fromkeys([*keep, "y", "f"]))
    both = tagged(train, test, cols)
    p = first_length(both, "f")
    return test_part(foldwise.logistic_folds(foldwise.chunked(both, 8 * p), "_test", n_classes, [*keep, "_test"], _given(p), p, c=c), keep)


def tagged(train: DataFrame, test: DataFrame, cols: list[str]) -> DataFrame:
    """Two frames as two folds: the model of fold 1 is fitted on the rows of fold 0."""
    return train.select(*cols, F.lit(0).alias("_test")).unionByName(test.select(*cols, F.lit(1).alias("_test")))


def test_part(out: DataFrame, keep: list[str]) -> DataFrame:
    return out.filter("_test = 1").select(*keep, "probs")


def first_length(df: DataFrame, name: str) -> int:
    row = df.select(F.size(name)).head()
    if row is None:
        raise ValueError("no rows to fit")
    return row[0]


def _given(p: int):
    return lambda table, ref: kernels.matrix(table.column("f").combine_chunks(), p)


def _tangent(d: int):
    """Features of matrices at the fold's reference, given as its inverse root."""
    def run(table, ref):
        return kernels.upper_vector(kernels.logm(kernels.congruence(ref.reshape(d, d), foldwise.matrices(table.column("cov"), d))))
    return run


def by_fold(df: DataFrame, fold: str, fit_predict) -> DataFrame:
    """Run a two-frame method for the (few) folds of a k-fold split and stack the test predictions."""
    out = None
    for row in df.select(fold).distinct().orderBy(fold).collect():
        test = F.col(fold) == row[0]
        p = fit_predict(df.filter(~test), df.filter(test))
        out = p if out is None else out.unionByName(p)
    return out


def distance_probs(df: DataFrame, keep: list[str]) -> DataFrame:
    """Softmax of the negative squared distances; a class without a mean has none and probability 0."""
    return df.select(*keep, let(F.transform("d2", lambda v: -v), lambda z: softmax(z)).alias("probs"))


def nearest_means(rows: foldwise.Chunks, means: DataFrame, fold: str, d: int, n_classes: int, keep: list[str], refs: DataFrame | None = None, project=None) -> DataFrame:
    """(keep…, probs) of every row by the class means of its own fold (fold, y, isqrt)."""
    packed = means.groupBy(fold).agg(F.collect_list("y").alias("classes"), F.flatten(F.collect_list("isqrt")).alias("roots"))
    state = packed.withColumn("ref", F.array().cast("array<double>")) if refs is None else packed.join(refs.select(fold, "ref"), fold)

    def distances(part, one):
        c = foldwise.matrices(part.column("cov"), d)
        if project is not None:
            c = project(c, np.asarray(one.column("s_ref")[0].as_py(), dtype=float))
        out = np.full((len(c), n_classes), 1e30)
        roots = np.asarray(one.column("s_roots")[0].as_py()).reshape(-1, d, d)
        for y, w in zip(one.column("s_classes")[0].as_py(), roots):
            lam = np.linalg.eigvalsh(kernels.congruence(w, c))
            out[:, int(y)] = (np.log(kernels.floor_eig(lam)) ** 2).sum(axis=1)
        return out

    state = align.checkpointed(state)
    return distance_probs(foldwise.own_rows(rows, state, fold, keep, "d2", distances, 8 * d * d * (n_classes + 2)), keep)


def mdm_folds(cov: DataFrame | foldwise.Chunks, fold: str, d: int, n_classes: int, keep: list[str]) -> DataFrame:
    """Nearest class mean for every fold of a k-fold split; probabilities are the softmax of the negative squared distances."""
    rows = foldwise.chunked(cov, 8 * d * d)
    return nearest_means(rows, align.train_means(rows, fold, d, "y"), fold, d, n_classes, keep)


def mdm(train: DataFrame, test: DataFrame, d: int, n_classes: int, keep: list[str]) -> DataFrame:
    return test_part(mdm_folds(tagged(train, test, list(dict.fromkeys([*keep, "y", "cov"]))), "_test", d, n_classes, [*keep, "_test"]), keep)


def discriminant_projection(rows: foldwise.Chunks, refs: DataFrame, fold: str, d: int) -> DataFrame:
    """(fold, ref): the fold's inverse root and root of the training mean, then the projector on the discriminant directions of the
    training rows' tangent vectors, one after another. Per fold and class only n, Σf and Σffᵀ leave the tasks."""
    p = d * (d + 1) // 2
    tangent = _tangent(d)
    groups = foldwise.per_class(refs.select(fold, "ref"), rows, "y")

    def sums(a, b):
        folds, y, ref = foldwise.values(a.column(fold)), foldwise.values(a.column("y")), b.column("s_ref").combine_chunks()
        for k, (f, label) in enumerate(zip(foldwise.values(b.column(f"s_{fold}")), foldwise.values(b.column("s_y")))):
            at = np.flatnonzero((folds != f) & (y == label))
            if len(at):
                x = tangent(a.take(at), np.asarray(ref[k].as_py()))
                yield k, np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])

    stats = foldwise.fold_sums(rows, align.checkpointed(groups), [fold, "y"], sums, 8 * d * d)
    packed = stats.groupBy(fold).agg(F.collect_list(F.struct("y", "_s")).alias("_own")).join(refs.select(fold, "ref"), fold)
    fields = f"{align._keys_schema(refs, [fold])}, ref array<double>"

    def solve(batches):
        for pdf in batches:
            out = []
            for own, ref in zip(pdf["_own"], pdf["ref"]):
                _, coef, _ = solve_lda({r["y"]: np.asarray(r["_s"]) for r in own}, p, 0.0, standardize=False)
                q = np.linalg.qr((coef - coef.mean(axis=0)).T)[0][:, :len(own) - 1]
                inv = np.asarray(ref).reshape(d, d)
                out.append(np.concatenate([inv.ravel(), np.linalg.inv(inv).ravel(), (q @ q.T).ravel()]))
            if out:
                yield pdf[[fold]].assign(ref=out)

    return align.checkpointed(packed.mapInPandas(solve, fields))


def projection(d: int):
    """Matrices to tangent vectors, onto the discriminant directions, and back."""
    def run(c, ref):
        inv, root, q = ref[:d * d].reshape(d, d), ref[d * d:2 * d * d].reshape(d, d), ref[2 * d * d:]
        v = kernels.upper_vector(kernels.logm(kernels.congruence(inv, c)))
        return kernels.congruence(root, kernels.expm(kernels.from_upper_vector(v @ q.reshape(v.shape[1], v.shape[1]), d)))
    return run


def train_refs(rows: foldwise.Chunks, fold: str, d: int) -> DataFrame:
    """(fold, ref): inverse root of every fold's training mean."""
    return align.checkpointed(align.train_means(rows, fold, d).select(fold, F.col("isqrt").alias("ref")))


def fgmdm_folds(cov: DataFrame | foldwise.Chunks, fold: str, d: int, n_classes: int, keep: list[str]) -> DataFrame:
    """Project tangent vectors on the discriminant directions, map back, then nearest class mean, all folds together."""
    rows = foldwise.chunked(cov, 8 * d * d)
    refs = discriminant_projection(rows, train_refs(rows, fold, d), fold, d)
    means = align.train_means(rows, fold, d, "y", refs=refs, project=projection(d))
    return nearest_means(rows, means, fold, d, n_classes, keep, refs, projection(d))


def fgmdm(train: DataFrame, test: DataFrame, d: int, n_classes: int, keep: list[str]) -> DataFrame:
    return test_part(fgmdm_folds(tagged(train, test, list(dict.fromkeys([*keep, "y", "cov"]))), "_test", d, n_classes, [*keep, "_test"]), keep)


def riemann_folds(cov: DataFrame | foldwise.Chunks, fold: str, d: int, n_classes: int, keep: list[str]) -> DataFrame:
    """Tangent vectors at the training mean, then logistic regression, all folds together."""
    rows = foldwise.chunked(cov, 8 * d * d)
    return foldwise.logistic_folds(rows, fold, n_classes, keep, _tangent(d), d * (d + 1) // 2, train_refs(rows, fold, d), ref_bytes=8 * d * d)


def riemann(train: DataFrame, test: DataFrame, d: int, n_classes: int, keep: list[str]) -> DataFrame:
    return test_part(riemann_folds(tagged(train, test, list(dict.fromkeys([*keep, "y", "cov"]))), "_test", d, n_classes, [*keep, "_test"]), keep)


def zero_shot_transfer(cov: DataFrame, subject: str, fold: str, d: int, n_classes: int, keep: list[str],
                       scale: bool = False) -> DataFrame:
    """Recentre every subject on its own mean (± dispersion), then tangent vectors at the identity and logistic
    regression, all folds together. The alignment does not depend on the fold and is done once."""
    al = align.recenter_covariances(cov, [subject], d)
    if scale:
        al = align.scale_dispersion(al, [subject], d)
    p = d * (d + 1) // 2
    return foldwise.logistic_folds(foldwise.chunked(align.tangent_features(al, d), 8 * p), fold, n_classes, keep, _given(p), p)


def calibrated_transfer(kind: str, source: DataFrame, calib: DataFrame, evaluation: DataFrame, d: int, n_classes: int,
                        keep: list[str], lam: float = 0.5) -> DataFrame:
    """``rpa``: centre, scale and rotate, then logistic regression; ``mdwm``: nearest blended class mean. Labels of the
    evaluation rows are not read."""
    if kind == "mdwm":
        means = align.weighted_class_means(source, calib, "y", d, lam).withColumn("_test", F.lit(1))
        means = map_cov(means, d, lambda m: kernels.powm(m, -0.5), cov="mean").withColumnRenamed("mean", "isqrt")
        rows = foldwise.chunked(evaluation.withColumn("_test", F.lit(1)), 8 * d * d)
        return test_part(nearest_means(rows, means, "_test", d, n_classes, [*keep, "_test"]), keep)
    if kind != "rpa":
        raise ValueError(f"unknown transfer {kind!r}")
    tag = lambda df, g: df.withColumn("_g", F.lit(g))
    src = align.scale_dispersion(align.recenter_covariances(tag(source, 0), ["_g"], d), ["_g"], d)
    unsup = tag(calib, 1)
    mean = align.checkpointed(align.riemannian_mean(unsup, ["_g"], d))
    c = align.recenter_covariances(unsup, ["_g"], d, mean)
    e = align.recenter_covariances(tag(evaluation, 1), ["_g"], d, mean)
    p = map_cov(c.select("cov"), d, lambda a: (np.log(kernels.floor_eig(np.linalg.eigvalsh(a))) ** 2).sum(axis=1),
                out="double").agg(F.sqrt(1.0 / F.avg("cov"))).head()[0]
    power = lambda df: map_cov(df, d, lambda a: kernels.powm(a, p))
    c, e = power(c), power(e)
    r = align.rotation(src, c, "y", d)
    turn = lambda df: map_cov(df, d, lambda a: r @ a @ r.T)
    cols = list(dict.fromkeys([*keep, "y", "cov"]))
    train = align.tangent_features(src.select(*cols).unionByName(turn(c).select(*cols)), d)
    return tangent_lr(train, align.tangent_features(turn(e), d), n_classes, keep)


# ---- spatial filters -------------------------------------------------------------------------------------------

def csp_filters(cov: DataFrame, d: int, k: int) -> np.ndarray:
    """k spatial filters [k, d] from class-mean covariances (one d × d problem per class): generalized eigenvectors of
    each class against the others, most discriminative first. Exact for two classes, one-vs-rest beyond."""
    g = cov.groupBy("y").agg(vector_sum("cov").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    return csp_from_means({r["y"]: np.asarray(r["s"]).reshape(d, d) / r["n"] for r in g}, k)


def csp_from_means(means: dict[int, np.ndarray], k: int) -> np.ndarray:
    classes = sorted(means)
    found = []
    for c in classes[:1] if len(classes) == 2 else classes:
        rest = sum(means[o] for o in classes if o != c) / max(len(classes) - 1, 1)
        white = kernels.powm(means[c] + rest, -0.5)
        lam, u = np.linalg.eigh(white @ means[c] @ white)
        found += [(abs(v - 0.5), (white @ u[:, i])) for i, v in enumerate(lam)]
    found.sort(key=lambda e: -e[0])
    w = np.stack([v for _, v in found[:k]])
    return w * np.sign(w[np.arange(len(w)), np.abs(w).argmax(axis=1)])[:, None]


def csp_features(cov: DataFrame, filters: np.ndarray, d: int) -> DataFrame:
    """ln(wᵀ C w) for every filter."""
    out = map_cov(cov, d, lambda c: np.log(np.maximum(np.einsum("ki,nij,kj->nk", filters, c, filters), 1e-300)))
    return out.withColumnRenamed("cov", "f")


def mutual_information_rank(long: DataFrame, bins: int = 16) -> DataFrame:
    """Mutual information of every feature with the class, from equal-width binned joint counts; rank 0 is the most
    informative. ``long(feature, y, f)``."""
    lim = long.groupBy("feature").agg(F.min("f").alias("_lo"), F.max("f").alias("_hi"))
    b = F.least(F.floor(F.try_divide((F.col("f") - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo"))), F.lit(bins - 1))
    joint = long.join(lim, "feature").groupBy("feature", F.coalesce(b, F.lit(0)).alias("b"), "y").agg(
        F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window as W
    w = lambda *c: F.sum("n").over(W.partitionBy("feature", *c))
    j = joint.withColumns({"_t": w(), "_b": w("b"), "_y": w("y")})
    p = F.col("n") / F.col("_t")
    mi = j.groupBy("feature").agg(F.sum(p * F.log(F.col("n") * F.col("_t") / (F.col("_b").cast("double") * F.col("_y")))).alias("mi"))
    order = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc(F.round("mi", 9)), "feature")) - 1
    return mi.withColumn("place", order)


def filter_bank_bands(fmin: float, fmax: float, width: float) -> list[tuple[float, float]]:
    """Bands of equal width from fmin; a remainder narrower than the width is dropped."""
    n = int((fmax - fmin) / width + 1e-6)  # a whole number of bands may come out just below itself
    return [(fmin + i * width, fmin + (i + 1) * width) for i in range(n)]


def filter_bank_csp(epochs: DataFrame, train, n_ch: int, fs: float, bands: list[tuple[float, float]], k: int,
                    k_features: int, keep: list[str], order: int = 4) -> DataFrame:
    """CSP per band on the train rows, features of all bands side by side, the k_features most informative kept. One pass gives the
    covariances of all bands; their class means are one small matrix per class and band."""
    from trialframe.operators import foldcsp
    n_b = len(bands)
    cov = align.checkpointed(foldcsp.band_covariances(epochs, keep, bands, fs, order))
    g = cov.filter(train).groupBy("y").agg(vector_sum("cov").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    means = {r["y"]: np.asarray(r["s"]).reshape(n_b, n_ch, n_ch) / r["n"] for r in g}
    w = np.stack([csp_from_means({y: m[b] for y, m in means.items()}, k) for b in range(n_b)])
    schema = f"{align._keys_schema(cov, keep)}, f array<double>"

    def features(batches):
        for pdf in batches:
            if len(pdf):
                stack = np.stack([np.asarray(c) for c in pdf["cov"]]).reshape(-1, n_b, n_ch, n_ch)
                yield pdf[keep].assign(f=list(foldcsp.log_variances(stack, w)))

    feats = align.checkpointed(cov.select(*keep, "cov").mapInPandas(features, schema))
    long = feats.filter(train).select("y", F.posexplode("f").alias("feature", "f"))
    chosen = [r["feature"] for r in mutual_information_rank(long).filter(F.col("place") < k_features).orderBy("place").collect()]
    return feats.withColumn("f", F.array(*[F.col("f")[i] for i in chosen]))


# ---- windows ---------------------------------------------------------------------------------------------------

def windowed_pool(win: DataFrame, key: list[str], mode: str) -> DataFrame:
    """Pool window rows per epoch: ``mean`` over ``probs``; ``max`` or ``lse`` over ``scores`` then softmax (at least
    three classes)."""
    if mode == "mean":
        e = win.select(*key, F.posexplode("probs").alias("cls", "p"))
        g = e.groupBy(*key, "cls").agg(F.avg("p").alias("p"))
        return g.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("cls", "p"))).alias("s")).select(
            *key, F.transform("s", lambda c: c["p"]).alias("probs"))
    if mode not in ("max", "lse"):
        raise ValueError(f"unknown pooling {mode!r}")
    few = F.raise_error(F.lit("score pooling needs at least three classes")).cast("array<double>")
    win = win.withColumn("scores", F.when(F.size("scores") >= 3, F.col("scores")).otherwise(few))
    e = win.select(*key, F.posexplode("scores").alias("cls", "s"))
    top = e.groupBy(*key, "cls").agg(F.max("s").alias("m"))
    if mode == "lse":
        sums = e.join(top, [*key, "cls"]).groupBy(*key, "cls", "m").agg(F.sum(F.exp(F.col("s") - F.col("m"))).alias("z"))
        top = sums.select(*key, "cls", (F.col("m") + F.log("z")).alias("m"))
    g = top.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("cls", "m"))).alias("s"))
    return g.withColumn("scores", F.transform("s", lambda c: c["m"])).select(*key, softmax("scores").alias("probs"))


def window_concat(win: DataFrame, key: list[str]) -> DataFrame:
    """One long vector per epoch: its windows' features in window order."""
    g = win.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("win", "f"))).alias("s"))
    return g.select(*key, F.flatten(F.transform("s", lambda c: c["f"])).alias("f"))
