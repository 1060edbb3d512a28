"""Spatial filters and a discriminant on their log-variances, for all folds and bands in shared passes.

Rows carry the covariances of all bands in one vector. Filters come from class means (total − own), so one shuffle of sums per fold and
class gives those of every fold. Features depend on the fold's filters; they are computed where the rows lie, and only sums per
fold and class leave the tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.functions import kernels
from trialframe.functions.columns import vector_sum
from trialframe.operators import classify as C
from trialframe.operators import foldwise
from trialframe.operators.epoching import map_vectors
from trialframe.session import checkpointed

#: Equal-width bins of a feature for its mutual information with the class.
BINS = 16


def cross_spectral_cov(x: np.ndarray, gains: np.ndarray) -> np.ndarray:
    """(n, bands, ch, ch): uncentred covariances of band-passed epochs (n, ch, t) from one transform, by Parseval's theorem."""
    t = x.shape[-1]
    both_sides = np.full(t // 2 + 1, 2.0)
    both_sides[0] = 1.0
    if t % 2 == 0:
        both_sides[-1] = 1.0
    z = np.fft.rfft(x, axis=-1)
    out = np.empty((len(x), len(gains), x.shape[1], x.shape[1]))
    for k, g in enumerate(gains):
        w = z * (g * np.sqrt(both_sides))
        out[:, k] = (np.einsum("nik,njk->nij", w.real, w.real) + np.einsum("nik,njk->nij", w.imag, w.imag)) / (t * t)
    return out


def band_covariances(df: DataFrame, keep: list[str], bands: list[tuple[float, float]], fs: float, order: int = 4, x: str = "x") -> DataFrame:
    """keep and ``cov``: the covariances of all bands, one after another."""
    def run(s: np.ndarray) -> np.ndarray:
        gains = np.stack([kernels.butter_band_gain(s.shape[-1], lo, hi, fs, order) for lo, hi in bands])
        return cross_spectral_cov(s, gains).reshape(len(s), -1)

    return map_vectors(df, keep, run, "cov", x)


def log_variances(cov: np.ndarray, w: np.ndarray) -> np.ndarray:
    """(n, bands · filters) of covariances (n, bands, ch, ch) under filters (bands, filters, ch)."""
    v = np.einsum("bki,nbij,bkj->nbk", w, cov, w, optimize=True)
    return np.log(np.maximum(v, 1e-300)).reshape(len(cov), -1)


def _stack(column: pa.ChunkedArray, bands: int, d: int) -> np.ndarray:
    return kernels.matrix(column.combine_chunks(), bands * d * d).reshape(-1, bands, d, d)


def fold_filters(rows: foldwise.Chunks, fold: str, bands: int, d: int, k: int) -> DataFrame:
    """(fold, w, mu): the filters of every fold's training rows and the log-variances of their mean, from sums per fold and class."""
    own = checkpointed(rows.df.groupBy(fold, "y").agg(vector_sum("cov").alias("_s"), F.count(F.lit(1)).cast("double").alias("_n")))
    total = own.groupBy("y").agg(vector_sum("_s").alias("_all"), F.sum("_n").alias("_rows"))
    grid = foldwise.per_class(own.select(fold).distinct(), rows, "y")
    sums = grid.join(total, "y").join(own, [fold, "y"], "left").select(fold, "y", "_all", "_rows", "_s", "_n")
    kind = rows.df.schema[fold].dataType.simpleString()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        left, counts = {}, {}
        for y, big, many, small, few in zip(pdf["y"], pdf["_all"], pdf["_rows"], pdf["_s"], pdf["_n"]):
            n = many - (0.0 if few is None or np.isnan(few) else few)
            if n > 0.5:
                left[y] = np.asarray(big) - (0.0 if small is None else np.asarray(small))
                counts[y] = n
        if not left:
            return pd.DataFrame({fold: [], "w": [], "mu": []})
        means = {y: (s / counts[y]).reshape(bands, d, d) for y, s in left.items()}
        w = np.stack([C.csp_from_means({y: m[b] for y, m in means.items()}, k) for b in range(bands)])
        overall = (sum(left.values()) / sum(counts.values())).reshape(1, bands, d, d)
        return pd.DataFrame({fold: [pdf[fold].iloc[0]], "w": [w.ravel()], "mu": [log_variances(overall, w)[0]]})

    return checkpointed(sums.groupBy(fold).applyInPandas(solve, f"`{fold}` {kind}, w array<double>, mu array<double>"))


def _training(a: pa.Table, b: pa.Table, fold: str, bands: int, d: int):
    """(number of the state, features of the chunk's rows that train it), one state at a time."""
    cov, folds = _stack(a.column("cov"), bands, d), foldwise.values(a.column(fold))
    y = foldwise.values(a.column("y"))
    w = b.column("s_w").combine_chunks()
    labels = foldwise.values(b.column("s_y")) if "s_y" in b.column_names else [None] * b.num_rows
    for k, (f, label) in enumerate(zip(foldwise.values(b.column(f"s_{fold}")), labels)):
        at = np.flatnonzero((folds != f) & ((y == label) if label is not None else True))
        if len(at):
            yield k, log_variances(cov[at], np.asarray(w[k].as_py()).reshape(bands, -1, d))


def chosen_features(rows: foldwise.Chunks, filters: DataFrame, fold: str, bands: int, d: int, k_features: int, state_bytes: int) -> DataFrame:
    """``filters`` with ``pick``, the features that tell most about the class on the fold's training rows, the best first."""
    kind = rows.df.schema[fold].dataType.simpleString()
    key, fields = foldwise.arrow_schema(filters, [fold])
    schema = pa.schema([*key, ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))])

    def limits(a: pa.Table, b: pa.Table) -> pa.Table | None:
        found = [(k, f.min(axis=0), f.max(axis=0)) for k, f in _training(a, b, fold, bands, d)]
        if not found:
            return None
        at, lo, hi = zip(*found)
        return pa.table([b.column(f"s_{fold}").take(pa.array(at)), kernels.to_list(list(lo)), kernels.to_list(list(hi))], names=schema.names)

    part = foldwise.meet(rows, filters, limits, schema, f"{fields}, lo array<double>, hi array<double>", state_bytes)
    each = part.select(fold, F.posexplode(F.arrays_zip("lo", "hi")).alias("p", "l")).groupBy(fold, "p").agg(F.min("l.lo").alias("lo"), F.max("l.hi").alias("hi"))
    span = each.groupBy(fold).agg(F.sort_array(F.collect_list(F.struct("p", "lo", "hi"))).alias("l"))
    span = span.select(fold, F.transform("l", lambda e: e["lo"]).alias("lo"), F.transform("l", lambda e: e["hi"]).alias("hi"))
    state = checkpointed(foldwise.per_class(filters.join(span, fold), rows, "y"))

    def counts(a: pa.Table, b: pa.Table):
        lows, highs = b.column("s_lo").combine_chunks(), b.column("s_hi").combine_chunks()
        for k, f in _training(a, b, fold, bands, d):
            lo, hi = np.asarray(lows[k].as_py()), np.asarray(highs[k].as_py())
            with np.errstate(all="ignore"):
                at = np.where(hi > lo, np.minimum(np.floor((f - lo) * BINS / (hi - lo)), BINS - 1), 0).astype(int)
            yield k, np.bincount((at + BINS * np.arange(f.shape[1])).ravel(), minlength=BINS * f.shape[1]).astype(float)

    joint = foldwise.fold_sums(rows, state, [fold, "y"], counts, state_bytes)

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.stack([np.asarray(s) for s in pdf["_s"]]).reshape(len(pdf), -1, BINS)        # class, feature, bin
        total = n[:, 0].sum()
        with np.errstate(all="ignore"):
            terms = n / total * np.log(n * total / (n.sum(axis=0) * n.sum(axis=2, keepdims=True)))
        told = np.round(np.where(n > 0, terms, 0.0).sum(axis=(0, 2)), 9)
        return pd.DataFrame({fold: [pdf[fold].iloc[0]], "pick": [np.argsort(-told, kind="stable")[:k_features].astype(float)]})

    picks = joint.groupBy(fold).applyInPandas(rank, f"`{fold}` {kind}, pick array<double>")
    return checkpointed(filters.join(picks, fold))


def csp_lda_folds(cov: DataFrame | foldwise.Chunks, fold: str, bands: int, d: int, n_filters: int, n_classes: int, keep: list[str], k_features: int | None = None) -> DataFrame:
    """(keep…, probs) of every fold's own rows: filters per band, the ``k_features`` most informative log-variances (all if None), and a
    discriminant with automatic shrinkage, each fitted on the rows of all other folds. The number of jobs depends on neither folds nor bands."""
    some = F.col("cov").isNotNull()
    rows = foldwise.Chunks(cov.df.filter(some), cov.pieces) if isinstance(cov, foldwise.Chunks) else foldwise.chunked(cov.filter(some), 8 * bands * d * d)
    width = bands * min(n_filters, d * n_classes)
    state_bytes = 8 * (width * (d + 4 + n_classes))
    filters = fold_filters(rows, fold, bands, d, n_filters)
    if k_features is None:
        filters = filters.withColumn("pick", F.transform(F.sequence(F.lit(0), F.size("mu") - 1), lambda i: i.cast("double")))
    else:
        filters = chosen_features(rows, filters, fold, bands, d, k_features, state_bytes + 8 * 2 * width)
    kind = rows.df.schema[fold].dataType.simpleString()

    def moments(a: pa.Table, b: pa.Table):
        mu, pick = b.column("s_mu").combine_chunks(), b.column("s_pick").combine_chunks()
        for k, f in _training(a, b, fold, bands, d):
            use = np.asarray(pick[k].as_py(), dtype=int)
            x = f[:, use] - np.asarray(mu[k].as_py())[use]
            sq = x * x
            yield k, np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel(), (sq.T @ sq).ravel(), (sq.T @ x).ravel()])

    grid = checkpointed(foldwise.per_class(filters, rows, "y"))
    stats = foldwise.fold_sums(rows, grid, [fold, "y"], moments, state_bytes)
    packed = stats.groupBy(fold).agg(F.collect_list(F.struct("y", "_s")).alias("_own")).join(filters, fold)

    def solve(batches):
        for pdf in batches:
            coefs, offsets = [], []
            for own, mu, pick in zip(pdf["_own"], pdf["mu"], pdf["pick"]):
                use = np.asarray(pick, dtype=int)
                classes, coef, offset = C.solve_lda({r["y"]: np.asarray(r["_s"]) for r in own}, len(use), "auto")
                w, b = np.zeros((n_classes, len(use))), np.full(n_classes, -1e30)
                w[classes], b[classes] = coef, offset - coef @ np.asarray(mu)[use]
                coefs.append(w.ravel())
                offsets.append(b)
            if coefs:
                yield pdf[[fold, "w", "pick"]].assign(coef=coefs, b=offsets)

    models = checkpointed(packed.select(fold, "w", "pick", "mu", "_own").mapInPandas(
        solve, f"`{fold}` {kind}, w array<double>, pick array<double>, coef array<double>, b array<double>"))

    def score(part: pa.Table, model: pa.Table) -> np.ndarray:
        w, pick, coef, b = (np.asarray(model.column(f"s_{c}")[0].as_py()) for c in ("w", "pick", "coef", "b"))
        f = log_variances(_stack(part.column("cov"), bands, d), w.reshape(bands, -1, d))[:, pick.astype(int)]
        return foldwise.softmax_rows(f @ coef.reshape(n_classes, -1).T + b)

    return foldwise.own_rows(rows, models, fold, keep, "probs", score, state_bytes)
