"""Alignment of covariance matrices and signals across subjects.

Covariances are rows ``(keys…, cov array<double>)`` in row-major order. Group means stay a DataFrame with one small row
per group; every round of a mean reduces the logs of whole batches to one partial sum per group before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.functions import kernels
from trialframe.functions.columns import vector_sum
from trialframe.operators import foldwise
from trialframe.operators.ordinal import ordinal
from trialframe.session import checkpointed


def _keys_schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)


def _square(column, d: int) -> np.ndarray:
    return np.stack([np.asarray(a, dtype=float) for a in column]).reshape(-1, d, d)


def map_cov(df: DataFrame, d: int, fn, cov: str = "cov", extra: list[str] | None = None, drop: bool = True,
            out: str = "array<double>") -> DataFrame:
    """Replace ``cov`` by fn(stack, *extra stacks) row by row in batches; extra columns are matrices too."""
    extra = extra or []
    kept = [c for c in df.columns if not (drop and c in extra)]
    schema = ", ".join(f"`{c}` {out if c == cov else df.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            res = fn(_square(pdf[cov], d), *[_square(pdf[e], d) for e in extra])
            yield pdf[kept].assign(**{cov: list(res.reshape(len(pdf), -1)) if out.startswith("array") else res})

    return df.mapInPandas(run, schema)


def _partial_logs(by: list[str], d: int, with_mean: bool):
    """Per batch and group: [n, Σ log(W C W)] with W the inverse root of the group's current mean."""

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            c = _square(pdf["cov"], d)
            if with_mean:
                c = kernels.congruence(_square(pdf["isqrt"], d), c)
            logs = kernels.logm(c).reshape(len(pdf), -1)
            part = pd.DataFrame(np.column_stack([np.ones(len(pdf)), logs])).groupby([pdf[b].to_numpy() for b in by]).sum()
            keys = part.index.to_frame(index=False)
            keys.columns = by
            yield keys.assign(_s=list(part.to_numpy()))

    return run


#: Means of at most so many bytes together are sent to every task; more are joined by key.
MEANS_BYTES = 32 << 20


def start_state(logs: np.ndarray, d: int) -> dict[str, list]:
    """State of a mean before its first round, from [n, Σ log C]: whitening by the log-Euclidean mean."""
    w = kernels.powm(kernels.expm((logs[:, 1:] / logs[:, :1]).reshape(-1, d, d)), -0.5)
    n = len(logs)
    return {"w": list(w.reshape(n, -1)), "tangent": [np.zeros(d * d)] * n, "step": np.zeros(n), "norm": np.full(n, np.inf), "least": np.full(n, np.inf),
            "stale": np.zeros(n, np.int32), "open": np.ones(n, bool)}


def next_state(sums: np.ndarray, pdf: pd.DataFrame, d: int, tol: float) -> dict[str, list]:
    """One round of every mean of ``pdf``. ``w`` whitens by the current mean; it moves with the mean along the geodesic, so the tangents of
    two rounds share their coordinates, and their change gives the curvature and with it the next step. A step is halved
    where the gradient grew. A mean is done below ``tol``, or when rounding keeps it from getting lower."""
    g = (sums[:, 1:] / sums[:, :1]).reshape(-1, d, d)
    norm = np.sqrt((g * g).sum(axis=(1, 2)))
    before, last, was = _square(pdf["tangent"], d), pdf["step"].to_numpy(), pdf["norm"].to_numpy()
    change = before - g
    curved = (change * change).sum(axis=(1, 2))
    along = last * (before * change).sum(axis=(1, 2))
    step = np.where((last > 0) & (curved > 0), along / np.where(curved > 0, curved, 1.0), 1.0)
    step = np.clip(step, 0.05, 1.0)  # curvature is at least 1
    step = np.where(norm > was, np.minimum(step, np.maximum(last, 0.1) / 2), step)
    w = kernels.expm(-step[:, None, None] / 2 * g) @ _square(pdf["w"], d)
    lower = norm < 0.5 * pdf["least"].to_numpy()
    stale = np.where(lower, 0, pdf["stale"].to_numpy() + 1)
    return {"w": list(w.reshape(len(w), -1)), "tangent": list(g.reshape(len(w), -1)), "step": step, "norm": norm, "least": np.where(lower, norm, pdf["least"]),
            "stale": stale.astype(np.int32), "open": (norm >= tol) & ~((norm < 1e-6) & (stale > 12))}


STATE = "w array<double>, tangent array<double>, step double, norm double, least double, stale int, open boolean"


def finished(state: DataFrame, by: list[str], d: int) -> DataFrame:
    """(by…, mean, isqrt, norm) of the states; ``norm`` is the length of the last gradient."""
    def run(batches):
        for pdf in batches:
            if len(pdf):
                back = np.linalg.inv(_square(pdf["w"], d))
                m = back @ np.swapaxes(back, -1, -2)
                m = (m + np.swapaxes(m, -1, -2)) / 2
                yield pdf[by].assign(mean=list(m.reshape(len(m), -1)), isqrt=list(kernels.powm(m, -0.5).reshape(len(m), -1)), norm=pdf["norm"])

    return state.mapInPandas(run, f"{_keys_schema(state, by)}, mean array<double>, isqrt array<double>, norm double")


def _rounds(sums, keys: list[str], key_fields: str, d: int, tol: float, max_rounds: int) -> DataFrame:
    """Runs ``sums(open states or None)`` → (keys…, _s) until no state is open. Only open groups take part in a round."""
    def step(fn):
        def run(batches):
            for pdf in batches:
                if len(pdf):
                    yield pdf[keys].assign(**fn(np.stack([np.asarray(a) for a in pdf["_s"]]), pdf))
        return run

    schema = f"{key_fields}, {STATE}"
    state = checkpointed(sums(None).mapInPandas(step(lambda s, pdf: start_state(s, d)), schema))
    for _ in range(max_rounds):
        live = state.filter("open")
        if live.isEmpty():
            break
        moved = live.join(sums(live), keys).mapInPandas(step(lambda s, pdf: next_state(s, pdf, d, tol)), schema)
        state = checkpointed(state.filter("not open").unionByName(moved))
    return finished(state, keys, d)


def riemannian_mean(cov: DataFrame, by: list[str], d: int, tol: float = 1e-9, max_rounds: int = 200) -> DataFrame:
    """Fréchet mean per group: (by…, mean, isqrt, norm). Starts at the log-Euclidean mean; a round moves every open group along its
    mean tangent vector by a step of its own. Groups are never gathered: only sums of d² numbers leave the tasks. A group that
    has not settled after ``max_rounds`` returns as it is, with the length of its last gradient in ``norm``."""
    data = checkpointed(cov.select(*by, "cov"))

    def sums(live):
        rows = data
        if live is not None:
            w = live.select(*by, F.col("w").alias("isqrt"))
            rows = data.join(F.broadcast(w) if live.count() * d * d * 8 <= MEANS_BYTES else w, by)
        part = rows.mapInPandas(_partial_logs(by, d, live is not None), f"{_keys_schema(cov, by)}, _s array<double>")
        return part.groupBy(*by).agg(vector_sum("_s").alias("_s"))

    return _rounds(sums, by, _keys_schema(cov, by), d, tol, max_rounds)


def train_means(rows: foldwise.Chunks, fold: str, d: int, label: str | None = None, tol: float = 1e-9, max_rounds: int = 200,
                refs: DataFrame | None = None, project=None) -> DataFrame:
    """Means over the training rows (all other folds) of every fold, optionally per class: (fold, [label], mean, isqrt, norm).

    ``project(matrices, ref)`` maps a fold's rows first, with the fold's ``ref`` of ``refs`` (fold, ref)."""
    keys = [fold, *([label] if label else [])]
    groups = rows.df.select(fold).distinct()
    if label:
        groups = foldwise.per_class(groups, rows, label)
    groups = groups.withColumn("ref", F.array().cast("array<double>")) if refs is None else groups.join(refs.select(fold, "ref"), fold)
    groups = checkpointed(groups.select(*keys, "ref"))

    def logs(a, b):
        c, folds = foldwise.matrices(a.column("cov"), d), foldwise.values(a.column(fold))
        of = foldwise.values(a.column(label)) if label else None
        ref = b.column("s_ref").combine_chunks()
        for k, f in enumerate(foldwise.values(b.column(f"s_{fold}"))):
            at = folds != f
            if label:
                at &= of == b.column(f"s_{label}")[k].as_py()
            if at.any():
                x = c[at] if project is None else project(c[at], np.asarray(ref[k].as_py(), dtype=float))
                if "s_w" in b.column_names:
                    x = kernels.congruence(np.asarray(b.column("s_w")[k].as_py()).reshape(d, d), x)
                yield k, np.concatenate([[len(x)], kernels.logm(x).sum(axis=0).ravel()])

    def sums(live):
        state = groups if live is None else live.select(*keys, "w").join(groups, keys)
        return foldwise.fold_sums(rows, state, keys, logs, 8 * d * d * (2 if refs is None else 4))

    return _rounds(sums, keys, _keys_schema(rows.df, keys), d, tol, max_rounds)


def recenter_covariances(cov: DataFrame, by: list[str], d: int, means: DataFrame | None = None) -> DataFrame:
    """C → M^{-1/2} C M^{-1/2} with the group's own mean (every target subject too)."""
    means = means if means is not None else riemannian_mean(cov, by, d)
    j = cov.join(means.select(*by, "isqrt"), by)
    return map_cov(j, d, lambda c, w: kernels.congruence(w, c), extra=["isqrt"])


def scale_dispersion(cov: DataFrame, by: list[str], d: int) -> DataFrame:
    """C → C^p with p = √(1 / mean d²(C, I)) per group."""
    d2 = map_cov(cov.select(*by, "cov"), d, lambda c: (np.log(kernels.floor_eig(np.linalg.eigvalsh(c))) ** 2).sum(axis=1),
                 out="double").groupBy(*by).agg(F.sqrt(1.0 / F.avg("cov")).alias("_p"))
    j = cov.join(d2, by)
    kept = cov.columns
    schema = ", ".join(f"`{c}` {cov.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                w, u = np.linalg.eigh(_square(pdf["cov"], d))
                w = kernels.floor_eig(w) ** pdf["_p"].to_numpy()[:, None]
                out = np.einsum("nij,nj,nkj->nik", u, w, u)
                yield pdf[kept].assign(cov=list(out.reshape(len(pdf), -1)))

    return j.select(*kept, "_p").mapInPandas(run, schema)


def tangent_features(cov: DataFrame, d: int, means: DataFrame | None = None, by: list[str] | None = None,
                     name: str = "f") -> DataFrame:
    """Upper triangle of log(C) (off-diagonal × √2), after whitening by the group's mean when one is given."""
    if means is not None:
        cov = cov.join(means.select(*by, "isqrt"), by)
        out = map_cov(cov, d, lambda c, w: kernels.upper_vector(kernels.logm(kernels.congruence(w, c))), extra=["isqrt"])
    else:
        out = map_cov(cov, d, lambda c: kernels.upper_vector(kernels.logm(c)))
    return out.withColumnRenamed("cov", name)


def whiten_signals(df: DataFrame, weights: DataFrame, by: list[str], w: str = "isqrt", x: str = "x",
                   strict: bool = True) -> DataFrame:
    """X → W X with the group's matrix; a group without one raises."""
    j = df.join(weights.select(*by, F.col(w).alias("_w")), by, "left")
    if strict:
        unfitted = F.raise_error(F.concat(F.lit("no whitener for "), F.concat_ws("/", *by))).cast("array<double>")
        j = j.withColumn("_w", F.coalesce(F.col("_w"), unfitted))
    kept = df.columns
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            out = []
            for row, m in zip(pdf[x], pdf["_w"]):
                sig = np.stack([np.asarray(ch, dtype=float) for ch in row])
                out.append(list(np.asarray(m).reshape(len(sig), len(sig)) @ sig))
            yield pdf[kept].assign(**{x: out})

    return j.select(*kept, "_w").mapInPandas(run, schema)


def strided_sample(df: DataFrame, keys: list[str], order: list[str], bucket: Column, m: int) -> DataFrame:
    """Rows linspace(0, n−1, m).astype(int) of every group; all rows when n ≤ m, the first one for m = 1."""
    d = ordinal(df, keys, order, bucket, "_pos", "_n")
    if m == 1:
        return d.filter("_pos = 0").drop("_pos", "_n")
    last, n1 = m - 1, F.col("_n") - 1
    k = F.ceil(F.col("_pos") * last / F.greatest(n1, F.lit(1)))
    hit = F.floor(k * n1 / F.lit(last)) == F.col("_pos")
    return d.filter((F.col("_n") <= m) | hit).drop("_pos", "_n")


def recenter_signals(df: DataFrame, by: list[str], order: list[str], bucket: Column, n_ch: int, max_ref: int | None = None,
                     shrinkage: float = 0.0) -> DataFrame:
    """X → M^{-1/2} X, M the mean covariance of all the subject's trials, or of ``max_ref`` evenly strided ones where a
    caller asks for that, optionally pulled towards its scaled identity."""
    from trialframe.operators.spatial import trial_covariance
    ref = trial_covariance(df if max_ref is None else strided_sample(df, by, order, bucket, max_ref), by)
    means = riemannian_mean(ref, by, n_ch).select(*by, "mean")

    def shrink(m):
        mu = np.trace(m, axis1=1, axis2=2) / n_ch
        m = (1 - shrinkage) * m + shrinkage * mu[:, None, None] * np.eye(n_ch)
        return kernels.powm(m, -0.5)

    return whiten_signals(df, map_cov(means, n_ch, shrink, cov="mean"), by, "mean")


# ---- noise whitening -------------------------------------------------------------------------------------------

def condition_residual(cells: DataFrame, subject: str, condition: str) -> DataFrame:
    """trial − its condition mean per (subject, condition, ch, i)."""
    by = [subject, condition, "ch", "i"]
    m = cells.groupBy(*by).agg(F.avg("x").alias("_m"))
    return cells.join(m, by).withColumn("x", F.col("x") - F.col("_m")).drop("_m")


def noise_whitener(epochs: DataFrame, by: list[str], condition: str, n_ch: int, x: str = "x", no_noise: float = 1e6) -> DataFrame:
    """Σ^{-1/2} per subject from within-condition residuals, Ledoit-Wolf shrunk, over all rows: the batches add
    Σ r, Σ rrᵀ and Σ‖r‖⁴ and only these sums are shuffled. A subject whose residuals are all 0, as with one row per condition,
    has the diagonal ``no_noise``; infinity says so, the finite default keeps signals finite. Returns (by…, isqrt)."""
    means = epochs.groupBy(*by, condition).agg(vector_sum(F.flatten(x)).alias("_s"), F.count(F.lit(1)).alias("_n"))
    means = means.select(*by, condition, F.transform("_s", lambda v: v / F.col("_n")).alias("_m"))
    j = epochs.select(*by, condition, F.flatten(x).alias("_x")).join(means, [*by, condition])
    keys = _keys_schema(epochs, by)

    def partial(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            rows = []
            for v, m in zip(pdf["_x"], pdf["_m"]):
                res = (np.asarray(v, dtype=float) - np.asarray(m)).reshape(n_ch, -1)
                q = (res * res).sum(axis=0)
                rows.append(np.concatenate([[res.shape[1], (q * q).sum()], (res @ res.T).reshape(-1)]))
            part = pd.DataFrame(rows).groupby([pdf[b].to_numpy() for b in by]).sum()
            k = part.index.to_frame(index=False)
            k.columns = by
            yield k.assign(_s=list(part.to_numpy()))

    sums = j.mapInPandas(partial, f"{keys}, _s array<double>").groupBy(*by).agg(vector_sum("_s").alias("_s"))

    def whitener(s):
        c = kernels.shrink_lw(np.asarray(s[2:]).reshape(n_ch, n_ch) / s[0], s[1], s[0])
        return (kernels.powm(c, -0.5) if c.any() else np.where(np.eye(n_ch) > 0, no_noise, 0.0)).reshape(-1)

    def solve(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf[by].assign(isqrt=[whitener(s) for s in pdf["_s"]])

    return sums.mapInPandas(solve, f"{keys}, isqrt array<double>")


# ---- supervised alignment --------------------------------------------------------------------------------------

def fit_rotation(a: np.ndarray, b: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Orthogonal R with the smallest Σ ‖A_k − R B_k Rᵀ‖² over a few symmetric d × d pairs.

    Starts pair the eigenvectors of one class (or of a weighted sum) and settle their signs by the other classes; each
    start climbs Σ tr(A R B Rᵀ) by polar steps, which cannot fall once both sides are shifted to be positive."""
    d = a.shape[1]
    weights = np.vstack([np.eye(len(a)), 1.0 / (1 + np.arange(len(a)))])
    starts = [np.eye(d)]
    for w in weights:
        ua, ub = (np.linalg.eigh(np.einsum("k,kij->ij", w, m))[1] for m in (a, b))
        pair = np.einsum("kij,kij->ij", np.einsum("ip,kij,jq->kpq", ua, a, ua), np.einsum("ip,kij,jq->kpq", ub, b, ub))
        np.fill_diagonal(pair, 0.0)
        sign = np.where(np.linalg.eigh(pair)[1][:, -1] < 0, -1.0, 1.0)
        starts.append((ua * sign) @ ub.T)
    lift = lambda m: m + (1e-6 - min(np.linalg.eigvalsh(m).min(), 0.0)) * np.eye(d)
    score = lambda r: np.einsum("kij,jl,klm,im->", a, r, b, r)
    pa, pb = lift(a), lift(b)

    def climb(r):
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.einsum("kij,jl,klm->im", pa, r, pb))
            moved = np.abs(u @ vt - r).max()
            r = u @ vt
            if moved < 1e-12:
                break
        return r

    return max((climb(r) for r in starts), key=score)


def class_mean_pairs(source: DataFrame, calib: DataFrame, label: str, d: int, how: str = "inner") -> DataFrame:
    """(label, a, b): class means of the source and of the calibration rows."""
    a, b = (riemannian_mean(df, [label], d).select(label, F.col("mean").alias(n)) for df, n in ((source, "a"), (calib, "b")))
    return checkpointed(a.join(b, label, how))


def rotation(source: DataFrame, calib: DataFrame, label: str, d: int) -> np.ndarray:
    """Orthogonal map that takes the calibration's class means to the source's, fitted in a task on their matrix logs."""
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"r": [fit_rotation(kernels.logm(_square(pdf["a"], d)), kernels.logm(_square(pdf["b"], d))).ravel()]})

    found = class_mean_pairs(source, calib, label, d).orderBy(label).groupBy().applyInPandas(fit, "r array<double>").head()
    if found is None:
        raise ValueError("source and calibration share no class")
    return np.asarray(found["r"]).reshape(d, d)


def rotate_alignment(source: DataFrame, calib: DataFrame, target: DataFrame, label: str, d: int) -> DataFrame:
    """Apply the calibration's rotation to centred and scaled target matrices."""
    r = rotation(source, calib, label, d)
    return map_cov(target, d, lambda c: r @ c @ r.T)


def geodesic(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """Point at share t on the way from a to b."""
    root, inv = kernels.powm(a, 0.5), kernels.powm(a, -0.5)
    return root @ kernels.powm(inv @ b @ inv, t) @ root


def weighted_class_means(source: DataFrame, calib: DataFrame, label: str, d: int, lam: float = 0.5) -> DataFrame:
    """(label, mean): class means blended along the geodesic, λ = 1 keeps the source's, 0 the target's; a class of one side keeps its mean."""
    def blend(batches):
        for pdf in batches:
            if len(pdf):
                means = [np.asarray(a if b is None else b if a is None else geodesic(_square([b], d)[0], _square([a], d)[0], lam)).ravel() for a, b in zip(pdf["a"], pdf["b"])]
                yield pdf[[label]].assign(mean=means)

    pairs = class_mean_pairs(source, calib, label, d, "full")
    return pairs.mapInPandas(blend, f"{_keys_schema(pairs, [label])}, mean array<double>")
