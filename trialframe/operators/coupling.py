"""Lagged coupling between a fast drive and a slow response, per epoch arrays ``drive`` and ``resp``."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.functions import kernels
from trialframe.functions.columns import amean, astd, centre, dot, let, vector_sum
from trialframe.operators.epoching import shift_fill

# fixed values: least response lag, limits of the response spread, step of both, and deviation of a stable lag, in seconds
LEAST_LAG_S, SPREAD_S, STEP_S, STABLE_STD_S = 2.0, (2.0, 5.0), 0.5, 2.0
# fixed values: envelope bands of the cross-modal series in Hz
SERIES_BANDS = {"theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0)}


def correlation(a: Column, b: Column) -> Column:
    """Mean product of z-scores (σ + 1e-9) over time."""
    return let(centre(a), lambda x: let(centre(b), lambda y: dot(x, y) / F.size(x) / ((astd(x) + 1e-9) * (astd(y) + 1e-9))))


def shift_scan(df: DataFrame, fs: float, lags_s=range(12)) -> DataFrame:
    """Mean correlation of the response with the drive delayed by each lag (head filled with the first value)."""
    lags = F.array(*[F.struct(F.lit(s).alias("lag_s"), correlation(shift_fill("drive", round(s * fs)), F.col("resp")).alias("r"))
                     for s in lags_s])
    return df.select(F.explode(lags).alias("e")).groupBy("e.lag_s").agg(F.avg("e.r").alias("r"))


def coupling_grid(lag_max: float = 12.0) -> np.ndarray:
    """[kernels, 2]: every (lag, spread) on the half-second lattice whose spread doesn't exceed its lag, by lag."""
    lattice = lambda low, high: low + STEP_S * np.arange(int(np.floor((high - low) / STEP_S + 1e-9)) + 1)
    lag, spread = np.meshgrid(lattice(LEAST_LAG_S, lag_max), lattice(*SPREAD_S), indexing="ij")
    return np.column_stack([lag[spread <= lag], spread[spread <= lag]])


def _convolve(d: np.ndarray, g: np.ndarray) -> np.ndarray:
    n = d.shape[1] + len(g) - 1
    return np.fft.irfft(np.fft.rfft(d, n, axis=1) * np.fft.rfft(g, n), n, axis=1)[:, :d.shape[1]]


def _zscore(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(axis=1, keepdims=True)) / (x.std(axis=1, keepdims=True) + 1e-9)


def estimate_coupling(df: DataFrame, by: list[str], fs: float, lag_max: float = 12.0, length_s: float = 30.0) -> DataFrame:
    """Causal gamma response per group: (by…, lag, decay, beta). The batches add one score per kernel of the grid, the
    kernel with the largest squared mean correlation wins, and its least-squares gain comes from a second pass."""
    grid = coupling_grid(lag_max)
    bank = kernels.response_kernels(grid[:, 0], grid[:, 1], fs, length_s)
    schema = "".join(f"`{c.name}` {c.dataType.simpleString()}, " for c in df.select(*by).schema)
    group = by or [F.lit(1)]

    def groups(pdf):
        """(code per row, key frame)."""
        if not by:
            return np.zeros(len(pdf), int), pd.DataFrame(index=[0])
        codes, uniq = pd.factorize(pd.MultiIndex.from_frame(pdf[by]))
        keys = uniq.to_frame(index=False)
        keys.columns = by
        return codes, keys

    def stacks(pdf):
        lens = pdf["drive"].map(len).to_numpy()
        for n in np.unique(lens):
            at = np.flatnonzero(lens == n)
            yield at, *(np.stack([np.asarray(pdf[c].iloc[i], dtype=float) for i in at]) for c in ("drive", "resp"))

    def score(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            codes, keys = groups(pdf)
            s = np.zeros((len(keys), len(bank) + 1))
            for at, d, r in stacks(pdf):
                rz = _zscore(r)
                np.add.at(s[:, 0], codes[at], 1.0)
                for k, g in enumerate(bank):
                    np.add.at(s[:, k + 1], codes[at], (_zscore(_convolve(d, g)) * rz).mean(axis=1))
            yield keys.assign(_s=list(s))

    sums = df.select(*by, "drive", "resp").mapInPandas(score, f"{schema}_s array<double>")
    sums = sums.groupBy(*group).agg(vector_sum("_s").alias("_s")).select(*by, "_s")
    strength = F.transform(F.slice("_s", 2, len(bank)), lambda v: F.round(F.pow(v / F.col("_s")[0], 2), 12))
    best = sums.select(*by, F.array_position(strength, F.array_max(strength)).cast("int").alias("_k"))
    at = F.element_at(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(w).alias("w")) for p, w in grid.tolist()]), F.col("_k"))

    def gain(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            codes, keys = groups(pdf)
            num, den = np.zeros(len(keys)), np.zeros(len(keys))
            chosen = pdf["_k"].to_numpy() - 1
            for at, d, r in stacks(pdf):
                for k in np.unique(chosen[at]):
                    rows = chosen[at] == k
                    pred = _convolve(d[rows], bank[k])
                    np.add.at(num, codes[at][rows], (pred * r[rows]).sum(axis=1))
                    np.add.at(den, codes[at][rows], (pred * pred).sum(axis=1))
            yield keys.assign(_num=num, _den=den)

    if by:
        j = df.select(*by, "drive", "resp").join(best, by)
    else:
        j = df.select("drive", "resp").withColumn("_k", best.select("_k").scalar())
    beta = j.mapInPandas(gain, f"{schema}_num double, _den double").groupBy(*group).agg(
        (F.sum("_num") / (F.sum("_den") + 1e-12)).alias("beta")).select(*by, "beta")
    fit = best.select(*by, at.alias("_at")).select(*by, F.col("_at.p").alias("lag"),
                                                   (F.col("_at.w") * F.col("_at.w") / F.col("_at.p")).alias("decay"))
    if by:
        return fit.join(beta, by)
    return fit.withColumn("beta", beta.scalar())


def pooled_vs_subject_lag(df: DataFrame, subject: str, fs: float, **kw) -> DataFrame:
    """Spread of the per-subject lags next to the pooled fit; a deviation below two seconds is stable."""
    per = estimate_coupling(df, [subject], fs, **kw)
    pooled = estimate_coupling(df, [], fs, **kw)
    g = per.agg(F.avg("lag").alias("lag_mean"), F.stddev_pop("lag").alias("lag_std"), F.min("lag").alias("lag_min"),
                F.max("lag").alias("lag_max"))
    g = g.withColumn("verdict", F.when(F.col("lag_std") < STABLE_STD_S, "STABLE").otherwise("UNSTABLE"))
    return g.withColumn("pooled_lag", pooled.select("lag").scalar())


def interpolated(s: np.ndarray, t0: float, fs: float, grid: np.ndarray) -> np.ndarray:
    """Last axis read linearly at ``grid`` from t0 + i/fs; 0 outside."""
    src = t0 + np.arange(s.shape[-1]) / fs
    return np.stack([np.interp(grid, src, row, left=0.0, right=0.0) for row in s.reshape(-1, s.shape[-1])]).reshape(*s.shape[:-1], len(grid))


def regrid(df: DataFrame, x: str, t0: float, fs: float, step: float, n: int) -> DataFrame:
    """Linear interpolation of the nested array from t0 + i/fs to 0, step, …; 0 outside."""
    from trialframe.operators.epoching import map_epochs
    grid = np.arange(n) * step
    return map_epochs(df, lambda s: interpolated(s, t0, fs, grid), x)


def channel_series(df: DataFrame, fs_e: float, fs_f: float, tmin_f: float, fps: float, t_end: float, lag_s: float,
                   bands: dict = SERIES_BANDS) -> DataFrame:
    """Paired epochs (``xe``, ``xf``) on one grid: band envelopes ``env_<band>`` and the haemodynamic map ``neural``,
    the blood read ``lag_s`` later and 0 beyond the recording. All series of a batch are made in one pass, so a task has one Python worker
    whatever the number of bands."""
    grid = np.arange(int(np.ceil(t_end * fps - 1e-9))) * (1 / fps)
    keep = [c for c in df.columns if c not in ("x", "xe", "xf")]
    made = [(f"env_{name}", len(keep), lambda s, lo=lo, hi=hi: interpolated(kernels.envelope(s, lo, hi, fs_e), 0.0, fs_e, grid))
            for name, (lo, hi) in bands.items()]
    made.append(("x", len(keep) + 1, lambda s: interpolated(s, tmin_f - lag_s, fs_f, grid)))
    types = [df.schema["xf" if name == "x" else "xe"].dataType.simpleString() for name, _, _ in made]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema],
                        *[f"`{name}` {kind}" for (name, _, _), kind in zip(made, types)]])

    def run(batches):
        for b in batches:
            split = {at: kernels.stacks(b.column(at)) for at in (len(keep), len(keep) + 1)}
            cols = [b.column(i) for i in range(len(keep))]
            for _, at, fn in made:
                rows = [None] * b.num_rows
                for where, stack in split[at]:
                    for i, e in zip(where, fn(stack)):
                        rows[i] = e
                cols.append(kernels.to_nested(rows).cast(b.schema.field(at).type))
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *[name for name, _, _ in made]])

    out = df.select(*keep, "xe", "xf").mapInArrow(run, schema)
    half = (F.size("x") / 2).cast("int")

    def neural(c):
        return let(F.struct(F.col("x")[c].alias("o"), F.col("x")[c + half].alias("r")), lambda p: let(
            astd(p["o"]) / (astd(p["r"]) + 1e-9), lambda a: F.zip_with(p["o"], p["r"], lambda o, r: 0.5 * (o - a * r))))

    return out.withColumn("neural", F.transform(F.sequence(F.lit(0), half - 1), neural)).drop("x")


def sign_aligned_product(df: DataFrame, env: str, neural: str, coverage: str, sign: float, name: str = "joint") -> DataFrame:
    """sign·(envelope − its time mean) × co-located haemodynamic series × coverage, per node."""
    def node(e, i):
        return let(amean(e), lambda m: F.zip_with(e, F.col(neural)[i], lambda v, u: sign * (v - m) * u * F.col(coverage)[i]))

    return df.withColumn(name, F.transform(env, node))

