"""Band power, haemodynamic cleaning and model weights."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialframe.functions import kernels
from trialframe.functions.columns import amean, astd, asum, dot, let
from trialframe.operators.epoching import map_vectors

# fixed values: rhythm names and limits in Hz
BANDS = [("theta", 4.0, 7.0), ("alpha", 8.0, 13.0), ("beta", 13.0, 30.0)]


def band_powers(df: DataFrame, keep: list[str], fs: float, bands=BANDS, relative: bool = False) -> DataFrame:
    """Log Welch power per band and channel, array in band-major order; Arrow batches."""
    nperseg = round(2 * fs)

    def run(x: np.ndarray) -> np.ndarray:
        freqs, psd = kernels.welch_psd(x, fs, nperseg)
        p = np.stack([psd[..., (freqs >= lo) & (freqs < hi)].sum(axis=-1) for _, lo, hi in bands], axis=1)
        if relative:
            p = p / (p.sum(axis=1, keepdims=True) + 1e-12)
        return np.log(p + 1e-12).reshape(len(x), -1)

    return map_vectors(df, keep, run, "power")


def band_powers_relational(cells: DataFrame, keys: list[str], fs: float, bands=BANDS,
                           relative: bool = False) -> DataFrame:
    """The same numbers as joins-free relational steps: samples are copied to their segments, Fourier sums are
    grouped by (epoch, segment, frequency), power is averaged over segments and summed in bands."""
    n_max = round(2 * fs)
    w = W.partitionBy(*keys)
    d = cells.withColumn("_t", F.count(F.lit(1)).over(w))
    d = d.withColumn("_n", F.least(F.col("_t"), F.lit(n_max)))
    d = d.withColumn("_hop", F.col("_n") - F.floor(F.col("_n") / 2))
    lo = F.greatest(F.lit(0), F.floor((F.col("i") - F.col("_n")) / F.col("_hop")) + 1)
    hi = F.least(F.floor((F.col("_t") - F.col("_n")) / F.col("_hop")), F.floor(F.col("i") / F.col("_hop")))
    d = d.withColumn("seg", F.explode(F.when(lo <= hi, F.sequence(lo, hi))))
    d = d.withColumn("j", F.col("i") - F.col("seg") * F.col("_hop"))
    d = d.withColumn("_m", F.avg("x").over(W.partitionBy(*keys, "seg")))
    hann = F.when(F.col("_n") > 1, 0.5 - 0.5 * F.cos(2 * F.pi() * F.col("j") / F.col("_n"))).otherwise(F.lit(1.0))
    d = d.withColumn("_w", hann).withColumn("_x", (F.col("x") - F.col("_m")) * F.col("_w"))
    d = d.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_n") / 2))))
    phase = 2 * F.pi() * F.col("k") * F.col("j") / F.col("_n")
    g = d.groupBy(*keys, "_n", "seg", "k").agg(F.sum(F.col("_x") * F.cos(phase)).alias("re"),
                                               F.sum(F.col("_x") * F.sin(phase)).alias("im"),
                                               F.sum(F.col("_w") * F.col("_w")).alias("ww"))
    sides = F.when((F.col("k") > 0) & (2 * F.col("k") != F.col("_n")), 2.0).otherwise(1.0)
    power = sides * (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (fs * F.col("ww"))
    psd = g.groupBy(*keys, "_n", "k").agg(F.avg(power).alias("p"))
    f = F.col("k") * fs / F.col("_n")
    total = [F.sum(F.when((f >= lo_) & (f < hi_), F.col("p")).otherwise(0.0)) for _, lo_, hi_ in bands]
    out = psd.groupBy(*keys).agg(F.array(*total).alias("p"))
    p = let(asum("p") + 1e-12, lambda s: F.transform("p", lambda v: v / s)) if relative else F.col("p")
    names = F.array(*[F.lit(n) for n, _, _ in bands])
    out = out.select(*keys, F.posexplode(F.transform(p, lambda v: F.log(v + 1e-12))).alias("b", "power"))
    return out.select(*keys, F.element_at(names, F.col("b") + 1).alias("band"), "power")


# ---- cleaners on nested arrays: no shuffle, chained with DataFrame.transform -------------------------------------

def cbsi(df: DataFrame, x: str = "x") -> DataFrame:
    """Correlation-based signal improvement of paired chromophores: channel c with c + C/2."""
    half = (F.size(x) / 2).cast("int")

    def pair(c):
        return let(F.struct(F.col(x)[c].alias("o"), F.col(x)[c + half].alias("r")), lambda p: let(
            F.struct(p["o"].alias("o"), p["r"].alias("r"), (astd(p["o"]) / (astd(p["r"]) + 1e-9)).alias("a")),
            lambda q: F.struct(F.zip_with(q["o"], q["r"], lambda o, r: 0.5 * (o - q["a"] * r)).alias("o"),
                               q["a"].alias("a"))))

    pairs = F.transform(F.sequence(F.lit(0), half - 1), pair)
    d = df.withColumn("_p", pairs)
    hbo = F.transform("_p", lambda p: p["o"])
    hbr = F.transform("_p", lambda p: F.transform(p["o"], lambda v: F.try_divide(-v, p["a"])))
    return d.withColumn(x, F.concat(hbo, hbr)).drop("_p")


def detrend(df: DataFrame, x: str = "x") -> DataFrame:
    """Subtract mean and least-squares line per channel."""

    def line(row):
        mid = (F.size(row) - 1) / 2.0
        num = asum(F.transform(row, lambda v, i: v * (i - mid)))
        den = asum(F.transform(row, lambda v, i: (i - mid) * (i - mid)))
        fit = F.struct(amean(row).alias("m"), F.coalesce(F.try_divide(num, den), F.lit(0.0)).alias("s"))
        return let(fit, lambda f: F.transform(row, lambda v, i: v - f["m"] - f["s"] * (i - mid)))

    return df.withColumn(x, F.transform(x, line))


CLEANERS = {"cbsi": cbsi, "detrend": detrend, "none": lambda df: df}


def clean_chain(df: DataFrame, names: list[str] | None) -> DataFrame:
    """Cleaners in the given order (they do not commute); None is the identity."""
    unknown = [n for n in names or [] if n not in CLEANERS]
    if unknown:
        raise ValueError(f"unknown cleaners: {unknown}")
    return reduce(lambda d, n: d.transform(CLEANERS[n]), names or [], df)


def glm_beta(df: DataFrame, keep: list[str], n: int, fs: float, tmin: float, task_dur: float,
             derivatives: bool = True, drift_order: int = 1, x: str = "x") -> DataFrame:
    """Task weights of every channel of epochs with ``n`` samples: each weight is a dot product with a constant."""
    p = kernels.glm_projection(n, fs, tmin, task_dur, derivatives, drift_order)
    rows = [F.array(*[F.lit(float(v)) for v in row]) for row in p]
    beta = F.transform(x, lambda ch: F.array(*[dot(ch, row) for row in rows]))
    return df.select(*keep, F.posexplode(beta).alias("ch", "_b")).select(
        *keep, "ch", F.posexplode("_b").alias("k", "beta"))


def channel_sd(x: Column) -> Column:
    return F.transform(x, astd)
