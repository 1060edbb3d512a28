"""Normalization. Statistics are grouped sums (partial sums on the map side), then joined back; the joins are left
to Catalyst and AQE, which broadcast the small side only when its measured size allows and split skewed subjects."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.functions import kernels
from trialframe.functions.columns import amean, astd, let
from trialframe.operators.epoching import stream_chunks


def zscore_epoch(df: DataFrame, eps: float = 1e-7, x: str = "x") -> DataFrame:
    """Per epoch and channel over time; no shuffle."""

    def z(row):
        return let(F.struct(amean(row).alias("m"), (astd(row) + eps).alias("s")),
                   lambda q: F.transform(row, lambda v: (v - q["m"]) / q["s"]))

    return df.withColumn(x, F.transform(x, z))


def zscore_block(df: DataFrame, eps: float = 1e-6, x: str = "x") -> DataFrame:
    """Per epoch over channels and time together."""
    q = F.struct(amean(F.flatten(x)).alias("m"), (astd(F.flatten(x)) + eps).alias("s"))
    return df.withColumn("_q", q).withColumn(x, F.transform(x, lambda row: F.transform(
        row, lambda v: (v - F.col("_q.m")) / F.col("_q.s")))).drop("_q")


def scale(df: DataFrame, k: float, x: str = "x") -> DataFrame:
    return df.withColumn(x, F.transform(x, lambda row: F.transform(row, lambda v: v * k)))


def fit_stats(df: DataFrame, by: list[str], value: str, where: Column | None = None) -> DataFrame:
    v = F.col(value) if where is None else F.when(where, F.col(value))
    return df.groupBy(*by).agg(F.avg(v).alias("_mu"), F.stddev_pop(v).alias("_sd"))


def apply_stats(df: DataFrame, stats: DataFrame, by: list[str], value: str, eps: float) -> DataFrame:
    out = df.join(stats, by)
    return out.withColumn(value, (F.col(value) - F.col("_mu")) / (F.col("_sd") + eps)).drop("_mu", "_sd")


def zscore_train(df: DataFrame, by: list[str], value: str, eps: float = 1e-6) -> DataFrame:
    """Statistics from ``part`` = train, applied to every row."""
    return apply_stats(df, fit_stats(df, by, value, F.col("part") == "train"), by, value, eps)


def zscore_subject(df: DataFrame, by: list[str], value: str, eps: float = 1e-6) -> DataFrame:
    """Each feature by its subject's own statistics; ``by`` holds the subject and the feature keys."""
    return apply_stats(df, fit_stats(df, by, value), by, value, eps)


def zscore_calibrated(df: DataFrame, by: list[str], value: str, calib: str = "calib", eps: float = 1e-6) -> DataFrame:
    return apply_stats(df, fit_stats(df, by, value, F.col(calib)), by, value, eps)


def weighted_family_scaler(df: DataFrame, by: list[str], value: str, family: str, weights: dict[str, float],
                           eps: float = 1e-8) -> DataFrame:
    """Standardize on the train rows, then multiply by the family's weight (1 when not listed)."""
    z = apply_stats(df, fit_stats(df, by, value, F.col("part") == "train"), by, value, eps)
    w = F.create_map(*[F.lit(a) for kv in weights.items() for a in (kv[0], float(kv[1]))])
    return z.withColumn(value, F.col(value) * F.coalesce(F.try_element_at(w, F.col(family)), F.lit(1.0)))


Link = Callable[[DataFrame], DataFrame]


def compose_normalization(df: DataFrame, links: list[Link]) -> DataFrame:
    """Each link is fitted on the output of the links before it; no link is the identity."""
    return reduce(lambda d, link: d.transform(link), links, df)


# ---- exponential moving standardization -----------------------------------------------------------------------

def _ewm_weights(t: np.ndarray, q: float) -> np.ndarray:
    return (1.0 - q ** (t + 1.0)) / (1.0 - q)


def _chunk_summary(v: np.ndarray, t0: int, q: float, init: int) -> tuple:
    """(length, sum, a, b, c, n, mean, m2) of a chunk that starts without a carry.

    With a carry s at its start the deviations are (v − L/w) − s·qᵏ⁺¹/w, so the weighted sum of their squares at its end is a − 2bs + cs².
    n, mean and m2 (squared deviations) are those of the samples before ``init``.
    """
    t = t0 + np.arange(len(v))
    local, w = kernels.ewm_sums(v, q), _ewm_weights(t, q)
    fixed, moved = v - local / w, q ** (np.arange(len(v)) + 1.0) / w
    down = q ** np.arange(len(v) - 1, -1, -1.0)
    head = v[t < init]
    mean = head.mean() if len(head) else 0.0
    return (len(v), local[-1], (down * fixed * fixed).sum(), (down * fixed * moved).sum(), (down * moved * moved).sum(), len(head), mean, ((head - mean) ** 2).sum())


def _carries(rows: list, q: float) -> tuple[list, list, float, float]:
    """Carries (s, q) at the start of every chunk of a recording, and mean and deviation of its first samples."""
    s = sq = m2 = mean = 0.0
    n, firsts, seconds = 0, [], []
    for r in rows:
        firsts.append(s)
        seconds.append(sq)
        down = q ** r["len"]
        sq = r["a"] - 2 * r["b"] * s + r["c"] * s * s + down * sq
        s = r["sum"] + down * s
        if r["n"]:
            gap, total = r["mean"] - mean, n + r["n"]
            m2 += r["m2"] + gap * gap * n * r["n"] / total
            mean += gap * r["n"] / total
            n = total
    return firsts, seconds, mean, float(np.sqrt(m2 / n)) if n else 0.0


def ewm_standardize(samples: DataFrame, value: str, factor: float = 1e-3, init: int = 1000, eps: float = 1e-4,
                    chunk: int = 65536) -> DataFrame:
    """Exponential moving mean and variance over each recording ``(rec, t, value)``; the first ``init`` samples are
    standardized by their own mean and deviation.

    Both weighted sums are linear recurrences, the second one quadratic in the first one's carry. So chunks are summed up in one scan,
    a few numbers per chunk are folded into both carries of every chunk, and one join brings these back to the samples.
    """
    q = 1.0 - factor
    pieces = stream_chunks(samples, value, chunk)
    rec = samples.schema["rec"].dataType.simpleString()
    names = ["len", "sum", "a", "b", "c", "n", "mean", "m2"]

    def summaries(batches):
        for pdf in batches:
            rows = [(rec, c, *_chunk_summary(np.asarray(v, dtype=float), t0, q, init)) for rec, c, t0, v in zip(*[pdf[k] for k in ("rec", "chunk", "t0", "v")])]
            yield pd.DataFrame(rows, columns=["rec", "chunk", *names])

    def fold(batches):
        for pdf in batches:
            found = [_carries(rows, q) for rows in pdf["rows"]]
            yield pd.DataFrame({"rec": pdf["rec"], "chunk": [[r["chunk"] for r in rows] for rows in pdf["rows"]], "s0": [f[0] for f in found],
                                "q0": [f[1] for f in found], "hm": [f[2] for f in found], "hs": [f[3] for f in found]})

    fields = f"rec {rec}, chunk bigint, len bigint, sum double, a double, b double, c double, n bigint, mean double, m2 double"
    listed = pieces.mapInPandas(summaries, fields).groupBy("rec").agg(F.sort_array(F.collect_list(F.struct("chunk", *names))).alias("rows"))
    carries = listed.mapInPandas(fold, f"rec {rec}, chunk array<bigint>, s0 array<double>, q0 array<double>, hm double, hs double")
    carries = carries.select("rec", "hm", "hs", F.explode(F.arrays_zip("chunk", "s0", "q0")).alias("x")).select("rec", "x.*", "hm", "hs")

    def apply(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            ts, zs = [], []
            for t0, v, s0, q0, hm, hs in zip(*[pdf[k] for k in ("t0", "v", "s0", "q0", "hm", "hs")]):
                v = np.asarray(v, dtype=float)
                t = t0 + np.arange(len(v))
                w = _ewm_weights(t, q)
                d = v - kernels.ewm_sums(v, q, s0) / w
                z = d / np.maximum(eps, np.sqrt(kernels.ewm_sums(d * d, q, q0) / w))
                ts.append(t)
                zs.append(np.where(t < init, (v - hm) / max(eps, hs), z))
            yield pd.DataFrame({"rec": np.repeat(pdf["rec"].to_numpy(), [len(t) for t in ts]), "t": np.concatenate(ts), "z": np.concatenate(zs)})

    return pieces.join(carries, ["rec", "chunk"]).mapInPandas(apply, f"rec {rec}, t bigint, z double")
