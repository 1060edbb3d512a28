"""Decoding methods by name and the experiment matrix.

A method takes epochs ``(keep…, y, fold, x)`` and returns ``(keep…, y, fold, probs)`` for every row, predicted by the
model of the row's fold.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.functions.columns import softmax
from trialframe.operators import classify as C
from trialframe.operators import descriptors as D
from trialframe.operators import foldcsp, foldwise, metrics, spectral
from trialframe.operators.epoching import time_delay_embed, window_length
from trialframe.operators.spatial import trial_covariance
from trialframe.session import checkpointed


@dataclass(frozen=True)
class Task:
    """What a method needs to know about the epochs."""
    n_ch: int
    n_samples: int
    fs: float
    n_classes: int
    keep: tuple[str, ...] = ("subject", "blk")
    estimator: str = "oas"
    bands: tuple = tuple(spectral.BANDS)
    csp_filters: int = 6
    fb_bands: tuple[tuple[float, float], ...] = ((8.0, 12.0), (12.0, 16.0))
    fb_features: int = 8
    fb_order: int = 5
    acm_order: int = 2
    acm_lag: int = 1
    win_s: float = 1.0
    hop_s: float = 0.5
    pool: str = "mean"
    add_position: bool = True
    tmin: float = 0.0
    task_dur: float = 10.0

    @property
    def columns(self) -> list[str]:
        return [*self.keep, "y", "fold"]


def _lda(features: DataFrame, t: Task, shrinkage="auto") -> DataFrame:
    """Features are read by a pass each for their mean, their sums and the scores, so they are kept."""
    return C.shrinkage_lda(checkpointed(features), "fold", t.n_classes, shrinkage, t.columns)


def _cov(df: DataFrame, t: Task) -> DataFrame:
    return checkpointed(trial_covariance(df, t.columns, t.estimator))


def covariance_rows(df: DataFrame, t: Task) -> foldwise.Chunks:
    """Covariances dealt to chunks, as all methods on plain covariances read them."""
    return foldwise.chunked(trial_covariance(df, t.columns, t.estimator), 8 * t.n_ch**2)


def _bank_vectors(df: DataFrame, t: Task, families: list[str], keys: list[str], x: str = "x") -> DataFrame:
    """Descriptors of all channels as one vector per key, channel-major."""
    return D.array_bank(df, keys, families, x).select(*keys, D.bank_vector().alias("f"))


def csp_lda(df: DataFrame, t: Task, rows: foldwise.Chunks | None = None) -> DataFrame:
    return foldcsp.csp_lda_folds(rows or covariance_rows(df, t), "fold", 1, t.n_ch, t.csp_filters, t.n_classes, t.columns)


def fbcsp(df: DataFrame, t: Task) -> DataFrame:
    cov = foldcsp.band_covariances(df, t.columns, list(t.fb_bands), t.fs, t.fb_order)
    return foldcsp.csp_lda_folds(cov, "fold", len(t.fb_bands), t.n_ch, t.csp_filters, t.n_classes, t.columns, t.fb_features)


def riemann(df: DataFrame, t: Task, rows: foldwise.Chunks | None = None) -> DataFrame:
    return C.riemann_folds(rows or covariance_rows(df, t), "fold", t.n_ch, t.n_classes, t.columns)


def riemann_acm(df: DataFrame, t: Task) -> DataFrame:
    return C.riemann_folds(_cov(time_delay_embed(df, t.acm_order, t.acm_lag), t), "fold", t.n_ch * t.acm_order, t.n_classes, t.columns)


def riemann_mdm(df: DataFrame, t: Task, rows: foldwise.Chunks | None = None) -> DataFrame:
    return C.mdm_folds(rows or covariance_rows(df, t), "fold", t.n_ch, t.n_classes, t.columns)


def riemann_fgmdm(df: DataFrame, t: Task, rows: foldwise.Chunks | None = None) -> DataFrame:
    return C.fgmdm_folds(rows or covariance_rows(df, t), "fold", t.n_ch, t.n_classes, t.columns)


def fnirs_lda(df: DataFrame, t: Task) -> DataFrame:
    return _lda(_bank_vectors(df, t, D.RECIPES["amplitude"], t.columns), t)


def window_features(df: DataFrame, t: Task) -> DataFrame:
    """Task columns, ``win`` and ``f``: the descriptors of every window and, unless windows are concatenated, the place of its
    centre within the epoch."""
    length, hop = window_length(t.win_s, t.fs), max(1, round(t.hop_s * t.fs))
    rows = df.select(*t.columns, F.size(F.col("x")[0]).alias("_t"), "x")
    win = D.window_bank(rows, [*t.columns, "_t"], length, hop, D.RECIPES["amplitude"]).withColumn("f", D.bank_vector())
    if t.add_position and t.pool != "concat":
        win = win.withColumn("f", F.concat("f", F.array((F.col("win") * hop + length / 2.0) / F.col("_t"))))
    return win.select(*t.columns, "win", "f")


def fnirs_windowed(df: DataFrame, t: Task) -> DataFrame:
    """Window rows inherit the epoch's label for the first stage; their outputs are pooled per epoch."""
    f = checkpointed(window_features(df, t))
    if t.pool == "concat":
        return C.shrinkage_lda(C.window_concat(f, t.columns), "fold", t.n_classes, "auto", t.columns)
    scored = C.linear_scores(f, C.lda_models(f, "fold", t.n_classes), "fold").withColumn("probs", softmax("scores"))
    return C.windowed_pool(scored, t.columns, t.pool)


def fnirs_glm(df: DataFrame, t: Task) -> DataFrame:
    b = spectral.glm_beta(df, t.columns, t.n_samples, t.fs, t.tmin, t.task_dur)
    g = b.groupBy(*t.columns).agg(F.sort_array(F.collect_list(F.struct("ch", "k", "beta"))).alias("s"))
    return _lda(g.select(*t.columns, F.transform("s", lambda e: e["beta"]).alias("f")), t)


def eeg_bandpower(df: DataFrame, t: Task) -> DataFrame:
    return _lda(spectral.band_powers(df, t.columns, t.fs, t.bands).withColumnRenamed("power", "f"), t)


METHODS: dict[str, Callable[[DataFrame, Task], DataFrame]] = {
    "csp_lda": csp_lda, "riemann": riemann, "riemann_acm": riemann_acm, "riemann_mdm": riemann_mdm,
    "riemann_fgmdm": riemann_fgmdm, "fbcsp": fbcsp, "fnirs_lda": fnirs_lda, "fnirs_windowed": fnirs_windowed,
    "fnirs_glm": fnirs_glm, "eeg_bandpower": eeg_bandpower,
}


#: Methods that read the same covariances.
ON_COVARIANCES = {"csp_lda", "riemann", "riemann_mdm", "riemann_fgmdm"}


def get_method(name: str) -> Callable[[DataFrame, Task], DataFrame]:
    if name not in METHODS:
        raise ValueError(f"unknown method {name!r}; known: {sorted(METHODS)}")
    return METHODS[name]


def run_matrix(epochs: DataFrame | Callable[[str], DataFrame], task: Task, names: list[str], run_prefix: str = "") -> DataFrame:
    """Predictions of several methods stacked with a ``run`` key; one grouping then evaluates all of them. ``epochs`` may depend on
    the method's name, as one method may need what another doesn't. Epochs are kept, and the covariances of one frame are made once."""
    if not callable(epochs):
        kept = checkpointed(epochs)
        epochs = lambda name: kept
    out, shared = None, {}
    for name in names:
        method, e = get_method(name), epochs(name)
        if name in ON_COVARIANCES:
            if id(e) not in shared:
                shared[id(e)] = e, covariance_rows(e, task)
            p = method(e, task, shared[id(e)][1])
        else:
            p = method(e, task)
        p = p.withColumn("run", F.lit(f"{run_prefix}{name}"))
        out = p if out is None else out.unionByName(p)
    return out


def matrix_report(predictions: DataFrame) -> DataFrame:
    p = metrics.predict_label(predictions)
    cont = metrics.contingency(p, ["run", "fold"])
    per = metrics.evaluate(cont, ["run", "fold"])
    return per.groupBy("run").agg(F.avg("acc").alias("acc"), F.avg("kappa").alias("kappa"), F.avg("ece").alias("ece"),
                                  F.sum("n").alias("n"))
