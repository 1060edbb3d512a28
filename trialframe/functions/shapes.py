"""Shape descriptors of many equally long series at once, inside Arrow batches."""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view


def window_starts(n: int, length: int, hop: int) -> np.ndarray:
    """First samples of the whole windows of a series; one window at 0 if the series is not longer than a window."""
    return np.arange(0, max(0, n - length) + 1, hop)


def windows(x: np.ndarray, length: int, hop: int) -> np.ndarray:
    """(m, windows, samples) view of ``x`` (m, n); no sample is copied."""
    if x.shape[1] <= length:
        return x[:, None, :]
    return sliding_window_view(x, length, axis=1)[:, ::hop]


def _slope(x: np.ndarray, i: np.ndarray, ok: np.ndarray) -> np.ndarray:
    n = ok.sum(axis=-1)
    at = np.where(ok, i, 0.0)
    di = np.where(ok, at - at.sum(axis=-1, keepdims=True) / n[..., None], 0.0)
    dx = np.where(ok, x - np.where(ok, x, 0.0).sum(axis=-1, keepdims=True) / n[..., None], 0.0)
    return (di * dx).sum(axis=-1) / (di * di).sum(axis=-1)


def describe(x: np.ndarray, families: list[str]) -> np.ndarray:
    """(..., families) descriptors of series along the last axis. A NaN sample is missing: it keeps its place and adds nothing;
    an undefined descriptor is NaN, but the skew and kurtosis of a constant or missing series are 0."""
    t = x.shape[-1]
    out = np.full((*x.shape[:-1], len(families)), np.nan)
    if not t:
        return out
    with np.errstate(all="ignore"):
        ok = ~np.isnan(x)
        i = np.arange(t, dtype=float)
        n = ok.sum(axis=-1)
        total = np.where(ok, x, 0.0).sum(axis=-1)
        mean = total / n
        d = np.where(ok, x - mean[..., None], 0.0)
        low, high = np.where(ok, x, np.inf).min(axis=-1), np.where(ok, x, -np.inf).max(axis=-1)
        low, high = np.where(n > 0, low, np.nan), np.where(n > 0, high, np.nan)
        var = (d * d).sum(axis=-1) / n
        last = slice(t - max(1, t // 10), t)
        first_peak = np.where(ok, np.abs(x), -1.0).argmax(axis=-1)

        def moment(p: int) -> np.ndarray:
            return (d ** p).sum(axis=-1) / n

        def part(at: slice) -> np.ndarray:
            return _slope(x[..., at], i[at], ok[..., at])

        def peak() -> np.ndarray:
            return np.take_along_axis(x, first_peak[..., None], axis=-1)[..., 0]

        made = {
            "mean": lambda: mean,
            "variance": lambda: var,
            "min": lambda: low,
            "max": lambda: high,
            "range": lambda: high - low,
            "auc": lambda: total - (x[..., 0] + x[..., -1]) / 2.0,
            "final": lambda: np.where(ok[..., last], x[..., last], 0.0).sum(axis=-1) / ok[..., last].sum(axis=-1),
            "peak": peak,
            "time_to_peak": lambda: np.where(n > 0, first_peak / t, np.nan),
            "skew": lambda: np.where(high > low, moment(3) / var ** 1.5, 0.0),
            "kurtosis": lambda: np.where(high > low, moment(4) / var ** 2 - 3.0, 0.0),
            "zero_crossings": lambda: (((x[..., 1:] < 0) != (x[..., :-1] < 0)) & ok[..., 1:] & ok[..., :-1]).sum(axis=-1),
            "slope": lambda: part(slice(0, t)),
            "early_slope": lambda: part(slice(0, t // 2)),
            "late_slope": lambda: part(slice(t // 2, t)),
        }
        for k, f in enumerate(families):
            out[..., k] = made[f]()
    return out
