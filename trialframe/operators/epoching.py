"""Cutting streams into epochs and reshaping the time axis.

A stream is ``samples(rec, t, c array<double>)`` with consecutive sample numbers; an epoch row carries
``x array<array<double>>`` (channel outside, time inside).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialframe.functions import kernels
from trialframe.functions.columns import asum, let
from trialframe.operators.ordinal import with_previous


#: Length of a piece of a recording in windows.
WINDOWS_PER_PIECE = 4


# ---- event-locked windows --------------------------------------------------------------------------------------

def block_epochs(samples: DataFrame, events: DataFrame, fs: float, tmin: float, tmax: float,
                 baseline_s: float = 0.0) -> DataFrame:
    """Windows [onset + tmin, onset + tmax) per event; windows off the recording are dropped and the mean of the
    first ``baseline_s`` of the window is subtracted per channel. ``events(rec, event, onset, label)``; an event named twice in a
    recording has no window of its own and is dropped.

    A sample is shuffled once, or twice near the end of a piece, and never once per window: pieces of a few window lengths reach
    one window beyond their end, so every window is a slice of the piece in which it begins."""
    a, b = round(tmin * fs), round(tmax * fs)
    n, nb = b - a, round(baseline_s * fs)
    width = WINDOWS_PER_PIECE * n
    homes = F.sequence(F.floor((F.col("t") - (n - 1)) / width), F.floor(F.col("t") / width))
    cut = samples.select("rec", F.explode(homes).alias("_b"), F.struct(F.col("t").cast("bigint").alias("t"), "c").alias("s"))
    pieces = cut.groupBy("rec", "_b").agg(F.sort_array(F.collect_list("s")).alias("s"))
    channels = F.sequence(F.lit(0), F.size(F.col("s")[0]["c"]) - 1)
    pieces = pieces.select("rec", "_b", F.col("s.t").alias("_t"), F.transform(channels, lambda k: F.transform("s", lambda e: e["c"][k])).alias("_x"))
    once = events.groupBy("rec", "event").agg(F.first("onset").alias("onset"), F.first("label").alias("label"), F.count(F.lit(1)).alias("_n"))
    once = once.filter("_n = 1").withColumn("_lo", (F.col("onset") + a).cast("bigint")).withColumn("_b", F.floor(F.col("_lo") / width))
    j = once.join(pieces, ["rec", "_b"]).withColumn("_at", F.array_position("_t", F.col("_lo")).cast("int"))
    last, after = F.get("_t", F.col("_at") + (n - 2)), F.get("_t", F.col("_at") + (n - 1))
    j = j.filter((F.col("_at") > 0) & (last == F.col("_lo") + (n - 1)) & (after.isNull() | (after != last)))
    at = F.greatest(F.col("_at"), F.lit(1))  # a slice from 0 raises, and it may be tried before the filter
    x = F.transform("_x", lambda row: F.slice(row, at, n))
    if nb > 0:
        x = F.transform(x, lambda row: let(asum(F.slice(row, 1, nb)) / nb,
                                           lambda base: F.transform(row, lambda v: v - base)))
    return j.select("rec", "event", "onset", "label", x.alias("x"))


def event_epochs(samples: DataFrame, events: DataFrame, fs: float, tmin: float, tmax: float,
                 baseline_s: float = 0.0) -> DataFrame:
    """As block_epochs with onsets in seconds. An onset past the end of its recording means samples were passed
    as seconds and raises."""
    length = samples.groupBy("rec").agg((F.max("t") + 1).alias("_len"))
    at = F.rint(F.col("onset") * fs).cast("bigint")
    checked = F.when(at < F.col("_len"), at).otherwise(
        F.raise_error(F.lit("onset past the recording: onsets must be in seconds")).cast("bigint"))
    ev = events.join(length, "rec").withColumn("onset", checked).drop("_len")
    return block_epochs(samples, ev, fs, tmin, tmax, baseline_s)


def trigger_onsets(samples: DataFrame, code: str, max_code: int) -> DataFrame:
    """Rising edges of a trigger channel with codes in [1, max_code]."""
    s = with_previous(samples, ["rec"], "t", [code])
    rising = (F.col(code) != 0) & (F.coalesce(F.col(f"prev_{code}"), F.lit(0)) == 0) & (F.col("t") > 0)
    return s.filter(rising & F.col(code).between(1, max_code)).select("rec", F.col("t").alias("onset"),
                                                                      F.col(code).alias("code"))


def resample_linear(samples: DataFrame, step: float, n_grid: int) -> DataFrame:
    """Linear interpolation of ``(rec, t, sec, v)`` on the grid 0, step, …, (n_grid−1)·step; 0 outside the data.

    Each pair of neighbouring samples fills the grid points between them, so no range join is needed; only the
    grid points outside the recording come from its first and last time.
    """
    s = with_previous(samples, ["rec"], "t", ["sec", "v"])
    first = F.ceil(F.col("prev_sec") / step)
    last = F.ceil(F.col("sec") / step) - 1
    grid = lambda lo, hi: F.explode(F.when(lo <= hi, F.sequence(lo, hi)))
    pair = s.filter("prev_sec IS NOT NULL").withColumn(
        "g", grid(F.greatest(first, F.lit(0)), F.least(last, F.lit(n_grid - 1))))
    w = (F.col("g") * step - F.col("prev_sec")) / (F.col("sec") - F.col("prev_sec"))
    inside = pair.select("rec", "g", (F.col("prev_v") + w * (F.col("v") - F.col("prev_v"))).alias("v"))
    ends = samples.groupBy("rec").agg(F.min("sec").alias("a"), F.max("sec").alias("b"),
                                      F.max_by("v", "sec").alias("vb"))
    head = ends.withColumn("g", grid(F.lit(0).cast("bigint"),
                                     F.least(F.ceil(F.col("a") / step), F.lit(n_grid)) - 1)
                           ).select("rec", "g", F.lit(0.0).alias("v"))
    tail = ends.withColumn("g", grid(F.greatest(F.ceil(F.col("b") / step), F.lit(0)),
                                     F.lit(n_grid - 1).cast("bigint")))
    tail = tail.select("rec", "g", F.when(F.col("g") * step == F.col("b"), F.col("vb")).otherwise(0.0).alias("v"))
    return inside.unionByName(head).unionByName(tail)


# ---- spectral filters (Arrow batches) --------------------------------------------------------------------------

def map_epochs(df: DataFrame, fn, x: str = "x") -> DataFrame:
    """Apply a stack kernel [n, ch, t] → [n, ch', t'] to the nested array of every row, batch by batch; the element type stays."""
    at = df.columns.index(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None] * b.num_rows
            for rows, stack in kernels.stacks(b.column(at)):
                for i, e in zip(rows, fn(stack)):
                    out[i] = e
            yield b.set_column(at, x, kernels.to_nested(out).cast(b.schema.field(at).type))

    return df.mapInArrow(run, df.schema)


def map_vectors(df: DataFrame, keep: list[str], fn, name: str, x: str = "x") -> DataFrame:
    """Apply a stack kernel [n, ch, t] → [n, d] and return the kept columns and one array per row."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None] * b.num_rows
            for rows, stack in kernels.stacks(b.column(len(keep))):
                for i, e in zip(rows, fn(stack)):
                    out[i] = e
            cols = [b.column(i) for i in range(len(keep))] + [kernels.to_list(out)]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, name])

    return df.select(*keep, x).mapInArrow(run, f"{schema}, `{name}` array<double>")


def resample_fft(df: DataFrame, n_out: int) -> DataFrame:
    return map_epochs(df, lambda s: kernels.resample_fft(s, n_out))


def bandpass_epochs(df: DataFrame, lo: float, hi: float, fs: float, order: int = 4) -> DataFrame:
    return map_epochs(df, lambda s: kernels.bandpass(s, lo, hi, fs, order))


def band_envelope(df: DataFrame, lo: float, hi: float, fs: float, order: int = 4) -> DataFrame:
    return map_epochs(df, lambda s: kernels.envelope(s, lo, hi, fs, order))


def stream_chunks(samples: DataFrame, value: str, chunk: int, halo: int = 0) -> DataFrame:
    """(rec, chunk, t0, v[]) pieces of a stream, each with ``halo`` extra samples on both sides."""
    t = F.col("t")
    lo, hi = F.floor((t - halo) / chunk), F.floor((t + halo) / chunk)
    homes = F.sequence(F.greatest(lo, F.lit(0)), hi) if halo else F.array(F.floor(t / chunk))
    cut = samples.select("rec", "t", F.col(value).alias("v"), F.explode(homes).alias("chunk"))
    g = cut.groupBy("rec", "chunk").agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("s"))
    return g.select("rec", "chunk", F.col("s")[0]["t"].alias("t0"), F.transform("s", lambda e: e["v"]).alias("v"))


def bandpass_stream(samples: DataFrame, value: str, lo: float, hi: float, fs: float, order: int = 4,
                    chunk: int = 65536, halo: int = 4096) -> DataFrame:
    """Zero-phase band-pass of continuous recordings: pieces with halos are filtered apart and trimmed. Equals the
    whole-recording filter up to the tail of its impulse response beyond the halo."""
    pieces = stream_chunks(samples, value, chunk, halo)

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            ts, ys = [], []
            for c, t0, v in zip(pdf["chunk"], pdf["t0"], pdf["v"]):
                y = kernels.bandpass(np.asarray(v, dtype=float), lo, hi, fs, order)
                t = t0 + np.arange(len(y))
                keep = (t >= c * chunk) & (t < (c + 1) * chunk)
                ts.append(t[keep])
                ys.append(y[keep])
            rec = np.repeat(pdf["rec"].to_numpy(), [len(t) for t in ts])
            yield pd.DataFrame({"rec": rec, "t": np.concatenate(ts), "y": np.concatenate(ys)})

    rec_type = samples.schema["rec"].dataType.simpleString()
    return pieces.mapInPandas(run, f"rec {rec_type}, t bigint, y double")


# ---- windows inside an epoch -----------------------------------------------------------------------------------

def window_length(win_s: float, fs: float) -> int:
    return max(1, round(win_s * fs))


def subwindows(df: DataFrame, win_s: float, hop_s: float, fs: float, x: str = "x") -> DataFrame:
    """One row per (epoch, sliding window) with ``win``, ``start``, centre ``pos`` and the sliced array. A block
    shorter than the window gives one window at 0."""
    length, hop = window_length(win_s, fs), max(1, round(hop_s * fs))
    t = F.size(F.col(x)[0])
    starts = F.when(t <= length, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), t - length, F.lit(hop)))
    cut = df.select("*", t.alias("_t"), F.posexplode(starts).alias("win", "start"))
    piece = F.transform(F.col(x), lambda ch: F.slice(ch, F.col("start") + 1, length))
    return (cut.withColumn("pos", (F.col("start") + length / 2.0) / F.col("_t")).withColumn(x, piece).drop("_t"))


def crops(df: DataFrame, crop_len: int, n_crops: int, x: str = "x") -> DataFrame:
    """Evenly spaced crops, start = round-half-even of linspace(0, T − L, n)."""
    free = F.size(F.col(x)[0]) - crop_len
    step = free / F.lit(max(n_crops - 1, 1))
    starts = F.transform(F.sequence(F.lit(0), F.lit(n_crops - 1)), lambda k: F.bround(k * step, 0).cast("int"))
    cut = df.select("*", F.posexplode(starts).alias("crop", "start"))
    return cut.withColumn(x, F.transform(F.col(x), lambda ch: F.slice(ch, F.col("start") + 1, crop_len)))


def crop_average(df: DataFrame, key: str, probs: str) -> DataFrame:
    """Mean class probability over the crops of a trial, long form."""
    e = df.select(key, F.posexplode(probs).alias("cls", "p"))
    return e.groupBy(key, "cls").agg(F.avg("p").alias("p"))


def time_delay_embed(df: DataFrame, order: int, lag: int, x: str = "x") -> DataFrame:
    """Stack ``order`` lagged copies of every channel; no samples left raises."""
    n = F.size(F.col(x)[0]) - (order - 1) * lag
    checked = F.when(n > 0, n).otherwise(F.raise_error(F.lit("epoch too short to embed")).cast("int"))
    stacked = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(order - 1)), lambda k: F.transform(
        F.col(x), lambda ch: F.slice(ch, k * lag + 1, F.col("_len")))))
    return df.withColumn("_len", checked).withColumn(x, stacked).drop("_len")


def roll(a: str | Column, k: int) -> Column:
    """Circular shift to the right by k."""
    c = F.col(a) if isinstance(a, str) else a
    n = F.size(c)
    cut = F.pmod(n - F.lit(k), n)
    return F.concat(F.slice(c, cut + 1, n), F.slice(c, F.lit(1), cut))


def shift_fill(a: str | Column, k: int) -> Column:
    """Shift to the right by k, the head filled with the first value."""
    c = F.col(a) if isinstance(a, str) else a
    if k == 0:
        return c
    kept = F.greatest(F.size(c) - k, F.lit(0))
    return F.concat(F.array_repeat(c[0], F.least(F.lit(k), F.size(c))), F.slice(c, F.lit(1), kept))


# ---- class averages over time bins -----------------------------------------------------------------------------

def bin_edges(t: int, n_frames: int) -> list[int]:
    return np.linspace(0, t, n_frames + 1).astype(int).tolist()


def with_bin(df: DataFrame, t: int, n_frames: int) -> DataFrame:
    edges = bin_edges(t, n_frames)
    b = F.lit(0)
    for e in edges[1:-1]:
        b = b + (F.col("i") >= e).cast("int")
    return df.withColumn("bin", b)


def bin_centre(t: int, n_frames: int, fs: float, tmin: float = 0.0) -> Column:
    edges = bin_edges(t, n_frames)
    mids = [(a + b) / 2 / fs + tmin for a, b in zip(edges[:-1], edges[1:])]
    return F.element_at(F.array(*[F.lit(float(m)) for m in mids]), F.col("bin") + 1)


def class_trace(cells: DataFrame, value: Column) -> DataFrame:
    """Mean over epochs per (label, ch, i)."""
    return cells.groupBy("label", "ch", "i").agg(F.avg(value).alias("m"))


def frame_bins(cells: DataFrame, t: int, n_frames: int, fs: float, tmin: float = 0.0) -> DataFrame:
    m = with_bin(class_trace(cells, F.col("x")), t, n_frames)
    return (m.groupBy("label", "ch", "bin").agg(F.avg("m").alias("v"))
            .withColumn("time", bin_centre(t, n_frames, fs, tmin)))


def erd_frames(cells: DataFrame, t: int, n_frames: int, fs: float, baseline_s: float) -> DataFrame:
    """(power − base) / base of the class-mean power, averaged in bins."""
    p = class_trace(cells, F.col("x") * F.col("x"))
    w = W.partitionBy("label", "ch")
    base = F.avg(F.when(F.col("i") / fs < baseline_s, F.col("m"))).over(w) + 1e-20
    p = p.withColumn("_b", base).withColumn("e", (F.col("m") - F.col("_b")) / F.col("_b"))
    return with_bin(p, t, n_frames).groupBy("label", "ch", "bin").agg(F.avg("e").alias("v"))


def power_map_frames(cells: DataFrame, t: int, n_frames: int) -> DataFrame:
    """Log power per bin minus its mean over channels."""
    p = with_bin(class_trace(cells, F.col("x") * F.col("x")), t, n_frames)
    g = p.groupBy("label", "ch", "bin").agg(F.log(F.avg("m") + 1e-20).alias("lp"))
    return g.select("label", "ch", "bin", (F.col("lp") - F.avg("lp").over(W.partitionBy("label", "bin"))).alias("v"))


def example_waveform(epochs: DataFrame, n_t: int, order: list[str], x: str = "x") -> DataFrame:
    """First epoch of each class, every max(1, T // n_t)-th sample, long form."""
    first = epochs.groupBy("label").agg(F.min_by(x, F.struct(*order)).alias("x"))
    long = first.select("label", F.posexplode("x").alias("ch", "s"))
    long = long.select("label", "ch", F.size("s").alias("_t"), F.posexplode("s").alias("i", "v"))
    return long.filter(F.col("i") % F.greatest(F.lit(1), F.floor(F.col("_t") / n_t)) == 0).drop("_t")
