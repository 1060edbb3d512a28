"""Epoching and standardization of live sample streams; each equals its batch operator on the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from trialframe.functions import kernels


def stream_epochs(samples: DataFrame, events: DataFrame, fs: float, tmin: float, tmax: float,
                  late: str = "0 seconds") -> DataFrame:
    """Event-locked windows from two streams: ``samples(rec, t, at, c)`` and ``events(rec, event, onset, onset_at,
    label)`` with event times ``at`` and ``onset_at``.

    The streams meet in an interval join per (rec, time bucket); a window is emitted when the watermark passes it, rows
    later than the watermark are dropped, and a window with missing samples is discarded like one off the recording.
    """
    a, b = round(tmin * fs), round(tmax * fs)
    n = b - a
    lo, hi = F.col("onset") + a, F.col("onset") + b
    ev = events.withWatermark("onset_at", late).withColumn(
        "_b", F.explode(F.sequence(F.floor(lo / n), F.floor((hi - 1) / n))))
    sm = samples.withWatermark("at", late).withColumnRenamed("rec", "_r").withColumn("_sb", F.floor(F.col("t") / n))
    first, last = f"onset_at + interval {a / fs} seconds", f"onset_at + interval {b / fs} seconds"
    on = (F.col("rec") == F.col("_r")) & (F.col("_b") == F.col("_sb"))
    on = on & F.expr(f"at >= {first} AND at < {last}") & (F.col("t") >= lo) & (F.col("t") < hi)
    g = ev.join(sm, on).groupBy("rec", "event", "onset", "label", "onset_at").agg(
        F.sort_array(F.collect_list(F.struct("t", "c"))).alias("s"))
    g = g.filter(F.size("s") == n)
    channels = F.sequence(F.lit(0), F.size(F.col("s")[0]["c"]) - 1)
    return g.select("rec", "event", "onset", "label",
                    F.transform(channels, lambda k: F.transform("s", lambda e: e["c"][k])).alias("x"))


def _short(held: list[float], eps: float) -> pd.DataFrame:
    """The standardized samples of a recording that ended within its start-up window."""
    head = np.array(held, dtype=float)
    return pd.DataFrame({"t": np.arange(len(head)), "z": (head - head.mean()) / max(eps, head.std())})


def stream_standardize(samples: DataFrame, order: list[str], value: str, factor: float = 1e-3, init: int = 1000,
                       eps: float = 1e-4, at: str | None = None, idle: float = 60.0, late: str = "0 seconds") -> DataFrame:
    """Exponential moving standardization per recording: (rec, t, z). The state is the sample count, the two weighted
    sums and, until ``init`` samples have come, those samples. Samples of a recording must arrive in order across
    micro-batches; inside one they are sorted.

    A recording shorter than ``init`` is standardized when it is known to be over: with event times ``at``, when the watermark
    passes its last sample by ``idle`` seconds (its state goes then, rows later than the watermark are dropped); else, or
    when the input ends before that, by ``unfinished``.
    """
    q = 1.0 - factor
    rec_type = samples.schema["rec"].dataType.simpleString()
    if at is not None:
        samples = samples.withWatermark(at, late).withColumn("_ms", F.unix_millis(at))

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, _, _, held = state.get
            state.remove()
            if n < init:
                yield _short(held, eps).assign(rec=key[0])[["rec", "t", "z"]]
            return
        pdf = pd.concat(list(batches)).sort_values(order)
        n, s, sq, held = state.get if state.exists else (0, 0.0, 0.0, [])
        held = list(held)
        v = pdf[value].to_numpy(dtype=float)
        t = n + np.arange(len(v))
        w = (1.0 - q ** (t + 1.0)) / (1.0 - q)
        sums = kernels.ewm_sums(v, q, s)
        d = v - sums / w
        squares = kernels.ewm_sums(d * d, q, sq)
        z = d / np.maximum(eps, np.sqrt(squares / w))
        head = held + v[: max(0, init - n)].tolist() if n < init else []
        state.update((n + len(v), float(sums[-1]), float(squares[-1]), head if n + len(v) < init else []))
        if at is not None:
            over = int(pdf["_ms"].max()) + round(1000 * idle)
            state.setTimeoutTimestamp(max(over, state.getCurrentWatermarkMs() + 1))
        keep = t >= init
        out = [pd.DataFrame({"t": t[keep], "z": z[keep]})]
        if n < init <= n + len(v):
            out.insert(0, _short(head, eps))
        yield pd.concat(out).assign(rec=key[0])[["rec", "t", "z"]]

    timeout = GroupStateTimeout.NoTimeout if at is None else GroupStateTimeout.EventTimeTimeout
    return samples.groupBy("rec").applyInPandasWithState(
        step, f"rec {rec_type}, t bigint, z double", "n bigint, s double, q double, held array<double>", "append", timeout)


def unfinished(spark: SparkSession, progress: str, init: int = 1000, eps: float = 1e-4) -> DataFrame:
    """(rec, t, z) of the recordings that a stopped ``stream_standardize`` still holds, from the state in its checkpoint folder: those
    whose input ended within the start-up window. The state stays, so only a stream that isn't resumed is finished by this."""
    held = (spark.read.format("statestore").load(progress)
            .select("key.rec", F.col("value.groupState.n").alias("n"), F.col("value.groupState.held").alias("held")).filter(F.col("n") < init))
    n = F.size("held")
    mean = F.aggregate("held", F.lit(0.0), lambda a, x: a + x) / n
    sd = F.sqrt(F.aggregate("held", F.lit(0.0), lambda a, x: a + (x - F.col("_m")) * (x - F.col("_m"))) / n)
    e = held.withColumn("_m", mean).withColumn("_sd", F.greatest(F.lit(eps), sd))
    return (e.select("rec", "_m", "_sd", F.posexplode("held").alias("t", "x"))
            .select("rec", F.col("t").cast("bigint").alias("t"), ((F.col("x") - F.col("_m")) / F.col("_sd")).alias("z")))


def run_to_table(stream: DataFrame, path: str) -> DataFrame:
    """Drain a stream into a Parquet table (exactly once through its checkpoint) and return the table."""
    q = (stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-progress").outputMode("append")
         .trigger(availableNow=True).start(path))
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
