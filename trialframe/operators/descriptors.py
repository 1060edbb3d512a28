"""Shape descriptors of a channel within an epoch, all families at once.

``extract_bank`` aggregates long input: key columns, ``i`` (0-based sample) and ``x``. ``array_bank`` and ``window_bank`` take
epochs as arrays (channel x time) and compute inside the batch that holds them, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from trialframe.functions import shapes

# the families in the order of this library's columns, and the subsets compared as recipes
FAMILIES = ["mean", "variance", "min", "max", "range", "auc", "final", "peak", "time_to_peak", "skew", "kurtosis",
            "zero_crossings", "slope", "early_slope", "late_slope"]
RECIPES = {
    "full": FAMILIES,
    "amplitude": ["mean", "slope", "peak"],
    "slope_only": ["slope"],
    "dynamics": ["slope", "early_slope", "late_slope"],
    "mean_only": ["mean"],
    "peak_only": ["peak"],
    "all_but_slope": [f for f in FAMILIES if f != "slope"],
}

#: Samples that a task describes at once.
SAMPLES = 2_000_000


def _definitions() -> dict[str, Column]:
    I, X, T = F.col("i"), F.col("x"), F.col("_t")
    crossing = F.col("_flip")
    first_peak = F.struct(F.abs(X), -I)
    half = F.floor(T / 2)
    return {
        "mean": F.avg(X),
        "variance": F.var_pop(X),
        "min": F.min(X),
        "max": F.max(X),
        "range": F.max(X) - F.min(X),
        "auc": F.sum(X) - (F.min_by(X, I) + F.max_by(X, I)) / 2.0,
        "final": F.avg(F.when(I >= T - F.greatest(F.lit(1), F.floor(T / 10)), X)),
        "peak": F.max_by(X, first_peak),
        "time_to_peak": F.max_by(I, first_peak) / F.max(T),
        "skew": F.coalesce(F.skewness(X), F.lit(0.0)),
        "kurtosis": F.coalesce(F.kurtosis(X), F.lit(0.0)),
        "zero_crossings": F.sum(crossing).cast("double"),
        "slope": F.regr_slope(X, I),
        "early_slope": F.regr_slope(F.when(I < half, X), I),
        "late_slope": F.regr_slope(F.when(I >= half, X), I),
    }


def extract_bank(cells: DataFrame, keys: list[str], families: list[str] | None = None) -> DataFrame:
    """One row per channel with one column per family. The window and the grouping share one shuffle."""
    chosen = families or FAMILIES
    unknown = set(chosen) - set(FAMILIES)
    if unknown:
        raise ValueError(f"unknown families: {sorted(unknown)}")
    w = W.partitionBy(*keys)
    d = cells.withColumn("_t", F.count(F.lit(1)).over(w))
    if "zero_crossings" in chosen:
        negative = F.col("x") < 0
        flip = F.coalesce((negative != F.lag(negative).over(w.orderBy("i"))).cast("int"), F.lit(0))
        d = d.withColumn("_flip", flip)
    defs = _definitions()
    return d.groupBy(*keys).agg(*[defs[f].alias(f) for f in chosen])


def to_long(bank: DataFrame, keys: list[str], families: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("family"), F.col(f).cast("double").alias("f")) for f in families])
    return bank.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.family", "p.f")


def amplitude_features(cells: DataFrame, keys: list[str]) -> DataFrame:
    return extract_bank(cells, keys, RECIPES["amplitude"])


def select_recipe(features: DataFrame, recipe: str) -> DataFrame:
    if recipe not in RECIPES:
        raise ValueError(f"unknown recipe {recipe!r}")
    return features.filter(F.col("family").isin(RECIPES[recipe]))


def _epochs_at_a_time(b: pa.RecordBatch, x: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``SAMPLES`` samples; one epoch at least."""
    per_row = max(1, b.column(x).nbytes // 8 // max(1, b.num_rows))
    step = max(1, SAMPLES // per_row)
    for at in range(0, b.num_rows, step):
        yield b.slice(at, step)


def _described(epochs: pa.ListArray, families: list[str], length: int | None, hop: int) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """Row of the epoch, window and bank (channel x family) of every window of ``epochs`` (channel x time)."""
    n_ch = pc.fill_null(pc.list_value_length(epochs), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    series = epochs.flatten()
    n = pc.fill_null(pc.list_value_length(series), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = series.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    first = np.cumsum(n) - n
    epoch = np.repeat(np.arange(len(n_ch)), n_ch)
    channel = np.arange(len(epoch)) - np.repeat(np.cumsum(n_ch) - n_ch, n_ch)
    n_win = np.ones(len(n_ch), np.int64)
    if length is not None:
        n_win[:] = 0
        np.maximum.at(n_win, epoch, 1 + np.maximum(0, n - length) // hop)
    n_win[n_ch == 0] = 0
    base = np.cumsum(n_win * n_ch) - n_win * n_ch
    out = np.full((int((n_win * n_ch).sum()), len(families)), np.nan)
    for size in np.unique(n):
        own = np.nonzero(n == size)[0]
        x = values[first[own][:, None] + np.arange(size)]
        win = x[:, None, :] if length is None else shapes.windows(x, length, hop)
        place = base[epoch[own]][:, None] + np.arange(win.shape[1]) * n_ch[epoch[own]][:, None] + channel[own][:, None]
        out[place] = shapes.describe(win, families)
    rows = np.repeat(np.arange(len(n_ch)), n_win)
    ends = lambda k: pa.array(np.concatenate([[0], np.cumsum(k)]), pa.int32())
    cells = pa.ListArray.from_arrays(ends(np.full(len(out), len(families))), pa.array(out.ravel(), pa.float64(), from_pandas=True))
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(n_win) - n_win, n_win), pa.ListArray.from_arrays(ends(n_ch[rows]), cells)


def _array_form(df: DataFrame, keys: list[str], families: list[str], x: str, length: int | None, hop: int) -> DataFrame:
    unknown = set(families) - set(FAMILIES)
    if unknown:
        raise ValueError(f"unknown families: {sorted(unknown)}")
    rows = df.select(*keys, F.col(x).cast("array<array<double>>").alias("_x"))
    extra = [StructField("win", IntegerType())] if length is not None else []
    schema = StructType([*rows.schema.fields[:-1], *extra, StructField("bank", ArrayType(ArrayType(DoubleType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _epochs_at_a_time(batch, len(keys)):
                at, win, bank = _described(b.column(len(keys)), families, length, hop)
                columns = [c.take(pa.array(at)) for c in b.columns[:-1]] + ([pa.array(win, pa.int32())] if length is not None else []) + [bank]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def array_bank(df: DataFrame, keys: list[str], families: list[str] | None = None, x: str = "x") -> DataFrame:
    """keys and ``bank`` (channel x family) of every epoch; equal to ``extract_bank`` of its samples. A null or NaN sample is
    missing, an undefined descriptor null; an epoch that is null or has no channels gives no row."""
    return _array_form(df, keys, families or FAMILIES, x, None, 1)


def window_bank(df: DataFrame, keys: list[str], length: int, hop: int, families: list[str], x: str = "x") -> DataFrame:
    """keys, ``win`` and ``bank`` of every sliding window of ``length`` samples, ``hop`` apart; a series that isn't longer than a
    window is one. Windows are views of the epoch's array. Of channels of unequal length the shorter ones have null descriptors
    in the windows they lack."""
    if length < 1 or hop < 1:
        raise ValueError("window length and hop are at least one sample")
    return _array_form(df, keys, families, x, length, hop)


def bank_cells(bank: DataFrame, keys: list[str], families: list[str]) -> DataFrame:
    """One row per key and channel ``ch`` with one column per family."""
    cells = bank.select(*keys, F.posexplode("bank").alias("ch", "_d"))
    return cells.select(*keys, "ch", *[F.col("_d")[k].alias(f) for k, f in enumerate(families)])


def bank_vector(bank: str | Column = "bank") -> Column:
    """The bank as one vector, channel by channel; undefined descriptors are 0."""
    b = F.col(bank) if isinstance(bank, str) else bank
    return F.transform(F.flatten(b), lambda d: F.coalesce(d, F.lit(0.0)))
