"""Joins and set operations over trial tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trialframe.operators.ordinal import ordinal


def gather(meta: DataFrame, signals: DataFrame, keys: list[str]) -> DataFrame:
    """Attach signals to metadata rows; the row order travels as a column of ``meta``. Empty metadata raises."""
    if meta.isEmpty():
        raise ValueError("no rows to gather")
    return meta.join(signals, keys)


def gather_aligned(a: DataFrame, b: DataFrame, bucket: Column, order: list[str], label: str = "label",
                   strict: bool = False) -> DataFrame:
    """Pair the blocks of two modalities by position within the subject; a row without partner or with another
    label is a mismatch (``ok`` = false), or an error when strict."""
    pa = ordinal(a, ["subject"], order, bucket, "seq").select("subject", "seq", F.col(label).alias("label_a"))
    pb = ordinal(b, ["subject"], order, bucket, "seq").select("subject", "seq", F.col(label).alias("label_b"))
    both = pa.join(pb, ["subject", "seq"], "full_outer")
    ok = F.coalesce(F.col("label_a") == F.col("label_b"), F.lit(False))
    if strict:
        ok = F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("modalities misaligned")).cast("boolean"))
    return both.withColumn("ok", ok)


def paired_subjects(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("subject").intersect(b.select("subject"))


def embedding_lookup(trials: DataFrame, by_file: DataFrame, key: str, value: str, order: str,
                     strict: bool = True) -> DataFrame:
    """Vector per trial by base name; among duplicates the last wins; a missing key raises."""
    bank = by_file.groupBy(key).agg(F.max_by(value, order).alias("_vec"))
    out = trials.join(bank, key, "left")
    vec = F.col("_vec")
    if strict:
        missing = F.raise_error(F.concat(F.lit("no vector for "), F.col(key)))
        vec = F.when(vec.isNotNull(), vec).otherwise(missing.cast(bank.schema["_vec"].dataType))
    return out.withColumn(value, vec).drop("_vec")


def union_prototypes(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """Name to prototype over two sets; the second wins."""
    tagged = first.select(key, value, F.lit(0).alias("_p")).unionByName(second.select(key, value, F.lit(1).alias("_p")))
    return tagged.groupBy(key).agg(F.max_by(value, "_p").alias(value))


def channel_positions(source: list[str], target: list[str]) -> list[int]:
    missing = [t for t in target if t not in source]
    if missing:
        raise ValueError(f"missing channels: {missing}")
    return [source.index(t) for t in target]


def align_channels(df: DataFrame, source: list[str], target: list[str], x: str = "x") -> DataFrame:
    """Reorder and drop channels of the nested array by name."""
    return df.withColumn(x, F.array(*[F.col(x)[i] for i in channel_positions(source, target)]))


def common_channels(a: DataFrame, b: DataFrame) -> DataFrame:
    """Channels of both tables with a's position."""
    return a.select("name", "pos").join(b.select("name").distinct(), "name", "left_semi")


def upsert_run(runs: DataFrame, new: DataFrame) -> DataFrame:
    return runs.join(new.select("run"), "run", "left_anti").unionByName(new)


def compare_to_ceiling(runs: DataFrame, ceilings: DataFrame) -> DataFrame:
    """Gap to the ceiling of the same method, else ``sota``, else the first one listed."""
    c = ceilings.select("dataset", "regime", F.col("method").alias("bar"), F.col("acc").alias("bar_acc"), "ordinal")
    j = runs.join(c, ["dataset", "regime"], "left")
    rank = F.struct(F.when(F.col("bar") == F.col("method"), 0).when(F.col("bar") == "sota", 1).otherwise(2),
                    F.col("ordinal"))
    best = j.groupBy("run", "method", "regime", "dataset", "acc").agg(
        F.min_by(F.struct("bar", "bar_acc"), rank).alias("b"))
    return best.select("run", "acc", F.coalesce(F.col("b.bar"), F.lit("no reference")).alias("bar"),
                       F.col("b.bar_acc").alias("bar_acc"), (F.col("acc") - F.col("b.bar_acc")).alias("gap"))


def run_gap(runs: DataFrame, by: list[str], arm: str, a, b, value: str = "acc") -> DataFrame:
    """value(a) − value(b) for every group, by conditional aggregation instead of a self-join."""
    pick = lambda v: F.max(F.when(F.col(arm) == v, F.col(value)))
    return runs.groupBy(*by).agg(pick(a).alias("value_a"), pick(b).alias("value_b")).withColumn(
        "gap", F.col("value_a") - F.col("value_b"))


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)
