"""Filters, label maps and concept names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.functions.columns import col
from trialframe.operators.ordinal import ordinal


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])


def filter_criteria(df: DataFrame, subjects=(), sessions=()) -> DataFrame:
    """Rows of the listed subjects or sessions. A DataFrame instead of a list of subjects is matched by a join."""
    if isinstance(subjects, DataFrame):
        listed = subjects.select("subject").distinct().withColumn("_listed", F.lit(True))
        in_session = F.col("session").isin([str(s) for s in sessions]) if sessions else F.lit(False)
        return df.join(listed, "subject", "left").filter(F.col("_listed") | in_session).select(*df.columns)
    return df.filter(F.col("subject").isin([str(s) for s in subjects])
                     | F.col("session").isin([str(s) for s in sessions]))


def remap_labels(df: DataFrame, label_map: dict[str, int], source: str = "label",
                 target: str = "label_id") -> DataFrame:
    """Source name to canonical id; a name outside the map raises."""
    unknown = F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(F.col(source), F.lit("NULL")))).cast("int")
    return df.withColumn(target, F.coalesce(F.try_element_at(literal_map(label_map), F.col(source)), unknown))


def id_to_name(df: DataFrame, names: dict[int, str], source: str = "label_id", target: str = "name") -> DataFrame:
    return df.withColumn(target, F.coalesce(F.try_element_at(literal_map(names), F.col(source)),
                                            F.col(source).cast("string")))


def marker_filter(df: DataFrame, name: str = "marker") -> DataFrame:
    """Block-level markers only; the class is the first word."""
    return df.filter(F.col(name).contains("session")).withColumn("cls", F.split(name, " ")[0])


def event_mask(df: DataFrame, drop_targets: bool = True, include_validation: bool = False) -> DataFrame:
    """Drop target and validation stimuli; a missing flag column keeps everything."""
    if drop_targets and "istarget" in df.columns:
        df = df.filter(F.col("istarget") == 0)
    if not include_validation and "isteststim" in df.columns:
        df = df.filter(F.col("isteststim") == 0)
    return df


def restrict_classes(df: DataFrame, a, b, label: str = "label_id") -> DataFrame:
    return df.filter(F.col(label).isin(a, b)).withColumn("binary", (F.col(label) == b).cast("int"))


def series_session(df: DataFrame, bucket: Column, per: int = 9, order=("ts", "epoch")) -> DataFrame:
    """Chronological index of the series within the subject, cut in sessions of ``per``."""
    return (ordinal(df, ["subject"], list(order), bucket, "_series")
            .withColumn("series_session", F.floor(F.col("_series") / per)).drop("_series"))


def holdout_concepts(df: DataFrame, holdout: DataFrame, name: str = "name") -> DataFrame:
    return df.join(holdout.select(name).distinct(), name, "left_anti")


def bare_name(name: str | Column) -> Column:
    """Concept name without a five-digit prefix."""
    return F.regexp_replace(col(name), "^[0-9]{5}_", "")


def holdout_sets_disjoint(a: DataFrame, b: DataFrame, name: str = "name", strict: bool = False) -> DataFrame:
    """Sizes of two concept sets and their overlap by bare name, in one pass over the union."""
    tagged = (a.select(bare_name(name).alias("n"), F.lit(1).alias("a"), F.lit(0).alias("b"))
              .unionByName(b.select(bare_name(name).alias("n"), F.lit(0).alias("a"), F.lit(1).alias("b"))))
    per_name = tagged.groupBy("n").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    out = per_name.agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.col("a") * F.col("b")).alias("overlap"))
    if strict:
        out = out.withColumn("overlap", F.when(F.col("overlap") > 0, F.raise_error(F.lit("concept sets overlap"))
                                               .cast("bigint")).otherwise(F.col("overlap")))
    return out


def concept_index(name: str | Column) -> Column:
    return (F.substring(col(name), 1, 5).cast("int") - 1)


def n_classes(df: DataFrame, label: str = "label_id") -> DataFrame:
    return df.agg((F.max(label) + 1).alias("n_classes"))


def dense_ids(df: DataFrame, value: str, bucket: Column, name: str = "dense_id") -> DataFrame:
    """0-based rank of each row's value among the sorted distinct values (numbered on the distinct set only)."""
    ids = ordinal(df.select(value).distinct(), [], [value], bucket, name)
    return df.join(ids, value)


def profile_counts(df: DataFrame, by: list[str], distinct: tuple[str, ...] = (), sets: tuple[str, ...] = ()) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.count_distinct(c).alias(f"n_{c}") for c in distinct]
    aggs += [F.concat_ws(",", F.sort_array(F.collect_set(c))).alias(f"{c}_set") for c in sets]
    return df.groupBy(*by).agg(*aggs)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, conditions)
