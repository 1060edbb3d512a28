"""Splits and folds as columns.

Train sets are never materialized: a row carries the fold that tests it, and everything else in that fold is train.
Random choices are ranks of an md5 hash, so they do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.functions.columns import hash_key
from trialframe.operators.ordinal import hash_ordinal, ordinal, range_bucket

KEY = ["epoch"]


def held_out(test_subjects=(), test_sessions=()) -> Column:
    return (F.col("subject").isin([str(s) for s in test_subjects])
            | F.col("session").isin([str(s) for s in test_sessions]))


def carve_size(n: Column, frac: float) -> Column:
    """max(1, round-half-even(n·frac))."""
    return F.greatest(F.lit(1), F.bround(n * frac, 0).cast("bigint"))


def val_carve(df: DataFrame, frac: float = 0.2, seed=0, key: list[str] = KEY) -> DataFrame:
    d = hash_ordinal(df, [], seed, key, "_pos", "_n")
    return d.withColumn("part", F.when(F.col("_pos") < carve_size(F.col("_n"), frac), "val").otherwise("train")
                        ).drop("_pos", "_n")


def make_split(df: DataFrame, test_subjects=(), test_sessions=(), val_subjects=(), val_frac: float = 0.2, seed=0,
               key: list[str] = KEY) -> DataFrame:
    """Add ``part``: test by subject or session, then val by subject or as a random share of the rest."""
    test = held_out(test_subjects, test_sessions)
    if val_subjects:
        val = F.col("subject").isin([str(s) for s in val_subjects])
        return df.withColumn("part", F.when(test, "test").when(val, "val").otherwise("train"))
    tagged = df.withColumn("_test", test)
    d = hash_ordinal(tagged, ["_test"], seed, key, "_pos", "_n")
    part = F.when(F.col("_test"), "test").when(F.col("_pos") < carve_size(F.col("_n"), val_frac), "val")
    return d.withColumn("part", part.otherwise("train")).drop("_test", "_pos", "_n")


def leave_one_subject_out(df: DataFrame) -> DataFrame:
    """One fold per subject with its sizes; the rows of a fold's train set are all rows of other subjects, so
    their number is total − own and no row is copied."""
    own = df.groupBy("subject").agg(F.count(F.lit(1)).alias("n_test"))
    total = df.agg(F.count(F.lit(1)).alias("_total")).scalar()
    return own.select(F.col("subject").alias("fold"), "n_test", (total - F.col("n_test")).alias("n_train"))


def fold_part(df: DataFrame, fold: str) -> DataFrame:
    """``part`` of every row in one leave-one-out fold."""
    return df.withColumn("part", F.when(F.col("subject") == fold, "test").otherwise("train"))


def subject_folds(df: DataFrame, k: int = 5, keys: list[str] | None = None, name: str = "fold") -> DataFrame:
    """Fold of each distinct subject: position in descending subject order modulo k."""
    keys = keys or []
    subjects = df.select(*keys, "subject").distinct()
    d = ordinal(subjects, keys, ["subject"], range_bucket(subjects, "subject"), "_pos", "_n")
    return d.select(*keys, "subject", ((F.col("_n") - 1 - F.col("_pos")) % k).cast("int").alias(name))


def grouped_kfold(df: DataFrame, k: int = 5) -> DataFrame:
    return df.join(subject_folds(df, k), "subject")


def within_subject(df: DataFrame, test_sessions=(), val_frac: float = 0.2, seed=0, key: list[str] = KEY) -> DataFrame:
    """Split every subject on its own, all in one pass: a session protocol or 20 % test, then val from the rest."""
    if test_sessions:
        tagged = df.withColumn("_test", F.col("session").isin(list(test_sessions)))
        d = hash_ordinal(tagged, ["subject", "_test"], seed, key, "_pos", "_n")
        part = F.when(F.col("_test"), "test").when(F.col("_pos") < carve_size(F.col("_n"), val_frac), "val")
        return d.withColumn("part", part.otherwise("train")).drop("_test", "_pos", "_n")
    d = hash_ordinal(df, ["subject"], seed, key, "_pos", "_n").withColumn("_nt", carve_size(F.col("_n"), 0.2))
    nv = carve_size(F.col("_n") - F.col("_nt"), val_frac)
    part = F.when(F.col("_pos") < F.col("_nt"), "test").when(F.col("_pos") < F.col("_nt") + nv, "val")
    return d.withColumn("part", part.otherwise("train")).drop("_pos", "_n", "_nt")


def stratified_kfold(df: DataFrame, k: int = 5, seed=0, label: str = "label_id", key: list[str] = KEY) -> DataFrame:
    d = hash_ordinal(df, [label], seed, key, "_pos")
    return d.withColumn("fold", ((F.col("_pos") + F.col(label)) % k).cast("int")).drop("_pos")


def stratified_group_kfold(df: DataFrame, group: str, label: str, k: int = 5, seeds=(0,)) -> DataFrame:
    """Whole groups per fold, for several seeds: groups sorted by the spread of their class counts are dealt out
    in snake order; ties are ordered by the seed's hash."""
    per_class = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("_c"))
    n_labels = df.select(label).distinct().agg(F.count(F.lit(1))).scalar()
    hist = per_class.groupBy(group).agg(F.sum("_c").alias("_s"), F.sum(F.col("_c") * F.col("_c")).alias("_q"))
    mean = F.col("_s") / n_labels
    spread = F.round(F.sqrt(F.greatest(F.col("_q") / n_labels - mean * mean, F.lit(0.0))), 6)
    dealt = hist.select(group, (-spread).alias("_spread"), F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))
    dealt = dealt.withColumn("_h", hash_key(F.col("seed"), group))
    d = ordinal(dealt, ["seed"], ["_spread", "_h"], F.floor(F.col("_spread") * 16), "_pos")
    within = F.col("_pos") % k
    even = F.floor(F.col("_pos") / k) % 2 == 0
    return d.select("seed", group, F.when(even, within).otherwise(k - 1 - within).cast("int").alias("fold"))


def stratified_calibration(df: DataFrame, frac: float, seed=0, label: str = "label_id",
                           key: list[str] = KEY) -> DataFrame:
    """Labelled calibration share per (subject, label), disjoint from the evaluation rows."""
    d = hash_ordinal(df, ["subject", label], seed, key, "_pos", "_n")
    cut = F.bround(F.col("_n") * frac, 0).cast("bigint")
    return d.withColumn("part", F.when(F.col("_pos") < cut, "calib").otherwise("eval")).drop("_pos", "_n")


def calibration_half(df: DataFrame, seed=0, key: list[str] = KEY) -> DataFrame:
    d = hash_ordinal(df, ["subject"], seed, key, "_pos", "_n")
    return d.withColumn("calib", F.col("_pos") < F.floor(F.col("_n") / 2)).drop("_pos", "_n")


def concept_holdout(df: DataFrame, concept: str = "concept", frac: float = 0.1, seed=0) -> DataFrame:
    """Part and dense id of each concept; max(1, int(frac·K)) concepts are held out for validation."""
    d = hash_ordinal(df.select(concept).distinct(), [], seed, [concept], "_pos", "_k")
    d = d.withColumn("part", F.when(F.col("_pos") < F.greatest(F.lit(1), F.floor(F.col("_k") * frac)), "val")
                     .otherwise("train")).select(concept, "part")
    return ordinal(d, ["part"], [concept], F.floor(F.col(concept) / 1024), "dense_id")


def concept_holdout_rows(df: DataFrame, concept: str = "concept", frac: float = 0.1, seed=0) -> DataFrame:
    """The rows with ``part`` and ``val_label``, the dense id of a held-out concept (null in the train part, where concepts keep their own
    ids). Rows without a concept are in neither part and go. Only the table of concepts is shuffled to be numbered."""
    parts = concept_holdout(df.filter(F.col(concept).isNotNull()), concept, frac, seed)
    label = F.when(F.col("part") == "val", F.col("dense_id")).alias("val_label")
    return df.join(parts.select(concept, "part", label), concept)


def folds_for(df: DataFrame, regime: str, k: int = 5, test_sessions=("s2",)) -> DataFrame:
    """Rows with ``fold`` (the fold that tests the row, or the subject's own fold) and ``part``."""
    if regime == "within":
        return within_subject(df, test_sessions).withColumn("fold", F.col("subject"))
    if regime == "cross_subject":
        return df.withColumn("fold", F.col("subject")).withColumn("part", F.lit("test"))
    if regime == "cross_subject_kfold":
        return grouped_kfold(df, k).withColumn("fold", F.col("fold").cast("string")).withColumn("part", F.lit("test"))
    raise ValueError(f"unknown regime {regime!r}")


def nested_group_folds(df: DataFrame, outer: int = 5, inner: int = 3) -> DataFrame:
    """(outer fold, train subject, inner fold): group folds again inside the train subjects of each outer fold."""
    own = subject_folds(df, outer, name="_own")
    train = (own.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(outer - 1))))
             .filter("fold <> _own").select("fold", "subject"))
    return subject_folds(train, inner, ["fold"], "inner_fold")
