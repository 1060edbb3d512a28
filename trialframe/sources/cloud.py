"""The epoch table: one row per epoch, partitioned by dataset and recipe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

META = ["dataset", "subject", "session", "run", "label_id", "label", "epoch"]


def _part(v: str | Column) -> Column:
    c = F.col(v) if isinstance(v, str) else v
    return F.replace(F.replace(c.cast("string"), F.lit("."), F.lit("p")), F.lit("-"), F.lit("m"))


def recipe_key(fmin, fmax, tmin, tmax, resample) -> Column:
    """b<fmin>-<fmax>_t<tmin>-<tmax|full>_r<rate>, with . as p and − as m."""
    return F.concat(F.lit("b"), _part(fmin), F.lit("-"), _part(fmax), F.lit("_t"), _part(tmin), F.lit("-"),
                    F.coalesce(_part(tmax), F.lit("full")), F.lit("_r"), _part(resample))


def haemo_recipe_key(l_freq, h_freq, tmin, tmax, resample, cleaners: list[str] | str | None) -> Column:
    """As recipe_key for the slow modality: a native rate and the cleaner names joined by +."""
    names = [cleaners] if isinstance(cleaners, str) else list(cleaners or [])
    return F.concat(F.lit("b"), _part(l_freq), F.lit("-"), _part(h_freq), F.lit("_t"), _part(tmin), F.lit("-"), _part(tmax),
                    F.lit("_r"), F.coalesce(_part(resample), F.lit("native")), F.lit("_c"), F.lit("+".join(names) or "none"))


#: Subjects of a bucket, and the limits of the number of buckets.
BUCKET_SUBJECTS, FEWEST_BUCKETS, MOST_BUCKETS = 32, 16, 4096
#: Subjects that a read names in its filter; a longer list is joined.
NAMED_SUBJECTS = 1000


def subject_bucket(buckets: int = FEWEST_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.col("subject").cast("string")), F.lit(buckets)).cast("int")


def write_epochs(df: DataFrame, path: str, mode: str = "append", buckets: int = FEWEST_BUCKETS) -> None:
    """Partitioned by dataset, recipe and a subject bucket, so a read of a few subjects opens few files; inside a file rows are
    sorted by subject, so that its row groups can be skipped too. The rebalance hint lets AQE cut a bucket that holds a very large
    subject into files of even size and merge small ones."""
    keyed = df.withColumn("bucket", subject_bucket(buckets)).hint("rebalance", "dataset", "recipe", "bucket")
    (keyed.sortWithinPartitions("dataset", "recipe", "bucket", "subject").write.mode(mode)
     .option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "recipe", "bucket").parquet(path))


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def table_buckets(spark: SparkSession, path: str, epochs: DataFrame | None = None) -> int:
    """Number of subject buckets of the table. A new table gets it from the number of subjects in ``epochs`` and keeps it in
    ``_layout``; one without that note has the fewest."""
    note = _read(spark, f"{path.rstrip('/')}/_layout")
    if note is not None:
        return note.head()["buckets"]
    if epochs is None or _read(spark, path) is not None:
        return FEWEST_BUCKETS
    subjects = epochs.select("subject").distinct().count()
    buckets = min(MOST_BUCKETS, max(FEWEST_BUCKETS, subjects // BUCKET_SUBJECTS))
    spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/_layout")
    return buckets


def load_cloud(spark: SparkSession, path: str, datasets: list[str], recipe: str, subjects: list | None = None) -> DataFrame:
    """Epoch rows of several datasets under one recipe, of all or of the named subjects. Dataset, recipe and the buckets of
    the subjects prune partitions, so only their files are opened."""
    df = spark.read.parquet(path)
    df = df.filter(F.col("dataset").isin(list(datasets)) & (F.col("recipe") == recipe))
    if subjects is not None:
        names = sorted({str(s) for s in subjects})
        if not names:
            return df.filter("false").drop("bucket")
        wanted = spark.createDataFrame([(n,) for n in names], "subject string")
        found = wanted.select(subject_bucket(table_buckets(spark, path)).alias("b")).distinct().collect()
        df = df.filter(F.col("bucket").isin([r["b"] for r in found]))
        name = F.col("subject").cast("string")
        df = df.filter(name.isin(names)) if len(names) <= NAMED_SUBJECTS else df.join(wanted.withColumnRenamed("subject", "_s"), name == F.col("_s"), "left_semi")
    return df.drop("bucket")


def build_cloud(epochs: DataFrame, path: str, rebuild: bool = False) -> DataFrame:
    """Write the (dataset, recipe, subject) groups that the table lacks, or all of them when rebuilding; returns the
    table. The subjects on disk come from the partition columns and one pruned column. A rebuild replaces whole partitions, so
    the rows of other subjects in them are carried over."""
    spark = epochs.sparkSession
    buckets, old = table_buckets(spark, path, epochs), _read(spark, path)
    if old is not None and rebuild:
        keys = ["dataset", "recipe", "subject"]
        new = epochs.select(*keys).distinct()
        touched = new.withColumn("bucket", subject_bucket(buckets)).select("dataset", "recipe", "bucket").distinct()
        others = old.join(touched, ["dataset", "recipe", "bucket"], "left_semi").join(new, keys, "left_anti")
        epochs = epochs.unionByName(others.select(*epochs.columns))
    elif old is not None:
        have = old.select("dataset", "recipe", F.col("subject")).distinct()
        epochs = epochs.join(have, ["dataset", "recipe", "subject"], "left_anti")
    write_epochs(epochs, path, "overwrite" if rebuild else "append", buckets)
    return spark.read.parquet(path).drop("bucket")


def feature_cache(spark: SparkSession, path: str, wanted: DataFrame, key: list[str], compute) -> DataFrame:
    """Features for every key of ``wanted``: rows already cached are reused, ``compute(missing)`` fills the holes."""
    old = _read(spark, path)
    missing = wanted if old is None else wanted.join(old.select(*key).distinct(), key, "left_anti")
    compute(missing).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(wanted.select(*key).distinct(), key, "left_semi")


def subject_manifest(views: DataFrame) -> DataFrame:
    """Subjects per modality, sorted."""
    return views.groupBy("modality").agg(F.sort_array(F.collect_set("subject")).alias("subjects"))


def write_view_json(df: DataFrame, path: str, buckets: int = 16) -> DataFrame:
    """View rows as JSON lines by modality and subject bucket; returns the manifest of what is on disk. The given subjects'
    rows are replaced, those of other subjects in the same partitions carried over."""
    keyed = df.withColumn("bucket", subject_bucket(buckets))
    try:
        old = df.sparkSession.read.schema(keyed.schema).json(path)
    except AnalysisException:
        old = None
    if old is not None:
        touched = keyed.select("modality", "bucket").distinct()
        others = old.join(touched, ["modality", "bucket"], "left_semi").join(keyed.select("modality", "subject").distinct(), ["modality", "subject"], "left_anti")
        keyed = keyed.unionByName(others.select(*keyed.columns))
    (keyed.hint("rebalance", "modality", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("modality", "bucket").json(path))
    return subject_manifest(df.sparkSession.read.schema(keyed.schema).json(path).select("modality", "subject").distinct())
