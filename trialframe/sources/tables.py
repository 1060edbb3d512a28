"""Small readers: stimulus tables and run aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS_SCHEMA = "onset double, object string, stimname string, isteststim int, istarget int"
AGGREGATE_SCHEMA = ("method string, regime string, n_classes int, fold_mean struct<acc:double,kappa:double,ece:double>, "
                    "acc_mean double, kappa_mean double, ece_mean double, per_role_mean map<string,double>, "
                    "aggregation map<string,double>, complementarity map<string,double>")
# fixed values: regimes that can end a run name
REGIMES = ["cross_subject", "cross_session", "within"]


def read_events_tsv(spark: SparkSession, path: str, schema: str = EVENTS_SCHEMA) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


def read_run_aggregates(spark: SparkSession, path: str, files: str = "aggregate.json") -> DataFrame:
    """One row per run folder below ``path``, the folder name as ``run``; ``files`` is the name, or a pattern of names, of the JSON inside."""
    df = spark.read.schema(AGGREGATE_SCHEMA).option("multiLine", True).json(f"{path.rstrip('/')}/*/{files}")
    parts = F.split(F.col("_metadata.file_path"), "/")
    return df.select("*", F.url_decode(F.element_at(parts, -2)).alias("run"))


def split_run_name(run: str, datasets: list[str]) -> dict[str, Column]:
    """method, regime and dataset of <method>_<regime>_<dataset>; the dataset must be one of the given names."""
    known = "|".join(sorted(datasets, key=len, reverse=True)) or "$^"
    dataset = F.regexp_extract(run, f"({known})$", 1)
    stem = F.regexp_replace(F.col(run), f"_({known})$", "")
    tail = f"_?({'|'.join(REGIMES)})$"
    return {"method": F.regexp_replace(stem, tail, ""), "regime": F.regexp_extract(stem, tail, 1), "dataset": dataset}


def normalize_runs(df: DataFrame, datasets: list[str], digits: int = 4) -> DataFrame:
    """Both aggregate layouts as (run, method, regime, dataset, n_classes, acc, kappa, ece, extra map); a run without an
    accuracy is left out, and the complementarity map wins over the other two."""
    nested = F.col("fold_mean.acc").isNotNull()
    pick = lambda a, b: F.round(F.when(nested, F.col(f"fold_mean.{a}")).otherwise(F.col(b)), digits)
    empty = F.create_map().cast("map<string,double>")
    entries = F.flatten(F.array(*[F.map_entries(F.coalesce(F.col(c), empty)) for c in
                                  ("per_role_mean", "aggregation", "complementarity")]))
    merged = F.aggregate(entries, empty, lambda m, e: F.map_concat(
        F.map_filter(m, lambda k, v: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))))
    name = split_run_name("run", datasets)
    out = df.select("run", F.coalesce("method", name["method"]).alias("method"),
                    F.coalesce("regime", name["regime"]).alias("regime"), name["dataset"].alias("dataset"), "n_classes",
                    pick("acc", "acc_mean").alias("acc"), pick("kappa", "kappa_mean").alias("kappa"),
                    pick("ece", "ece_mean").alias("ece"),
                    F.transform_values(merged, lambda k, v: F.round(v, digits)).alias("extra"))
    return out.filter("acc IS NOT NULL")
