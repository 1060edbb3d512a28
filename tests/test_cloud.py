"""Files that a read of a few subjects opens."""

import pytest
from pyspark.sql import functions as F

from trialframe.sources import cloud


def scanned_files(df):
    """Number of files that the scan of a plan without shuffles opens."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    leaf = plan.collectLeaves().head()
    return leaf.metrics().apply("numFiles").value()


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cloud") / "t")
    rows = spark.range(20_000).select(F.lit("d").alias("dataset"), F.lit("k").alias("recipe"), F.format_string("sub-%05d", F.col("id") % 10_000).alias("subject"),
                                      F.lit("s").alias("session"), "id")
    cloud.build_cloud(rows, path)
    return path


def test_a_few_of_many_subjects_open_their_buckets_only(spark, table):
    assert cloud.table_buckets(spark, table) == 312
    every = cloud.load_cloud(spark, table, ["d"], "k")
    few = cloud.load_cloud(spark, table, ["d"], "k", ["sub-00007", "sub-05000", "sub-09999"])
    assert every.count() == 20_000 and "bucket" not in every.columns
    assert sorted(r["id"] for r in few.collect()) == [7, 5000, 9999, 10_007, 15_000, 19_999]
    assert scanned_files(few) <= 3 < 300 < scanned_files(every)
    assert cloud.load_cloud(spark, table, ["d"], "k", []).count() == 0
    assert cloud.load_cloud(spark, table, ["d"], "k", ["nobody"]).count() == 0
    assert cloud.load_cloud(spark, table, ["other"], "k", ["sub-00007"]).count() == 0


def test_long_lists_join_and_later_writes_keep_the_layout(spark, table, monkeypatch):
    monkeypatch.setattr(cloud, "NAMED_SUBJECTS", 2)
    names = [f"sub-{i:05d}" for i in range(0, 10_000, 500)]
    assert cloud.load_cloud(spark, table, ["d"], "k", names).count() == 2 * len(names)
    more = spark.createDataFrame([("d", "k", "new", "s", -1), ("d", "k", "sub-00007", "s", -2)], "dataset string, recipe string, subject string, session string, id long")
    assert cloud.build_cloud(more, table).count() == 20_001  # sub-00007 is there already
    assert [r["id"] for r in cloud.load_cloud(spark, table, ["d"], "k", ["new"]).collect()] == [-1]
    assert cloud.build_cloud(more, table, rebuild=True).count() == 20_000
    assert [r["id"] for r in cloud.load_cloud(spark, table, ["d"], "k", ["sub-00007"]).collect()] == [-2]
    assert cloud.table_buckets(spark, table) == 312
