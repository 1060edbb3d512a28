"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.session import fresh_table_path

#: Runs of anything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

#: A side with at most so many rows is shipped to every task; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000


#: Where the tables of ``stored`` are, and those written since the innermost ``only_stored`` began.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_WRITTEN: ContextVar[list[str]] = ContextVar("written")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to a new table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_table_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    _WRITTEN.get([]).append(path)
    return out


def only_stored(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``make()`` stored. The tables that were stored on the way to it are deleted, so only what ``make`` returns may read them."""
    written: list[str] = []
    before = _WRITTEN.set(written)
    try:
        out = stored(make(), name)
    finally:
        _WRITTEN.reset(before)
    _WRITTEN.get([]).append(_PATHS[out])
    _delete(out.sparkSession, [path for path in written if path != _PATHS[out]])
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing will read any more; other data frames are left alone."""
    for table in tables:
        if table in _PATHS:
            _delete(table.sparkSession, [_PATHS.pop(table)])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    sc = spark.sparkContext
    for path in (sc._jvm.org.apache.hadoop.fs.Path(p) for p in paths):
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint when it has at most ``limit`` rows, else as it is (the join then shuffles)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
