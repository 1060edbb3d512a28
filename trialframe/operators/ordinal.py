"""Row positions inside groups of any size.

A plain ``row_number() over (partition by subject …)`` puts a whole subject in one task. Here every group is cut
along a bucket that rises with the order (a day, a hash prefix, a range of sample numbers): rows are numbered inside
(group, bucket), bucket sizes are counted with map-side partial sums, and the running total of the sizes is joined
back. The result does not depend on the bucket width; only the size of the largest task does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialframe.functions.columns import col, hash_key

HASH_BUCKET_CHARS = 3          # 16^3 = 4096 buckets per group

#: Rows of a range bucket, buckets at most (beyond, buckets hold more rows), sampled values per bucket, characters of a splitter.
RANGE_ROWS, RANGE_BUCKETS, RANGE_SAMPLE, SPLITTER_CHARS = 4096, 1024, 32, 256


def ordinal(df: DataFrame, keys: list[str], order: list[str | Column], bucket: Column, name: str = "pos",
            size: str | None = None) -> DataFrame:
    """Add ``name`` = 0-based position of the row in its group (and ``size`` = rows of the group).

    ``bucket`` must not fall while ``order`` rises. With no keys the position is global.
    """
    tagged = df.withColumn("_bucket", bucket)
    ranked = tagged.withColumn("_local", F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order)))
    sizes = tagged.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                           F.col("_bucket").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    group = [f"_k{i}" for i in range(len(keys))] or [F.lit(1)]
    prior = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(prior), F.lit(0)))
    if size:
        offsets = offsets.withColumn("_total", F.sum("_n").over(W.partitionBy(*group)))
    on = [ranked[k].eqNullSafe(offsets[f"_k{i}"]) for i, k in enumerate(keys)]
    on.append(ranked["_bucket"].eqNullSafe(offsets["_b"]))
    out = ranked.join(offsets, reduce(lambda a, b: a & b, on))
    extra = [F.col("_total").alias(size)] if size else []
    return out.select(*[ranked[c] for c in df.columns], (F.col("_local") + F.col("_before") - 1).alias(name), *extra)


def hash_ordinal(df: DataFrame, keys: list[str], seed, by: list[str], name: str = "pos",
                 size: str | None = None) -> DataFrame:
    """Position in a deterministic shuffle of each group; the hash prefix is the bucket, so tasks are even."""
    hashed = df.withColumn("_h", hash_key(seed, *by))
    return ordinal(hashed, keys, ["_h"], F.substring("_h", 1, HASH_BUCKET_CHARS), name, size).drop("_h")


def range_bucket(df: DataFrame, c: str) -> Column:
    """Bucket that rises with ``c`` and holds a similar number of rows whatever the values look like.

    The splitters are quantiles of the values with the smallest hashes, a sample whose size is bounded by the number of buckets; a
    row's bucket is the number of splitters up to its value. Only the sizes of tasks depend on the sample.
    """
    wanted = min(RANGE_BUCKETS, df.count() // RANGE_ROWS)
    if wanted < 2:
        return F.least(F.length(F.col(c).cast("string")), F.lit(0))  # one bucket, as a column: a join on a literal would have no key
    value = F.substring(c, 1, SPLITTER_CHARS) if df.schema[c].dataType.simpleString() == "string" else F.col(c)
    hashed = df.filter(F.col(c).isNotNull()).select(value.alias("v"), F.xxhash64(c).alias("h"))
    sample = sorted(r["v"] for r in hashed.orderBy("h").limit(wanted * RANGE_SAMPLE).collect())
    edges = sorted({sample[len(sample) * i // wanted] for i in range(1, wanted)}) if sample else []
    # binary search, a comparison per level
    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(c) >= F.lit(edges[mid]), search(mid + 1, hi)).otherwise(search(lo, mid))

    return F.when(F.col(c).isNotNull(), search(0, len(edges)))


def time_bucket(ts: str | Column, seconds: int = 3600) -> Column:
    """Time cut in fixed steps, a bucket for streams ordered by timestamp. Counted on the wall clock of the column, so a
    session time zone with daylight saving cannot make it fall."""
    since = F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), col(ts).cast("timestamp_ntz"))
    return F.floor(since / seconds)


def with_previous(df: DataFrame, keys: list[str], t: str, values: list[str], chunk: int = 65536) -> DataFrame:
    """Add ``prev_<v>`` = value at t − 1 (NULL at the start) for a stream with sample numbers.

    The last sample of each chunk is copied into the next one, so the window runs over (stream, chunk) and a long
    stream is spread over many tasks.
    """
    c = F.floor(F.col(t) / chunk)
    homes = F.when(F.col(t) % chunk == chunk - 1, F.array(c, c + 1)).otherwise(F.array(c))
    cut = df.withColumn("_home", c).withColumn("_chunk", F.explode(homes))
    w = W.partitionBy(*keys, "_chunk").orderBy(t)
    for v in values:
        cut = cut.withColumn(f"prev_{v}", F.lag(v).over(w))
    return cut.filter("_home = _chunk").drop("_home", "_chunk")
