"""Mixing sources to target weights by nested hash thresholds.

Every document has a fixed 60-bit hash. A source whose target is ``k`` sizes and a rest takes every document ``k`` times, and
once more those whose hash lies under the source's threshold. The threshold comes from sums per (source, hash bucket): the
bucket in which the running sum meets the rest is found, only its documents are summed again by their next ten bits, and so
on until a boundary bucket holds a single hash. No document is sorted; each round sees only the boundary buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialframe.llm.common import WORD, small_side, stored, text_or_empty

#: Hash digits per level: 10 bits, six levels.
BITS, LEVELS = 10, 6


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size (words), h (60 bits of the md5 of the id's decimal text; null ids hash as an empty text)."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), _size(text_col).alias("size"), _hash(id_col).alias("h"))


def _size(text_col: str) -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")


def _hash(id_col: str) -> Column:
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target. ``sizes``: source, source_size, one row per source.

    Weights repeat over the sources by code point, null last. ``share`` times all sizes is dealt by weight; no target exceeds
    ``most`` times its source, the excess goes to the others by weight until none is above. Filling level: sources ordered by
    cap over weight are capped as long as the level that the rest would get reaches their ratio.
    """
    if share > most:
        raise ValueError("share may not exceed the cap of every source")
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pos = F.row_number().over(by_name) - 1
    ratio_order = Window.orderBy("ratio", "pos")
    before, whole = ratio_order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    s = (sizes.withColumn("pos", pos)
         .withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("pos") % len(weights) + 1).cast("int")))
         .withColumn("cap", F.col("source_size") * F.lit(most))
         .withColumn("ratio", F.col("cap") / F.col("w"))
         .withColumn("level", (F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                     / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
         .withColumn("at", F.row_number().over(ratio_order))
         .withColumn("final", F.min(F.when(F.col("level") < F.col("ratio"), F.struct("at", "level"))).over(whole)["level"]))
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("w")))
    return s.select("source", "source_size", F.round(target, 6).alias("target"))


def thresholds(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """source, copies, limit: documents with h <= limit get one more than ``copies``.

    ``docs``: source, size, h. ``plan``: source, source_size, target. Of the document at the boundary the nearer side is
    taken. Rows with equal hashes (equal ids) stand or fall together.
    """
    state = plan.select(
        "source", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("copies"),
        F.col("target"), F.col("source_size"))
    state = stored(state.select("source", "copies", (F.col("target") - F.col("copies") * F.col("source_size")).alias("rest"),
                                F.lit(0).cast("long").alias("prefix"), F.lit(0.0).alias("passed")), "mix-level")
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        bucket = F.shiftright("h", shift)
        at = small_side(state.select(F.col("source").alias("of"), "rest", "passed", "prefix"))
        inside = docs.join(at, F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("h", shift + BITS) == F.col("prefix"))).select(
            "source", "rest", "passed", bucket.alias("b"), "size", "h")
        sums = inside.groupBy("source", "rest", "passed", "b").agg(
            F.sum("size").cast("double").alias("size"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        order = Window.partitionBy("source").orderBy("b")
        run = sums.withColumn("upto", F.col("passed") + F.sum("size").over(order))
        edge = run.where(F.col("upto") >= F.col("rest")).groupBy("source").agg(
            F.min(F.struct("b", "upto", "size", "lo", "hi")).alias("e"))
        got = state.alias("s").join(small_side(edge).alias("e"), F.col("s.source").eqNullSafe(F.col("e.source")), "left")
        # without an edge the rest exceeds all that is left: everything is taken
        state = stored(got.select(
            F.col("s.source").alias("source"), "copies", "rest",
            F.coalesce(F.col("e.b"), F.lit((1 << (BITS * level)) - 1)).cast("long").alias("prefix"),
            F.coalesce(F.col("e.upto") - F.col("e.size"), F.col("passed")).alias("passed"),
            F.coalesce(F.col("e.size"), F.lit(0.0)).alias("size"), F.col("e.lo").alias("lo"), F.col("e.hi").alias("hi"),
            F.col("e.b").isNull().alias("all")), "mix-level")
        if not state.where("lo < hi").limit(1).count():
            break
    take = F.when(F.col("all"), F.lit((1 << (BITS * LEVELS)) - 1)).when(
        F.col("passed") + F.col("size") / 2 <= F.col("rest"), F.col("hi")).otherwise(F.col("lo") - 1)
    return state.select("source", "copies", take.cast("long").alias("limit"))


def mixing_plan(narrow: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """of (source), source_size, target, whole, limit: what each source's documents are taken by. ``narrow``: as ``sized``, stored."""
    sizes = stored(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    plan = stored(targets(sizes, weights, share, most), "mix-targets")
    cut = thresholds(narrow, plan)
    per_source = plan.alias("p").join(small_side(cut).alias("c"), F.col("p.source").eqNullSafe(F.col("c.source"))).select(
        F.col("p.source").alias("of"), "source_size", "target", F.col("copies").alias("whole"), "limit")
    return stored(per_source, "mix-plan")


def with_copies(narrow: DataFrame, plan: DataFrame) -> DataFrame:
    """``narrow`` plus source_size, target, copies, taken."""
    out = narrow.join(small_side(plan), F.col("source").eqNullSafe(F.col("of")))
    copies = F.col("whole") + F.when((F.col("h") <= F.col("limit")) & (F.col("source_size") > 0), 1).otherwise(0)
    return out.withColumn("copies", copies.cast("long")).withColumn("taken", (F.col("copies") * F.col("size")).cast("long")).drop("of", "whole", "limit", "h")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row.

    Null texts have size 0; a null source is a source of its own, last in order; an empty table gives no rows. Other columns
    are ignored. A row's copies depend only on its id, source and the source's sizes, so reruns agree.
    """
    narrow = stored(sized(docs, id_col, text_col, source_col), "mix-sizes")
    return with_copies(narrow, mixing_plan(narrow, weights, share, most))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that the mix takes, as a struct doc, with size, source_size, target, copies, taken."""
    narrow = stored(sized(docs), "mix-sizes")
    plan = mixing_plan(narrow, **how)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", "text", "source")
    rows = rows.select("doc", "source", _size("text").alias("size"), _hash("doc_id").alias("h"))
    return with_copies(rows, plan).where("copies > 0").drop("source")
