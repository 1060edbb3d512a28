"""Divergence between the sources of each language, term by term and over whole vocabularies.

Row accumulation in the manner of Gustavson's sparse product: the counts are a matrix of groups by terms, its term-major form the
index of a task. Each group (a row) scatters its terms through the index into one dense accumulator with a cell per peer, so a
posting pair is added up where it is met and never emitted. A task holds one block of terms and at most ``ROWS`` groups;
blocks of terms hold about ``POSTINGS`` postings.

Absent terms count too: with smoothing they have a probability above zero, which differs by group. Their share follows from the
groups' numbers of terms by count, as if no term were shared; each shared term then corrects it:
f(p, p') - f(p, zero') - f(zero, p') + f(zero, zero').
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialframe.llm.common import stored, text_or_empty

#: Documents of its language in which a term must occur.
DOCUMENTS = 10
#: Terms reported per group.
TOP = 10
SMOOTHING = 2
SCALE = 1_000_000_000
#: Groups whose accumulators a task holds.
ROWS = 64
#: Postings of a block of terms.
POSTINGS = 1_000_000
#: Counts that a task holds before it hands them on.
HELD = 400_000
#: Postings scattered at once.
STEP = 1 << 20

#: Bytes that end a term become spaces, A-Z become a-z; bytes from 128 on belong to terms.
_LETTERS = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of letters and of characters outside ASCII; only A-Z are lower-cased."""
    return text.translate(_LETTERS).split()


def _counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: partial sums of a task's documents, and a row without a term for every group. ``docs``: text as bytes."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def rows(groups: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), pa.array(n.keys(), pa.binary()).cast(pa.string()),
                 pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        met: set[tuple[str, str]] = set()
        held = 0
        for batch in batches:
            for lang, source, text in zip(*batch.columns, strict=True):
                group = lang.as_py(), source.as_py()
                n, docs = groups.setdefault(group, (Counter(), Counter()))
                met.add(group)
                own = Counter(terms_of(text.as_buffer().to_pybytes()))
                held -= len(n)
                n.update(own)
                docs.update(own.keys())
                held += len(n)
                if held > HELD:
                    yield from rows(groups)
                    groups, held = {}, 0
        yield from rows(groups)
        if met:
            lang, source = zip(*met, strict=True)
            none = pa.nulls(len(met), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.nulls(len(met), pa.string()), none, none], schema=schema)

    return docs.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def weight(n: str, total: str, kept: str) -> F.Column:
    """1 + floor(SCALE (n + s) / (total + s kept)) exactly, for counts of any size."""
    return (F.expr(f"cast({n} + {SMOOTHING} as decimal(28, 0)) * {SCALE} div cast({total} + {SMOOTHING} * {kept} as decimal(28, 0))") + 1).cast("bigint")


def distance(p, q):
    """floor((p - q)^2 / (p + q)) of arrays of whole numbers up to 10^9."""
    return (p - q) * (p - q) // (p + q)


class Statistics(NamedTuple):
    """groups: lang, source, place (from 0 by source, per language), total, kept (V), zero (weight of an absent term);
    entries: lang, source, place, term, n, p, zero; languages: lang, term, q."""

    groups: DataFrame
    entries: DataFrame
    languages: DataFrame


def statistics(docs: DataFrame, least: int = DOCUMENTS) -> Statistics:
    """Kept terms, their counts and weights per group and language."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
                       text_or_empty().cast("binary").alias("text"))
    counts = stored(_counted(rows).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")
    real = counts.where("term is not null")
    kept = stored(real.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs"), "divergence-kept")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("all"))
    own = stored(real.drop("docs").join(kept.select("lang", "term"), ["lang", "term"]), "divergence-own")
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    place = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("place")
    groups = counts.where("term is null").select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes.drop("all"), "lang", "left")
    groups = groups.select("lang", "source", place, F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"))
    # without kept terms nothing has a weight, and 1 keeps the division defined
    groups = stored(groups.withColumn("zero", F.when(F.col("kept") > 0, weight("0", "total", "kept")).otherwise(1)), "divergence-groups")
    entries = own.join(groups, ["lang", "source"]).select("lang", "source", "place", "term", "n", weight("n", "total", "kept").alias("p"), "zero")
    languages = kept.join(sizes, "lang").select("lang", "term", weight("n", "all", "kept").alias("q"))
    return Statistics(groups, stored(entries, "divergence-entries"), languages)


_CELLS = pa.schema([("lang", pa.string()), ("place", pa.int32()), ("peer", pa.int32()), ("value", pa.int64())])
CELLS = "lang string, place int, peer int, value bigint"


def _cells(lang: str, place: np.ndarray, peer: np.ndarray, value: np.ndarray) -> pa.Table:
    return pa.table([pa.array([lang] * len(place), pa.string()), pa.array(place, pa.int32()), pa.array(peer, pa.int32()), pa.array(value, pa.int64())], schema=_CELLS)


def _shared(stats: Statistics) -> DataFrame:
    """lang, place, peer, value: corrections for shared terms, a sum per block of terms."""
    blocks = F.greatest(F.lit(1), F.ceil(F.count("*") / POSTINGS)).cast("int").alias("blocks")
    entries = stats.entries.join(stats.entries.groupBy("lang").agg(blocks, F.max("place").alias("last")), "lang")
    entries = entries.select("lang", "term", "place", "p", "zero", "last", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"))
    band = F.floor(F.col("place") / ROWS).cast("int")
    rows = entries.select(F.col("lang"), F.col("block"), band.alias("band"), *[F.col(c).alias(f"own_{c}") for c in ("term", "place", "p", "zero")])
    # every band of groups needs the whole index of a block: postings are repeated per band, not per pair
    index = entries.select(F.col("lang").alias("of"), F.col("block").alias("part"), F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / ROWS).cast("int"))).alias("rows"), "term", "place", "p", "zero", "last")

    def accumulate(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _CELLS.empty_table()
        coded = pa.chunked_array(right.column("term").chunks + left.column("own_term").chunks).combine_chunks().dictionary_encode().indices.to_numpy()
        term, order = coded[:right.num_rows], np.argsort(coded[:right.num_rows], kind="stable")
        peer, p, zero = (right.column(c).to_numpy()[order].astype(np.int64) for c in ("place", "p", "zero"))
        starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=coded.max() + 1))])
        own, place, q, none = coded[right.num_rows:], *(left.column(f"own_{c}").to_numpy().astype(np.int64) for c in ("place", "p", "zero"))
        peers = int(right.column("last")[0].as_py()) + 1
        out = []
        for row in np.unique(place):
            mine = np.flatnonzero(place == row)
            dense = np.zeros(peers, np.int64)
            length = starts[own[mine] + 1] - starts[own[mine]]
            part = np.cumsum(length) // STEP
            for k in np.unique(part):
                some, n = mine[part == k], length[part == k]
                at = np.repeat(starts[own[some]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                mine_p, mine_zero = np.repeat(q[some], n), np.repeat(none[some], n)
                value = distance(mine_p, p[at]) - distance(mine_p, zero[at]) - distance(mine_zero, p[at]) + distance(mine_zero, zero[at])
                np.add.at(dense, peer[at], value)
            dense[row] = 0
            touched = np.flatnonzero(dense)
            out.append(_cells(left.column("lang")[0].as_py(), np.full(len(touched), row), touched, dense[touched]))
        return pa.concat_tables(out)

    return rows.groupBy("lang", "block", "band").cogroup(index.groupBy("of", "part", "rows")).applyInArrow(accumulate, CELLS)


def _absent(stats: Statistics) -> DataFrame:
    """lang, place, peer, value: the sums as if no two groups shared a term."""
    band = F.floor(F.col("place") / ROWS).cast("int")
    tally = stats.entries.groupBy("lang", "place", "p").agg(F.count("*").alias("terms"))
    # a group without terms still has absent ones
    rows = stats.groups.select("lang", "place", F.col("zero").alias("p"), F.lit(0).cast("bigint").alias("terms")).unionByName(tally).withColumn("band", band)
    last = stats.groups.groupBy("lang").agg(F.floor(F.max("place") / ROWS).cast("int").alias("bands"))
    peers = stats.groups.join(stats.entries.groupBy("lang", "source").agg(F.count("*").alias("own")), ["lang", "source"], "left").join(last, "lang")
    peers = peers.select(F.col("lang").alias("of"), F.explode(F.sequence(F.lit(0), "bands")).alias("rows"), F.col("place").alias("peer"), F.col("zero").alias("none"), F.coalesce("own", F.lit(0)).alias("own"), F.col("kept").alias("all"))

    def baseline(left: pa.Table, right: pa.Table) -> pa.Table:
        lang = right.column("of")[0].as_py()
        right = right.sort_by("peer")
        zero, own, kept = (right.column(c).to_numpy().astype(np.int64) for c in ("none", "own", "all"))
        place, p, terms = (left.column(c).to_numpy().astype(np.int64) for c in ("place", "p", "terms"))
        every, out = np.arange(len(zero)), []
        for row in np.unique(place):
            mine = np.flatnonzero(place == row)
            present = np.zeros(len(zero), np.int64)
            for at in range(0, len(mine), max(1, STEP // len(zero))):
                some = mine[at:at + max(1, STEP // len(zero))]
                present += (terms[some, None] * distance(p[some, None], zero[None, :])).sum(axis=0)
            absent = (kept - own - own[row]) * distance(zero[row], zero)
            other = every != row
            n = int(other.sum())
            # the row's terms count for both directions of a pair, the rest once for each
            out.append(_cells(lang, np.concatenate([np.full(n, row), every[other]]), np.concatenate([every[other], np.full(n, row)]), np.concatenate([(present + absent)[other], present[other]])))
        return pa.concat_tables(out)

    return rows.groupBy("lang", "band").cogroup(peers.groupBy("of", "rows")).applyInArrow(baseline, CELLS)


def audit(docs: DataFrame, least: int = DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank for every source of every language; ``docs`` has text, lang, source, other columns are not read.

    Terms in at least ``least`` documents of a language are kept. part ``pair``: item is each other source of the language, value the
    sum of floor((p - q)^2 / (p + q)) over all kept terms of both sources' smoothed weights (0 without kept terms), all ranks. part ``term``:
    item is each kept term that the source uses more than its language does, ranks to ``top``. Ranks fall by value and, in ties,
    rise by item. Nulls count as '', also as names of a language or source; rows that repeat count each; null and empty texts have no
    terms, their groups still take part. An empty table gives no rows. All sums are of whole numbers.
    """
    stats = statistics(docs, least)
    sums = _shared(stats).unionByName(_absent(stats)).groupBy("lang", "place", "peer").agg(F.sum("value").alias("value"))
    names = stats.groups.select("lang", "place", "source")
    pairs = sums.join(names, ["lang", "place"]).join(names.select("lang", F.col("place").alias("peer"), F.col("source").alias("item")), ["lang", "peer"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    used = stats.entries.join(stats.languages, ["lang", "term"]).where("p > q")
    value = F.expr("(p - q) * (p - q) div (p + q)").alias("value")
    terms = used.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)
