"""Jaccard self-join of word n-gram sets, size-aware: subsets for small sets, inverted lists for large ones.

Equal sets are merged first. A small set enumerates its subsets of every size that a similar partner could share; two sets with
a common subset are linked if its size is the overlap they need. A large set puts the rarest part of its n-grams into inverted
lists; sets that meet in a list are candidates if their sizes and the parities of their n-grams leave the needed overlap possible, and are then
compared whole. The size up to which sets enumerate is the one with the least estimated cost.

Groups of similar sets aren't expanded into pairs: each list first compares its members with a few of them, and afterwards only
members of different components with one another, so every link that could join two components is still looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialframe.llm.common import discard, only_stored, small_side, stored, text_or_empty
from trialframe.llm.components import components

#: Sets of more n-grams never enumerate; the cost decides below.
MOST_ENUMERATED = 24
#: Cells of the table of frequent n-grams, as bits; its size doesn't depend on the corpus.
CELL_BITS = 21
#: n-grams that are counted together in a task before counts are passed on.
CHUNK = 500_000
#: Rows of an Arrow batch that are worked on at once.
PIECE = 1000
#: 64-bit words of a set's parities, at least and at most; between them one bit an n-gram.
PARITIES, MOST_PARITIES = 8, 1024
#: Members of a list up to which its first comparisons are all it needs.
SETTLED = 3
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def gram_set(text: str, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-grams; the whole sequence if there are fewer words; empty without words."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    m = max(1, len(words) - n + 1)
    out = np.full(m, min(n, len(words)), np.uint64)
    for k in range(min(n, len(words))):
        out = mixed(out * M1 + h[k:k + m])
    return np.unique(out.view(np.int64))


def set_id(grams: np.ndarray) -> int:
    d = xxhash.xxh3_64_intdigest(grams.tobytes(), seed=len(grams))
    return d - (1 << 64) if d >= 1 << 63 else d


def least_partner(size: int, t: int) -> int:
    """Size of the smallest set that can be similar: ceil(t * size / 100); also the least overlap."""
    return -(-t * size // 100)


def subsets(size: int, t: int) -> int:
    return sum(comb(size, c) for c in range(least_partner(size, t), size + 1))


def prefix_length(size: int, t: int) -> int:
    return size - least_partner(size, t) + 1


def prefix_size(size: Column, t: int) -> Column:
    return size - F.ceil(t * size / F.lit(100)) + 1


def parities(grams: np.ndarray, words: int = 0) -> np.ndarray:
    """Bit p tells whether an odd number of n-grams falls on it. Where two sets differ in d n-grams, at most d bits differ. Twice as many
    words fold to these by an exclusive or of their halves."""
    words = words or min(MOST_PARITIES, max(PARITIES, 1 << max(0, -(-len(grams) // 64) - 1).bit_length()))
    odd = np.bincount(grams & (64 * words - 1), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, PIECE):
            yield b.slice(at, PIECE)


def _sketch(docs: DataFrame, n: int) -> DataFrame:
    """One row (doc_id, thash, size, sid) per document; rows (cell, times) of n-grams that repeat within a task's chunk; one row (repeats, grams) per chunk."""
    schema = pa.schema([("doc_id", pa.int64()), ("thash", pa.int64()), ("size", pa.int64()), ("sid", pa.int64()), ("cell", pa.int32()), ("times", pa.int64()), ("repeats", pa.int64()), ("grams", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, total = [], 0

        def counted() -> pa.RecordBatch:
            g, c = np.unique(np.concatenate(held), return_counts=True)
            g, c = g[c > 1], c[c > 1]
            cells, where = np.unique(g.view(np.uint64) >> np.uint64(64 - CELL_BITS), return_inverse=True)
            times = np.zeros(len(cells), np.int64)
            np.maximum.at(times, where, c)
            none, k = [None], len(cells)
            return _batch(schema, [none * (k + 1)] * 4 + [[*cells.tolist(), None], [*times.tolist(), None], none * k + [int(c.sum())], none * k + [total]])

        for b in _in_pieces(batches):
            sizes, sids = [], []
            for text in b.column(2):
                g = gram_set(text.as_py(), n)
                sizes.append(len(g))
                sids.append(set_id(g))
                if len(g) and sids[-1] not in seen:
                    seen.add(sids[-1])
                    held.append(g)
                    total += len(g)
                    if total >= CHUNK:
                        yield counted()
                        held, total, seen = [], 0, set()
            none = [None] * b.num_rows
            yield _batch(schema, [b.column(0), b.column(1), sizes, sids, none, none, none, none])
        if held:
            yield counted()

    kinds = "doc_id bigint, thash bigint, size bigint, sid bigint, cell int, times bigint, repeats bigint, grams bigint"
    return docs.mapInArrow(run, kinds)


def choose_boundary(histogram: dict[int, int], rate: float, t: int) -> int:
    """The size up to which sets enumerate subsets. ``rate``: share of n-grams that also occur elsewhere.

    A subset or list entry costs 1; a list entry that occurs elsewhere leads to a comparison, which costs the shipping of two sets.
    """
    def listed(s: int) -> float:
        return prefix_length(s, t) * (1 + rate * (20 + 2 * s))

    costs = {0: 0.0}
    for s in range(1, MOST_ENUMERATED + 1):
        costs[s] = costs[s - 1] + histogram.get(s, 0) * (subsets(s, t) - listed(s))
    return min(costs, key=lambda s: (costs[s], s))


def _subset_keys(docs: DataFrame, n: int, t: int, boundary: int) -> DataFrame:
    """key, c, size, sid: the subsets of ``c`` elements of small sets."""
    schema = pa.schema([("key", pa.int64()), ("c", pa.int32()), ("size", pa.int32()), ("sid", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _in_pieces(batches):
            seen: set[int] = set()
            keys, cs, sizes, sids = [], [], [], []
            for text in b.column(0):
                g = gram_set(text.as_py(), n)
                if not len(g) or len(g) > boundary or (sid := set_id(g)) in seen:
                    continue
                seen.add(sid)
                for c in range(least_partner(len(g), t), len(g) + 1):
                    own = [set_id(np.array(x, np.int64)) for x in combinations(g.tolist(), c)]
                    keys += own
                    cs += [c] * len(own)
                    sizes += [len(g)] * len(own)
                    sids += [sid] * len(own)
            yield _batch(schema, [keys, cs, sizes, sids])

    return docs.mapInArrow(run, "key bigint, c int, size int, sid bigint")


def _small_links(keys: DataFrame, t: int) -> DataFrame:
    """a, b: sets that share a subset as large as the overlap they need.

    In a list of equal subsets the smallest set needs the least overlap with any other, so comparing with it alone joins all
    that are linked.
    """
    lists = keys.groupBy("key", "c").agg(F.min(F.struct("size", "sid")).alias("low"), F.max("sid").alias("hi"), F.min("sid").alias("lo")).where("lo <> hi")
    own = keys.join(lists.select("key", "c", "low"), ["key", "c"]).where(F.col("sid") != F.col("low.sid"))
    return own.where((100 + t) * F.col("c") >= t * (F.col("size") + F.col("low.size"))).select(F.col("sid").alias("a"), F.col("low.sid").alias("b"))


def _prefixes(docs: DataFrame, n: int, t: int, boundary: int, weights) -> DataFrame:
    """token, sid, size: the rarest n-grams of the sets that can have a partner above ``boundary``. A row without token per set has its parities, ``bits`` and, if it has more, ``all``."""
    schema = pa.schema([("token", pa.int64()), ("sid", pa.int64()), ("size", pa.int32()), ("bits", pa.list_(pa.int64())), ("all", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = weights.value
        seen: set[int] = set()
        for b in _in_pieces(batches):
            tokens, sids, sizes, bits, more = [], [], [], [], []
            for text in b.column(0):
                g = gram_set(text.as_py(), n)
                size = len(g)
                if not size or size * 100 // t <= boundary:
                    continue
                if (sid := set_id(g)) in seen:
                    continue
                seen.add(sid)
                if len(seen) > 200_000:
                    seen.clear()
                w = heavy[g.view(np.uint64) >> np.uint64(64 - CELL_BITS)]
                take = np.argsort(w, kind="stable")[:prefix_length(size, t)]  # rare first, then by hash
                tokens.append(g[take])
                sids.append(sid)
                sizes.append(size)
                p = parities(g)
                bits.append(np.bitwise_xor.reduce(p.reshape(-1, PARITIES)))
                more.append(p if len(p) > PARITIES else None)
            k = [len(x) for x in tokens]
            none = [None] * sum(k)
            yield _batch(schema, [np.concatenate(tokens) if tokens else [], np.repeat(np.array(sids, np.int64), k), np.repeat(np.array(sizes, np.int32), k), none, none])
            yield _batch(schema, [[None] * len(k), sids, sizes, bits, more])

    return docs.mapInArrow(run, "token bigint, sid bigint, size int, bits array<bigint>, all array<bigint>")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """sid, grams of the given texts, each set once a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in _in_pieces(batches):
            rows = {}
            for text in b.column(0):
                g = gram_set(text.as_py(), n)
                if (sid := set_id(g)) not in seen:
                    seen.add(sid)
                    rows[sid] = g
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array([g for g in rows.values()], pa.list_(pa.int64()))], names=["sid", "grams"])

    return docs.mapInArrow(run, "sid bigint, grams array<bigint>")


def _need(a: Column, b: Column, t: int) -> Column:
    """Least overlap of similar sets of these sizes."""
    return F.ceil(t * (a + b) / F.lit(100 + t))


def _fit(a: str, b: str, t: int, boundary: int) -> Column:
    """Whether two list members can be similar, by their sizes and numbers of listed n-grams k.

    Every common n-gram up to the end of the prefix that ends first stands in both prefixes, so it is listed in both; the others
    are in that set's rest. Of the other prefix, n-grams beyond that end can be common without being listed, so a set's listed
    n-grams and its own rest don't bound the overlap.
    """
    na, nb, ka, kb = (F.col(f"{x}.{c}") for c in ("size", "k") for x in (a, b))
    rest = F.ceil(t * F.greatest(na, nb) / F.lit(100)) - 1
    return (F.greatest(na, nb) > boundary) & (100 * F.least(na, nb) >= t * F.greatest(na, nb)) & (F.least(ka, kb) + rest >= _need(na, nb, t))


def _most_apart(na: Column, nb: Column, t: int) -> Column:
    """n-grams that similar sets of these sizes can have in only one of them."""
    return na + nb - 2 * _need(na, nb, t)


def _near(a: str, b: str, t: int) -> Column:
    """Whether the parities ``bits`` leave it possible that two sets are similar."""
    differ = sum(F.bit_count(F.col(f"{a}.bits")[j].bitwiseXOR(F.col(f"{b}.bits")[j])) for j in range(PARITIES))
    return differ <= _most_apart(F.col(f"{a}.size"), F.col(f"{b}.size"), t)


def _nearer(pairs: DataFrame, known: DataFrame, t: int) -> DataFrame:
    """The pairs (a, b) that all their parities leave possible. ``known``: sid, size, bits, all. Sizes of a pair are within a factor of two, so lengths are as well."""
    a, b = (known.select(F.col("sid").alias(x), F.struct("size", "bits", F.coalesce("all", "bits").alias("all")).alias(f"of_{x}")) for x in "ab")

    def folded(x: Column, other: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.when(F.size(x) > F.size(other), F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda u, v: u.bitwiseXOR(v))).otherwise(x)

    pa_, pb_ = F.col("of_a.all"), F.col("of_b.all")
    differ = F.aggregate(F.zip_with(folded(pa_, pb_), folded(pb_, pa_), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda total, x: total + x)
    close = pairs.join(a, "a").join(b, "b").where(_near("of_a", "of_b", t))
    return close.where(differ <= _most_apart(F.col("of_a.size"), F.col("of_b.size"), t)).select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, texts: DataFrame, n: int, t: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar. ``texts``: sid, one (thash, low: document) of each set."""
    wanted = stored(texts.join(small_side(stored(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "join-wanted")), "sid", "left_semi").select("thash", "low"), "join-texts").alias("w")
    sets = stored(_sets(docs.alias("d").join(small_side(wanted), (F.col("d.thash") == F.col("w.thash")) & F.col("d.doc_id").eqNullSafe(F.col("w.low")), "left_semi").select("text"), n), "join-sets")
    left = pairs.join(sets.select(F.col("sid").alias("a"), F.col("grams").alias("ga")), "a")
    both = left.join(sets.select(F.col("sid").alias("b"), F.col("grams").alias("gb")), "b")
    o = F.size(F.array_intersect("ga", "gb"))
    return both.where(100 * o >= t * (F.size("ga") + F.size("gb") - o)).select("a", "b")


def _large_links(docs: DataFrame, lists: DataFrame, known: DataFrame, texts: DataFrame, n: int, t: int, boundary: int, known_links: DataFrame) -> DataFrame:
    """a, b: enough links among list members to join all that links connect. ``lists``: token, sid, size, deleted on the way; ``known``: parities of their sets; ``known_links``: those known."""
    listed = lists.groupBy("sid").agg(F.count("*").alias("k"))
    rows = stored(lists.join(listed, "sid").select("token", "sid", "size", "k"), "join-lists")
    discard(lists)
    # every list's members meet a few of them: that with the largest listed share, and two at random
    own = prefix_size(F.col("size"), t) - F.col("k")
    member = F.struct("sid", "size", "k")
    picks = rows.groupBy("token").agg(F.min(F.struct(own.alias("own"), member.alias("p")))["p"].alias("p0"), F.min(member).alias("p1"), F.max(member).alias("p2"))
    picks = picks.select("token", F.explode(F.array_distinct(F.array("p0", "p1", "p2"))).alias("p")).select("token", "p.*")
    met = rows.alias("r").join(picks.alias("q"), (F.col("r.token") == F.col("q.token")) & (F.col("r.sid") != F.col("q.sid")) & _fit("r", "q", t, boundary))
    met = met.select(F.greatest("r.sid", "q.sid").alias("a"), F.least("r.sid", "q.sid").alias("b")).distinct()
    first = stored(_nearer(met, known, t), "join-first")
    links = only_stored(lambda: known_links.union(_verified(first, docs, texts, n, t)), "join-links")
    # where a larger list has several components: members outside its largest one meet those of all others
    comp = only_stored(lambda: components(links), "join-comp")
    large = rows.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > SETTLED).select("token")
    placed = rows.join(large, "token", "left_semi").join(comp, F.col("sid") == comp["node"], "left").select("token", "sid", "size", F.coalesce("comp", "sid").alias("comp"))
    placed = stored(placed, "join-placed")
    discard(rows)
    counts = placed.groupBy("token", "comp").agg(F.count("*").alias("k")).groupBy("token").agg(F.count("*").alias("comps"), F.max(F.struct("k", "comp")).alias("m")).where("comps > 1")
    open_ = placed.join(counts.select("token", F.col("m.comp").alias("largest")), "token")
    # what two sets have in common and did not meet before stands in these lists alone
    one_set = Window.partitionBy("sid")  # its prefix at most
    open_ = open_.withColumn("place", F.row_number().over(one_set.orderBy("token")) - 1).withColumn("k", F.count("*").over(one_set))
    open_ = stored(open_.join(known.select("sid", "bits"), "sid"), "join-open")
    discard(placed)
    few = open_.where("comp <> largest")
    # a pair that shares enough listed n-grams shares one with that many of its own behind it, in either set
    enough = _need(F.col("f.size"), F.col("r.size"), t) - F.ceil(t * F.greatest("f.size", "r.size") / F.lit(100)) + 1
    early = (F.col("f.place") <= F.col("f.k") - enough) & (F.col("r.place") <= F.col("r.k") - enough)
    pairs = few.alias("f").join(open_.alias("r"), (F.col("f.token") == F.col("r.token")) & early & (F.col("f.comp") != F.col("r.comp"))
                                & ((F.col("r.comp") == F.col("r.largest")) | (F.col("f.sid") < F.col("r.sid"))) & _fit("f", "r", t, boundary) & _near("f", "r", t))
    far = pairs.select(F.greatest("f.sid", "r.sid").alias("a"), F.least("f.sid", "r.sid").alias("b")).distinct()
    far = stored(_nearer(far.join(first, ["a", "b"], "left_anti"), known, t), "join-rest")
    discard(open_, first)
    return links.union(_verified(far, docs, texts, n, t))


def near_duplicates(docs: DataFrame, n: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, n_copies, group, thash for every row.

    Words are runs of other than space and the control characters 9 to 13, A-Z lower-cased; a text's set has its distinct n-word
    shingles, the whole sequence if it has fewer words, and is empty without words. Two texts link when 100 * intersection >=
    threshold * union; component_id is the smallest doc_id reachable by links. Null and empty texts link with nothing and are
    components of their own; rows with a null id count as texts but give no component_id (null if a component has no other).
    Equal texts and repeated rows are one set, of which n_copies tells the rows; group numbers the component (null for empty
    sets) and thash is xxhash64 of the text. Extra columns are ignored, an empty table gives no rows. Shingles and sets are known by 64-bit hashes.
    """
    if not 50 < threshold <= 100:
        raise ValueError("threshold is a percentage above 50")
    t = threshold
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("thash", F.xxhash64("text"))
    only = texts.select("text")
    sketch = stored(_sketch(texts.select("doc_id", "thash", "text"), n), "join-sketch")
    rows = sketch.where("sid is not null").select("doc_id", "thash", "size", "sid")
    sets = stored(rows.where("size > 0").groupBy("sid").agg(
        F.min("doc_id").alias("lowest"), F.min(F.struct("thash", F.col("doc_id").alias("low"))).alias("one"), F.max("size").alias("size"), F.count("*").alias("n_copies")), "join-reps")
    # frequent n-grams: a table of fixed size
    cells = sketch.where("cell is not null").groupBy("cell").agg(F.sum("times").alias("times")).where("times >= 16").collect()
    weights = np.zeros(1 << CELL_BITS, np.uint8)
    for r in cells:
        weights[r["cell"]] = int(r["times"]).bit_length()
    repeats, grams = sketch.where("grams is not null").agg(F.sum("repeats"), F.sum("grams")).first()
    histogram = {r["size"]: r["count"] for r in sets.where(F.col("size") <= MOST_ENUMERATED).groupBy("size").count().collect()}
    boundary = choose_boundary(histogram, (repeats or 0) / max(1, grams or 0), t)

    def linked() -> DataFrame:
        small = stored(_subset_keys(only, n, t, boundary), "join-subsets")
        prefixes = stored(_prefixes(only, n, t, boundary, docs.sparkSession.sparkContext.broadcast(weights)), "join-prefixes")
        # n-grams met by two sets; half the hash is enough to leave the others out
        half = F.shiftright("token", 32).cast("int")
        tokens = prefixes.where("token is not null").select("token", "sid", "size")
        shared = tokens.groupBy(half.alias("half")).agg(F.count("*").alias("k")).where("k > 1").select("half")
        some = stored(tokens.withColumn("half", half).join(shared, "half", "left_semi").drop("half"), "join-shared")
        met = some.groupBy("token").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo <> hi").select("token")
        lists = stored(some.join(met, "token", "left_semi").distinct(), "join-members")
        discard(some)
        known = prefixes.where("token is null").join(lists.select("sid").distinct(), "sid", "left_semi").dropDuplicates(["sid"])
        known = stored(known.select("sid", "size", "bits", "all"), "join-parities")
        discard(prefixes)
        return _large_links(texts, lists, known, sets.select("sid", "one.thash", "one.low"), n, t, boundary, _small_links(small, t))

    comp = only_stored(lambda: components(only_stored(linked, "join-all")), "join-comp")
    placed = sets.join(comp, sets["sid"] == comp["node"], "left").select("sid", "lowest", "n_copies", F.coalesce("comp", "sid").alias("comp"))
    lowest = placed.groupBy("comp").agg(F.min("lowest").alias("component_id"))
    known = stored(placed.join(lowest, "comp").select("sid", "component_id", "n_copies", F.col("comp").alias("group")), "join-known")
    discard(sets, comp)
    out = rows.where("size > 0").join(known, "sid").select("doc_id", F.col("size").alias("n_shingles"), "component_id", "n_copies", "group", "thash")
    none = F.lit(None).cast("bigint")
    return out.union(rows.where("size = 0").select("doc_id", F.lit(0).cast("bigint"), F.col("doc_id"), F.lit(1).cast("bigint"), none, F.col("thash")))


def one_of_each(docs: DataFrame, n: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the smallest id (null last) stays, once. Rows without words stay."""
    found = only_stored(lambda: near_duplicates(docs, n, threshold, id_col, text_col), "join-found")
    empty = found.where("group is null").select("doc_id", "thash").distinct().withColumn("_rows", F.lit(1))
    best = found.where("group is not null").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "thash")).alias("b")).select("b.doc_id", "b.thash")
    again = found.groupBy("doc_id", "thash").agg(F.count("*").alias("_rows"))
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.thash") == F.col(f"{b}.thash"))
    kept = best.alias("b").join(again.alias("a"), same("a", "b")).select("b.doc_id", "b.thash", "a._rows").union(empty)
    kept = stored(kept.select(F.col("doc_id").alias("_id"), F.col("thash").alias("_thash"), "_rows"), "join-kept")
    discard(found)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(id_col).cast("bigint").alias("_id1"), F.xxhash64(text_or_empty(text_col)).alias("_thash1"))
    out = rows.join(small_side(kept), F.col("_id").eqNullSafe(F.col("_id1")) & (F.col("_thash") == F.col("_thash1")))
    # a row that is repeated as a whole stays once
    repeated = out.where("_rows > 1").groupBy("_id", "_thash").agg(F.first("_doc").alias("_doc"))
    return out.where("_rows = 1").select("_doc.*").union(repeated.select("_doc.*"))
