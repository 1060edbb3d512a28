"""Removal of repeated word passages with suffix automata of reference shards.

Every window of ``length`` words has a key: the least hash of the shorter word runs inside it. Equal windows have equal keys, and
consecutive windows mostly share one, so a text is cut into contexts (windows with one key at one place), about two for ``length``
words. Keys with a single occurrence can't hold a repeated window. Where all contexts of a key are equal, all their windows
repeat. The other contexts are the reference: they are dealt to shards by key, each shard's suffix automaton is built with
the number of occurrences of every state, and its contexts are streamed through it for matching statistics. Passages that a
shard holds only as a whole are one letter of its automaton, so its states are as many as the places where contexts part or meet.
Windows that occur twice are found word by word. The automata travel with their shards instead of to every document, since each document
against each shard would be quadratic; a key with very many contexts is dealt by single windows, so that no shard gets
large.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.llm.common import discard, only_stored, small_side, stored, text_or_empty
from trialframe.llm.ngram_join import M1, mixed

#: Windows of one context at most.
CONTEXT = 24
#: Words whose automaton one task holds.
SHARD_WORDS = 40_000
#: Words of the runs from which letters are made (a power of two; fewer for shorter windows).
RUN = 8
#: Texts that are cut at once.
TEXTS = 500
#: Bytes of a word up to which words are hashed together, and masks of the first bytes of eight.
LONG_WORD = 64
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Rows of words that leave a task in one batch.
TOGETHER = 4096
#: Contexts from which a key is dealt by single windows.
HOT = 2048
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
MASK = (1 << 64) - 1


class Powers:
    """Powers of a base modulo 2^64, as many as asked for."""

    def __init__(self, base: int):
        self.base, self.held = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.held) < n:
            step = np.uint64(pow(self.base, len(self.held), 1 << 64))
            self.held = np.concatenate([self.held, self.held * step])
        return self.held[:n]


UP, DOWN = Powers(BASE), Powers(INVERSE)


def sums(h: np.ndarray) -> np.ndarray:
    """Running polynomial sums, from which the hash of any run of words follows."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * UP.upto(len(h)), dtype=np.uint64)])


def run_hashes(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((c[end] - c[start]) * DOWN.upto(len(c))[start])


def sliding_argmin(a: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value of each run of ``width``, the first of equal ones."""
    out, have = np.arange(len(a)), 1
    while have < width:
        step = min(have, width - have)
        left, right = out[:-step], out[step:]
        out = np.where(a[left] <= a[right], left, right)
        have += step
    return out


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one behind the other, and their number per text."""
    bare = pc.ascii_trim_whitespace(texts)
    lines = pc.ascii_split_whitespace(pc.if_else(pc.equal(bare, ""), pa.scalar(None, bare.type), bare))
    return lines.flatten(), pc.fill_null(pc.list_value_length(lines), 0).to_numpy().astype(np.int64)


def word_hashes(words: pa.Array) -> np.ndarray:
    """Eight bytes of all words at a time; long words one by one."""
    words = words.cast(pa.large_binary())
    if not len(words):
        return np.zeros(0, np.uint64)
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    start, size = ends[:-1] - ends[0], np.diff(ends)
    letters = np.zeros(ends[-1] - ends[0] + 8, np.uint8)
    letters[:-8] = np.frombuffer(words.buffers()[2], np.uint8)[ends[0]:ends[-1]]
    eight = np.ndarray(len(letters) - 7, "<u8", letters, strides=(1,))
    h, live, at = size.astype(np.uint64), np.nonzero(size <= LONG_WORD)[0], 0
    while len(live):
        x = eight[start[live] + at] & FIRST[np.minimum(size[live] - at, 8)]
        h[live] = mixed(h[live] * M1 + x)
        at += 8
        live = live[size[live] > at]
    for k in np.nonzero(size > LONG_WORD)[0]:
        h[k] = xxhash.xxh3_64_intdigest(letters[start[k]:start[k] + size[k]].tobytes())
    return h


def contexts(hashes: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """text, key, start, windows, hash of the contexts of several texts, whose hashed words stand one behind the other."""
    window = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(sizes)), window)
    if not len(text):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    base = np.cumsum(sizes) - sizes
    at = np.arange(len(text)) + (base - np.cumsum(window) + window)[text]  # first words of the windows, none of which spans two texts
    c = sums(hashes)
    run = max(1, length // 3)
    first = np.arange(len(hashes) - run + 1)
    runs = run_hashes(c, first, first + run)
    least = sliding_argmin(runs, length - run + 1)[at]  # a window that recurs in its own text has its least run at another place there
    change = np.nonzero(np.diff(least, prepend=-1))[0]  # texts have no run in common
    many = np.diff(np.append(change, len(at)))
    parts = -(-many // CONTEXT)
    step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(change, parts) + CONTEXT * step
    count = np.minimum(np.repeat(change + many, parts) - begin, CONTEXT)
    start, of = at[begin], text[begin]
    return of, runs[least[begin]].view(np.int64), start - base[of], count, run_hashes(c, start, start + count + length - 1).view(np.int64)


class Automaton:
    """Suffix automaton of word sequences, with the number of occurrences of each state's words."""

    def __init__(self, texts: list[list[int]], weights: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        last = 0
        for k, (words, weight) in enumerate(zip(texts, weights, strict=True)):
            for w in words:
                last = self._add(last, w, weight)
            last = self._add(last, -1 - k, 0)  # a word that no text has: nothing matches across texts
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[v]] += self.count[v]

    def _state(self, length: int, link: int, moves: dict[int, int], count: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.count.append(count)
        return len(self.length) - 1

    def _add(self, last: int, w: int, weight: int) -> int:
        new = self._state(self.length[last] + 1, 0, {}, weight)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            if self.length[q] == self.length[p] + 1:
                self.link[new] = q
            else:
                twin = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), 0)
                while p >= 0 and self.next[p].get(w) == q:
                    self.next[p][w] = twin
                    p = self.link[p]
                self.link[q] = self.link[new] = twin
        return new

    def repeated(self, words: list[int], length: int) -> Iterator[int]:
        """Starts of the windows of ``words`` that the reference holds more than once: matching statistics, cut at ``length``."""
        v = matched = 0
        for i, w in enumerate(words):
            while v and w not in self.next[v]:
                v = self.link[v]
                matched = self.length[v]
            if w in self.next[v]:
                v = self.next[v][w]
                matched += 1
            while v and self.length[self.link[v]] >= length:
                v = self.link[v]
            matched = min(matched, self.length[v])
            if matched >= length and self.count[v] > 1:
                yield i - length + 1


    def repeats(self, letters: list[int], spans: list[tuple[int, int]]) -> list[bool]:
        """Whether the reference holds letters[a:b + 1] more than once, for spans (a, b) of one of its texts; neither end ever falls."""
        v, at, out = 0, 0, []
        for b, w in enumerate(letters):
            v = self.next[v][w]
            while at < len(spans) and spans[at][1] == b:
                while self.length[self.link[v]] >= b - spans[at][0] + 1:
                    v = self.link[v]
                out.append(self.count[v] > 1)
                at += 1
        return out


def numbered(values: np.ndarray | pa.Array) -> np.ndarray:
    """The values as numbers from 0, equal ones alike."""
    return pa.array(values).dictionary_encode().indices.to_numpy().astype(np.int64)


def parted(values: np.ndarray | list, sizes: np.ndarray) -> list:
    """Consecutive parts of these sizes."""
    ends = np.cumsum(sizes).tolist()
    return [values[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def lettered(texts: list[list[int]] | list[np.ndarray], length: int) -> tuple[list[list[int]], list[list[tuple[int, int]]], list[list[int]]]:
    """Texts of at least ``length`` numbered words as sequences of letters; per text the spans (a, b) of letters under its windows and the
    first window of each span, in order.

    A letter stands for runs of words each of which has only the next one behind and only the one before in front, in all texts, so a
    letter occurs as a whole or not at all, and a window as often as the letters under it.
    """
    run = 1
    while 2 * run <= min(RUN, length):
        run *= 2
    sizes = np.array([len(t) for t in texts])
    r, width = np.concatenate([np.asarray(t, np.int64) for t in texts]), 1
    while width < run:
        if int(r.max()) >= 1 << 31:
            r = numbered(r)
        r = r[:-width] * (r.max() + 1) + r[width:]
        width *= 2
    n, text = sizes - run + 1, np.arange(len(texts))
    ends = np.cumsum(n)
    first = ends - n
    g = numbered(r[np.arange(ends[-1]) + np.repeat(text * (run - 1), n)])  # runs within texts

    def one(neighbours: np.ndarray) -> np.ndarray:
        """Whether all places of a run have the same neighbour: that of any one of them."""
        some, same = np.empty(g.max() + 1, np.int64), np.ones(g.max() + 1, bool)
        some[g] = neighbours
        same[g[neighbours != some[g]]] = False
        return same

    behind, before = np.append(g[1:], 0), np.append(0, g[:-1])
    behind[ends - 1] = before[first] = -1 - text
    joined = one(behind)[g[:-1]] & one(before)[g[1:]]
    joined[ends[:-1] - 1] = False
    begins = np.append(True, ~joined)
    letter = np.cumsum(begins) - 1
    low = letter[first]
    letters = parted(g[begins].tolist(), np.diff(np.append(low, letter[-1] + 1)))
    count = sizes - length + 1
    of = np.repeat(text, count)
    window = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    a, b = letter[first[of] + window] - low[of], letter[first[of] + window + length - run] - low[of]
    new = np.nonzero((np.diff(of, prepend=-1) != 0) | (np.diff(a, prepend=-1) != 0) | (np.diff(b, prepend=-1) != 0))[0]
    many = np.bincount(of[new], minlength=len(texts))
    return letters, parted(list(zip(a[new].tolist(), b[new].tolist(), strict=True)), many), parted(window[new].tolist(), many)


def _rows(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _cut(docs: DataFrame, length: int) -> DataFrame:
    """A row (doc_id, thash, n_words, whole) per document and rows (thash, key, start, windows, ctx) of its contexts."""
    schema = pa.schema([("doc_id", pa.int64()), ("thash", pa.int64()), ("n_words", pa.int64()), ("whole", pa.string()), ("key", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("ctx", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            words, sizes = split_words(b.column(2))
            lines = pa.ListArray.from_arrays(np.append(0, np.cumsum(sizes)).astype(np.int32), words)
            whole = [hashlib.sha256(line).hexdigest() for line in pc.binary_join(lines, " ").cast(pa.binary()).to_pylist()]
            none = [None] * b.num_rows
            yield _rows(schema, [b.column(0), b.column(1), sizes, whole, none, none, none, none])
            thash = b.column(1).to_numpy()
            new = [k for k, t in enumerate(thash.tolist()) if t not in seen and not seen.add(t)]
            if len(seen) > 200_000:
                seen.clear()
            of, key, start, count, ctx = contexts(word_hashes(lines.take(pa.array(new, pa.int32())).flatten()), sizes[new], length)
            none = [None] * len(key)
            yield _rows(schema, [none, thash[new][of], none, none, key, start, count, ctx])

    return docs.mapInArrow(run, "doc_id bigint, thash bigint, n_words bigint, whole string, key bigint, start int, windows int, ctx bigint")


def _context_words(texts: DataFrame, length: int) -> DataFrame:
    """key, ctx, window, whash, weight, words: contexts as they are (window null), those of hot keys window by window. ``texts``: thash, text, wanted."""
    schema = pa.schema([("key", pa.int64()), ("ctx", pa.int64()), ("window", pa.int32()), ("whash", pa.int64()), ("weight", pa.int32()), ("words", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        fields = ("key", "ctx", "start", "windows", "hot", "weight")
        for b in batches:
            out = []
            for k in range(b.num_rows):
                if (thash := b.column(0)[k].as_py()) in seen:
                    continue
                seen.add(thash)
                words, wanted = b.column(1)[k].as_py().encode().split(), b.column(2)[k].values
                for key, ctx, start, windows, is_hot, weight in zip(*(wanted.field(f).to_pylist() for f in fields), strict=True):
                    own = words[start:start + windows + length - 1]
                    if is_hot:
                        for i in range(windows):
                            line = b" ".join(own[i:i + length])
                            out.append((key, ctx, i, np.uint64(xxhash.xxh3_64_intdigest(line)).astype(np.int64), weight, line.decode()))
                    else:
                        out.append((key, ctx, None, None, weight, b" ".join(own).decode()))
                if len(out) >= TOGETHER:
                    yield _rows(schema, [list(c) for c in zip(*out, strict=True)])
                    out = []
            if out:
                yield _rows(schema, [list(c) for c in zip(*out, strict=True)])

    return texts.mapInArrow(run, "key bigint, ctx bigint, window int, whash bigint, weight int, words string")


def _masks(reference: DataFrame, length: int) -> DataFrame:
    """key, ctx, mask (bit i: window i repeats). ``reference``: shard, key, ctx, origin, weight, words; rows that repeat (key, ctx, origin) count once."""
    schema = pa.schema([("key", pa.int64()), ("ctx", pa.int64()), ("mask", pa.int64())])

    def shard(table: pa.Table) -> pa.Table:
        once = {k: i for i, k in enumerate(zip(*(table.column(c).to_pylist() for c in ("key", "ctx", "origin")), strict=True))}
        table = table.take(pa.array(sorted(once.values()), pa.int64()))
        lines = pc.split_pattern(table.column("words").combine_chunks(), " ")
        texts = parted(numbered(lines.flatten()), pc.list_value_length(lines).to_numpy())
        letters, spans, starts = lettered(texts, length)
        automaton = Automaton(letters, table.column("weight").to_pylist())
        masks = []
        for t, x, own, at, w, s in zip(texts, letters, spans, starts, *(table.column(c).to_pylist() for c in ("weight", "origin")), strict=True):
            mask = 0
            if w == 1 or s:  # contexts of weight 2 repeat as a whole and are there for the others
                for i, j, twice in zip(at, [*at[1:], len(t) - length + 1], automaton.repeats(x, own), strict=True):
                    mask |= ((1 << j) - (1 << i)) * twice
            masks.append(mask)
        return pa.Table.from_arrays([table.column("key"), table.column("ctx"), pa.array(masks, pa.int64())], schema=schema)

    return reference.groupBy("shard").applyInArrow(shard, "key bigint, ctx bigint, mask bigint")


def _kept(texts: DataFrame, length: int) -> DataFrame:
    """thash, n_removed, kept: ``texts`` (thash, text, marks) without the words under repeated windows."""
    schema = pa.schema([("thash", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, kept = [], []
            for text, marks in zip(b.column(1), b.column(2), strict=True):
                words = text.as_py().encode().split()
                edge = np.zeros(len(words) + length + 1, np.int64)
                for m in marks.as_py():
                    bits = m["mask"]
                    while bits:
                        i = m["start"] + (bits & -bits).bit_length() - 1
                        edge[i] += 1
                        edge[i + length] -= 1
                        bits &= bits - 1
                cover = np.cumsum(edge[:len(words)]) > 0
                removed.append(int(cover.sum()))
                kept.append(b" ".join(w for w, gone in zip(words, cover, strict=True) if not gone).decode())
            yield _rows(schema, [b.column(0), removed, kept])

    return texts.mapInArrow(run, "thash bigint, n_removed bigint, kept string")


def repeated_windows(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(rows of the documents, marks): marks has thash and an array of (start, mask) of repeated windows. ``docs``: doc_id, thash, text."""
    cut = stored(_cut(docs, length), "sub-cut")
    rows = stored(cut.where("n_words is not null").select("doc_id", "thash", "n_words", "whole"), "sub-rows")
    ctx = cut.where("key is not null").select("thash", "key", "start", "windows", "ctx")
    place = F.xxhash64("thash", "start")
    # half of the key is enough to leave out what occurs once
    half, short = F.shiftright("key", 32).cast("int"), F.shiftright(place, 32).cast("int")
    twice = ctx.groupBy(half.alias("half")).agg(F.min(short).alias("lo"), F.max(short).alias("hi")).where("lo <> hi").select("half")
    found = stored(ctx.withColumn("half", half).join(twice, "half", "left_semi").drop("half"), "sub-found")
    discard(cut)
    each = found.groupBy("key", "ctx").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.min(F.struct("thash", "start", "windows")).alias("x"))
    each = stored(each.select("key", "ctx", (F.col("lo") != F.col("hi")).alias("full"), "x.*"), "sub-contexts")
    whole = F.expr("shiftleft(1L, windows) - 1")
    full = each.where("full").select("key", "ctx", whole.alias("mask"))
    masks = only_stored(lambda: _parted_masks(docs, each, length), "sub-masks")
    final = stored(full.union(masks).groupBy("key", "ctx").agg(F.bit_or("mask").alias("mask")), "sub-final")
    discard(each, masks)
    marks = found.distinct().join(final, ["key", "ctx"]).groupBy("thash").agg(F.collect_list(F.struct("start", "mask")).alias("marks"))
    marks = stored(marks, "sub-marks")
    discard(found, final)
    return rows, marks


def _parted_masks(docs: DataFrame, each: DataFrame, length: int) -> DataFrame:
    """key, ctx, mask of the contexts that have windows in common with others of their key. ``each``: key, ctx, full, thash, start, windows."""
    keys = each.groupBy("key").agg(F.count("*").alias("n"), F.min("full").alias("settled")).where("n > 1 and not settled")
    reference = stored(each.join(keys, "key").select("key", "ctx", "full", "thash", "start", "windows", (F.col("n") > HOT).alias("hot")), "sub-reference")
    total = reference.agg(F.sum(F.col("windows") + length)).first()[0] or 0
    shards = max(1, -(-total // SHARD_WORDS))
    shard = lambda *c: F.pmod(F.xxhash64(*c), F.lit(shards))
    wanted = reference.groupBy("thash").agg(F.collect_list(F.struct("key", "ctx", "start", "windows", "hot", F.when(F.col("full"), 2).otherwise(1).alias("weight"))).alias("wanted"))
    some = docs.join(small_side(stored(wanted.select("thash"), "sub-wanted")), "thash", "left_semi").select("thash", "text")
    lines = stored(_context_words(some.join(wanted, "thash").select("thash", "text", "wanted"), length), "sub-lines")
    discard(reference)
    cold = lines.where("window is null").select("key", "ctx", F.lit(0).cast("bigint").alias("origin"), "weight", "words")
    # of a hot key's equal windows two are evidence enough; those that occur once need none
    hot = lines.where("window is not null").withColumn("origin", F.xxhash64("ctx", "window"))
    again = hot.groupBy("key", "whash").agg(F.min("origin").alias("lo"), F.max("origin").alias("hi"), F.max("weight").alias("w")).where("lo <> hi or w > 1")
    evidence = hot.join(again.select("key", "whash", "lo", "hi"), ["key", "whash"]).where("origin in (lo, hi)").select("key", F.col("whash").alias("ctx"), "origin", "weight", "words")
    cold_masks = _masks(cold.withColumn("shard", shard("key")), length)
    hot_masks = _masks(evidence.withColumn("shard", shard("key", "ctx")), length).where("mask <> 0").select("key", F.col("ctx").alias("whash")).distinct()
    hot_masks = hot.join(hot_masks, ["key", "whash"], "left_semi").select("key", "ctx", F.expr("shiftleft(1L, window)").alias("mask"))
    return cold_masks.where("mask <> 0").union(hot_masks).groupBy("key", "ctx").agg(F.bit_or("mask").alias("mask"))


def without_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, where words were removed, kept (the words that stay, joined by one space).

    A window of ``length`` consecutive words whose words also start anywhere else, the same text included, goes with all words
    under it; windows are judged on the input. Null and empty texts have no words. A text that several rows have repeats
    itself, so it goes whole if it has a window. Windows never span rows; shorter texts stay.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("thash", F.xxhash64("text")).select("doc_id", "thash", "text")
    rows, marks = repeated_windows(texts, length)
    copies = rows.groupBy("thash").agg(F.count("*").alias("n"), F.max("n_words").alias("w")).where("n > 1").where(F.col("w") >= length).select("thash", F.lit(True).alias("copied"))
    copies = stored(copies, "sub-copies")
    partial = stored(marks.join(copies, "thash", "left_anti"), "sub-partial")
    some = texts.join(small_side(partial.select("thash")), "thash", "left_semi").select("thash", "text").join(partial, "thash")
    kept = stored(_kept(some.select("thash", "text", "marks"), length), "sub-kept")
    discard(marks, partial)
    out = rows.join(copies, "thash", "left").join(kept, "thash", "left")
    return out.select(
        "doc_id", "n_words", F.when(F.col("copied"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(F.col("copied"), F.sha2(F.lit(""), 256)).when(F.col("kept").isNotNull(), F.sha2("kept", 256)).otherwise(F.col("whole")).alias("kept_sha256"),
        F.when(F.col("copied"), "").otherwise(F.col("kept")).alias("kept"))
