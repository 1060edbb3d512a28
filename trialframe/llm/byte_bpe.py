"""Byte-level BPE encoding and decoding over a rank file.

A text is split by a pattern, and each match is merged by itself. The distinct matches of a batch lie in numpy matrices, one per
bucket of lengths, a row per match and padded on the right. In every round each row merges its leftmost pair of least rank:
ranks of pairs come from an open hash table, everything right of the merged pair moves one place to the left, only the two
pairs beside it are looked up again, and rows without a known pair leave the matrix. A match of more than ``LONG`` bytes
would need as many rounds as it has bytes, so it is merged with a heap, which gives the same ids in near-linear time.

The rank file is read once on the driver and shipped with the tasks: it holds one vocabulary, whatever the size of the corpus.
"""

from __future__ import annotations

import base64
import functools
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from trialframe.llm.common import text_or_empty

#: Bytes of a match from which on a heap replaces the matrix.
LONG = 512
#: Matrix cells worked on at once.
CELLS = 1 << 18
#: Distinct matches that a task remembers.
REMEMBERED = 400_000
#: Characters after which a text is cut at the next white space that follows something else; no match spans such a place.
SEGMENT = 1 << 20
#: Largest rank file that is shipped with the tasks.
FILE_BYTES = 64 << 20
NONE = np.iinfo(np.int32).max
BREAK = regex.compile(r"(?<=\S)\s")

# Letters and numbers of Unicode 17 and 18, in hexadecimal. The pattern library knows them; the tables of Unicode 16, by
# which the tokenizer splits, hold them to be neither.
YOUNGER = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 "
    "10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 "
    "16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 "
    "1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F "
    "2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F "
)
YOUNGER_SET = "[" + "".join("-".join(f"\\U{int(c, 16):08X}" for c in run.split("-")) for run in YOUNGER.split()) + "]"
YOUNG = regex.compile(YOUNGER_SET)


def without_younger(pattern: str) -> str:
    r"""``pattern`` with \p{L} and \p{N} as Unicode 16 has them."""
    for kind in (r"\p{L}", r"\p{N}"):
        pattern = pattern.replace(kind, f"[{kind}--{YOUNGER_SET}]")
    return pattern


class PairTable:
    """Hash table from a pair of token ids to the rank of their bytes put together; open addressing in numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(4, int(2 * len(rank) + 1).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        keys = self._key(left, right)
        at, open_ = self._slot(keys), np.arange(len(keys))
        while len(open_):
            free = self.keys[at[open_]] < 0
            self.keys[at[open_[free]]] = keys[open_[free]]  # of several for one slot the last one written stays
            won = self.keys[at[open_]] == keys[open_]
            self.ranks[at[open_[won]]] = rank[open_[won]]
            open_ = open_[~won]
            at[open_] = (at[open_] + 1) & self.mask

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << 32 | right.astype(np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE where a pair is unknown or holds padding (-1)."""
        out = np.full(left.shape, NONE, np.int32)
        real = np.flatnonzero((left >= 0).ravel() & (right >= 0).ravel())
        keys = self._key(left.ravel()[real], right.ravel()[real])
        at, flat = self._slot(keys), out.ravel()
        while len(real):
            held = self.keys[at]
            hit = held == keys
            flat[real[hit]] = self.ranks[at[hit]]
            more = ~hit & (held >= 0)
            real, keys, at = real[more], keys[more], (at[more] + 1) & self.mask
        return out


class Vocabulary:
    """Tokens and pair ranks of a rank file: one line per token, its bytes in base64 and its rank."""

    def __init__(self, file: bytes):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file.splitlines() if line.strip())}
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"the rank file has no token for byte {missing[0]}")
        tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.tokens = pa.array(tokens, pa.binary())
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        halves = [(self.ranks.get(t[:i]), self.ranks.get(t[i:]), r) for t, r in self.ranks.items() for i in range(1, len(t))]
        left, right, rank = np.array([h for h in halves if h[0] is not None and h[1] is not None], np.int32).reshape(-1, 3).T
        self.pairs = PairTable(left, right, rank)

    def merged_long(self, piece: bytes) -> list[int]:
        """Ids of one long piece: the pair of least rank, the leftmost of equal ones, is taken from a heap; stale entries are skipped."""
        spelled = [bytes([b]) for b in piece]
        n, get = len(spelled), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        now = [get(a + b) for a, b in zip(spelled, spelled[1:], strict=False)] + [None]
        heap = [(r, i) for i, r in enumerate(now) if r is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if now[i] != rank:
                continue
            j = after[i]
            spelled[i] += spelled[j]
            spelled[j], now[j], after[i] = b"", None, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (i, before[i]):
                if k >= 0:
                    now[k] = get(spelled[k] + spelled[after[k]]) if after[k] < n else None
                    if now[k] is not None:
                        heapq.heappush(heap, (now[k], k))
        return [self.ranks[token] for token in spelled if token]

    def _merged_rows(self, pieces: list[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pieces of at most ``width`` bytes, as they are done: (their places, numbers of ids, ids)."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        cells = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < size[:, None], self.of_byte[cells], -1).astype(np.int32)
        ranks = np.full((len(pieces), width + 1), NONE, np.int32)  # rank of (place - 1, place), NONE at both edges
        ranks[:, 1:width] = self.pairs.rank(ids[:, :-1], ids[:, 1:])
        row = np.arange(len(pieces))
        while len(row):
            place = ranks.argmin(axis=1)  # of equal ranks the leftmost
            least = ranks[np.arange(len(row)), place]
            done = least == NONE
            if done.any():
                real = ids[done] >= 0
                yield row[done], real.sum(axis=1), ids[done][real]
                ids, ranks, row, place, least = (x[~done] for x in (ids, ranks, row, place, least))
            every, width = np.arange(len(row)), ids.shape[1] - 1
            left = place - 1  # the pair lies at (place - 1, place)
            ids = np.where(np.arange(width) > left[:, None], ids[:, 1:], ids[:, :-1])
            ids[every, left] = least
            ranks = np.where(np.arange(width + 1) > left[:, None], ranks[:, 1:], ranks[:, :-1])
            beside = [np.where((at >= 0) & (at < width), ids[every, np.clip(at, 0, width - 1)], -1) for at in (left - 1, left + 1)]
            ranks[every, left] = self.pairs.rank(beside[0], least)
            ranks[every, left + 1] = self.pairs.rank(least, beside[1])

    def merged(self, pieces: list[bytes]) -> pa.ListArray:
        """Ids of every piece. A piece that is itself a token is that token."""
        whole = [self.ranks.get(p, -1) for p in pieces]
        long = [k for k, p in enumerate(pieces) if whole[k] < 0 and len(p) > LONG]
        size = np.where(np.array(whole, np.int64) < 0, np.fromiter(map(len, pieces), np.int64, len(pieces)), -1)
        known = np.flatnonzero(size <= 0)
        done = [(known, (size[known] < 0).astype(np.int64), np.array(whole, np.int32)[size < 0])]
        for k in long:
            ids = np.array(self.merged_long(pieces[k]), np.int32)
            done.append((np.array([k]), np.array([len(ids)]), ids))
        for width in set(map(bucket_width, np.unique(size[(size > 0) & (size <= LONG)]).tolist())):
            low, step = bucket_below(width), max(1, CELLS // width)
            members = np.flatnonzero((size > low) & (size <= width))
            for at in range(0, len(members), step):
                some = members[at:at + step]
                done += [(some[k], n, ids) for k, n, ids in self._merged_rows([pieces[k] for k in some], width)]
        order, n, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32())).take(pa.array(np.argsort(order)))


def bucket_width(n: int) -> int:
    """Width of the matrix for a piece of ``n`` bytes: every length to 16, then in steps of about an eighth."""
    step = 1 << max(0, (n - 1).bit_length() - 4)
    return -(-n // step) * step


def bucket_below(width: int) -> int:
    """Width of the next narrower matrix."""
    return width - (1 << max(0, (width - 1).bit_length() - 4))


@functools.lru_cache(maxsize=2)
def vocabulary(file: bytes) -> Vocabulary:
    return Vocabulary(file)


class _Numbers(dict):
    """Numbers new words in the order in which they are asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Encoder:
    """Encodes texts, remembering the ids of distinct matches."""

    def __init__(self, words: Vocabulary, pattern: str):
        self.words, self.pattern = words, regex.compile(pattern)
        self.older = regex.compile(without_younger(pattern), regex.VERSION1)
        self._forget()

    def _forget(self) -> None:
        self.number, self.held = _Numbers(), pa.array([], pa.list_(pa.int32()))

    def _matches(self, text: str) -> Iterator[list[str]]:
        pattern = self.pattern if text.isascii() or not YOUNG.search(text) else self.older
        at = 0
        while len(text) - at > SEGMENT:
            cut = BREAK.search(text, at + SEGMENT)
            end = cut.start() if cut else len(text)
            yield pattern.findall(text, at, end)
            at = end
        yield pattern.findall(text, at)

    def encode(self, texts: list[str]) -> pa.ListArray:
        if len(self.number) > REMEMBERED:
            self._forget()
        places, sizes = [], []
        for text in texts:
            n = 0
            for part in self._matches(text):
                places.append(np.fromiter(map(self.number.__getitem__, part), np.int32, len(part)))
                n += len(part)
            sizes.append(n)
        fresh = list(self.number)[len(self.held):] if len(self.number) > len(self.held) else []
        if fresh:
            self.held = pa.concat_arrays([self.held, self.words.merged([w.encode() for w in fresh])])
        taken = self.held.take(pa.array(np.concatenate([np.zeros(0, np.int32), *places])))
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        return pa.ListArray.from_arrays(pa.array(taken.offsets.to_numpy()[starts], pa.int32()), taken.flatten())


def shipped_file(path: str) -> bytes:
    """A vocabulary file, read on the driver; one of more than FILE_BYTES is refused."""
    size = os.path.getsize(path)
    if size > FILE_BYTES:
        raise ValueError(f"{path} has {size} bytes; at most {FILE_BYTES} are shipped with every task")
    with open(path, "rb") as f:
        return f.read()


def _runs(batch: pa.RecordBatch, size: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows of about ``limit`` bytes each."""
    group = (np.cumsum(size) - size) // limit
    edges = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(size)]])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: the whole text of every row, encoded without special tokens; only the two columns named are read.

    A null text counts as empty, and an empty text has an empty array. Rows that repeat an id, or whose id is null, give a row
    each, equal texts equal ids. An empty table gives no rows. Of equal ranks the leftmost pair is merged first. The rank file
    needs a token for every single byte, else it is refused.
    """
    shared = docs.sparkSession.sparkContext.broadcast(shipped_file(path))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(shared.value), pattern)
        for batch in batches:
            size = pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            for part in _runs(batch, size, 4 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), encoder.encode(part.column(1).to_pylist())], schema=schema)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (with a column ids array<int>) and a column ``bytes``: the tokens' bytes one after another. Null ids decode to
    nothing; an id that the vocabulary lacks stops the job."""
    shared = encoded.sparkSession.sparkContext.broadcast(shipped_file(path))
    place = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(shared.value).tokens
        for batch in batches:
            size = pa.compute.list_value_length(batch.column(place)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for part in _runs(batch, size * 4, 4 << 20):
                lists = part.column(place)
                n = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
                flat = tokens.take(lists.flatten())
                ends = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset:flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int32)
                own = ends[np.concatenate([[0], np.cumsum(n)])].astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(own), flat.buffers()[2]])
                yield pa.RecordBatch.from_arrays([*part.columns, data], names=[*part.schema.names, "bytes"])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields]).add("bytes", BinaryType()))
