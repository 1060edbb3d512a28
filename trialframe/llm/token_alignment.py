"""Alignment of two tokenizers' tokens over a corpus.

Copies are tokenised once: rows are shuffled by their full text and counted, and each distinct text goes through both tokenizers
in one task. All texts of a small batch are aligned together on one line of bytes. The ends of the A tokens and of the B tokens are two
sorted arrays; where both end a group ends, and every stretch between neighbouring ends lies in exactly one token of either side,
so the stretches are the links.

What a link's count needs is known only at the end, so texts are kept in blocks of bounded size: each block has a list of its
distinct id pairs with the number of documents (copies included) that hold them, and each text has the places of its pairs in that
list. Only the blocks' lists are shuffled by pair; counts come back to the blocks, and each text adds up its own.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.llm.byte_bpe import shipped_file
from trialframe.llm.common import stored, text_or_empty

#: Bytes of text in a block; a longer text is a block by itself.
BLOCK = 12 << 20
#: Bytes of text aligned at once.
BATCH = 1 << 20
#: A text that at least this share of all rows has is joined by broadcast; there can be at most as many such texts as the share says.
HOT = 1000


def _byte_of_letter() -> dict[str, int]:
    """Bytes by the letters that stand for them in a byte-level vocabulary: printable ones stand for themselves, the rest follow from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteTokenizer:
    """Byte-level BPE from a vocabulary file with merges. Special tokens' strings inside texts are plain text.

    The ids of the merges must follow their order; ranks are then ids, which the rank-based library takes.
    """

    def __init__(self, file: bytes):
        import public_tokenizers
        model = json.loads(file)["model"]
        letters, vocab = _byte_of_letter(), model["vocab"]
        spelled = {i: bytes(letters[c] for c in entry) for entry, i in vocab.items()}
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if made != sorted(made) or (made and made[0] != 256):
            raise ValueError("ids of a byte-level vocabulary must follow the order of its merges")
        self.bytes = pa.array([spelled.get(i, b"") for i in range(max(spelled) + 1)], pa.binary())
        self.library = tiktoken.Encoding("shared", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in spelled.items()}, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.library.encode_ordinary(" " + t) for t in texts]


class PieceTokenizer:
    """Pieces with byte fallback; the library itself puts a space before a text."""

    def __init__(self, file: bytes):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=file)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes = pa.array([bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)], pa.binary())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


@functools.lru_cache(maxsize=2)
def _byte_tokenizer(file: bytes) -> ByteTokenizer:
    return ByteTokenizer(file)


@functools.lru_cache(maxsize=2)
def _piece_tokenizer(file: bytes) -> PieceTokenizer:
    return PieceTokenizer(file)


class Alignment(NamedTuple):
    """Per text: numbers of A and B tokens, groups and links, the groups spelled out; per link: its text's number, A id, B id."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[bytes]
    of: np.ndarray
    a: np.ndarray
    b: np.ndarray


def _joined(tokens: pa.BinaryArray, lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray, memoryview, np.ndarray]:
    """ids, ends of every token, the bytes of all tokens, ends of every list."""
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    ids = np.fromiter((i for ids in lists for i in ids), np.int32, n.sum())
    taken = tokens.take(pa.array(ids))
    ends = np.frombuffer(taken.buffers()[1], np.int32)[1:len(ids) + 1] if len(ids) else np.zeros(0, np.int32)
    of = np.concatenate([[0], ends])[np.cumsum(n)]
    return ids, ends, memoryview(taken.buffers()[2] or b"").cast("B"), of


def _spelled(a: ByteTokenizer, b: PieceTokenizer) -> pa.StringArray:
    """Strings ``id,`` and ``id|`` of every A id, then ``id,`` and ``id;`` of every B id."""
    return pa.array([f"{i}{sign}" for n, signs in ((len(a.bytes), ",|"), (len(b.bytes), ",;")) for sign in signs for i in range(n)], pa.string())


def align(texts: list[str], a: ByteTokenizer, b: PieceTokenizer, signs: pa.StringArray) -> Alignment:
    """Aligns every text; texts that are empty or that either side doesn't spell byte by byte have no tokens."""
    lists_a, lists_b = a.encode(texts), b.encode(texts)
    for side, lists in ((a, lists_a), (b, lists_b)):
        _, _, data, ends = _joined(side.bytes, lists)
        start = 0
        for k, end in enumerate(ends.tolist()):
            if not texts[k] or data[start:end] != b" " + texts[k].encode():
                lists_a[k], lists_b[k] = [], []
            start = end
    ids_a, ends_a, _, of_a = _joined(a.bytes, lists_a)
    ids_b, ends_b, _, _ = _joined(b.bytes, lists_b)
    n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (lists_a, lists_b))
    cuts, links = np.intersect1d(ends_a, ends_b, assume_unique=True), np.union1d(ends_a, ends_b)
    edges = np.concatenate([[0], of_a])
    upto_cuts, upto_links = np.searchsorted(cuts, edges, "right"), np.searchsorted(links, edges, "right")
    # tokens in the order of the groups: an A token comes after the B tokens of the groups before, a B token after the A tokens of its group too
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    past_a, past_b = (np.concatenate([[0], np.searchsorted(e, cuts, "right")]) for e in (ends_a, ends_b))
    order = np.zeros(len(ids_a) + len(ids_b), np.int64)
    order[np.arange(len(ids_a)) + past_b[group_a]] = ids_a + len(a.bytes) * np.isin(ends_a, cuts, assume_unique=True)
    order[np.arange(len(ids_b)) + past_a[group_b + 1] if len(ids_b) else []] = 2 * len(a.bytes) + ids_b + len(b.bytes) * np.isin(ends_b, cuts, assume_unique=True)
    line = signs.take(pa.array(order))
    place = np.concatenate([[0], np.frombuffer(line.buffers()[1], np.int32)[1:len(order) + 1]]) if len(order) else np.zeros(1, np.int32)
    data, at = memoryview(line.buffers()[2] or b"").cast("B"), place[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
    groups = [bytes(data[x:max(x, y - 1)]) for x, y in zip(at[:-1], at[1:], strict=True)]
    return Alignment(n_a, n_b, np.diff(upto_cuts), np.diff(upto_links), groups, np.searchsorted(of_a, links),
                     ids_a[np.searchsorted(ends_a, links)] if len(links) else ids_a, ids_b[np.searchsorted(ends_b, links)] if len(links) else ids_b)


TEXTS = "hash string, rows bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, places array<int>, times array<int>"
PAIRS = "place int, a int, b int, docs bigint"


def _cut(texts: DataFrame, file_a, file_b, spell_groups: bool) -> DataFrame:
    """Rows (block, TEXTS) of the distinct texts and rows (block, PAIRS) of each block's pairs. ``texts``: text, hash, rows."""
    schema = pa.schema([("block", pa.int64()), ("hash", pa.string()), *[(c, pa.int64()) for c in ("rows", "n_a", "n_b", "n_groups", "n_links")], ("groups", pa.string()),
                        ("places", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("place", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("docs", pa.int64())])

    def batch(columns: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def block_rows(block: int, rows: list[tuple[str, str, int]], a: ByteTokenizer, b: PieceTokenizer, signs: pa.StringArray) -> Iterator[pa.RecordBatch]:
        parts, ofs, keys, times, at, size = [], [], [], [], 0, 0
        for k, (text, _, _) in enumerate(rows):
            size += len(text)
            if size < BATCH and k + 1 < len(rows):
                continue
            got = align([r[0] for r in rows[at:k + 1]], a, b, signs)
            pair = got.a.astype(np.int64) << 32 | got.b
            order = np.lexsort((pair, got.of))
            pair, of = pair[order], got.of[order]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(pair) != 0) | (np.diff(of) != 0)])) if len(pair) else np.zeros(0, np.int64)
            ofs.append(of[first] + at)
            keys.append(pair[first])
            times.append(np.diff(np.append(first, len(pair))))
            spelled = [g.decode() if spell_groups else hashlib.sha256(g).hexdigest() if g else "" for g in got.groups]
            parts.append((got.n_a, got.n_b, got.n_groups, got.n_links, np.array(spelled, object)))
            at, size = k + 1, 0
        of, key, count = (np.concatenate(x) for x in (ofs, keys, times))
        distinct, place = np.unique(key, return_inverse=True)
        copies = np.array([r[2] for r in rows], np.int64)
        docs = np.zeros(len(distinct), np.int64)
        np.add.at(docs, place, copies[of])
        ends = pa.array(np.searchsorted(of, np.arange(len(rows) + 1)).astype(np.int32))
        n_a, n_b, n_groups, n_links, groups = (np.concatenate(x) for x in zip(*parts, strict=True))
        yield batch({"block": np.full(len(rows), block), "hash": [r[1] for r in rows], "rows": copies, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups": groups,
                     "places": pa.ListArray.from_arrays(ends, pa.array(place.astype(np.int32))), "times": pa.ListArray.from_arrays(ends, pa.array(count.astype(np.int32)))}, len(rows))
        for i in range(0, len(distinct), 100_000):
            some = distinct[i:i + 100_000]
            yield batch({"block": np.full(len(some), block), "place": np.arange(i, i + len(some)), "a": some >> 32, "b": some & 0xFFFFFFFF, "docs": docs[i:i + len(some)]}, len(some))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _byte_tokenizer(file_a.value), _piece_tokenizer(file_b.value)
        signs = _spelled(a, b)
        block, rows, size = TaskContext.get().partitionId() << 32, [], 0
        for got in batches:
            for text, key, n in zip(*got.columns, strict=True):
                rows.append((text.as_py(), key.as_py(), n.as_py()))
                size += len(rows[-1][0])
                if size >= BLOCK:
                    yield from block_rows(block, rows, a, b, signs)
                    block, rows, size = block + 1, [], 0
        if rows:
            yield from block_rows(block, rows, a, b, signs)

    return texts.mapInArrow(run, f"block bigint, {TEXTS}, {PAIRS}")


def _sums(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Measures of every text of a block. ``pairs``: block, place, count, best."""
    schema = pa.schema([("hash", pa.string()), ("rows", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups", pa.string())])

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        order = right.column("place").to_numpy()
        count, best = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        count[order], best[order] = right.column("count").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        places, times = left.column("places").combine_chunks(), left.column("times").combine_chunks()
        ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(places).to_numpy(zero_copy_only=False))]).astype(np.int64)
        at, n = places.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        n_best, total = (np.diff(np.concatenate([[0], np.cumsum(n * x[at])])[ends]) for x in (best, count))
        own = {"n_best": n_best, "count_sum": total}
        return pa.table([pa.array(own[f.name]) if f.name in own else left.column(f.name) for f in schema], schema=schema)

    fields = "hash string, rows bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string"
    return texts.groupBy("block").cogroup(pairs.withColumnRenamed("block", "own").groupBy("own")).applyInArrow(block, fields)


class Aligned(NamedTuple):
    """documents: doc_id and measures; pairs: a, b, docs (documents that hold the pair linked), best (no pair of a has more)."""

    documents: DataFrame
    pairs: DataFrame


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", spell_groups: bool = False) -> Aligned:
    """Tokens of every whole text by a byte-level vocabulary (A, of space and text) and a piece model (B), and how they align.

    documents has a row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair's count is the highest of
    their A id, ties included), count_sum (counts added over links) and groups, the groups spelled ``a1,a2|b1;a3|b2,b3`` with
    ``spell_groups``, else the SHA-256 of that in lower-case hexadecimal. Null and empty texts, and texts whose bytes either side
    changes, have zeros and ''. Copies and repeated rows each count as a document and get equal measures; a null id stays null. Other
    columns are not read. An empty table gives empty tables.
    """
    context = docs.sparkSession.sparkContext
    file_a, file_b = (context.broadcast(shipped_file(p)) for p in (path_a, path_b))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    distinct = rows.where("text <> ''").groupBy("text").agg(F.count("*").alias("rows")).select("text", F.sha2("text", 256).alias("hash"), "rows")
    cut = stored(_cut(distinct, file_a, file_b, spell_groups), "align-cut")
    listed = cut.where("place is not null").select("block", "place", "a", "b", "docs")
    counts = listed.groupBy("a", "b").agg(F.sum("docs").alias("docs"))
    highest = counts.groupBy("a").agg(F.max("docs").alias("most"))
    pairs = stored(counts.join(highest, "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("best")), "align-pairs")
    back = listed.drop("docs").join(pairs, ["a", "b"]).select("block", "place", F.col("docs").alias("count"), "best")
    measured = stored(_sums(cut.where("place is null").drop("place", "a", "b", "docs"), back), "align-measures")
    total = rows.count()
    hot = F.broadcast(measured.where(F.col("rows") * HOT >= total).drop("rows"))
    own = rows.select("doc_id", F.when(F.col("text") != "", F.sha2("text", 256)).alias("hash"))
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    wide = own.join(hot, "hash", "left")
    settled = wide.where("hash is null or groups is not null")
    rest = wide.where("hash is not null and groups is null").select("doc_id", "hash").join(measured.where(F.col("rows") * HOT < total).drop("rows"), "hash")
    both = settled.unionByName(rest)
    return Aligned(both.select("doc_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in names], F.coalesce("groups", F.lit("")).alias("groups")), pairs)
