"""Tokenizers against the libraries whose results they must equal, on awkward texts."""

import base64
import collections
import hashlib
import itertools
import random

import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trialframe.llm import byte_bpe, token_alignment
from trialframe.llm.queries import QUERIES

MULTI = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def awkward():
    rng = random.Random(7)
    texts = [None, "", " ", "  \t\n ", "a", "don't  stop \n\n now's", " leading", "trailing   ", "<|endoftext|> is text", "naïve café — “quoted”", "日本語のテキスト 123 456",
             "x" * 5000, "é" * 400, "ab" * 300, "=" * 257, "\U0001F600" * 90, "▁under ▁ score", "<0x41> <0x0A>", "\x00\x1c\x85  　 tail", "é ​ ﬁ Ⅳ ½"]
    texts += ["".join(rng.choice("abcde ") for _ in range(n)) for n in (7, 63, 512, 513, 3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x2000), rng.randrange(0x3040, 0x9FFF), rng.randrange(0x1F300, 0x1F700)])) for _ in range(n)) for n in (5, 200, 2000)]
    return texts + ["same text twice"] * 3


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def as_docs(spark, texts):
    """Rows with extra columns whose names clash with results; the last row repeats an id, one id is null."""
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(0, "again", "clash", 1), (None, "no id", "clash", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string, bytes int")


def test_ids_and_bytes_equal_the_library(spark, awkward, library):
    docs = as_docs(spark, awkward)
    out = byte_bpe.decode(byte_bpe.encode(docs, MULTI, P.PATTERN), MULTI).collect()
    got = sorted(((r["doc_id"], list(r["ids"]), bytes(r["bytes"])) for r in out), key=str)
    want = [(i, t or "") for i, t in [*enumerate(awkward), (0, "again"), (None, "no id")]]
    assert got == sorted(((i, library.encode_ordinary(t), t.encode()) for i, t in want), key=str)
    assert byte_bpe.encode(docs.where("false"), MULTI, P.PATTERN).count() == 0


def test_every_character_is_split_as_the_library_splits():
    """A vocabulary that merges a, 1 or ! with the byte after it shows whether the character after it is in the same match."""
    tokens = [bytes([b]) for b in range(256)] + [bytes([first, b]) for first in b"a1!" for b in range(256)]
    library = tiktoken.Encoding("classes", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    encoder = byte_bpe.Encoder(byte_bpe.Vocabulary(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens))), P.PATTERN)
    texts = ["".join(f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}" for c in range(at, min(at + 4096, 0x110000)) if not 0xD800 <= c < 0xE000) for at in range(0, 0x110000, 4096)]
    texts = [t for t in texts if t]
    assert encoder.encode(texts).to_pylist() == [library.encode_ordinary(t) for t in texts]


def test_cut_texts_and_forgetting_change_nothing(monkeypatch, awkward, library):
    monkeypatch.setattr(byte_bpe, "SEGMENT", 16)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 3)
    monkeypatch.setattr(byte_bpe, "LONG", 8)
    monkeypatch.setattr(byte_bpe, "CELLS", 64)
    encoder = byte_bpe.Encoder(byte_bpe.vocabulary(open(MULTI, "rb").read()), P.PATTERN)
    texts = [t or "" for t in awkward]
    assert encoder.encode(texts[:9]).to_pylist() + encoder.encode(texts[9:]).to_pylist() == [library.encode_ordinary(t) for t in texts]


def test_merges_follow_ranks_not_places(library):
    """A vocabulary in which the pair of least rank lies right of another one, and of equal pairs the left one goes first."""
    lines = [base64.b64encode(t) + b" %d" % i for i, t in enumerate([bytes([b]) for b in range(256)] + [b"bc", b"ab", b"aa", b"abc"])]
    words = byte_bpe.Vocabulary(b"\n".join(lines))
    assert words.merged([b"abcd", b"aaaa", b"aaa", b"abc", b""]).to_pylist() == [[259, 100], [258, 258], [258, 97], [259], []]
    assert [words.merged_long(p) for p in (b"abcd", b"aaaa", b"aaa")] == [[259, 100], [258, 258], [258, 97]]
    with pytest.raises(ValueError, match="byte 0"):
        byte_bpe.Vocabulary(b"YQ== 0")


def test_op12_against_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op12_byte_bpe"](spark, sf).collect()}
    for doc, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit(""))).collect():
        ids = library.encode_ordinary(text)
        digest = [hashlib.sha256(x).hexdigest() for x in (",".join(map(str, ids)).encode(), text.encode())]
        assert got.pop(doc) == (len(ids), *digest)
    assert not got


BYTES, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def plain_alignment(rows):
    """Measures of (doc_id, text) rows by both libraries themselves and by looking at every byte of a text."""
    a_tokens, b_tokens = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_tokens.encode_special_tokens = True
    letters = {v: k for k, v in token_alignment._byte_of_letter().items()}
    byte_of = {letters[b]: b for b in range(256)}
    links, groups = [], []
    for _, text in rows:
        ids = a_tokens.encode(" " + (text or ""), add_special_tokens=False).ids, b_tokens.encode(text or "")
        spelled = [[bytes(byte_of[c] for c in a_tokens.id_to_token(i)) for i in ids[0]],
                   [bytes([i - 3]) if b_tokens.is_byte(i) else b_tokens.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]]
        own, done = [], []
        if text and all(b"".join(s) == b" " + text.encode() for s in spelled):
            token_of = [[k for k, t in enumerate(s) for _ in t] for s in spelled]  # of every byte
            own = [(ids[0][i], ids[1][j]) for i, j in set(zip(*token_of, strict=True))]
            ends = [{len(t) for t in itertools.accumulate(s)} for s in spelled]
            low = 0
            for end in sorted(ends[0] & ends[1]):
                done.append("|".join(",".join(str(x[k]) for k in sorted(set(of[low:end]))) for x, of in zip(ids, token_of, strict=True)))
                low = end
        else:
            ids = [], []
        links.append(own)
        groups.append((len(ids[0]), len(ids[1]), len(done), ";".join(done)))
    count = collections.Counter(p for own in links for p in set(own))
    most = collections.defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    return [(i, n_a, n_b, n, len(own), sum(count[p] == most[p[0]] for p in own), sum(count[p] for p in own), line)
            for (i, _), own, (n_a, n_b, n, line) in zip(rows, links, groups, strict=True)], count


def test_alignment_equals_plain_alignment(spark, awkward, monkeypatch):
    texts = [t for t in awkward if t is None or len(t) < 600]
    docs = as_docs(spark, texts).withColumn("groups", F.lit("clash")).withColumn("rows", F.lit(3))
    want, count = plain_alignment([*enumerate(texts), (0, "again"), (None, "no id")])
    for block, hot in ((1 << 20, 1000), (50, 10)):
        monkeypatch.setattr(token_alignment, "BLOCK", block)
        monkeypatch.setattr(token_alignment, "BATCH", block)
        monkeypatch.setattr(token_alignment, "HOT", hot)
        out = token_alignment.aligned(docs, BYTES, PIECES, spell_groups=True)
        assert sorted((tuple(r) for r in out.documents.collect()), key=str) == sorted(want, key=str)
        assert {(r["a"], r["b"]): r["docs"] for r in out.pairs.collect()} == dict(count)
    assert sum(w[1] > 0 for w in want) > 8 and sum(w[1] == 0 for w in want) >= 3
    none = token_alignment.aligned(docs.where("false"), BYTES, PIECES)
    assert none.documents.count() == none.pairs.count() == 0


def test_byte_vocabulary_by_ranks_equals_its_library(awkward):
    own, library = token_alignment.ByteTokenizer(open(BYTES, "rb").read()), Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    texts = [t or "" for t in awkward] + ["".join(f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}" for c in range(at, at + 4096) if not 0xD800 <= c < 0xE000) for at in range(0, 0x110000, 4096)]
    assert own.encode(texts) == [e.ids for e in library.encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_op13_against_plain_alignment(spark):
    sf = "/root/testdata/sf0.001"
    got = [tuple(r) for r in QUERIES["op13_token_alignment"](spark, sf).collect()]
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = plain_alignment(docs)[0]
    assert sorted(got) == sorted((*w[:7], hashlib.sha256(w[7].encode()).hexdigest() if w[7] else "") for w in want)
