"""Toxic sentences by a support vector machine on a subsequence string kernel.

Two words are as alike as their weighted common subsequences of three characters, gaps allowed within a span, so an insult
with inserted or changed letters stays close to the insult. A sentence's kernel with a landmark is that of its closest word.
The landmarks (Nyström) are words that mark toxic texts in the labelled sample and a few frequent ones; the machine is linear
in K^(-1/2) k. Labels belong to documents: a toxic document's most suspicious sentence is its positive example, chosen anew
after each fit. A document scores as its worst sentence, mapped to 0..1 by a logistic fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.llm.common import stored, text_or_empty

#: Longest span of a subsequence, decay per character of the span, longest word read as one piece.
SPAN, DECAY, PIECE = 6, 0.6, 24
#: Kernel values below count as nothing alike.
LEAST = 0.6
#: Power of the kernel; it stays a kernel and sets near words further apart from like ones.
POWER = 2
#: Labelled documents per class that the model is fitted on (all if there are fewer), sentences of each (those closest to the
#: landmarks of toxic texts), and landmarks of either kind.
SAMPLE, PER_DOCUMENT, MARKED, PLAIN = 2500, 6, 112, 16
#: Distinct words a worker remembers.
CACHE = 300_000
#: Characters of the texts whose words are looked up together.
TOGETHER = 1_000_000
TABLE = 1 << 18
STOPS = frozenset(".!?")


@lru_cache(maxsize=64)
def subsequences(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index triples within the span in a word of n characters, and their weights."""
    t = [(i, j, k) for i in range(n) for j in range(i + 1, min(n, i + SPAN)) for k in range(j + 1, min(n, i + SPAN))]
    i, j, k = (np.array(x, np.int64) for x in zip(*t, strict=True))
    return i, j, k, (DECAY ** (k - i - 2)).astype(np.float32)


def coded(words: list[str]) -> np.ndarray:
    """Character codes of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.int64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(words, triples) feature numbers and the triples' weights; all words have one length of at least 3."""
    c = coded(words)
    i, j, k, w = subsequences(c.shape[1])
    return (((c[:, i] * 1_000_003 + c[:, j]) * 8191 + c[:, k]) * 2_654_435_761 & (1 << 40) - 1) >> 22, w


def bare(token: str) -> str:
    """A token without punctuation at its ends, with a mark in front; only that if nothing is left."""
    return "^" + token.strip("\"'.,;:!?()[]{}<>|*#%&~`-_=+/\\")


def pieces(word: str) -> list[str]:
    """Very long words are read in overlapping pieces."""
    return [word] if len(word) <= PIECE else [word[i:i + PIECE] for i in range(0, len(word) - PIECE // 2, PIECE // 2)]


class Landmarks:
    """Kernel of words with the landmarks."""

    def __init__(self, words: list[str]):
        self.words = words
        codes: dict[int, int] = {}
        rows: list[dict[int, float]] = []
        for w in words:
            f, weight = features([w])
            own: dict[int, float] = {}
            for x, v in zip(f[0].tolist(), weight.tolist(), strict=True):
                own[x] = own.get(x, 0.0) + v
            rows.append(own)
            for x in own:
                codes.setdefault(x, len(codes) + 1)
        self.index = np.zeros(TABLE, np.int32)
        self.matrix = np.zeros((len(codes) + 1, len(words)), np.float32)
        for x, n in codes.items():
            self.index[x] = n
        for m, own in enumerate(rows):
            norm = np.sqrt(sum(v * v for v in own.values()))
            for x, v in own.items():
                self.matrix[codes[x], m] = v / norm
        self.most = self.matrix.max(axis=1)[self.index]  # by feature number
        self.forget()

    def forget(self) -> None:
        """Known tokens: 4 times the row of ``rows`` (0: no landmark is close), 2 more if it ends a sentence, 1 more if it is a single character."""
        self.held: dict[str, int] = {}
        self.rows, self.used = np.zeros((1024, len(self.words)), np.float32), 1

    def kernel(self, words: list[str]) -> np.ndarray:
        """(words, landmarks); words of one length."""
        f, w = features(words)
        norm = np.float32(np.sqrt((w * w).sum()))
        out = np.zeros((len(words), len(self.words)), np.float32)
        near = np.nonzero(self.most[f] @ w >= LEAST * norm * (1 - 1e-5))[0]  # no landmark can be closer than this sum
        for a in range(0, len(near), 512):
            rows = near[a:a + 512]
            out[rows] = np.einsum("wtm,t->wm", self.matrix[self.index[f[rows]]], w) / norm
        return np.where(out >= LEAST, np.minimum(out, 1) ** POWER, 0)

    def learn(self, tokens: set[str]) -> None:
        """Put the kernels of unknown tokens into the cache."""
        by_length: dict[int, list[tuple[str, str]]] = {}
        for t in tokens:
            self.held[t] = 2 * (t[-1] in STOPS) + (len(t) == 1)
            inner = bare(t)
            letters = "^" + "".join(c for c in inner if c.isalnum()) if not inner[1:].isalnum() else inner
            for p in {*pieces(inner), *pieces(letters)}:
                if len(p) >= 3:
                    by_length.setdefault(len(p), []).append((t, p))
        for group in by_length.values():
            for a in range(0, len(group), 4096):
                part = group[a:a + 4096]
                k = self.kernel([p for _, p in part])
                for i in np.nonzero(k.any(axis=1))[0]:
                    t = part[i][0]
                    if self.held[t] < 4:
                        if self.used == len(self.rows):
                            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                        self.held[t] += 4 * self.used
                        self.used += 1
                    row = self.rows[self.held[t] >> 2]
                    np.maximum(row, k[i], out=row)

    def sentences(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Per text (sentences, landmarks) of those that have a word close to a landmark. A sentence ends with a word that ends in a stop."""
        at = 0
        while at < len(texts):
            split, size = [], 0
            while at < len(texts) and size < TOGETHER:
                split.append(texts[at].lower().split())
                size += len(texts[at])
                at += 1
            if len(self.held) > CACHE:
                self.forget()
            # unknown words of all these texts are compared with the landmarks at once
            self.learn(set().union(*split).difference(self.held))
            codes = [np.fromiter(map(self.held.__getitem__, words), np.int64, len(words)) for words in split]
            spelled = [self._spelled(words, c) for words, c in zip(split, codes, strict=True)]
            self.learn({w for own in spelled for w in own.values()}.difference(self.held))
            yield from map(self._of_text, codes, spelled)

    def _spelled(self, words: list[str], codes: np.ndarray) -> dict[int, str]:
        """Three or more single characters in a row are one word, at the place of the first."""
        single = np.nonzero(codes & 1)[0]
        if len(single) < 3:
            return {}
        runs = np.split(single, np.nonzero(np.diff(single) != 1)[0] + 1)
        return {int(run[0]): "".join(words[i] for i in run) for run in runs if len(run) > 2}

    def _of_text(self, codes: np.ndarray, spelled: dict[int, str]) -> np.ndarray:
        found, ends = np.nonzero(codes >> 2)[0], np.nonzero(codes & 2)[0]
        rows = codes[found] >> 2
        if spelled:
            more = [(i, row) for i, w in spelled.items() if (row := self.held[w] >> 2)]
            found = np.append(found, [i for i, _ in more]).astype(np.int64)
            rows = np.append(rows, [row for _, row in more]).astype(np.int64)
        if not len(found):
            return np.zeros((0, len(self.words)), np.float32)
        # each row once a sentence, sentences in order
        both = np.unique(np.searchsorted(ends, found) * self.used + rows)
        starts = np.nonzero(np.diff(both // self.used, prepend=-1))[0]
        return np.maximum.reduceat(self.rows[both % self.used], starts, axis=0)


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.offset, -30, 30)))


def labelled(docs: DataFrame, labels: DataFrame, keep: Column, sample: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """doc_id, toxic, text of at most ``sample`` documents per class, in the order of their ids' hashes; equal texts once, toxic if any of them is."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & keep).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("toxic"))
    picks = None
    for c in (0, 1):
        part = known.where(F.col("toxic") == c).orderBy(F.xxhash64("id"), "id").limit(sample)
        picks = part if picks is None else picks.union(part)
    # at most 2 * sample rows
    found = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(picks), "id")
    return found.groupBy("text").agg(F.min("id").alias("doc_id"), F.max("toxic").alias("toxic")).select("doc_id", "toxic", "text")


def choose_landmarks(train: DataFrame, marked: int = MARKED, plain: int = PLAIN) -> list[str]:
    """Words of toxic documents by count times log odds, then the most frequent words of the others."""
    totals = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    words = train.select("doc_id", "toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]{2,24}"), F.lit(0)))).alias("w"))
    counts = words.groupBy("w").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).where("t + c >= 4")
    odds = F.log((F.col("t") + 0.5) / (bad + 1)) - F.log((F.col("c") + 0.5) / (good + 1))
    top = counts.where((F.col("t") >= 4) & (odds > 2)).orderBy((F.col("t") * odds).desc(), "w").limit(marked).collect()
    rest = counts.where(odds < 0.5).orderBy(F.col("c").desc(), "w").limit(plain).collect()
    return ["^" + r["w"] for r in [*top, *rest]]


def _sentences(train: DataFrame, words: list[str]) -> DataFrame:
    """doc_id, toxic, k (float32 bytes) of the sentences to fit on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Landmarks(words)
        for b in batches:
            ids, toxic, rows = [], [], []
            for i, y, own in zip(*(b.column(k).to_pylist() for k in range(2)), marks.sentences(b.column(2).to_pylist()), strict=True):
                own = np.unique(own, axis=0)
                own = own[np.argsort(-own[:, :MARKED].sum(axis=1), kind="stable")[:PER_DOCUMENT]] if len(own) else np.zeros((1, len(words)), np.float32)
                ids += [i] * len(own)
                toxic += [y] * len(own)
                rows += [k.astype(np.float32).tobytes() for k in own]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(toxic, pa.int32()), pa.array(rows, pa.binary())], names=["doc_id", "toxic", "k"])

    return train.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(run, "doc_id bigint, toxic int, k binary")


def fit_machine(z: np.ndarray, y: np.ndarray, rounds: int = 400, penalty: float = 1e-3) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, both classes of equal weight; y is +-1."""
    x = np.hstack([z, np.ones((len(z), 1))])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w, speed = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    step = 1 / (2 * np.linalg.norm(x * np.sqrt(share)[:, None], 2) ** 2 + penalty + 1e-12)
    for r in range(rounds):
        ahead = w + speed * (r / (r + 3))
        slack = np.maximum(0, 1 - y * (x @ ahead))
        grad = -2 * (x * (share * y * slack)[:, None]).sum(axis=0) + penalty * np.append(ahead[:-1], 0)
        new = ahead - step * grad
        speed, w = new - w, new
    return w


def logistic(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset with smoothed targets, by Newton steps."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, w = np.stack([s, np.ones_like(s)], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-6 * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, x.T @ (p - t)), -2, 2)
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, keep: Column | None = None, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from at most ``sample`` labelled documents per class for which ``keep`` holds (a column of ``labels``).

    Without both classes every text scores the share of toxic labels (0 without labels).
    """
    rows = stored(labelled(docs, labels, F.lit(True) if keep is None else keep, sample, id_col, text_col, label_col), "toxic-sample")
    words = choose_landmarks(rows)
    classes = {r["toxic"] for r in rows.select("toxic").distinct().collect()}
    if not words or classes != {0, 1}:
        share = min(max(float(classes == {1}), 1e-9), 1 - 1e-9)
        return Model(words or ["^  "], np.zeros(max(1, len(words))), 0.0, 0.0, float(np.log(share / (1 - share))))
    # at most 2 * sample * PER_DOCUMENT rows of 4 bytes a landmark
    found = sorted(tuple(r) for r in _sentences(rows, words).collect())
    ids, y = np.array([r[0] for r in found]), np.array([r[1] for r in found])
    k = np.stack([np.frombuffer(r[2], np.float32) for r in found]).astype(float)
    marks = Landmarks(words)
    gram = np.vstack([marks.kernel([w]) for w in words]).astype(float)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 0.05))) @ vector.T
    z = k @ root
    docs_of, doc = np.unique(ids, return_inverse=True)
    y_doc = np.zeros(len(docs_of), int)
    np.maximum.at(y_doc, doc, y)
    s = k[:, :MARKED].sum(axis=1)  # at first the sentence closest to the landmarks of toxic texts
    w = np.zeros(z.shape[1] + 1)
    for _ in range(3):
        best = {d: i for i in np.argsort(s, kind="stable") for d in (doc[i],)}
        take = (y == 0) | np.isin(np.arange(len(y)), [i for d, i in best.items() if y_doc[d] == 1])
        w = fit_machine(z[take], np.where(y[take] == 1, 1.0, -1.0))
        s = z @ w[:-1] + w[-1]
    worst = np.full(len(docs_of), w[-1])
    np.maximum.at(worst, doc, s)
    slope, offset = logistic(worst, y_doc)
    return Model(words, root @ w[:-1], float(w[-1]), slope, offset)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """doc (the row as it was, as a struct), toxic_score (0 to 1). Null and empty texts score as texts without a suspicious word."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of landmarks
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        marks = Landmarks(m.landmarks)
        for b in batches:
            worst = np.full(b.num_rows, m.bias)
            for i, rows in enumerate(marks.sentences(b.column(1).to_pylist())):
                if len(rows):
                    worst[i] = max(m.bias, float((rows @ m.weights).max()) + m.bias)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.probability(worst))], names=["doc", "toxic_score"])

    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, toxic_score double")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that the model never learns from: crc32 of the id's text modulo 4 is 2."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def judged(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row. Labels of rows with null label or id aren't used; a document with several labels is toxic if one is."""
    model = train(docs, labels, ~held_out(id_col), id_col=id_col, text_col=text_col)
    out = score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model).select("doc.doc_id", "toxic_score")
    return out.select("doc_id", held_out().alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= threshold).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold`` with a model fitted on all labels of ``docs``."""
    return score(docs, train(docs, labels)).where(F.col("toxic_score") < threshold).select("doc.*")
