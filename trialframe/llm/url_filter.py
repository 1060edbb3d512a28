"""URL rules looked up in a sorted array of 64-bit digests.

The rules' keys (host, path) are hashed with xxhash64 and sorted; digests and full keys lie in one file that each Python
worker memory-maps. A url's candidate keys (its host's suffixes at label borders, its path's prefixes of the lengths that
rules have) are probed by vectorised binary search, and every digest hit is confirmed against the stored key.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: host, path, verdict
Rule = tuple[str, str, str]

#: The digest file goes to every worker up to this many rules; more are joined by shuffle.
MAX_MAPPED_RULES = 2_000_000


def host_of(url: Column) -> Column:
    """From the first ``://`` to the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def digest_file(rules: list[Rule], digest=xxhash.xxh64_intdigest) -> bytes:
    """Number of rules; sorted digests; key offsets; verdicts (1: block); keys."""
    rows = sorted((digest(k := f"{h}\0{p}".encode()), k, v == "block") for h, p, v in rules)
    keys = b"".join(k for _, k, _ in rows)
    ends = np.cumsum([0] + [len(k) for _, k, _ in rows])
    return b"".join([np.array([len(rows)], np.uint64).tobytes(), np.array([d for d, _, _ in rows], np.uint64).tobytes(),
                     ends.astype(np.uint64).tobytes(), np.array([b for _, _, b in rows], np.uint8).tobytes(), keys])


class DigestArray:
    """A memory-mapped digest file."""

    def __init__(self, data: bytes):
        self.file = tempfile.TemporaryFile()  # nameless: gone with the worker
        self.file.write(data)
        self.file.flush()
        m = np.memmap(self.file, np.uint8, "r")
        n = int(m[:8].view(np.uint64)[0])
        self.n, self.digests = n, m[8:8 + 8 * n].view(np.uint64)
        at = 8 + 8 * n
        self.ends = m[at:at + 8 * (n + 1)].view(np.uint64)
        at += 8 * (n + 1)
        self.block, self.keys = m[at:at + n], m[at + n:]

    def find(self, keys: list[bytes], digest=xxhash.xxh64_intdigest) -> np.ndarray:
        """Index of each key's rule, -1 for none."""
        out = np.full(len(keys), -1)
        if not keys or not self.n:
            return out
        d = np.fromiter(map(digest, keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, d)
        for i in np.nonzero(self.digests[np.minimum(at, self.n - 1)] == d)[0]:
            j = int(at[i])
            while j < self.n and self.digests[j] == d[i]:  # equal digests stand side by side
                if self.keys[int(self.ends[j]):int(self.ends[j + 1])].tobytes() == keys[i]:
                    out[i] = j
                    break
                j += 1
        return out


def candidates(host: str, path: str, labels: int, lengths: list[int]) -> list[bytes]:
    """Keys of every rule that could fit, the longest first."""
    ends, at = [host], 0
    if (parts := host.count(".")) >= labels:  # no rule has more labels
        for _ in range(parts - labels + 1):
            at = host.find(".", at) + 1
        ends = [host[at:]]
    tail = ends[0]
    while (dot := tail.find(".")) >= 0:
        tail = tail[dot + 1:]
        ends.append(tail)
    keys = [(len(h) + n, f"{h}\0{path[:n]}".encode()) for h in ends for n in lengths if n <= len(path)]
    return [k for _, k in sorted(keys, key=lambda x: -x[0])]


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule (host and path of the longest rule that fits, else null), verdict.

    Null urls and urls without ``://`` have an empty host and path, which no rule with a host fits. Repeated rows are judged
    alike; other columns are ignored. Of rules of equal length the one with the longer host wins; of equal keys, block.
    """
    rules = list({(h, p): (h, p, v) for h, p, v in sorted(rules, key=lambda r: r[2] == "block")}.values())
    urls = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if len(rules) > MAX_MAPPED_RULES:
        return judge_by_join(urls, rules, default, id_col)
    held = pages.sparkSession.sparkContext.broadcast(digest_file(rules))
    labels = max([r[0].count(".") + 1 for r in rules], default=1)
    lengths = sorted({len(r[1]) for r in rules})

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = DigestArray(held.value)
        for b in batches:
            keys, of = [], []
            for i, (h, p) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                own = candidates(h, p, labels, lengths) if h else []
                keys += own
                of += [i] * len(own)
            found = table.find(keys)
            rule, verdict = [None] * b.num_rows, [default] * b.num_rows
            for j in np.nonzero(found >= 0)[0][::-1]:  # the longest stands first and is written last
                rule[of[j]] = keys[j].decode().replace("\0", "", 1)
                verdict[of[j]] = "block" if table.block[found[j]] else "allow"
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                                             names=[*b.schema.names, "rule", "verdict"])

    return urls.mapInArrow(probe, f"{id_col} {urls.schema[id_col].dataType.simpleString()}, host string, path string, rule string, verdict string")


def judge_by_join(urls: DataFrame, rules: list[Rule], default: str, id_col: str) -> DataFrame:
    """The same for rule sets too large to map: candidate keys of distinct (host, path) meet the rules by equi-join."""
    spark = urls.sparkSession
    table = spark.createDataFrame(pa.table({"rh": [r[0] for r in rules], "rp": [r[1] for r in rules], "v": [r[2] for r in rules]}))
    lengths = F.array(*[F.lit(n) for n in sorted({len(r[1]) for r in rules})])
    most = max(r[0].count(".") + 1 for r in rules)
    parts = F.split("host", r"\.")
    pairs = urls.select("host", "path").distinct()
    probes = (pairs.where("host <> ''")
              .withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(most)))))
              .withColumn("rh", F.array_join(F.slice(parts, F.size(parts) - F.col("k") + 1, F.col("k")), "."))
              .withColumn("n", F.explode(lengths)).where(F.col("n") <= F.length("path"))
              .withColumn("rp", F.expr("substring(path, 1, n)")))
    best = probes.join(table, ["rh", "rp"]).groupBy("host", "path").agg(
        F.max(F.struct((F.length("rh") + F.length("rp")).alias("n"), F.length("rh").alias("m"), F.concat("rh", "rp").alias("rule"), "v")).alias("b"))
    return urls.join(best, ["host", "path"], "left").select(
        id_col, "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.v", F.lit(default)).alias("verdict"))
