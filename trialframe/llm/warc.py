"""WARC archives: written as gzip text parts, read back by boundary-chain verification.

Reading: each task looks for every place in its archives where a record could start and emits it with the offset at which
its header says the successor starts. Pointer jumping from offset 0 keeps the records on the chain; a record mark inside a
payload isn't reachable and goes.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.llm.common import text_or_empty
from trialframe.session import fresh_table_path

CRLF = "\r\n"
MAGIC = b"WARC/1.1\r\n"
VERSION = re.compile(rb"WARC/[0-9]+\.[0-9]+\r\n")
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Records and payload bytes per archive file, which bound what a reading task holds; one record may have more bytes.
RECORDS_PER_FILE, BYTES_PER_FILE = 4000, 1 << 28
#: Digits of base 32: those of Spark's conv and those of RFC 4648, both in order (fixed values).
CONV32, RFC32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD = "path string, offset bigint, successor bigint, page_id bigint, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base 32 of the SHA-1: five bits a digit, ten hex digits at a time."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), CONV32, RFC32)


def with_types(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to.

    Of records with equal payloads of at least ``min_bytes`` bytes the one with the largest page_id is the response, the others
    revisit it; smaller ones are responses. Null html is an empty payload. Rows with a null page_id are responses that
    nothing refers to; equal rows of the largest page_id are all responses.
    """
    html = text_or_empty(html_col)
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("html").cast("bigint"), "payload_digest": base32_sha1(F.col("html"))})
    best = (rows.where((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("payload_digest", "payload_bytes")
            .agg(F.max("page_id").alias("best"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "payload_bytes", "best"))
    got = rows.join(best, ["payload_digest", "payload_bytes"], "left")
    refers = F.when(F.col("page_id").isNotNull() & (F.col("best") != F.col("page_id")), F.col("best"))
    return got.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(refers.isNull(), "response").otherwise("revisit").alias("record_type"),
                      refers.alias("refers_to"))


def record_text(rows: DataFrame) -> DataFrame:
    """value: one whole record per row, without the two line ends that close it."""
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, F.lit("")).otherwise(F.concat(F.lit(HTTP), F.col("html")))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")
    key = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    return rows.select(F.concat(
        F.lit(MAGIC.decode()), F.lit("WARC-Type: "), F.col("record_type"), F.lit(CRLF + "WARC-Record-ID: <urn:page:"), key, F.lit(">" + CRLF),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">" + CRLF))).otherwise(F.lit("")),
        F.lit("WARC-Target-URI: "), url, F.lit(CRLF + "WARC-Date: 2000-01-01T00:00:00Z" + CRLF + "WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.lit(CRLF + "X-Payload-Bytes: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + "Content-Type: application/http; msgtype=response" + CRLF + "Content-Length: "),
        F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block).alias("value"))


def size_class(payload_bytes: Column) -> Column:
    """The least k so that 2^k times ``BYTES_PER_FILE / RECORDS_PER_FILE`` bytes hold the payload."""
    fit = BYTES_PER_FILE // RECORDS_PER_FILE
    return F.when(payload_bytes <= fit, 0).otherwise(F.length(F.bin(F.floor((payload_bytes - 1) / fit))))


def write_archives(pages: DataFrame, path: str, **columns) -> None:
    """Gzip archives of up to ``RECORDS_PER_FILE`` records and ``BYTES_PER_FILE`` payload bytes of a task. The text writer's line
    separator closes each record. Records of a size class are written together, with half as many a file from class to class."""
    rows = with_types(pages, **columns)
    length = F.octet_length(text_or_empty(columns.get("html_col", "html"))).cast("bigint")
    classes = sorted(r["k"] for r in pages.select(size_class(length).alias("k")).distinct().collect()) or [0]
    for k in classes:
        own = rows.where(size_class(F.col("payload_bytes")) == k) if len(classes) > 1 else rows
        out = record_text(own).write.mode("append" if k != classes[0] else "errorifexists").option("lineSep", CRLF * 2).option("compression", "gzip")
        out.option("maxRecordsPerFile", max(1, RECORDS_PER_FILE >> k)).text(path)


def whole(content: bytes) -> bytes:
    """The bytes of an archive, of all members of a gzip one; one that is cut off or followed by other bytes raises."""
    return gzip.GzipFile(fileobj=io.BytesIO(content)).read() if content[:2] == b"\x1f\x8b" else content


def parse_candidate(data: bytes, at: int) -> tuple[int, dict[str, str], int] | None:
    """Successor's offset, header fields and block start of the record whose version line ends before ``at``; None if it can't be one.

    A field's value may follow its colon at once or after blanks and go on in lines that begin with a blank. Reading stops at the
    first line that is none of this, so marks in a row cost no more than one.
    """
    head: dict[str, str] = {}
    name = ""
    while (end := data.find(b"\r\n", at)) > at:
        line = data[at:end]
        at = end + 2
        if line[:1] in b" \t" and name:
            head[name] += " " + line.decode("utf-8", "replace").strip()
            continue
        k, colon, v = line.partition(b":")
        if not colon or not k or k != k.strip():
            return None
        name = k.decode("latin-1").lower()
        head[name] = v.decode("utf-8", "replace").strip()
    size = head.get("content-length", "")
    if end < 0 or not (size.isascii() and size.isdigit()):
        return None
    after = end + 2 + int(size) + 4
    return (after, head, end + 2) if after <= len(data) and data[after - 4:after] == b"\r\n\r\n" else None


def candidate_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    number = lambda s: int(s) if s.lstrip("-").isdigit() else None
    for b in batches:
        for path, content in zip(b.column("path"), b.column("content"), strict=True):
            data = whole(content.as_py())
            rows = [(path.as_py(), len(data), None, None, None, None, None, None)]  # the end, which the chain has to reach
            for mark in VERSION.finditer(data):
                at = mark.start()
                if (found := parse_candidate(data, mark.end())) is not None:
                    after, head, start = found
                    payload = data[start:after - 4].partition(b"\r\n\r\n")[2]
                    kind = head.get("warc-type", "")
                    refers = head.get("warc-refers-to", "")[len("<urn:page:"):-1]
                    response = kind == "response"  # digest and length of the bytes read; a revisit names those of its payload
                    rows.append((path.as_py(), at, after, number(head.get("warc-record-id", "")[len("<urn:page:"):-1]), kind, number(refers),
                                 len(payload) if response else number(head.get("x-payload-bytes", "")),
                                 base64.b32encode(hashlib.sha1(payload).digest()).decode() if response else head.get("warc-payload-digest", "").removeprefix("sha1:")))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=names)


def on_chain(offset: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Which records pointer jumping from offset 0 reaches. ``offset`` is sorted; after k rounds a record knows its 2^k-th successor."""
    n = len(offset)
    if not n:
        return np.zeros(0, bool)
    at = np.searchsorted(offset, successor)
    jump = np.append(np.where((at < n) & (offset[np.minimum(at, n - 1)] == successor), at, n), n)  # n: none
    reach = np.zeros(n + 1, bool)
    reach[0] = offset[0] == 0
    for _ in range(int(n).bit_length()):
        reach[jump[reach]] = True
        jump = jump[jump]
    return reach[:n]


def chained(table: pa.Table, damaged: str) -> pa.Table:
    table = table.sort_by("offset")
    offset, successor = table.column("offset").to_numpy(), table.column("successor").fill_null(-1).to_numpy()
    reached = on_chain(offset, successor)
    if not reached[-1] and damaged == "raise":
        last = int(successor[reached].max()) if reached.any() else 0
        raise ValueError(f"{table.column('path')[0]}: no record starts at byte {last} of {offset[-1]}")
    reached[-1] = False
    return table.filter(pa.array(reached))


def read_archives(spark: SparkSession, path: str, damaged: str = "raise") -> DataFrame:
    """The records of all archives under ``path``, gzip of one or many members or uncompressed; columns as in ``RECORD``.

    Records of any version are read, with or without blanks after the colons of their header. Where the chain of records breaks
    before the archive's end, as in one that is cut off, ``damaged`` tells whether to raise (the default) or to ``keep`` the records
    before the break. A gzip member that is cut off raises always.

    An archive is read whole by one task (the writer bounds its records); its candidates, some 100 bytes each, meet in one
    group to be chained. A folder without archives has no records.
    """
    if damaged not in ("raise", "keep"):
        raise ValueError(f"damaged is raise or keep, not {damaged!r}")
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(candidate_records, RECORD).groupBy("path").applyInArrow(lambda archive: chained(archive, damaged), RECORD)


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every row, written and read back."""
    spark = pages.sparkSession
    path = fresh_table_path(spark, "warc")
    write_archives(pages, path, **columns)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
