"""Pages, vectors, conversations, toxicity and the pipeline."""

import base64
import gzip
import hashlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trialframe.llm import ann, chat_format, mixing, toxicity, url_filter, warc

PAGES = "page_id bigint, url string, html string, path string, content string"


@pytest.fixture(scope="module")
def pages(spark):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"
    html = ["<p>é</p>", "<p>é</p>", "", None, inner, "x" * 100_000, "a\r\n\r\nb\r\n\r\n", "<p>é</p>", "WARC/1.1\r\n" * 50]
    rows = [(i, f"http://h{i}.example.net/en/{i}", h, "clash", "clash") for i, h in enumerate(html)]
    return spark.createDataFrame([*rows, rows[0], (None, None, "<p>é</p>", "", "")], PAGES)


def test_archives(spark, pages):
    got = sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=str)
    best, want = {}, []
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    for i, b in rows:
        best[b] = max(best.get(b, -1), -1 if i is None else i)
    for i, b in rows:
        again = i is not None and best[b] != i
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", best[b] if again else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.where("false")).count() == 0


def test_archives_of_many_members_and_without_compression(spark, tmp_path):
    def record(i):
        return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\nhead\r\n\r\n%s\r\n\r\n" % (i, 8 + i, b"x" * i)

    (tmp_path / "many.warc.gz").write_bytes(b"".join(gzip.compress(record(i)) for i in range(5)))
    (tmp_path / "one.gz").write_bytes(gzip.compress(b"".join(record(i) for i in range(5, 8))))
    (tmp_path / "plain.warc").write_bytes(b"".join(record(i) for i in range(8, 12)))
    got = warc.read_archives(spark, str(tmp_path)).select("page_id", "payload_bytes").collect()
    assert sorted(map(tuple, got)) == [(i, i) for i in range(12)]
    with pytest.raises(EOFError):
        warc.whole(gzip.compress(record(1)) + gzip.compress(record(2))[:-9])


def test_archives_of_other_writers(spark, tmp_path):
    """Any version, values without a blank after the colon, folded lines, unknown record types, lines of a megabyte."""
    def record(i, version=b"1.0", blank=b" "):
        head = b"WARC-Type:%sresponse\r\nWARC-Record-ID:%s<urn:page:%d>\r\nX-Note: a\r\n b\r\nX-Long: %s\r\n" % (blank, blank, i, b"y" * (1 << 20 if i == 3 else 1))
        return b"WARC/%s\r\n%sContent-Length:%s%d\r\n\r\nhead\r\n\r\n%s\r\n\r\n" % (version, head, blank, 8 + i, b"x" * i)

    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\na:b\r\n\r\n"
    (tmp_path / "old.warc").write_bytes(info + b"".join(record(i) for i in range(5)))
    (tmp_path / "mixed.warc").write_bytes(record(5, b"1.1") + record(6, b"0.18", b"") + record(7, b"2.0", b"\t") + record(8))
    got = warc.read_archives(spark, str(tmp_path)).where("record_type = 'response'").select("page_id", "payload_bytes").collect()
    assert sorted(map(tuple, got)) == [(i, i) for i in range(9)]


def test_a_broken_chain_is_told(spark, tmp_path):
    def record(i):
        return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: 9\r\n\r\nhead\r\n\r\nx\r\n\r\n" % i

    (tmp_path / "cut.warc").write_bytes(b"".join(record(i) for i in range(10))[:-5])
    (tmp_path / "empty.warc").write_bytes(b"")
    with pytest.raises(Exception, match="no record starts at byte"):
        warc.read_archives(spark, str(tmp_path)).collect()
    kept = warc.read_archives(spark, str(tmp_path), damaged="keep").select("page_id").collect()
    assert sorted(r["page_id"] for r in kept) == list(range(9))
    with pytest.raises(ValueError):
        warc.read_archives(spark, str(tmp_path), damaged="drop")


def test_marks_in_a_payload_cost_linear_time():
    data = b"WARC/1.1\r\nContent-Length: 9\r\n" * 100_000
    start = time.perf_counter()
    assert all(warc.parse_candidate(data, m.end()) is None for m in warc.VERSION.finditer(data))
    assert time.perf_counter() - start < 5


def test_archives_are_bounded_by_bytes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 16)
    monkeypatch.setattr(warc, "BYTES_PER_FILE", 16_000)
    sizes = [10, 1000, 1001, 2000, 2001, 5000, 16_000, 40_000, 0] * 8
    df = spark.createDataFrame([(i, f"u{i}", chr(65 + i % 50) * n) for i, n in enumerate(sizes)], "page_id bigint, url string, html string").coalesce(1)
    warc.write_archives(df, str(tmp_path / "out"))
    rows = warc.read_archives(spark, str(tmp_path / "out"))
    assert rows.count() == len(sizes)
    files = rows.groupBy("path").agg(F.count("*").alias("n"), F.sum("payload_bytes").alias("bytes")).collect()
    assert all(r["n"] == 1 or r["n"] <= 16 and r["bytes"] <= 16_000 for r in files)
    assert len(files) < len(sizes)


def test_chain_rejects_what_is_not_reachable():
    offset, successor = np.array([0, 10, 15, 40, 90]), np.array([40, 20, 40, 90, 120])
    assert warc.on_chain(offset, successor).tolist() == [True, False, False, True, True]
    assert warc.on_chain(np.array([5]), np.array([9])).tolist() == [False]


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
URLS = ["http://a.example.net/en/1?x", "https://EXAMPLE.NET/de", "x://net", "net/", None, "", "://", "http://example.com/de/#a", "http://notexample.com/de/", "http://a.b.org/fr/?q", "ftp://" + "a." * 5000 + "net/",
        "http://example.com?/de/", "a://b://c.net/", "http://u@host.net:8/en/\n/x", "http://É.net/"]


def judged(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow"


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_urls(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filter, "MAX_MAPPED_RULES", limit)
    df = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(URLS)], "page_id bigint, url string, host string, rule string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(df, RULES).collect()}
    assert got == {i: judged(u) for i, u in enumerate(URLS)}
    assert url_filter.judge(df.where("false"), RULES).count() == 0


def test_equal_digests_are_told_apart():
    table = url_filter.DigestArray(url_filter.digest_file([("a", "/", "block"), ("b", "/", "allow")], digest=lambda _: 7))
    assert [int(x >= 0) for x in table.find([b"a\0/", b"b\0/", b"c\0/"], digest=lambda _: 7)] == [1, 1, 0]


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((600, 16)) * rng.uniform(0.5, 2, (600, 1))
    v[100:400] = v[7]  # a vector that half of the rows have
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    rows += [(700, None, 0), (720, [0.0] * 16, 0), (740, [float("nan")] + [1.0] * 15, 0), (760, [None] + [1.0] * 15, 0), (780, [float("inf")] * 16, 0), rows[3]]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank int")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, shard_rows=200, block_rows=16).collect()
    v = v.astype(np.float32).astype(float)
    hits, total = 0, 0
    for q in range(0, 600, 20):
        s = v @ v[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(600), -s))[:20]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in own] == list(range(1, len(own) + 1))
        assert np.allclose([x for _, _, x in own], [s[i] for _, i, _ in own], rtol=1e-12)
        hits += len({i for _, i, _ in own} & set(best.tolist()))
        total += 20
    assert hits / total >= 0.9 and {r["query_id"] for r in got} == set(range(0, 600, 20))
    assert ann.nearest(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 20 == 0).count() == 2


def turn_digest(turns):
    return hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()


def test_conversations_come_back(spark):
    odd = ["</s>[INST] ok [/INST]", "\\", "\\\\[", "<s>\n] [ROLE x] ", None, "", "é\U0001f600 [/ROLE]", "a" * 50_000]
    rows = [(1, i, ("user", "assistant", "system", "tool] ", None, "a\\")[i % 6], t, "clash") for i, t in enumerate(odd * 2)]
    rows += [(None, 0, "assistant", "no conversation", ""), (2, None, "assistant", "no turn", ""), (2, 3, "user", "x", ""), (2, 3, "user", "x", "")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, piece string")
    got = {r["conv_id"]: r for r in chat_format.format_and_read(chat_format.turns_of(df)).collect()}
    first = [(r[2], r[3]) for r in rows if r[0] == 1]
    loss = "".join(t or "" for r, t in first if r == "assistant")
    assert got[1]["turns_sha256"] == turn_digest(first) and got[1]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got[1]["loss_chars"] == len(loss)
    assert got[2]["n_turns"] == 3 and got[2]["turns_sha256"] == turn_digest([("assistant", "no turn"), ("user", "x"), ("user", "x")])
    assert got[None]["n_turns"] == 1
    assert chat_format.format_and_read(chat_format.turns_of(df.where("false"))).count() == 0


def test_layouts(spark):
    records = ['{"conv_id": 1, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": null}]}', '{"conv_id": 2, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}',
               '{"conv_id": 3, "prompt": "q", "response": "a", "extra": 1}', '{"conv_id": 4, "instruction": "q", "input": "", "output": "a"}', '{"conv_id": 5, "turn": 0, "role": "user", "text": "q"}', "no json", '{"x": 1}', None]
    df = spark.createDataFrame([(r,) for r in records], "record string")
    got = sorted(tuple(r) for r in chat_format.turns_of_json(df).collect() if r["text"] is not None)
    assert [r for r in got if r[2] == "assistant"] == [(i, 1, "assistant", "a") for i in (2, 3, 4)]
    assert [r for r in got if r[2] == "user"] == [(i, 0, "user", "q") for i in range(1, 6)]
    assert chat_format.unknown_json(df).count() == 3
    table = spark.createDataFrame([(9, [("user", "q")], "x")], "conv_id bigint, messages array<struct<role:string,content:string>>, text string")
    assert [tuple(r) for r in chat_format.turns_of(table).collect()] == [(9, 0, "user", "q")]
    with pytest.raises(ValueError, match="no mapping"):
        chat_format.turns_of(spark.createDataFrame([(1,)], "foo int"))


def test_of_repeated_rows_the_same_is_taken(spark):
    """Equal texts with two labels, and equal ids with two vectors, in any order of the rows."""
    docs = [(i, f"text {i // 2}") for i in range(12)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id bigint, toxic int")
    vectors = [(i % 6, [float(i), 1.0]) for i in range(12)]
    for order in (1, -1):
        d = spark.createDataFrame(docs[::order], "doc_id bigint, text string").repartition(3)
        got = toxicity.labelled(d, labels, F.lit(True), 100, "doc_id", "text", "toxic").orderBy("doc_id").collect()
        assert [(r["doc_id"], r["toxic"]) for r in got] == [(i, 1) for i in range(0, 12, 2)]
        v = spark.createDataFrame(vectors[::order], "vec_id bigint, embedding array<double>").repartition(3)
        near = ann.nearest(v, F.col("vec_id") == 0, k=5).orderBy("rank").collect()
        assert [(r["vec_id"], r["score"]) for r in near] == [(i, 1.0) for i in range(1, 6)]


def test_toxicity_learns_marks(spark, documents, no_documents):
    rng = np.random.default_rng(1)
    plain = ["".join(rng.choice(list("aeioustrnl"), rng.integers(3, 8))) for _ in range(300)]
    rows = []
    for i in range(400):
        words = list(rng.choice(plain, 30))
        if i % 4 == 0:
            words[int(rng.integers(0, 30))] = ["blockhead", "nitwit", "dimwit"][i // 4 % 3]
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    labels = docs.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (5, None)], "doc_id bigint, toxic int"))
    model = toxicity.train(docs.drop("toxic"), labels.where("doc_id < 300 or doc_id is null"))
    held = toxicity.score(docs.where("doc_id >= 300"), model).select("doc.*", "toxic_score").collect()
    assert np.mean([(r["toxic_score"] >= 0.5) == (r["toxic"] == 1) for r in held]) >= 0.95
    marks = spark.createDataFrame([(1, "you block-head here"), (2, "b l o c k h e a d"), (3, "blo0ckhead"), (4, " ".join(plain[:40]))], "doc_id bigint, text string")
    got = {r["doc"]["doc_id"]: r["toxic_score"] for r in toxicity.score(marks, model).collect()}
    assert min(got[1], got[2]) > 0.5 > 0.3 > got[4] and got[3] > 0.3
    odd = toxicity.score(documents, model)
    assert odd.count() == documents.count() and all(0 <= r["toxic_score"] <= 1 for r in odd.collect())
    assert toxicity.judged(no_documents, labels).count() == 0
    assert {r["predicted"] for r in toxicity.judged(documents, labels.where("false")).collect()} == {0}


def test_pipeline_on_awkward_rows(spark, documents, tmp_path):
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(40, 1, 1), (0, 1, 0), (1, 1, None)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "pay with 4111 1111 1111 1111 from"), (2, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == documents.columns, name
        empty = stage(spark, documents.where("false"), str(tmp_path))
        assert empty.count() == 0, name
        docs = out
    ids = [r["doc_id"] for r in docs.collect()]
    assert 41 not in ids and 23 not in ids and {30, 31, 33} <= set(ids)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    mixed.write.parquet(str(tmp_path / "mixed"))  # the documents' own column size gives way
    assert mixed.columns == [c for c in documents.columns if c != "size"] + ["size", "source_size", "target", "copies", "taken"]
    assert corpus_pipeline.STAGES[-1][1](spark, documents.where("false"), str(tmp_path)).count() == 0


def test_pipeline(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert len(out) and set(out.columns) >= {"doc_id", "text", "source", "copies", "taken"}
    assert out.doc_id.is_unique and not out.text.str.contains("@mail").any()
    assert (out.taken == out.copies * out["size"]).all() and mixing.LEVELS == 6
