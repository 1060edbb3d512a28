"""Streams equal their batch operators."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialframe.operators.epoching import block_epochs
from trialframe.operators.normalize import ewm_standardize
from trialframe.streaming.epochs import run_to_table, stream_epochs, stream_standardize, unfinished


def written(spark, tmp_path, name, frames, schema):
    """One file per micro-batch, read back as a stream."""
    path = str(tmp_path / name)
    for f in frames:
        spark.createDataFrame(f, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_standardize_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    parts = [pd.DataFrame({"rec": np.repeat(["a", "b"], 40), "t": np.tile(np.arange(k * 40, k * 40 + 40), 2), "v": rng.standard_normal(80)})
             for k in range(3)]
    s = written(spark, tmp_path, "s", [p.sample(frac=1, random_state=1) for p in parts], "rec string, t bigint, v double")
    got = run_to_table(stream_standardize(s, ["t"], "v", 0.05, 50), str(tmp_path / "out")).orderBy("rec", "t").toPandas()
    batch = spark.createDataFrame(pd.concat(parts))
    want = ewm_standardize(batch, "v", 0.05, 50, chunk=32).orderBy("rec", "t").toPandas()
    assert len(got) == 240 and np.allclose(got["z"], want["z"])


def short_and_long():
    """Recordings of 5, 49, 50, 51 and 120 samples; the one of 5 comes over three micro-batches."""
    rng = np.random.default_rng(2)
    rows = [(f"r{n}", i, datetime(2024, 1, 1) + timedelta(seconds=i), float(rng.standard_normal())) for n in (5, 49, 50, 51, 120) for i in range(n)]
    rows.append(("one", 0, datetime(2024, 1, 1), 2.5))
    frame = pd.DataFrame(rows, columns=["rec", "t", "at", "v"])
    part = np.where(frame["rec"] == "r5", frame["t"] // 2, frame["t"] // 40)
    return frame, [frame[part == k] for k in range(3)]


def standardized(df):
    return df.orderBy("rec", "t").toPandas()


def test_recordings_shorter_than_the_start_come_out_at_the_end_of_input(spark, tmp_path):
    frame, parts = short_and_long()
    s = written(spark, tmp_path, "s", parts, "rec string, t bigint, at timestamp, v double")
    out = run_to_table(stream_standardize(s, ["t"], "v", 0.05, 50), str(tmp_path / "out"))
    assert {r["rec"] for r in out.select("rec").distinct().collect()} == {"r50", "r51", "r120"}
    got = standardized(out.unionByName(unfinished(spark, str(tmp_path / "out-progress"), 50)))
    want = standardized(ewm_standardize(spark.createDataFrame(frame.drop(columns="at")), "v", 0.05, 50, chunk=32))
    assert len(got) == len(want) == 276 and (got[["rec", "t"]] == want[["rec", "t"]]).all(axis=None) and np.allclose(got["z"], want["z"])


def test_recordings_shorter_than_the_start_come_out_when_idle(spark, tmp_path):
    frame, parts = short_and_long()
    end = pd.DataFrame([("end", 0, datetime(2024, 1, 2), 0.0)], columns=["rec", "t", "at", "v"])     # moves the watermark past all
    s = written(spark, tmp_path, "s", [*parts, end], "rec string, t bigint, at timestamp, v double")
    out = run_to_table(stream_standardize(s, ["t"], "v", 0.05, 50, at="at", idle=60.0, late="5 minutes"), str(tmp_path / "out"))
    got = standardized(out)
    want = standardized(ewm_standardize(spark.createDataFrame(frame.drop(columns="at")), "v", 0.05, 50, chunk=32))
    assert len(got) == len(want) and (got[["rec", "t"]] == want[["rec", "t"]]).all(axis=None) and np.allclose(got["z"], want["z"])
    rest = unfinished(spark, str(tmp_path / "out-progress"), 50).collect()
    assert [(r["rec"], r["t"]) for r in rest] == [("end", 0)]


@pytest.mark.parametrize("files", [1, 4])
def test_stream_epochs_equals_batch(spark, tmp_path, files):
    n = 60
    at = lambda i: datetime(2024, 1, 1) + timedelta(seconds=i)
    rows = [(r, i, at(i), [float(i), float(-i)]) for i in range(n) for r in ("a", "b")]
    rows = [r for r in rows if not (r[0] == "b" and 30 <= r[1] < 32)]                       # a gap discards its windows
    rows += [("end", 0, at(9999), [0.0, 0.0])]                 # moves the watermark past all windows
    ev = [(r, 10 * o + k, o, at(o), "x") for k, r in enumerate("ab") for o in (1, 2, 20, 29, 55, 56, 57)]
    ev += [("end", 9999, 0, at(9999), "x")]
    cut = lambda seq: [seq[len(seq) * i // files: len(seq) * (i + 1) // files] for i in range(files)]
    s = written(spark, tmp_path, "s", cut(sorted(rows, key=lambda r: r[2])), "rec string, t bigint, at timestamp, c array<double>")
    e = written(spark, tmp_path, "e", cut(sorted(ev, key=lambda r: r[3])), "rec string, event int, onset bigint, onset_at timestamp, label string")
    got = run_to_table(stream_epochs(s, e, 1.0, -2, 4, "20 seconds"), str(tmp_path / "out")).orderBy("event").collect()
    samples = spark.createDataFrame([(r[0], r[1], r[3]) for r in rows], "rec string, t bigint, c array<double>")
    events = spark.createDataFrame([(r[0], r[1], r[2], r[4]) for r in ev], "rec string, event int, onset bigint, label string")
    want = block_epochs(samples, events, 1.0, -2, 4).filter(F.col("rec") != "end").orderBy("event").collect()
    assert [(r["event"], r["x"]) for r in got] == [(r["event"], r["x"]) for r in want]
    assert {r["event"] for r in want if r["rec"] == "b"} == {21, 201, 551, 561}
