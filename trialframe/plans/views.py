"""How the test tables play the roles of the data model, once for Spark and once as DuckDB text.

trials   one labelled event per row (events)
samples  the events of a subject as a numbered four-channel stream
cells    the stream cut in blocks of eight samples, long form: one row per (block, channel, sample)
epochs   the same blocks, one row each with nested arrays
emb      embedding trials with a concept and a subject
preds    three-class logits and probabilities of two models per order
runs_v   accuracy per (method, regime, dataset), from preds
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.operators.ordinal import ordinal, time_bucket

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
STATUSES = ["F", "O", "P"]
BLOCK = 8


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def trials(self) -> DataFrame:
        ts = F.col("ts")
        return self.table("events").select(
            F.col("event_id").alias("epoch"),
            F.col("user_id").cast("string").alias("subject"),
            F.concat(F.lit("s"), F.floor((F.dayofmonth(ts) - 1) / 10)).alias("session"),
            F.concat(F.lit("r"), F.floor(F.hour(ts) / 8)).alias("run"),
            F.col("event_type").alias("label"),
            (F.array_position(F.array(*[F.lit(e) for e in EVENT_TYPES]), F.col("event_type")) - 1)
            .cast("int").alias("label_id"),
            ts.alias("ts"),
            F.log(1 + F.col("value")).alias("x"),
            F.col("value"),
        )

    @property
    def samples(self) -> DataFrame:
        pos = ordinal(self.trials, ["subject"], ["ts", "epoch"], time_bucket("ts"), "t")
        v, c0 = F.col("value"), F.col("x") - 4.0
        return pos.select("subject", "t", "epoch", "session", "label", "label_id", "ts", c0.alias("c0"),
                          F.sin(v).alias("c1"), F.cos(v / 7.0).alias("c2"), (c0 * F.sin(v / 3.0)).alias("c3"))

    @property
    def cells(self) -> DataFrame:
        # one shuffle of the wide rows; every later grouping by (subject, blk, …) is already co-located
        s = self.samples.withColumn("blk", F.floor(F.col("t") / BLOCK)).repartition("subject", "blk")
        channels = F.posexplode(F.array("c0", "c1", "c2", "c3")).alias("ch", "x")
        return s.select("subject", "blk", channels, (F.col("t") % BLOCK).cast("int").alias("i"))

    @property
    def epochs(self) -> DataFrame:
        s = self.samples.withColumn("blk", F.floor(F.col("t") / BLOCK))
        cell = F.struct("t", "label", "label_id", "session", F.array("c0", "c1", "c2", "c3").alias("c"))
        g = s.groupBy("subject", "blk").agg(F.sort_array(F.collect_list(cell)).alias("s"))
        return g.select("subject", "blk", F.col("s")[0]["label"].alias("label"),
                        F.col("s")[0]["label_id"].alias("label_id"), F.col("s")[0]["session"].alias("session"),
                        F.size("s").alias("n"),
                        F.transform(F.sequence(F.lit(0), F.lit(3)),
                                    lambda k: F.transform("s", lambda e: e["c"][k])).alias("x"))

    @property
    def emb(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").alias("trial"), (F.col("vec_id") % 10).cast("string").alias("subject"),
            F.col("label").alias("concept"), F.col("embedding").cast("array<double>").alias("v"))

    @property
    def preds(self) -> DataFrame:
        p, k, c = F.col("o_totalprice"), F.col("o_orderkey"), F.col("o_custkey")
        za = [F.log(p) - 11.5, F.sin(p), F.cos(p / 3.0)]
        zb = [F.cos(p / 11.0), F.sin(k + 0.5), F.log(1.0 + c) / 5.0]
        base = self.table("orders").select(
            k.alias("trial"), c.cast("string").alias("subject"), F.col("o_orderpriority").alias("fold"),
            F.year("o_orderdate").alias("year"),
            (F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("o_orderstatus")) - 1)
            .cast("int").alias("y"), F.array(*za).alias("za"), F.array(*zb).alias("zb"))

        def probs(z):
            e = [F.exp(F.col(z)[i]) for i in range(3)]
            total = e[0] + e[1] + e[2]
            return F.array(*[x / total for x in e])

        return base.withColumns({"pa": probs("za"), "pb": probs("zb")})

    @property
    def runs_v(self) -> DataFrame:
        from trialframe.functions.columns import argmax0
        both = self.preds.select("fold", "year", "y", F.explode(F.create_map(
            F.lit("a"), argmax0("pa"), F.lit("b"), argmax0("pb"))).alias("method", "yhat"))
        g = both.groupBy("method", F.concat(F.lit("y"), "year").alias("regime"), F.col("fold").alias("dataset")).agg(
            F.count(F.lit(1)).alias("n"), F.avg((F.col("y") == F.col("yhat")).cast("int")).alias("acc"))
        return g.select(F.concat_ws("_", "method", "regime", "dataset").alias("run"), "method", "regime", "dataset",
                        "n", "acc")


_EVENT_LIST = "[" + ",".join(f"'{e}'" for e in EVENT_TYPES) + "]"

SQL_VIEWS = {
    "trials": f"""SELECT event_id AS epoch, CAST(user_id AS VARCHAR) AS subject,
        's' || ((day(ts) - 1) // 10) AS session, 'r' || (hour(ts) // 8) AS run, event_type AS label,
        CAST(list_position({_EVENT_LIST}, event_type) - 1 AS INTEGER) AS label_id, ts, ln(1 + value) AS x, value
        FROM events""",
    "samples": """SELECT subject, row_number() OVER (PARTITION BY subject ORDER BY ts, epoch) - 1 AS t, epoch,
        session, label, label_id, ts, x - 4 AS c0, sin(value) AS c1, cos(value / 7) AS c2,
        (x - 4) * sin(value / 3) AS c3 FROM trials""",
    "cells": """SELECT subject, t // 8 AS blk, u.ch, u.x, CAST(t % 8 AS INTEGER) AS i FROM samples,
        LATERAL (SELECT unnest([0, 1, 2, 3]) AS ch, unnest([c0, c1, c2, c3]) AS x) u""",
    "epochs": """SELECT subject, t // 8 AS blk, first(label ORDER BY t) AS label, first(label_id ORDER BY t) AS label_id,
        first(session ORDER BY t) AS session, CAST(count(*) AS INTEGER) AS n,
        [list(c0 ORDER BY t), list(c1 ORDER BY t), list(c2 ORDER BY t), list(c3 ORDER BY t)] AS x
        FROM samples GROUP BY subject, t // 8""",
    "emb": """SELECT vec_id AS trial, CAST(vec_id % 10 AS VARCHAR) AS subject, label AS concept,
        CAST(embedding AS DOUBLE[]) AS v FROM embeddings""",
    "preds_z": """SELECT o_orderkey AS trial, CAST(o_custkey AS VARCHAR) AS subject, o_orderpriority AS fold,
        CAST(year(o_orderdate) AS INTEGER) AS year,
        CAST(list_position(['F', 'O', 'P'], o_orderstatus) - 1 AS INTEGER) AS y,
        [ln(o_totalprice) - 11.5, sin(o_totalprice), cos(o_totalprice / 3)] AS za,
        [cos(o_totalprice / 11), sin(o_orderkey + 0.5), ln(1.0::DOUBLE + o_custkey) / 5] AS zb FROM orders""",
    "preds": """SELECT *, list_transform(za, lambda q: exp(q) / (exp(za[1]) + exp(za[2]) + exp(za[3]))) AS pa,
        list_transform(zb, lambda q: exp(q) / (exp(zb[1]) + exp(zb[2]) + exp(zb[3]))) AS pb FROM preds_z""",
    "runs_v": """SELECT method || '_y' || year || '_' || fold AS run, method, 'y' || year AS regime, fold AS dataset,
        count(*) AS n, avg(CAST(y = list_position(p, list_max(p)) - 1 AS INTEGER)) AS acc
        FROM (SELECT 'a' AS method, fold, year, y, pa AS p FROM preds
              UNION ALL SELECT 'b', fold, year, y, pb FROM preds) GROUP BY ALL""",
}


def sql_with_views(body: str) -> str:
    """Put the views the text names (and theirs) in front as common table expressions."""
    wanted: list[str] = []

    def need(text: str) -> None:
        for name, sql in SQL_VIEWS.items():
            if name not in wanted and re.search(rf"\b{name}\b", text):
                need(sql)
                if name not in wanted:
                    wanted.append(name)

    need(body)
    if not wanted:
        return body
    head = ", ".join(f"{n} AS ({SQL_VIEWS[n]})" for n in wanted)
    body = body.strip()
    return f"WITH {head}, {body[4:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
