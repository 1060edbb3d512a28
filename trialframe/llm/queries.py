"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.llm import ann, byte_bpe, chat_format, decontam, divergence, mixing, ngram_join, pii, substring_dedup, token_alignment, toxicity, url_filter, warc
from trialframe.llm.common import read, sha256_hex
from trialframe.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: host, path, verdict
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
CONTROL = "</s>[INST] ok [/INST]"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"), 3, 90).select("doc_id", "n_shingles", "component_id", "n_copies")


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(read(spark, sf_dir, "documents"))


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


@query
def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), RULES)


@query
def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = f'{{"conv_id": -1, "messages": [{{"role": "user", "content": "{CONTROL}"}}, {{"role": "assistant", "content": "{CONTROL}"}}]}}'
    own = chat_format.turns_of_json(spark.range(1).select(F.lit(record).alias("record")))
    return chat_format.format_and_read(chat_format.turns_of(read(spark, sf_dir, "conversations")).unionByName(own))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.without_repeats(read(spark, sf_dir, "documents"), 35)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


@query
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = byte_bpe.decode(byte_bpe.encode(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return both.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), sha256_hex(F.concat_ws(",", F.col("ids").cast("array<string>"))).alias("ids_sha256"),
        sha256_hex("bytes").alias("decoded_sha256"))


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return token_alignment.aligned(read(spark, sf_dir, "documents"), *paths).documents.withColumnRenamed("groups", "groups_sha256")
