"""A corpus from raw documents in five stages: toxicity, near duplicates, benchmark decontamination, personal data, source mix.

Each stage takes the documents that the one before kept and is written as Parquet in the shared folder before the next reads it;
the tables on the way to it are deleted then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.llm import decontam, mixing, ngram_join, pii, toxicity
from trialframe.llm.common import only_stored, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine, fitted on the labelled ones, scores below 0.3."""
    return toxicity.clean(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by a Jaccard similarity of 0.8 on five-word shingles."""
    return ngram_join.one_of_each(docs, 5, 80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets; n_chars follows the text."""
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their number of copies and the words taken. A column of the documents that has the name of
    one of these five gives way to it. Null and empty texts are chosen like others and bring no words; rows that repeat an id are
    chosen together; an empty table gives no rows."""
    own = ["size", "source_size", "target", "copies", "taken"]
    return mixing.mixed_documents(docs).select(*[F.col("doc")[c].alias(c) for c in docs.columns if c.lower() not in own], *own)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
]

#: A fitted machine and connected components have no SQL form; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    def after(stages: list) -> DataFrame:
        if not stages:
            return read(spark, sf_dir, "documents")
        *before, (name, stage) = stages
        return only_stored(lambda: stage(spark, after(before), sf_dir), f"pipeline-{name}")

    return STAGES[-1][1](spark, after(STAGES[:-1]), sf_dir)
