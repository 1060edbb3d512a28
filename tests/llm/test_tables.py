"""Tables on the way to a result are deleted, and texts that are cut together give the contexts of each."""

import os
import random

import numpy as np
import pyarrow as pa

from trialframe.llm import common, decontam, ngram_join, substring_dedup
from trialframe.session import shared_dir


def tables(spark):
    folder = shared_dir(spark).removeprefix("file:")
    return {f for f in os.listdir(folder) if "-" in f and os.path.isdir(os.path.join(folder, f))}


def left(spark, before):
    """Names of the tables that are there and were not before."""
    return sorted(x.rsplit("-", 1)[0] for x in tables(spark) - before)


def test_tables_on_the_way_are_deleted(spark):
    before = tables(spark)

    def make():
        a = common.stored(spark.range(5), "t-a")
        b = common.only_stored(lambda: common.stored(a.where("id > 1"), "t-c"), "t-b")
        return b.union(a)

    out = common.only_stored(make, "t-out")
    assert left(spark, before) == ["t-out"] and out.count() == 8
    common.discard(out, spark.range(3))
    assert left(spark, before) == []


def test_passages_leave_what_their_rows_need(spark, documents):
    before = tables(spark)
    out = substring_dedup.without_repeats(documents, 5)
    assert left(spark, before) == ["sub-copies", "sub-kept", "sub-rows"]
    assert out.count() == documents.count()


def test_joins_and_verdicts_leave_what_their_rows_need(spark, documents):
    before = tables(spark)
    ngram_join.one_of_each(documents, 3, 80).collect()
    assert left(spark, before) == ["join-kept"]
    items = spark.createDataFrame([("i", "small birds watch from the old red barn near a quiet river")], "item_id string, text string")
    decontam.clean(documents, items).collect()
    assert left(spark, before) == ["decontam-verdict", "join-kept"]


def test_contexts_of_texts_cut_together():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abé\x1c\x85\xa0 \t\n\x0b\x0c\r  ") for _ in range(rng.randrange(200))) for _ in range(60)]
    texts += ["", " ", "a " * 300, "y" * 63 + " " + "y" * 64 + " " + "y" * 65, *["b" * k for k in range(20)]]
    words, sizes = substring_dedup.split_words(pa.array(texts))
    assert words.to_pylist() == [w.decode() for t in texts for w in t.encode().split()]
    assert sizes.tolist() == [len(t.encode().split()) for t in texts]
    hashes = substring_dedup.word_hashes(words)
    assert len(set(hashes.tolist())) == len(set(words.to_pylist())) == len(set(zip(hashes.tolist(), words.to_pylist(), strict=True)))
    ends = np.cumsum(sizes)
    for length in (1, 2, 5, 35):
        together = substring_dedup.contexts(hashes, sizes, length)
        for k, (end, n) in enumerate(zip(ends, sizes, strict=True)):
            alone = substring_dedup.contexts(substring_dedup.word_hashes(words[end - n:end]), sizes[k:k + 1], length)
            assert alone[3].sum() == max(0, n - length + 1)
            assert all(np.array_equal(x[together[0] == k], y) for x, y in zip(together[1:], alone[1:], strict=True))
