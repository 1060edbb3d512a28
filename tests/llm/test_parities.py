"""Near copies that aren't similar enough are told apart before their sets are compared."""

import random

import numpy as np

from trialframe.llm import ngram_join


def folded(x, words):
    return np.bitwise_xor.reduce(x.reshape(-1, words))


def test_parities_differ_in_no_more_bits_than_sets_in_members():
    rng = np.random.default_rng(5)
    for size in (1, 40, 600, 3000, 200_000):
        a = np.unique(ngram_join.mixed(rng.integers(0, 1 << 62, size).astype(np.uint64)).view(np.int64))
        b = np.unique(np.concatenate([a[: len(a) // 10 * 9], ngram_join.mixed(rng.integers(0, 1 << 62, size // 10 + 1).astype(np.uint64)).view(np.int64)]))
        pa, pb = ngram_join.parities(a), ngram_join.parities(b)
        words = min(len(pa), len(pb))
        assert np.array_equal(folded(pa, words), ngram_join.parities(a, words))
        assert sum(int(x).bit_count() for x in np.bitwise_xor(folded(pa, words), folded(pb, words)).view(np.uint64)) <= len(np.setxor1d(a, b))
        assert not folded(pa, words).any() or len(a)


def test_a_group_of_near_copies_below_the_threshold_is_not_compared_in_pairs(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for d in range(60):
        words = list(base)
        for k in range(4):
            words[75 * k + rng.randrange(70)] = f"own{d}x{k}"
        rows.append((d, " ".join(words)))
    rows += [(100, rows[7][1] + " more"), (101, "more " + rows[7][1]), (102, "other " + rows[31][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    counted = {}

    def stored(df, name, write=ngram_join.stored):
        out = write(df, name)
        counted[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "stored", stored)
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs, 3, 90).collect()}
    assert found == {d: {100: 7, 101: 7, 102: 31}.get(d, d) for d, _ in rows}
    assert counted["join-first"] + counted["join-rest"] <= len(rows)
