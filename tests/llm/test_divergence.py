"""The source audit against exact arithmetic over every pair and term."""

import collections
import random
import re

import pytest

from trialframe.llm import divergence


def plain_audit(rows, least, top):
    """lang, source, part, item, value, rank straight from the definition, with Python's whole numbers."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        kept = [t for t, n in collections.Counter(t for d in own for t in set(d[2])).items() if n >= least]
        count = {s: collections.Counter(t for d in own if d[1] == s for t in d[2]) for s in {d[1] for d in own}}
        count[None] = collections.Counter(t for d in own for t in d[2])
        total = {s: sum(c[t] for t in kept) for s, c in count.items()}
        p = {s: {t: 1 + 10**9 * (c[t] + 2) // (total[s] + 2 * len(kept)) for t in kept} for s, c in count.items()}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in count:
            if s is None:
                continue
            pairs = [(sum(f(p[s][t], p[h][t]) for t in kept), h) for h in count if h not in (None, s)]
            terms = [(f(p[s][t], p[None][t]), t) for t in kept if count[s][t] and p[s][t] > p[None][t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:limit])]
    return sorted(out)


def rows_of(seed):
    rng = random.Random(seed)
    words = ["Apple", "apple", "Éclair", "éclair", "日本", "z" * 300, "x1y", "don't", "ß", "\U0001F600"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(" ".join(rng.choice(words[k % 3:]) for _ in range(rng.randrange(30))), rng.choice(["en", "de"]), f"s{k % 5}") for k in range(120)]
    rows += [("hot hot " * 3000 + "apple", "en", "s0")] * 12  # one source holds most of all terms, in repeated rows
    rows += [(None, "en", "silent"), ("", None, None), ("42 !?", "fr", "only"), ("one text", "it", "a"), ("other text", "it", "b"), (None, "it", None), ("apple", "en", "")]
    return rows


@pytest.mark.parametrize(("rows", "postings", "step", "held"), [(64, 1_000_000, 1 << 20, 400_000), (2, 15, 4, 10)])
def test_audit_equals_exact_arithmetic(spark, monkeypatch, rows, postings, step, held):
    for name, value in (("ROWS", rows), ("POSTINGS", postings), ("STEP", step), ("HELD", held)):
        monkeypatch.setattr(divergence, name, value)
    data = rows_of(rows)
    docs = spark.createDataFrame([(*r, "clash", 1, 2) for r in data], "text string, lang string, source string, term string, n int, rank int")
    got = sorted(tuple(r) for r in divergence.audit(docs, 3, 4).collect())
    assert got == plain_audit(data, 3, 4)
    assert {("it", "a", "pair", "b", 0, 2), ("it", "a", "pair", "", 0, 1)} <= set(got)


def test_empty_table_and_one_group(spark):
    docs = spark.createDataFrame([("a a", "en", "s")], "text string, lang string, source string")
    assert divergence.audit(docs.where("false")).count() == 0
    assert divergence.audit(docs).count() == 0
    assert divergence.audit(docs, 1).count() == 0  # it uses the term as its language does


def test_weights_are_exact_beyond_64_bits(spark):
    row = spark.sql("select 900000000000000000L as n, 1000000000000000003L as t, 7L as v").select(divergence.weight("n", "t", "v")).first()
    assert row[0] == 1 + 10**9 * (900000000000000000 + 2) // (1000000000000000003 + 14)
