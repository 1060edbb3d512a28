"""Document operators against brute force on awkward rows."""

import collections
import hashlib
import re

import numpy as np
import pytest

from trialframe.llm import decontam, mixing, ngram_join, pii, substring_dedup
from trialframe.llm.components import components


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def gram_sets(rows, n):
    out = []
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        out.append(frozenset(tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    return out


def linked(sets, t):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if sets[a] and 100 * o >= t * (len(sets[a]) + len(sets[b]) - o):
                root[find(a)] = find(b)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("n,t", [(3, 90), (5, 80), (1, 60)])
def test_near_duplicates(spark, documents, n, t):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma tau ypsilon".split()
    rng = np.random.default_rng(n)
    extra = [(100 + i, " ".join(w for j, w in enumerate(words[:10 + i % 10]) if j != rng.integers(0, 40)), "s", "en", 0, "", 0, "") for i in range(60)]
    df = documents.union(spark.createDataFrame(extra, documents.schema))
    rows = df.collect()
    sets = gram_sets(rows, n)
    roots = linked(sets, t)
    low = {}
    for r, k in zip(rows, roots, strict=True):
        if r["doc_id"] is not None:
            low[k] = min(low.get(k, r["doc_id"]), r["doc_id"])
    want = [(r["doc_id"], len(s), low.get(k) if s else r["doc_id"]) for r, s, k in zip(rows, sets, roots, strict=True)]
    got = ngram_join.near_duplicates(df, n, t).select("doc_id", "n_shingles", "component_id")
    assert rows_of(got) == sorted(want, key=str)


@pytest.mark.parametrize("t", [80, 90])
def test_near_duplicates_in_pairs_of_unequal_size(spark, t):
    """Two texts a group: most groups have no third set that would list the n-grams beyond the end of a prefix."""
    rng = np.random.default_rng(t)
    texts = []
    for g, size in enumerate([100, 100, 200, 400, 700, 1000] * 4):
        words = sorted((f"w{g}x{i}" for i in range(size + size // 4)), key=lambda w: ngram_join.gram_set(w, 1)[0])
        other = ngram_join.least_partner(size, t) + int(rng.integers(0, 1 + size - ngram_join.least_partner(size, t)))
        common = min(other, -(-t * (size + other) // (100 + t)) - g % 2)  # just a link, or one n-gram short of it
        own = size - common, other - common
        if g % 4 < 2:  # the larger set's own words come first in the order, the other's last
            a, b = words[:size], words[own[0]:own[0] + other]
        else:
            mixed = rng.permutation(words).tolist()
            a, b = mixed[:size], mixed[own[0]:own[0] + other]
        texts += [" ".join(rng.permutation(a)), " ".join(rng.permutation(b))]
    # 93 of 102 are common, 4 of the larger set's 11 in front and all 10 of the other's
    words = sorted((f"v{i}" for i in range(102)), key=lambda w: ngram_join.gram_set(w, 1)[0])
    texts += [" ".join(words[:100]), " ".join(words[7:])]
    sets = gram_sets([{"text": x} for x in texts], 1)
    roots = linked(sets, t)
    low = {k: i for i, k in reversed(list(enumerate(roots)))}
    got = ngram_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), 1, t)
    assert 2 * len(set(roots)) > len(texts) > len(set(roots))
    assert rows_of(got.select("doc_id", "component_id")) == sorted(((i, low[k]) for i, k in enumerate(roots)), key=str)


def test_near_duplicates_of_nothing(no_documents):
    assert ngram_join.near_duplicates(no_documents).count() == 0
    assert ngram_join.one_of_each(no_documents).count() == 0


def test_one_of_each(documents):
    out = ngram_join.one_of_each(documents, 3, 90)
    assert out.columns == documents.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect())
    assert ids.count((False, 23)) == 0 and ids.count((False, 22)) == 1 and (False, 21) not in ids and (False, 20) in ids
    assert {(False, 30), (False, 31), (False, 32)} <= set(ids)


def test_boundary_follows_cost():
    assert ngram_join.choose_boundary({9: 10}, 0.5, 90) >= 9
    assert ngram_join.choose_boundary({24: 1000}, 0.0, 80) < 24
    assert [ngram_join.subsets(n, 90) for n in (8, 10, 20)] == [1, 11, 211]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = dict(rows_of(components(spark.createDataFrame(edges, "a bigint, b bigint"))))
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("length,hot", [(5, 2048), (5, 1), (35, 2048)])
def test_repeats(documents, monkeypatch, length, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rows = documents.collect()
    words = [(r["text"] or "").encode().split() for r in rows]
    count = collections.Counter(tuple(w[k:k + length]) for w in words for k in range(len(w) - length + 1))
    want = []
    for r, w in zip(rows, words, strict=True):
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - length + 1):
            if count[tuple(w[k:k + length])] > 1:
                gone[k:k + length] = True
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((r["doc_id"], len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    got = substring_dedup.without_repeats(documents, length).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert rows_of(got) == sorted(want, key=str)


def test_repeats_of_nothing(no_documents):
    assert substring_dedup.without_repeats(no_documents).count() == 0


def test_automaton_counts():
    a = substring_dedup.Automaton([[1, 2, 3, 1, 2], [2, 3, 4]], [1, 1])
    assert list(a.repeated([1, 2, 3, 4, 9, 1, 2], 2)) == [0, 1, 5]
    assert list(substring_dedup.Automaton([[1, 2]], [2]).repeated([1, 2, 1], 2)) == [0]


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_spans(text):
    def ok(kind, v):
        d = re.sub("[^0-9]", "", v)
        if kind == "ip":
            return all(int(x) <= 255 for x in v.split("."))
        if kind == "card":
            return 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
        return kind != "phone" or 8 <= len(d) <= 15

    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE for m in re.finditer(p, text) if ok(k, m[0])]


HARD = ["a@b.c_d@e.f g@h", "é\U0001f600 x@y.zé 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004", "4111-1111-1111-1111 4111 1111 1111 1112 +49 (30) 1234-5678 +1 2", "a" * 3000 + "@", "1" * 5000,
        "9." * 3000, "@ @@ a@ @b.c x@-.-", "+1 +2 +3 4 5 6 7 8 9 (", None, ""]


def test_base_spans(spark, documents):
    df = documents.select("doc_id", "text").union(spark.createDataFrame([(900 + i, t) for i, t in enumerate(HARD)], "doc_id bigint, text string"))
    got = pii.summary(df)
    want = sorted(((r["doc_id"], hashlib.sha256(",".join(base_spans(r["text"] or "")).encode()).hexdigest()) for r in df.collect()), key=str)
    assert rows_of(got.select("doc_id", "base_sha256")) == want
    assert all(r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] + r["n_learnt"] == len([x for x in r["spans"].split(",") if x]) for r in got.collect())


def test_contexts_teach_unseen_identifiers(spark):
    seeds = [(i, f"please reach customer line +4930{1000000 + i} today or later") for i in range(8)]
    df = spark.createDataFrame([*seeds, (50, "please reach customer line 0301234567x today or later"), (51, "nothing like it 77 here")], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_learnt"], r["spans"]) for r in pii.summary(df).collect()}
    assert got[50] == (1, "phone:27:38") and got[51] == (0, "")


def test_redaction(documents, no_documents):
    out = pii.redact(documents)
    assert out.columns == documents.columns and pii.redact(no_documents).count() == 0
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[41] == "pay with [CARD] from 10.0.0.300 or [IP] now" and texts[30] is None
    assert "[EMAIL]" in texts[0] and "[PHONE]" in texts[0] and "@" not in texts[0]


def windows_hit(text, items, window):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, ids = cut(text), set(), set()
    for item, t in items:
        v = cut(t)
        for own in {tuple(v[k:k + window]) for k in range(max(1, len(v) - window + 1))} if v else ():
            for k in range(len(w) - len(own) + 1):
                if tuple(w[k:k + len(own)]) == own:
                    hit.update(range(k, k + len(own)))
                    ids.add("" if item is None else str(item))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def test_contamination(spark, documents, no_documents):
    items = [(1, "Quick BROWN fox, jumps over one lazy dog while seven small birds"), (2, "one"), (10, None), (11, ""), (12, "ab ab"), (None, "own words"), (3, "not in any text at all of these"), (2, "one")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontam.contamination(documents, bench)
    want = sorted(((r["doc_id"], *windows_hit(r["text"], items, 10)) for r in documents.collect()), key=str)
    assert rows_of(got) == want
    assert decontam.contamination(no_documents, bench).count() == 0
    assert {r["contaminated"] for r in decontam.contamination(documents, bench.where("false")).collect()} == {False}
    kept = decontam.clean(documents, bench)
    assert kept.columns == documents.columns and kept.count() == sum(not w[-1] for w in want)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "rare one two three seldom"), (2, "rare a b c d e f g h i j seldom")], "row bigint, text string").select("row", decontam.words_of("text").alias("w"))
    w = decontam.item_windows(spark.createDataFrame([(7, "rare seldom")], "item_id bigint, text string"))
    plan = decontam.drivers(w, decontam.frequencies(docs, w))
    near = decontam.proximity_matches(decontam.build_index(docs, plan, 1), plan, 5).collect()
    assert [(r["row"], r["distance"]) for r in near] == [(1, 4)]


def test_mix(documents, no_documents):
    rows = mixing.mix(documents).collect()
    sizes = collections.Counter()
    for r in documents.collect():
        sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, total, want = set(names), 1.5 * sum(sizes.values()), {}
    while True:  # cap, deal the rest again
        level = (total - sum(want.values())) / sum(weight[s] for s in left) if left else 0
        over = {s for s in left if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        want |= {s: 2.0 * sizes[s] for s in over}
        left -= over
    want |= {s: level * weight[s] for s in left}
    taken, largest = collections.Counter(), collections.Counter()
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]], abs=1e-5) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - want[s]) <= 2 * largest[s] for s in names)
    assert mixing.mix(no_documents).count() == 0 and rows_of(mixing.mix(documents)) == sorted(map(tuple, rows), key=str)


def test_thresholds_take_the_nearer_side(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 7 as int)) as text", "if(id % 3 = 0, 'a', 'b') as source")
    rows = mixing.mix(docs).collect()
    taken = collections.Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[r["source"]] - r["target"]) <= 3.5 for r in rows)
