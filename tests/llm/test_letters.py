"""Automata over letters find the same repeated windows as automata over words, with few states."""

import random

import pytest

from trialframe.llm import substring_dedup


@pytest.mark.parametrize("length", [1, 2, 3, 5, 13, 35])
def test_windows_by_letters_repeat_as_by_words(length):
    rng = random.Random(length)
    for words in (1, 2, 4, 40):
        base = [rng.randrange(words) for _ in range(length + 20)]
        texts, weights = [], []
        for _ in range(rng.randrange(1, 30)):
            t = [rng.randrange(words) if rng.random() < 0.03 else w for w in base]
            t = t[rng.randrange(8):length + rng.randrange(8, 20)] if rng.random() < 0.8 else [rng.randrange(words) for _ in range(length + rng.randrange(20))]
            texts.append(t)
            weights.append(rng.choice([1, 1, 2]))
        by_words = substring_dedup.Automaton(texts, weights)
        letters, spans, starts = substring_dedup.lettered(texts, length)
        by_letters = substring_dedup.Automaton(letters, weights)
        for t, x, own, at in zip(texts, letters, spans, starts, strict=True):
            got = [k for i, j, twice in zip(at, [*at[1:], len(t) - length + 1], by_letters.repeats(x, own), strict=True) if twice for k in range(i, j)]
            assert got == list(by_words.repeated(t, length))


def test_near_copies_have_few_letters():
    texts = [[*range(40), 1000 + k, *range(41, 80)] for k in range(10)]
    assert len(substring_dedup.Automaton(substring_dedup.lettered(texts, 35)[0], [1] * 10).length) < 100
