"""Words of many texts meet the landmarks of toxic texts together."""

import numpy as np

from trialframe.llm import toxicity


def test_words_of_many_texts_meet_the_landmarks_at_once(monkeypatch):
    calls, kernel = [], toxicity.Landmarks.kernel
    monkeypatch.setattr(toxicity.Landmarks, "kernel", lambda self, words: calls.append(len(words)) or kernel(self, words))
    texts = [f"word{i} is here. what an idiot{i}! yes" for i in range(300)] + ["", "i d i o t", "no i d i o t. a b", " \n", "no one"]
    marks = toxicity.Landmarks(["^idiot", "^moron"])
    got = list(marks.sentences(texts))
    assert [len(x) for x in got] == [1] * 300 + [0, 1, 1, 0, 0]
    assert len(calls) < 30
    for x, text in zip(got, texts, strict=True):
        assert np.array_equal(x, next(toxicity.Landmarks(["^idiot", "^moron"]).sentences([text])))


def test_known_words_are_forgotten_between_texts(monkeypatch):
    marks = toxicity.Landmarks(["^idiot"])
    texts = [f"idiot{i} a{i}. b{i} idiot" for i in range(50)]
    want = list(marks.sentences(texts))
    monkeypatch.setattr(toxicity, "CACHE", 5)
    monkeypatch.setattr(toxicity, "TOGETHER", 10)
    assert all(np.array_equal(x, y) for x, y in zip(want, toxicity.Landmarks(["^idiot"]).sentences(texts), strict=True))
