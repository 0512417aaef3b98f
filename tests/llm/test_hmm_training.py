"""Baum-Welch of the hidden Markov model against sums over all paths, and its vocabulary."""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pytest

from tillwork.llm import hmm
from tillwork.llm.hmm import Model, _expected, score, vocabulary


def random_model(states: int, symbols: int, seed: int) -> Model:
    draw = np.random.default_rng(seed)
    emit = draw.random((symbols, states)) + 0.01
    move = draw.random((states, states)) + 0.01
    start = draw.random(states) + 0.01
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def all_paths(texts, model):
    """Expected counts by every path of states through every text."""
    states = len(model.start)
    total = Model(np.zeros(states), np.zeros((states, states)), np.zeros_like(model.emit))
    for text in texts:
        found, whole = Model(*(np.zeros_like(v) for v in (total.start, total.move, total.emit))), 0.0
        for path in itertools.product(range(states), repeat=len(text)):
            weight = model.start[path[0]] * np.prod([model.emit[s, k] for s, k in zip(text, path, strict=True)])
            weight *= np.prod([model.move[a, b] for a, b in itertools.pairwise(path)])
            whole += weight
            found.start[path[0]] += weight
            for a, b in itertools.pairwise(path):
                found.move[a, b] += weight
            for s, k in zip(text, path, strict=True):
                found.emit[s, k] += weight
        for name in ("start", "move", "emit"):
            getattr(total, name)[:] += getattr(found, name) / whole
    return total


@pytest.mark.parametrize("trained", [1, 2, 3, 1024])
@pytest.mark.parametrize("at_once", [3, 1 << 20])
def test_expected_counts_are_those_of_all_paths(monkeypatch, trained, at_once):
    """The same however texts are cut into stretches and groups."""
    monkeypatch.setattr(hmm, "TRAINED", trained)
    monkeypatch.setattr(hmm, "_AT_ONCE", at_once)
    draw = np.random.default_rng(5)
    for states in (1, 2, 3):
        model = random_model(states, 6, states)
        texts = [draw.integers(0, 6, n) for n in (1, 7, 4, 2, 8, 3, 1)]
        got, want = _expected(texts, model), all_paths(texts, model)
        for name in ("start", "move", "emit"):
            np.testing.assert_allclose(getattr(got, name), getattr(want, name), rtol=1e-9, atol=1e-12)


def test_long_texts_count_as_in_one_stretch(monkeypatch):
    model = random_model(8, 500, 1)
    texts = [np.random.default_rng(k).integers(0, 500, n) for k, n in enumerate((5000, 1024, 1025, 3))]
    got = _expected(texts, model)
    monkeypatch.setattr(hmm, "TRAINED", 10_000)
    whole = _expected(texts, model)
    for name in ("start", "move", "emit"):
        np.testing.assert_allclose(getattr(got, name), getattr(whole, name), rtol=1e-7)
    assert np.isclose(got.emit.sum(), 7052) and np.isclose(got.start.sum(), 4) and np.isclose(got.move.sum(), 7048)


def test_vocabulary_takes_whole_classes_of_counts(spark, monkeypatch):
    counts = spark.createDataFrame(
        [(bytearray(f"w{k}".encode()), 1000 // k) for k in range(1, 101)] + [(bytearray(), 7), (bytearray(b"x" * 65), 900)],
        "word binary, n long")
    every = vocabulary(counts)
    assert len(every.words) == 100 and every.ends == 7 and every.words[0] == b"w1" and every.distinct == 102
    assert every.named == 100
    monkeypatch.setattr(hmm, "SENT", 40)
    some = vocabulary(counts)
    assert some.words == every.words[:len(some.words)] and 30 <= len(some.words) <= 40
    # No count is split: all words of the least count are there.
    assert every.counts[len(some.words)] < some.counts[-1]
    monkeypatch.setattr(hmm, "SENT", 0)
    assert vocabulary(counts).words == ()


def test_words_beyond_those_sent_have_emissions_of_their_own(spark, monkeypatch):
    """Every word seen often enough, the sent ones or not, against a model worked out by hand."""
    monkeypatch.setattr(hmm, "SENT", 4)
    monkeypatch.setattr(hmm, "LEAST_SEEN", 3)
    draw = np.random.default_rng(3)
    names = [f"w{k}" for k in range(12)] + ["long" * 30] * 2 + [f"once{k}" for k in range(8)]
    weight = np.r_[1 / np.arange(1, 13), 0.3, 0.3, [0.04] * 8]
    texts = [" ".join(draw.choice(names, draw.integers(1, 9), p=weight / weight.sum())) for _ in range(60)] + ["", "unseen w0"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in score(docs, states=3, passes=2).collect()}

    words = [t.split() for t in texts]
    training = [w for k, w in enumerate(words) if not rows[k]["held_out"]]
    counts = Counter(w for text in training for w in text)
    stored = spark.createDataFrame(
        [(bytearray(w.encode()), n) for w, n in counts.items()] + [(bytearray(), len(training))], "word binary, n long")
    vocabulary_ = vocabulary(stored)
    sent = [w.decode() for w in vocabulary_.words]
    outer = sorted(w for w, n in counts.items() if n >= 3 and w not in sent)
    assert len(sent) <= 4 and "long" * 30 in outer and len(outer) == vocabulary_.outer_words > 4
    assert all(counts[w] >= 3 for w in sent)

    known = len(sent) + 2
    number = {w: k + 2 for k, w in enumerate(sent)} | {w: known + k for k, w in enumerate(outer)}
    coded = [np.array([number.get(w, 1) for w in text] + [0]) for text in training]
    model = hmm.first_model(vocabulary_, 3)
    for _ in range(2):
        wide = Model(model.start, model.move, np.r_[model.emit, [model.emit[1]] * len(outer)])
        found = _expected(coded, wide)
        rare = found.emit[1] + found.emit[known:].sum(0)
        emit = np.r_[found.emit[:1], [rare], found.emit[2:known]]
        emit = emit + (hmm._PRIOR + hmm._SHARED * emit.sum(0)) * vocabulary_.shares()[:, None]
        start, move = found.start + 1, found.move + 1
        model = Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    seldom = [n for w, n in counts.items() if w not in sent and w not in outer]
    every = sum(n + 0.5 for w, n in counts.items() if w not in sent) + 0.5
    prior = hmm._PRIOR + hmm._SHARED * rare
    part = [(found.emit[known + k] + prior * (counts[w] + 0.5) / every) / (rare + prior) for k, w in enumerate(outer)]
    left = sum(n + 0.5 for n in seldom) + 0.5
    rest = (found.emit[1] + prior * left / every) / (rare + prior)
    np.testing.assert_allclose(np.sum(part, 0) + rest, 1)

    emission = {w: model.emit[number[w]] for w in sent} | {w: model.emit[1] * p for w, p in zip(outer, part, strict=True)}
    for k, text in enumerate(words):
        state = model.start
        for place, w in enumerate([*text, None]):
            state = state if place == 0 else state @ model.move
            one = model.emit[1] * rest * (counts[w] + 0.5) / left
            state = state * (model.emit[0] if w is None else emission.get(w, one))
        assert rows[k]["score"] == pytest.approx(np.log10(state.sum()), rel=1e-5)
        assert rows[k]["n_known"] == 1 + sum(counts[w] > 0 for w in text)


def test_there_must_be_a_pass(spark):
    with pytest.raises(ValueError, match="a pass"):
        score(spark.createDataFrame([(1, "a")], "doc_id long, text string"), passes=0).count()
