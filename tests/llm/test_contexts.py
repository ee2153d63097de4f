"""Scoring with the log-bilinear model of `op10`."""

import numpy as np
import pytest

from whygraph.llm import lm


def test_recurring_contexts_are_normalised_once(monkeypatch):
    """The sum over classes is taken once a context of a run, with the probabilities of single tokens."""
    counts = np.full(20, 9)
    vocab = lm.Vocabulary(np.arange(20).astype(np.uint64), 33 + np.arange(20), np.concatenate((np.ones(33, int), counts)), 33 + sum(counts), 53, np.ones(32, int), np.zeros(0, np.uint64), np.zeros(0, int))
    model, draw = lm.LogBilinear(vocab), np.random.default_rng(2)
    for name in model.NAMES:
        getattr(model, name)[...] = draw.normal(size=getattr(model, name).shape)
    model.prepared()
    w = draw.integers(30, 53, 600)
    before = [draw.integers(33, 36, 600), draw.integers(33, 36, 600)]
    single = [float(model.log_probability(w[i : i + 1], [v[i : i + 1] for v in before])[0]) for i in range(600)]
    normalise, rows = model.normalise, []
    monkeypatch.setattr(model, "normalise", lambda out, guess, vectors, *more: (rows.append(len(guess)) if vectors is model.t else None, normalise(out, guess, vectors, *more)))
    assert model.log_probability(w, before) == pytest.approx(single, abs=1e-4)
    assert rows == [9]
