"""The trainers against plain loops and gradients by finite differences."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest

from codonweave.llm import language, lm, toxicity


def plain_svm(x, y, rounds, reg, seed):
    """linear_svm() by loops over rows and features."""
    rng = np.random.default_rng(seed)
    rows = [[*map(float, r), 1.0] for r in x]
    n, pos, neg = len(rows), sum(v > 0 for v in y), sum(v < 0 for v in y)
    w, mean, t, kept = [0.0] * len(rows[0]), [0.0] * len(rows[0]), 0, 0
    for k in range(rounds):
        for batch in np.array_split(rng.permutation(n), max(1, n // 32)):
            t += 1
            g = [0.0] * len(w)
            for i in batch:
                if y[i] * sum(a * b for a, b in zip(rows[i], w)) < 1:
                    share = (0.5 / max(1, pos) if y[i] > 0 else 0.5 / max(1, neg)) * n
                    g = [a + share * y[i] * b / len(batch) for a, b in zip(g, rows[i])]
            w = [a * (1 - reg) + 4 / math.sqrt(1 + t / 20) * b for a, b in zip(w, g)]
            if k >= rounds // 2:
                mean, kept = [a + b for a, b in zip(mean, w)], kept + 1
    return [a / kept for a in mean]


def test_svm_against_loops():
    rng = np.random.default_rng(1)
    y = np.where(rng.random(150) < 0.3, 1.0, -1.0)
    x = (rng.normal(size=(150, 6)) + y[:, None] * np.array([0.8, 0, 0, -0.5, 0, 0])).astype(np.float32)
    got = language.linear_svm(x, y, rounds=6)
    assert got == pytest.approx(plain_svm(x.tolist(), y.tolist(), 6, 1e-4, 7), abs=2e-3)
    right = np.mean(np.sign(x @ got[:-1] + got[-1]) == y)
    assert right > 0.75


def loss_of(rows, y, scale, w, b, reg):
    """The regression's loss by loops: labels weigh alike, weights are held back."""
    pos, neg = sum(y), sum(1 - y)
    total = reg / 2 * sum(float(v) ** 2 for v in w)
    for r, label in zip(rows, y):
        z = b + sum(w[k] * scale[k] for k in r)
        total += (0.5 / pos if label else 0.5 / neg) * (math.log1p(math.exp(-z)) if label else math.log1p(math.exp(z)))
    return total


def slope_of(rows, y, scale, w, b, reg, e=1e-5):
    out = []
    for k in range(len(w) + 1):
        up, down = (loss_of(rows, y, scale, [v + d * (i == k) for i, v in enumerate(w)], b + d * (k == len(w)), reg) for d in (e, -e))
        out.append((up - down) / (2 * e))
    return np.array(out)


def test_logistic_against_finite_differences():
    """The first step goes against the loss's slope in every weight; at the end the slope is nearly gone and the loss no higher than around it."""
    rng = np.random.default_rng(2)
    size, reg = 12, 3e-3
    y = (rng.random(80) < 0.4).astype(float)
    rows = [np.flatnonzero(rng.random(size) < np.where(np.arange(size) < 4, 0.2 + 0.5 * v, 0.3)) for v in y]
    scale = rng.normal(size=size)
    w, b = toxicity.logistic(rows, y, size, scale, steps=1, reg=reg)
    start = slope_of(rows, y, scale, np.zeros(size), 0.0, reg)
    steps = np.append(w, b)
    assert (np.sign(steps) == -np.sign(start))[np.abs(start) > 1e-6].all()
    w, b = toxicity.logistic(rows, y, size, scale, steps=3000, reg=reg)
    end = slope_of(rows, y, scale, w, b, reg)
    assert np.abs(end).max() < 0.03 * np.abs(start).max()
    best = loss_of(rows, y, scale, w, b, reg)
    assert best < loss_of(rows, y, scale, np.zeros(size), 0.0, reg)
    assert all(best < loss_of(rows, y, scale, w + 0.3 * rng.normal(size=size), b, reg) for _ in range(20))


def test_ratios_scale_the_weights():
    """A feature of ratio 0 learns nothing but the pull towards 0; doubling all ratios moves scores further."""
    rows, y = [np.array([0, 1]), np.array([1]), np.array([0]), np.array([1, 2])] * 5, np.array([1.0, 0, 1, 0] * 5)
    w, _ = toxicity.logistic(rows, y, 3, np.array([1.0, 1.0, 0.0]))
    assert w[0] > 0 > w[1] and w[2] == 0


def test_network_step_against_finite_differences():
    """One step of the network is the slope of the mean negative log-probability, parameter by parameter."""
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 62, 60, dtype=np.uint64))
    model = lm.Model(keys, np.sort(rng.integers(1, 40, len(keys)))[::-1].astype(np.int64), {}, len(keys))
    weights = rng.normal(size=len(model.weights)) * 0.3
    windows, cls = rng.integers(0, model.classes + 1, (2 * lm.SIDE, 40)), rng.integers(0, model.classes, 40)
    held = 1e6  # AdaGrad over so large a square goes along the slope itself

    def loss(w):
        return -lm.log_probabilities(model.parts(w), windows, cls).mean()

    after, squares = weights.copy(), np.full(len(weights), held**2)
    lm.step(model.parts(after), model.parts(squares), windows, cls)
    slope = (weights - after) * held / lm.RATE
    checked = 0
    for k in rng.permutation(len(weights))[:400].tolist():
        up, down = weights.copy(), weights.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        want = (loss(up) - loss(down)) / 2e-5
        assert slope[k] == pytest.approx(want, abs=3e-6)
        checked += abs(want) > 1e-5
    assert checked > 20


def test_network_along_texts_is_that_of_each_words_neighbours():
    """Words that share the rows of a text score and train as words whose neighbours are given one by one, with softmaxes of long stretches in pieces."""
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 62, 60, dtype=np.uint64))
    model = lm.Model(keys, np.sort(rng.integers(1, 40, len(keys)))[::-1].astype(np.int64), {}, len(keys))
    lengths = np.array([1, 0, 2, 3, 5, 900, 1, 4000, 7])
    ids = rng.integers(0, model.classes, lengths.sum()).astype(np.int32)
    texts = np.split(ids, np.cumsum(lengths)[:-1])
    around = [[t[i + k] if 0 <= i + k < len(t) else model.classes for k in (-2, -1, 1, 2)] for t in texts for i in range(len(t))]
    row, at = lm.padded(ids, lengths, model.classes)
    assert np.array_equal(row[at], ids) and [[int(row[p + k]) for k in (-2, -1, 1, 2)] for p in at] == around
    windows = np.array(around).T
    weights = (rng.normal(size=len(model.weights)) * 0.3).astype(np.float32)
    want = np.concatenate([lm.log_probabilities(model.parts(weights), windows[:, [i]], ids[[i]]) for i in range(0, len(ids), 37)])
    assert lm.log_probabilities_along(model.parts(weights), row, at, ids)[::37] == pytest.approx(want, abs=1e-4)
    for a, b in ((0, 1), (1, 40), (300, 2348)):
        one, other = [(weights.copy(), np.full(len(weights), 1e-3, np.float32)) for _ in range(2)]
        lm.step(*map(model.parts, one), windows[:, a:b], ids[a:b])
        lm.step_along(*map(model.parts, other), *lm._stretch(row, at[a:b]), ids[a:b])
        assert (one[0] != weights).any() and one[0] == pytest.approx(other[0], abs=1e-4) and one[1] == pytest.approx(other[1], abs=1e-4)


def test_words_are_told_apart_in_pieces(monkeypatch):
    """What a batch's words are made into stays small, whatever the batch, and is the same in pieces of any size."""
    texts = pa.array([None, "", "one two", "x" * 5000 + " y", *[f"w{i} The the. \u00fcber{i % 7}" for i in range(400)]], pa.string())
    keys, lengths = lm.word_keys(texts)
    model = lm.Model(np.unique(keys)[::2], np.arange(len(np.unique(keys)[::2]), 0, -1), {}, 400)
    want, seen, real = model.encode(keys), [], lm.split_words
    monkeypatch.setattr(lm, "KEYED", 256)
    monkeypatch.setattr(lm, "split_words", lambda t: seen.append(len(t)) or real(t))
    got = lm.word_keys(texts)
    assert np.array_equal(got[0], keys) and np.array_equal(got[1], lengths) and len(seen) > 20 and sum(seen) == len(texts)
    assert all(np.array_equal(a, b) for a, b in zip(model.encode(keys), want))
