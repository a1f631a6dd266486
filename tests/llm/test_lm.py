"""Steps of the language model's network against the definition, a word at a time and in double precision."""

import numpy as np
import pytest

from specton.llm import lm


def made(seed=3, kinds=lm.VOCABULARY):
    """A vocabulary with classes from one word to several hundred, as square roots of counts cut them, and a network."""
    r = np.random.default_rng(seed)
    root = 1 / np.sqrt(np.arange(1, kinds))
    classes = np.concatenate([[0], 1 + np.minimum((np.cumsum(root) / root.sum() * (lm.CLASSES - 1)).astype(int), lm.CLASSES - 2)]).astype(np.int32)
    hashes = np.sort(r.integers(0, 1 << 63, kinds - 2, dtype=np.uint64) * np.uint64(2))
    v = lm.Vocabulary(hashes, np.arange(2, kinds, dtype=np.int32), classes, r.normal(-4, 1, kinds).astype(np.float32))
    return r, v, lm.Network(lm.Network().flat + r.normal(0, 0.2, lm.Network().flat.shape).astype(np.float32))


def words(r, n, kinds=lm.VOCABULARY):
    """Ids of which some are very frequent, some occur once and the unknown word is among them."""
    draw = lambda *shape: np.where(r.random(shape) < 0.3, 0, (kinds * r.random(shape) ** 3).astype(int)).astype(np.int32)
    return draw(n, 2 * lm.WINDOW), draw(n)


def defined(net, context, ids, v):
    """Log probabilities, and gradients of the mean of minus these: table, classes with biases, words with biases."""
    table, out, rows = net.table.astype(float), net.output.astype(float), net.words.astype(float)
    grads, values = (np.zeros_like(table), np.zeros_like(out), np.zeros_like(rows)), []
    for c, i in zip(context, ids, strict=True):
        h = np.tanh(sum(table[k, x] for k, x in enumerate(c)) + net.bias)
        x = np.append(h, 1)
        p = np.exp(x @ out)
        p /= p.sum()
        kind = v.classes[i]
        value = np.log(p[kind])
        p[kind] -= 1
        grads[1][:] += np.outer(x, p)
        back = out[:-1] @ p
        own = np.flatnonzero(v.classes == kind)
        if len(own) > 1:
            q = np.exp(rows[own] @ x + v.within[own])
            q /= q.sum()
            value += np.log(q[own == i].item())
            q[own == i] -= 1
            grads[2][own] += np.outer(q, x)
            back += q @ rows[own, :-1]
        elif i == 0:
            value += v.within[0]
        values.append(value)
        for k, x in enumerate(c):
            grads[0][k, x] += back * (1 - h * h)
    return np.array(values), [g / len(ids) for g in grads]


@pytest.mark.parametrize("kinds, n", [(lm.VOCABULARY, 700), (300, 700), (5, 60), (lm.VOCABULARY, 1)])
def test_steps_are_the_gradients_of_the_definition(kinds, n):
    r, v, net = made(kinds=kinds)
    context, ids = words(r, n, kinds)
    values, (table, out, rows) = defined(net, context, ids, v)
    assert np.abs(net.log_probabilities(context, ids, v) - values).max() < 1e-4
    before = net.table.copy(), net.output.copy(), net.words.copy()
    net.train(context, ids, v)
    seen = [1e-6 + (table**2).mean(2, keepdims=True), 1e-6 + out**2, 1e-6 + rows**2]
    for old, new, grad, scale in zip(before, (net.table, net.output, net.words), (table, out, rows), seen, strict=True):
        assert np.abs(new - (old - 0.05 * grad / np.sqrt(scale))).max() < 2e-4
        assert (new[grad == 0] == old[grad == 0]).all()


def test_a_step_takes_few_exponentials(monkeypatch):
    """Classes are computed some at once: one call for each of 95 classes was most of a step's time."""
    r, v, net = made()
    context, ids = words(r, lm.BATCH)
    assert len(np.unique(v.classes[ids])) > 85
    calls, exp = [], np.exp
    monkeypatch.setattr(np, "exp", lambda x, **more: (calls.append(x.size), exp(x, **more))[1])
    net.train(context, ids, v)
    assert len(calls) < 30
    calls.clear()
    net.log_probabilities(context, ids, v)
    assert len(calls) < 30


@pytest.mark.parametrize("common", [None, 3, 100, 8000])
def test_blocks_have_each_place_once_and_little_to_fill_up(common):
    """Also where half of all places are one word, whatever the size of its class."""
    r, v, _ = made()
    _, ids = words(r, lm.BATCH)
    if common is not None:
        ids[r.random(len(ids)) < 0.5] = common
    seen, filled = [], 0
    for places, rows, wanted in v.blocks(ids):
        real = places < len(ids)
        for place, row in zip(places, rows, strict=True):
            own = ids[place[place < len(ids)]]
            assert set(v.classes[own]) == {v.classes[row[0]]} and (row[row < lm.VOCABULARY] == np.flatnonzero(v.classes == v.classes[own[0]])).all()
        group, word, place = np.unravel_index(wanted, (len(places), rows.shape[1], places.shape[1]))
        assert (rows[group, word][real] == ids[places[real]]).all() and (places[group, place] == places).all()
        seen.append(places[real])
        need = int((real.sum(1) * (rows < lm.VOCABULARY).sum(1)).sum())
        filled = places.shape[1] * rows.size
        assert filled <= need + max(need // 2, lm.FILL)
    sizes = np.bincount(v.classes, minlength=lm.CLASSES)
    assert (np.sort(np.concatenate(seen)) == np.flatnonzero(sizes[v.classes[ids]] > 1)).all()


def test_words_are_looked_up_among_hashes_that_begin_alike():
    close = np.concatenate([np.arange(5, dtype=np.uint64) + np.uint64(7 << 50), np.array([0, 1 << 40, (1 << 64) - 1, (1 << 64) - 2], np.uint64)])
    hashes = np.sort(np.unique(np.concatenate([close, np.random.default_rng(1).integers(0, 1 << 63, 3000, dtype=np.uint64)])))
    v = lm.Vocabulary(hashes, np.arange(2, len(hashes) + 2, dtype=np.int32), np.zeros(len(hashes) + 2, np.int32), np.zeros(len(hashes) + 2, np.float32))
    assert (v.of(hashes[::-1]) == np.arange(2, len(hashes) + 2)[::-1]).all()
    other = np.setdiff1d(np.concatenate([hashes + np.uint64(1), hashes - np.uint64(1)]), hashes)
    assert len(other) > 3000 and (v.of(other) == 0).all()
