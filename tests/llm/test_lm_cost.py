"""The window network's nodes near the root are worked on as one matrix: the same results, most steps never gathered."""

import numpy as np
import pytest

from quantspark.llm import lm


def network(near_root=15, words=300, seed=3):
    rng = np.random.default_rng(seed)
    counts = (20000 / np.arange(2, words + 2)).astype(np.int64)
    net = lm.WindowNet(np.unique(rng.integers(0, 1 << 63, words).astype(np.uint64)), counts, int(counts.sum() / 2), lm.LMConfig(near_root=near_root))
    net.rows[...] = rng.normal(0, 0.3, net.rows.shape)
    share = np.concatenate(([counts.sum() // 2], counts)) / (counts.sum() // 2 + counts.sum())
    ids = rng.choice(words + 1, 2000, p=share / share.sum())
    return net, ids, rng.integers(0, words + 2, (len(ids), 6)).astype(np.uint16)


def trained(net, ids, context):
    squares, seen = np.full(net.rows.shape, 1e-3, dtype=np.float32), np.zeros(len(net.rows), dtype=np.float32)
    net.train(ids, context, 5, squares, seen)
    return net.rows.astype(float), seen


def test_most_steps_are_near_the_root():
    net, ids, _ = network()
    by, node, turn, at = net.descents(ids)
    whole = (net.start[ids + 1] - net.start[ids]).sum()
    assert len(node) == len(turn) == at[-1] < 0.6 * whole
    assert len(node) + np.count_nonzero(net.near[ids]) == whole and sorted(by) == list(range(len(ids)))


@pytest.mark.parametrize("near_root", [0, 1, 1000])
def test_results_do_not_depend_on_it(near_root):
    net, ids, context = network()
    other = network(near_root)[0]
    assert other.log_probabilities(ids, context) == pytest.approx(net.log_probabilities(ids, context), abs=1e-4)
    for a, b in zip(trained(net, ids, context), trained(other, ids, context), strict=True):
        assert np.abs(a - b).max() < 1e-3


def test_a_batch_follows_the_gradient_of_a_slow_version():
    """Token by token and step by step, in double precision."""
    net, ids, context = network(words=40)
    inputs, nodes, gates, bias = (x.astype(float) for x in net.parts())
    grads, uses = [np.zeros_like(x) for x in (inputs, nodes, gates, bias)], np.zeros(len(net.rows))
    for own, around in zip(ids, context.tolist(), strict=True):
        h = np.tanh(bias + sum(g * inputs[c] for g, c in zip(gates, around, strict=True)))
        h[-1], back = 1, 0
        for n, t in zip(net.node[net.start[own] : net.start[own + 1]], net.turn[net.start[own] : net.start[own + 1]], strict=True):
            slope = -t / (1 + np.exp(t * (nodes[n] @ h))) / 32
            back = back + slope * nodes[n]
            grads[1][n] += slope * h
            uses[net.at[1] + n] += 1
        dz = back * (1 - h * h)
        for j, c in enumerate(around):
            grads[0][c] += dz * gates[j]
            grads[2][j] += dz * inputs[c] / 64
            uses[c] += 1
        grads[3] += dz / 64
    uses[net.at[2] :] = len(ids)
    flat = np.concatenate([*grads[:3], grads[3][None]])
    want = net.rows - net.cfg.rate * flat / np.sqrt(1e-3 + flat * flat)
    got, seen = trained(net, ids, context)
    assert np.abs(got - want).max() < 1e-3 and (seen == uses).all()


def test_overlapping_contexts_are_read_once():
    """Runs of words on a line give what contexts of their own give, with texts of every length between others."""
    net, _, _ = network()
    rng = np.random.default_rng(8)
    doc = np.repeat(np.arange(60), rng.integers(0, 40, 60))
    ids = rng.integers(0, len(net.vocabulary) + 1, len(doc)).astype(np.int32)
    line, place = net.line(ids, doc)
    context = np.full((len(ids), 6), len(net.vocabulary) + 1)
    for i in range(len(ids)):
        for j, o in enumerate((-3, -2, -1, 1, 2, 3)):
            if 0 <= i + o < len(ids) and doc[i + o] == doc[i]:
                context[i, j] = ids[i + o]
    assert (line[place] == ids).all() and (line[place[:, None] + net.beside] == context).all() and len(line) == len(ids) + 3 * (len(set(doc)) + 1)
    assert net.log_probabilities_on(line, place, ids, 100) == pytest.approx(net.log_probabilities(ids, context), abs=1e-5)
    got = []
    for run in (1, 16):  # all words fit in one batch, so their order doesn't matter
        own, squares, seen = network()[0], np.full(net.rows.shape, 1e-3, dtype=np.float32), np.zeros(len(net.rows), dtype=np.float32)
        own.train_on(line, place, ids, run, 5, squares, seen)
        got.append((own.rows.astype(float), seen))
    got.append(trained(network()[0], ids, context))
    assert len(ids) < net.cfg.batch and all(np.abs(got[2][0] - rows).max() < 1e-3 and (got[2][1] == seen).all() for rows, seen in got[:2])
    first = np.arange(0, len(ids), 16)[::-1]
    words, _, pick = net.stretches(line, place, first, np.minimum(first + 16, len(ids)))
    assert sorted(pick) == list(range(len(ids))) and len(words) < 2 * len(ids)  # contexts apart would be 6 places a word


def test_shortest_spelling_contexts_are_looked_up_once_a_pair(monkeypatch):
    rng = np.random.default_rng(9)
    text = b" ".join(bytes(rng.integers(97, 105, rng.integers(1, 12)).astype(np.uint8)) for _ in range(4000))
    net, cfg = lm.WindowNet(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), 1, lm.LMConfig()), lm.LMConfig()
    speller, looked = lm.Speller(1 << 12, cfg), []
    cells = lm.Speller.cells
    monkeypatch.setattr(lm.Speller, "cells", lambda self, context, *a: looked.append(len(context)) or cells(self, context, *a))
    spelled = net.read([text])[-1]
    speller.count(spelled)
    letters = int((spelled[2] - spelled[1] + 1).sum())
    assert sum(looked) < 2.1 * letters + 2 * len(spelled[3])
    want, buf = np.zeros(speller.rows * 16), spelled[0]
    words, n = np.unique([bytes(buf[a:b]) + b" " for a, b in zip(spelled[1][spelled[3]], spelled[2][spelled[3]], strict=True)], return_counts=True)
    for w, times in zip(words, n, strict=True):
        w = w if w.endswith(b" ") else w + b" "
        for before, symbol in zip(b"\0" + w, w, strict=False):
            for cell in cells(speller, lm._salted(1, np.array([before])), np.array([symbol], dtype=np.uint8)):
                want[cell] += times
    rows = np.unique(np.concatenate([c >> 4 for b in (0, 32, *range(97, 105)) for s in range(0, 256, 16) for c in cells(speller, lm._salted(1, np.array([b])), np.array([s], dtype=np.uint8))]))
    held = speller.counts.reshape(-1, 16)[rows].sum(axis=1)
    assert (held >= want.reshape(-1, 16)[rows].sum(axis=1)).all() and speller.counts.sum() == 2 * (3 * (n * [len(w.rstrip() + b" ") for w in words]).sum() + 2 * n.sum())
