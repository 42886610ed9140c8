"""Forests grow in the rows of a node, not in the bins of all nodes."""

import numpy as np
import pytest

from tidemark.operators import trees as T


def noisy(n=1500, p=6):
    r = np.random.default_rng(3)
    x = np.column_stack([r.integers(0, 2, n), *[r.random(n) for _ in range(p - 1)]]).astype(float)
    return x, (r.random(n) < 0.3).astype(float)


def test_drawn_cuts_make_no_histogram(monkeypatch):
    def histograms(*args):
        raise AssertionError("a histogram was made")

    x, y = noisy()
    monkeypatch.setattr(T, "_best_cuts", histograms)
    binned = T.Binned.of(x, 31)
    nodes = T.grow_forest(binned, y, np.ones((5, len(y))), 1, 20, 7, True)
    leaf = nodes[nodes["feature"] < 0]
    assert leaf["count"].sum() == 5 * len(y) and (leaf["count"] * leaf["value"]).sum() == pytest.approx(5 * y.sum())
    inner = np.flatnonzero(nodes["feature"] >= 0)
    left = nodes["left"][inner]
    assert (nodes["count"][inner] == nodes["count"][left] + nodes["count"][left + 1]).all() and nodes["count"].min() >= 1
    for tree in range(5):  # what a leaf says is the mean of the rows that reach it
        values = T.leaf_values(nodes, np.array([tree]), x)[0]
        assert all(y[values == v].mean() == pytest.approx(v) for v in np.unique(values)) and values.std() > 0.3


def test_nodes_of_one_target_are_not_searched(monkeypatch):
    x, y = noisy(300)
    searched, best = [], T._best_cuts

    def watched(count, total, *args):
        n, s = count.sum(axis=2), total.sum(axis=2)
        searched.append(float(np.min(np.minimum(s + n * y.mean(), n * (1 - y.mean()) - s))))
        return best(count, total, *args)

    monkeypatch.setattr(T, "_best_cuts", watched)
    T.grow_forest(T.Binned.of(x, 31), y, np.ones((3, len(y))), 1, 20, 7)
    assert min(searched) > 0.5
