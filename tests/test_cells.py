"""Models of many cells in one plan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cells as C
from tidemark.operators import small_models as S
from tidemark.operators import trees as T

rng = np.random.default_rng(0)


def data(n, seed=0, p=5):
    r = np.random.default_rng(seed)
    x = np.column_stack([r.normal(size=n), r.integers(0, 6, n), *[r.random(n) for _ in range(p - 2)]]).astype(float)
    return x, 3 * x[:, 0] + np.where(x[:, 1] > 2, 2.0, -1.0) + 0.3 * r.normal(size=n)


def frame(spark, cells):
    rows = [(c, i, float(y), [None if np.isnan(v) else float(v) for v in x]) for c, (xs, ys) in cells.items() for i, (x, y) in enumerate(zip(xs, ys))]
    return spark.createDataFrame(rows, "cell int, row_id long, label double, features array<double>").repartition(3)


def walk(nodes, root, x):
    at = root
    while nodes[at]["feature"] >= 0:
        v = x[nodes[at]["feature"]]
        right = (not nodes[at]["missing_left"]) if np.isnan(v) else v > nodes[at]["cut"]
        at = nodes[at]["left"] + int(right)
    return nodes[at]


@pytest.mark.parametrize("random", [False, True])
def test_forests_hold_their_rows_and_means(random):
    x, y = data(400)
    weights = np.ones((6, 400)) if random else T.bootstrap_weights(rng.integers(0, 1 << 62, 400).astype(np.uint64), np.arange(6), 1)
    nodes = T.grow_forest(T.Binned.of(x, 63), y, weights, 5, 20, 7, random)
    leaf = nodes[nodes["feature"] < 0]
    assert leaf["count"].min() >= 5 and leaf["count"].sum() == weights.sum()
    for tree in range(6):
        values = np.array([walk(nodes, tree, row)["value"] for row in x])
        assert (T.leaf_values(nodes, np.array([tree]), x)[0] == values).all()
        for v in np.unique(values):
            own = values == v
            assert np.average(y[own], weights=weights[tree][own]) == pytest.approx(v)
    fitted = T.leaf_values(nodes, np.arange(6), x).mean(axis=0)
    assert np.mean((y - fitted) ** 2) < 0.3 * y.var()


def test_a_forest_splits_where_the_best_cut_is():
    x = np.arange(20.0)[:, None]
    y = (x[:, 0] > 12).astype(float)
    nodes = T.grow_forest(T.Binned.of(x, 63), y, np.ones((1, 20)), 1, 20, 0)
    assert len(nodes) == 3 and nodes[0]["cut"] == 12.5 and sorted(nodes[1:]["value"]) == [0, 1]
    assert len(T.grow_forest(T.Binned.of(x, 63), y, np.ones((1, 20)), 8, 20, 0)) == 1 + 2 * 1  # no leaf below eight rows
    assert len(T.grow_forest(T.Binned.of(x, 63), np.ones(20), np.ones((2, 20)), 1, 20, 0)) == 2  # nothing to explain


def test_boosting_learns_the_side_of_missing_values():
    x, y = data(600, 3)
    x[::3, 0] = np.nan
    y = np.where(np.isnan(x[:, 0]), 9.0, y)
    how = T.Boosting(0.1, 60, 10, 64, min_rows=10, min_hessian=1e-3)
    base, nodes, roots = T.boost(T.Binned.of(x, 255), y, 60, how)
    score = base + T.leaf_values(nodes, roots, x).sum(axis=0)
    assert np.mean((y - score) ** 2) < 0.05 * y.var() and abs(np.mean(y - score)) < 1e-9
    leaves = [np.sum(nodes["feature"][a:b] < 0) for a, b in zip(roots, [*roots[1:], len(nodes)])]
    assert max(leaves) == 10 and nodes["count"][nodes["feature"] < 0].min() >= 10
    by_hand = base + sum(walk(nodes, r, x[0])["value"] for r in roots)
    assert by_hand == pytest.approx(score[0])


def test_first_split_is_the_best_of_all():
    x, y = data(120, 5, p=3)
    how = T.Boosting(0.3, 1, 4, 2, l2=1.0)
    _, nodes, _ = T.boost(T.Binned.of(x, 255), y, 1, how)
    g = y.mean() - y
    gains = {(f, c): (g[x[:, f] <= c].sum() ** 2 / ((x[:, f] <= c).sum() + 1) + g[x[:, f] > c].sum() ** 2 / ((x[:, f] > c).sum() + 1))
             for f in range(3) for c in np.unique(x[:, f])[:-1]}
    f, c = max(gains, key=gains.get)
    assert nodes[0]["feature"] == f and (x[:, f] <= nodes[0]["cut"]).sum() == (x[:, f] <= c).sum()
    assert (nodes["feature"] < 0).sum() <= 4


def test_rounds_stop_with_patience():
    x, _ = data(200, 6)
    y = np.random.default_rng(1).normal(size=200)  # noise: early rounds are best
    fold = np.arange(200) % 5
    how = T.Boosting(0.3, 90, 4, 2, l2=1.0)
    assert T.best_rounds(x, y, fold, how, 10) == T.best_rounds(x, y, fold, how) < 20
    assert T.best_rounds(x[:1], y[:1], fold[:1], how) == 1


@pytest.mark.parametrize("l1", [0.0, 1.0])
def test_logistic_meets_its_conditions(l1):
    x, s = data(300, 8)
    y = (s + np.random.default_rng(2).logistic(size=300) > 0).astype(float)
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    w, _, converged = S.logistic(x, y, 0.05 if l1 else 1.0, l1)
    p = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
    g = x.T @ (p - y)
    assert converged and abs(np.sum(p - y)) < 1e-4
    if l1:
        assert (w[1:] == 0).any() and all(abs(gj) <= 20 + 1e-4 if wj == 0 else abs(gj + 20 * np.sign(wj)) < 1e-4 for gj, wj in zip(g, w[1:]))
    else:
        assert np.abs(g + w[1:]).max() < 1e-4
    _, _, ended = S.logistic(np.array([[0.0], [1.0]]), np.array([0.0, 1.0]), 1e12, 0.0)  # separable: no optimum, but an end
    assert ended in (True, False)


def test_network_beats_the_line_on_a_ring():
    r = np.random.default_rng(3)
    x = r.normal(size=(500, 2))
    y = ((x**2).sum(axis=1) > 1.4).astype(float)
    theta, n_iter, _ = S.network(x, y, 64, 500, 1e-4, 1e-3, 0)
    right = np.mean((S.network_score(theta, x, 64) > 0) == y)
    assert right > 0.95 and n_iter <= 500


def test_cells_in_one_plan(spark):
    cells = {1: data(300, 1), 2: data(40, 2), 3: (np.zeros((10, 5)), np.arange(10.0))}
    train = frame(spark, cells)
    test = frame(spark, {c: data(60, 10 + c) for c in cells})
    small = C._forest(40, 5, 20, False, False)
    models = C.fit_cells(train, ["cell"], small, 3)
    preds = C.predict_cells(models, test, ["cell"], small).toPandas()
    assert preds.groupby("cell").size().to_dict() == {1: 60, 2: 60, 3: 60}
    error = ((preds.label - preds.y_pred) ** 2).groupby(preds.cell).mean()
    assert error[1] < 3 and preds[preds.cell == 3].y_pred.nunique() == 1
    again = C.predict_cells(C.fit_cells(train.repartition(5), ["cell"], small, 3), test.repartition(2), ["cell"], small).toPandas()
    key = ["cell", "row_id"]
    np.testing.assert_allclose(preds.sort_values(key).y_pred.to_numpy(), again.sort_values(key).y_pred.to_numpy(), rtol=1e-12)
    sizes = C.forest_sizes(models, ["cell"], small).collect()
    assert all(r.trees == 40 for r in sizes)


def test_units_and_blocks_add_up(spark, monkeypatch):
    cells = {1: data(200, 1)}
    train, test = frame(spark, cells), frame(spark, {1: data(50, 9)})
    kind = C._forest(30, 5, 20, True, False)
    monkeypatch.setattr(C, "UNIT_PLACEMENTS", 1000)
    monkeypatch.setattr(C, "BLOCK_ROWS", 16)
    models = C.fit_cells(train, ["cell"], kind, 3).persist()
    assert models.count() == 6 and models.agg(F.sum("weight")).first()[0] == 30
    preds = C.predict_cells(models, test, ["cell"], kind)
    assert preds.count() == 50 and preds.where("y_pred between -20 and 20").count() == 50


def test_errors_of_cells(spark):
    x, _ = data(30)
    holes = x.copy()
    holes[3, 2] = np.nan
    train = frame(spark, {1: (x, np.ones(30)), 2: (holes, np.arange(30) % 2), 3: (x, np.arange(30) % 2)})
    got = {r.cell: r.error for r in C.fit_cells(train, ["cell"], C.KINDS["ridge_classifier"]).collect()}
    assert got[1] == "the training rows are of one class" and got[2] == "a feature is missing" and got[3] is None
    assert {r.cell for r in C.oversized(train, ["cell"], 149).collect()} == {1, 2, 3} and C.oversized(train, ["cell"], 150).isEmpty()


def test_stacks(spark):
    cells = {1: data(150, 1), 2: data(90, 2)}
    train, test = frame(spark, cells), frame(spark, {c: data(40, 20 + c) for c in cells})
    bases = {"ridge": C.KINDS["ridge"], "extra_trees": C._forest(20, 5, 20, True, False), "boosted_leaf": C._boosted(T.Boosting(0.1, 20, 10, 64, min_rows=10), 0, None)}
    held = {}

    def keep(df, name):
        held[name] = df.persist()
        return held[name]

    preds, weights, errors = C.stack_cells(train, test, ["cell"], "stack", 3, keep_models=keep, bases=bases)
    assert preds.count() == 80 and errors.isEmpty()
    for r in weights.collect():
        oof = [t for t in held["scores"].where(F.col("part") >= 0).collect() if t.cell == r.cell]
        assert len(oof) == len(cells[r.cell][1]) and min(r.weights) >= 0
        gaps = np.array([t.label - r.intercept - np.dot(t.features, r.weights) for t in oof])
        assert abs(gaps.mean()) < 1e-9 and gaps.var() <= min(np.var([t.label - t.features[k] for t in oof]) for k in range(3)) + 1e-9


@pytest.mark.parametrize("random", [False, True])
def test_forests_are_scored_where_they_grow(spark, monkeypatch, random):
    cells = {1: data(300, 1), 2: data(40, 2), 3: (np.zeros((10, 5)), np.arange(10.0)), 4: (np.full((9, 5), np.nan), np.arange(9.0))}
    train, test = frame(spark, cells), frame(spark, {c: data(60, 10 + c) for c in cells})
    kind = C._forest(20, 5, 20, random, False)
    monkeypatch.setattr(C, "UNIT_WORK", 2000)
    monkeypatch.setattr(C, "UNIT_PLACEMENTS", 900)
    monkeypatch.setattr(C, "CHUNK_ROWS", 128)
    forests = C.forest_cells(train, test, ["cell"], kind, 3, True, lambda df, name: df.persist())
    # Nothing that is written grows with the trees: one sum per row, chunk and unit.
    assert set(forests.parts.columns).isdisjoint({"body", "roots"}) and forests.parts.where("cell = 1 and chunk >= 0").count() == 3 * (3 + 1)
    told = {r.cell: r for r in forests.reports().collect()}
    assert told[4].error == "a feature is missing" and all(told[c].trees == 20 and told[c].error is None for c in (1, 2, 3))
    preds, own = forests.predictions().toPandas(), forests.predictions(train=True).toPandas()
    assert preds.groupby("cell").size().to_dict() == {1: 60, 2: 60, 3: 60} and own.groupby("cell").size().to_dict() == {1: 300, 2: 40, 3: 10}
    error = ((preds.label - preds.y_pred) ** 2).groupby(preds.cell).mean()
    assert error[1] < 3 and preds[preds.cell == 3].y_pred.nunique() == 1
    if random:
        assert all(told[c].leaf_rows == 20 * len(cells[c][1]) for c in (1, 2, 3)) and abs((own.label - own.y_pred).groupby(own.cell).mean()).max() < 1e-9
    again = C.forest_cells(train.repartition(5), test.repartition(2), ["cell"], kind, 3).predictions().toPandas()
    key = ["cell", "row_id"]
    assert (preds.sort_values(key).y_pred.to_numpy() == again.sort_values(key).y_pred.to_numpy()).all()


def test_cuts_by_bins_are_cuts_by_values():
    x, y = data(300, 4)
    binned = T.Binned.of(x, C.FOREST_BINS)
    nodes = T.grow_forest(binned, y, np.ones((4, 300)), 5, 20, 1)
    other = data(200, 5)[0]
    by_value = T.leaf_values(nodes, np.arange(4), other)
    nodes["cut"] = T.code_cuts(nodes, binned.edges)
    assert (T.leaf_values(nodes, np.arange(4), binned.codes_of(other).T) == by_value).all()


def test_rows_of_the_same_bins_grow_the_same_trees_as_one():
    x, y = data(600, 6)
    x = np.round(x[:, :3])
    binned, weights = T.Binned.of(x, C.FOREST_BINS), T.bootstrap_weights(rng.integers(0, 1 << 62, 600).astype(np.uint64), np.arange(5), 1)
    grouped = T.Grouped.of(binned, y)
    assert grouped.data.codes.shape[1] == len(np.unique(x, axis=0)) < 200
    for random, w in ((False, weights), (True, np.ones((5, 600)))):
        one, other = T.grow_forest(binned, y, w, 5, 20, 2, random), grouped.grow(lambda t: w[t], range(5), 5, 20, 2, random)
        assert (one["feature"] == other["feature"]).all() and (one["cut"] == other["cut"]).all() and (one["count"] == other["count"]).all()
        np.testing.assert_allclose(one["value"], other["value"], rtol=1e-9)


@pytest.mark.parametrize("name", ["boosted", "boosted_leaf", "boosted_classifier", "boosted_leaf_classifier"])
def test_boosted_trees_from_packed_rows_are_those_of_plain_rows(spark, name):
    kind = C.KINDS[name]
    cells = {}
    for c, n in ((1, 30), (2, 900)):
        x, y = data(n, c)
        x[::7, 0] = x[::5, 2] = np.nan
        cells[c] = (x, (y > 0).astype(float) if kind.classifier else y)
    train, test = frame(spark, cells), frame(spark, {c: (x[:40], y[:40]) for c, (x, y) in cells.items()})
    forests = C.forest_cells(train, test, ["cell"], kind, 3, True, lambda df, label: df.persist())
    models = C.fit_cells(train, ["cell"], kind, 3).persist()
    assert {r.cell: r.best_rounds for r in forests.reports().collect()} == {r.cell: r.best_rounds for r in models.collect()}
    for rows, got in ((test, forests.predictions()), (train, forests.predictions(train=True))):
        want = {(r.cell, r.row_id): r.y_pred for r in C.predict_cells(models, rows, ["cell"], kind).collect()}
        found = {(r.cell, r.row_id): r.y_pred for r in got.collect()}
        assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_boosted_trees_of_a_task_take_more_values(spark, monkeypatch):
    train = frame(spark, {1: data(30)})
    monkeypatch.setattr(C, "MAX_VALUES", 149)
    assert not C.oversized(train, ["cell"]).isEmpty() and C.oversized(train, ["cell"], kind=C.KINDS["boosted"]).isEmpty()


def test_features_of_few_bins_are_counted_together():
    r = np.random.default_rng(5)
    x = np.column_stack([r.random(500), r.integers(0, 12, 500), *[r.integers(0, 2, 500) for _ in range(3)]]).astype(float)
    x[::9, 1] = x[::4, 3] = np.nan
    binned = T.Binned.of(x, 255)
    g, h, rows = r.normal(size=500), r.random(500), np.flatnonzero(r.random(500) < 0.5)
    assert len(binned.bundles()) == 2
    for own in (None, h):
        hist = T._histogram(binned, rows, g, own)
        for f in range(5):
            for k, w in enumerate((np.ones(500), g, np.ones(500) if own is None else own)):
                assert hist[k, f] == pytest.approx(np.bincount(binned.codes[f, rows], w[rows], binned.bins))
