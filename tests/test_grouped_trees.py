"""Trees of cells of any size grow from sums of rows of the same bins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_cells import data, frame
from tidemark.operators import blocks as B
from tidemark.operators import cells as C
from tidemark.operators import grouped as Q
from tidemark.operators import trees as T


def hashed(spark, cells):
    return frame(spark, cells).withColumn("_hash", F.xxhash64("row_id"))


@pytest.mark.parametrize("most", [5, 31, 255])
def test_edges_and_folds_are_those_of_whole_cells(spark, monkeypatch, most):
    monkeypatch.setattr(B, "ROWS", 100)
    monkeypatch.setattr(Q, "SAMPLES", 7)
    cells = {1: data(700, 1), 2: data(9, 2)}
    cells[1][0][::7, 0] = np.nan
    cells[1][0][:, 3] = np.exp(9 * cells[1][0][:, 3])
    rows = hashed(spark, cells).repartition(1)
    for c in Q.cells_of(rows, ["cell"], most, 5, 3):
        x, y = cells[c.key[0]]
        want = T.Binned.of_columns(lambda f: x[:, f], x.shape[1], len(x), most, np.uint8)
        assert c.n == len(y) and (c.y_min, c.y_max) == (y.min(), y.max()) and c.lacks.tolist() == np.isnan(x).any(axis=0).tolist()
        assert all((e == w[np.isfinite(w)]).all() and len(e) == np.isfinite(w).sum() for e, w in zip(c.edges, want.edges))
        own = {r.row_id: r._hash for r in rows.where(F.col("cell") == c.key[0]).collect()}
        row_hash = np.array([own[i] for i in range(len(y))])
        fold = np.searchsorted(c.fold_cuts, Q.fold_keys(row_hash, c.fold_seed), "left")
        assert (fold == C._folds(row_hash.view(np.uint64), c.fold_seed, 5)).all()


@pytest.mark.parametrize("name", ["extra", "bootstrap", "classifier", "boosted"])
def test_rows_of_the_same_bins_meet_no_task_by_themselves(spark, name):
    x, y = data(400, 5)
    x = np.round(x[:, :3])
    y = (y > 0).astype(float) if name == "classifier" else y
    kind = {"extra": C._forest(30, 5, 20, True, False), "bootstrap": C._forest(30, 5, 20, False, False), "classifier": C._forest(30, 1, 20, False, True), "boosted": C.KINDS["boosted"]}[name]
    different, held = len(np.unique(x, axis=0)), {}

    def keep(df, label):
        held[label] = df.persist()
        return held[label]

    grown = C.forest_cells(frame(spark, {1: (x, y)}), frame(spark, {1: (x, y)}), ["cell"], kind, 3, True, keep)
    of_train = [len(r.keys) // 8 for r in held["packed-rows"].where(F.col("role") == Q.TRAIN).collect()]
    assert sum(of_train) <= different * (5 if kind.folds else 1) < 300
    rows, groups = grown.predictions(train=True).toPandas(), grown.groups(train=True).toPandas()
    assert len(rows) == 400 and groups.rows.sum() == 400 and groups.total.sum() == pytest.approx(y.sum())
    assert grown.predictions().toPandas().sort_values("row_id").y_pred.to_numpy() == pytest.approx(rows.sort_values("row_id").y_pred.to_numpy(), abs=1e-9)
    assert np.dot(groups.y_pred, groups.rows) == pytest.approx(rows.y_pred.sum())
    assert ((rows.y_pred - rows.label) ** 2).mean() < 0.4 * y.var()
    told = grown.reports().first()
    assert told.error is None and (not kind.trees or (told.trees == 30 and abs(told.leaf_rows / 30 - 400) <= 6 * np.sqrt(400 / 30)))


def test_weights_of_groups_are_sums_of_those_of_rows():
    groups, y = np.repeat(np.arange(50), 40), np.random.default_rng(1).normal(size=2000)
    draws = Q.Draws(groups, y)
    n, s = np.array([draws.of(7, t, 0.0) for t in range(400)]).transpose(1, 0, 2)
    assert Q.Draws.table().mean() == 1 and Q.Draws.table().var() == pytest.approx(1, abs=1e-3)
    assert n.mean() == pytest.approx(40, abs=0.3) and n.var(axis=0).mean() == pytest.approx(40, rel=0.05)
    assert s.mean(axis=0) == pytest.approx(np.bincount(groups, y), abs=2.0)
    mixed = np.random.default_rng(2).permutation(2000)
    assert (Q.Draws(groups[mixed], y[mixed]).of(7, 3, 0.5)[1] == draws.of(7, 3, 0.5)[1]).all()


def test_more_features_than_a_number_holds(spark):
    x, y = data(120, 6, p=11)
    kind = C._forest(10, 5, 20, True, False)
    grown = C.forest_cells(frame(spark, {1: (x, y)}), frame(spark, {1: (x[:30], y[:30])}), ["cell"], kind, 3, True, lambda df, label: df.persist())
    train, test = [grown.predictions(t).toPandas().sort_values("row_id").y_pred.to_numpy() for t in (True, False)]
    assert len(train) == 120 and (train[:30] == test).all()
