"""Logistic regressions are fitted from distributed rows, whatever the size of a cell."""

import numpy as np
import pytest

from tests.test_cells import data, frame
from tidemark.operators import blocks as B
from tidemark.operators import cells as C
from tidemark.operators import small_models as S


def classes(n, seed):
    x, y = data(n, seed)
    return x, (y + np.random.default_rng(seed).normal(size=n) > 0).astype(float)


@pytest.mark.parametrize("name", ["ridge_classifier", "lasso_classifier", "ols_classifier"])
def test_distributed_steps_are_those_of_one_task(spark, monkeypatch, name):
    cells = {1: classes(30, 1), 2: classes(900, 2)}
    want = {c: S.logistic(*own, *C.KINDS[name].logistic) for c, own in cells.items()}
    monkeypatch.setattr(C.S, "logistic", None)  # no task fits the rows of a cell
    monkeypatch.setattr(B, "ROWS", 50)
    models = C.fit_cells(frame(spark, cells), ["cell"], C.KINDS[name]).collect()
    for r in models:
        w, n_iter, converged = want[r.cell]
        assert np.frombuffer(r.body) == pytest.approx(w, rel=1e-6) and (r.n_iter, r.converged, r.error) == (n_iter, converged, None)


def test_rows_are_given_once_for_several_cells(spark):
    x, y = classes(200, 3)
    rows = frame(spark, {1: (x, y), 2: (x[:50], y[:50])})
    picks = B.Picks(("cell",), ("k",), {(1,): [((1,), [0]), ((3,), [0, 2, 4])], (2,): [((3,), [0, 2, 4])]})
    kind = C.KINDS["ridge_classifier"]
    models = C.fit_cells(rows, ["cell", "k"], kind, picks=picks)
    got = {(r.cell, r.k): np.frombuffer(r.body) for r in models.collect()}
    assert got.keys() == {(1, 1), (1, 3), (2, 3)}
    assert got[1, 3] == pytest.approx(S.logistic(x[:, [0, 2, 4]], y, 1.0, 0.0)[0]) and got[2, 3] == pytest.approx(S.logistic(x[:50, [0, 2, 4]], y[:50], 1.0, 0.0)[0])
    preds = C.predict_cells(models, rows, ["cell", "k"], kind, picks=picks).toPandas()
    assert preds.groupby(["cell", "k"]).size().to_dict() == {(1, 1): 200, (1, 3): 200, (2, 3): 50}
    one = preds[(preds.cell == 1) & (preds.k == 1)].sort_values("row_id").y_pred.to_numpy()
    assert one == pytest.approx(S.sigmoid(got[1, 1][0] + x[:, 0] * got[1, 1][1]))


def test_no_size_changes_how_a_cell_is_fitted(spark):
    train = frame(spark, {1: data(30)})
    assert C.MAX_VALUES is None and C.oversized(train, ["cell"]).isEmpty() and not C.oversized(train, ["cell"], 149).isEmpty()
