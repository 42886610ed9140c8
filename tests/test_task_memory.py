"""What a task that fits one cell holds beside the rows."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tidemark.operators import cells as C
from tidemark.operators import small_models as S
from tests.test_cells import data, frame


def peak(call):
    tracemalloc.start()
    try:
        out = call()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_features_of_a_cell_are_held_once():
    r = np.random.default_rng(0)

    def batches():
        for a in range(60):
            x = pa.ListArray.from_arrays(np.arange(0, 8 * 10_000 + 1, 8, dtype=np.int32), r.random(8 * 10_000))
            yield pa.record_batch([x, pa.array(np.arange(a * 10_000, (a + 1) * 10_000))], names=["features", "row_id"])

    (x, own), most = peak(lambda: C._gathered(batches(), ["row_id"]))
    assert x.shape == (600_000, 8) and (own["row_id"] == np.arange(600_000)).all()
    assert most < 1.7 * x.nbytes


def test_a_regression_makes_products_of_some_rows_at_a_time(monkeypatch):
    r = np.random.default_rng(1)
    x = r.normal(size=(300_000, 6))
    y = (r.random(300_000) < S.sigmoid(x[:, 0] - 0.5 * x[:, 3])).astype(float)
    whole = S.logistic(x, y, 1.0, 0.0)[0]
    monkeypatch.setattr(S, "ROWS", 10_000)
    (parts, _, met), most = peak(lambda: S.logistic(x, y, 1.0, 0.0))
    assert met and most < 0.5 * x.nbytes and np.allclose(parts, whole, atol=1e-9)


def test_a_network_of_a_task_takes_more_values(spark, monkeypatch):
    train = frame(spark, {1: data(30)})
    monkeypatch.setattr(C, "MAX_VALUES", 149)
    assert not C.oversized(train, ["cell"]).isEmpty() and C.oversized(train, ["cell"], kind=C.KINDS["neural_net_classifier"]).isEmpty()
