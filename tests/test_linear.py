import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import design as D
from tidemark.operators import impute as I
from tidemark.operators import linear as L
from tidemark.operators import models as Z
from tidemark.plans import sweep as S


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    n, p = 60, 4
    x = rng.normal(size=(n, p)) * [1, 10, 0.1, 3] + [0, 50, 1, -2]
    y = x @ [2.0, 0.0, -30.0, 0.5] + 7 + rng.normal(size=n)
    pdf = pd.DataFrame({"seed": 1, "draw": 0, "n": n, "row_id": np.arange(n), "rk": np.arange(n) + 1, "y": y,
                        "x": list(x.tolist())})
    return x, y, spark.createDataFrame(pdf).repartition(3)


SOURCES = [D.Source(f"s{i}", "continuous", [f"x{i}"]) for i in range(4)]


def fitted(spark, data, models, k=4):
    orders = spark.createDataFrame([(1, 0, [2, 0, 1, 3])], "seed long, draw long, src_order array<int>")
    rows = L.fit_linear(L.with_fold(data[2]), ["seed", "draw", "n"], SOURCES, orders, [2, k], models).collect()
    return {(r["model"], r["k"]): r for r in rows}


def test_ols_matches_lstsq_for_every_prefix(spark, data):
    x, y, _ = data
    got = fitted(spark, data, ["ols"])
    for k, cols in ((2, [0, 2]), (4, [0, 1, 2, 3])):
        b = np.linalg.lstsq(np.column_stack([np.ones(len(y)), x[:, cols]]), y, rcond=None)[0]
        r = got["ols", k]
        assert r["intercept"] == pytest.approx(b[0], rel=1e-8)
        assert np.array(r["coef"])[cols] == pytest.approx(b[1:], rel=1e-8)


def _folds(n, f=5):
    return np.array_split(np.arange(n), f)


def test_ridge_matches_direct_cross_validation(spark, data):
    x, y, _ = data
    z = (x - x.mean(0)) / x.std(0)

    def solve(rows, a):
        zc, yc = z[rows] - z[rows].mean(0), y[rows] - y[rows].mean()
        b = np.linalg.solve(zc.T @ zc + a * np.eye(4), zc.T @ yc)
        return b, y[rows].mean() - z[rows].mean(0) @ b

    errors = []
    for a in L.RIDGE_ALPHAS:
        e = []
        for f in _folds(len(y)):
            rest = np.setdiff1d(np.arange(len(y)), f)
            b, c = solve(rest, a)
            e.append(((y[f] - z[f] @ b - c) ** 2).mean())
        errors.append(np.mean(e))
    r = fitted(spark, data, ["ridge"])["ridge", 4]
    assert r["alpha"] == pytest.approx(L.RIDGE_ALPHAS[int(np.argmin(errors))])
    b, _ = solve(np.arange(len(y)), r["alpha"])
    assert np.array(r["coef"]) == pytest.approx(b / x.std(0), rel=1e-6)


def test_lasso_meets_optimality(spark, data):
    x, y, _ = data
    r = fitted(spark, data, ["lasso"])["lasso", 4]
    z = (x - x.mean(0)) / x.std(0)
    b = np.array(r["coef"]) * x.std(0)
    grad = z.T @ (y - y.mean() - z @ b) / len(y)
    assert r["converged"]
    for g, w in zip(grad, b):
        assert abs(g) <= r["alpha"] * 1.05 + 1e-3
        if w != 0:
            assert g == pytest.approx(np.sign(w) * r["alpha"], abs=2e-3)


def test_minimum_norm_when_wide():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(5, 9)), rng.normal(size=5)
    assert L.least_squares(x.T @ x, x.T @ y) == pytest.approx(np.linalg.pinv(x) @ y, abs=1e-8)


def test_nonnegative_weights():
    xx = np.array([[1.0, 0.2, 0.0], [0.2, 1.0, 0.1], [0.0, 0.1, 1.0]])
    w = Z.nonnegative_weights(xx, np.array([1.0, -0.5, 0.3]))
    assert (w >= 0).all() and w[1] == 0.0 and w[0] == pytest.approx(1.0) and w[2] == pytest.approx(0.3)


def test_size_grid_matches_columns(spark):
    for total, n, low in ((11477, 20, 10), (3, 5, 1), (100, 1, 1)):
        col = D.log2_grid(F.lit(total), n, min_size=low)
        assert spark.range(1).select(col.alias("g")).first()["g"] == S.size_grid(total, n, low)


def test_sweep_end_to_end(spark):
    rows = [(i, 2.0 * i - 0.5 * (i % 4) + 3, float(i), None if i % 7 == 0 else float(i % 4)) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, y double, x_a double, x_b double")
    src = [D.Source("a", "continuous", ["x_a"]), D.Source("b", "continuous", ["x_b"])]
    sample = S.sample_rows(I.assemble(df, ["x_a", "x_b"]), "y", [1, 2], [0], n_grid=[8, 32])
    sweep = S.linear_sweep(sample, src, [1, 2], ["ols", "ridge"])
    out = S.result_rows(sweep.predictions, sample, "e", by=["model", "seed", "draw", "n", "k"]).collect()
    assert len(out) == 16
    best = [r for r in out if r["model"] == "ols" and r["n"] == 32 and r["k"] == 2]
    assert all(r["r2_test"] > 0.999 and r["status"] == "ok" and r["n_test_total"] == 8 for r in best)
    again = S.linear_sweep(sample, src, [1, 2], ["ols"]).fits.select("intercept").collect()
    assert sorted(again) == sorted(S.linear_sweep(sample, src, [1, 2], ["ols"]).fits.select("intercept").collect())


def test_models_by_name(spark, data):
    rows = Z.as_vectors(data[2], "y")
    for name, params in (("random_forest", {"trees": 5, "depth": 3}), ("ridge", None)):
        fitted_ = Z.fit(name, rows, 1, params)
        assert fitted_.model.transform(rows).count() == 60
        assert fitted_.diagnostics["converged"]
    cells = list(Z.fit_cells([("a",), ("bad",)], lambda c: rows if c[0] == "a" else rows.select("missing"), lambda c: rows,
                             lambda r: Z.fit("ridge", r), "ridge"))
    assert cells[0][3] is None and cells[1][3] is not None


@pytest.mark.parametrize("model", ["ols", "ridge", "lasso"])
def test_columns_far_from_zero(spark, model):
    rng = np.random.default_rng(8)
    n, orders = 200, spark.createDataFrame([(1, 0, [0, 1, 2, 3])], "seed long, draw long, src_order array<int>")
    z = np.round(rng.normal(size=(n, 4)), 3)
    z[:, 3] = 0
    y = z @ [3.0, 3.0, -2.0, 0.0] + np.round(rng.normal(size=n), 3)
    got = []
    for scale, shift in ((1.0, [0, 0, 0, 0]), ([1e3, 1, 1, 1], [1.7e9, 1e7, 0, 0.1])):
        pdf = pd.DataFrame({"seed": 1, "draw": 0, "n": n, "row_id": np.arange(n), "rk": np.arange(n) + 1, "y": y, "x": list((z * scale + shift).tolist())})
        train = L.with_fold(spark.createDataFrame(pdf).repartition(3))
        got.append(L.fit_linear(train, ["seed", "draw", "n"], SOURCES, orders, [4], [model]).first())
    near, far = got
    assert np.array(far["coef"]) * [1e3, 1, 1, 1] == pytest.approx(np.array(near["coef"]), rel=1e-6, abs=1e-9)
    assert far["coef"][3] == 0 and (model == "ols" or far["alpha"] == pytest.approx(near["alpha"]))
