"""Linear models of every cell from one pass of Gram matrices.

A cell's sufficient statistics are the cross-products of ``[1, x, y]`` per
cross-validation fold, x and y less the cell's means, so that columns far from
zero lose no digits. Tasks sum them over Arrow batches with matrix products;
Spark adds the parts. Fitting then works on p x p numbers, whatever the number
of rows: one Gram serves every K (its sources come first in the permutation)
and every linear model.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.design import Source, contiguous_fold, source_positions
from tidemark.operators.impute import MAX_COMPILED_FEATURES, join_cells

# Penalty grids and limits (fixed values).
RIDGE_ALPHAS = np.logspace(-4, 4, 50)
LASSO_ALPHAS = np.logspace(-4, 1, 50)
CV_FOLDS = 5
LASSO_MAX_ITER = 20_000
LASSO_TOL = 1e-4
# Bytes of partial matrices a task holds before it hands them on.
MAX_HELD_BYTES = 64 << 20
EPS = float(np.finfo(float).eps)
# Share of variance, on standardised columns, below which a direction is taken as dependent.
DEPENDENT = 1e-13

FIT_DDL = "k int, model string, intercept double, coef array<double>, alpha double, n_iter int, converged boolean"


def with_fold(train: DataFrame, folds: int = CV_FOLDS) -> DataFrame:
    """Contiguous folds along the cell's row permutation; ``rk`` is the position."""
    n = F.col("n").cast("bigint")
    return train.withColumn("fold", contiguous_fold(F.col("rk"), n, F.least(F.lit(folds).cast("bigint"), n)))


def centres(train: DataFrame, by: Sequence[str], x: str = "x", y: str = "y", features: int | None = None) -> DataFrame:
    """Mean of every column of ``[x, y]``, exact where the column is constant: ``(by, j, v)``, j from 1.

    Few ``features`` are averaged as columns of a row; more, or of unknown number, as rows of their own.
    """
    if features is not None and features <= MAX_COMPILED_FEATURES:
        own = [*[F.col(x)[i] for i in range(features)], F.col(y).cast("double")]
        means = F.array(*[F.greatest(F.min(v), F.least(F.max(v), F.avg(v))) for v in own])
        return train.groupBy(*by).agg(means.alias("_m")).select(*by, F.posexplode("_m").alias("j", "v")).select(*by, (F.col("j") + 1).alias("j"), "v")
    columns = F.concat(F.col(x), F.array(F.col(y).cast("double")))
    long = train.select(*by, F.posexplode(columns).alias("pos", "v"))
    mean = F.greatest(F.min("v"), F.least(F.max("v"), F.avg("v")))
    return long.groupBy(*by, "pos").agg(mean.alias("v")).select(*by, (F.col("pos") + 1).alias("j"), "v")


def gram(train: DataFrame, by: Sequence[str], x: str = "x", y: str = "y",
         centre: DataFrame | None = None, n_cells: int | None = None, width: int = 1000, features: int | None = None) -> DataFrame:
    """Upper triangle of the cross-products of ``[1, x, y]``, less their ``centre``: ``(by, fold, i, j, v)``."""
    by = list(by)
    keys = [*by, "fold"]

    def emit(held: dict, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for key, g in held.items():
            i, j = np.triu_indices(g.shape[0])
            own = [pa.repeat(pa.scalar(v, schema.field(k).type), len(i)) for k, v in zip(keys, key)]
            yield pa.record_batch([*own, pa.array(i.astype("int32")), pa.array(j.astype("int32")), pa.array(g[i, j])], names=[*keys, "i", "j", "v"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, schema = {}, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            schema = b.schema
            z = np.column_stack([np.ones(b.num_rows), b.column(len(keys)).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)])
            cells = pd.DataFrame({k: b.column(i).to_numpy(zero_copy_only=False) for i, k in enumerate(keys)})
            for key, rows in cells.groupby(keys, sort=False).indices.items():
                part = z[rows].T @ z[rows]
                if key not in held:
                    size += part.nbytes
                held[key] = held[key] + part if key in held else part
            if size > MAX_HELD_BYTES:
                yield from emit(held, schema)
                held, size = {}, 0
        yield from emit(held, schema)

    types = dict(train.dtypes)
    ddl = ", ".join([*[f"{k} {types[k]}" for k in keys], "i int, j int, v double"])
    rows = train.select(*keys, F.concat(F.col(x), F.array(F.col(y).cast("double"))).alias("z"))
    if centre is not None:
        packed = centre.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("_c"))
        less = F.zip_with("z", "_c", lambda a, c: a - c["v"])
        if features is not None and features <= MAX_COMPILED_FEATURES:
            less = F.array(*[F.col("z")[i] - F.col("_c")[i]["v"] for i in range(features + 1)])
        rows = join_cells(rows, packed, by, n_cells, width=2 * width).select(*keys, less.alias("z"))
    return rows.mapInArrow(parts, ddl).groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))


def _centred(g: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float, np.ndarray, float]:
    """Count-free centred moments of the chosen columns of an augmented Gram."""
    n = g[0, 0]
    mean, y_mean = g[0, cols] / n, g[0, -1] / n
    xx = g[np.ix_(cols, cols)] - n * np.outer(mean, mean)
    xy = g[cols, -1] - n * mean * y_mean
    # A column that is constant in these folds only leaves rounding behind.
    none = np.diag(xx) <= 16 * EPS * np.diag(g)[cols]
    xx[none, :] = xx[:, none] = 0.0
    xy[none] = 0.0
    return xx, xy, n, y_mean, mean, g[-1, -1] - n * y_mean * y_mean


def least_squares(xx: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """Minimum-norm solution of the normal equations."""
    return np.linalg.pinv(xx, rcond=DEPENDENT, hermitian=True) @ xy


def ridge_path(xx: np.ndarray, xy: np.ndarray, alphas: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(xx)
    turned = vectors.T @ xy
    return (vectors @ (turned[:, None] / (np.maximum(values, 0)[:, None] + alphas[None, :]))).T


def lasso_path(xx: np.ndarray, xy: np.ndarray, n: float, alphas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinate descent on the Gram, from the largest penalty down with warm starts."""
    p = len(xy)
    out, iters = np.zeros((len(alphas), p)), np.zeros(len(alphas), dtype=int)
    b, grad = np.zeros(p), xy.copy()
    diag = np.diag(xx)
    scale = np.sqrt(np.maximum(diag, 1e-300))
    for a in np.argsort(alphas)[::-1]:
        for it in range(1, LASSO_MAX_ITER + 1):
            moved = 0.0
            for j in range(p):
                if diag[j] <= 0.0:
                    continue
                rho = grad[j] + diag[j] * b[j]
                new = np.sign(rho) * max(abs(rho) - n * alphas[a], 0.0) / diag[j]
                step = new - b[j]
                if step != 0.0:
                    grad -= xx[:, j] * step
                    b[j] = new
                    moved = max(moved, abs(step) * scale[j])
            if moved <= LASSO_TOL * max(1.0, np.max(np.abs(b) * scale)):
                break
        out[a], iters[a] = b, it
    return out, iters


def _fold_error(g: np.ndarray, cols: np.ndarray, b: np.ndarray, intercept: float) -> float:
    """Mean squared error on a fold, from the fold's own Gram."""
    w = np.concatenate([[-intercept], -b, [1.0]])
    take = np.concatenate([[0], cols, [g.shape[0] - 1]])
    return float(w @ g[np.ix_(take, take)] @ w) / g[0, 0]


def _scaled(g: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """The Gram after standardising x with the cell's mean and deviation."""
    t = np.eye(g.shape[0])
    inner = np.arange(1, g.shape[0] - 1)
    t[inner, inner] = 1.0 / sd
    t[0, inner] = -mean / sd
    return t.T @ g @ t


def fit_cell(folds: dict[int, np.ndarray], cols: np.ndarray, model: str,
             centre: np.ndarray | None = None) -> tuple[float, np.ndarray, float, int, bool]:
    """Fit one model on the chosen columns: (intercept, coef, alpha, iterations, converged).

    ``centre`` is what was taken from the columns of ``[x, y]`` before the products.
    A column is constant if nothing is left of it.
    """
    total = sum(folds.values())
    n = total[0, 0]
    mean = total[0, 1:-1] / n
    var = np.diag(total)[1:-1] / n - mean * mean
    tiny = 16 * EPS * np.diag(total)[1:-1] / n
    sd = np.where(var > tiny, np.sqrt(np.maximum(var, 0)), 1.0)
    parts = {f: _scaled(g, mean, sd) for f, g in folds.items()}
    whole = sum(parts.values())
    xx, xy, n, y_mean, x_mean, _ = _centred(whole, cols)
    alpha, iters, converged = float("nan"), 1, True
    if model == "ols":
        b = least_squares(xx, xy)
    else:
        alphas = RIDGE_ALPHAS if model == "ridge" else LASSO_ALPHAS
        errors = np.zeros((len(parts), len(alphas)))
        # Added up, not subtracted: a fold with an outlier would take the others' digits along.
        rests = [_centred(sum((p for g, p in parts.items() if g != f), np.zeros_like(whole)), cols) for f in parts]
        if model == "ridge":
            paths = [ridge_path(r[0], r[1], alphas) for r in rests]
        else:
            paths = [lasso_path(r[0], r[1], r[2], alphas)[0] for r in rests]
        for row, part in enumerate(parts.values()):
            _, _, _, ry, rmean, _ = rests[row]
            for a, coef in enumerate(paths[row]):
                errors[row, a] = _fold_error(part, cols, coef, ry - rmean @ coef)
        best = int(np.argmin(np.round(errors.mean(axis=0), 12)))
        alpha = float(alphas[best])
        if model == "ridge":
            b = ridge_path(xx, xy, alphas[best:best + 1])[0]
        else:
            path, counts = lasso_path(xx, xy, n, alphas[best:best + 1])
            b, iters = path[0], int(counts[0])
            converged = iters < LASSO_MAX_ITER
    coef = np.zeros(total.shape[0] - 2)
    coef[cols - 1] = b / sd[cols - 1]
    intercept = y_mean - x_mean @ b - float(np.dot(coef, mean))
    if centre is not None:
        intercept += centre[-1] - float(np.dot(coef, centre[:-1]))
    return float(intercept), coef, alpha, iters, converged


def fit_linear(train: DataFrame, by: Sequence[str], sources: Sequence[Source], orders: DataFrame,
               k_grid: Sequence[int], models: Sequence[str] = ("ols", "ridge", "lasso"),
               x: str = "x", y: str = "y", n_cells: int | None = None) -> DataFrame:
    """Coefficients for every (cell, K, model).

    ``train`` holds imputed rows with a ``fold``; ``orders`` one row per
    (seed, draw) with the permuted source positions as ``src_order``.
    """
    by = list(by)
    positions = source_positions(sources)
    ks, names = sorted(k_grid), list(models)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        size = int(pdf["j"].max()) + 1
        off = pdf["fold"] == -1
        centre = np.zeros(size - 1)
        centre[pdf["j"][off] - 1] = pdf["v"][off]
        grams: dict[int, np.ndarray] = {}
        for fold, rows in pdf[~off].groupby("fold"):
            g = np.zeros((size, size))
            g[rows["i"], rows["j"]] = rows["v"]
            grams[int(fold)] = g + np.triu(g, 1).T
        order = pdf["src_order"].iloc[0]
        out = []
        for k in ks:
            cols = np.array(sorted(p + 1 for s in order[:k] for p in positions[s]))
            for m in names:
                out.append((k, m, *fit_cell(grams, cols, m, centre)))
        res = pd.DataFrame(out, columns=["k", "model", "intercept", "coef", "alpha", "n_iter", "converged"])
        for c in by:
            res[c] = pdf[c].iloc[0]
        return res[[*by, "k", "model", "intercept", "coef", "alpha", "n_iter", "converged"]]

    features = sum(len(p) for p in positions)
    centre = centres(train, by, x, y, features)
    fold = dict(train.dtypes)["fold"]
    products = gram(train, by, x, y, centre, n_cells, features + 1, features)
    shifts = centre.select(*by, F.lit(-1).cast(fold).alias("fold"), F.lit(0).alias("i"), "j", "v")
    stats = products.unionByName(shifts).join(orders, [c for c in by if c in orders.columns])
    types = dict(train.dtypes)
    ddl = ", ".join([*[f"{c} {types[c]}" for c in by], FIT_DDL])
    return stats.groupBy(*by).applyInPandas(solve, ddl)


def linear_value(x: Column, intercept: Column, coef: Column, features: int | None = None) -> Column:
    if features is not None and features <= MAX_COMPILED_FEATURES:
        return intercept + reduce(lambda acc, i: acc + x[i] * coef[i], range(features), F.lit(0.0))
    dot = F.aggregate(F.zip_with(x, coef, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    return intercept + dot


def predict_linear(rows: DataFrame, fits: DataFrame, by: Sequence[str], n_cells: int | None = None,
                   keep: Sequence[str] = ("row_id", "y"), x: str = "x", width: int = 1000, features: int | None = None) -> DataFrame:
    """Predictions of every fit of a cell on the cell's rows; ``width`` bounds a cell's coefficients.

    The sum of few ``features`` is written out, so that Spark compiles it.
    """
    packed = fits.groupBy(*by).agg(F.collect_list(F.struct("k", "model", "intercept", "coef")).alias("_fits"))
    return join_cells(rows, packed, by, n_cells, width=width).select(*by, *keep, x, F.explode("_fits").alias("_f")).select(
        *by, "_f.k", "_f.model", *keep, linear_value(F.col(x), F.col("_f.intercept"), F.col("_f.coef"), features).alias("y_pred"))
