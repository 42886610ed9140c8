"""Distributed estimators by name, cross-validated boosting and stacking.

Every fit is a Spark ML job over all rows of a cell. Trees take no missing
values, so passthrough features are given a value below every real one.
"""

from __future__ import annotations

import itertools
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordered import seed_hash
from tidemark.operators.design import kfold_shuffled

# Parameters of the named models (fixed values).
PARAMS: dict[str, dict] = {
    "random_forest": {"trees": 500, "min_leaf": 5, "depth": 20},
    "random_forest_classifier": {"trees": 500, "min_leaf": 1, "depth": 20},
    "extra_trees": {"trees": 500, "min_leaf": 5, "depth": 20, "bins": 16},
    "extra_trees_classifier": {"trees": 500, "min_leaf": 1, "depth": 20, "bins": 16},
    "boosted": {"depth": 2, "step": 0.3, "rounds": 90},
    "boosted_classifier": {"depth": 2, "step": 0.3, "rounds": 90},
    "boosted_leaf": {"depth": 4, "step": 0.05, "rounds": 200, "min_leaf": 10, "tol": 0.0},
    "boosted_leaf_classifier": {"depth": 4, "step": 0.05, "rounds": 200, "min_leaf": 10, "tol": 0.0},
    "ridge": {"alpha": 1.0},
    "ols_classifier": {"C": 1e12, "l1": 0.0},
    "ridge_classifier": {"C": 1.0, "l1": 0.0},
    "lasso_classifier": {"C": 1.0, "l1": 1.0},
    "neural_net_classifier": {"hidden": 64, "iterations": 500},
}
MISSING_VALUE = -1e30
LOGISTIC_ITERATIONS = 20_000
# Base models of the classification stack that differ from the models by themselves.
STACK_PARAMS = {"extra_trees_classifier": {"trees": 300}}
PATIENCE = 10


@dataclass
class Fitted:
    """A model and what its training reported."""

    model: Model
    diagnostics: dict[str, object] = field(default_factory=dict)


def make_estimator(name: str, n_rows: int, n_features: int, seed: int = 0,
                   params: dict | None = None) -> Estimator:
    """Estimator of a named model over ``features`` and ``label``."""
    p = {**PARAMS[name], **(params or {})}
    columns = {"featuresCol": "features", "labelCol": "label"}
    kind = name.removesuffix("_classifier")
    clf = name.endswith("_classifier")
    if kind in ("random_forest", "extra_trees"):
        cls = RandomForestClassifier if clf else RandomForestRegressor
        extra = {"bootstrap": False, "maxBins": p["bins"]} if kind == "extra_trees" else {}
        return cls(numTrees=p["trees"], featureSubsetStrategy="sqrt", maxDepth=p["depth"],
                   minInstancesPerNode=p["min_leaf"], seed=seed, **extra, **columns)
    if kind in ("boosted", "boosted_leaf"):
        cls = GBTClassifier if clf else GBTRegressor
        return cls(maxDepth=p["depth"], stepSize=p["step"], maxIter=p["rounds"],
                   minInstancesPerNode=p.get("min_leaf", 1), seed=seed, **columns)
    if name == "ridge":
        return LinearRegression(solver="normal", standardization=False, elasticNetParam=0.0,
                                regParam=p["alpha"] / n_rows, **columns)
    if name == "neural_net_classifier":
        return MultilayerPerceptronClassifier(layers=[n_features, p["hidden"], 2], maxIter=p["iterations"],
                                              seed=seed, **columns)
    if clf:
        return LogisticRegression(regParam=1.0 / (p["C"] * n_rows), elasticNetParam=p["l1"],
                                  standardization=False, maxIter=LOGISTIC_ITERATIONS, **columns)
    raise KeyError(name)


def as_vectors(rows: DataFrame, y: str, x: str = "x", keep: Sequence[str] = ("row_id",), passthrough: bool = False) -> DataFrame:
    """Rows for an estimator. Only trees on passthrough rows take missing values; elsewhere one raises."""
    absent = F.lit(MISSING_VALUE) if passthrough else F.raise_error(F.lit("a feature is missing")).cast("double")
    filled = F.transform(F.col(x), lambda v: F.coalesce(v, absent))
    return rows.select(*keep, F.col(y).cast("double").alias("label"), array_to_vector(filled).alias("features"))


def positive_probability(c: str = "probability") -> Column:
    return vector_to_array(F.col(c))[1]


def score_column(name: str) -> Column:
    return positive_probability() if name.endswith("_classifier") else F.col("prediction")


def describe(model: Model, limit: int | None = None) -> dict[str, object]:
    """Convergence, iterations and rounds a model reports; converged unless it hit its limit."""
    out: dict[str, object] = {"converged": True, "n_iter": None, "best_rounds": None}
    if getattr(model, "hasSummary", False) and hasattr(model.summary, "totalIterations"):
        out["n_iter"] = int(model.summary.totalIterations)
        out["converged"] = limit is None or out["n_iter"] < limit
    if hasattr(model, "getNumTrees"):
        trees = model.getNumTrees
        out["best_rounds"] = int(trees() if callable(trees) else trees)
    return out


def fit(name: str, train: DataFrame, seed: int = 0, params: dict | None = None) -> Fitted:
    """Fit a named model on ``(label, features)`` rows."""
    size = train.count()
    width = len(train.select("features").first()[0])
    est = make_estimator(name, size, width, seed, params)
    model = est.fit(train)
    limit = est.getMaxIter() if est.hasParam("maxIter") else None
    return Fitted(model, describe(model, limit))


def fit_boosted_cv(train: DataFrame, seed: int = 0, folds: int = 5, params: dict | None = None) -> Fitted:
    """Boosting whose number of rounds minimises the mean RMSE over shuffled folds."""
    p = {**PARAMS["boosted"], **(params or {})}
    tagged = kfold_shuffled(train.withColumn("_g", F.lit(0)), ["_g"], seed_hash(seed, "f", F.col("row_id")),
                            "row_id", folds).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        size = tagged.count()
        errors = []
        for f in range(min(folds, size)):
            model = fit("boosted", tagged.where(F.col("fold") != f), seed, params).model
            held = tagged.where(F.col("fold") == f)
            errors.append(np.sqrt(np.asarray(model.evaluateEachIteration(held, "squared"))))
        rounds = int(np.argmin(np.mean(errors, axis=0))) + 1
        fitted = fit("boosted", train, seed, {**p, "rounds": rounds})
        fitted.diagnostics["best_rounds"] = rounds
        return fitted
    finally:
        tagged.unpersist()


def fit_boosted_early_stop(train: DataFrame, seed: int = 0, share: float = 0.2,
                           params: dict | None = None) -> Fitted:
    """Boosting cut where a held-back share of the rows has not improved for ``PATIENCE`` rounds.

    All rounds are fitted on the other rows; the patience rule is applied to the
    held rows' error after each, and the model keeps the rounds up to the best.
    """
    p = {**PARAMS["boosted_leaf"], **(params or {})}
    held = F.conv(F.substring(seed_hash(seed, "e", F.col("row_id")), 1, 8), 16, 10).cast("double") < share * 2.0**32
    est = make_estimator("boosted_leaf", 1, 1, seed, p)
    model = est.fit(train.where(~held))
    rounds = best_round(model.evaluateEachIteration(train.where(held), "squared"))
    return Fitted(fit("boosted_leaf", train.where(~held), seed, {**p, "rounds": rounds}).model, {**describe(model), "best_rounds": rounds})


def best_round(errors: Sequence[float], patience: int = PATIENCE) -> int:
    """Round of the least error, looking on until ``patience`` rounds in a row bring nothing better."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def nonnegative_weights(xx: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """Non-negative least squares on centred moments by trying every active set."""
    best, best_gain = np.zeros(len(xy)), 0.0
    for size in range(1, len(xy) + 1):
        for active in itertools.combinations(range(len(xy)), size):
            take = list(active)
            w = np.linalg.pinv(xx[np.ix_(take, take)], hermitian=True) @ xy[take]
            if (w < 0).any():
                continue
            gain = 2 * xy[take] @ w - w @ xx[np.ix_(take, take)] @ w
            if gain > best_gain + 1e-12:
                best, best_gain = np.zeros(len(xy)), gain
                best[take] = w
    return best


Fitter = Callable[[DataFrame], Fitted]


@dataclass
class Stack:
    """Base models refitted on all rows, and how their predictions are combined."""

    bases: dict[str, Fitted]
    weights: np.ndarray
    intercept: float
    classifier: bool

    def predict(self, rows: DataFrame) -> DataFrame:
        out = rows
        for i, (name, f) in enumerate(self.bases.items()):
            keep = out.columns
            out = f.model.transform(out).select(*keep, score_column(name).alias(f"_b{i}"))
        total = F.lit(float(self.intercept))
        for i, w in enumerate(self.weights):
            total = total + F.lit(float(w)) * F.col(f"_b{i}")
        value = 1 / (1 + F.exp(-total)) if self.classifier else total
        return out.withColumn("prediction", value).drop(*[f"_b{i}" for i in range(len(self.bases))])

    transform = predict


def fit_stack(train: DataFrame, bases: dict[str, Fitter], folds: int, classifier: bool, seed: int = 0) -> Stack:
    """Stack on out-of-fold predictions.

    Regression combines with non-negative weights and an intercept;
    classification with a logistic regression on the class-1 probabilities.
    """
    by = ["label"] if classifier else ["_g"]
    source = train.withColumn("_g", F.lit(0)) if not classifier else train
    tagged = kfold_shuffled(source, by, seed_hash(seed, "k", F.col("row_id")), "row_id", folds)
    tagged = tagged.select("row_id", "label", "features", "fold").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        parts = None
        for f in range(folds):
            rest, held = tagged.where(F.col("fold") != f), tagged.where(F.col("fold") == f)
            for i, (name, fitter) in enumerate(bases.items()):
                keep = held.columns
                held = fitter(rest).model.transform(held).select(*keep, score_column(name).alias(f"_b{i}"))
            parts = held if parts is None else parts.unionByName(held)
        names = [f"_b{i}" for i in range(len(bases))]
        if classifier:
            meta_rows = parts.select("row_id", "label", array_to_vector(F.array(*names)).alias("features"))
            meta = LogisticRegression(regParam=0.0).fit(meta_rows)
            weights, intercept = meta.coefficients.toArray(), float(meta.intercept)
        else:
            # Ten-odd moments of the base predictions; the rows stay distributed.
            cols = [*names, "label"]
            pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
            m = parts.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                          *[F.covar_pop(a, b).alias(f"c_{a}_{b}") for a, b in pairs]).first()
            xx = np.array([[m[f"c_{min(a, b)}_{max(a, b)}"] for b in names] for a in names])
            xy = np.array([m[f"c_{a}_label"] for a in names])
            weights = nonnegative_weights(xx, xy)
            intercept = m["m_label"] - float(sum(w * m[f"m_{c}"] for w, c in zip(weights, names)))
        return Stack({n: fitter(train) for n, fitter in bases.items()}, weights, intercept, classifier)
    finally:
        tagged.unpersist()


def regression_stack(train: DataFrame, seed: int = 0, folds: int = 5, params: dict | None = None) -> Stack:
    p = params or {}
    return fit_stack(train, {
        n: (lambda rows, n=n: fit(n, rows, seed, p.get(n))) for n in ("ridge", "extra_trees", "boosted_leaf")
    }, folds, False, seed)


def classification_stack(train: DataFrame, seed: int = 0, folds: int = 5, params: dict | None = None) -> Stack:
    p = params or {}
    names = ("ridge_classifier", "boosted_leaf_classifier", "extra_trees_classifier", "neural_net_classifier")
    return fit_stack(train, {n: (lambda rows, n=n: fit(n, rows, seed, {**STACK_PARAMS.get(n, {}), **p.get(n, {})})) for n in names},
                     folds, True, seed)


def fit_cells(cells: Sequence[tuple], train_of: Callable[[tuple], DataFrame], test_of: Callable[[tuple], DataFrame],
              fitter: Fitter, name: str, parallel: int = 4) -> Iterator[tuple[tuple, Fitted | None, DataFrame | None, str | None]]:
    """Fit one Spark ML model per cell, several jobs at a time.

    Yields ``(cell, fitted, predictions, error)`` in order: a failing cell is
    reported, it does not stop the others. At most ``parallel`` models are held;
    the next is begun when the caller has taken one.
    """
    def one(cell: tuple):
        try:
            fitted = fitter(train_of(cell))
            scored = fitted.model.transform(test_of(cell)).select(
                "row_id", F.col("label").alias("y_true"), score_column(name).alias("y_pred"))
            return cell, fitted, scored, None
        except Exception as e:  # becomes the cell's error
            return cell, None, None, f"{type(e).__name__}: {e}"

    with ThreadPoolExecutor(parallel) as pool:
        waiting = deque()
        for cell in cells:
            waiting.append(pool.submit(one, cell))
            if len(waiting) >= parallel:
                yield waiting.popleft().result()
        while waiting:
            yield waiting.popleft().result()
