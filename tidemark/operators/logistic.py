"""Penalised logistic regressions of all cells, whose rows stay distributed.

All cells take their Newton steps together: a step is one pass that adds up losses,
gradients and curvatures, which are as many numbers as a cell has pairs of features,
whatever the number of rows. The steps are those of ``small_models.logistic``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import blocks as B
from tidemark.operators import small_models as S

#: Shares of a step that are tried where the whole one does not lower the loss.
SHARES = 0.5 ** np.arange(1, 34)
VECTORS = "cell int, slot int, task int, v binary"


@dataclass
class Fit:
    """A cell's regression on its way."""

    row_cell: int  # of the rows
    slot: int
    columns: np.ndarray
    n: int
    w: np.ndarray
    value: float = 0.0
    gradient: np.ndarray | None = None  # of the loss alone, as the curvature
    hessian: np.ndarray | None = None
    step: int = 1
    move: np.ndarray | None = None
    given: bool = False  # the next point was found lower already
    converged: bool | None = None


def facts(rows: DataFrame, by: list[str], keys: list[tuple]) -> dict[int, np.ndarray]:
    """Of every cell of rows: count, sum, least and largest label, and how often each feature is missing."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for cell, x, own in B.by_cell(batches, ["label"]):
            y = own["label"]
            new = np.concatenate([[len(y), y.sum(), (y == 0).sum(), (y == 1).sum()], np.isnan(x).sum(axis=0)])
            held[cell] = held.get(cell, 0.0) + new
        yield from _vectors(((cell, 0, v) for cell, v in held.items()))

    found = B.added(B.numbered(rows, by, keys).mapInArrow(look, VECTORS))
    return {cell: v for (cell, _), v in found.items()}


def _vectors(found: Iterator[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    rows = [(cell, slot, task, np.asarray(v, float).tobytes()) for cell, slot, v in found]
    columns = zip(*rows) if rows else [[], [], [], []]
    yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["cell", "slot", "task", "v"])


def _sums(rows: DataFrame, by: list[str], keys: list[tuple], points: dict[int, list[tuple[int, np.ndarray, np.ndarray]]]) -> dict[tuple[int, int], np.ndarray]:
    """One pass: at a single point loss, gradient and curvature, at several the losses alone."""
    cells = sorted(points)
    asked = [points[c] for c in cells]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for cell, x, own in B.by_cell(batches, ["label"]):
            y = own["label"]
            for slot, columns, w in asked[cell]:
                z = np.column_stack([np.ones(len(y)), x[:, columns]])
                if w.ndim == 2:
                    new = np.array([S._loss(z @ v, y) for v in w])
                else:
                    s = z @ w
                    prob = S.sigmoid(s)
                    new = np.concatenate([[S._loss(s, y)], z.T @ (prob - y), ((z * (prob * (1 - prob))[:, None]).T @ z).ravel()])
                held[cell, slot] = held.get((cell, slot), 0.0) + new
        yield from _vectors(((*k, v) for k, v in held.items()))

    found = B.added(B.numbered(rows, by, [keys[c] for c in cells]).mapInArrow(add, VECTORS))
    return {(cells[cell], slot): v for (cell, slot), v in found.items()}


def fit(rows: DataFrame, picks: B.Picks, c: float, l1: float) -> list[dict]:
    """A dict per cell: its keys, ``w``, ``n_train``, ``y_min``, ``y_max``, ``n_iter``, ``converged`` and ``error``.

    ``rows``: the keys of rows, ``label`` and ``features``; they are read once per step.
    """
    by = list(picks.by)
    rows = rows.select(*by, F.col("label").cast("double").alias("label"), "features")
    keys = sorted(tuple(r) for r in rows.select(*by).distinct().collect())  # cells of the caller's design
    out, fits = [], []
    for i, found in sorted(facts(rows, by, keys).items()):
        n, ones, y_none, y_one, lacks = int(found[0]), found[1], found[2], found[3], found[4:]
        for slot, (key, columns) in enumerate(picks.cells(keys[i], len(lacks))):
            told = dict(zip(picks.keys, (*keys[i], *key))) | {"n_train": n, "y_min": 0.0 if y_none else 1.0, "y_max": 1.0 if y_one else 0.0, "error": None, "w": None, "n_iter": None, "converged": None}
            if not (y_none and y_one):
                told["error"] = "the training rows are of one class"
            elif lacks[columns].any():
                told["error"] = "a feature is missing"
            else:
                w = np.zeros(len(columns) + 1)
                mean = min(max(ones / n, 1e-6), 1 - 1e-6)
                w[0] = np.log(mean / (1 - mean))
                fits.append((told, Fit(i, slot, np.array(columns, int), n, w)))
            out.append(told)
    _newton(rows, by, keys, [f for _, f in fits], c, l1)
    for told, f in fits:
        told |= {"w": f.w, "n_iter": f.step, "converged": f.converged}
    return out


def _newton(rows: DataFrame, by: list[str], keys: list[tuple], fits: list[Fit], c: float, l1: float) -> None:
    penalty = l1 / c

    def l2(f: Fit) -> np.ndarray:
        return np.concatenate([[0.0], np.full(len(f.columns), (1 - l1) / c)])

    def added(f: Fit, w: np.ndarray) -> float:
        return float(l2(f) @ w**2) / 2 + penalty * float(np.abs(w[1:]).sum())

    def ask(own: list[tuple[Fit, np.ndarray]]) -> list[np.ndarray]:
        points: dict[int, list] = {}
        for f, w in own:
            points.setdefault(f.row_cell, []).append((f.slot, f.columns, w))
        found = _sums(rows, by, keys, points) if own else {}
        return [found[f.row_cell, f.slot] for f, _ in own]

    def take(f: Fit, w: np.ndarray, sums: np.ndarray) -> None:
        p = len(w)
        f.w, f.value, f.gradient, f.hessian = w, float(sums[0]) + added(f, w), sums[1 : p + 1], sums[p + 1 :].reshape(p, p)

    for f, sums in zip(fits, ask([(f, f.w) for f in fits])):
        take(f, f.w, sums)
    while active := [f for f in fits if f.converged is None]:
        for f in active:
            if f.given:
                continue
            gradient, hessian = f.gradient + l2(f) * f.w, f.hessian + np.diag(l2(f))
            if S.violation(gradient, f.w, penalty) <= 1e-7 * f.n:
                f.step, f.converged = f.step - 1, True
                continue
            hessian[np.diag_indices(len(f.w))] += 1e-12 * max(1.0, float(np.trace(hessian)))
            new = S._lasso_step(hessian, gradient, f.w, penalty) if penalty else f.w - np.linalg.lstsq(hessian, gradient, rcond=None)[0]
            f.move = new - f.w
        active = [f for f in active if f.converged is None]
        search = []
        for f, sums in zip(active, ask([(f, f.w + f.move) for f in active])):
            w = f.w + f.move
            if f.given or float(sums[0]) + added(f, w) < f.value:
                take(f, w, sums)
                f.step, f.given = f.step + 1, False
                if f.step > S.NEWTON_STEPS:
                    f.step, f.converged = S.NEWTON_STEPS, False
            else:
                search.append(f)
        for f, losses in zip(search, ask([(f, f.w + SHARES[:, None] * f.move) for f in search])):
            lower = [k for k, (s, loss) in enumerate(zip(SHARES, losses)) if loss + added(f, f.w + s * f.move) < f.value]
            if lower:
                f.move, f.given = SHARES[lower[0]] * f.move, True
            else:
                f.converged = S.violation(f.gradient + l2(f) * f.w, f.w, penalty) <= 1e-5 * f.n
