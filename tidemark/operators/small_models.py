"""Penalised logistic regression, ridge and a one-layer network in numpy, for tasks that hold one cell."""

from __future__ import annotations

import numpy as np

NEWTON_STEPS = 200
#: Rows of which products are made at once.
ROWS = 1 << 18


def sigmoid(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -700, 700)))


def _loss(s: np.ndarray, y: np.ndarray) -> float:
    return float(np.sum(np.logaddexp(0, s) - y * s))


def ridge(x: np.ndarray, y: np.ndarray, alpha: float) -> np.ndarray:
    """Intercept and coefficients; the intercept is not penalised."""
    mean = x.mean(axis=0)
    z = x - mean
    if z.shape[1] <= len(z):
        w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    else:
        w = z.T @ np.linalg.solve(z @ z.T + alpha * np.eye(len(z)), y - y.mean())
    return np.concatenate([[y.mean() - mean @ w], w])


def _lasso_step(hessian: np.ndarray, gradient: np.ndarray, w: np.ndarray, penalty: float) -> np.ndarray:
    """Minimiser of the quadratic model plus ``penalty * |w[1:]|``, by coordinate descent."""
    v = w.copy()
    slope = gradient.copy()
    for _ in range(1000):
        moved = 0.0
        for j in range(len(v)):
            if hessian[j, j] <= 0:
                continue
            z = v[j] - slope[j] / hessian[j, j]
            new = z if j == 0 else np.sign(z) * max(0.0, abs(z) - penalty / hessian[j, j])
            if new != v[j]:
                slope += hessian[:, j] * (new - v[j])
                moved = max(moved, abs(new - v[j]) * np.sqrt(hessian[j, j]))
                v[j] = new
        if moved < 1e-10:
            break
    return v


def logistic(x: np.ndarray, y: np.ndarray, c: float, l1: float) -> tuple[np.ndarray, int, bool]:
    """Intercept and coefficients, iterations, and whether the optimum was met.

    Minimises ``loss + ((1 - l1) / 2 * |w|^2 + l1 * |w|) / c`` by (proximal) Newton steps
    with halving; the intercept is not penalised.
    """
    n, p = x.shape
    starts = range(0, n, ROWS)
    first = np.column_stack([np.ones(len(x[:ROWS])), x[:ROWS]])

    def block(a: int) -> tuple[np.ndarray, np.ndarray]:
        return first if a == 0 else np.column_stack([np.ones(len(x[a : a + ROWS])), x[a : a + ROWS]]), y[a : a + ROWS]

    l2 = np.full(p + 1, (1 - l1) / c)
    l2[0] = 0.0
    penalty = l1 / c
    mean = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    w = np.zeros(p + 1)
    w[0] = np.log(mean / (1 - mean))

    def value(w: np.ndarray) -> float:
        return sum(_loss(z @ w, own) for z, own in map(block, starts)) + float(l2 @ w**2) / 2 + penalty * float(np.abs(w[1:]).sum())

    def slopes(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gradient, hessian = np.zeros(p + 1), np.zeros((p + 1, p + 1))
        for z, own in map(block, starts):
            prob = sigmoid(z @ w)
            gradient += z.T @ (prob - own)
            hessian += (z * (prob * (1 - prob))[:, None]).T @ z
        return gradient + l2 * w, hessian + np.diag(l2)

    now = value(w)
    for step in range(1, NEWTON_STEPS + 1):
        gradient, hessian = slopes(w)
        if violation(gradient, w, penalty) <= 1e-7 * n:
            return w, step - 1, True
        hessian[np.diag_indices(p + 1)] += 1e-12 * max(1.0, float(np.trace(hessian)))
        new = _lasso_step(hessian, gradient, w, penalty) if penalty else w - np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        share = 1.0
        while share > 1e-10 and not value(w + share * (new - w)) < now:
            share /= 2
        if share <= 1e-10:
            return w, step, violation(gradient, w, penalty) <= 1e-5 * n
        w = w + share * (new - w)
        now = value(w)
    return w, NEWTON_STEPS, False


def violation(gradient: np.ndarray, w: np.ndarray, penalty: float) -> float:
    """How far the gradient of the smooth part is from an optimum's."""
    off = np.abs(gradient)
    if penalty:
        rest = np.where(w[1:] != 0, np.abs(gradient[1:] + penalty * np.sign(w[1:])), np.maximum(0, np.abs(gradient[1:]) - penalty))
        off = np.concatenate([off[:1], rest])
    return float(off.max())


def network(x: np.ndarray, y: np.ndarray, hidden: int, iterations: int, l2: float, rate: float, seed: int,
            batch: int = 200, tolerance: float = 1e-4, patience: int = 10) -> tuple[np.ndarray, int, bool]:
    """One hidden layer of rectified units for a 0/1 target, by Adam over shuffled batches.

    Stops when the mean loss has not improved by ``tolerance`` for ``patience`` passes.
    Returns the weights in a row: hidden layer by column, its biases, output weights, bias.
    """
    rng = np.random.default_rng(seed)
    n, p = x.shape
    sizes = [(p, hidden), (hidden,), (hidden,), (1,)]
    wide, narrow = np.sqrt(6 / (p + hidden)), np.sqrt(2 / (hidden + 1))
    theta = np.concatenate([rng.uniform(-b, b, int(np.prod(s))) for s, b in zip(sizes, (wide, wide, narrow, narrow))])
    m, v, best, waited, t = np.zeros_like(theta), np.zeros_like(theta), np.inf, 0, 0
    for step in range(1, iterations + 1):
        order, total = rng.permutation(n), 0.0
        for a in range(0, n, batch):
            rows = order[a : a + batch]
            xs, ys = x[rows], y[rows]
            w1, b1, w2, b2 = layers(theta, p, hidden)
            inner = xs @ w1 + b1
            active = np.maximum(inner, 0)
            s = active @ w2 + b2
            total += _loss(s, ys) + l2 / 2 * (np.sum(w1**2) + np.sum(w2**2))
            d = (sigmoid(s) - ys) / len(rows)
            back = np.outer(d, w2) * (inner > 0)
            g = np.concatenate([(xs.T @ back + l2 / len(rows) * w1).ravel(), back.sum(axis=0), active.T @ d + l2 / len(rows) * w2, [d.sum()]])
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) * m / (np.sqrt(v) + 1e-8)
        loss = total / n
        waited = waited + 1 if loss > best - tolerance else 0
        best = min(best, loss)
        if waited > patience:
            return theta, step, True
    return theta, iterations, False


def layers(theta: np.ndarray, p: int, hidden: int) -> tuple[np.ndarray, ...]:
    k = p * hidden
    return theta[:k].reshape(p, hidden), theta[k : k + hidden], theta[k + hidden : k + 2 * hidden], theta[-1]


def network_score(theta: np.ndarray, x: np.ndarray, hidden: int) -> np.ndarray:
    w1, b1, w2, b2 = layers(theta, x.shape[1], hidden)
    return np.maximum(x @ w1 + b1, 0) @ w2 + b2
