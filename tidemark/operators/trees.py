"""Histogram trees in numpy, for tasks that hold the rows of one cell.

Features are binned once; a node is split by summed counts and targets per bin. Forests
grow level by level, all trees of a batch at once; boosted trees grow best leaf first,
with the sibling's histogram by subtraction and a learned side for missing values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np

#: A node: rows with ``x[feature] <= cut`` go to ``left``, others to ``left + 1``;
#: missing values where ``missing_left`` says. A leaf has no feature.
NODE = np.dtype([("feature", "<i4"), ("cut", "<f8"), ("left", "<i4"), ("missing_left", "?"), ("value", "<f8"), ("count", "<f8")])
HISTOGRAM = 1 << 22  # entries of a level's histogram that are held at a time
BUNDLE = 1 << 12  # joint bins of features that are counted together


@dataclass
class Binned:
    """Rows as bin numbers, ``codes[feature, row]``; the last bin is for missing values."""

    codes: np.ndarray
    edges: np.ndarray  # upper edges by feature, padded with infinity
    bins: int
    held: list | None = None

    def bundles(self) -> list[tuple[list[int], list[int], np.ndarray]]:
        """Features that are counted together, how many bins each has, and their joint codes.

        Features of few bins share one code, from whose histogram each takes its own by sums.
        """
        if self.held is None:
            sizes = [int(np.isfinite(e).sum()) + 2 for e in self.edges]
            parts: list[list[int]] = []
            for f in np.argsort(sizes, kind="stable").tolist():
                if parts and int(np.prod([sizes[g] for g in parts[-1]])) * sizes[f] <= BUNDLE:
                    parts[-1].append(f)
                else:
                    parts.append([f])
            self.held = []
            for own in parts:
                joint = np.zeros(self.codes.shape[1], np.uint16)
                for f in own:
                    joint *= np.uint16(sizes[f])
                    joint += np.where(self.codes[f] == self.bins - 1, sizes[f] - 1, self.codes[f]).astype(np.uint16)
                self.held.append((own, [sizes[f] for f in own], joint))
        return self.held

    @classmethod
    def of(cls, x: np.ndarray, most: int) -> Binned:
        """At most ``most`` bins a feature: one per distinct value, or quantiles of the values."""
        return cls.of_columns(lambda f: x[:, f], x.shape[1], len(x), most, np.int16)

    @classmethod
    def of_columns(cls, column: Callable[[int], np.ndarray], p: int, n: int, most: int, kind: type) -> Binned:
        """As ``of``, for columns that are made one at a time; ``kind`` is the type of the codes."""
        edges, codes = [], np.empty((p, n), kind)
        for f in range(p):
            values = column(f)
            known = ~np.isnan(values)
            ranked = np.sort(values[known])
            v = ranked[np.concatenate([[True], ranked[1:] != ranked[:-1]])] if len(ranked) else ranked
            if len(v) > most:
                v = np.unique(ranked[np.arange(most) * len(ranked) // most])
            edges.append((v[1:] + v[:-1]) / 2)
            del ranked
            codes[f] = np.searchsorted(edges[f], values, "left")  # missing values are above all others, until told apart
            codes[f][~known] = np.iinfo(kind).max
        width = max([1, *map(len, edges)])
        padded = np.full((p, width), np.inf)
        for row, e in zip(padded, edges):
            row[: len(e)] = e
        codes[codes == np.iinfo(kind).max] = width + 1  # no feature has as many bins as the type has numbers
        return cls(codes, padded, width + 2)

    def codes_of(self, x: np.ndarray) -> np.ndarray:
        """Other rows by the same edges."""
        codes = np.empty(x.T.shape, self.codes.dtype)
        for f, (column, e) in enumerate(zip(x.T, self.edges)):  # the padding is above every value
            codes[f] = np.where(np.isnan(column), self.bins - 1, np.searchsorted(e, column, "left"))
        return codes


@dataclass
class Nodes:
    """Nodes of a batch of trees, the roots first."""

    parts: list[np.ndarray] = field(default_factory=list)
    size: int = 0

    def add(self, n: int) -> tuple[int, np.ndarray]:
        new = np.zeros(n, NODE)
        new["feature"], new["left"] = -1, -1
        self.parts.append(new)
        self.size += n
        return self.size - n, new

    def all(self) -> np.ndarray:
        return np.concatenate(self.parts)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed hash of 64-bit numbers."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def code_cuts(nodes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Cuts of nodes as bin numbers: a value is at most an edge where its bin is at most the edge's place."""
    out = np.zeros(len(nodes))
    for f, e in enumerate(edges):
        own = nodes["feature"] == f
        out[own] = np.searchsorted(e, nodes["cut"][own], "left")
    return out


def bootstrap_weights(row_hash: np.ndarray, trees: np.ndarray, seed: int) -> np.ndarray:
    """How often each tree sees each row: Poisson with mean one, from the row's hash alone."""
    x = row_hash[None, :] ^ ((trees.astype(np.uint64)[:, None] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(seed * 0x2545F4914F6CDD1D % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    u = (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    steps = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 12.0)])))
    return np.searchsorted(steps, u.ravel()).reshape(u.shape)


def _gain(left: np.ndarray, left_total: np.ndarray, n: np.ndarray, s: np.ndarray) -> np.ndarray:
    return left_total**2 / left + (s - left_total) ** 2 / (n - left) - s**2 / n


def _best_cuts(count: np.ndarray, total: np.ndarray, features: np.ndarray, min_leaf: int) -> tuple[np.ndarray, ...]:
    """Gain, feature and cut of each node from histograms ``[node, feature, bin]``."""
    nodes, mtry, bins = count.shape
    left, left_total = np.cumsum(count, axis=2)[:, :, :-1], np.cumsum(total, axis=2)[:, :, :-1]
    n, s = count.sum(axis=2)[:, :, None], total.sum(axis=2)[:, :, None]
    valid = (left >= min_leaf) & (n - left >= min_leaf)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(valid, _gain(left, left_total, n, s), -np.inf)
    flat = gain.reshape(nodes, -1)
    best = np.argmax(flat, axis=1)
    j, cut = np.divmod(best, bins - 1)
    at = np.arange(nodes)
    return flat[at, best], features[at, j], cut


def _drawn_cuts(data: Binned, at: np.ndarray, row: np.ndarray, w: np.ndarray, s: np.ndarray, features: np.ndarray, drawn: np.ndarray, min_leaf: int) -> tuple[np.ndarray, ...]:
    """Gain, feature and cut of each node, where a cut is drawn evenly between the node's least and largest value.

    ``at`` is the node of each row, in order; every node has rows. No histogram is made: a
    node of a few rows costs these few rows, however many bins there are.
    """
    nodes, tries = features.shape
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    n, total = np.bincount(at, w, nodes), np.bincount(at, s, nodes)
    flat, rows, last = data.codes.ravel(), data.codes.shape[1], data.edges.shape[1] - 1
    gains, cuts = np.empty((nodes, tries)), np.empty((nodes, tries), np.int64)
    for j in range(tries):
        f = features[:, j].astype(np.int64)
        codes = flat[(f * rows)[at] + row]
        low, high = [part.reduceat(codes, starts).astype(np.int64) for part in (np.minimum, np.maximum)]
        least, most = data.edges[f, np.minimum(low, last)], data.edges[f, np.clip(high - 1, 0, last)]
        with np.errstate(invalid="ignore"):
            value = least + drawn[:, j] * (most - least)
        place = np.zeros(nodes, np.int64)
        for own, edges in enumerate(data.edges):
            here = np.flatnonzero(f == own)
            place[here] = np.searchsorted(edges, value[here], "left")
        place[np.isnan(value)] = 0
        cuts[:, j] = np.clip(place, low, np.maximum(high - 1, low))
        goes = codes <= cuts[at, j]
        left, left_total = np.bincount(at, w * goes, nodes), np.bincount(at, s * goes, nodes)
        valid = (left >= min_leaf) & (n - left >= min_leaf) & (high > low)
        with np.errstate(divide="ignore", invalid="ignore"):
            gains[:, j] = np.where(valid, _gain(left, left_total, n, total), -np.inf)
    best, each = np.argmax(gains, axis=1), np.arange(nodes)
    return gains[each, best], features[each, best], cuts[each, best]


def grow_forest(data: Binned, y: np.ndarray, weights: np.ndarray, min_leaf: int, depth: int, seed: int, random_cuts: bool = False) -> np.ndarray:
    """Trees over ``weights[tree, row]``; each node tries a random square root of the features.

    A node whose features allow no split tries the next ones, up to all. Leaves hold
    the weighted mean of ``y``; for a 0/1 target the split by variance is that by Gini.
    """
    centre = float(y.mean()) if len(y) else 0.0
    target = y - centre
    return _grow(data, weights, weights * target, centre, float((target**2).sum()), min_leaf, depth, seed, random_cuts)


def _grow(data: Binned, weights: np.ndarray, sums: np.ndarray, centre: float, squares: float, min_leaf: int, depth: int, seed: int, random_cuts: bool) -> np.ndarray:
    """Trees over rows that each stand for ``weights[tree, row]`` ones, whose targets less ``centre`` add up to ``sums``."""
    p = len(data.codes)
    mtry = max(1, int(np.sqrt(p)))
    rng = np.random.default_rng(seed)
    least = 1e-12 * squares + 1e-300
    trees = len(weights)
    tree, row = np.nonzero(weights)
    w, s = weights[tree, row].astype(np.float64), sums[tree, row]
    mean = s / w
    out = Nodes()
    base, nodes = out.add(trees)
    node = tree  # number within the level; rows stay in the order of their nodes
    for level in range(depth + 1):
        size = len(nodes)
        count, total = np.bincount(node, w, size), np.bincount(node, s, size)
        nodes["count"], nodes["value"] = count, centre + np.divide(total, count, out=np.zeros(size), where=count > 0)
        feature, cut = np.full(size, -1), np.zeros(size, np.int64)
        open_ = np.flatnonzero(count >= 2 * min_leaf) if level < depth else np.zeros(0, np.int64)
        order = rng.random((len(open_), p)).argsort(axis=1)
        varies = np.zeros(size, bool)  # rows of one target gain nothing by any split
        if len(open_):
            starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            varies[node[starts]] = np.maximum.reduceat(mean, starts) > np.minimum.reduceat(mean, starts)
        for first in range(0, p, mtry):
            if not len(open_):
                break
            failed = []
            drawn = rng.random((len(open_), min(mtry, p - first))) if random_cuts else None
            batch = max(1, HISTOGRAM // (mtry * (1 if random_cuts else data.bins)))
            for a in range(0, len(open_), batch):
                good = np.zeros(len(open_[a : a + batch]), bool)
                here = a + np.flatnonzero(varies[open_[a : a + batch]])
                if len(here):
                    own, tried = open_[here], order[here, first : first + mtry]
                    place = np.full(size, -1)
                    place[own] = np.arange(len(own))
                    rows = np.flatnonzero(place[node] >= 0)
                    at, r, weight, total_of = place[node[rows]], row[rows], w[rows], s[rows]
                    if random_cuts:
                        gain, f, c = _drawn_cuts(data, at, r, weight, total_of, tried, drawn[here], min_leaf)
                    else:
                        k = tried.shape[1]
                        hist_n, hist_s = np.empty((k, len(own), data.bins)), np.empty((k, len(own), data.bins))
                        for j in range(k):
                            key = at * data.bins + data.codes[tried[at, j], r]
                            hist_n[j] = np.bincount(key, weight, len(own) * data.bins).reshape(len(own), data.bins)
                            hist_s[j] = np.bincount(key, total_of, len(own) * data.bins).reshape(len(own), data.bins)
                        gain, f, c = _best_cuts(hist_n.transpose(1, 0, 2), hist_s.transpose(1, 0, 2), tried, min_leaf)
                    better = gain > least
                    feature[own[better]], cut[own[better]] = f[better], c[better]
                    good[here - a] = better
                failed.append(~good)
            again = np.concatenate(failed)
            open_, order = open_[again], order[again]
        split = np.flatnonzero(feature >= 0)
        if not len(split):
            break
        base, new = out.add(2 * len(split))
        nodes["feature"][split], nodes["cut"][split] = feature[split], data.edges[feature[split], cut[split]]
        nodes["left"][split] = base + 2 * np.arange(len(split))
        place = np.full(size, -1)
        place[split] = 2 * np.arange(len(split))
        going = np.flatnonzero(place[node] >= 0)
        node = node[going]
        right = data.codes[feature[node], row[going]] > cut[node]
        node = place[node] + right
        # Rows of a node lie side by side: its left rows stay in order before its right ones.
        sizes = np.bincount(node, minlength=2 * len(split))
        ends = np.cumsum(sizes)
        before = np.cumsum(~right)  # left rows so far, of all nodes
        rank = np.where(right, np.arange(1, len(node) + 1) - before, before)
        sides = np.stack([np.cumsum(sizes[::2]) - sizes[::2], np.cumsum(sizes[1::2]) - sizes[1::2]], axis=1).ravel()
        to = np.empty(len(node), np.int64)
        to[(ends - sizes - sides - 1)[node] + rank] = going
        row, w, s, mean = row[to], w[to], s[to], mean[to]
        node = np.repeat(np.arange(2 * len(split)), sizes)
        nodes = new
    return out.all()


def alike(codes: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of ``codes[feature, row]``, and which of them each row is: no tree can tell others apart."""
    key = np.zeros(codes.shape[1], np.int64)
    first, size = np.zeros(min(1, codes.shape[1]), np.int64), 1
    for own in codes:
        if size * bins >= 1 << 62:
            _, key = np.unique(key, return_inverse=True)
            size = len(key)
        key, size = key * bins + own, size * bins
    _, first, group = np.unique(key, return_index=True, return_inverse=True)
    return np.ascontiguousarray(codes[:, first]), group


@dataclass
class Grouped:
    """Training rows of forests, those with the same bins as one: a tree costs what they differ in, not their number."""

    data: Binned
    group: np.ndarray
    y: np.ndarray

    @classmethod
    def of(cls, data: Binned, y: np.ndarray) -> Grouped:
        codes, group = alike(data.codes, data.bins)
        return cls(Binned(codes, data.edges, data.bins), group, y)

    def grow(self, weights: Callable[[int], np.ndarray] | None, trees: Sequence[int], min_leaf: int, depth: int, seed: int, random_cuts: bool = False) -> np.ndarray:
        """As ``grow_forest``; ``weights`` gives those of the rows for a tree, each one if there is none."""
        size, centre = self.data.codes.shape[1], float(self.y.mean())
        target = self.y - centre

        def added(w: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
            return np.bincount(self.group, w, size), np.bincount(self.group, target if w is None else w * target, size)

        if weights is None:
            n, s = [np.tile(part, (len(trees), 1)) for part in added(None)]
        else:
            n, s = [np.array(part) for part in zip(*(added(weights(t)) for t in trees))]
        return _grow(self.data, n, s, centre, float((target**2).sum()), min_leaf, depth, seed, random_cuts)


def forest_sums(nodes: np.ndarray, trees: int, x: np.ndarray) -> np.ndarray:
    """Sum of the leaf values of ``trees`` trees for every row of ``x``."""
    return leaf_values(nodes, np.arange(trees), x).sum(axis=0)


def leaf_values(nodes: np.ndarray, roots: np.ndarray, x: np.ndarray, missing: int | None = None) -> np.ndarray:
    """``[root, row]``: value of the leaf that each row reaches; ``missing`` is the code of missing values, where ``x`` are codes."""
    out = np.empty((len(roots), len(x)))
    feature, cut, left, value = [np.ascontiguousarray(nodes[c]) for c in ("feature", "cut", "left", "value")]
    left = left.astype(np.int64)
    lacks = np.isnan if missing is None else lambda v: v == missing
    missing_left = np.ascontiguousarray(nodes["missing_left"]) if lacks(x).any() else None
    flat, width = np.ascontiguousarray(x).ravel(), x.shape[1]
    block = max(1, (1 << 18) // max(1, len(x)))
    for a in range(0, len(roots), block):
        own = roots[a : a + block]
        at = np.repeat(own, len(x))
        base = np.tile(np.arange(len(x)) * width, len(own))
        going = np.flatnonzero(feature[at] >= 0)
        here, base = at[going], base[going]
        while len(going):
            v = flat[base + feature[here]]
            right = v > cut[here]
            if missing_left is not None:
                right = np.where(lacks(v), ~missing_left[here], right)
            here = left[here] + right
            ended = feature[here] < 0
            at[going[ended]] = here[ended]
            stays = ~ended
            going, here, base = going[stays], here[stays], base[stays]
        out[a : a + block] = value[at].reshape(-1, len(x))
    return out


def leaf_sums(nodes: np.ndarray, roots: np.ndarray, x: np.ndarray, start: float, missing: int | None = None) -> np.ndarray:
    """``start`` and the leaf values of every row of ``x``, added up in the order of the trees, a few at a time."""
    total, few = np.zeros(len(x)), max(1, (1 << 18) // max(1, len(x)))
    for a in range(0, len(roots), few):
        total += leaf_values(nodes, roots[a : a + few], x, missing).sum(axis=0)
    return start + total


@dataclass(frozen=True)
class Boosting:
    """How boosted trees grow: leaves, depth, shrinkage and what a leaf needs."""

    step: float
    rounds: int
    leaves: int
    depth: int
    min_rows: int = 1
    min_hessian: float = 1.0
    l2: float = 0.0
    logistic: bool = False
    bins: int = 255


def _histogram(data: Binned, rows: np.ndarray, g: np.ndarray, h: np.ndarray | None, count: np.ndarray | None = None) -> np.ndarray:
    """``[3, feature, bin]``: rows (``count``, where each stands for some), gradients and curvatures (rows, where ``h`` is none)."""
    out = np.zeros((3, len(data.codes), data.bins))
    whole = len(rows) == data.codes.shape[1]
    own_g, own_h, own_n = (v if whole or v is None else v[rows] for v in (g, h, count))
    for features, sizes, codes in data.bundles():
        key = (codes if whole else codes[rows]).astype(np.int64)
        total = int(np.prod(sizes))
        sums = [np.bincount(key, w, total).reshape(sizes) for w in (own_n, own_g)]
        sums.append(sums[0] if h is None else np.bincount(key, own_h, total).reshape(sizes))
        for at, (f, size) in enumerate(zip(features, sizes)):
            others = tuple(k for k in range(len(sizes)) if k != at)
            for k in range(3):
                own = sums[k].sum(axis=others)
                out[k, f, : size - 1], out[k, f, -1] = own[:-1], own[-1]
    return out


def _split_of(hist: np.ndarray, how: Boosting) -> tuple[float, int, int, bool]:
    """Gain, feature, cut and side of missing values of the best split of one node."""
    n, g, h = hist.sum(axis=2)[:, :, None]
    known = np.cumsum(hist[:, :, :-1], axis=2)[:, :, :-1]
    best = (0.0, -1, -1, False)
    for missing_left in (False, True):
        ln, lg, lh = known + hist[:, :, -1:] * missing_left
        rn, rg, rh = n - ln, g - lg, h - lh
        valid = (ln >= how.min_rows) & (rn >= how.min_rows) & (lh >= how.min_hessian) & (rh >= how.min_hessian)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(valid, lg**2 / (lh + how.l2) + rg**2 / (rh + how.l2) - g**2 / (h + how.l2), -np.inf)
        if gain.size:
            k = int(np.argmax(gain))
            if gain.flat[k] > best[0]:
                f, c = divmod(k, gain.shape[1])
                best = (float(gain.flat[k]), f, c, missing_left)
        if not hist[0, :, -1].any():
            break
    return best


def grow_boosted(data: Binned, rows: np.ndarray, g: np.ndarray, h: np.ndarray | None, how: Boosting, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One tree, best leaf first, and the leaf value of every row of ``data``, each of which may stand for ``count`` ones."""
    nodes = np.zeros(2 * how.leaves - 1, NODE)
    nodes["feature"], nodes["left"] = -1, -1
    everyone = np.arange(data.codes.shape[1], dtype=np.int32)
    held = {0: (rows, everyone, _histogram(data, rows, g, h, count), 0)}
    best = {0: _split_of(held[0][2], how)}
    used = 1
    while used + 1 < len(nodes):
        at = max(best, key=lambda k: best[k][0], default=None)
        if at is None or best[at][0] <= 1e-12:
            break
        _, f, cut, missing_left = best.pop(at)
        own, reach, hist, depth = held.pop(at)

        def goes_left(r: np.ndarray) -> np.ndarray:
            code = data.codes[f, r]
            return np.where(code == data.bins - 1, missing_left, code <= cut)

        side, far = goes_left(own), goes_left(reach)
        parts = [(own[side], reach[far]), (own[~side], reach[~far])]
        small = int(len(parts[1][0]) < len(parts[0][0]))
        hists: list = [None, None]
        hists[small] = _histogram(data, parts[small][0], g, h, count)
        hists[1 - small] = hist - hists[small]
        nodes["feature"][at], nodes["cut"][at], nodes["left"][at], nodes["missing_left"][at] = f, data.edges[f, cut], used, missing_left
        for k in (0, 1):
            held[used + k] = (*parts[k], hists[k], depth + 1)
            if depth + 1 < how.depth:
                best[used + k] = _split_of(hists[k], how)
        used += 2
    values = np.zeros(data.codes.shape[1])
    for at, (own, reach, hist, _) in held.items():
        n, gs, hs = hist[:, 0].sum(axis=1) if len(data.codes) else (len(own), g[own].sum(), len(own) if count is None else count[own].sum())
        nodes["count"][at] = len(own) if count is None else count[own].sum()
        nodes["value"][at] = -how.step * gs / (hs + how.l2) if hs + how.l2 > 0 else 0.0
        values[reach] = nodes["value"][at]
    return nodes[:used], values


def _gradient(y: np.ndarray, score: np.ndarray, how: Boosting, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    if not how.logistic:
        return (score if count is None else count * score) - y, None
    p = 1 / (1 + np.exp(-score))
    if count is None:
        return p - y, p * (1 - p)
    return count * p - y, count * (p * (1 - p))


def base_score(y: np.ndarray, how: Boosting, count: np.ndarray | None = None) -> float:
    mean = (float(y.mean()) if count is None else float(y.sum() / count.sum())) if len(y) else 0.0
    if not how.logistic:
        return mean
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    return float(np.log(mean / (1 - mean)))


def boost(data: Binned, y: np.ndarray, rounds: int, how: Boosting) -> tuple[float, np.ndarray, np.ndarray]:
    """Start value, nodes of all rounds and the root of each."""
    return boost_and_score(data, y, rounds, how)[:3]


def boost_and_score(data: Binned, y: np.ndarray, rounds: int, how: Boosting, count: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """As ``boost``, and the scores of the training rows; with ``count`` a row stands for so many, of which ``y`` is the sum."""
    base = base_score(y, how, count)
    score, rows, parts, roots, at = np.full(len(y), base), np.arange(len(y), dtype=np.int32), [], [], 0
    for _ in range(rounds):
        nodes, values = grow_boosted(data, rows, *_gradient(y, score, how, count), how, count)
        nodes["left"] = np.where(nodes["left"] >= 0, nodes["left"] + at, -1)
        score += values
        parts.append(nodes)
        roots.append(at)
        at += len(nodes)
    return base, np.concatenate(parts) if parts else np.zeros(0, NODE), np.array(roots, np.int64), score


def best_rounds(x: np.ndarray | Binned, y: np.ndarray, fold: np.ndarray, how: Boosting, patience: int | None = None,
                count: np.ndarray | None = None, squares: np.ndarray | None = None) -> int:
    """Number of rounds of the least mean error over the folds.

    With ``patience`` all folds advance together, and training stops when so many rounds in
    a row brought nothing better; without it one fold is held after the other. Fewer than
    two folds cannot judge: one round. With ``count`` a row stands for so many of its fold,
    of which ``y`` is the sum; ``squares`` are the sums of squares of each fold.
    """
    folds = np.unique(fold)
    if len(folds) < 2:
        return 1
    data = x if isinstance(x, Binned) else Binned.of(x, how.bins)
    data.bundles()  # once for all folds

    def start(f: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = np.flatnonzero(fold != f).astype(np.int32)
        return rows, np.flatnonzero(fold == f).astype(np.int32), np.full(len(y), base_score(y[rows], how, None if count is None else count[rows]))

    def error(f: int, rows: np.ndarray, held: np.ndarray, score: np.ndarray) -> float:
        score += grow_boosted(data, rows, *_gradient(y, score, how, count), how, count)[1]
        if count is None:
            return float(np.sqrt(np.mean((y[held] - score[held]) ** 2)))
        n, own = count[held], score[held]
        return float(np.sqrt(max(0.0, squares[f] + np.sum(own * (n * own - 2 * y[held]))) / n.sum()))

    if patience is None:
        errors = np.zeros(how.rounds)
        for f in folds:
            state = start(f)
            errors += [error(f, *state) for _ in range(how.rounds)]
        return int(np.argmin(errors)) + 1
    states = [(f, *start(f)) for f in folds]
    best, least = 0, np.inf
    for k in range(how.rounds):
        mean = float(np.mean([error(*state) for state in states]))
        if mean < least:
            best, least = k, mean
        elif k - best >= patience:
            break
    return best + 1
