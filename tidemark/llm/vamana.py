"""A robust-pruned directed graph over vectors, built and searched in lockstep.

Searches of many queries advance together: each step expands the nearest open nodes
of every query's beam. Building inserts points in batches of growing size: a greedy
search proposes neighbours, relaxed pruning keeps those that no kept neighbour
covers, and reverse edges are pruned the same way. Distances are squared Euclidean;
vectors get one more component, so that the nearest point has the largest inner
product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DEGREE, BEAM, ALPHA, BATCH = 28, 56, 1.2, 512
#: Nodes of a beam that a step expands.
WIDTH = 4


@dataclass
class Graph:
    points: np.ndarray  # n by d + 1, 32-bit
    edges: np.ndarray  # n by DEGREE, -1 where free
    start: int


def lift(vectors: np.ndarray) -> np.ndarray:
    """Unit of scale taken out, and a component that makes all norms equal."""
    vectors = vectors / max(np.abs(vectors).max(initial=0.0), np.finfo(float).tiny)
    norms = np.einsum("ij,ij->i", vectors, vectors)
    most = norms.max() if len(norms) else 1.0
    extra = np.sqrt(np.maximum(0, most - norms))
    return (np.concatenate([vectors, extra[:, None]], axis=1) / np.sqrt(most)).astype(np.float32)


def search(points: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the ``beam`` nearest nodes found, nearest first; -1 where fewer."""
    n = len(queries)
    ids, dist = np.full((n, beam), -1, np.int32), np.full((n, beam), np.inf, np.float32)
    open_ = np.zeros((n, beam), bool)
    seen = np.zeros((n, len(points)), bool)
    ids[:, 0], open_[:, 0], seen[:, start] = start, True, True
    dist[:, 0] = ((queries - points[start]) ** 2).sum(axis=1)
    live = np.arange(n)
    while len(live):
        # The nearest WIDTH open nodes of a beam, which is sorted; a beam with fewer takes none twice.
        at = np.argsort(~open_[live], axis=1, kind="stable")[:, :WIDTH]
        taken = np.take_along_axis(open_[live], at, 1)
        np.put_along_axis(still := open_[live], at, False, 1)
        open_[live] = still
        near = np.where(taken[:, :, None], edges[np.take_along_axis(ids[live], at, 1)], -1)
        fresh = np.zeros(near.shape, bool)
        for w in range(near.shape[1]):  # the second of two nodes with a common neighbour has seen it
            to = np.where(near[:, w] >= 0, near[:, w], start)
            fresh[:, w] = ~seen[live[:, None], to]
            seen[live[:, None], to] = True
        near, fresh = near.reshape(len(live), -1), fresh.reshape(len(live), -1)
        row, col = np.nonzero(fresh)
        gap = points[near[row, col]] - queries[live[row]]
        d = np.full(near.shape, np.inf, np.float32)
        d[row, col] = np.einsum("ij,ij->i", gap, gap)
        both = np.concatenate([dist[live], d], axis=1)
        order = np.argsort(both, axis=1, kind="stable")[:, :beam]
        dist[live] = np.take_along_axis(both, order, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1), order, 1)
        open_[live] = np.take_along_axis(np.concatenate([open_[live], fresh], axis=1), order, 1)
        live = live[open_[live].any(axis=1)]
    return ids, dist


def prune(points: np.ndarray, of: np.ndarray, found: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node ``of[i]``, its kept edges among ``found[i]`` (-1 where none).

    The nearest candidate is kept; it covers those that are closer to it, by the
    factor ``alpha``, than to the node. Repeat with the nearest that is left.
    """
    found = np.where(found == of[:, None], -1, found)
    own = points[of]
    d = np.where(found >= 0, ((points[found] - own[:, None, :]) ** 2).sum(axis=2), np.inf)
    order = np.argsort(d, axis=1, kind="stable")
    found, d = np.take_along_axis(found, order, 1), np.take_along_axis(d, order, 1)
    same = np.zeros(found.shape, bool)
    same[:, 1:] = (found[:, 1:] == found[:, :-1]) & (found[:, 1:] >= 0)
    d[same] = np.inf
    # Relative to the node: what rounding takes is small against the distances compared.
    p = points[found] - own[:, None, :]
    products = p @ p.transpose(0, 2, 1)
    alive = np.isfinite(d)
    out = np.full((len(of), degree), -1, np.int32)
    rows = np.arange(len(of))
    for k in range(degree):
        pick = alive.argmax(axis=1)
        has = alive[rows, pick]
        if not has.any():
            break
        out[has, k] = found[rows[has], pick[has]]
        between = d[rows, pick][:, None] + d - 2 * products[rows, pick]
        alive &= ~(has[:, None] & (alpha * alpha * between <= d))
        alive[rows, pick] = False
    return out


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, batch: int = BATCH) -> Graph:
    """Graph over all rows of ``vectors``, which should be distinct."""
    points = lift(vectors)
    n = len(points)
    edges = np.full((n, degree), -1, np.int32)
    if n <= degree + 1:  # everyone knows everyone
        others = np.arange(n - 1)[None, :] + (np.arange(n - 1)[None, :] >= np.arange(n)[:, None])
        edges[:, : n - 1] = others
        return Graph(points, edges, 0)
    start = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    order = np.random.default_rng(n).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    done = 1
    while done < n:
        new = order[done : done + min(batch, done)]
        found, _ = search(points, edges, start, points[new], beam)
        edges[new] = prune(points, new, found, degree, alpha)
        to, of = edges[new].ravel(), np.repeat(new, degree)
        to, of = to[to >= 0], of[to >= 0]
        rank = np.argsort(to, kind="stable")
        to, of = to[rank], of[rank]
        first = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        count = np.diff(np.append(first, len(to)))
        while len(first):  # a hub takes its new edges a few at a time
            take = np.minimum(count, degree)
            wide = np.full((len(first), degree), -1, np.int32)
            at = np.arange(degree)
            ok = at < take[:, None]
            wide[ok] = of[(first[:, None] + at)[ok]]
            for s in range(0, len(first), batch):
                t = to[first[s : s + batch]]
                edges[t] = prune(points, t, np.concatenate([edges[t], wide[s : s + batch]], axis=1), degree, alpha)
            first, count = first + take, count - take
            first, count = first[count > 0], count[count > 0]
        done += len(new)
    return Graph(points, edges, start)
