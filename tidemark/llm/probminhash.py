"""ProbMinHash signatures and exact probability Jaccard of weighted word shingles.

A shingle of weight w is a Poisson process of rate w: its arrival times and the
register that each arrival falls to are functions of the shingle alone, scaled by
1/w. A register keeps the shingle that arrives first. Two texts agree in a register
with the probability Jaccard of their weighted shingle sets. A shingle is dropped as
soon as its next arrival comes after the latest of its text's registers.
"""

from __future__ import annotations

import numpy as np

from tidemark.llm.text import Words, mix, span_hash, window_hash

GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, shingle and weight of every distinct shingle of a slice.

    A text of fewer words than a shingle is one shingle. The weight is
    1 + ln(occurrences), so that a repeated line does not drown the rest.
    """
    hashes = w.hashes()
    whole = w.whole(size)[: max(0, len(hashes) - size + 1)]
    at = np.flatnonzero(whole)
    short = np.flatnonzero((w.count > 0) & (w.count < size))
    doc = np.concatenate([w.doc[at], short])
    item = np.concatenate([window_hash(hashes, size)[at] if len(at) else np.zeros(0, np.uint64), span_hash(hashes, w.off[short], w.off[short + 1])])
    order = np.lexsort((item, doc))
    doc, item = doc[order], item[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(doc)))
    return doc[first], item[first], 1.0 + np.log(times)


def signatures(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """Winning shingle of each register, ``texts`` by ``registers``; 0 for texts without shingles."""
    low = np.full(texts * registers, np.inf)
    winner = np.zeros(texts * registers, np.uint64)
    time = np.zeros(len(doc))
    step = np.uint64(0)
    while len(doc):
        step += np.uint64(1)
        draw = mix(item + np.multiply([step], GOLD))
        time = time - np.log1p(-(draw >> np.uint64(11)).astype(float) * 2.0**-53) / weight
        slot = doc * registers + ((mix(draw ^ GOLD) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        better = np.flatnonzero(time < low[slot])
        better = better[np.argsort(-time[better], kind="stable")]  # the earliest is written last
        low[slot[better]] = time[better]
        winner[slot[better]] = item[better]
        going = time < low.reshape(texts, registers).max(axis=1)[doc]
        doc, item, weight, time = doc[going], item[going], weight[going], time[going]
    return winner.reshape(texts, registers)


def bands(winners: np.ndarray, rows: int) -> np.ndarray:
    """Hash of every ``rows`` registers in a row, different for each band."""
    texts, registers = winners.shape
    at = np.arange(0, texts * registers, rows)
    keys = span_hash(winners.ravel(), at, at + rows).reshape(texts, registers // rows)
    return mix(keys + np.arange(1, registers // rows + 1, dtype=np.uint64) * GOLD).view(np.int64)


def probability_jaccard(item_a: np.ndarray, weight_a: np.ndarray, item_b: np.ndarray, weight_b: np.ndarray) -> float:
    """Exact probability Jaccard of two weighted sets with sorted items.

    Sum over shared d of 1 / sum over e of max(a_e / a_d, b_e / b_d). With the
    items ordered by the ratio of their weights, the inner sums are prefix sums.
    """
    shared, at_a, at_b = np.intersect1d(item_a, item_b, assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    a, b = weight_a[at_a], weight_b[at_b]
    only_a, only_b = weight_a.sum() - a.sum(), weight_b.sum() - b.sum()
    ratio = a / b
    if ratio.min() == ratio.max():
        return float((1 / (np.maximum(a, ratio[0] * b).sum() / a + only_a / a + only_b / b)).sum())
    order = np.argsort(ratio)
    a, b, ratio = a[order], b[order], ratio[order]
    # For d, e with a larger ratio counts a_e / a_d, one with a smaller counts b_e / b_d.
    above = a.sum() - np.cumsum(a)
    below = np.cumsum(b)
    return float((1 / ((above + only_a) / a + (below + only_b) / b)).sum())
