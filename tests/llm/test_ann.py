"""Graph search against brute force."""

import numpy as np
import pandas as pd
import pytest

from tidemark.llm import ann, vamana
from tidemark.llm.tables import table


def dot(v, w):
    total = 0.0
    for a, b in zip(v, w):  # sum() would compensate rounding
        total += a * b
    return total


def brute(rows, k, every):
    rows = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in rows:
        if i % every == 0:
            near = sorted((-dot(v, w), j) for j, w in rows if j != i and len(w) == len(v))
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def answers(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


@pytest.mark.parametrize("recall", [ann.RECALL, 2.0])  # beams; scans of all nodes
def test_ties_nulls_and_lengths(spark, recall):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(40)] + [(200, None), (220, [0.0] * 4), (240, [1.0, None, 2.0, 3.0]), (260, [float("nan")] * 4), (280, [float("inf"), 1.0, 1.0, 1.0])]
    rows += [(None, [1.0] * 4), (300, [1.0, 2.0]), (320, [2.0, 1.0]), (340, [1.0] * 5), (0, rows[0][1]), (0, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1, "d") for i, v in rows], "vec_id long, embedding array<double>, rank int, dim string")
    want = {q: near for q, near in brute(rows, 20, 20).items() if near}
    assert answers(ann.search_table(df, recall=recall)) == want
    assert ann.search_table(df.limit(0), recall=recall).count() == 0


def test_recall_over_the_table(spark):
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = df.toPandas()
    ids, v = rows.vec_id.to_numpy(), np.array(rows.embedding.tolist(), float)
    got = answers(ann.search_table(df))
    hits = 0
    for q, near in got.items():
        s = v @ v[ids == q][0]
        s[ids == q] = -np.inf
        hits += len(set(ids[np.argsort(-s)[:20]]) & {j for j, _ in near})
    assert len(got) == (ids % 20 == 0).sum()
    assert hits / (20 * len(got)) >= 0.95


def test_pruned_edges_are_diverse():
    points = np.array([[0, 0], [1, 0], [1.1, 0], [0, 2], [5, 5]], np.float32)
    kept = vamana.prune(points, np.array([0]), np.array([[1, 2, 3, 4, 0, -1, 1]]), 4, 1.2)[0]
    assert kept.tolist() == [1, 3, -1, -1]


def test_one_vector_far_larger_than_the_rest(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1500)]
    rows[7] = (7, [1e9 * x for x in rows[7][1]])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, 20, 100)
    got = answers(ann.search_table(df, every=100))
    hits = sum(len({j for j, _ in want[q]} & {j for j, _ in got[q]}) for q in want)
    assert set(got) == set(want) and hits / (20 * len(want)) >= 0.95


def test_close_points_far_from_zero_are_pruned_alike():
    points = np.array([[0, 0], [1, 0], [1.1, 0], [0, 2], [5, 5]])
    far = (points * 2.0**-12 + 1.0).astype(np.float32)
    kept = vamana.prune(far, np.array([0]), np.array([[1, 2, 3, 4, 0, -1, 1]]), 4, 1.2)[0]
    assert kept.tolist() == [1, 3, -1, -1]


def test_recall_of_vectors_without_structure(spark):
    v = np.random.default_rng(7).normal(size=(50_000, 64))
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(v)), "embedding": list(v)}))
    got = answers(ann.search_table(df, every=100))
    s = v[::100] @ v.T
    s[np.arange(500), np.arange(0, 50_000, 100)] = -np.inf
    best = np.argsort(-s, axis=1)[:, :20]
    hits = sum(len(set(best[q // 100]) & {j for j, _ in near}) for q, near in got.items())
    assert len(got) == 500 and hits / (20 * len(got)) >= 0.95


def test_beams_answer_where_they_find_enough():
    rng = np.random.default_rng(8)
    near = rng.normal(size=(60, 32))[rng.integers(0, 60, 3000)] * 2 + rng.normal(size=(3000, 32)) * 0.3
    for v, beams in ((near, True), (rng.normal(size=(3000, 32)), False)):
        g = vamana.build(v)
        unit = v[::30] / np.abs(v[::30]).max(axis=1, keepdims=True)
        asked = np.concatenate([unit / np.linalg.norm(unit, axis=1, keepdims=True), np.zeros((len(unit), 1))], axis=1).astype(np.float32)
        for recall in (0.95, 2.0):
            beam = ann._beam(g, v, unit, asked, 20, 48, 96, recall)
            assert (beam is not None) == (beams and recall < 1)


def test_scans_keep_every_tie_of_the_last_place():
    rng = np.random.default_rng(9)
    v = np.array([[0.1, 0.7], [0.7, 0.1], [0.4, 0.4], [0.8, 0.0], [-1.0, 3.0]] + [[-1.0, -1.0]] * 20)
    got = [set(nodes.tolist()) for nodes in ann._scan(v, np.array([[1.0, 1.0], [1.0, 0.0]]), 3)]
    assert got == [{0, 1, 2, 3, 4}, {1, 2, 3}]
    w = rng.normal(size=(9000, 5)) * 1e300
    q = rng.normal(size=(70, 5))
    for nodes, ask in zip(ann._scan(w, q, 21), q):
        assert set(nodes.tolist()) == set(np.argsort(-(w / 1e300) @ ask)[:21].tolist())
