"""Inversions are counted in blocks of ranks, and a row is moved twice, not once for every digit."""

import numpy as np
import pytest

from tidemark.operators import metrics as M


def brute(y, p):
    s = np.sign(np.subtract.outer(y, y)) * np.sign(np.subtract.outer(p, p))
    upper = np.triu_indices(len(y), 1)
    ties = [int((np.subtract.outer(v, v) == 0)[upper].sum()) for v in (y, p)]
    n0 = len(y) * (len(y) - 1) / 2
    return s[upper].sum() / np.sqrt((n0 - ties[0]) * (n0 - ties[1]))


@pytest.mark.parametrize("bits", [0, 2, 4])
def test_blocks_and_ties(spark, monkeypatch, bits):
    monkeypatch.setattr(M, "BLOCK_BITS", bits)
    r, cells = np.random.default_rng(bits), {}
    cells[1] = r.normal(size=200), r.normal(size=200)
    cells[2] = r.integers(0, 2, 150).astype(float), np.round(r.normal(size=150), 1)
    cells[3] = np.where(r.random(180) < 0.6, 1.0, r.normal(size=180)), np.where(r.random(180) < 0.5, 0.3, r.normal(size=180))
    cells[4] = np.arange(30.0), -np.arange(30.0)
    rows = spark.createDataFrame([(c, float(a), float(b)) for c, (y, p) in cells.items() for a, b in zip(y, p)], "cell int, y_true double, y_pred double")
    got = {x.cell: x.kendall_tau for x in M.kendall(rows, ["cell"]).collect()}
    assert got == pytest.approx({c: brute(y, p) for c, (y, p) in cells.items()}, abs=1e-12)


def test_inversions_by_bits():
    r = np.random.default_rng(3)
    order, code, weight = r.integers(0, 20, 120), r.integers(0, 15, 120), r.integers(1, 4, 120)
    want = sum(int(weight[i] * weight[j]) for i in range(120) for j in range(120) if order[i] < order[j] and code[i] > code[j])
    assert M.inversions(order, code, weight) == want


def test_rows_are_not_repeated_for_digits(spark):
    rows = spark.range(50).selectExpr("1 as cell", "sin(id) as y_true", "cos(id) as y_pred")
    assert "Generate" not in M.kendall(rows, ["cell"])._jdf.queryExecution().optimizedPlan().toString()
