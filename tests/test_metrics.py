import itertools
import math

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from tidemark.operators import metrics as M


def _frame(spark, rows):
    return spark.createDataFrame(pd.DataFrame(rows, columns=["c", "y_true", "y_pred", "train_mean"]))


@pytest.fixture(scope="module")
def tied(spark):
    rng = np.random.default_rng(3)
    rows = [(c, float(rng.integers(0, hi)), float(rng.integers(0, hi)) / 2, 2.0)
            for c, n, hi in (("few", 40, 5), ("many", 120, 60)) for _ in range(n)]
    rows += [("flat", 3.0, float(i), 1.0) for i in range(10)]
    return rows, _frame(spark, rows)


def brute_tau(y, p):
    conc = disc = ty = tp = 0
    for i, j in itertools.combinations(range(len(y)), 2):
        a, b = np.sign(y[i] - y[j]), np.sign(p[i] - p[j])
        conc += a * b > 0
        disc += a * b < 0
        ty += a == 0
        tp += b == 0
    n0 = len(y) * (len(y) - 1) / 2
    bottom = math.sqrt((n0 - ty) * (n0 - tp))
    return (conc - disc) / bottom if bottom else None


def test_all_regression_metrics(tied):
    rows, df = tied
    got = {r["c"]: r for r in M.regression_metrics(df, ["c"]).collect()}
    assert set(got["few"].asDict()) == {"c", *M.REGRESSION_METRICS}
    for c in ("few", "many"):
        y = np.array([r[1] for r in rows if r[0] == c])
        p = np.array([r[2] for r in rows if r[0] == c])
        ry, rp = pd.Series(y).rank().to_numpy(), pd.Series(p).rank().to_numpy()
        vals = np.sort(np.unique(np.concatenate([y, p])))
        gap = np.array([abs((y <= v).mean() - (p <= v).mean()) for v in vals])
        e = y - p
        want = {
            "kendall_tau": brute_tau(y, p), "spearman_rho": np.corrcoef(ry, rp)[0, 1],
            "ks_statistic": gap.max(), "wasserstein_distance": (gap[:-1] * np.diff(vals)).sum(),
            "medae": np.median(abs(e)), "median_bias": np.median(-e), "rmse": math.sqrt((e**2).mean()),
            "r2_test": 1 - (e**2).mean() / ((y - 2.0) ** 2).mean(),
            "d2_absolute_error": 1 - abs(e).sum() / abs(y - np.median(y)).sum(),
            "explained_variance": 1 - e.var() / y.var(),
            "top_decile_hit_rate": ((y >= np.quantile(y, 0.9)) & (p >= np.quantile(p, 0.9))).sum() / (y >= np.quantile(y, 0.9)).sum(),
            "pinball_q75": np.maximum(0.75 * e, -0.25 * e).mean(),
            "ccc": 2 * np.cov(y, p, bias=True)[0, 1] / (y.var() + p.var() + (y.mean() - p.mean()) ** 2),
        }
        for name, value in want.items():
            assert got[c][name] == pytest.approx(value, rel=1e-9), (c, name)


def test_constant_outcome_is_null(tied):
    row = {r["c"]: r for r in M.regression_metrics(tied[1], ["c"]).collect()}["flat"]
    for name in ("pearson_r", "spearman_rho", "kendall_tau", "nrmse", "rsr"):
        assert row[name] is None
    assert row["explained_variance"] == 0.0


def test_classification(spark):
    rng = np.random.default_rng(5)
    y, s = rng.integers(0, 2, 60), np.round(rng.random(60), 1)
    rows = [("a", int(a), float(b), 0.4) for a, b in zip(y, s)] + [("one", 1, 0.7, 0.4)] * 3
    rows += [("inf", 0, 0.1, 0.4), ("inf", 1, float("inf"), 0.4)]
    df = spark.createDataFrame(rows, "c string, y_true int, score double, train_pos_rate double")
    got = {r["c"]: r for r in M.classification_metrics(df, ["c"]).collect()}
    wins = [(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]
    assert got["a"]["roc_auc"] == pytest.approx(np.mean(wins))
    ap, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        rec, prec = ((s >= t) & (y == 1)).sum() / y.sum(), y[s >= t].mean()
        ap, last = ap + (rec - last) * prec, rec
    assert got["a"]["pr_auc"] == pytest.approx(ap)
    assert got["one"]["roc_auc"] is None and got["one"]["log_loss"] is None and got["one"]["accuracy"] == 1.0
    assert all(got["inf"][m] is None for m in M.CLASSIFICATION_METRICS)


def test_exploded_rows_are_never_broadcast(spark, tmp_path):
    """A small file whose rows are exploded looks small to the planner; only one row per cell may be sent."""
    spark.range(2000).select((F.col("id") * 1.5).alias("y_true")).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows")).withColumn("cell", F.explode(F.array(F.lit(1), F.lit(2))))
    rows = rows.withColumn("y_pred", F.col("y_true") % 97 + F.col("cell")).withColumn("train_mean", F.lit(9.0))
    for run in (lambda: M.d2_absolute_error(rows, ["cell"], 2), lambda: M.decile_hits(rows, ["cell"], 2), lambda: M.medae(rows, ["cell"], 2)):
        plan = run()._jdf.queryExecution().executedPlan().toString()
        sides = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
        assert sides and all("BuildRight" in line for line in sides)
    for run in (lambda: M.spearman(rows, ["cell"]), lambda: M.kendall(rows, ["cell"])):
        plan = run()._jdf.queryExecution().executedPlan().toString()
        assert not any("BroadcastHashJoin" in line and ("y_pred" in line or "y_true" in line) and "LeftOuter" not in line for line in plan.splitlines())
