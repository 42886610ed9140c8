"""Metric queries over ``preds`` and ``cpreds``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import views
from tidemark.catalog.registry import query, r, rounded
from tidemark.operators import metrics as M

BY = views.CELL
N_CELLS = 6  # three models and two seeds in `preds`
KEYS = "model, seed, draw, n, k"
ERR = "(y_true - y_pred)"
COV = "covar_pop(y_true, y_pred)"
VARIES = "min(y_true) <> max(y_true) AND min(y_pred) <> max(y_pred)"
PEARSON = f"CASE WHEN {VARIES} THEN {COV} / sqrt(var_pop(y_true) * var_pop(y_pred)) END"
MSE = f"avg({ERR} * {ERR})"
NULL_MSE = "avg((y_true - train_mean) * (y_true - train_mean))"


def grouped(columns: dict[str, str], digits: int = 6) -> str:
    cols = ", ".join(f"{r(e, digits)} AS {n}" for n, e in columns.items())
    return f"WITH {views.PREDS_SQL} SELECT {KEYS}, {cols} FROM preds GROUP BY {KEYS}"


def pinball(a: float) -> str:
    return f"avg(greatest({a} * {ERR}, ({a} - 1) * {ERR}))"


SIMPLE = {
    "metric_r2": {"r2_test": f"1 - {MSE} / nullif({NULL_MSE}, 0)"},
    "metric_skill": {"skill_score_pct": f"100 * (1 - {MSE} / nullif({NULL_MSE}, 0))"},
    "metric_rmse": {"rmse": f"sqrt({MSE})"},
    "metric_mae": {"mae": f"avg(abs({ERR}))"},
    "metric_max_error": {"max_error": f"max(abs({ERR}))"},
    "metric_nrmse": {"nrmse": f"sqrt({MSE}) / nullif(max(y_true) - min(y_true), 0)"},
    "metric_pearson": {"pearson_r": PEARSON},
    "metric_ccc": {"ccc": f"2 * {COV} / nullif(var_pop(y_true) + var_pop(y_pred) + pow(avg(y_true) - avg(y_pred), 2), 0)"},
    "metric_explained_variance": {"explained_variance": f"1 - var_pop({ERR}) / var_pop(y_true)"},
    "metric_mean_bias": {"mean_bias": f"avg(y_pred - y_true)"},
    "metric_pinball": {n: pinball(a) for n, a in M.PINBALL_LEVELS.items()},
    "metric_rsr": {"rsr": f"sqrt({MSE}) / nullif(stddev_pop(y_true), 0)"},
    "metric_cv_rmse": {"cv_rmse": f"sqrt({MSE}) / nullif(avg(y_true), 0)"},
    "metric_mase": {"mase": f"avg(abs({ERR})) / nullif(avg(abs(y_true - train_mean)), 0)"},
    "metric_pearson_r2": {"pearson_r2": f"pow({PEARSON}, 2)"},
    "metric_null_mse": {"null_mse": NULL_MSE},
}
# Squared money amounts carry about 1e11; fewer decimals keep the check meaningful.
DIGITS = {"metric_null_mse": 1, "metric_rmse": 4, "metric_mae": 4, "metric_max_error": 4,
          "metric_mean_bias": 4, "metric_pinball": 4}


def _register(name: str, columns: dict[str, str]) -> None:
    digits = DIGITS.get(name, 6)

    @query(name, grouped(columns, digits))
    def run(spark, d):
        return rounded(M.simple_regression(views.preds(spark, d), BY, list(columns)), digits)


for _name, _columns in SIMPLE.items():
    _register(_name, _columns)


@query("metric_medae", grouped({"medae": f"quantile_cont(abs({ERR}), 0.5)"}, 4))
def metric_medae(spark, d):
    return rounded(M.medae(views.preds(spark, d), BY, N_CELLS), 4)


@query("metric_median_bias", grouped({"median_bias": "quantile_cont(y_pred - y_true, 0.5)"}, 4))
def metric_median_bias(spark, d):
    return rounded(M.median_bias(views.preds(spark, d), BY, N_CELLS), 4)


QUANTILES = f"""q AS (SELECT {KEYS}, quantile_cont(y_true, 0.5) AS ymed,
  quantile_cont(y_true, 0.9) AS y90, quantile_cont(y_true, 0.1) AS y10,
  quantile_cont(y_pred, 0.9) AS p90, quantile_cont(y_pred, 0.1) AS p10 FROM preds GROUP BY {KEYS})"""


@query("metric_d2", f"""WITH {views.PREDS_SQL}, {QUANTILES}
SELECT {KEYS}, {r('1 - sum(abs(y_true - y_pred)) / nullif(sum(abs(y_true - ymed)), 0)')} AS d2_absolute_error
FROM preds JOIN q USING ({KEYS}) GROUP BY {KEYS}""")
def metric_d2(spark, d):
    return rounded(M.d2_absolute_error(views.preds(spark, d), BY, N_CELLS))


@query("metric_decile_hits", f"""WITH {views.PREDS_SQL}, {QUANTILES}
SELECT {KEYS},
 {r('count_if(y_true >= y90 AND y_pred >= p90) / count_if(y_true >= y90)')} AS top_decile_hit_rate,
 {r('count_if(y_true <= y10 AND y_pred <= p10) / count_if(y_true <= y10)')} AS bottom_decile_hit_rate
FROM preds JOIN q USING ({KEYS}) GROUP BY {KEYS}""")
def metric_decile_hits(spark, d):
    return rounded(M.decile_hits(views.preds(spark, d), BY, N_CELLS))


SPEARMAN_SQL = f"""ranked AS (SELECT {KEYS},
  rank() OVER (PARTITION BY {KEYS} ORDER BY y_true) + (count(*) OVER (PARTITION BY {KEYS}, y_true) - 1) / 2.0 AS ry,
  rank() OVER (PARTITION BY {KEYS} ORDER BY y_pred) + (count(*) OVER (PARTITION BY {KEYS}, y_pred) - 1) / 2.0 AS rp
 FROM preds)"""


@query("metric_spearman", f"""WITH {views.PREDS_SQL}, {SPEARMAN_SQL}
SELECT {KEYS}, {r('corr(CAST(ry AS DOUBLE), CAST(rp AS DOUBLE))')} AS spearman_rho FROM ranked GROUP BY {KEYS}""")
def metric_spearman(spark, d):
    return rounded(M.spearman(views.preds(spark, d), BY))


KENDALL_SQL = f"""dense AS (SELECT {KEYS},
  dense_rank() OVER (PARTITION BY {KEYS} ORDER BY y_true) AS ry,
  dense_rank() OVER (PARTITION BY {KEYS} ORDER BY y_pred) AS rp FROM preds),
 bits AS (SELECT *, (rp >> b) & 1 AS bit, rp >> (b + 1) AS high FROM dense, (SELECT unnest(range(0, 24)) AS b)),
 inv AS (SELECT {KEYS}, bit, sum(bit) OVER (PARTITION BY {KEYS}, b, high ORDER BY ry, rp
   ROWS UNBOUNDED PRECEDING) AS ones FROM bits),
 disc AS (SELECT {KEYS}, sum(CASE WHEN bit = 0 THEN ones ELSE 0 END)::DOUBLE AS d FROM inv GROUP BY {KEYS}),
 n0 AS (SELECT {KEYS}, count(*) * (count(*) - 1) / 2.0::DOUBLE AS n0 FROM preds GROUP BY {KEYS}),
 t1 AS (SELECT {KEYS}, sum(c * (c - 1) / 2.0::DOUBLE) AS t1 FROM (SELECT {KEYS}, count(*) AS c FROM preds GROUP BY {KEYS}, y_true) GROUP BY {KEYS}),
 t2 AS (SELECT {KEYS}, sum(c * (c - 1) / 2.0::DOUBLE) AS t2 FROM (SELECT {KEYS}, count(*) AS c FROM preds GROUP BY {KEYS}, y_pred) GROUP BY {KEYS}),
 t3 AS (SELECT {KEYS}, sum(c * (c - 1) / 2.0::DOUBLE) AS t3 FROM (SELECT {KEYS}, count(*) AS c FROM preds GROUP BY {KEYS}, y_true, y_pred) GROUP BY {KEYS}),
 tau AS (SELECT {KEYS}, (n0 - t1 - t2 + t3 - 2 * d) / sqrt((n0 - t1) * (n0 - t2)) AS kendall_tau
   FROM disc JOIN n0 USING ({KEYS}) JOIN t1 USING ({KEYS}) JOIN t2 USING ({KEYS}) JOIN t3 USING ({KEYS}))"""


@query("metric_kendall", f"WITH {views.PREDS_SQL}, {KENDALL_SQL} SELECT {KEYS}, {r('kendall_tau')} AS kendall_tau FROM tau")
def metric_kendall(spark, d):
    return rounded(M.kendall(views.preds(spark, d), BY))


DISTANCE_SQL = f"""pooled AS (SELECT {KEYS}, v, sum(a) AS cy, sum(1 - a) AS cp FROM (
  SELECT {KEYS}, y_true AS v, 1 AS a FROM preds UNION ALL SELECT {KEYS}, y_pred, 0 FROM preds) GROUP BY {KEYS}, v),
 ecdf AS (SELECT {KEYS}, v,
   abs(sum(cy) OVER w / sum(cy) OVER c - sum(cp) OVER w / sum(cp) OVER c) AS gap,
   lead(v) OVER (PARTITION BY {KEYS} ORDER BY v) - v AS dv FROM pooled
   WINDOW w AS (PARTITION BY {KEYS} ORDER BY v ROWS UNBOUNDED PRECEDING), c AS (PARTITION BY {KEYS}))"""


@query("metric_ks", f"WITH {views.PREDS_SQL}, {DISTANCE_SQL} SELECT {KEYS}, {r('max(gap)')} AS ks_statistic FROM ecdf GROUP BY {KEYS}")
def metric_ks(spark, d):
    return rounded(M.distribution_distance(views.preds(spark, d), BY).select(*BY, "ks_statistic"))


@query("metric_wasserstein", f"WITH {views.PREDS_SQL}, {DISTANCE_SQL} SELECT {KEYS}, {r('sum(gap * dv)', 4)} AS wasserstein_distance FROM ecdf GROUP BY {KEYS}")
def metric_wasserstein(spark, d):
    df = M.distribution_distance(views.preds(spark, d), BY)
    return rounded(df.select(*BY, "wasserstein_distance"), 4)


def _all_regression_sql() -> str:
    plain = {n: e for cols in SIMPLE.values() for n, e in cols.items() if n in M.REGRESSION_METRICS}
    plain["medae"] = f"quantile_cont(abs({ERR}), 0.5)"
    plain["median_bias"] = "quantile_cont(y_pred - y_true, 0.5)"
    base = ", ".join(f"{e} AS {n}" for n, e in plain.items())
    out = ", ".join(f"{r(n, 4)} AS {n}" for n in M.REGRESSION_METRICS)
    return f"""WITH {views.PREDS_SQL}, {QUANTILES}, {SPEARMAN_SQL}, {KENDALL_SQL}, {DISTANCE_SQL},
 base AS (SELECT {KEYS}, {base} FROM preds GROUP BY {KEYS}),
 spear AS (SELECT {KEYS}, corr(CAST(ry AS DOUBLE), CAST(rp AS DOUBLE)) AS spearman_rho FROM ranked GROUP BY {KEYS}),
 dist AS (SELECT {KEYS}, max(gap) AS ks_statistic, sum(gap * dv) AS wasserstein_distance FROM ecdf GROUP BY {KEYS}),
 hits AS (SELECT {KEYS}, 1 - sum(abs(y_true - y_pred)) / nullif(sum(abs(y_true - ymed)), 0) AS d2_absolute_error,
   count_if(y_true >= y90 AND y_pred >= p90) / count_if(y_true >= y90) AS top_decile_hit_rate,
   count_if(y_true <= y10 AND y_pred <= p10) / count_if(y_true <= y10) AS bottom_decile_hit_rate
   FROM preds JOIN q USING ({KEYS}) GROUP BY {KEYS})
SELECT {KEYS}, {out} FROM base JOIN spear USING ({KEYS}) JOIN tau USING ({KEYS})
 JOIN dist USING ({KEYS}) JOIN hits USING ({KEYS})"""


@query("regression_metrics", _all_regression_sql())
def regression_metrics(spark, d):
    return rounded(M.regression_metrics(views.preds(spark, d), BY, N_CELLS), 4)


S = "least(greatest(score, 1e-15), 1 - 1e-15)"
LL = f"(y_true * ln({S}) + (1 - y_true) * ln(1 - {S}))"
BOTH = "min(y_true) = 0 AND max(y_true) = 1"
CLF = {
    "metric_brier": {"brier": "avg((y_true - score) * (y_true - score))"},
    "metric_log_loss": {"log_loss": f"CASE WHEN {BOTH} THEN -avg({LL}) END"},
    "metric_balanced_accuracy": {"balanced_accuracy": f"CASE WHEN {BOTH} THEN (count_if(score >= 0.5 AND y_true = 1) / count_if(y_true = 1) + count_if(score < 0.5 AND y_true = 0) / count_if(y_true = 0)) / 2 END"},
    "metric_f1": {"f1": "coalesce(2.0::DOUBLE * count_if(score >= 0.5 AND y_true = 1) / nullif(2 * count_if(score >= 0.5 AND y_true = 1) + count_if((score >= 0.5) <> (y_true = 1)), 0), 0.0)"},
    "metric_accuracy": {"accuracy": "avg(CASE WHEN (score >= 0.5) = (y_true = 1) THEN 1.0 ELSE 0.0 END)"},
    "metric_mcfadden": {"mcfadden_pseudo_r2": f"CASE WHEN {BOTH} THEN 1 - sum({LL}) / sum(y_true * ln(train_pos_rate) + (1 - y_true) * ln(1 - train_pos_rate)) END"},
}


def _register_clf(name: str, columns: dict[str, str]) -> None:
    cols = ", ".join(f"{r(e)} AS {n}" for n, e in columns.items())

    @query(name, f"WITH {views.CPREDS_SQL} SELECT {KEYS}, {cols} FROM cpreds GROUP BY {KEYS}")
    def run(spark, d):
        return rounded(M.simple_classification(views.cpreds(spark, d), BY, list(columns)))


for _name, _columns in CLF.items():
    _register_clf(_name, _columns)

AUC_SQL = f"""ranked AS (SELECT {KEYS}, y_true, score,
   rank() OVER (PARTITION BY {KEYS} ORDER BY score) + (count(*) OVER (PARTITION BY {KEYS}, score) - 1) / 2.0 AS rk FROM cpreds),
 auc AS (SELECT {KEYS}, (sum(CASE WHEN y_true = 1 THEN rk ELSE 0 END) - count_if(y_true = 1) * (count_if(y_true = 1) + 1) / 2.0)
   / (count_if(y_true = 1)::DOUBLE * count_if(y_true = 0)) AS roc_auc FROM ranked GROUP BY {KEYS})"""
AP_SQL = f"""steps AS (SELECT {KEYS}, score, sum(y_true) AS p, count(*) AS c FROM cpreds GROUP BY {KEYS}, score),
 curve AS (SELECT {KEYS}, p / sum(p) OVER (PARTITION BY {KEYS}) AS dr,
   sum(p) OVER w / sum(c) OVER w AS prec FROM steps WINDOW w AS (PARTITION BY {KEYS} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
 ap AS (SELECT {KEYS}, sum(dr * prec) AS pr_auc FROM curve GROUP BY {KEYS})"""


@query("metric_roc_auc", f"WITH {views.CPREDS_SQL}, {AUC_SQL} SELECT {KEYS}, {r('roc_auc')} AS roc_auc FROM auc")
def metric_roc_auc(spark, d):
    return rounded(M.ranking_quality(views.cpreds(spark, d), BY).select(*BY, "roc_auc"))


@query("metric_pr_auc", f"WITH {views.CPREDS_SQL}, {AP_SQL} SELECT {KEYS}, {r('pr_auc')} AS pr_auc FROM ap")
def metric_pr_auc(spark, d):
    return rounded(M.ranking_quality(views.cpreds(spark, d), BY).select(*BY, "pr_auc"))


def _all_classification_sql(source: str = "cpreds") -> str:
    base = ", ".join(f"{e} AS {n}" for cols in CLF.values() for n, e in cols.items())
    out = ", ".join(f"{r(n)} AS {n}" for n in M.CLASSIFICATION_METRICS)
    return f"""WITH {views.CPREDS_SQL}, {AUC_SQL}, {AP_SQL},
 base AS (SELECT {KEYS}, {base} FROM cpreds GROUP BY {KEYS})
SELECT {KEYS}, {out} FROM base JOIN auc USING ({KEYS}) JOIN ap USING ({KEYS})"""


@query("classification_metrics", _all_classification_sql())
def classification_metrics(spark, d):
    return rounded(M.classification_metrics(views.cpreds(spark, d), BY))


# Seed 22 gets one infinite score, so its whole row must be NULL.
@query("metric_nonfinite_guard", f"""WITH {views.CPREDS_SQL},
 broken AS (SELECT {KEYS}, y_true, CASE WHEN seed = 22 AND row_id = (SELECT min(row_id) FROM cpreds) THEN NULL ELSE score END AS score FROM cpreds)
SELECT {KEYS}, CASE WHEN bool_and(score IS NOT NULL) THEN {r('avg((y_true - score) * (y_true - score))')} END AS brier,
 CASE WHEN bool_and(score IS NOT NULL) THEN {r("avg(CASE WHEN (score >= 0.5) = (y_true = 1) THEN 1.0 ELSE 0.0 END)")} END AS accuracy
FROM broken GROUP BY {KEYS}""")
def metric_nonfinite_guard(spark, d):
    df = views.cpreds(spark, d)
    first = df.agg(F.min("row_id").alias("_first"))
    broken = (
        df.join(F.broadcast(first), df.row_id == F.col("_first"), "left")
        .withColumn("score", F.when(F.col("_first").isNotNull() & (F.col("seed") == 22),
                                    F.lit(float("inf"))).otherwise(F.col("score")))
    )
    return rounded(M.classification_metrics(broken, BY).select(*BY, "brier", "accuracy"))


BROKEN = "row_id % 1000 = 1 AND ((model = 'a' AND seed = 11) OR (model = 'b' AND seed = 22))"


@query("metric_failed_cells", f"""WITH {views.PREDS_SQL}, bad AS (SELECT DISTINCT {KEYS}, true AS failed FROM preds WHERE {BROKEN})
SELECT {KEYS}, CASE WHEN failed IS NULL THEN {r(f"sqrt({MSE})", 4)} END AS rmse, CASE WHEN failed IS NULL THEN {r(f"quantile_cont(abs({ERR}), 0.5)", 4)} END AS medae
FROM preds LEFT JOIN bad USING ({KEYS}) GROUP BY {KEYS}, failed""")
def metric_failed_cells(spark, d):
    """An infinite and a NaN prediction: their cells have no metrics, the others theirs."""
    bad = F.expr(BROKEN)
    value = F.when(bad & (F.col("seed") == 11), float("inf")).when(bad, float("nan")).otherwise(F.col("y_pred"))
    rows = M.regression_metrics(views.preds(spark, d).withColumn("y_pred", value), BY, N_CELLS)
    return rounded(rows.select(*BY, "rmse", "medae"), 4)
