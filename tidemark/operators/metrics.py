"""Held-out prediction metrics, grouped by cell.

Variances are population variances and every degenerate metric is NULL.
Metrics that are plain aggregates share one hash aggregation; the others use
the bucketed primitives, so a cell may be arbitrarily large.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordered import exact_quantiles, ordered_running
from tidemark.operators.impute import join_cells

# Output names of the two metric rows (fixed values).
REGRESSION_METRICS = [
    "r2_test", "skill_score_pct", "rmse", "mae", "medae", "max_error", "nrmse",
    "spearman_rho", "pearson_r", "kendall_tau", "ccc", "explained_variance",
    "mean_bias", "median_bias", "pinball_q10", "pinball_q90", "d2_absolute_error",
    "pinball_q05", "pinball_q25", "pinball_q50", "pinball_q75", "pinball_q95",
    "ks_statistic", "wasserstein_distance", "top_decile_hit_rate",
    "bottom_decile_hit_rate", "rsr", "cv_rmse", "mase", "pearson_r2",
]
CLASSIFICATION_METRICS = [
    "roc_auc", "pr_auc", "brier", "log_loss", "balanced_accuracy", "f1",
    "accuracy", "mcfadden_pseudo_r2",
]
PINBALL_LEVELS = {
    "pinball_q05": 0.05, "pinball_q10": 0.10, "pinball_q25": 0.25, "pinball_q50": 0.50,
    "pinball_q75": 0.75, "pinball_q90": 0.90, "pinball_q95": 0.95,
}
PROBABILITY_FLOOR = 1e-15


def _y() -> Column:
    return F.col("y_true")


def _p() -> Column:
    return F.col("y_pred")


def _tm() -> Column:
    return F.col("train_mean")


def _s() -> Column:
    return F.col("score")


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom != 0, top / bottom)


def regression_aggregates() -> dict[str, Column]:
    """Metrics that are expressions over ordinary aggregates."""
    err = _y() - _p()
    mse, mae = F.avg(err * err), F.avg(F.abs(err))
    null_mse = F.avg((_y() - _tm()) * (_y() - _tm()))
    var_y, var_p, var_e = F.var_pop(_y()), F.var_pop(_p()), F.var_pop(err)
    cov = F.covar_pop(_y(), _p())
    varies = (F.min(_y()) != F.max(_y())) & (F.min(_p()) != F.max(_p()))
    pearson = F.when(varies, cov / F.sqrt(var_y * var_p))
    r2 = F.when(null_mse != 0, 1 - mse / null_mse)
    spread = var_y + var_p + (F.avg(_y()) - F.avg(_p())) * (F.avg(_y()) - F.avg(_p()))
    out = {
        "r2_test": r2,
        "skill_score_pct": r2 * 100,
        "rmse": F.sqrt(mse),
        "mae": mae,
        "max_error": F.max(F.abs(err)),
        "nrmse": _ratio(F.sqrt(mse), F.max(_y()) - F.min(_y())),
        "pearson_r": pearson,
        "ccc": _ratio(2 * cov, spread),
        "explained_variance": F.when(F.min(_y()) != F.max(_y()), 1 - var_e / var_y)
        .when(F.min(err) == F.max(err), 1.0).otherwise(0.0),
        "mean_bias": F.avg(-err),
        "rsr": F.when(F.min(_y()) != F.max(_y()), F.sqrt(mse) / F.stddev_pop(_y())),
        "cv_rmse": _ratio(F.sqrt(mse), F.avg(_y())),
        "mase": _ratio(mae, F.avg(F.abs(_y() - _tm()))),
        "pearson_r2": pearson * pearson,
        "null_mse": null_mse,
    }
    for name, a in PINBALL_LEVELS.items():
        out[name] = F.avg(F.greatest(err * a, err * (a - 1)))
    return out


def simple_regression(preds: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    exprs = regression_aggregates()
    return preds.groupBy(*by).agg(*[exprs[n].alias(n) for n in names])


def _series() -> dict[str, Column]:
    """Series whose exact quantiles the metrics need."""
    return {"abs_err": F.abs(_y() - _p()), "bias": _p() - _y(), "y": _y(), "p": _p()}


def prediction_quantiles(preds: DataFrame, by: Sequence[str], series: Sequence[str],
                         probs: dict[str, float], n_cells: int | None = None) -> DataFrame:
    """Exact quantiles of several error series at once: columns ``<series>_<prob>``."""
    values = _series()
    stacked = preds.select(
        *by,
        F.explode(F.array(*[F.struct(F.lit(s).alias("s"), values[s].alias("v"))
                            for s in series])).alias("e"),
    ).select(*by, F.col("e.s").alias("_s"), F.col("e.v").alias("_x"))
    long = exact_quantiles(stacked, [*by, "_s"], "_x", probs, n_groups=None if n_cells is None else n_cells * len(series))
    return long.groupBy(*by).agg(
        *[F.max(F.when(F.col("_s") == s, F.col(p))).alias(f"{s}_{p}")
          for s in series for p in probs]
    )


def medae(preds: DataFrame, by: Sequence[str], n_cells: int | None = None) -> DataFrame:
    q = prediction_quantiles(preds, by, ["abs_err"], {"q50": 0.5}, n_cells)
    return q.select(*by, F.col("abs_err_q50").alias("medae"))


def median_bias(preds: DataFrame, by: Sequence[str], n_cells: int | None = None) -> DataFrame:
    q = prediction_quantiles(preds, by, ["bias"], {"q50": 0.5}, n_cells)
    return q.select(*by, F.col("bias_q50").alias("median_bias"))


def _d2_column(med: Column) -> Column:
    top, bottom = F.sum(F.abs(_y() - _p())), F.sum(F.abs(_y() - med))
    score = F.when(bottom != 0, 1 - top / bottom).when(top == 0, 1.0).otherwise(0.0)
    return F.when(F.count(F.lit(1)) >= 2, score)


def _hit_columns() -> list[Column]:
    def share(y_in: Column, p_in: Column) -> Column:
        return F.count_if(y_in & p_in) / F.count_if(y_in)

    return [
        share(_y() >= F.col("y_q90"), _p() >= F.col("p_q90")).alias("top_decile_hit_rate"),
        share(_y() <= F.col("y_q10"), _p() <= F.col("p_q10")).alias("bottom_decile_hit_rate"),
    ]


def d2_absolute_error(preds: DataFrame, by: Sequence[str], n_cells: int | None = None) -> DataFrame:
    q = prediction_quantiles(preds, by, ["y"], {"q50": 0.5}, n_cells)
    return join_cells(preds, q, by, n_cells).groupBy(*by).agg(
        _d2_column(F.col("y_q50")).alias("d2_absolute_error"))


def decile_hits(preds: DataFrame, by: Sequence[str], n_cells: int | None = None) -> DataFrame:
    q = prediction_quantiles(preds, by, ["y", "p"], {"q10": 0.1, "q90": 0.9}, n_cells)
    return join_cells(preds, q, by, n_cells).groupBy(*by).agg(*_hit_columns())


def _pooled(preds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Observed and predicted values on one axis, with counts of either side."""
    stacked = preds.select(
        *by,
        F.explode(F.array(F.struct(_y().cast("double").alias("v"), F.lit(1).alias("y")),
                          F.struct(_p().cast("double").alias("v"), F.lit(0).alias("y")))).alias("e"),
    ).select(*by, F.col("e.v").alias("v"), F.col("e.y").alias("is_y"))
    return ordered_running(
        stacked, by, "v", {"cy": F.col("is_y"), "cp": 1 - F.col("is_y")}, with_next=True
    )


def distribution_distance(preds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Kolmogorov-Smirnov and Wasserstein distance of observed and predicted values."""
    pooled = _pooled(preds, by)
    gap = F.abs((F.col("cy_before") + F.col("cy")) / F.col("cy_total")
                - (F.col("cp_before") + F.col("cp")) / F.col("cp_total"))
    return pooled.groupBy(*by).agg(
        F.max(gap).alias("ks_statistic"),
        F.coalesce(F.sum(gap * (F.col("next_value") - F.col("v"))), F.lit(0.0))
        .alias("wasserstein_distance"),
    )


def _rank_table(pairs: DataFrame, by: Sequence[str], value: str, prefix: str) -> DataFrame:
    """Average rank, rows before and tie count of each distinct value."""
    run = ordered_running(pairs, by, value, {"_c": F.col("_c")})
    return run.select(
        *by, value,
        (F.col("_c_before") + (F.col("_c") + 1) / 2).alias(f"{prefix}_rank"),
        F.col("_c").alias(f"{prefix}_ties"),
        F.col("_c_before").alias(f"{prefix}_before"),
        F.col("_c_total").alias("_n"),
    )


def _pairs(preds: DataFrame, by: Sequence[str]) -> DataFrame:
    return preds.groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("_c"))


def spearman(preds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Pearson correlation of average ranks, from counts of distinct pairs."""
    by = list(by)
    pairs = _pairs(preds, by)
    ry = _rank_table(pairs, by, "y_true", "y").drop("_n")
    rp = _rank_table(pairs, by, "y_pred", "p")
    a = F.col("y_rank") - (F.col("_n") + 1) / 2
    b = F.col("p_rank") - (F.col("_n") + 1) / 2
    c = F.col("_c")
    saa, sbb = F.sum(c * a * a), F.sum(c * b * b)
    return (
        pairs.join(ry.hint("merge"), [*by, "y_true"]).join(rp.hint("merge"), [*by, "y_pred"])  # as many rows on either side
        .groupBy(*by)
        .agg(F.when((saa > 0) & (sbb > 0), F.sum(c * a * b) / F.sqrt(saa * sbb))
             .alias("spearman_rho"))
    )


# Blocks of like many rows into which the ranks of a cell are cut for the inversion count, as a power of two.
BLOCK_BITS = 9


def inversions(order: np.ndarray, code: np.ndarray, weight: np.ndarray) -> int:
    """Weighted pairs whose ``order`` rises where ``code`` falls, bit by bit of the code: n log n."""
    code = np.unique(code, return_inverse=True)[1]
    at = np.lexsort((code, order))  # rows of the same order come by their code, so they count nothing
    code, weight, found = code[at], weight[at], 0
    for bit in reversed(range(int(code.max()).bit_length() if len(code) else 0)):
        by_prefix = np.argsort(code >> (bit + 1), kind="stable")
        code, weight = code[by_prefix], weight[by_prefix]
        one = (code >> bit) & 1 == 1
        before = np.cumsum(weight * one)
        prefix = code >> (bit + 1)
        starts = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
        base = np.repeat(np.concatenate([[0], before])[starts], np.diff(np.append(starts, len(code))))
        found += int((weight * (before - base))[~one].sum())
    return found


def kendall(preds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Kendall tau-b by counting inversions in blocks of ranks.

    Ranks of either value are cut into some hundred blocks. Pairs of rows that differ in
    both blocks are counted from the rows of each pair of blocks; pairs within a block by
    tasks that hold the rows of one block, once for either value. A value tied in more
    rows than a block has is a block by itself, in which nothing is inverted. So a row is
    moved twice, no pair is formed, and no task holds the rows of a cell.
    """
    by = list(by)
    pairs = _pairs(preds, by)
    ry = _rank_table(pairs, by, "y_true", "y").drop("_n")
    rp = _rank_table(pairs, by, "y_pred", "p")
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("_n").cast("double"))).cast("int") - BLOCK_BITS)

    def block(name: str) -> Column:
        own = F.expr(f"shiftright({name}_before, _bits)")
        return (own * 2 + (F.col(f"{name}_ties") >= F.expr("shiftleft(1L, _bits)")).cast("bigint")).cast("int")

    coded = pairs.join(ry.hint("merge"), [*by, "y_true"]).join(rp.hint("merge"), [*by, "y_pred"])  # as many rows on either side
    whole = [F.col(c).cast("bigint").alias(c) for c in ("y_before", "y_ties", "p_before", "p_ties", "_c")]
    coded = coded.select(*by, *whole, bits.alias("_bits"))
    coded = coded.select(*by, "_c", "y_before", "p_before", block("y").alias("_yb"), block("p").alias("_pb"))
    keys = ", ".join(f"{k} {coded.schema[k].dataType.simpleString()}" for k in by)

    def inside(order: str, code: str):
        def count(table: pa.Table) -> pa.Table:
            own = [table.column(c).to_numpy() for c in (order, code, "_c")]
            return table.select(by).slice(0, 1).append_column("_disc", pa.array([float(inversions(*own))]))
        return count

    def across(table: pa.Table) -> pa.Table:
        a, b, c = [table.column(x).to_numpy() for x in ("_yb", "_pb", "_c")]
        (_, a), (_, b) = [np.unique(x, return_inverse=True) for x in (a, b)]
        grid = np.zeros((int(a.max()) + 1, int(b.max()) + 1), np.int64)
        np.add.at(grid, (a, b), c)
        later = np.zeros_like(grid)  # rows of a larger observed and a smaller predicted block
        later[:-1, 1:] = np.cumsum(np.cumsum(grid[::-1], axis=0)[::-1], axis=1)[1:, :-1]
        return table.select(by).slice(0, 1).append_column("_disc", pa.array([float((grid.astype(float) * later).sum())]))

    schema = f"{keys}, _disc double"
    light_y, light_p = [coded.where(F.col(c) % 2 == 0) for c in ("_yb", "_pb")]
    parts = light_y.select(*by, "_yb", F.col("y_before").alias("_order"), F.col("p_before").alias("_code"), "_c").groupBy(*by, "_yb").applyInArrow(inside("_order", "_code"), schema)
    parts = parts.unionByName(light_p.select(*by, "_pb", F.col("_yb").alias("_order"), F.col("p_before").alias("_code"), "_c").groupBy(*by, "_pb").applyInArrow(inside("_order", "_code"), schema))
    # A cell has at most as many pairs of blocks as the square of their number, whatever its rows.
    parts = parts.unionByName(coded.groupBy(*by, "_yb", "_pb").agg(F.sum("_c").alias("_c")).groupBy(*by).applyInArrow(across, schema))
    inverted = parts.groupBy(*by).agg(F.sum("_disc").alias("_disc"))

    def tied(table: DataFrame, count: str, out: str) -> DataFrame:
        c = F.col(count).cast("double")
        return table.groupBy(*by).agg((F.sum(c * (c - 1)) / 2).alias(out))

    total = pairs.groupBy(*by).agg(F.sum("_c").cast("double").alias("_m"))
    joined = reduce(
        lambda l, rgt: l.join(rgt, by),
        [inverted, tied(ry, "y_ties", "_t1"), tied(rp, "p_ties", "_t2"),
         tied(pairs, "_c", "_t3"), total],
    )
    n0 = F.col("_m") * (F.col("_m") - 1) / 2
    conc = n0 - F.col("_t1") - F.col("_t2") + F.col("_t3") - F.col("_disc")
    scale = F.sqrt((n0 - F.col("_t1")) * (n0 - F.col("_t2")))
    return joined.select(
        *by, F.when(scale > 0, (conc - F.col("_disc")) / scale).alias("kendall_tau"))


def regression_metrics(preds: DataFrame, by: Sequence[str], n_cells: int | None = None) -> DataFrame:
    """All thirty regression metrics, one row per cell.

    A cell with a prediction that is NULL, NaN or infinite has no metrics. Such a
    prediction counts as 0 on the way, so that it can stop no other cell. ``n_cells``
    bounds the cells of the caller's design.
    """
    by = list(by)
    preds = preds.withColumn("_broken", ~finite(_p())).withColumn("y_pred", F.when(finite(_p()), _p()).otherwise(0.0))
    exprs = regression_aggregates()
    simple = [n for n in REGRESSION_METRICS if n in exprs]
    quantiles = prediction_quantiles(
        preds, by, ["abs_err", "bias", "y", "p"], {"q10": 0.1, "q50": 0.5, "q90": 0.9}, n_cells)
    base = join_cells(preds, quantiles, by, n_cells, width=12).groupBy(*by).agg(
        *[exprs[n].alias(n) for n in simple],
        F.max("abs_err_q50").alias("medae"),
        F.max("bias_q50").alias("median_bias"),
        _d2_column(F.col("y_q50")).alias("d2_absolute_error"),
        *_hit_columns(),
        F.bool_or("_broken").alias("_broken"),
    )
    parts = [base, spearman(preds, by), kendall(preds, by), distribution_distance(preds, by)]
    whole = reduce(lambda l, rgt: l.join(rgt, by, "left"), parts)
    return whole.select(*by, *[F.when(~F.col("_broken"), F.col(m)).alias(m) for m in REGRESSION_METRICS])


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def classification_aggregates() -> dict[str, Column]:
    y = _y().cast("double")
    s = F.least(F.greatest(_s(), F.lit(PROBABILITY_FLOOR)), F.lit(1 - PROBABILITY_FLOOR))
    ll = y * F.ln(s) + (1 - y) * F.ln(1 - s)
    rate = F.col("train_pos_rate")
    null_ll = y * F.ln(rate) + (1 - y) * F.ln(1 - rate)
    both = (F.min(_y()) == 0) & (F.max(_y()) == 1)
    hit = (_s() >= 0.5).cast("int")
    tp = F.count_if((hit == 1) & (_y() == 1))
    wrong = F.count_if(hit != _y())
    out = {
        "brier": F.avg((y - _s()) * (y - _s())),
        "log_loss": F.when(both, -F.avg(ll)),
        "balanced_accuracy": F.when(
            both,
            (tp / F.count_if(_y() == 1) + F.count_if((hit == 0) & (_y() == 0)) / F.count_if(_y() == 0)) / 2,
        ),
        "f1": F.coalesce(F.when(2 * tp + wrong > 0, 2.0 * tp / (2 * tp + wrong)), F.lit(0.0)),
        "accuracy": F.avg((hit == _y()).cast("double")),
        "mcfadden_pseudo_r2": F.when(
            both & (F.min(rate) > 0) & (F.max(rate) < 1), 1 - F.sum(ll) / F.sum(null_ll)),
    }
    return {n: F.when(F.bool_and(finite(_s())), c) for n, c in out.items()}


def simple_classification(preds: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    exprs = classification_aggregates()
    return preds.groupBy(*by).agg(*[exprs[n].alias(n) for n in names])


def ranking_quality(preds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Area under the ROC curve and average precision, from distinct thresholds."""
    by = list(by)
    scored = preds.withColumn("score", F.when(finite(_s()), _s()).otherwise(F.lit(-1e308)))
    run = ordered_running(
        scored.withColumn("_neg", -F.col("score")), by, "_neg",
        {"pos": (_y() == 1).cast("bigint"), "neg": (_y() == 0).cast("bigint"),
         "bad": (F.col("score") == F.lit(-1e308)).cast("bigint")},
    )
    pos, neg = F.col("pos"), F.col("neg")
    tp, fp = F.col("pos_before") + pos, F.col("neg_before") + neg
    n1, n0 = F.col("pos_total").cast("double"), F.col("neg_total").cast("double")
    usable = (F.max("pos_total") > 0) & (F.max("neg_total") > 0) & (F.max("bad_total") == 0)
    # A negative outranked by a positive is one pair won, a tie half a pair.
    won = F.sum(F.try_divide(neg.cast("double") * F.col("pos_before") + neg * pos / 2, n1 * n0))
    precision = F.sum(F.when(pos > 0, F.try_divide(pos, n1) * F.try_divide(tp, tp + fp)))
    return run.groupBy(*by).agg(
        F.when(usable, won).alias("roc_auc"), F.when(usable, precision).alias("pr_auc"))


def classification_metrics(preds: DataFrame, by: Sequence[str]) -> DataFrame:
    """All eight classification metrics, one row per cell."""
    by = list(by)
    base = simple_classification(
        preds, by, [n for n in CLASSIFICATION_METRICS if n not in ("roc_auc", "pr_auc")])
    return base.join(ranking_quality(preds, by), by, "left").select(*by, *CLASSIFICATION_METRICS)
