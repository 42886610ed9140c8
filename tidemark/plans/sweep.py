"""The sweep: every cell of a design in one DataFrame plan, with no loop over cells."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ordered import exact_quantiles
from tidemark.operators import design as D
from tidemark.operators import impute as I
from tidemark.operators import linear as L
from tidemark.operators import metrics as M
from tidemark.session import scratch_path

BY = ["seed", "draw", "n"]


def size_grid(total: int, n_sizes: int, min_size: int = 1, max_size: int | None = None) -> list[int]:
    """Driver-side twin of :func:`tidemark.operators.design.log2_grid`."""
    upper = min(total, max_size) if max_size and max_size > 0 else total
    if n_sizes == 1:
        return [upper]
    low, high = math.log2(min_size), math.log2(upper)
    sizes = {
        min(max(round(round(2.0 ** (low + (high - low) * i / (n_sizes - 1)), 9)), min_size), upper)
        for i in range(n_sizes)
    }
    return sorted(sizes)


@dataclass
class Sample:
    """Row sample of a design: training rows per (seed, draw, N) and test rows per seed."""

    train: DataFrame
    test: DataFrame
    n_grid: list[int]
    seeds: list[int]
    draws: list[int]
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        for df in self.held:
            df.unpersist()

    @property
    def n_cells(self) -> int:
        return len(self.seeds) * len(self.draws) * len(self.n_grid)


def sample_rows(rows: DataFrame, outcome: str, seeds: Sequence[int], draws: Sequence[int],
                test_size: float = 0.2, n_sizes: int = 4, min_n: int = 10,
                n_grid: Sequence[int] | None = None, row_id: str = "row_id", stratified: bool = False) -> Sample:
    """Split, permute and take nested prefixes. Rows without an outcome are left out.

    ``rk`` of the training rows is their rank in the permutation, rounded up to the next
    size of the grid or end of a fold (``L.CV_FOLDS``); with ``stratified`` it is exact.

    ``stratified`` keeps the shares of the outcome's classes in the split, and lets the
    smallest sample hold every class: a permutation whose first rows lack one has its
    first row of that class among them.
    """
    observed = rows.where(F.col(outcome).isNotNull())
    if not stratified:
        # Dealt out once, however few files they come from, with all digests; then held once with their place in every repeat.
        hashed = D.with_digests(observed.repartition(row_id), seeds, draws, row_id).persist(StorageLevel.MEMORY_AND_DISK)
        total = hashed.count()
        n_test = math.ceil(total * test_size)
        n_grid = size_grid(total - n_test, n_sizes, min_n) if n_grid is None else n_grid
        ends = {e for n in n_grid for e in D.fold_ends(n, L.CV_FOLDS)}
        tagged = D.rank_tags(hashed, seeds, draws, n_test, sorted(ends), row_id).persist(StorageLevel.MEMORY_AND_DISK)
        tagged.count()
        hashed.unpersist()
        ranked, test = D.tagged_rows(tagged, seeds, draws)
        return Sample(D.nested_prefix(ranked, n_grid), test, list(n_grid), list(seeds), list(draws), [tagged])
    if n_grid is None:
        total = observed.count()
        n_grid = size_grid(total - math.ceil(total * test_size), n_sizes, min_n)
    split = D.split_stratified(observed, seeds, test_size, outcome, row_id)
    ranked = D.row_ranks(split.where(F.col("role") == "train").drop("role"), draws, row_id,
                         limit=max(n_grid))
    # Ranked rows feed every statistic of every cell; held once, rebuilt if lost.
    ranked = ranked.persist(StorageLevel.MEMORY_AND_DISK)
    test = split.where(F.col("role") == "test").drop("role").persist(StorageLevel.MEMORY_AND_DISK)
    held = [ranked, test]
    swaps = D.class_swaps(ranked, outcome, min(n_grid)).persist(StorageLevel.MEMORY_AND_DISK)
    held.append(swaps)
    ranked = D.swap_ranks(ranked, swaps)
    return Sample(D.nested_prefix(ranked, n_grid), test, list(n_grid), list(seeds), list(draws), held)


def test_cells(sample: Sample) -> DataFrame:
    """Held-out rows of a seed, once per (draw, N)."""
    pairs = F.array(*[F.struct(F.lit(d).alias("draw"), F.lit(n).alias("n"))
                      for d in sample.draws for n in sample.n_grid])
    return sample.test.withColumn("_c", F.explode(pairs)).select(
        *sample.test.columns, F.col("_c.draw").alias("draw"), F.col("_c.n").alias("n"))


def accumulate_bands(banded: DataFrame, by: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Totals of every N from per-band totals: bands up to N add up to the N-sample."""
    w = Window.partitionBy(*by).orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
    return banded.select(*by, F.col("band").alias("n"), *[F.sum(c).over(w).alias(c) for c in sums])


def univariate_fit(train: DataFrame, by: Sequence[str], y: str, x: str,
                   n_cells: int | None = None) -> DataFrame:
    """Median fill and least-squares line of one predictor, per cell."""
    fills = exact_quantiles(train, by, x, {"fill": 0.5})
    filled = F.coalesce(F.col(x), F.col("fill"), F.lit(0.0))
    stats = I.join_cells(train, fills, by, n_cells, "left").groupBy(*by).agg(
        F.max("fill").alias("fill"), F.avg(y).alias("train_mean"),
        F.covar_pop(filled, F.col(y)).alias("_cov"), F.var_pop(filled).alias("_var"),
        F.avg(filled).alias("_mx"), (F.min(filled) != F.max(filled)).alias("_varies"))
    slope = F.when(F.col("_varies"), F.col("_cov") / F.col("_var")).otherwise(0.0)
    return stats.select(*by, "fill", "train_mean", slope.alias("slope"),
                        (F.col("train_mean") - slope * F.col("_mx")).alias("intercept"))


def univariate_predictions(sample: Sample, y: str, x: str) -> DataFrame:
    fits = univariate_fit(sample.train, BY, y, x, sample.n_cells)
    joined = I.join_cells(test_cells(sample), fits, BY, sample.n_cells)
    value = F.coalesce(F.col(x), F.col("fill"), F.lit(0.0))
    value = F.when(F.col("fill").isNull(), 0.0).otherwise(value)
    return joined.select(
        *BY, "row_id", F.col(y).alias("y_true"),
        (F.col("intercept") + F.col("slope") * value).alias("y_pred"),
        "train_mean", "slope", "intercept")


def baseline_sweep(rows: DataFrame, y: str, x: str, seeds: Sequence[int], draws: Sequence[int],
                   metrics: Sequence[str] = ("r2_test", "rmse", "mae"), **kw) -> DataFrame:
    """Held-out error of a one-predictor regression for every (seed, draw, N)."""
    sample = sample_rows(rows.select("row_id", y, x), y, seeds, draws, **kw)
    preds = univariate_predictions(sample, y, x)
    exprs = M.regression_aggregates()
    return preds.groupBy(*BY).agg(
        F.count(F.lit(1)).alias("n_test"),
        F.max("slope").alias("slope"), F.max("intercept").alias("intercept"),
        *[exprs[m].alias(m) for m in metrics])


def source_orders(pairs: DataFrame, sources: Sequence[D.Source]) -> DataFrame:
    """Permuted source positions of each (seed, draw) as one array."""
    names = [s.name for s in sources]
    ranks = D.source_ranks(pairs, names).withColumn(
        "src", (F.array_position(F.array(*[F.lit(n) for n in names]), F.col("source")) - 1).cast("int"))
    packed = F.array_sort(F.collect_list(F.struct("srk", "src")))
    return ranks.groupBy("seed", "draw").agg(packed.alias("_o")).select("seed", "draw", F.col("_o.src").alias("src_order"))


@dataclass
class LinearSweep:
    fits: DataFrame
    predictions: DataFrame
    fills: DataFrame
    sample: Sample


def linear_sweep(sample: Sample, sources: Sequence[D.Source], k_grid: Sequence[int],
                 models: Sequence[str] = ("ols", "ridge", "lasso"), y: str = "y") -> LinearSweep:
    """Impute, fit and predict every (model, seed, draw, N, K) cell in one plan."""
    spark = sample.train.sparkSession
    # Read by the means, the products, the predictions and the caller; as a table its long plan is not repeated in each.
    path, features = scratch_path(spark, "fills"), sum(len(x.features) for x in sources)
    I.fit_fills(sample.train, BY, sources).write.parquet(path)
    fills = spark.read.parquet(path)
    packed = I.pack_fills(fills, BY)
    train = I.apply_fills(L.with_fold(sample.train), packed, BY, sources, n_cells=sample.n_cells)
    test = I.apply_fills(test_cells(sample), packed, BY, sources, n_cells=sample.n_cells)
    pairs = D.repeat_pairs(spark, pairs=[(s, d) for s in sample.seeds for d in sample.draws])
    fits = L.fit_linear(train, BY, sources, source_orders(pairs, sources), k_grid, models, y=y, n_cells=sample.n_cells)
    preds = L.predict_linear(test, fits, BY, sample.n_cells, ["row_id", y],
                             width=features * len(k_grid) * len(models), features=features).withColumnRenamed(y, "y_true")
    means = sample.train.groupBy(*BY).agg(F.avg(y).alias("train_mean"))
    preds = I.join_cells(preds, means, BY, sample.n_cells)
    return LinearSweep(fits, preds, fills, sample)


def result_rows(preds: DataFrame, sample: Sample, experiment_id: str, model: str | None = None,
                by: Sequence[str] = BY, min_n: int = 1) -> DataFrame:
    """Result rows of predicted cells: identity, sizes, all metrics, flags, status and error.

    A cell below ``min_n`` is skipped and one with a prediction that is no finite
    number has failed; neither has metrics. The predictions stay persisted, for the
    caller to release.
    """
    by = list(by)
    # The metrics take several passes over the predictions.
    preds = preds.persist(StorageLevel.MEMORY_AND_DISK)
    sizes = preds.groupBy(*by).agg(F.count(F.lit(1)).alias("n_test_total"))
    used = preds.where(F.col("n") >= min_n)
    metrics = M.regression_metrics(used, by, sample.n_cells if by == BY else None)
    broken = used.groupBy(*by).agg(F.bool_or(~M.finite(F.col("y_pred"))).alias("_broken"))
    flags = I.constant_prediction(preds, by)
    out = sizes.join(metrics, by, "left").join(broken, by, "left").join(flags, by, "left")
    if model is not None:
        out = out.withColumn("model", F.lit(model))
    failed = F.coalesce("_broken", F.lit(False))
    status = F.when(F.col("n") < min_n, "skipped").when(failed, "failed").otherwise("ok")
    error = F.when(F.col("n") < min_n, "below_cv_floor").when(failed, "non_finite_prediction")
    return out.withColumn("experiment_id", F.lit(experiment_id)).withColumn("status", status).withColumn(
        "error", error).drop("_broken")
