"""Every model of a task in every cell of a design: skip rules, fits, metrics and result rows in one plan.

The same sweep serves random and given splits, regression and classification, and
goes on where an earlier one stopped: cells whose keys are done are neither fitted nor
returned.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import blocks as B
from tidemark.operators import cells as C
from tidemark.operators import design as D
from tidemark.operators import impute as I
from tidemark.operators import metrics as M
from tidemark.operators import results as R
from tidemark.plans import sweep as S
from tidemark.session import scratch_path
from tidemark.sources import shards as H

BY = S.BY
CELL = [*BY, "k"]
LINEAR = ("ols", "ridge", "lasso")


@dataclass(frozen=True)
class Model:
    """What a named model is fitted as, and the rows it takes: imputed, standardized or passthrough."""

    kind: str
    rows: str = "imputed"


# Models of each task by name (fixed values).
MODELS: dict[str, dict[str, Model]] = {
    "regression": {
        "ols": Model("linear"), "ridge": Model("linear"), "lasso": Model("linear"),
        "random_forest": Model("random_forest"), "extra_trees": Model("extra_trees"),
        "xgboost": Model("boosted", "passthrough"), "lightgbm": Model("boosted_leaf", "passthrough"),
        "super_learner": Model("stack", "standardized"),
    },
    "classification": {
        "ols": Model("ols_classifier", "standardized"), "ridge": Model("ridge_classifier", "standardized"),
        "lasso": Model("lasso_classifier", "standardized"), "neural_net": Model("neural_net_classifier", "standardized"),
        "random_forest": Model("random_forest_classifier"), "extra_trees": Model("extra_trees_classifier"),
        "xgboost": Model("boosted_classifier", "passthrough"), "lightgbm": Model("boosted_leaf_classifier", "passthrough"),
        "super_learner": Model("stack_classifier", "standardized"),
    },
}


def make_model(name: str, task: str) -> Model:
    """The model of a name; raises for one that the task does not have."""
    if name not in MODELS[task]:
        raise KeyError(f"{task} has no model {name}; it has {', '.join(MODELS[task])}")
    return MODELS[task][name]


def external_sample(train: DataFrame, test: DataFrame, outcome: str, seeds: Sequence[int], draws: Sequence[int],
                    n_sizes: int = 4, min_n: int = 10, n_grid: Sequence[int] | None = None, row_id: str = "row_id") -> S.Sample:
    """Nested training samples of a given split; the test rows are those of every seed."""
    train, test = [part.where(F.col(outcome).isNotNull()) for part in (train, test)]
    total = train.count()
    if n_grid is None:
        n_grid = S.size_grid(total, n_sizes, min_n)
    rows = D.with_seeds(train, seeds)
    ranked = D.row_ranks(rows, draws, row_id, limit=max(n_grid)).persist(StorageLevel.MEMORY_AND_DISK)
    held = D.with_seeds(test, seeds).persist(StorageLevel.MEMORY_AND_DISK)
    return S.Sample(D.nested_prefix(ranked, n_grid), held, list(n_grid), list(seeds), list(draws), [ranked, held])


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def selected_sources(sample: S.Sample, sources: Sequence[D.Source], k_grid: Sequence[int]) -> DataFrame:
    """``seed, draw, k, src`` of the first K sources of every repeat."""
    spark = sample.train.sparkSession
    pairs = D.repeat_pairs(spark, pairs=[(s, d) for s in sample.seeds for d in sample.draws])
    sizes = F.array(*[F.lit(int(k)) for k in sorted(k_grid)])
    ranked = S.source_orders(pairs, sources).select("seed", "draw", F.posexplode("src_order").alias("_rank", "src"))
    return ranked.withColumn("k", F.explode(F.filter(sizes, lambda k: k > F.col("_rank")))).drop("_rank")


def _columns(chosen: DataFrame, sources: Sequence[D.Source]) -> DataFrame:
    """``seed, draw, k`` and the places of the features of the first K sources, ``_columns``."""
    spec = D.source_positions(sources)
    positions = F.array(*[F.array(*[F.lit(p) for p in own]) for own in spec])
    columns = F.sort_array(F.flatten(F.collect_list(F.element_at(positions, F.col("src") + 1))))
    return chosen.groupBy("seed", "draw", "k").agg(columns.alias("_columns"))


def _picks(runnable: DataFrame, chosen: DataFrame, sources: Sequence[D.Source]) -> B.Picks:
    """Cells that can be run, over rows that are held once for every K."""
    columns = {(r["seed"], r["draw"], r["k"]): list(r["_columns"]) for r in _columns(chosen, sources).collect()}  # of the caller's design
    of: dict[tuple, list] = {}
    for seed, draw, n, k in sorted(tuple(r) for r in runnable.select(*CELL).collect()):  # of the caller's design
        of.setdefault((seed, draw, n), []).append(((k,), columns[seed, draw, k]))
    return B.Picks(tuple(BY), ("k",), of)


def _features(rows: DataFrame, chosen: DataFrame, sources: Sequence[D.Source], y: str) -> DataFrame:
    """``CELL, row_id, label, features``: each row once per K, with the features of the first K sources."""
    picks = _columns(chosen, sources)  # a row per (seed, draw, K) of the design
    both = rows.join(F.broadcast(picks), ["seed", "draw"])
    return both.select(*CELL, "row_id", F.col(y).cast("double").alias("label"), F.transform("_columns", lambda p: F.col("x")[p]).alias("features"))


def cell_facts(sample: S.Sample, sources: Sequence[D.Source], chosen: DataFrame, fills: DataFrame, filled: DataFrame, y: str) -> DataFrame:
    """One row per cell: sizes, classes, and how many of its sources were seen and vary."""
    classes = sample.train.groupBy(*BY, y).agg(F.count(F.lit(1)).alias("_c")).groupBy(*BY).agg(
        F.sum("_c").alias("n_train"), F.count(F.lit(1)).alias("n_classes"), F.min("_c").alias("min_class"))
    widths = F.array(*[F.lit(len(s.features)) for s in sources])
    expanded = chosen.groupBy("seed", "draw", "k").agg(F.sum(F.element_at(widths, F.col("src") + 1)).alias("k_expanded"))
    unseen = I.k_unobserved(fills, chosen, BY)
    varying = I.k_varying(I.feature_ranges(filled, BY, sources), chosen, BY).drop("varying_columns")
    tests = sample.test.groupBy("seed").agg(F.count(F.lit(1)).alias("n_test_total"))
    return unseen.join(varying, CELL, "left").join(classes, BY).join(expanded, ["seed", "draw", "k"]).join(tests, "seed")


def model_sweep(sample: S.Sample, sources: Sequence[D.Source], k_grid: Sequence[int], models: Sequence[str], experiment_id: str,
                task: str = "regression", y: str = "y", done: DataFrame | None = None, seed: int = 0, metrics: Sequence[str] | None = None) -> DataFrame:
    """Result rows of ``models`` in all cells of the design that are not ``done``.

    A row: identity, sizes, the task's metrics, ``k_expanded, k_unobserved, k_varying,
    underdetermined, constant_prediction, converged, n_iter, best_rounds, alpha``,
    ``status`` and ``error``. Cells that the skip rules name are skipped, cells whose fit
    raised or predicted no finite number have failed; neither has metrics. ``done`` holds
    keys ``model, seed, draw, n, k``. ``metrics`` names those to compute, all unless
    given; some that are plain sums take one pass. Raises if every cell of a model failed.
    """
    spark = sample.train.sparkSession
    wanted = {name: make_model(name, task) for name in models}
    fills = _written(I.fit_fills(sample.train, BY, sources), "sweep-fills")
    packed = _written(I.pack_fills(fills, BY), "sweep-packed")
    chosen = _written(selected_sources(sample, sources, k_grid), "sweep-sources")
    parts = {"train": sample.train, "test": S.test_cells(sample)}

    def rows_of(mode: str) -> dict[str, DataFrame]:
        out = {r: I.apply_fills(p, packed, BY, sources, mode == "passthrough", n_cells=sample.n_cells) for r, p in parts.items()}
        if mode == "standardized":
            out = {r: I.standardize(p, BY, n_cells=sample.n_cells, fitted_on=out["train"]) for r, p in out.items()}
        return {r: _written(p.select(*BY, "row_id", y, "x"), f"sweep-{mode}-{r}") for r, p in out.items()}

    modes = {m: rows_of(m) for m in {"imputed", *(w.rows for w in wanted.values() if w.kind != "linear")}}
    facts = cell_facts(sample, sources, chosen, fills, modes["imputed"]["train"], y)
    design = facts.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    reason = R.skip_reason(F.col("n_train"), F.col("k_sources"), F.col("k_unobserved"), F.col("model"), F.col("min_class"), F.col("n_classes"), task)
    design = design.withColumn("skipped", reason)
    if done is not None:
        design = design.join(done.select("model", *CELL).distinct(), ["model", *CELL], "left_anti")
    design = _written(design, "sweep-design")

    preds, errors, notes = [], [], []
    for name, model in wanted.items():
        runnable = design.where((F.col("model") == name) & F.col("skipped").isNull()).select(*CELL)
        if model.kind == "linear" or runnable.isEmpty():
            continue
        parts_of = [modes[model.rows]["train"], modes[model.rows]["test"]]
        train, test = [_features(p, chosen, sources, y).join(runnable, CELL, "left_semi") for p in parts_of]
        # Trees and regressions take rows once for all K.
        picks, kept = _picks(runnable, chosen, sources), F.broadcast(runnable.select(*BY).distinct())
        own_train, own_test = [p.join(kept, BY, "left_semi").select(*BY, "row_id", F.col(y).cast("double").alias("label"), F.col("x").alias("features")) for p in parts_of]
        if model.kind in C.BASES:
            own, _, bad = C.stack_cells(train, test, CELL, model.kind, seed, keep_models=lambda df, label: _written(df, f"sweep-{label}"))
        elif C.KINDS[model.kind].packed:
            forests = C.forest_cells(own_train, own_test, CELL, C.KINDS[model.kind], seed, keep=lambda df, label: _written(df, f"sweep-{label}"), picks=picks)
            own, bad = forests.predictions(), forests.reports().where("error is not null").select(*CELL, "error")
            notes.append(forests.reports().select(F.lit(name).alias("model"), *CELL, F.when(F.col("error").isNull(), True).alias("converged"), F.col("best_rounds").alias("n_iter"),
                                                  "best_rounds", F.lit(None).cast("double").alias("alpha")))
        else:
            kind = C.KINDS[model.kind]
            held = (own_train, own_test) if kind.linear else (train, test)
            fitted = _written(C.fit_cells(held[0], CELL, kind, seed, picks), f"sweep-{name}")
            own, bad = C.predict_cells(fitted, held[1], CELL, kind, picks=picks if kind.linear else None), fitted.where("error is not null").groupBy(*CELL).agg(F.min("error").alias("error"))
            notes.append(fitted.groupBy(*CELL).agg(F.bool_and("converged").alias("converged"), F.max("n_iter").alias("n_iter"), F.max("best_rounds").alias("best_rounds"))
                         .select(F.lit(name).alias("model"), *CELL, "converged", "n_iter", "best_rounds", F.lit(None).cast("double").alias("alpha")))
        if bad.count() == runnable.count():
            raise RuntimeError(f"{name}: no cell could be fitted: {bad.first()['error']}")
        errors.append(bad.select(F.lit(name).alias("model"), *CELL, "error"))
        preds.append(own.select(F.lit(name).alias("model"), *CELL, "row_id", F.col("label").alias("y_true"), "y_pred"))
    open_models = {r[0] for r in design.where("skipped is null").select("model").distinct().collect()}  # of the caller's list
    linear = [m for m in models if wanted[m].kind == "linear" and m in open_models]
    if linear:
        swept = S.linear_sweep(sample, sources, k_grid, linear, y)
        runnable = design.where(F.col("model").isin(linear) & F.col("skipped").isNull()).select("model", *CELL)
        preds.append(swept.predictions.join(runnable, ["model", *CELL], "left_semi").select("model", *CELL, "row_id", F.col("y_true").cast("double").alias("y_true"), "y_pred"))
        fits = swept.fits.join(runnable, ["model", *CELL], "left_semi")
        notes.append(fits.select("model", *CELL, "converged", F.col("n_iter").cast("int").alias("n_iter"), F.lit(None).cast("int").alias("best_rounds"), F.col("alpha").cast("double").alias("alpha")))

    def union(frames: list[DataFrame], ddl: str) -> DataFrame:
        out = spark.createDataFrame([], ddl)
        for f in frames:
            out = out.unionByName(f)
        return out

    keys = "model string, seed int, draw int, n int, k int"
    scored = _written(union(preds, f"{keys}, row_id long, y_true double, y_pred double"), "sweep-predictions")
    by = ["model", *CELL]
    mean = sample.train.groupBy(*BY).agg(F.avg(F.col(y).cast("double")).alias("_mean"))
    scored = I.join_cells(scored, mean, BY, sample.n_cells)
    if task == "regression":
        given, every, sums = scored.withColumnRenamed("_mean", "train_mean"), M.REGRESSION_METRICS, set(M.regression_aggregates())
        simple, full = M.simple_regression, M.regression_metrics
    else:
        given = scored.withColumn("score", F.col("y_pred")).withColumnRenamed("_mean", "train_pos_rate")
        every, sums, simple, full = M.CLASSIFICATION_METRICS, set(M.classification_aggregates()), M.simple_classification, M.classification_metrics
    names = list(every if metrics is None else metrics)
    table = simple(given, by, names) if set(names) <= sums else full(given, by)
    broken = scored.groupBy(*by).agg(F.bool_or(~M.finite(F.col("y_pred"))).alias("_broken"))
    failed = union(errors, f"{keys}, error string").groupBy(*by).agg(F.min("error").alias("_error"))
    found = union(notes, f"{keys}, converged boolean, n_iter int, best_rounds int, alpha double")
    out = design.join(table, by, "left").join(broken, by, "left").join(I.constant_prediction(scored, by), by, "left").join(failed, by, "left").join(found, by, "left")
    error = F.coalesce("skipped", "_error", F.when(F.col("_broken"), "non_finite_prediction"), F.when(F.col("_broken").isNull(), "no_prediction"))
    status = F.when(F.col("skipped").isNotNull(), "skipped").when(error.isNotNull(), "failed").otherwise("ok")
    total = len(D.feature_names(sources))
    return out.select(
        F.lit(experiment_id).alias("experiment_id"), F.lit(task).alias("task"), *by, F.col("n_train").alias("n_train_rows"), "n_test_total",
        F.lit(len(sources)).alias("n_features_total"), "k_expanded", F.lit(total).alias("n_expanded_features_total"), "k_unobserved",
        *[F.when(status == "ok", F.col(m)).alias(m) for m in names],
        "k_varying", "constant_prediction", "underdetermined", "converged", "n_iter", "best_rounds", "alpha", status.alias("status"), error.alias("error"))


def resume_sweep(sample: S.Sample, sources: Sequence[D.Source], k_grid: Sequence[int], models: Sequence[str], experiment_id: str,
                 shards: str, batch: str, **options) -> int:
    """Fit what the shards of ``experiment_id`` lack, append it as one batch, and return its rows.

    Failed cells are fitted again; reading prefers completed rows over earlier failures.
    """
    spark = sample.train.sparkSession
    done = None
    if H.batches(spark, shards):
        index = R.prefer_completed(R.rows_for_experiment(H.read_shards(spark, shards, [*R.RESULT_KEYS, "status", "seq"]), experiment_id))
        done = _written(R.completed_keys(index), "sweep-done")
        pairs = D.repeat_pairs(spark, pairs=[(s, d) for s in sample.seeds for d in sample.draws])
        cells = D.design_cells(pairs, models, sample.n_grid, k_grid).select("model", *CELL)
        if cells.join(done, ["model", *CELL], "left_anti").isEmpty():
            return 0
    rows = model_sweep(sample, sources, k_grid, models, experiment_id, done=done, **options)
    rows = _written(rows.withColumn("seq", F.lit(len(H.batches(spark, shards))).cast("bigint")), "sweep-batch")
    H.append_batch(rows, shards, batch)
    return rows.count()


