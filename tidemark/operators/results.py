"""Reconciliation of sweep results: deduplicate, verify, summarise, publish."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tidemark.functions import scalars as X
from tidemark.functions.ordered import exact_quantiles
from tidemark.operators.joins import key_differences

RESULT_KEYS = ["experiment_id", "model", "seed", "draw", "n", "k"]
COMPLETED = ("ok", "skipped")
# Columns left out of published results (fixed names).
TIMING_COLUMNS = [
    "fit_seconds", "preprocess_seconds", "slice_seconds", "cell_wall_seconds",
    "preprocess_computed", "peak_rss_bytes", "best_rounds",
]
# Failure policy defaults (fixed values).
FAILED_ABS, FAILED_RATIO = 50, 0.05
STACK_FITS_PER_CELL = 24
COMPACT_AT = 50
# Positions of one slice when neighbouring rows are compared.
ORDER_SLICE = 65536


def status_or_ok(c: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("ok"))


def prefer_completed(rows: DataFrame, keys: Sequence[str] = RESULT_KEYS, seq: str = "seq") -> DataFrame:
    """One row per key: a completed one if there is any, and of those the latest.

    An aggregate, not a window: each task reduces its own rows before the
    shuffle, so a key repeated any number of times stays one row per task. A plain
    ``seq`` is reduced first, in a hash table, as aggregates of whole rows sort them;
    only rows that reach their key's best are looked at again.
    """
    rest = [c for c in rows.columns if c not in keys]
    done = status_or_ok(F.col("status")).isin(*COMPLETED) if "status" in rows.columns else F.lit(True)
    if isinstance(rows.schema[seq].dataType, NumericType):
        every = rows.groupBy(*keys).agg(F.max(done).alias("_done"), F.max(F.when(done, F.col(seq))).alias("_done_seq"), F.max(seq).alias("_any_seq"))
        top = every.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_done", F.when(F.col("_done"), F.col("_done_seq")).otherwise(F.col("_any_seq")).alias("_top"))
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        rows = rows.join(top, reduce(lambda a, b: a & b, [*same, done == F.col("_done"), F.col(seq).eqNullSafe(F.col("_top"))]), "left_semi")
    best = F.max_by(F.struct(*rest), F.struct(done.alias("done"), F.col(seq).alias("seq")))
    picked = rows.groupBy(*keys).agg(best.alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*rows.columns)


def union_shards(shards: Sequence[DataFrame]) -> DataFrame:
    """Shards aligned by name; a column a shard lacks is NULL, a missing status is ok."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shards)
    if "status" not in merged.columns:
        return merged.withColumn("status", F.lit("ok"))
    return merged.withColumn("status", status_or_ok(F.col("status")))


def rows_for_experiment(rows: DataFrame, experiment_id: str) -> DataFrame:
    return rows.where(F.col("experiment_id") == experiment_id)


def add_metadata(rows: DataFrame, metadata: dict[str, object]) -> DataFrame:
    """Constant columns; a column the rows already have keeps its values."""
    return rows.withColumns({k: F.lit(v) for k, v in metadata.items() if k not in rows.columns})


def publish_projection(rows: DataFrame) -> DataFrame:
    return rows.drop(*TIMING_COLUMNS)


def completed_keys(rows: DataFrame, keys: Sequence[str] = RESULT_KEYS) -> DataFrame:
    return rows.where(status_or_ok(F.col("status")).isin(*COMPLETED)).select(*keys)


def ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*[c for c in RESULT_KEYS if c in rows.columns])


def order_violations(rows: DataFrame, position: str, keys: Sequence[str] = RESULT_KEYS) -> DataFrame:
    """Rows that repeat the key of the row before them or are out of order.

    Positions may have gaps. They are cut into slices of a bounded number of
    values; neighbours meet inside a slice, and the first row of each slice meets
    the last of the nearest one before it.
    """
    key = F.struct(*keys)
    placed = rows.select(F.col(position).alias("pos"), key.alias("here"), F.floor(F.col(position) / ORDER_SLICE).alias("_s"))
    inside = placed.withColumn("before", F.lag("here").over(Window.partitionBy("_s").orderBy("pos")))
    edges = placed.groupBy("_s").agg(F.max_by("here", "pos").alias("last"))
    edges = edges.select("_s", F.lag("last").over(Window.orderBy("_s")).alias("_last"))  # one row per slice
    inside = inside.join(edges, "_s").withColumn("before", F.coalesce("before", "_last"))
    kind = F.when(F.col("here") == F.col("before"), "duplicate").when(F.col("here") < F.col("before"), "unordered")
    pairs = inside.select("pos", kind.alias("kind")).where("kind is not null")
    return pairs.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


def status_counts(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    s = status_or_ok(F.col("status"))
    return rows.groupBy(*by).agg(
        F.count_if(s == "ok").alias("ok"), F.count_if(s == "skipped").alias("skipped"),
        F.count_if(s == "failed").alias("failed"), F.count(F.lit(1)).alias("materialized"))


def completion_status(rows: DataFrame, expected: DataFrame, by: Sequence[str]) -> DataFrame:
    """incomplete, complete_with_failures or complete, per group of ``expected``."""
    counts = expected.join(status_counts(rows, by), list(by), "left").na.fill(0)
    status = (F.when(F.col("materialized") != F.col("expected"), "incomplete")
              .when(F.col("failed") > 0, "complete_with_failures").otherwise("complete"))
    return counts.withColumn("completed", F.col("ok") + F.col("skipped")).withColumn("status", status)


def failure_policy(rows: DataFrame, by: Sequence[str], max_failed: int = FAILED_ABS,
                   max_ratio: float = FAILED_RATIO) -> DataFrame:
    """Failed share among ok and failed rows, and which limit it breaks."""
    c = status_counts(rows, by)
    base = F.col("ok") + F.col("failed")
    ratio = F.when(base > 0, F.col("failed") / base)
    violation = (F.when(base == 0, "empty_denominator").when(F.col("failed") > max_failed, "failed_count")
                 .when(ratio > max_ratio, "failed_ratio"))
    return c.select(*by, "ok", "skipped", "failed", base.alias("denominator"),
                    ratio.alias("failed_ratio"), violation.alias("violation"),
                    violation.isNull().alias("passed"))


def diagnostics_flags(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts of true flags and of fits that did not converge, over ok rows."""
    ok = rows.where(status_or_ok(F.col("status")) == "ok")
    out = [F.count(F.lit(1)).alias("ok_rows")]
    for flag in ("constant_prediction", "underdetermined"):
        if flag in rows.columns:
            out.append(F.sum(X.truthy(F.col(flag))).alias(flag))
    out.append(F.count_if(X.truthy(F.col("converged")) == 0).alias("nonconverged"))
    return ok.groupBy(*by).agg(*out)


def diagnostics_numeric(rows: DataFrame, by: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """count, sum, exact median, min and max of finite values, rows of any status."""
    e = F.array(*[F.struct(F.lit(f).alias("field"), X.finite(F.col(f).cast("string")).alias("v")) for f in fields])
    long = rows.select(*by, F.explode(e).alias("e")).select(*by, "e.field", "e.v").where("v is not null")
    keys = [*by, "field"]
    stats = long.groupBy(*keys).agg(
        F.count("v").alias("count"), F.sum("v").alias("total"), F.min("v").alias("min"), F.max("v").alias("max"))
    return stats.join(exact_quantiles(long, keys, "v", {"median": 0.5}), keys)


def materialize(shards: Sequence[DataFrame], experiment_id: str) -> DataFrame:
    """Shards to one sorted, deduplicated, published table."""
    rows = rows_for_experiment(union_shards(shards), experiment_id)
    return ordered(publish_projection(prefer_completed(rows)))


def verify_materialized(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: counts of unfinished, missing, extra and repeated keys, and the verdict."""
    diff = key_differences(expected, rows, RESULT_KEYS)
    e = F.array(F.lit("missing"), F.lit("extra"), F.lit("duplicate"))
    kinds = expected.sparkSession.range(1).select(F.explode(e).alias("kind"))
    counts = kinds.join(diff.groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "kind", "left")
    unfinished = rows.where(~status_or_ok(F.col("status")).isin(*COMPLETED)).agg(
        F.lit("unfinished").alias("kind"), F.count(F.lit(1)).alias("n"))
    return counts.select("kind", F.coalesce("n", F.lit(0)).alias("n")).unionByName(unfinished)


def reuse_decision(runs: DataFrame, by: Sequence[str], rerun_completed: bool) -> DataFrame:
    """reuse, resume or new per group, from its newest run that has rows.

    ``runs``: ``(by, run_id, modified, matched, completed, wanted)``.
    """
    newest = runs.where(F.col("matched") > 0).groupBy(*by).agg(
        F.max_by(F.struct("run_id", "completed", "wanted"), F.struct("modified", "run_id")).alias("r"))
    done = F.col("r.completed") >= F.col("r.wanted")
    decision = F.when(~done, "resume").otherwise("new" if rerun_completed else "reuse")
    groups = runs.select(*by).distinct()
    return groups.join(newest, list(by), "left").select(
        *by, F.when(F.col("r").isNull(), "new").otherwise(decision).alias("decision"),
        F.when(F.col("r").isNotNull() & (decision != "new"), F.col("r.run_id")).alias("run_id"))


def merge_shards(shards: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Faults of merging disjoint shards: repeated, unplanned or absent keys."""
    return key_differences(expected, shards, keys).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def finalize_model(rows: DataFrame, expected: DataFrame, by: Sequence[str] = ("panel", "model")) -> DataFrame:
    """Per (panel, model): key faults against the design, status counts and policy."""
    by = list(by)
    keys = [*by, "seed", "draw", "n", "k"]
    faults = key_differences(expected, rows, keys).groupBy(*by).agg(
        F.count_if(F.col("kind") == "missing").alias("missing"),
        F.count_if(F.col("kind") == "extra").alias("extra"),
        F.count_if(F.col("kind") == "duplicate").alias("duplicate"))
    # A model without a single row is in the design all the same, and empty.
    wanted = expected.select(*by).unionByName(rows.select(*by)).distinct()
    out = wanted.join(failure_policy(rows, by), by, "left").join(faults, by, "left").na.fill(
        0, ["ok", "skipped", "failed", "denominator", "missing", "extra", "duplicate"]).na.fill(
        "empty_denominator", ["violation"]).na.fill(False, ["passed"])
    out = out.withColumn("violation", F.when(~F.col("passed"), F.col("violation")))
    whole = (F.col("missing") + F.col("extra") + F.col("duplicate")) == 0
    return out.withColumn("publishable", whole & F.col("passed"))


def publish_panel(models: DataFrame) -> DataFrame:
    """A panel passes only if every model does."""
    return models.groupBy("panel").agg(
        F.count(F.lit(1)).alias("n_models"), F.bool_and("publishable").alias("passed"),
        F.sum("ok").alias("ok"), F.sum("failed").alias("failed"))


def diagnose_shards(jobs: DataFrame, manifests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """State of every planned shard: missing, invalid, incomplete or complete."""
    found = manifests.withColumn("_found", F.lit(True))
    joined = jobs.join(found, list(keys), "left")
    state = (F.when(F.col("_found").isNull(), "missing")
             .when(F.coalesce(F.col("identity") != F.col("expected_identity"), F.lit(True)), "invalid")
             .when(F.col("rows_written") < F.col("rows_expected"), "incomplete").otherwise("complete"))
    return joined.select(*keys, state.alias("state"))


def carry_forward(current: DataFrame, prior: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Fields of an earlier run where the new one has none."""
    old = prior.select(key, *[F.col(f).alias(f"_old_{f}") for f in fields])
    return current.join(old, key, "left").select(
        *[F.coalesce(F.col(c), F.col(f"_old_{c}")).alias(c) if c in fields else F.col(c) for c in current.columns])


# Panel presets and defaults (fixed values).
PRESETS_DDL = "preset string, n_seeds int, n_draws int, n_sizes_n int, n_sizes_k int, min_n int, max_n int, max_k int, batch_size int"
PRESETS = [
    ("dev", 3, 3, 3, 3, 10, 100, 100, None),
    ("medium", 8, 8, 10, 10, 10, 100, 100, None),
    ("timing_full", 1, 1, 20, 20, 10, 0, 0, 20),
    ("production", 100, 50, 20, 20, 10, 0, 0, 20),
]
PANEL_DEFAULTS = {"seed": 12345, "test_size": 0.3, "batch_size": 20, "failed_abs_threshold": 50,
                  "failed_ratio_threshold": 0.05}


def resolve_panels(spark: SparkSession, panels: DataFrame, root: dict[str, object] | None = None) -> DataFrame:
    """Settings of each panel: its own, else the root's, the preset's, the default."""
    root = root or {}
    presets = spark.createDataFrame(PRESETS, PRESETS_DDL)
    preset_fields = [f.name for f in presets.schema.fields if f.name != "preset"]
    renamed = presets.select("preset", *[F.col(f).alias(f"_p_{f}") for f in preset_fields])
    joined = panels.join(F.broadcast(renamed), "preset", "left")
    fields = list(dict.fromkeys([*preset_fields, *PANEL_DEFAULTS]))

    def pick(f: str) -> Column:
        options = []
        if f in panels.columns:
            options.append(F.col(f))
        if f in root:
            options.append(F.lit(root[f]))
        if f in preset_fields:
            options.append(F.col(f"_p_{f}"))
        if f in PANEL_DEFAULTS:
            options.append(F.lit(PANEL_DEFAULTS[f]))
        return F.coalesce(*options).alias(f)

    return joined.select("panel", "preset", *[pick(f) for f in fields])


def panel_repeats(resolved: DataFrame) -> DataFrame:
    """(panel, seed, draw) of every repeat a panel asks for."""
    seeds = F.sequence(F.col("seed"), F.col("seed") + F.col("n_seeds") - 1)
    draws = F.sequence(F.lit(0), F.col("n_draws") - 1)
    return resolved.select("panel", "n_draws", F.explode(seeds).alias("seed")).select(
        "panel", "seed", F.explode(draws).alias("draw"))


def run_size(cells: DataFrame, by: Sequence[str], batch: int = 20, stack: str = "super_learner") -> DataFrame:
    """Cells, internal fits, checkpoint writes and shard counts of a design."""
    counts = cells.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cells"),
        (F.count_if(F.col("model") == stack) * STACK_FITS_PER_CELL).alias("stack_fits"))
    writes = F.ceil(F.col("cells") / batch)
    full = F.floor(writes / COMPACT_AT)
    stable = full + writes % COMPACT_AT
    return counts.select(
        *by, "cells", "stack_fits", writes.alias("checkpoint_writes"), stable.alias("stable_parts"),
        F.greatest(stable, F.when(full > 0, full + COMPACT_AT).otherwise(writes)).alias("peak_parts"),
        F.least(F.lit(batch), F.col("cells")).alias("max_uncheckpointed"))


def cv_argmin(scores: DataFrame, by: Sequence[str], candidate: str, score: str) -> DataFrame:
    """Candidate with the smallest mean score over folds; ties go to the smallest."""
    mean = scores.groupBy(*by, candidate).agg(F.round(F.avg(score), 12).alias("mean_score"))
    return mean.groupBy(*by).agg(F.min(F.struct("mean_score", candidate)).alias("b")).select(
        *by, F.col(f"b.{candidate}").alias(candidate), F.col("b.mean_score").alias("mean_score"))


def skip_reason(n_train: Column, n_selected: Column, n_unobserved: Column, model: Column,
                min_class: Column, n_classes: Column, task: str) -> Column:
    """Why a cell is skipped before fitting, first reason wins; NULL to fit it."""
    floor = (F.when(model.isin("ridge", "lasso", "neural_net"), 2)
             .when(model.isin("lightgbm", "super_learner"), 5).otherwise(1))
    unseen = F.when(n_unobserved >= n_selected, "all_sources_unobserved")
    if task == "regression":
        return F.coalesce(unseen, F.when(n_train < floor, "below_cv_floor"))
    return F.coalesce(unseen, F.when(n_classes < 2, "single_class_training"),
                      F.when((model == "super_learner") & (min_class < 2), "class_too_small_for_stacking"))
