"""Data contracts. Every check returns its violations ``(check_id, subject, example, n)``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import joins as J
from tidemark.operators.design import Source

VIOLATION_DDL = "check_id string, subject string, example string, n bigint"
# Cross-validation floors of the models (fixed values).
CV_FLOORS = {"ridge": 2, "lasso": 2, "neural_net": 2, "lightgbm": 5, "super_learner": 5}


class ContractError(ValueError):
    pass


def _violations(df: DataFrame, check: str) -> DataFrame:
    return df.where(F.col("n") > 0).select(
        F.lit(check).alias("check_id"), F.col("subject").cast("string").alias("subject"),
        F.col("example").cast("string").alias("example"), F.col("n").cast("bigint").alias("n"))


def combine(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def assert_valid(*checks: DataFrame) -> None:
    """Raise with up to three examples when any check has violations."""
    bad = combine(checks).orderBy("check_id", "subject").limit(3).collect()
    if bad:
        raise ContractError("; ".join(
            f"{r['check_id']}: {r['subject']} ({r['n']} rows, e.g. {r['example']})" for r in bad))


def numeric_types(df: DataFrame, predictors: Sequence[str]) -> list[str]:
    """Predictors whose type is not a real number."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return [p for p in predictors if not isinstance(types[p], (T.NumericType, T.BooleanType))]


def check_numeric(df: DataFrame, predictors: Sequence[str]) -> DataFrame:
    """Infinite values, and predictors without any value; all columns in one pass."""
    inf = float("inf")
    entries = F.array(*[F.struct(F.lit(p).alias("subject"), F.col(p).cast("double").alias("v"))
                        for p in predictors])
    v = F.col("v")
    per = df.select(F.explode(entries).alias("e")).select("e.*").groupBy("subject").agg(
        F.count_if(F.abs(v) == inf).alias("infinite"), F.count(v).alias("seen"),
        F.count(F.lit(1)).alias("rows"))
    infinite = per.select("subject", F.lit(None).cast("string").alias("example"), F.col("infinite").alias("n"))
    empty = per.select("subject", F.lit(None).cast("string").alias("example"),
                       F.when(F.col("seen") == 0, F.col("rows")).otherwise(0).alias("n"))
    return _violations(infinite, "infinite_value").unionByName(_violations(empty, "all_missing"))


def check_onehot(df: DataFrame, sources: Sequence[Source], row_id: str) -> DataFrame:
    """Illegal group states: partly missing, not 0/1, or the wrong number of ones."""
    entries = []
    for s in sources:
        if s.unit_type != "onehot_group":
            continue
        cols = [F.col(f) for f in s.features]
        nulls = sum((c.isNull().cast("int") for c in cols[1:]), cols[0].isNull().cast("int"))
        ones = sum((F.coalesce((c == 1).cast("int"), F.lit(0)) for c in cols[1:]),
                   F.coalesce((cols[0] == 1).cast("int"), F.lit(0)))
        binary = reduce(lambda a, b: a & b, [c.isin(0.0, 1.0) for c in cols])
        legal = binary & ((ones == 1) | (F.lit(s.drop_first) & (ones == 0)))
        bad = F.when(nulls == len(cols), False).when(nulls > 0, True).otherwise(~legal)
        entries.append(F.struct(F.lit(s.name).alias("subject"), bad.alias("bad")))
    per = df.select(row_id, F.explode(F.array(*entries)).alias("e")).where("e.bad").groupBy(
        F.col("e.subject").alias("subject")).agg(F.min(row_id).alias("example"), F.count(F.lit(1)).alias("n"))
    return _violations(per, "illegal_onehot_state")


def check_ordinal(df: DataFrame, sources: Sequence[Source]) -> DataFrame:
    """Ordinal values outside their declared levels."""
    entries = [
        F.struct(F.lit(s.name).alias("subject"), F.col(s.features[0]).alias("v"),
                 (~F.col(s.features[0]).isin(s.ordinal_levels)).alias("bad"))
        for s in sources if s.unit_type == "ordinal"]
    per = df.select(F.explode(F.array(*entries)).alias("e")).where("e.bad").groupBy(
        F.col("e.subject").alias("subject")).agg(F.min("e.v").alias("example"), F.count(F.lit(1)).alias("n"))
    return _violations(per, "undeclared_ordinal_level")


def check_ids(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Missing ids, repeated ids within a table, ids shared by both tables."""
    sides = train.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        test.select(key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    per_key = sides.groupBy(key).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    present = F.col(key).isNotNull()
    entries = F.array(*[
        F.struct(F.lit(name).alias("subject"), cond.alias("hit"))
        for name, cond in (
            ("null_train", ~present & (F.col("a") > 0)), ("null_test", ~present & (F.col("b") > 0)),
            ("duplicate_train", present & (F.col("a") > 1)),
            ("duplicate_test", present & (F.col("b") > 1)),
            ("overlap", present & (F.col("a") > 0) & (F.col("b") > 0)))])
    per = per_key.select(key, F.explode(entries).alias("e")).where("e.hit").groupBy(
        F.col("e.subject").alias("subject")).agg(F.min(key).alias("example"), F.count(F.lit(1)).alias("n"))
    return _violations(per, "ids")


def outcome_stats(df: DataFrame, outcome: str, by: Sequence[str] = ()) -> DataFrame:
    y = F.col(outcome).cast("double")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(y).alias("n_observed"),
        F.coalesce(F.avg(y.isNull().cast("double")), F.lit(1.0)).alias("missing_ratio"),
        F.count_if(F.abs(y) == float("inf")).alias("n_infinite"),
        F.count_if(y.isNotNull() & ~y.isin(0.0, 1.0)).alias("n_not_binary"))


def check_outcome(df: DataFrame, outcome: str, task: str = "regression", ceiling: float = 0.5) -> DataFrame:
    """Too many missing outcomes, none observed, or values the task cannot use."""
    s = outcome_stats(df, outcome)
    bad_value = "n_infinite" if task == "regression" else "n_not_binary"
    entries = F.array(
        F.struct(F.lit("missing_ratio").alias("subject"), F.round("missing_ratio", 9).cast("string").alias("example"),
                 F.when(F.col("missing_ratio") > ceiling, F.col("n_rows") - F.col("n_observed")).otherwise(0).alias("n")),
        F.struct(F.lit("empty").alias("subject"), F.lit(None).cast("string").alias("example"),
                 F.when(F.col("n_observed") == 0, F.greatest("n_rows", F.lit(1))).otherwise(0).alias("n")),
        F.struct(F.lit(bad_value).alias("subject"), F.lit(None).cast("string").alias("example"),
                 F.col(bad_value).alias("n")))
    return _violations(s.select(F.explode(entries).alias("e")).select("e.*"), "outcome")


def check_row_floor(train: DataFrame, by: Sequence[str], models: Sequence[str], min_n: int,
                    label: str | None = None) -> DataFrame:
    """Training sets below the largest cross-validation floor of their models."""
    floor = max([min_n, *[CV_FLOORS.get(m, 1) for m in models]])
    subject = F.concat_ws("/", *[F.col(b).cast("string") for b in by])
    sizes = train.groupBy(*by).agg(F.count(F.lit(1)).alias("c"))
    rows = _violations(
        sizes.select(subject.alias("subject"), F.col("c").alias("example"),
                     F.greatest(F.lit(floor) - F.col("c"), F.lit(0)).alias("n")), "row_floor")
    if label is None:
        return rows
    folds = 5 if "super_learner" in models else 2
    smallest = train.groupBy(*by, label).agg(F.count(F.lit(1)).alias("c")).groupBy(*by).agg(
        F.when(F.count(F.lit(1)) > 1, F.min("c")).otherwise(0).alias("c"))
    return rows.unionByName(_violations(
        smallest.select(subject.alias("subject"), F.col("c").alias("example"),
                        F.greatest(F.lit(folds) - F.col("c"), F.lit(0)).alias("n")), "class_floor"))


def check_coverage(train: DataFrame, test: DataFrame, subject: str, state: str, check: str) -> DataFrame:
    """Test states or classes that no training row has, per subject."""
    keys = [subject, state]
    unseen = test.where(F.col(state).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).join(
        train.select(*keys).distinct(), keys, "left_anti")
    per = unseen.groupBy(F.col(subject).alias("subject")).agg(
        F.min(state).alias("example"), F.sum("c").alias("n"))
    return _violations(per, check)


def _ordinal_faults(manifest: DataFrame) -> list[Column]:
    """Declared levels that repeat or are no finite numbers, and priors outside them."""
    if not {"ordinal_levels", "source_prior"} <= set(manifest.columns):
        return []
    levels = F.from_json(F.col("ordinal_levels").cast("string"), "array<double>")
    ordinal = F.col("unit_type") == "ordinal"
    unfit = F.coalesce(F.size(levels) < 1, F.lit(True)) | F.coalesce(
        (F.size(F.array_distinct(levels)) != F.size(levels))
        | F.exists(levels, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(True))
    outside = F.col("source_prior").isNotNull() & ~F.coalesce(
        F.array_contains(levels, F.col("source_prior").cast("double")), F.lit(False))
    return [F.bool_or(ordinal & unfit).alias("ordinal_levels_unfit"),
            F.bool_or(ordinal & outside).alias("prior_not_a_level")]


def check_manifest(manifest: DataFrame) -> DataFrame:
    """Structural faults of a feature manifest, per source."""
    one = F.count(F.lit(1))
    group = F.col("unit_type") == "onehot_group"
    refs = F.count_if("is_reference")
    per = manifest.groupBy("source_column").agg(
        (F.count_distinct("source_order") > 1).alias("source_order_differs"),
        (F.count_distinct("unit_type") > 1).alias("unit_type_differs"),
        (F.count_distinct("drop_first") > 1).alias("drop_first_differs"),
        ((F.min("feature_order") != 0) | (F.max("feature_order") != one - 1)
         | (F.count_distinct("feature_order") != one)).alias("feature_order_gap"),
        (F.bool_or(~group) & (one > 1)).alias("single_feature_expected"),
        (F.bool_or(group & ~F.col("drop_first")) & (refs != 1)).alias("reference_count"),
        (F.bool_or(group) & (F.count_distinct("level_value") != one)).alias("level_repeated"),
        F.bool_or(F.col("is_reference") & (F.col("reference_level") != F.col("level_value"))).alias("reference_mismatch"),
        *_ordinal_faults(manifest),
        F.min("source_order").alias("_order"))
    faults = [c for c in per.columns if c not in ("source_column", "_order")]
    entries = F.array(*[F.struct(F.lit(c).alias("fault"), F.coalesce(F.col(c), F.lit(False)).alias("hit")) for c in faults])
    own = per.select("source_column", F.explode(entries).alias("e")).where("e.hit").groupBy(
        F.col("e.fault").alias("subject")).agg(F.min("source_column").alias("example"), F.count(F.lit(1)).alias("n"))
    shared = per.groupBy("_order").agg(F.count(F.lit(1)).alias("c"), F.min("source_column").alias("example")).where(
        "c > 1").groupBy().agg(F.min("example").alias("example"), F.count(F.lit(1)).alias("n")).withColumn(
        "subject", F.lit("source_order_shared"))
    return _violations(own, "manifest").unionByName(_violations(shared, "manifest"))


def check_disjoint_features(manifest: DataFrame) -> DataFrame:
    """Features that belong to more than one source."""
    per = manifest.groupBy(F.col("feature_name").alias("subject")).agg(
        F.count_distinct("source_column").alias("c"), F.min("source_column").alias("example"))
    return _violations(per.withColumn("n", F.when(F.col("c") > 1, F.col("c")).otherwise(0)), "shared_feature")


def check_features_match(features: DataFrame, manifest: DataFrame, key: str) -> bool:
    """Feature columns equal the kept manifest, in order. The manifest is header-sized."""
    kept = manifest.where("keep").orderBy("source_order", "feature_order").select("feature_name").collect()
    return [r[0] for r in kept] == [c for c in features.columns if c != key]


def check_universe(declared: DataFrame, resolved: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entries of one universe that the other lacks."""
    diff = J.key_differences(declared, resolved, keys).where(F.col("kind") != "duplicate")
    per = diff.groupBy(F.col("kind").alias("subject")).agg(
        F.min(F.concat_ws("/", *keys)).alias("example"), F.count(F.lit(1)).alias("n"))
    return _violations(per, "universe")


def _integral(c: Column) -> Column:
    v = c.try_cast("double")
    return F.coalesce((v == F.floor(v)) & (F.abs(v) != float("inf")), F.lit(False))


def check_checkpoint_rows(rows: DataFrame) -> DataFrame:
    """Checkpoint rows with missing keys, non-integral numbers or an unknown status."""
    faults = {
        f"empty_{c}": F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))
        for c in ("experiment_id", "model")}
    faults |= {f"not_integer_{c}": ~_integral(F.col(c)) for c in ("seed", "draw", "n", "k")}
    status = F.coalesce(F.nullif(F.trim("status"), F.lit("")), F.lit("ok"))
    faults["unknown_status"] = ~status.isin("ok", "skipped", "failed")
    entries = F.array(*[F.struct(F.lit(k).alias("subject"), v.alias("hit")) for k, v in faults.items()])
    per = rows.select("seq", F.explode(entries).alias("e")).where("e.hit").groupBy(
        F.col("e.subject").alias("subject")).agg(F.min("seq").alias("example"), F.count(F.lit(1)).alias("n"))
    return _violations(per, "checkpoint_row")


def flatten_paths(df: DataFrame, key: str, document: str) -> DataFrame:
    """Leaf values of a JSON document as ``(key, path, value)`` rows, at any depth.

    Objects are opened level by level as long as one is left; an empty object
    and an array are leaves.
    """
    def opened(rows: DataFrame) -> DataFrame:
        return rows.select(key, "path", F.explode(F.from_json("value", "map<string,string>")).alias("k", "value")).select(
            key, F.concat_ws(".", "path", "k").alias("path"), "value")

    def is_object() -> Column:
        return F.coalesce(F.trim("value").startswith("{") & ~F.col("value").rlike(r"^\s*\{\s*\}\s*$"), F.lit(False))

    rows = opened(df.select(key, F.lit(None).cast("string").alias("path"), F.col(document).alias("value")))
    leaves = rows.where(~is_object())
    while not (deeper := rows.where(is_object())).isEmpty():
        rows = opened(deeper)
        leaves = leaves.unionByName(rows.where(~is_object()))
    return leaves


def contract_diff(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """First path, in name order, at which two documents of a key differ.

    A path that one side lacks differs from one whose value is NULL.
    """
    both = left.withColumnRenamed("value", "left_value").withColumn("_l", F.lit(True)).join(
        right.withColumnRenamed("value", "right_value").withColumn("_r", F.lit(True)), [key, "path"], "full_outer")
    differs = both.where(~F.col("left_value").eqNullSafe(F.col("right_value")) | F.col("_l").isNull() | F.col("_r").isNull())
    first = F.min(F.struct("path", "left_value", "right_value")).alias("f")
    return differs.groupBy(key).agg(first, F.count(F.lit(1)).alias("n_paths")).select(
        key, "f.path", "f.left_value", "f.right_value", "n_paths")


def check_repeat_plan(plan: DataFrame, draws_per_seed: int) -> DataFrame:
    """Negative or repeated (seed, draw) pairs, and seeds with incomplete draws."""
    pair = F.concat_ws("/", "seed", "draw")
    counts = plan.groupBy("seed", "draw").agg(F.count(F.lit(1)).alias("c"))
    negative = counts.where("seed < 0 or draw < 0").groupBy().agg(
        F.min(pair).alias("example"), F.count(F.lit(1)).alias("n")).withColumn("subject", F.lit("negative"))
    repeated = counts.where("c > 1").groupBy().agg(
        F.min(pair).alias("example"), F.count(F.lit(1)).alias("n")).withColumn("subject", F.lit("repeated"))
    gaps = counts.groupBy("seed").agg(
        F.count_if((F.col("draw") >= 0) & (F.col("draw") < draws_per_seed)).alias("c")).where(
        F.col("c") < draws_per_seed).groupBy().agg(
        F.min("seed").alias("example"), F.count(F.lit(1)).alias("n")).withColumn("subject", F.lit("incomplete_seed"))
    return combine([_violations(x, "repeat_plan") for x in (negative, repeated, gaps)])


def check_unknown_rate(qa: DataFrame) -> DataFrame:
    """Unknown-category rates above their ceiling."""
    return _violations(qa.where("exceeds").select(
        F.col("source_column").alias("subject"), F.col("unknown_rate").alias("example"),
        F.col("unknown_count").alias("n")), "unknown_rate")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], VIOLATION_DDL)
