"""Validated joins of outcomes, features, labels and designs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join with a match indicator. The size of a side is left to the planner."""
    return left.join(right.withColumn("_matched", F.lit(True)), key, "left").withColumn(
        "_matched", F.coalesce("_matched", F.lit(False)))


def one_to_one_violations(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Duplicate keys on either side, and left keys without a partner."""
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    per_key = sides.groupBy(key).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    kinds = F.filter(
        F.array(F.when(F.col("l") > 1, "duplicate_left"), F.when(F.col("r") > 1, "duplicate_right"),
                F.when((F.col("l") > 0) & (F.col("r") == 0), "unmatched")),
        lambda k: k.isNotNull())
    return per_key.select(F.explode(kinds).alias("kind"), F.col(key).cast("string").alias("k")).groupBy(
        "kind").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("example"))


def outcome_summary(outcomes: DataFrame, features: DataFrame, key: str, split: str,
                    names: Sequence[str], predictors: int) -> DataFrame:
    """Row accounting per (split, outcome) of outcomes joined to features."""
    joined = join_one_to_one(outcomes.select(key, split, *names), features.select(key), key)
    long = joined.select(
        split, "_matched",
        F.explode(F.array(*[F.struct(F.lit(n).alias("outcome"),
                                     F.col(n).isNotNull().alias("seen")) for n in names])).alias("e"))
    return long.groupBy(split, F.col("e.outcome").alias("outcome")).agg(
        F.count(F.lit(1)).alias("rows_in_outcome_file"),
        F.count_if("_matched").alias("rows_after_feature_merge"),
        F.count_if(F.col("e.seen") & F.col("_matched")).alias("rows_with_observed_outcome"),
    ).withColumn("predictor_columns", F.lit(predictors))


def label_vocabulary(coded: DataFrame, code: str, label: str) -> DataFrame:
    """Distinct labels per code, without a leading copy of the code."""
    pairs = coded.where(F.col(code).isNotNull()).select(
        F.col(code).alias("code"), F.trim(label).alias("raw_label")).distinct()
    prefix = F.col("code").cast("string")
    short = F.trim(F.when(F.startswith("raw_label", prefix),
                          F.substr("raw_label", F.length(prefix) + 1)).otherwise(F.col("raw_label")))
    return pairs.select("code", F.when(short != "", short).otherwise(F.col("raw_label")).alias("label"))


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys present on both sides."""
    return left.select(key).intersect(right.select(key))


def pending(design: DataFrame, completed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Design cells without a completed result."""
    return design.join(completed.select(*keys).distinct(), list(keys), "left_anti")


def expected_keys(tasks: DataFrame) -> DataFrame:
    """One key per (task row, model)."""
    return tasks.select(F.explode("models").alias("model"), "seed", "draw", "n", "k").distinct()


def pending_groups(tasks: DataFrame, completed: DataFrame) -> DataFrame:
    """Task rows for which at least one model is not complete."""
    keys = ["model", "seed", "draw", "n", "k"]
    open_rows = tasks.select("row_id", F.explode("models").alias("model"), "seed", "draw", "n", "k").join(
        completed.select(*keys), keys, "left_anti").select("row_id")
    return tasks.join(open_rows, "row_id", "left_semi")


def key_differences(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Missing, extra and duplicated keys of a result against its design, in one shuffle."""
    both = expected.select(*keys, F.lit(1).alias("e"), F.lit(0).alias("a")).unionByName(
        actual.select(*keys, F.lit(0).alias("e"), F.lit(1).alias("a")))
    per_key = both.groupBy(*keys).agg(F.sum("e").alias("e"), F.sum("a").alias("a"))
    kinds = F.filter(
        F.array(F.when((F.col("e") > 0) & (F.col("a") == 0), "missing"),
                F.when((F.col("e") == 0) & (F.col("a") > 0), "extra"),
                F.when(F.col("a") > 1, "duplicate")),
        lambda k: k.isNotNull())
    return per_key.select(*keys, F.explode(kinds).alias("kind"))


def validation_rows(points: DataFrame, predicted: DataFrame, measured: DataFrame,
                    keys: Sequence[str]) -> DataFrame:
    """Predicted against measured time, with why a measurement is absent.

    ``measured`` holds ``seconds`` and ``censored``; ``points`` may mark
    ``planned = false`` for cells that were never going to be measured.
    """
    joined = points.join(predicted, list(keys), "left").join(measured, list(keys), "left")
    status = (
        F.when(~F.col("planned"), "not_measured")
        .when(F.coalesce("censored", F.lit(False)), "censored")
        .when(F.col("seconds").isNull(), "missing").otherwise("measured"))
    return joined.select(
        *keys, "predicted", F.when(status == "measured", F.col("seconds")).alias("actual"),
        status.alias("status"),
        F.when(status == "measured", F.col("predicted") / F.nullif("seconds", F.lit(0.0))).alias("ratio"))
