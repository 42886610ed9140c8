"""Training-pool profile of raw columns: what to keep, and how to encode it.

All columns are profiled in one pass over a long form ``(column, raw)``. Only
the finished profile, a few rows per column, ever reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as X


@dataclass(frozen=True)
class ScreenConfig:
    """Screening thresholds (fixed values)."""

    min_valid_rate: float = 0.5
    min_numeric_fraction: float = 0.95
    categorical_max_levels: int = 15
    min_binary_prevalence: float = 0.01


@dataclass
class RawSource:
    """What the driver needs to encode one kept column."""

    column: str
    safe_name: str
    status: str
    levels: list[float] = field(default_factory=list)
    # Name part of each level: its token, or token and label.
    tokens: dict[float, str] = field(default_factory=dict)
    suffixes: dict[float, str] = field(default_factory=dict)
    # (token, keep): coded answers in numeric order, then "blank".
    missing: list[tuple[str, bool]] = field(default_factory=list)


def pool_rows(raw: DataFrame, train_ids: DataFrame, key: str) -> DataFrame:
    """Rows of the training pool."""
    return raw.join(train_ids.select(key), key, "left_semi")


def melt(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form ``(column, position, raw)`` with the cleaned states of each answer."""
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"),
                                 X.normalize(F.col(c)).alias("raw"))
                        for i, c in enumerate(columns)])
    long = raw.select(F.explode(entries).alias("e")).select("e.*")
    return long.select("*", X.to_number(F.col("raw")).alias("number"),
                       X.is_blank(F.col("raw")).alias("blank"),
                       X.is_coded(F.col("raw")).alias("coded"))


def profile_columns(long: DataFrame) -> DataFrame:
    """One row per column: valid rate, numeric share, distinct numbers, integrality.

    Answers are first counted per distinct text, so repeated answers combine
    before the shuffle and the distinct count needs no second pass.
    """
    texts = long.groupBy("column", "position", "raw").agg(
        F.count(F.lit(1)).alias("_c"), F.max("number").alias("number"),
        F.bool_or("blank").alias("blank"), F.bool_or("coded").alias("coded"))
    numbers = texts.groupBy("column", "position", "number").agg(
        F.sum("_c").alias("rows"),
        F.sum(F.when(~F.col("blank") & ~F.col("coded"), F.col("_c")).otherwise(0)).alias("valid"),
        F.bool_or("blank").alias("blank"))
    v = F.col("number")
    numeric_rows = F.sum(F.when(v.isNotNull(), F.col("rows")).otherwise(0))
    return numbers.groupBy("column", "position").agg(
        F.sum("rows").alias("n_rows"),
        (F.sum("valid") / F.sum("rows")).alias("raw_valid_rate"),
        F.coalesce(F.when(F.sum("valid") > 0, numeric_rows / F.sum("valid")), F.lit(0.0))
        .alias("numeric_fraction"),
        F.count(v).alias("distinct_numeric"),
        F.coalesce(F.bool_and(F.abs(v - F.floor(v)) <= 1e-8), F.lit(True)).alias("all_integer"),
        F.bool_or("blank").alias("has_blank"),
    )


def screen_columns(profile: DataFrame, config: ScreenConfig = ScreenConfig(),
                   labelled: Sequence[str] = ()) -> DataFrame:
    """Status and reason of every column; the first failed test decides."""
    low = F.col("raw_valid_rate") < config.min_valid_rate
    text = F.col("numeric_fraction") < config.min_numeric_fraction
    flat = F.col("distinct_numeric") <= 1
    few = F.col("distinct_numeric") <= config.categorical_max_levels
    named = F.col("column").isin(list(labelled)) if labelled else F.lit(False)
    kind = F.when(few & (named | F.col("all_integer")), "categorical").otherwise("numeric")
    return profile.withColumn(
        "status", F.when(low | text | flat, "dropped").otherwise(kind)
    ).withColumn(
        "reason", F.when(low, "below_min_valid_rate").when(text, "below_min_numeric_fraction")
        .when(flat, "constant_after_missing").otherwise("kept"))


def _of_status(long: DataFrame, screened: DataFrame, *status: str) -> DataFrame:
    """Answers of columns with a status. One row per column: bounded by the header."""
    kept = screened.where(F.col("status").isin(*status)).select("column", "n_rows")
    return long.join(F.broadcast(kept), "column")


def level_vocabulary(long: DataFrame, screened: DataFrame,
                     config: ScreenConfig = ScreenConfig()) -> DataFrame:
    """Levels of categorical columns with index, prevalence and keep flag."""
    counts = (
        _of_status(long, screened, "categorical").where(F.col("number").isNotNull())
        .groupBy("column", "number").agg((F.count(F.lit(1)) / F.max("n_rows")).alias("prevalence"))
    )
    # At most categorical_max_levels entries per column.
    packed = counts.groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct(F.col("number").alias("level"), "prevalence"))).alias("l"))
    keep = _kept(F.col("prevalence"), config)
    return packed.select("column", F.posexplode("l").alias("level_index", "e")).select(
        "column", "level_index", "e.level", "e.prevalence").withColumn("keep", keep)


def _kept(p: Column, config: ScreenConfig) -> Column:
    return F.least(p, 1 - p) >= config.min_binary_prevalence


def missing_code_vocabulary(long: DataFrame, screened: DataFrame,
                            config: ScreenConfig = ScreenConfig()) -> DataFrame:
    """Coded answers of kept columns by numeric value, blank last."""
    missing = _of_status(long, screened, "categorical", "numeric").where("coded or blank")
    token = F.when(F.col("coded"), F.col("raw")).otherwise("blank")
    rank = F.when(F.col("coded"), F.col("raw").try_cast("double").cast("int")).otherwise(0)
    counts = missing.groupBy("column", token.alias("token"), rank.alias("rank")).agg(
        (F.count(F.lit(1)) / F.max("n_rows")).alias("prevalence"))
    return counts.withColumn("keep", _kept(F.col("prevalence"), config))


def categorical_eligible(vocabulary: DataFrame) -> DataFrame:
    """A categorical column stays if any of its levels does; then all are encoded."""
    return vocabulary.groupBy("column").agg(
        F.bool_or("keep").alias("eligible"), F.count(F.lit(1)).alias("n_levels"))


def collect_sources(pool: DataFrame, columns: Sequence[str],
                    config: ScreenConfig = ScreenConfig(),
                    labels: dict[str, dict[float, str]] | None = None) -> list[RawSource]:
    """The profile on the driver: names of encoded columns depend on it.

    At most one row per column, level and missing code.
    """
    labels = labels or {}
    long = melt(pool, columns)
    screened = screen_columns(profile_columns(long), config, list(labels))
    info = {r["column"]: r for r in screened.collect()}
    levels: dict[str, list[tuple[float, bool]]] = {}
    for r in level_vocabulary(long, screened, config).collect():
        levels.setdefault(r["column"], []).append((r["level"], r["keep"]))
    missing: dict[str, list[tuple[int, str, bool]]] = {}
    for r in missing_code_vocabulary(long, screened, config).collect():
        missing.setdefault(r["column"], []).append((r["rank"], r["token"], r["keep"]))
    safe = F.array(*[X.safe_identifier(F.lit(c)) for c in columns])
    named = dict(zip(columns, pool.sparkSession.range(1).select(X.unique_names(safe)).first()[0]))
    tokens, suffixes = level_names(pool.sparkSession, levels, labels)
    out = []
    for column in columns:
        status = info[column]["status"] if column in info else "dropped"
        own = sorted(levels.get(column, []))
        if status == "dropped" or (status == "categorical" and not any(k for _, k in own)):
            continue
        out.append(RawSource(
            column, named[column], status, [v for v, _ in own], tokens.get(column, {}), suffixes.get(column, {}),
            [(t, k) for _, t, k in sorted(missing.get(column, []))]))
    return out



def level_names(spark: SparkSession, levels: dict[str, list[tuple[float, bool]]], labels: dict[str, dict[float, str]]
                ) -> tuple[dict[str, dict[float, str]], dict[str, dict[float, str]]]:
    """Token and feature suffix of every level, by column; one row per level."""
    rows = [(c, v, labels.get(c, {}).get(v)) for c, own in levels.items() for v, _ in own]
    tokens: dict[str, dict[float, str]] = {}
    suffixes: dict[str, dict[float, str]] = {}
    if rows:
        token = X.level_token(F.col("level"))
        label = F.when(F.col("label").isNotNull(), X.safe_identifier(F.col("label")))
        for r in spark.createDataFrame(rows, "column string, level double, label string").select(
                "column", "level", token.alias("token"), X.feature_suffix(token, label).alias("suffix")).collect():
            tokens.setdefault(r["column"], {})[r["level"]] = r["token"]
            suffixes.setdefault(r["column"], {})[r["level"]] = r["suffix"]
    return tokens, suffixes
