"""Cost calibration: repetition summaries, power-law fits, roll-ups and balance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordered import exact_quantiles, ordered_running
from tidemark.functions.scalars import power_law
from tidemark.operators.design import PASSTHROUGH_MODELS

VALID_BAND = (0.5, 2.0)
MAX_SPREAD = 3.0


def rep_summary(measures: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """median, min, max and count of repeated measurements."""
    stats = measures.groupBy(*by).agg(
        F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n_reps"))
    return stats.join(exact_quantiles(measures, by, value, {"median": 0.5}), list(by))


def telemetry(measures: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Per (model, k, field): observed count, min, median and max."""
    e = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("v")) for f in fields])
    long = measures.select("model", "k", F.explode(e).alias("e")).select("model", "k", "e.field", "e.v").where(
        "v is not null")
    keys = ["model", "k", "field"]
    return long.groupBy(*keys).agg(
        F.count("v").alias("observed"), F.min("v").alias("min"), F.max("v").alias("max")).join(
        exact_quantiles(long, keys, "v", {"median": 0.5}), keys)


def telemetry_values(measures: DataFrame, fields: Sequence[str]) -> DataFrame:
    """How often each value of a field occurs: one row per value, not one list per group."""
    e = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return measures.select("model", "k", F.explode(e).alias("e")).select("model", "k", "e.*").where(
        "value is not null").groupBy("model", "k", "field", "value").agg(F.count(F.lit(1)).alias("n"))


def convergence(measures: DataFrame) -> DataFrame:
    c = F.col("converged")
    return measures.groupBy("model", "k").agg(
        F.count(F.lit(1)).alias("n_measurements"), F.count(c).alias("converged_observed"),
        F.count_if(c).alias("converged_true"), F.count_if(~c).alias("converged_false"),
        (F.count_if(c) / F.nullif(F.count(c), F.lit(0))).alias("true_fraction"))


def fit_power_law(measures: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``value = exp(log_c) * k**a * n**b`` per group, on medians per (n, k).

    The normal equations are centred second moments, so one aggregation fits
    every group; residuals take a second pass. Groups with fewer than three
    points, a non-positive value or a degenerate design are left out.
    """
    by = list(by)
    points = exact_quantiles(measures, [*by, "n", "k"], value, {"t": 0.5}).select(
        *by, F.col("t").alias("_t"), F.ln("t").alias("y"), F.ln(F.col("k").cast("double")).alias("u"),
        F.ln(F.col("n").cast("double")).alias("w"))
    m = points.groupBy(*by).agg(
        F.var_pop("u").alias("uu"), F.var_pop("w").alias("ww"), F.covar_pop("u", "w").alias("uw"),
        F.covar_pop("u", "y").alias("uy"), F.covar_pop("w", "y").alias("wy"), F.var_pop("y").alias("yy"),
        F.avg("u").alias("mu"), F.avg("w").alias("mw"), F.avg("y").alias("my"),
        F.count(F.lit(1)).alias("n_points"), F.min("_t").alias("low"))
    det = F.col("uu") * F.col("ww") - F.col("uw") * F.col("uw")
    a = (F.col("uy") * F.col("ww") - F.col("wy") * F.col("uw")) / det
    b = (F.col("wy") * F.col("uu") - F.col("uy") * F.col("uw")) / det
    fits = (
        m.where((F.col("n_points") >= 3) & (F.col("low") > 0) & (det > 1e-12))
        .withColumn("a", a).withColumn("b", b)
        .withColumn("log_c", F.col("my") - F.col("a") * F.col("mu") - F.col("b") * F.col("mw"))
        .select(*by, "log_c", "a", "b", "yy", "n_points")
    )
    residual = F.col("y") - (F.col("log_c") + F.col("a") * F.col("u") + F.col("b") * F.col("w"))
    return points.join(fits, by).groupBy(*by, "log_c", "a", "b", "n_points").agg(
        F.when(F.max("yy") > 1e-15, 1 - F.avg(residual * residual) / F.max("yy")).otherwise(1.0).alias("r2"),
        F.min(residual).alias("residual_min"), F.max(residual).alias("residual_max"))


def predict_power_law(points: DataFrame, fits: DataFrame, by: Sequence[str], out: str = "predicted") -> DataFrame:
    return points.join(fits.select(*by, "log_c", "a", "b"), list(by)).withColumn(
        out, power_law(F.col("log_c"), F.col("a"), F.col("b"), F.col("n"), F.col("k"))).drop("log_c", "a", "b")


def validation_band(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """How many predicted/actual ratios were checked, and how many are out of band."""
    low, high = VALID_BAND
    ratio = F.col("ratio")
    return rows.groupBy(*by).agg(F.count(ratio).alias("checked"),
                                 F.count_if(~ratio.between(low, high)).alias("failing"))


def task_cost(tasks: DataFrame, fit_cost: DataFrame, preprocess_cost: DataFrame, memory: DataFrame,
              extra: Column | None = None) -> DataFrame:
    """Cost of a task: one preprocessing pass, every model's fit, the largest peak memory.

    The cost tables hold one power law per model or mode.
    """
    def law(table: DataFrame, key: str, tag: str) -> DataFrame:
        return table.select(F.col(key).alias(f"_{tag}"), *[F.col(c).alias(f"_{tag}_{c}") for c in ("log_c", "a", "b")])

    def value(tag: str) -> Column:
        return power_law(F.col(f"_{tag}_log_c"), F.col(f"_{tag}_a"), F.col(f"_{tag}_b"), F.col("n"), F.col("k"))

    mode = F.when(F.forall("models", lambda m: m.isin(*PASSTHROUGH_MODELS)), "passthrough").otherwise("imputed")
    rows = tasks.select("row_id", "n", "k", mode.alias("_pre"), F.explode("models").alias("_fit"))
    rows = rows.withColumn("_mem", F.col("_fit"))
    joined = (rows.join(law(fit_cost, "model", "fit"), "_fit").join(law(memory, "model", "mem"), "_mem")
              .join(law(preprocess_cost, "mode", "pre"), "_pre"))
    total = F.max(value("pre")) + F.sum(value("fit"))
    if extra is not None:
        total = total + F.max(extra)
    return joined.groupBy("row_id").agg(total.alias("cost_seconds"), F.max(value("mem")).alias("peak_bytes"))


def load_balance(tasks: DataFrame, budgets: Sequence[float]) -> DataFrame:
    """Spread of chunk costs per budget; a lone task above the budget is set apart."""
    chunks = tasks.groupBy("chunk_id").agg(F.sum("est_cost").alias("cost"), F.count(F.lit(1)).alias("rows"))
    per = chunks.withColumn("budget", F.explode(F.array(*[F.lit(float(b)) for b in budgets])))
    oversized = (F.col("rows") == 1) & (F.col("cost") > F.col("budget"))
    packable = per.where(~oversized)
    counts = per.groupBy("budget").agg(F.count(F.lit(1)).alias("chunk_count"),
                                       F.count_if(oversized).alias("oversized_chunk_count"))
    middle = exact_quantiles(packable, ["budget"], "cost", {"p50": 0.5})
    run = ordered_running(packable, ["budget"], "cost", {"c": F.lit(1)})
    rank = F.ceil(F.col("c_total") * 0.95) - 1
    p95 = run.where((rank >= F.col("c_before")) & (rank < F.col("c_before") + F.col("c"))).select(
        "budget", F.col("cost").alias("p95"))
    spread = F.when(F.col("p50") > 0, F.col("p95") / F.col("p50"))
    return counts.join(middle, "budget", "left").join(p95, "budget", "left").withColumn(
        "p95_over_p50", spread).withColumn("balanced", F.coalesce(spread < MAX_SPREAD, F.lit(False)))
