"""From shards in storage to published tables, one panel and model at a time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import checks as V
from tidemark.operators import results as R
from tidemark.sources import shards as H


@dataclass
class Published:
    rows: DataFrame
    models: DataFrame
    panels: DataFrame


def manifest_faults(manifests: DataFrame, expected: DataFrame, own: tuple[str, ...] = ("model",)) -> DataFrame:
    """``panel, model, fault, example``: shards that are missing or do not belong together.

    ``manifests``: ``panel, model, seed, contract`` (a JSON document with the grid in it)
    and ``header`` (column names). Shards of one model must agree in the whole contract,
    those of a panel in all of it but the paths below ``own``, and in the header; such a
    fault of a panel has no ``model``. The example is the first differing path.
    """
    keys = ["panel", "model", "seed"]
    name = F.concat_ws("/", *keys)
    shards = manifests.select(*keys, name.alias("shard"))
    paths = V.flatten_paths(manifests.select(name.alias("shard"), "contract"), "shard", "contract").join(shards, "shard")

    def differing(rows: DataFrame, by: list[str], fault: str) -> DataFrame:
        sizes = shards.groupBy(*by).agg(F.count(F.lit(1)).alias("_shards"))
        values = F.struct(F.col("value").isNull(), "value")
        per = rows.groupBy(*by, "path").agg(F.count_distinct(values).alias("_values"), F.count(F.lit(1)).alias("_present"))
        bad = per.join(sizes, by).where("_values > 1 or _present < _shards")
        return bad.groupBy(*by).agg(F.min("path").alias("example")).withColumn("fault", F.lit(fault))

    common = paths
    for p in own:
        common = common.where((F.col("path") != p) & ~F.startswith("path", F.lit(f"{p}.")))
    headers = manifests.groupBy("panel").agg(F.count_distinct("header").alias("_n"), F.min(F.concat_ws(",", "header")).alias("example"))
    absent = expected.select(*keys).distinct().join(manifests, keys, "left_anti")
    faults = [
        absent.groupBy("panel", "model").agg(F.min(F.col("seed").cast("string")).alias("example")).withColumn("fault", F.lit("missing_shard")),
        differing(paths, ["panel", "model"], "contract"),
        differing(common, ["panel"], "panel_contract").withColumn("model", F.lit(None).cast("string")),
        headers.where("_n > 1").select("panel", "example", F.lit("header").alias("fault"), F.lit(None).cast("string").alias("model")),
    ]
    out = faults[0]
    for f in faults[1:]:
        out = out.unionByName(f)
    return out.select("panel", "model", "fault", "example")


def publish(spark: SparkSession, shard_path: str, expected: DataFrame, experiment_id: str, manifests: DataFrame | None = None) -> Published:
    """Deduplicate, check against the design, apply the failure policy, keep passing panels.

    Shards and ``expected`` carry ``panel``; ``rows`` holds only complete panels. With
    ``manifests`` a model is publishable only if its shards and its panel have no fault.
    """
    raw = R.rows_for_experiment(H.read_shards(spark, shard_path), experiment_id)
    best = R.prefer_completed(raw, ["panel", *R.RESULT_KEYS])
    models = R.finalize_model(best, expected)
    if manifests is not None:
        faults = manifest_faults(manifests, expected)
        own = faults.where("model is not null").select("panel", "model", F.lit(True).alias("_own")).distinct()
        whole = faults.where("model is null").select("panel", F.lit(True).alias("_whole")).distinct()
        models = models.join(own, ["panel", "model"], "left").join(whole, "panel", "left")
        models = models.withColumn("publishable", F.col("publishable") & F.col("_own").isNull() & F.col("_whole").isNull()).drop("_own", "_whole")
    panels = R.publish_panel(models)
    # One row per panel of the run.
    passed = panels.where("passed").select("panel")
    rows = R.publish_projection(best.join(passed, "panel", "left_semi"))
    return Published(rows.orderBy("panel", *R.RESULT_KEYS), models, panels)


def write(published: Published, path: str) -> None:
    published.rows.write.mode("overwrite").partitionBy("experiment_id", "panel", "model").parquet(f"{path}/rows")
    published.models.write.mode("overwrite").parquet(f"{path}/models")
    published.panels.withColumn("checked_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/panels")
