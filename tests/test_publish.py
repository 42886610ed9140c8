"""Publication: what stops a panel."""

from pyspark.sql import functions as F

from tidemark.plans import publish as P
from tidemark.sources import shards as H

KEYS = "experiment_id string, panel string, model string, seed int, draw int, n int, k int, status string, seq long, rmse double, fit_seconds double"


def test_only_whole_and_agreeing_panels_are_published(spark, tmp_path):
    rows = [("e", p, m, s, 0, 10, 1, "ok", 1, 0.5, 1.0) for p in ("good", "odd", "short") for m in ("a", "b") for s in (1, 2)]
    df = spark.createDataFrame(rows, KEYS)
    expected = df.select("panel", "model", "seed", "draw", "n", "k")
    path = str(tmp_path / "s")
    H.append_batch(df.where("not (panel = 'short' and model = 'b' and seed = 2)"), path, "001")
    contract = F.to_json(F.struct("model", F.struct(F.when((F.col("panel") == "odd") & (F.col("seed") == 2), "w").otherwise("v").alias("version")).alias("code")))
    manifests = df.select("panel", "model", "seed", contract.alias("contract"), F.array(F.lit("rmse")).alias("header"))
    plain = P.publish(spark, path, expected, "e")
    assert {r.panel for r in plain.panels.where("passed").collect()} == {"good", "odd"}
    checked = P.publish(spark, path, expected, "e", manifests)
    assert {r.panel for r in checked.panels.where("passed").collect()} == {"good"}
    assert checked.rows.count() == 4 and "fit_seconds" not in checked.rows.columns
    faults = {(r.panel, r.model, r.fault, r.example) for r in P.manifest_faults(manifests, expected).collect()}
    assert faults == {("odd", "a", "contract", "code.version"), ("odd", "b", "contract", "code.version"), ("odd", None, "panel_contract", "code.version")}
    P.write(checked, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "rows")).count() == 4
