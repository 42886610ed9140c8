"""Compaction and deduplication in tasks of bounded memory."""

from pyspark.sql import functions as F

from tidemark.operators import results as R
from tidemark.sources import shards as H


def test_only_the_best_rows_of_a_key_are_sorted(spark):
    rows = spark.createDataFrame(
        [("e", "m", 1, 0, 10, k, status, seq, note) for k, status, seq, note in
         [(1, "ok", 3, "a"), (1, "ok", 3, "a"), (1, "failed", 9, "b"), (1, "skipped", 2, "c"), (2, "failed", 4, "d"), (2, "failed", 5, "e"), (None, "ok", 1, "f"), (3, None, 7, "g"), (3, "failed", 8, "h"), (4, "failed", None, "i")]],
        "experiment_id string, model string, seed int, draw int, n int, k int, status string, seq long, note string")
    out = R.prefer_completed(rows)
    assert sorted((str(r.k), r.note) for r in out.collect()) == [("1", "a"), ("2", "e"), ("3", "g"), ("4", "i"), ("None", "f")]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "LeftSemi" in plan and "HashAggregate" in plan.replace("ObjectHashAggregate", "")


def test_compaction_streams_files(spark, tmp_path):
    path = str(tmp_path)
    for b in range(6):
        H.append_batch(spark.range(b * 100, b * 100 + 100).withColumn("v", F.lit(b)), path, f"{b:03d}")
    assert H.compact(spark, path, threshold=5, file_bytes=1 << 20) == 6
    got = spark.read.parquet(f"{path}/*")
    assert sorted(r.id for r in got.collect()) == list(range(600)) and len(H.batches(spark, path)) == 1
    assert len(got.inputFiles()) == 1
