import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import calibration as C
from tidemark.operators import results as R
from tidemark.sources import shards as H
from tidemark.streaming import ingest as G

DDL = "experiment_id string, model string, seed int, draw int, n int, k int, status string, seq long, rmse double"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([
        ("e", "m", 0, 0, 10, 1, "ok", 1, 0.0), ("e", "m", 0, 0, 10, 1, "failed", 2, 9.0),
        ("e", "m", 1, 0, 10, 1, "failed", 1, 9.0), ("e", "m", 1, 0, 10, 1, "ok", 3, 1.0),
        ("e", "m", 1, 0, 10, 1, None, 4, 2.0), ("e", "m", 2, 0, 10, 1, "failed", 5, 7.0),
        ("e", "m", 3, 0, 10, 1, "skipped", 6, None)], DDL)


def best(df):
    return {r["seed"]: (r["status"], r["rmse"]) for r in df.collect()}


WANT = {0: ("ok", 0.0), 1: (None, 2.0), 2: ("failed", 7.0), 3: ("skipped", None)}


def test_dedupe(rows):
    assert best(R.prefer_completed(rows)) == WANT


def test_policy_and_status(spark, rows):
    p = R.failure_policy(R.prefer_completed(rows), ["model"]).first()
    assert (p["ok"], p["skipped"], p["failed"], p["denominator"], p["violation"]) == (2, 1, 1, 3, "failed_ratio")
    only = R.failure_policy(rows.where("status = 'skipped'"), ["model"]).first()
    assert only["violation"] == "empty_denominator" and not only["passed"]
    want = spark.createDataFrame([("m", 4), ("z", 1)], "model string, expected long")
    got = {r["model"]: r["status"] for r in R.completion_status(R.prefer_completed(rows), want, ["model"]).collect()}
    assert got == {"m": "complete_with_failures", "z": "incomplete"}


def test_numeric_diagnostics_cover_all_statuses(rows):
    r = R.diagnostics_numeric(rows, ["model"], ["rmse"]).first()
    assert (r["count"], r["median"], r["max"]) == (6, 4.5, 9.0)


def test_shards_compact_and_read(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    for i, seq in enumerate((1, 2, 3, 4)):
        assert H.append_batch(rows.where(F.col("seq") == seq), path, f"{i:03d}")
    assert not H.append_batch(rows.where("seq < 0"), path, "009")
    before = sorted(H.read_shards(spark, path).select("seed", "seq").collect())
    assert H.compact(spark, path, threshold=9) == 0
    assert H.compact(spark, path, threshold=4) == 4
    assert len(H.batches(spark, path)) == 1
    assert sorted(H.read_shards(spark, path).select("seed", "seq").collect()) == before


def test_shard_order(spark):
    names = ["part-0002000000000-b", "zlegacy", "part-0001000000000-c", "alegacy"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.orderBy(H.shard_order(F.col("n"))).collect()]
    assert got == ["alegacy", "zlegacy", "part-0001000000000-c", "part-0002000000000-b"]


def test_stream_equals_batch(spark, rows, tmp_path):
    path = str(tmp_path / "s")
    for i in range(1, 7):
        H.append_batch(rows.where(F.col("seq") == i), path, f"{i:03d}")
    stream = G.shard_stream(spark, path, rows.schema, 1)
    G.upsert(stream, str(tmp_path / "u"), str(tmp_path / "cu"))
    assert best(G.read_upserted(spark, str(tmp_path / "u"))) == WANT
    assert G.read_upserted(spark, str(tmp_path / "u")).count() == len(WANT)

    def run(stop_after=None):
        return G.run_batches(G.shard_stream(spark, path, rows.schema, 1), str(tmp_path / "r"), str(tmp_path / "cr"), stop_after)

    assert run(2) == 2 and len(H.batches(spark, str(tmp_path / "r"))) == 2
    assert 0 < run(999) < 999 and run() == 0  # more than there are: it ends
    assert spark.read.parquet(str(tmp_path / "r")).count() == rows.count()


def test_upsert_goes_on_and_keeps_one_version(spark, rows, tmp_path):
    path, table, position = str(tmp_path / "s"), str(tmp_path / "u"), str(tmp_path / "c")
    for part in (range(1, 4), range(4, 7)):
        for i in part:
            H.append_batch(rows.where(F.col("seq") == i), path, f"{i:03d}")
        G.upsert(G.shard_stream(spark, path, rows.schema, 1), table, position, buckets=3)
    assert best(G.read_upserted(spark, table)) == WANT
    assert spark.read.parquet(table).count() == len(WANT) and len(list((tmp_path / "u").glob("bucket=*"))) <= 3


def test_order_without_a_sequence_column(spark, rows, tmp_path):
    path = str(tmp_path / "s")
    for i in (6, 2, 5, 1, 3, 4):  # written in another order than named
        H.append_batch(rows.where(F.col("seq") == i).drop("seq"), path, f"{i:09d}")
    got = R.prefer_completed(H.in_shard_order(spark, path))
    want = R.prefer_completed(rows)
    kept = [c for c in rows.columns if c != "seq"]
    assert sorted(map(str, got.select(kept).collect())) == sorted(map(str, want.select(kept).collect()))
    assert H.checkpoint_index(spark, path, sequence=None).count() == want.count()


def test_power_law_recovers_exactly(spark):
    pts = [("m", n, k, float(np.exp(-3) * k**1.3 * n**0.7)) for n in (10, 100, 1000) for k in (2, 8, 32)]
    pts += [("short", 10, 1, 1.0), ("short", 20, 1, 2.0)]
    df = spark.createDataFrame(pts, "model string, n int, k int, seconds double")
    fits = {r["model"]: r for r in C.fit_power_law(df, ["model"], "seconds").collect()}
    assert set(fits) == {"m"}
    assert fits["m"]["a"] == pytest.approx(1.3) and fits["m"]["b"] == pytest.approx(0.7)
    assert fits["m"]["log_c"] == pytest.approx(-3.0) and fits["m"]["r2"] == pytest.approx(1.0)


def test_carry_forward_and_ties(spark):
    cur = spark.createDataFrame([("a", None), ("b", 2.0)], "model string, t double")
    old = spark.createDataFrame([("a", 7.0), ("b", 9.0)], "model string, t double")
    assert dict(R.carry_forward(cur, old, "model", ["t"]).collect()) == {"a": 7.0, "b": 2.0}
    scores = spark.createDataFrame([(3, 0, 1.0), (1, 0, 1.0), (2, 0, 5.0)], "alpha int, fold int, s double")
    assert R.cv_argmin(scores.withColumn("g", F.lit(1)), ["g"], "alpha", "s").first()["alpha"] == 1


def test_many_batches_are_written_by_one_job(spark, tmp_path):
    path = str(tmp_path / "many")
    rows = spark.range(900).select((F.col("id") % 7).alias("key"), F.col("id").alias("seq"), F.col("id").alias("value"), F.lit("ok").alias("status")).repartition(5)
    H.append_batches(rows, path, F.lpad(F.floor(F.col("seq") / 100).cast("string"), 9, "0"), "seq")
    assert H.batches(spark, path) == [f"batch={i:09d}" for i in range(9)]
    assert all(len(list((tmp_path / "many" / b).glob("*.parquet"))) == 1 for b in H.batches(spark, path))
    got = R.prefer_completed(H.in_shard_order(spark, path), ["key"]).collect()
    assert {r.key: r.value for r in got} == {v % 7: v for v in range(893, 900)}
