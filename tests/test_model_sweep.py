"""Sweeps of named models: rules and samples. Whole sweeps are compared with SQL by tools/check.py."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cells as C
from tidemark.operators.design import Source
from tidemark.plans import model_sweep as W
from tidemark.plans import sweep as S
from tidemark.sources import shards as H

SOURCES = [Source("a", "continuous", ["a"]), Source("b", "continuous", ["b"]), Source("never", "continuous", ["c"])]


def rows(spark, n, low=0):
    r = np.random.default_rng(low)
    return spark.createDataFrame([(low + i, float(2 * a + b), [float(a), None if i % 9 == 0 else float(b), None]) for i, (a, b) in enumerate(r.normal(size=(n, 2)))],
                                 "row_id long, y double, x array<double>")


def test_models_by_name():
    assert W.make_model("lightgbm", "classification").rows == "passthrough"
    assert all(m.kind == "linear" or m.kind in C.KINDS or m.kind in C.BASES for task in W.MODELS.values() for m in task.values())
    with pytest.raises(KeyError, match="regression has no model neural_net"):
        W.make_model("neural_net", "regression")


def test_external_sample_skips_and_resumes(spark, tmp_path):
    s = W.external_sample(rows(spark, 60), rows(spark, 20, 1000), "y", [1, 2], [0], n_grid=[3, 60])
    assert s.train.groupBy("seed", "n").count().count() == 4 and s.test.count() == 40
    out = W.model_sweep(s, SOURCES, [1, 3], ["lightgbm", "random_forest"], "e", metrics=["rmse", "r2_test"]).persist()
    first = {(r.seed, r.draw): r.src for r in W.selected_sources(s, SOURCES, [1]).collect()}
    assert out.count() == 16 and out.select("model", *W.CELL).distinct().count() == 16
    for r in out.collect():
        want = "all_sources_unobserved" if r.k == 1 and first[r.seed, r.draw] == 2 else "below_cv_floor" if r.model == "lightgbm" and r.n == 3 else None
        assert r.error == want and (r.rmse is None) == (want is not None) and r.status == ("ok" if want is None else "skipped")
        assert r.k_unobserved == (r.k == 3 or first[r.seed, r.draw] == 2) and r.n_train_rows == r.n and r.n_test_total == 20
    best = out.where("model = 'lightgbm' and n = 60 and k = 3").collect()
    assert all(r.best_rounds >= 1 and r.converged for r in best)
    path = str(tmp_path / "shards")
    H.append_batch(out.withColumn("seq", F.lit(0).cast("bigint")).withColumn("status", F.when(F.col("n") == 60, "failed").otherwise(F.col("status"))).where("model = 'random_forest'"), path, "001")
    again = W.resume_sweep(s, SOURCES, [1, 3], ["random_forest"], "e", path, "002", metrics=["rmse"])
    assert again == out.where("model = 'random_forest' and n = 60").count()
    assert W.resume_sweep(s, SOURCES, [1, 3], ["random_forest"], "e", path, "003") == 0


def test_features_of_the_first_sources(spark):
    s = S.sample_rows(rows(spark, 40), "y", [1], [0], n_grid=[10])
    chosen = W.selected_sources(s, SOURCES, [1, 2])
    got = W._features(s.train, chosen, SOURCES, "y")
    order = [r.src for r in chosen.where("k = 2").collect()]
    one = {r.row_id: r.features for r in got.where("k = 1").collect()}
    two = {r.row_id: r.features for r in got.where("k = 2").collect()}
    own = {r.row_id: r.x for r in s.train.collect()}
    assert len(one) == 10 and all(two[i] == [own[i][p] for p in sorted(order)] for i in own)


def test_the_smallest_sample_holds_every_class(spark):
    rows = spark.createDataFrame([(i, int(i % 20 == 0)) for i in range(400)], "row_id long, y int")
    s = S.sample_rows(rows, "y", list(range(8)), [0, 1], 0.2, min_n=5, stratified=True)
    got = s.train.groupBy("seed", "draw", "n").agg(F.count_distinct("row_id").alias("c"), F.count_distinct("y").alias("classes")).collect()
    assert len(got) == 8 * 2 * 4 and all(r.c == r.n and r.classes == 2 for r in got)
    # Only repeats whose first rows were of one class changed, by two rows.
    plain = S.D.row_ranks(s.held[0].select("row_id", "y", "seed").distinct(), [0, 1])
    both = plain.select("seed", "draw", "row_id", F.col("rk").alias("was")).join(S.D.swap_ranks(s.held[0], s.held[2]), ["seed", "draw", "row_id"])
    moved = both.where("rk <> was").groupBy("seed", "draw").count().collect()
    lacking = {(r.seed, r.draw) for r in plain.where("rk <= 5").groupBy("seed", "draw").agg(F.max("y").alias("m")).where("m = 0").collect()}
    assert {(r.seed, r.draw) for r in moved} == lacking and len(lacking) > 5 and {r["count"] for r in moved} == {2}
    s.release()
