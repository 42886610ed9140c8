"""Samples from digest cuts: the rows of an exact ranking, without moving them."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import design as D
from tidemark.operators import impute as I
from tidemark.operators import linear as L
from tidemark.operators.design import Source
from tidemark.plans import sweep as S


@pytest.mark.parametrize("n_grid", [None, [3, 40, 900]])
def test_cuts_give_the_rows_and_folds_of_exact_ranks(spark, n_grid):
    rows = spark.createDataFrame([(7 * i, float(i) if i % 9 else None) for i in range(500)], "row_id long, y double")
    s = S.sample_rows(rows, "y", [5, 6], [0, 1, 2], n_grid=n_grid)
    split = D.split_random(rows.where("y is not null"), [5, 6], 0.2)
    exact = D.nested_prefix(D.row_ranks(split.where("role = 'train'"), [0, 1, 2]), s.n_grid)
    columns = ["seed", "draw", "n", "row_id", "fold"]
    got, want = [L.with_fold(df).select(columns).collect() for df in (s.train, exact)]
    assert sorted(got) == sorted(want) and len(set(got)) == len(got)
    tests = split.where("role = 'test'").select("seed", "row_id").collect()
    assert sorted(s.test.select("seed", "row_id").collect()) == sorted(tests)
    s.release()


def test_samples_shuffle_no_repeated_rows(spark):
    rows = spark.range(300).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("y"))
    s = S.sample_rows(rows, "y", [1, 2], [0, 1], n_grid=[10, 100])
    plan = s.train._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan.split("InMemoryRelation")[0] and len(s.held) == 1
    assert s.held[0].count() == 300  # each row once, whatever the number of repeats
    s.release()


def test_a_task_keeps_the_products_of_more_than_64_folds(spark):
    rng = np.random.default_rng(0)
    n = 4000
    pdf = pd.DataFrame({"seed": np.arange(n) % 100, "fold": 0, "x": list(rng.normal(size=(n, 2)).tolist()), "y": rng.normal(size=n)})
    train = spark.createDataFrame(pdf).coalesce(1)
    long = L.gram(train, ["seed"], features=2)
    with_rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
        got = {(r.seed, r.i, r.j): r.v for r in long.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", with_rows)
    z = np.column_stack([np.ones(n), np.stack(pdf["x"]), pdf["y"]])
    own = z[pdf["seed"] == 7]
    assert got[7, 1, 3] == pytest.approx((own.T @ own)[1, 3]) and len(got) == 100 * 10
    assert L.MAX_HELD_BYTES > 100 * 4 * 4 * 8


def test_median_levels_and_modes_from_counts(spark):
    sources = [Source("o", "ordinal", ["o"], ordinal_levels=[3.0, 1.0, 2.0]), Source("g", "onehot_group", ["g0", "g1"], level_values=["0", "1"], reference_level="0", reference_feature="g0")]
    rows = spark.createDataFrame([(1, [2.0, 0.0, 1.0]), (1, [3.0, 0.0, 1.0]), (1, [3.0, 1.0, 0.0]), (1, [2.0, 1.0, 0.0]), (1, [None, None, None])], "cell int, x array<double>")
    fills = {r.src: r.fill for r in I.fit_fills(rows, ["cell"], sources).collect()}
    assert fills == {0: 3.0, 1: 0.0}  # ties: the level declared first, the reference
    assert [r.fill for r in I.fit_ordinal(I.units(rows, ["cell"], sources, kinds=["ordinal"]), ["cell"], sources, "median").collect()] == [2.0]
    seen = I.fit_seen(rows, ["cell"], sources).collect()
    assert {r.src: (r.fill, r.observed) for r in seen} == {0: (None, True), 1: (None, True)}
