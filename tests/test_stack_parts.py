"""Stacks get the rows of a cell once; folds are dealt where the rows are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.ordered import seed_hash
from tidemark.operators import cells as C
from tidemark.operators.design import kfold_shuffled


@pytest.mark.parametrize("stratified", [False, True])
def test_folds_and_parts_of_a_cell(spark, stratified):
    train = spark.range(83).select(F.lit(1).alias("cell"), F.col("id").alias("row_id"), (F.col("id") % 3 == 0).cast("double").alias("label"),
                                   F.array(F.sin("id"), F.cos("id")).alias("features")).repartition(3)
    test = train.withColumn("row_id", F.col("row_id") + 1000).limit(20)
    stack = C.Stack(3, 5, stratified)
    rows = train.select("row_id", "label", stack.digest().alias("d")).toPandas()
    folds = dict(zip(rows.row_id.tolist(), stack.folds_of(rows.row_id.to_numpy(), rows.label.to_numpy(), rows.d.to_numpy()).tolist()))
    tagged = kfold_shuffled(train, ["cell", "label"] if stratified else ["cell"], seed_hash(3, "k", F.col("row_id")), "row_id", 5)
    assert folds == {r.row_id: r.fold for r in tagged.collect()}

    taken = C.part_cells(train, test, ["cell"], C.KINDS["ridge_classifier"], 3, stack).collect()
    assert {r.row_id: r.part for r in taken if r.part >= 0} == folds and len(taken) == 83 + 20 and all(r.error is None for r in taken)
    # As models that are fitted on rows repeated for every part.
    for part in (-1, 2):
        own = train.where(~F.col("row_id").isin([i for i, f in folds.items() if f == part]))
        scored = test if part < 0 else train.where(F.col("row_id").isin([i for i, f in folds.items() if f == part]))
        models = C.fit_cells(own, ["cell"], C.KINDS["ridge_classifier"], 3)
        want = {r.row_id: r.y_pred for r in C.predict_cells(models, scored, ["cell"], C.KINDS["ridge_classifier"]).collect()}
        assert {r.row_id: r.y_pred for r in taken if r.part == part} == pytest.approx(want)


def test_a_stack_shuffles_no_repeated_rows(spark):
    train = spark.range(400).select(F.lit(1).alias("cell"), F.col("id").alias("row_id"), F.sin("id").alias("label"), F.array(F.sin("id"), F.cos("id")).alias("features"))
    bases = {"ridge": C.KINDS["ridge"], "extra_trees": C._forest(3, 5, 4, True, False)}
    plans = []

    def keep(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df.localCheckpoint()

    preds, weights, errors = C.stack_cells(train, train, ["cell"], "stack", 3, keep_models=keep, bases=bases)
    assert preds.count() == 400 and errors.isEmpty() and np.all(np.array(weights.first()["weights"]) >= 0)
    assert not any("part" in p and "sequence(-1" in p for p in plans) and not any("Window" in p for p in plans)
