"""Model queries fit the library's full models in every cell of the design, above a task's size by Spark ML."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.catalog import model_queries as Q
from tidemark.operators import cells as C
from tidemark.operators import impute as I
from tidemark.operators import models as Z

SF = "/root/testdata/sf0.001"


class Mean:
    """Stands for a fitted model."""

    def transform(self, rows):
        return rows.withColumn("prediction", F.lit(1.0)).withColumn("probability", Z.array_to_vector(F.array(F.lit(0.25), F.lit(0.75))))


CALLS = {"random_forest": "fit", "boosted_cv": "fit_boosted_cv", "stacking_classifier": "classification_stack"}


@pytest.mark.parametrize("name", CALLS)
def test_every_cell_with_library_defaults(spark, monkeypatch, name):
    function = CALLS[name]
    seen = []

    def fake(*args, **kw):
        args = list(args) if function == "fit" else [function, *args]
        seen.append((args[2:], kw, len(args[1].first()["features"])))
        if len(seen) == 5:
            raise ValueError("a bad cell")
        return Mean() if "stack" in function else Z.Fitted(Mean(), {"best_rounds": 7})

    monkeypatch.setattr(Z, function, fake)
    monkeypatch.setattr(C, "MAX_VALUES", 0)  # every cell is too large for a task
    monkeypatch.setattr(Q, "_FITTED", {})
    out = entry.queries()[name](spark, SF)
    per = out.groupBy("seed", "draw", "n", "k").agg(F.count("row_id").alias("c"), F.max("error").alias("e")).collect()
    assert len({(r.seed, r.draw) for r in per}) == 4 and {r.k for r in per} == set(Q.K_GRID) and len(per) == len(seen) == 48
    bad = [r for r in per if r.e is not None]
    assert len(bad) == 1 and bad[0].c == 0 and "a bad cell" in bad[0].e and len({r.c for r in per} - {0}) == 1
    # Nothing but the seed is passed, so trees, rounds, folds and iterations are the library's.
    assert all(a == [3] and not kw for a, kw, _ in seen) and len({w for *_, w in seen}) > 1


def test_small_cells_are_fitted_in_one_plan(spark, monkeypatch):
    monkeypatch.setattr(Q, "_FITTED", {})
    monkeypatch.setitem(C.KINDS, "random_forest", C._forest(12, 5, 20, False, False))
    f = Q.fitted_cells(spark, SF, "random_forest")
    assert f.errors.isEmpty() and f.predictions.select(Q.CELL).distinct().count() == 48
    checks = Q.fit_checks(f, C.KINDS["random_forest"], ["in_range", "trees_whole"])
    assert checks.where("in_range and trees_whole").count() == 48
    assert Q.fitted_cells(spark, SF, "random_forest") is f


def test_a_design_without_any_fit_raises(spark, monkeypatch):
    monkeypatch.setattr(Q, "_FITTED", {})

    def broken(*args):
        raise ValueError("no luck")

    monkeypatch.setitem(C.KINDS, "ridge_classifier", C.Kind(broken, lambda part, x: x, classifier=True))
    with pytest.raises(RuntimeError, match="no cell could be fitted: no luck"):
        Q.fitted_cells(spark, SF, "ridge_classifier", "y_bin", standardized=True)


def test_scale_comes_from_training_rows(spark):
    train = spark.createDataFrame([(1, [0.0]), (1, [2.0])], "cell int, x array<double>")
    test = spark.createDataFrame([(1, [101.0])], "cell int, x array<double>")
    assert I.standardize(test, ["cell"], fitted_on=train).first()["x"] == [100.0]
