"""Faults that must be found: absent models, gaps, unmatched keys, ambiguous identities."""

import pytest
from pyspark.sql import functions as F

from tidemark import session
from tidemark.operators import checks as V
from tidemark.operators import profile as P
from tidemark.operators import results as R
from tidemark.plans.adapt import adapt
from tidemark.sources import tables as T


def test_a_model_without_rows_stops_its_panel(spark):
    ddl = "panel string, model string, seed int, draw int, n int, k int"
    want = spark.createDataFrame([("p", m, 1, 0, 10, 1) for m in "ab"] + [("q", "a", 1, 0, 10, 1)], ddl)
    rows = want.where("not (panel = 'p' and model = 'b')").withColumn("status", F.lit("ok"))
    models = R.finalize_model(rows, want)
    got = {(r.panel, r.model): (r.publishable, r.missing, r.violation) for r in models.collect()}
    assert got == {("p", "a"): (True, 0, None), ("p", "b"): (False, 1, "empty_denominator"), ("q", "a"): (True, 0, None)}
    assert {r.panel: (r.n_models, r.passed) for r in R.publish_panel(models).collect()} == {"p": (2, False), "q": (1, True)}


def test_order_is_checked_across_gaps_and_slices(spark, monkeypatch):
    monkeypatch.setattr(R, "ORDER_SLICE", 4)
    rows = [(1, "b"), (3, "a"), (9, "c"), (10, "c"), (40, "d"), (90, "a")]
    got = {r.kind: (r.n, r.first_pos) for r in R.order_violations(spark.createDataFrame(rows, "pos long, key string"), "pos", ["key"]).collect()}
    assert got == {"unordered": (2, 3), "duplicate": (1, 10)}


def test_identity_tells_rows_apart(spark):
    def digest(*row):
        return tuple(T.content_identity(spark.createDataFrame([row], "a string, b string")).first())

    assert len({digest("a|b", "c"), digest("a", "b|c"), digest(None, "~"), digest("~", None), digest("-", "~"), digest("", "1:a")}) == 6


def test_paths_of_any_depth(spark):
    ddl = "id int, doc string"
    left = V.flatten_paths(spark.createDataFrame([(1, '{"a":{"b":{"c":1,"d":{}}},"e":null}'), (2, '{"x":null}'), (3, "{}")], ddl), "id", "doc")
    right = V.flatten_paths(spark.createDataFrame([(1, '{"a":{"b":{"c":2,"d":{}}},"e":null}'), (2, '{"y":1}'), (3, "{}")], ddl), "id", "doc")
    got = {r.id: (r.path, r.n_paths) for r in V.contract_diff(left, right, "id").collect()}
    assert got == {1: ("a.b.c", 1), 2: ("x", 2)}


def test_ordinal_manifests(spark):
    ddl = "source_column string, source_order int, feature_order int, unit_type string, drop_first boolean, is_reference boolean, level_value string, reference_level string, ordinal_levels string, source_prior double"
    rows = [(c, i, 0, "ordinal", False, False, None, None, levels, prior)
            for i, (c, levels, prior) in enumerate([("ok", "[1,2,3]", 2.0), ("twice", "[1,1]", 1.0), ("none", None, None), ("outside", "[1,2]", 5.0)])]
    got = {r.subject: (r.example, r.n) for r in V.check_manifest(spark.createDataFrame(rows, ddl)).collect()}
    assert got == {"ordinal_levels_unfit": ("none", 2), "prior_not_a_level": ("outside", 1)}


def test_level_names(spark):
    tokens, suffixes = P.level_names(spark, {"q": [(1.0, True), (1.5, True), (-2.0, True)]}, {"q": {1.0: "Yes, always", 1.5: "no"}})
    assert tokens == {"q": {1.0: "1", 1.5: "v_1_5", -2.0: "-2"}}
    assert suffixes["q"][1.0] == "1__Yes_always" and suffixes["q"][1.5] == "v_1_5__no"


def test_adapt_raises_on_unmatched_and_repeated_keys(spark):
    raw = spark.createDataFrame([(i, "train" if i % 3 else "test", str(i % 4), str(i * 1.5)) for i in range(60)], "id long, pool string, q string, v string")
    good = spark.createDataFrame([(i, float(i)) for i in range(60)], "id long, y double")
    assert adapt(raw, good, "id", "pool", ["q", "v"], ["y"]).rows.count() == 60
    with pytest.raises(V.ContractError, match="duplicate_left"):
        adapt(raw, good.unionByName(good.where("id = 5")), "id", "pool", ["q", "v"], ["y"])


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
