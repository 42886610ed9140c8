import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions import scalars as X
from tidemark.operators import checks as V
from tidemark.operators import encode as E
from tidemark.operators import joins as J
from tidemark.operators import profile as P
from tidemark.operators.design import Source
from tidemark.sources import tables as T


@pytest.fixture(scope="module")
def survey(spark):
    rows = []
    for i in range(120):
        pool = "train" if i < 100 else "test"
        cat = "2" if i >= 118 else ("-2" if i % 20 == 0 else str(i % 2))
        cont = "-1" if i % 10 == 0 else ("" if i % 15 == 1 else str(1000 + i * 3))
        rows.append((1000 + i, pool, cont, cat, str(i % 4), "5"))
    return spark.createDataFrame(rows, "id long, pool string, continuous string, category string, small string, constant string")


COLUMNS = ["continuous", "category", "small", "constant"]


def sources(df):
    return P.collect_sources(df.where("pool = 'train'"), COLUMNS)


def test_screening_and_encoders(survey):
    found = sources(survey)
    assert [s.column for s in found] == ["continuous", "category", "small"]
    assert [s.status for s in found] == ["numeric", "categorical", "categorical"]
    one = E.ENCODERS["median_mode"](survey, "id", found)
    late = one.features.where("id = 1119").first()
    assert late["C_category__0"] is None and late["C_category__1"] is None
    tree = E.ENCODERS["tree_ordinal"](survey, "id", found)
    assert tree.features.where("id = 1003").first()["C_small"] == 3.0
    marked = E.ENCODERS["median_missing_indicator"](survey, "id", found)
    names = [s.name for s in marked.sources]
    assert names.index("continuous__missing__code_-1") == names.index("continuous") + 1
    assert V.check_features_match(one.features, one.manifest(), "id")
    assert E.same_sources(one.manifest(), tree.manifest()).first()["same"]


def test_test_rows_cannot_change_the_profile(survey):
    changed = survey.withColumn("category", F.when(F.col("pool") == "test", "9").otherwise(F.col("category")))
    assert sources(changed) == sources(survey)


def test_unknown_counts(survey):
    qa = E.unknown_category_qa(survey, survey.where("pool = 'test'").select("id"), "id", sources(survey))
    row = {r["source_column"]: r for r in qa.collect()}["category"]
    assert (row["unknown_count"], row["denominator"]) == (2, 19)


def test_strict_boolean(spark):
    df = spark.createDataFrame([(" True ",), ("false",)], "v string")
    assert [r[0] for r in df.select(X.strict_boolean(F.col("v"))).collect()] == [True, False]
    with pytest.raises(PySparkException):
        spark.createDataFrame([("yes",)], "v string").select(X.strict_boolean(F.col("v"))).collect()


def test_unique_names(spark):
    df = spark.createDataFrame([(["x", "x_2", "x", "x"],)], "h array<string>")
    assert df.select(X.unique_names(F.col("h"))).first()[0] == ["x", "x_2", "x_3", "x_4"]


def test_one_to_one(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (3,)], "id int")
    right = spark.createDataFrame([(1,), (2,), (2,)], "id int")
    got = {r["kind"]: r["n"] for r in J.one_to_one_violations(left, right, "id").collect()}
    assert got == {"duplicate_left": 1, "duplicate_right": 1, "unmatched": 1}


def test_contract_raises_with_example(spark):
    df = spark.createDataFrame([(0.5, 0.5), (1.0, None), (1.0, 1.0), (0.0, 1.0)], "a double, b double").withColumn(
        "row_id", F.monotonically_increasing_id())
    group = [Source("g", "onehot_group", ["a", "b"], reference_feature="a", reference_level="a", level_values=["a", "b"])]
    bad = V.check_onehot(df, group, "row_id")
    assert bad.first()["n"] == 3
    with pytest.raises(V.ContractError, match="illegal_onehot_state"):
        V.assert_valid(bad)
    V.assert_valid(V.empty(spark))


def test_types_and_header_groups(spark):
    df = spark.createDataFrame([("a", 1.0)], "s string, x double")
    assert V.numeric_types(df, ["s", "x"]) == ["s"]
    groups = E.groups_from_header(["A_age", "A_color_0", "A_color_1"], prefix="A")
    assert [(g.name, len(g.features)) for g in groups] == [("A_age", 1), ("A_color", 2)]
    with pytest.raises(ValueError):
        E.groups_from_header(["A_c_0", "A_c_1", "A_x", "A_c_2", "A_c_3"])


def test_predictors(spark):
    assert T.resolve_predictors(["y", "x_b", "x_a"], prefixes=["x_"]) == ["x_b", "x_a"]
    for bad in ({"prefixes": ["q"]}, {"predictors": ["zz"]}, {"predictors": ["y"], "protected": ["y"]}):
        with pytest.raises(ValueError):
            T.resolve_predictors(["y", "x_b", "x_a"], **bad)


def test_csv_manifest_and_json(spark, tmp_path):
    manifest = E.manifest_frame(spark, [Source("g", "onehot_group", ["a", "b"], reference_feature="a",
                                               reference_level="0", level_values=["0", "1"])])
    path = str(tmp_path / "m.csv")
    T.write(manifest, path)
    back = T.read_manifest(spark, path)
    assert back.count() == 2 and dict(back.dtypes)["keep"] == "boolean"
    assert T.header(spark, path) == manifest.columns
    T.write_json(spark, {"b": 1, "a": [1, 2]}, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"a":[1,2],"b":1}'
    with pytest.raises(ValueError):
        T.canonical_json({"a": float("nan")})


def test_mask_unseen(spark):
    src = [Source("o", "ordinal", ["o"], ordinal_levels=[1.0, 2.0, 3.0])]
    rows = spark.createDataFrame(
        [("p", "train", 1, 1.0, [1.0]), ("p", "train", 2, None, [2.0]), ("p", "test", 3, 1.0, [2.0]),
         ("p", "test", 4, None, [3.0]), ("p", "test", 5, 2.0, [1.0])],
        "outcome string, role string, row_id int, y double, x array<double>")
    masked, qa = E.mask_unseen(rows, src)
    got = {r["row_id"]: r["x"][0] for r in masked.collect()}
    assert got == {1: 1.0, 2: 2.0, 3: None, 4: 3.0, 5: 1.0}
    assert qa.first()["unknown_count"] == 1 and qa.first()["denominator"] == 2
