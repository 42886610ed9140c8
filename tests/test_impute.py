import pytest
from pyspark.sql import functions as F

from tidemark.operators import impute as I
from tidemark.operators.design import Source

SOURCES = [
    Source("x", "continuous", ["x"], prior=10.0),
    Source("o", "ordinal", ["o"], ordinal_levels=[1.0, 2.0, 3.0], prior=1.0),
    Source("c", "onehot_group", ["c0", "c1"], level_values=["a", "b"], reference_level="ref", drop_first=True),
]


def rows(spark, values):
    df = spark.createDataFrame([(1, i, *[None if c is None else float(c) for c in v]) for i, v in enumerate(values)],
                               "cell int, row_id int, x double, o double, c0 double, c1 double")
    return I.assemble(df, ["x", "o", "c0", "c1"])


def run(spark, train, test, passthrough=False, **how):
    fills = I.fit_fills(rows(spark, train), ["cell"], SOURCES, **how)
    out = I.apply_fills(rows(spark, test), I.pack_fills(fills, ["cell"]), ["cell"], SOURCES, passthrough, n_cells=1)
    return [r["x"] for r in out.orderBy("row_id").select("x").collect()], fills


N = None


def test_ties(spark):
    train = [(1, 1, 1, 0), (3, 2, 0, 1), (N, N, N, N)]
    got, _ = run(spark, train, [(N, N, N, N)], ordinal="median")
    assert got == [[2.0, 1.0, 1.0, 0.0]]


def test_reference_wins_tie(spark):
    got, _ = run(spark, [(1, 1, 0, 0), (1, 1, 1, 0), (1, 1, N, N)], [(1, 1, N, N)])
    assert got[0][2:] == [0.0, 0.0]


def test_unobserved_overwrites_both_sides(spark):
    train = [(N, 1, 0, 0), (N, 2, 0, 1)]
    got, fills = run(spark, train, [(999, 1, 0, 1), (N, 1, 0, 1)])
    assert [g[0] for g in got] == [10.0, 10.0]
    chosen = spark.createDataFrame([(1, 3, s) for s in range(3)], "cell int, k int, src int")
    seen = fills.join(chosen, ["cell", "src"]).where(~F.col("observed")).count()
    assert seen == 1


def test_passthrough_unobserved_is_null(spark):
    got, _ = run(spark, [(N, 1, 0, 0), (N, 2, 0, 1)], [(999, N, 0, 1)], passthrough=True)
    assert got == [[N, N, 0.0, 1.0]]


def test_mode_tie_follows_declared_order(spark):
    src = [Source("o", "ordinal", ["o"], ordinal_levels=[3.0, 1.0, 2.0])]
    df = I.assemble(spark.createDataFrame([(1, 1.0), (1, 3.0)], "cell int, o double"), ["o"])
    assert I.fit_fills(df, ["cell"], src).first()["fill"] == 3.0


def test_fill_comes_from_the_cell(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, 3.0), (2, 0, 1.0), (2, 1, 3.0), (2, 2, 100.0)],
                               "cell int, row_id int, x double")
    fills = I.fit_fills(I.assemble(df, ["x"]), ["cell"], SOURCES[:1])
    assert {r["cell"]: r["fill"] for r in fills.collect()} == {1: 2.0, 2: 3.0}


def test_standardize_constant(spark):
    df = I.assemble(spark.createDataFrame([(1, 5.0, 1.0), (1, 5.0, 3.0)], "cell int, a double, b double"), ["a", "b"])
    got = sorted(r["x"] for r in I.standardize(df, ["cell"]).collect())
    assert got == [[0.0, -1.0], [0.0, pytest.approx(1.0)]]


def test_compiled_manifests_give_what_walked_ones_give(spark, monkeypatch):
    sources = [Source("a", "continuous", ["a"]), Source("m", "ordinal", ["m"], ordinal_levels=[2.0, 1.0]),
               Source("g", "onehot_group", ["g0", "g1"], level_values=["0", "1"], reference_level="0", reference_feature="g0"),
               Source("d", "onehot_group", ["d0"], level_values=["0"], reference_level="r", drop_first=True), Source("u", "continuous", ["u"])]
    rows = [(c, [float(i) if i % 3 else None, [1.0, 2.0, None][i % 3], *([None, None] if i % 5 == 0 else [[1.0, 0.0], [0.0, 1.0]][i % 2]),
                 None if i % 4 == 0 else float(i % 3 == 0), None if c else float(i)]) for c in (0, 1) for i in range(20)]
    df = spark.createDataFrame(rows, "cell int, x array<double>")

    def found():
        fills = I.fit_fills(df, ["cell"], sources)
        packed = I.pack_fills(fills, ["cell"])
        out = [I.units(df, ["cell"], sources), fills, *[I.apply_fills(df, packed, ["cell"], sources, p) for p in (False, True)]]
        return [sorted(map(str, part.collect())) for part in out], [[f.dataType for f in part.schema] for part in out]

    (compiled, types), plan = found(), I.apply_fills(df, I.pack_fills(I.fit_fills(df, ["cell"], sources), ["cell"]), ["cell"], sources)
    assert "lambda" not in plan._jdf.queryExecution().analyzed().toString().split("Join")[0]  # nothing is walked row by row
    monkeypatch.setattr(I, "MAX_COMPILED_FEATURES", 0)
    walked, other = found()
    assert compiled == walked and [str(t) for t in types] == [str(t) for t in other]
