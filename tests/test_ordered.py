import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import ordered as O


def test_digit_is_monotone(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(size=300) * 10.0 ** rng.integers(-300, 300, 300),
                        [0.0, 1.0, 2.0, 4.0, -1.0, 5e-324, 1.7e308, 1 - 1e-16, 8.0 - 1e-15]])
    df = spark.createDataFrame(pd.DataFrame({"v": np.sort(v)})).withColumn("d", O.order_digit(F.col("v")))
    got = df.orderBy("v").toPandas()["d"].to_numpy()
    assert (np.diff(got) >= 0).all()


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, with many ties."""
    rng = np.random.default_rng(1)
    g = np.where(rng.random(3000) < 0.8, "hot", rng.choice(["a", "b", "c"], 3000))
    v = np.round(rng.normal(size=3000) * 50, 1)
    pdf = pd.DataFrame({"g": g, "id": np.arange(3000), "v": v})
    return pdf, spark.createDataFrame(pdf)


def test_quantiles(skewed):
    pdf, df = skewed
    got = O.exact_quantiles(df, ["g"], "v", {"q10": 0.1, "q50": 0.5, "q93": 0.93}).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        for name, p in (("q10", 0.1), ("q50", 0.5), ("q93", 0.93)):
            assert got.loc[g, name] == pytest.approx(np.quantile(part["v"], p), abs=1e-9)


def test_quantiles_skip_null_and_single_value(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None)], "g string, v double")
    assert O.exact_quantiles(df, ["g"], "v", {"q": 0.5}).collect() == [("a", 1.0)]


def test_running(skewed):
    pdf, df = skewed
    got = O.ordered_running(df, ["g"], "v", {"c": F.lit(1)}, with_next=True).toPandas()
    for g, part in got.groupby("g"):
        part = part.sort_values("v").reset_index(drop=True)
        want = pdf[pdf.g == g].groupby("v").size().sort_index()
        assert (part["c"].to_numpy() == want.to_numpy()).all()
        assert (part["c_before"].to_numpy() == want.cumsum().to_numpy() - want.to_numpy()).all()
        assert (part["c_total"] == want.sum()).all()
        assert (part["next_value"].to_numpy()[:-1] == part["v"].to_numpy()[1:]).all()
        assert np.isnan(part["next_value"].to_numpy()[-1])


def _digest(g, i):
    return hashlib.md5(f"{g}|{i}".encode()).hexdigest()


def test_hash_rank_and_limit(skewed):
    pdf, df = skewed
    digest = O.seed_hash(F.col("g"), F.col("id"))
    want = {}
    for g, part in pdf.groupby("g"):
        for rk, i in enumerate(sorted(part["id"], key=lambda i: (_digest(g, i), i)), 1):
            want[i] = rk
    got = {r["id"]: r["rk"] for r in O.hash_rank(df, ["g"], digest, "id").collect()}
    assert got == want
    few = {r["id"]: r["rk"] for r in O.hash_rank(df, ["g"], digest, "id", limit=7).collect()}
    assert few == {i: rk for i, rk in want.items() if rk <= 7}


def test_hash_cut_takes_exactly(skewed):
    pdf, df = skewed
    digest = O.seed_hash(F.col("g"), F.col("id"))
    cut = O.hash_cut(df, ["g"], digest, "id", F.ceil(F.col("_n") * 0.3))
    inside = df.join(cut, "g").withColumn("t", O.before_cut(digest, "id")).groupBy("g").agg(
        F.count_if("t").alias("t"), F.max("n_take").alias("want"))
    assert all(r["t"] == r["want"] for r in inside.collect())


def test_rank_does_not_depend_on_partitions(skewed):
    _, df = skewed
    digest = O.seed_hash(F.col("g"), F.col("id"))
    one = O.hash_rank(df.coalesce(1), ["g"], digest, "id").select("id", "rk")
    many = O.hash_rank(df.repartition(7, "v"), ["g"], digest, "id").select("id", "rk")
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


def test_no_window_over_a_whole_group(skewed):
    """Row windows must be partitioned by the bucket as well as the group."""
    _, df = skewed
    plan = O.hash_rank(df, ["g"], O.seed_hash(F.col("g"), F.col("id")), "id")._jdf.queryExecution().optimizedPlan().toString()
    row_windows = [line for line in plan.splitlines() if "Window" in line and "row_number()" in line]
    assert row_windows and all("_b#" in line.split("row_number()")[1] for line in row_windows)


def test_narrow_values_far_from_zero_are_cut(spark):
    for low, width in ((1.7e9, 1e5), (1e6, 100.0)):
        v = low + np.linspace(0, width, 100_000)
        df = spark.createDataFrame(pd.DataFrame({"v": v})).select("v", F.lit("g").alias("g"), O.order_digit(F.col("v")).alias("_d"))
        assert df.select("_d").distinct().count() <= 2
        cut = O.spread(df, ["g"], "v").groupBy("_d", "_slice").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("_d", "_slice").collect()
        assert len(cut) > 300 and max(r.n for r in cut) < 2 * O.BUCKET_ROWS
        assert all(a.hi <= b.lo for a, b in zip(cut, cut[1:]))
        got = O.exact_quantiles(df, ["g"], "v", {"q": 0.37}).first().q
        assert got == pytest.approx(np.quantile(v, 0.37), rel=1e-12)


def test_quantiles_of_ties_that_fill_buckets(spark):
    v = np.repeat([1.0, 1.0 + 1e-9, 2.0, 1e6], [900, 5, 2000, 700])
    df = spark.createDataFrame(pd.DataFrame({"v": v})).withColumn("g", F.lit("g"))
    probs = {f"q{i}": p for i, p in enumerate((0.0, 0.2497, 0.2499, 0.25, 0.5, 0.81, 1.0))}
    got = O.exact_quantiles(df, ["g"], "v", probs).first()
    for name, p in probs.items():
        assert got[name] == pytest.approx(np.quantile(v, p), rel=1e-15)


def test_quantiles_read_their_input_twice(spark, tmp_path):
    """Once for the histogram, once for the rows of the wanted buckets; the rest is one exchange, reused."""
    spark.range(5000).selectExpr("id % 3 AS g", "rand(1) AS v").write.parquet(str(tmp_path / "t"))
    q = O.exact_quantiles(spark.read.parquet(str(tmp_path / "t")), ["g"], "v", {"m": 0.5})
    q.collect()
    final = q._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("Scan parquet") == 2 and "ReusedExchange" in final
