"""Derived inputs over the given tables, for Spark and as CTE text for the SQL checks.

``ard``        analysis-ready rows from orders and customer
``preds``      regression predictions, three models and two seeds over all orders
``cpreds``     classification scores with ties, two seeds over all orders
``ckpt``       sweep-result rows from events, many per key
``raw_survey`` coded survey columns from customer
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.design import Source

CELL = ["model", "seed", "draw", "n", "k"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Sources of `ard` in manifest order.
ARD_SOURCES = [
    Source("acctbal", "continuous", ["x_acctbal"]),
    Source("custkey", "continuous", ["x_custkey"]),
    Source("month", "ordinal", ["o_month"], ordinal_levels=[float(m) for m in range(1, 13)]),
    Source("segment", "onehot_group", ["seg_0", "seg_1", "seg_2"],
           level_values=["0", "1", "2"], reference_level="0", reference_feature="seg_0"),
    Source("priority", "onehot_group", ["pri_0", "pri_1"],
           level_values=["0", "1"], reference_level="ref", drop_first=True),
]
ARD_FEATURES = [f for s in ARD_SOURCES for f in s.features]


def ard(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    key = F.col("o_orderkey")

    def unless(step: int, value):
        return F.when(key % step == 0, None).otherwise(value)

    def flag(cond):
        return F.when(cond, 1.0).otherwise(0.0)

    seg, pri = F.col("c_mktsegment"), F.col("o_orderpriority")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        key.alias("row_id"),
        unless(23, F.col("o_totalprice")).alias("y"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y_bin"),
        unless(7, F.col("c_acctbal")).alias("x_acctbal"),
        F.col("o_custkey").cast("double").alias("x_custkey"),
        unless(11, F.month("o_orderdate").cast("double")).alias("o_month"),
        unless(13, flag(seg == "AUTOMOBILE")).alias("seg_0"),
        unless(13, flag(seg == "BUILDING")).alias("seg_1"),
        unless(13, flag(~seg.isin("AUTOMOBILE", "BUILDING"))).alias("seg_2"),
        unless(17, flag(pri == "2-HIGH")).alias("pri_0"),
        unless(17, flag(pri == "5-LOW")).alias("pri_1"),
    )


ARD_SQL = """ard AS (
SELECT o.o_orderkey AS row_id,
  CASE WHEN o.o_orderkey % 23 = 0 THEN NULL ELSE o.o_totalprice END AS y,
  CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS y_bin,
  CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE c.c_acctbal END AS x_acctbal,
  CAST(o.o_custkey AS DOUBLE) AS x_custkey,
  CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE CAST(month(o.o_orderdate) AS DOUBLE) END AS o_month,
  CASE WHEN o.o_orderkey % 13 = 0 THEN NULL WHEN c.c_mktsegment = 'AUTOMOBILE' THEN 1.0E0 ELSE 0.0E0 END AS seg_0,
  CASE WHEN o.o_orderkey % 13 = 0 THEN NULL WHEN c.c_mktsegment = 'BUILDING' THEN 1.0E0 ELSE 0.0E0 END AS seg_1,
  CASE WHEN o.o_orderkey % 13 = 0 THEN NULL WHEN c.c_mktsegment NOT IN ('AUTOMOBILE','BUILDING') THEN 1.0E0 ELSE 0.0E0 END AS seg_2,
  CASE WHEN o.o_orderkey % 17 = 0 THEN NULL WHEN o.o_orderpriority = '2-HIGH' THEN 1.0E0 ELSE 0.0E0 END AS pri_0,
  CASE WHEN o.o_orderkey % 17 = 0 THEN NULL WHEN o.o_orderpriority = '5-LOW' THEN 1.0E0 ELSE 0.0E0 END AS pri_1
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = F.array(
        *[
            F.struct(F.lit(m).alias("model"), F.lit(s).alias("slope"))
            for m, s in (("a", 0.9), ("b", 0.5), ("c", 0.0))
        ]
    )
    y, key = F.col("o_totalprice"), F.col("o_orderkey")
    return (
        table(spark, sf_dir, "orders")
        .select(key, y, F.explode(models).alias("m"))
        .select("*", F.explode(F.array(F.lit(11), F.lit(22))).alias("seed"))
        .select(
            "m.model",
            "seed",
            F.lit(0).alias("draw"),
            F.lit(100).alias("n"),
            F.lit(2).alias("k"),
            key.alias("row_id"),
            y.alias("y_true"),
            (
                F.col("m.slope") * y
                + (1 - F.col("m.slope")) * 250000.0
                + ((key * 7919 + F.col("seed")) % 10007) * 3.0
            ).alias("y_pred"),
            F.lit(248000.0).alias("train_mean"),
        )
    )


PREDS_SQL = """preds AS (
SELECT m.model, s.seed, 0 AS draw, 100 AS n, 2 AS k, o.o_orderkey AS row_id,
  o.o_totalprice AS y_true,
  m.slope * o.o_totalprice + (1 - m.slope) * 250000.0E0 + ((o.o_orderkey * 7919 + s.seed) % 10007) * 3.0E0 AS y_pred,
  248000.0E0 AS train_mean
FROM orders o CROSS JOIN (VALUES ('a', 0.9E0), ('b', 0.5E0), ('c', 0.0E0)) AS m(model, slope)
CROSS JOIN (VALUES (11), (22)) AS s(seed))"""


def cpreds(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    positive = F.col("o_orderstatus") == "F"
    return (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_orderstatus",
                F.explode(F.array(F.lit(11), F.lit(22))).alias("seed"))
        .select(
            F.lit("clf").alias("model"),
            "seed",
            F.lit(0).alias("draw"),
            F.lit(100).alias("n"),
            F.lit(2).alias("k"),
            key.alias("row_id"),
            F.when(positive, 1).otherwise(0).alias("y_true"),
            (
                ((key * 7919 + F.col("seed")) % 500 + F.when(positive, 400).otherwise(0))
                / 1000.0
            ).alias("score"),
            F.lit(0.33).alias("train_pos_rate"),
        )
    )


CPREDS_SQL = """cpreds AS (
SELECT 'clf' AS model, s.seed, 0 AS draw, 100 AS n, 2 AS k, o.o_orderkey AS row_id,
  CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS y_true,
  ((o.o_orderkey * 7919 + s.seed) % 500 + CASE WHEN o.o_orderstatus = 'F' THEN 400 ELSE 0 END) / 1000.0E0 AS score,
  0.33E0 AS train_pos_rate
FROM orders o CROSS JOIN (VALUES (11), (22)) AS s(seed))"""


def ckpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    eid, value = F.col("event_id"), F.col("value")
    return e.select(
        F.lit("exp").alias("experiment_id"),
        F.col("event_type").alias("model"),
        (F.col("user_id") % 5).cast("int").alias("seed"),
        (eid % 4).cast("int").alias("draw"),
        F.lit(10).alias("n"),
        (F.floor(value).cast("int") % 6).alias("k"),
        F.when(eid % 10 == 0, "failed").when(eid % 10 == 1, "skipped").otherwise("ok").alias("status"),
        eid.alias("seq"),
        value.alias("rmse"),
        (value / 10).alias("fit_seconds"),
        (F.floor(value).cast("int") % 90 + 1).alias("best_rounds"),
        F.when(eid % 3 == 0, "True").when(eid % 3 == 1, "False").alias("converged"),
    )


CKPT_SQL = """ckpt AS (
SELECT 'exp' AS experiment_id, event_type AS model, CAST(user_id % 5 AS INT) AS seed,
  CAST(event_id % 4 AS INT) AS draw, 10 AS n, CAST(floor(value) AS INT) % 6 AS k,
  CASE event_id % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' ELSE 'ok' END AS status,
  event_id AS seq, value AS rmse, value / 10 AS fit_seconds, CAST(floor(value) AS INT) % 90 + 1 AS best_rounds,
  CASE WHEN event_id % 3 = 0 THEN 'True' WHEN event_id % 3 = 1 THEN 'False' END AS converged
FROM events)"""


def raw_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("unit_id"),
        F.when(key % 17 == 0, "-9")
        .when(key % 19 == 0, "")
        .when(key % 29 == 0, "NA")
        .when(key % 31 == 0, "-6.0")
        .otherwise(F.floor("c_acctbal").cast("bigint").cast("string"))
        .alias("balance"),
        F.when(key % 13 == 0, " -1 ")
        .when(key % 199 == 0, "7")
        .otherwise((key % 4).cast("string"))
        .alias("grp"),
        F.when(key % 3 == 0, "x").otherwise("5").alias("mixed"),
        F.lit("5").alias("constant"),
        F.when(key % 10 < 8, "train").otherwise("test").alias("pool"),
    )


RAW_SQL = """raw_survey AS (
SELECT c_custkey AS unit_id,
  CASE WHEN c_custkey % 17 = 0 THEN '-9' WHEN c_custkey % 19 = 0 THEN '' WHEN c_custkey % 29 = 0 THEN 'NA'
       WHEN c_custkey % 31 = 0 THEN '-6.0' ELSE CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR(40)) END AS balance,
  CASE WHEN c_custkey % 13 = 0 THEN ' -1 ' WHEN c_custkey % 199 = 0 THEN '7' ELSE CAST(c_custkey % 4 AS VARCHAR(40)) END AS grp,
  CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE '5' END AS mixed,
  '5' AS constant,
  CASE WHEN c_custkey % 10 < 8 THEN 'train' ELSE 'test' END AS pool
FROM customer)"""

RAW_COLUMNS = ["balance", "grp", "mixed", "constant"]
