"""Scans and sinks of tables, and what is known about them without reading rows."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.encode import MANIFEST_DDL


def _is_parquet(path: str) -> bool:
    return not path.rstrip("/").lower().endswith(".csv")


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
         schema: str | StructType | None = None) -> DataFrame:
    """CSV or Parquet by suffix, reading only ``columns``."""
    if _is_parquet(path):
        df = spark.read.parquet(path)
    else:
        reader = spark.read.option("header", True)
        df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.select(*columns) if columns is not None else df


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names from the footer or the first line."""
    if _is_parquet(path):
        return spark.read.parquet(path).schema.names
    return spark.read.option("header", True).csv(path).schema.names


def write(df: DataFrame, path: str) -> None:
    """CSV or Parquet by suffix."""
    if _is_parquet(path):
        df.write.mode("overwrite").parquet(path)
    else:
        df.write.mode("overwrite").option("header", True).csv(path)


def canonical_json(value: object) -> str:
    """Compact JSON with sorted keys; NaN is an error."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)


def write_json(spark: SparkSession, value: object, path: str) -> None:
    """One small document as a text file in shared storage."""
    spark.createDataFrame([(canonical_json(value),)], "value string").coalesce(1).write.mode(
        "overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    names = header(spark, path)
    fields = [f.strip() for f in MANIFEST_DDL.split(",")]
    ddl = ", ".join(f for n in names for f in fields if f.split()[0] == n)
    return spark.read.option("header", True).schema(ddl).csv(path)


def resolve_predictors(columns: Sequence[str], predictors: Sequence[str] | None = None,
                       prefixes: Sequence[str] = (), manifest: DataFrame | None = None,
                       protected: Sequence[str] = ()) -> list[str]:
    """Predictors from a list or header prefixes; a manifest fixes their order."""
    if manifest is not None:
        kept = manifest.where("keep").orderBy("source_order", "feature_order").select("feature_name")
        ordered = [row[0] for row in kept.collect()]
        wanted = predictors if predictors is not None else ordered
        if sorted(wanted) != sorted(ordered):
            raise ValueError("the manifest does not cover exactly the predictors")
        chosen = ordered
    elif predictors is not None:
        chosen = list(predictors)
    else:
        chosen = [c for c in columns if any(c.startswith(p) for p in prefixes)]
    if not chosen:
        raise ValueError("no predictors")
    absent = [c for c in chosen if c not in columns]
    if absent:
        raise ValueError(f"predictors not in the table: {absent[:3]}")
    clash = [c for c in chosen if c in protected]
    if clash:
        raise ValueError(f"predictors overlap outcome or id columns: {clash[:3]}")
    return chosen


def load_input(spark: SparkSession, path: str, outcome: str, predictors: Sequence[str],
               id_column: str | None = None, test_path: str | None = None) -> DataFrame:
    """Outcome, predictors and id of the training table and an optional test table."""
    wanted = [outcome, *predictors, *([id_column] if id_column else [])]

    def part(p: str, role: str) -> DataFrame:
        absent = [c for c in wanted if c not in header(spark, p)]
        if absent:
            raise ValueError(f"{role} table lacks columns: {absent[:3]}")
        return scan(spark, p, wanted).withColumn("role", F.lit(role))

    train = part(path, "train")
    return train if test_path is None else train.unionByName(part(test_path, "test"))


def missingness_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing cells and share of each column, all columns in one aggregation."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"),
                    *[F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(columns)])
    e = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("n_missing"))
                  for i, c in enumerate(columns)])
    return counts.select("_n", F.explode(e).alias("e")).select(
        "e.column", "e.n_missing", (F.col("e.n_missing") / F.col("_n")).alias("missing_fraction"))


def content_identity(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-free digest of all (or the named) columns: row count and sums of two slices of each row's md5.

    Each value is written with its length in bytes, NULL as ``-``, so that no two
    different rows give one text.
    """
    def part_of(name: str) -> Column:
        text = F.col(name).cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    h = F.md5(F.concat(*[part_of(c) for c in (columns or df.columns)]))
    part = [F.conv(F.substring(h, 1 + 7 * i, 7), 16, 10).cast("bigint") for i in range(2)]
    return df.select(*[p.alias(f"_p{i}") for i, p in enumerate(part)]).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("_p0").alias("digest_a"), F.sum("_p1").alias("digest_b"))


def run_metadata(df: DataFrame, strategy: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Identity and size of one input."""
    columns = columns or df.columns
    return content_identity(df, columns).select(
        F.lit(strategy).alias("strategy"), "n_rows", F.lit(len(columns)).alias("n_columns"),
        F.md5(F.concat_ws("|", "n_rows", "digest_a", "digest_b")).alias("identity"))


def write_chunked(tasks: DataFrame, path: str) -> None:
    """A design table stored by chunk, so that a worker reads only its chunk."""
    tasks.repartition("chunk_id").sortWithinPartitions("chunk_id", "row_id").write.mode(
        "overwrite").partitionBy("chunk_id").option("compression", "zstd").parquet(path)


def read_chunk(spark: SparkSession, path: str, chunk_id: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("chunk_id") == chunk_id)
