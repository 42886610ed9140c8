"""Append-only checkpoint shards: one directory per batch under a table path."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.results import COMPACT_AT, RESULT_KEYS, prefer_completed


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def batches(spark: SparkSession, path: str) -> list[str]:
    """Names of the batch directories, oldest first."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return sorted(n for n in names if n.startswith("batch="))


def append_batch(rows: DataFrame, path: str, label: str) -> bool:
    """Write one batch as a shard; an empty batch writes nothing."""
    if rows.isEmpty():
        return False
    rows.write.mode("overwrite").parquet(f"{path}/batch={label}")
    return True


def append_batches(rows: DataFrame, path: str, label: Column, order: str) -> None:
    """Write many batches in one job: a shard of one file per ``label``, its rows by ``order``, which is not written."""
    tagged = rows.withColumn("batch", label).repartition("batch").sortWithinPartitions("batch", order)
    tagged.drop(order).write.mode("append").partitionBy("batch").parquet(path)


def read_shards(spark: SparkSession, path: str, columns: list[str] | None = None,
                schema: StructType | str | None = None) -> DataFrame:
    """All shards; with ``columns`` only those are read. A given schema skips the footers."""
    reader = spark.read.schema(schema) if schema else spark.read.option("mergeSchema", True)
    df = reader.parquet(f"{path}/*")
    return df.select(*columns) if columns else df


def in_shard_order(spark: SparkSession, path: str, columns: list[str] | None = None,
                   schema: StructType | str | None = None, name: str = "seq") -> DataFrame:
    """All shards, with the place of each row in ``name``: later shards order after earlier ones.

    A shard's place is its name's, as :func:`shard_order` ranks names, then the time its
    file was written; within a file rows keep their order. Writers need no sequence
    number, and nothing is sorted: the place is a struct to take the greatest of.
    """
    reader = spark.read.schema(schema) if schema else spark.read.option("mergeSchema", True)
    df = reader.parquet(f"{path}/*")
    folder = F.element_at(F.split("_metadata.file_path", "/"), -2)
    place = F.struct(shard_order(folder).alias("shard"), F.col("_metadata.file_modification_time").alias("written"),
                     F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    return df.select(*(columns or [c for c in df.columns if c != name]), place.alias(name))


def checkpoint_index(spark: SparkSession, path: str, sequence: str | None = "seq") -> DataFrame:
    """What resuming needs: keys and status, deduplicated.

    Without a ``sequence`` column in the shards their own order decides.
    """
    if sequence is None:
        return prefer_completed(in_shard_order(spark, path, [*RESULT_KEYS, "status"])).drop("seq")
    return prefer_completed(read_shards(spark, path, [*RESULT_KEYS, "status", sequence]), seq=sequence)


#: Bytes of a compacted file.
FILE_BYTES = 128 << 20


def compact(spark: SparkSession, path: str, threshold: int = COMPACT_AT, file_bytes: int = FILE_BYTES) -> int:
    """Merge loose batches into one shard once there are ``threshold`` of them.

    The merged shard is written before the loose ones go, so a crash leaves
    repeated rows, which deduplication removes. It has as many files as its bytes ask
    for; a task streams whole files into one, so it neither sorts nor holds its rows.
    """
    loose = [b for b in batches(spark, path) if not b.startswith("batch=compact")]
    if len(loose) < threshold:
        return 0
    held = 0
    for b in loose:
        fs, p = _fs(spark, f"{path}/{b}")
        held += fs.getContentSummary(p).getLength()
    merged = spark.read.option("mergeSchema", True).parquet(*[f"{path}/{b}" for b in loose])
    merged.coalesce(max(1, -(-held // file_bytes))).write.parquet(f"{path}/batch=compact-{uuid.uuid4().hex}")
    for b in loose:
        fs, p = _fs(spark, f"{path}/{b}")
        fs.delete(p, True)
    return len(loose)


def shard_order(file_name: Column) -> Column:
    """Sort key of a shard file: undated names first, then by time stamp, then name."""
    stamp = F.regexp_extract(file_name, r"(\d{9,})", 1)
    return F.struct(F.when(stamp == "", F.lit(0)).otherwise(1).alias("dated"),
                    F.when(stamp != "", stamp.cast("decimal(38,0)")).alias("stamp"), file_name.alias("name"))
