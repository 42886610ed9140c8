"""Shards arriving in a directory, as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.results import COMPLETED, RESULT_KEYS, status_or_ok
from tidemark.sources.shards import _fs


def shard_stream(spark: SparkSession, path: str, schema: StructType | str,
                 files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path}/*")


def ingest(stream: DataFrame, table: str, checkpoint: str) -> None:
    """Append every new shard's rows to a table, then stop."""
    (stream.writeStream.format("parquet").option("path", table)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())


def best_rows(stream: DataFrame, keys: Sequence[str] = RESULT_KEYS, seq: str = "seq") -> DataFrame:
    """Best row per key as a streaming aggregation; the state holds one row per key."""
    rest = [c for c in stream.columns if c not in keys]
    done = status_or_ok(F.col("status")).isin(*COMPLETED)
    best = F.max_by(F.struct(*rest), F.struct(done.alias("done"), F.col(seq).alias("seq")))
    return stream.groupBy(*keys).agg(best.alias("r"))


def _versioned(table: str) -> Callable[[DataFrame, int], None]:
    """Each batch owns its directory, so a replayed batch rewrites only itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id:09d}")

    return write


#: Parts of an upserted table; a batch rewrites those that its keys fall into.
UPSERT_BUCKETS = 16


def upsert(stream: DataFrame, table: str, checkpoint: str, keys: Sequence[str] = RESULT_KEYS, buckets: int = UPSERT_BUCKETS) -> None:
    """Keep one row per key in ``table``: the best that any batch brought.

    The table is cut into hash buckets. A batch merges its keys into the buckets they
    fall into and overwrites just those, so no versions pile up; a replayed batch merges
    the same rows again and changes nothing. ``buckets`` must stay the same for a table.
    """
    spark = stream.sparkSession
    order = F.struct(status_or_ok(F.col("r.status")).isin(*COMPLETED).alias("done"), F.col("r.seq").alias("seq"))

    def merge(batch: DataFrame, _batch_id: int) -> None:
        changed = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
        try:
            touched = [r[0] for r in changed.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
            if not touched:
                return
            known = spark.createDataFrame([], changed.schema)
            fs, path = _fs(spark, table)
            if fs.exists(path):
                known = spark.read.schema(changed.schema).parquet(table).where(F.col("bucket").isin(touched))
            merged = known.unionByName(changed).groupBy(*keys, "bucket").agg(F.max_by("r", order).alias("r"))
            merged.repartition("bucket").write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(table)
        finally:
            changed.unpersist()

    (best_rows(stream, keys).writeStream.outputMode("update").foreachBatch(merge)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())


def read_upserted(spark: SparkSession, table: str, keys: Sequence[str] = RESULT_KEYS) -> DataFrame:
    return spark.read.parquet(table).select(*keys, "r.*")


class _Enough(Exception):
    """Ends a query before it writes a batch too many."""


def run_batches(stream: DataFrame, table: str, checkpoint: str, stop_after: int | None = None) -> int:
    """Process batches until ``stop_after`` are committed, or all that are there now; how many were.

    The position is kept in ``checkpoint``: a later call goes on from there. The batch
    after the last wanted one is refused before it writes anything, so it is not
    committed and comes first next time.
    """
    write, done, refused = _versioned(table), [], []

    def bounded(batch: DataFrame, batch_id: int) -> None:
        if stop_after is not None and len(done) >= stop_after:
            refused.append(batch_id)
            raise _Enough
        write(batch, batch_id)
        done.append(batch_id)

    query = stream.writeStream.foreachBatch(bounded).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if not refused:
            raise
    return len(done)


def status_totals(stream: DataFrame, table: str, checkpoint: str) -> None:
    """Running row counts per (model, status), kept as one small table."""
    counts = stream.groupBy("model", status_or_ok(F.col("status")).alias("status")).agg(
        F.count(F.lit(1)).alias("n"))

    def write(batch: DataFrame, _batch_id: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(table)

    (counts.writeStream.outputMode("complete").foreachBatch(write)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())
