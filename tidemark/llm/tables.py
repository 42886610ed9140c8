"""Table reads, the shared scratch folder and small column helpers of the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch_path

#: A word is a run of characters other than space, tab, line and page breaks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` below the shared folder and read it back.

    Passes that follow read the same rows, even when an executor is lost and a
    task runs again.
    """
    path = scratch_path(df.sparkSession, label)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_in(text: Column) -> Column:
    """Number of words, 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(col: Column) -> Column:
    """Uniform number below 2**60 from the md5 of a column's text; SQL engines agree on it."""
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def null_safe(col: Column) -> Column:
    """Text that tells NULL from every value, for keys of joins and groups."""
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit("-"))


def apart(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with its columns numbered, and the new names of ``names``.

    Columns that an operator adds cannot clash with those of its input then;
    ``toDF(*docs.columns)`` gives the names back.
    """
    new = [f"column{i}" for i in range(len(docs.columns))]
    return docs.toDF(*new), [new[docs.columns.index(n)] if n in docs.columns else "" for n in names]


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once nothing reads them any more."""
    for t in tables:
        folders = {f.rsplit("/", 1)[0] for f in t.inputFiles()}
        spark = t.sparkSession
        for folder in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
