"""Sharding by extendible hashing.

A directory indexed by the leading bits of a row's hash points to buckets. Only a
bucket over the byte limit is split on its next bit, until every bucket fits. The
directory is worked out from byte counts of hash prefixes: tasks add up bytes per
prefix of ``base`` bits before anything is shuffled, prefixes are summed up to
every shorter depth, and a bucket is the shortest prefix that fits while its
parent does not. Prefixes that are still too full take another round with more
bits, over their own rows only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import hash60, stored

BITS = 60
ROUND_BITS = 8


def _prefix(depth: int | str) -> Column:
    return F.expr(f"shiftright(_h, {BITS} - {depth})")


def _round(cells: DataFrame, low: int, high: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Buckets of depths ``low..high`` and the cells of depth ``high`` that stay too full.

    ``cells``: ``_h`` (smallest hash), ``_top`` (largest), ``_bytes``, one row per
    prefix of ``high`` bits. Every cell of ``low - 1`` bits is known to be too full.
    """
    at = cells.withColumn("_d", F.explode(F.sequence(F.lit(low), F.lit(high))))
    nodes = at.groupBy("_d", _prefix("_d").alias("prefix")).agg(
        F.sum("_bytes").alias("bytes"), F.sum("_rows").alias("rows"), F.min("_h").alias("_lo"), F.max("_top").alias("_hi"))
    nodes = stored(nodes.withColumn("_ends", (F.col("bytes") <= limit) | (F.col("_lo") == F.col("_hi"))), "shard-nodes")
    full = nodes.where("not _ends").select((F.col("_d") + 1).alias("_d"), F.col("prefix").alias("_parent"))
    ends = nodes.where("_ends").withColumn("_parent", F.shiftright("prefix", 1))
    leaves = ends.where(F.col("_d") > low).join(full, ["_d", "_parent"], "left_semi").unionByName(ends.where(F.col("_d") == low))
    deeper = nodes.where((F.col("_d") == high) & ~F.col("_ends")).select("prefix")
    return leaves.select(F.col("_d").alias("depth"), "prefix", "bytes", "rows"), deeper


def directory(keyed: DataFrame, limit: int) -> DataFrame:
    """Buckets ``depth, prefix, bytes, rows`` of rows ``(_h, _bytes)``."""
    total = keyed.agg(F.sum("_bytes")).first()[0] or 0
    high = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + ROUND_BITS)
    low, rows, found = 0, keyed, None
    while True:
        cells = rows.groupBy(_prefix(high).alias("_c")).agg(
            F.sum("_bytes").alias("_bytes"), F.count(F.lit(1)).alias("_rows"), F.max("_h").alias("_top"), F.min("_h").alias("_h"))
        leaves, deeper = _round(cells, low, high, limit)
        found = leaves if found is None else found.unionByName(leaves)
        if high >= BITS or deeper.isEmpty():
            return found
        rows = rows.join(deeper, _prefix(high) == F.col("prefix"), "left_semi")
        low, high = high + 1, min(BITS, high + ROUND_BITS)


def row_hash(key: Column, text: Column) -> Column:
    """60 uniform bits of a row's key and text."""
    return hash60(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("="), F.md5(F.coalesce(text, F.lit("")))))


def shard_documents(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard of every row of ``docs``.

    Returns ``doc_id, n_bytes, depth, prefix, page, shard_bytes``: the shard is the
    bucket of the leading ``depth`` bits ``prefix`` of the row's hash, which covers
    key and text, so one key with many texts still splits. Rows that agree in both
    are one entry with their number; where they alone pass the limit they are dealt
    over overflow ``page``s that hold as many of them as fit. Only a single row
    above the limit makes an over-full page. NULL texts have no bytes. Other
    columns are not read; an empty table gives no rows.
    """
    k, t = F.col(key), F.col(text)
    rows = docs.select(k.alias("doc_id"), row_hash(k, t).alias("_h"), F.coalesce(F.octet_length(t), F.lit(0)).cast("long").alias("n_bytes"))
    entries = rows.groupBy("doc_id", "_h", "n_bytes").agg(F.count(F.lit(1)).alias("_copies"))
    entries = stored(entries.withColumn("_bytes", F.col("n_bytes") * F.col("_copies")), "shard-entries")
    buckets = stored(directory(entries.select("_h", "_bytes"), limit), "shard-buckets")
    depths = sorted(r[0] for r in buckets.select("depth").distinct().collect())  # at most one row per bit
    if not depths:
        depths = [0]
    # A row asks for its prefix at every depth in use; exactly one of them is a bucket.
    at = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(d).alias("prefix")) for d in depths]))
    placed = entries.withColumn("_at", at).select("*", "_at.*").join(buckets, ["depth", "prefix"])
    fits = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("n_bytes"), F.lit(1)))).cast("long")
    over = F.col("bytes") > limit
    each = placed.withColumn("_fits", fits).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    page = F.when(over, F.floor(F.col("_i") / F.col("_fits"))).otherwise(0).cast("long")
    held = F.when(over, F.least(F.col("_fits"), F.col("_copies") - page * F.col("_fits")) * F.col("n_bytes")).otherwise(F.col("bytes"))
    return each.select("doc_id", "n_bytes", F.col("depth").cast("int"), "prefix", page.alias("page"), held.cast("long").alias("shard_bytes"))
