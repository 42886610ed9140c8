"""Mixing sources to target weights by random order and prefix sums.

Every document gets a key that is uniform and depends on its id alone. Within a
source documents are ordered by that key, a prefix sum of their sizes runs along
the order, and the mix is cut where the sum meets the source's budget: documents are
taken whole, the one that the cut would divide if the half of it fits. A budget above
the source's size takes whole epochs first.

The order is a range sort: the leading bits of the key name a slice, and each
source gets as many slices as it has rows for, so the largest source is sorted by
as many tasks as its share asks for. Only slice totals are summed across slices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.tables import apart, hash60, null_safe, stored, words_in


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """Add ``weight`` and ``target`` to rows ``(skey, source, source_size)``.

    Sources in order of their names, NULL last, take the weights in turn. All
    words are shared by weight; no target passes ``max_epochs`` times its source's
    size, and what is cut off goes to the others by weight. The windows see one
    row per source.
    """
    everything = W.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    pick = F.array(*[F.lit(float(w)) for w in weights])
    t = totals.withColumn("weight", F.element_at(pick, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("_cap", F.col("source_size") * max_epochs).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    by_ratio = everything.orderBy("_ratio", "skey")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    t = t.withColumn("_full", F.col("_ratio") < level).withColumn("_total", total)
    spent = F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0)).over(everything)
    open_weight = F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("weight"))).over(everything)
    share = F.when(open_weight > 0, (F.col("_total") - spent) / open_weight).otherwise(0.0) * F.col("weight")
    return t.withColumn("target", F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(share)).drop("_cap", "_ratio", "_full", "_total")


def allotments(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, rows_per_slice: int = 4096) -> DataFrame:
    """How often the mix takes every distinct (id, source, size) of ``docs``.

    Returns ``dkey, skey, doc_id, source, size, copies, source_size, target, epochs,
    extra``: each copy is taken ``epochs`` times and ``extra`` of them once more. Rows
    that agree in id, source and size are one entry with their number, so repeated rows
    cannot pile up in one task; they stand one after another in the prefix sum, and the
    cut falls between two of them. NULL or empty texts have size 0 and are never taken.
    NULL ids and sources are values of their own. Other columns of ``docs`` are not
    read. No documents, no entries.
    """
    rows = docs.select(null_safe(F.col("doc_id")).alias("dkey"), null_safe(F.col("source")).alias("skey"), "doc_id", "source", words_in(F.col("text")).alias("size"))
    entries = stored(rows.groupBy("dkey", "skey", "doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies")), "mix-entries")
    totals = entries.groupBy("skey", "source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count(F.lit(1)).alias("_n"))
    targets = source_targets(totals, weights, max_epochs)
    targets = targets.withColumn("_bits", F.greatest(F.lit(0), F.ceil(F.log2(F.col("_n") / rows_per_slice))).cast("int"))
    targets = stored(targets.select("skey", "source_size", "target", "_bits"), "mix-targets")
    keyed = entries.join(targets, "skey").withColumn("_key", hash60(F.col("doc_id")))
    keyed = keyed.withColumn("_slice", F.expr("shiftright(_key, 60 - _bits)")).withColumn("_mass", F.col("size") * F.col("copies"))
    along = W.partitionBy("skey").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    slices = keyed.groupBy("skey", "_slice").agg(F.sum("_mass").alias("_s"))
    slices = slices.select("skey", "_slice", F.coalesce(F.sum("_s").over(along), F.lit(0)).alias("_base"))
    inside = W.partitionBy("skey", "_slice").orderBy("_key", "dkey", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = keyed.withColumn("_in", F.coalesce(F.sum("_mass").over(inside), F.lit(0))).join(slices, ["skey", "_slice"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor(F.col("target")) - epochs * F.col("source_size")
    left = rest - F.col("_base") - F.col("_in")
    whole = F.floor((2 * left + F.col("size")) / (2 * F.col("size")))  # copies of which at least the half fits
    extra = F.when((F.col("size") > 0) & (left > 0), F.least(F.greatest(whole, F.lit(0)), F.col("copies"))).otherwise(0)
    return placed.select("dkey", "skey", "doc_id", "source", "size", "copies", "source_size", "target",
                         epochs.cast("long").alias("epochs"), extra.cast("long").alias("extra"))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``."""
    a = allotments(docs, **options)
    each = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    taken = F.col("size") * (F.col("epochs") + (F.col("_copy") <= F.col("extra")).cast("long"))
    return a.select("*", each.alias("_copy")).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents, with the columns of ``docs``; texts are whole.

    A document taken for several epochs comes once for each. Where the cut falls
    between rows that agree in id, source and size, the first of them by their texts'
    hashes are taken once more; only the rows of such entries, one entry a source at
    most, are ranked.
    """
    a = allotments(docs, **options).where("size > 0 and epochs + extra > 0").select("dkey", "skey", "size", "copies", "epochs", "extra")
    plain, (doc_id, text, source) = apart(docs, "doc_id", "text", "source")
    marked = plain.withColumns({"dkey": null_safe(F.col(doc_id)), "skey": null_safe(F.col(source)), "size": words_in(F.col(text))})
    both = marked.join(a, ["dkey", "skey", "size"])
    between = (F.col("extra") > 0) & (F.col("extra") < F.col("copies"))
    rank = F.row_number().over(W.partitionBy("dkey", "skey", "size").orderBy(F.xxhash64(text), F.xxhash64(*plain.columns)))
    divided = both.where(between).withColumn("_once", (rank <= F.col("extra")).cast("int"))
    others = both.where(~between).withColumn("_once", (F.col("extra") > 0).cast("int"))
    times = (F.col("epochs") + F.col("_once")).cast("int")
    out = others.unionByName(divided).withColumn("_epoch", F.explode(F.array_repeat(F.lit(1), times)))
    return out.select(*plain.columns).toDF(*docs.columns)
