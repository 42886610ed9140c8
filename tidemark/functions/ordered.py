"""Exact ranks, running totals and quantiles that never put a whole group in one task.

A window over ``partitionBy(cell).orderBy(value)`` sorts each cell in a single
task, so one large cell stalls the job. Here every value is first mapped to a
*bucket* by a monotone function of the value alone; a bucket that turns out too
full, as for values far from zero with a narrow spread, is cut between its own
least and largest value. Bucket totals are small and give each bucket its
starting offset; the window then runs per (cell, bucket). Bucket ids depend only
on the rows, never on tasks, so a retried or recomputed task always produces the
same ids.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Buckets per power of two for numeric order. Fine enough to split a hot group
# some thousand ways, coarse enough that bucket totals stay small.
DIGIT_STEPS = 512
# Selection only orders one bucket per wanted rank, so its histogram is coarser.
SELECT_STEPS = 128
# A bucket with more rows than this is cut further, between its own least and
# largest value.
BUCKET_ROWS = 256
# Wanted (group, rank) pairs up to which their buckets are broadcast, two rows each.
MAX_BROADCAST_BUCKETS = 1 << 17
# Keeps exponents positive: doubles reach down to 2**-1074.
DIGIT_BIAS = 1100
# Hex digits of an md5 used as its bucket: 16**3 = 4096 buckets per group.
HASH_BUCKET_CHARS = 3


def order_digit(value: Column, steps: int = DIGIT_STEPS) -> Column:
    """Monotone BIGINT bucket of a numeric value, of relative width ``1 / steps``."""
    v = value.cast("double")
    size = F.abs(v)
    exponent = F.floor(F.log2(size))
    fraction = size / F.pow(F.lit(2.0), exponent) - 1
    digit = (exponent + DIGIT_BIAS) * steps + F.floor(fraction * steps)
    return (
        F.when(v == 0, F.lit(0).cast("bigint"))
        .when(v < 0, -digit)
        .otherwise(digit)
        .cast("bigint")
    )


def spread(rows: DataFrame, by: Sequence[str], value: str, most: int | None = None) -> DataFrame:
    """Add ``_slice``, the slice of each row inside its bucket ``_d``, monotone in ``value``."""
    by, most = list(by), most or BUCKET_ROWS
    full = rows.groupBy(*by, "_d").agg(
        F.count(F.lit(1)).alias("_bucket_n"),
        F.min(value).cast("double").alias("_bucket_lo"),
        F.max(value).cast("double").alias("_bucket_hi"),
    ).where((F.col("_bucket_n") > most) & (F.col("_bucket_lo") < F.col("_bucket_hi")))
    slices = F.ceil(F.col("_bucket_n") / most)
    share = (F.col(value).cast("double") - F.col("_bucket_lo")) / (F.col("_bucket_hi") - F.col("_bucket_lo"))
    at = F.least(F.floor(share * slices), slices - 1)
    return rows.join(full, [*by, "_d"], "left").withColumn("_slice", F.coalesce(at, F.lit(0)).cast("bigint")).drop("_bucket_n", "_bucket_lo", "_bucket_hi")


def seed_hash(*parts: Column | str | int) -> Column:
    """Hex digest that orders rows pseudo-randomly and reproducibly."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def _hash_offsets(df: DataFrame, by: Sequence[str]) -> DataFrame:
    sizes = df.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*by)
    return sizes.select(
        *by,
        "_b",
        "_c",
        (F.sum("_c").over(w.orderBy("_b")) - F.col("_c")).alias("_o"),
        F.sum("_c").over(w).alias("_n"),
    )


def hash_rank(
    df: DataFrame,
    by: Sequence[str],
    digest: Column,
    tie: str,
    out: str = "rk",
    limit: int | None = None,
) -> DataFrame:
    """Rank rows of each group by ``(digest, tie)``, from 1.

    With ``limit`` only ranks up to it are returned, and only the hash buckets
    that can hold them are sorted.
    """
    by = list(by)
    tagged = df.withColumn("_h", digest).withColumn(
        "_b", F.substring("_h", 1, HASH_BUCKET_CHARS)
    )
    offsets = _hash_offsets(tagged, by).select(*by, "_b", "_o")
    if limit is not None:
        offsets = offsets.where(F.col("_o") < limit)
    w = Window.partitionBy(*by, "_b").orderBy("_h", tie)
    ranked = (
        tagged.join(offsets, [*by, "_b"])
        .withColumn(out, (F.col("_o") + F.row_number().over(w)).cast("bigint"))
        .drop("_h", "_b", "_o")
    )
    return ranked if limit is None else ranked.where(F.col(out) <= limit)


def hash_cut(
    df: DataFrame, by: Sequence[str], digest: Column, tie: str, take: Column
) -> DataFrame:
    """The digest and tie value of the ``take``-th row of each group.

    One row per group: ``(by, n_group, n_take, cut_hash, cut_tie)``. ``take``
    is an expression over ``_n``, the group size. Only the hash bucket that
    holds the cut is sorted; the cut columns are NULL when ``take`` is 0.
    """
    by = list(by)
    tagged = df.select(*by, tie, digest.alias("_h")).withColumn(
        "_b", F.substring("_h", 1, HASH_BUCKET_CHARS)
    )
    offsets = _hash_offsets(tagged, by).withColumn("_t", take.cast("bigint"))
    edge = offsets.where(
        (F.col("_o") < F.col("_t")) & (F.col("_t") <= F.col("_o") + F.col("_c"))
    )
    w = Window.partitionBy(*by, "_b").orderBy("_h", tie)
    at_cut = (
        tagged.join(edge.select(*by, "_b", "_o", "_t"), [*by, "_b"])
        .withColumn("_r", F.col("_o") + F.row_number().over(w))
        .where(F.col("_r") == F.col("_t"))
        .select(*by, F.col("_h").alias("cut_hash"), F.col(tie).alias("cut_tie"))
    )
    sizes = offsets.groupBy(*by).agg(
        F.max("_n").alias("n_group"), F.max("_t").alias("n_take")
    )
    return sizes.join(at_cut, by, "left")


def short_digest(digest: Column) -> Column:
    """The leading 60 bits of a hex digest as a BIGINT, in the same order."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def hash_cuts(df: DataFrame, by: Sequence[str], short: str, digest: Column, tie: str, ranks: Sequence[int]) -> DataFrame:
    """Digest and tie value at many ranks of each group: ``(by, cuts)``, a row per group, its cuts by rank.

    ``short`` holds the :func:`short_digest` of ``digest``, which is only made for rows of
    the hash buckets that hold a rank; only these are moved and sorted. A rank above the
    size of a group has its last row's.
    """
    by = list(by)
    tagged = df.withColumn("_b", F.shiftright(short, 60 - 4 * HASH_BUCKET_CHARS))
    wanted = F.array(*[F.lit(int(r)).cast("bigint") for r in sorted(set(ranks))])

    def at(rank: Column) -> Column:
        return F.least(rank, F.col("_n"))

    held = F.filter(wanted, lambda r: (at(r) > F.col("_o")) & (at(r) <= F.col("_o") + F.col("_c")))
    edges = _hash_offsets(tagged, by).withColumn("_wanted", held).where(F.size("_wanted") > 0)
    # A row per group and rank at most, both of the caller's design.
    near = tagged.join(F.broadcast(edges.select(*by, "_b", "_o", "_n", "_wanted")), [*by, "_b"]).withColumn("_h", digest)
    w = Window.partitionBy(*by, "_b").orderBy("_h", tie)
    placed = near.withColumn("_r", F.col("_o") + F.row_number().over(w))
    found = placed.select(*by, short, "_h", tie, F.explode(F.filter("_wanted", lambda r: at(r) == F.col("_r"))).alias("rank"))
    cut = F.struct("rank", F.col(short).alias("short"), F.col("_h").alias("hash"), F.col(tie).alias("tie"))
    return found.groupBy(*by).agg(F.array_sort(F.collect_list(cut)).alias("cuts"))


def inside_cut(cut: Column, short: Column, digest: Column, tie: Column) -> Column:
    """True for rows up to a cut of :func:`hash_cuts`; the whole digest is only made where the short ones are equal."""
    whole = (digest < cut["hash"]) | ((digest == cut["hash"]) & (tie <= cut["tie"]))
    return F.coalesce((short < cut["short"]) | ((short == cut["short"]) & whole), F.lit(False))


def before_cut(digest: Column, tie: str) -> Column:
    """True for rows inside the first ``n_take`` of a joined :func:`hash_cut`."""
    return F.coalesce(
        (digest < F.col("cut_hash"))
        | ((digest == F.col("cut_hash")) & (F.col(tie) <= F.col("cut_tie"))),
        F.lit(False),
    )


def ordered_running(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    sums: Mapping[str, Column],
    with_next: bool = False,
) -> DataFrame:
    """One row per (group, distinct value) with running sums in value order.

    For every name ``s`` in ``sums``: ``s`` (the sum at this value),
    ``s_before`` (at smaller values) and ``s_total`` (whole group). With
    ``with_next`` also ``next_value``, the following distinct value.
    """
    by = list(by)
    names = list(sums)
    distinct = (
        df.groupBy(*by, value)
        .agg(*[F.sum(c).alias(s) for s, c in sums.items()])
        .withColumn("_d", order_digit(F.col(value)))
    )
    distinct = spread(distinct, by, value)
    totals = distinct.groupBy(*by, "_d", "_slice").agg(
        *[F.sum(s).alias(f"_{s}") for s in names], F.min(value).alias("_first")
    )
    whole = Window.partitionBy(*by)
    run = whole.orderBy("_d", "_slice")
    offsets = totals.select(
        *by,
        "_d",
        "_slice",
        *[(F.sum(f"_{s}").over(run) - F.col(f"_{s}")).alias(f"_o_{s}") for s in names],
        *[F.sum(f"_{s}").over(whole).alias(f"{s}_total") for s in names],
        *([F.lead("_first").over(run).alias("_next_first")] if with_next else []),
    )
    inner = Window.partitionBy(*by, "_d", "_slice").orderBy(value)
    # Neither side is small, whatever the files say: rows may have been exploded. The window needs this shuffle anyway.
    joined = distinct.join(offsets.hint("merge"), [*by, "_d", "_slice"])
    return joined.select(
        *by,
        value,
        *names,
        *[
            (F.col(f"_o_{s}") + F.sum(s).over(inner) - F.col(s)).alias(f"{s}_before")
            for s in names
        ],
        *[f"{s}_total" for s in names],
        *(
            [
                F.coalesce(F.lead(value).over(inner), F.col("_next_first")).alias(
                    "next_value"
                )
            ]
            if with_next
            else []
        ),
    )


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float],
    steps: int = SELECT_STEPS, n_groups: int | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles per group, one column per entry of ``probs``.

    A histogram over :func:`order_digit` locates the buckets that hold the
    wanted ranks; only rows of those buckets are shuffled and ordered. ``n_groups``
    bounds the groups, where the caller's design does: these few buckets are then
    broadcast. Without it the planner may send the rows instead, if their files are
    small and they were exploded since.
    """
    by = list(by)
    rows = df.where(F.col(value).isNotNull()).select(
        *by,
        F.col(value).cast("double").alias("_v"),
        order_digit(F.col(value), steps).alias("_d"),
    )
    whole = Window.partitionBy(*by)
    hist = (
        rows.groupBy(*by, "_d")
        .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        .withColumn("_o", F.sum("_c").over(whole.orderBy("_d")) - F.col("_c"))
        .withColumn("_n", F.sum("_c").over(whole))
    )

    def at(prob: float) -> tuple[Column, Column, Column]:
        pos = (F.col("_n") - 1) * F.lit(float(prob))
        return pos, F.floor(pos), F.ceil(pos)

    def holds(rank: Column) -> Column:
        return (rank >= F.col("_o")) & (rank < F.col("_o") + F.col("_c"))

    wanted = F.lit(False)
    for prob in probs.values():
        _, low, high = at(prob)
        wanted = wanted | holds(low) | holds(high)
    near = hist.where(wanted).select(*by, "_d", F.col("_o").alias("_start"), "_n", F.col("_c").alias("_size"), "_low", "_high")
    if n_groups is not None and n_groups * len(probs) <= MAX_BROADCAST_BUCKETS:
        near = F.broadcast(near)
    # A full bucket is cut between its own least and largest value, which the histogram knows.
    slices = F.ceil(F.col("_size") / BUCKET_ROWS)
    share = F.try_divide(F.col("_v") - F.col("_low"), F.col("_high") - F.col("_low"))  # NULL where all values are one
    place = F.when(slices > 1, F.least(F.floor(F.coalesce(share, F.lit(0.0)) * slices), slices - 1)).otherwise(0)
    # Summed up twice from one exchange: by slice, and by value inside each.
    picked = rows.join(near, [*by, "_d"]).groupBy(
        *by, "_d", place.cast("bigint").alias("_slice"), "_v", "_start", "_n").agg(F.count(F.lit(1)).alias("_c"))
    run = Window.partitionBy(*by, "_d").orderBy("_slice")
    totals = picked.groupBy(*by, "_d", "_slice").agg(F.sum("_c").alias("_slice_n"))
    totals = totals.select(*by, "_d", "_slice", (F.sum("_slice_n").over(run) - F.col("_slice_n")).alias("_slice_base"))
    inner = Window.partitionBy(*by, "_d", "_slice").orderBy("_v")
    placed = picked.join(totals, [*by, "_d", "_slice"]).withColumn(
        "_o", F.col("_start") + F.col("_slice_base") + F.sum("_c").over(inner) - F.col("_c")
    )
    aggs = []
    for name, prob in probs.items():
        pos, low, high = at(prob)
        lo_v = F.max(F.when(holds(low), F.col("_v")))
        hi_v = F.max(F.when(holds(high), F.col("_v")))
        part = F.max(pos - low)
        aggs.append((lo_v + (hi_v - lo_v) * part).alias(name))
    return placed.groupBy(*by).agg(*aggs)
