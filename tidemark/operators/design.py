"""Sampling design: sources, splits, row and source orders, cells, folds."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.ordered import (
    before_cut,
    hash_cut,
    hash_cuts,
    hash_rank,
    inside_cut,
    ordered_running,
    seed_hash,
    short_digest,
)

CELL_KEYS = ["model", "seed", "draw", "n", "k"]


@dataclass(frozen=True)
class Source:
    """A predictor unit: the features that are sampled and imputed together."""

    name: str
    unit_type: str
    features: list[str]
    level_values: list[str] = field(default_factory=list)
    ordinal_levels: list[float] = field(default_factory=list)
    reference_level: str | None = None
    reference_feature: str | None = None
    drop_first: bool = False
    prior: float | None = None

    def prior_values(self) -> list[float]:
        """What every row takes when the source was never observed in a cell."""
        if self.unit_type == "onehot_group":
            return [1.0 if f == self.reference_feature else 0.0 for f in self.features]
        if self.prior is not None:
            return [float(self.prior)]
        return [self.ordinal_levels[0] if self.unit_type == "ordinal" else 0.0]


def feature_names(sources: Sequence[Source]) -> list[str]:
    return [f for s in sources for f in s.features]


def source_positions(sources: Sequence[Source]) -> list[list[int]]:
    """For each source the positions of its features in manifest order."""
    out, at = [], 0
    for s in sources:
        out.append(list(range(at, at + len(s.features))))
        at += len(s.features)
    return out


def with_seeds(df: DataFrame, seeds: Iterable[int], name: str = "seed") -> DataFrame:
    """Repeat every row once per seed."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(int(s)) for s in seeds])))


def split_digest(row_id: str = "row_id", seed: str = "seed") -> Column:
    return seed_hash(F.col(seed), "t", F.col(row_id))


def split_random(
    df: DataFrame, seeds: Sequence[int], test_size: float, row_id: str = "row_id"
) -> DataFrame:
    """Tag every row ``test`` or ``train`` per seed; ``ceil(n * test_size)`` are test.

    The cut table has one row per seed, so it is as large as the seed list
    held by the caller and is broadcast; the data itself is not shuffled.
    """
    rows = with_seeds(df, seeds)
    cut = hash_cut(
        rows, ["seed"], split_digest(row_id), row_id,
        F.ceil(F.col("_n") * F.lit(test_size)),
    ).select("seed", "cut_hash", "cut_tie")
    return _with_role(rows, cut, ["seed"], row_id)


def split_stratified(
    df: DataFrame,
    seeds: Sequence[int],
    test_size: float,
    label: str,
    row_id: str = "row_id",
) -> DataFrame:
    """Split that keeps class shares: largest remainders get the spare test rows."""
    rows = with_seeds(df, seeds)
    classes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    # One row per class: the classes of one outcome, a handful of rows.
    everything = Window.partitionBy(F.lit(0))
    exact = F.col("_c") * F.lit(test_size)
    quota = (
        classes.withColumn("_spare", F.ceil(F.sum("_c").over(everything) * F.lit(test_size))
                           - F.sum(F.floor(exact)).over(everything))
        .withColumn("_pos", F.row_number().over(
            everything.orderBy(F.round(exact - F.floor(exact), 9).desc(), label)))
        .select(label, (F.floor(exact) + (F.col("_pos") <= F.col("_spare")).cast("bigint"))
                .alias("_quota"))
    )
    cut = hash_cut(
        rows.join(F.broadcast(quota), label), ["seed", label, "_quota"], split_digest(row_id), row_id,
        F.col("_quota"),
    ).select("seed", label, "cut_hash", "cut_tie")
    return _with_role(rows, cut, ["seed", label], row_id)


def _with_role(rows: DataFrame, cut: DataFrame, by: list[str], row_id: str) -> DataFrame:
    digest = split_digest(row_id)
    # One row per seed of the caller's list, times the classes of one outcome.
    return (
        rows.join(F.broadcast(cut), by, "left")
        .withColumn("role", F.when(before_cut(digest, row_id), "test").otherwise("train"))
        .drop("cut_hash", "cut_tie")
    )


def split_external(train: DataFrame, test: DataFrame, outcome: str) -> DataFrame:
    """A given train/test pair, without rows whose outcome is missing."""
    tagged = train.withColumn("role", F.lit("train")).unionByName(
        test.withColumn("role", F.lit("test"))
    )
    return tagged.where(F.col(outcome).isNotNull())


def row_ranks(
    train: DataFrame, draws: Sequence[int], row_id: str = "row_id", limit: int | None = None
) -> DataFrame:
    """Permutation rank ``rk`` of training rows for every (seed, draw)."""
    rows = with_seeds(train, draws, "draw")
    digest = seed_hash(F.col("seed"), F.col("draw"), "r", F.col(row_id))
    return hash_rank(rows, ["seed", "draw"], digest, row_id, "rk", limit)


def fold_ends(n: int, folds: int) -> list[int]:
    """Last rank of every contiguous fold of ``n`` rows, as :func:`contiguous_fold` deals them."""
    folds = min(folds, n)
    base, extra = divmod(n, folds)
    return [(f + 1) * base + min(f + 1, extra) for f in range(folds)]


def _repeats(seeds: Sequence[int], draws: Sequence[int]) -> Column:
    return F.array(*[F.struct(F.lit(int(s)).alias("seed"), F.lit(int(d)).alias("draw")) for s in seeds for d in draws])


def with_digests(rows: DataFrame, seeds: Sequence[int], draws: Sequence[int], row_id: str = "row_id") -> DataFrame:
    """Short digests of the split (``_t``, by seed) and of the permutation (``_r``, by seed and draw), made once for :func:`rank_tags`."""
    key, own = F.col(row_id), F.array(*[F.lit(int(s)) for s in seeds])
    return rows.withColumns({
        "_t": F.transform(own, lambda s: short_digest(seed_hash(s, "t", key))),
        "_r": F.transform(_repeats(seeds, draws), lambda p: short_digest(seed_hash(p["seed"], p["draw"], "r", key)))})


def rank_tags(rows: DataFrame, seeds: Sequence[int], draws: Sequence[int], n_test: int, ranks: Sequence[int], row_id: str = "row_id") -> DataFrame:
    """Split and permutation of every repeat as one array ``_ranks`` of each row of :func:`with_digests`.

    An entry, by seed and then draw, is 0 for a test row, else the row's rank in the
    permutation, rounded up to the next of ``ranks``, and NULL above them. Rows are
    neither repeated nor moved: they meet one broadcast row, which holds a cut for every
    repeat and rank of the design.
    """
    key, own, repeats, each = F.col(row_id), F.array(*[F.lit(int(s)) for s in seeds]), _repeats(seeds, draws), len(draws)

    def split_of(i: Column) -> Column:
        return seed_hash(F.element_at(own, i + 1), "t", key)

    def order_of(i: Column) -> Column:
        return seed_hash(F.element_at(repeats, i + 1)["seed"], F.element_at(repeats, i + 1)["draw"], "r", key)

    def one_row(cuts: DataFrame, name: str) -> DataFrame:
        return F.broadcast(cuts.agg(F.map_from_entries(F.collect_list(F.struct("_g", "cuts"))).alias(name)))

    split = hash_cuts(rows.select(row_id, F.posexplode("_t").alias("_g", "_s")), ["_g"], "_s", split_of(F.col("_g")), row_id, [n_test])
    tests = F.transform("_t", lambda s, i: F.exists(F.coalesce(F.col("_split")[i], F.array()), lambda c: inside_cut(c, s, split_of(i), key)))
    staged = rows.crossJoin(one_row(split, "_split")).withColumn("_test", tests).drop("_split", "_t")
    placed = staged.select(row_id, "_test", F.posexplode("_r").alias("_g", "_s"))
    train = placed.where(~F.element_at("_test", (F.col("_g") / each).cast("int") + 1)).drop("_test")
    cuts = hash_cuts(train, ["_g"], "_s", order_of(F.col("_g")), row_id, ranks)

    def rank(s: Column, i: Column) -> Column:
        after = F.filter(F.col("_cuts")[i], lambda c: inside_cut(c, s, order_of(i), key))
        return F.when(F.element_at("_test", (i / each).cast("int") + 1), F.lit(0).cast("bigint")).otherwise(F.try_element_at(after, F.lit(1))["rank"])

    return staged.crossJoin(one_row(cuts, "_cuts")).withColumn("_ranks", F.transform("_r", rank)).drop("_cuts", "_r", "_test")


def tagged_rows(tagged: DataFrame, seeds: Sequence[int], draws: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """Training rows (``seed, draw, rk``) and test rows (``seed``) of all repeats, from :func:`rank_tags`."""
    columns = [c for c in tagged.columns if c != "_ranks"]
    pairs = [(s, d) for s in seeds for d in draws]
    own_seed, own_draw = [F.element_at(F.array(*[F.lit(int(p[i])) for p in pairs]), F.col("_pos") + 1) for i in (0, 1)]
    placed = tagged.select(*columns, F.posexplode("_ranks").alias("_pos", "rk"))
    train = placed.where(F.col("rk") > 0).select(*columns, own_seed.alias("seed"), own_draw.alias("draw"), "rk")
    test = placed.where((F.col("rk") == 0) & (F.col("_pos") % len(draws) == 0)).select(*columns, own_seed.alias("seed"))
    return train, test


def class_swaps(ranked: DataFrame, label: str, least: int) -> DataFrame:
    """Ranks to exchange (``seed, draw, rk, _to``) so that the first ``least`` rows hold every class.

    The first row of a class that is not among them takes the place of the last of
    them that is not its own class's first. At most two rows per class and repeat.
    """
    by = ["seed", "draw"]
    firsts = ranked.groupBy(*by, label).agg(F.min("rk").alias("rk"))
    w = Window.partitionBy(*by)  # the classes of a repeat, and the first rows of its permutation
    late = firsts.where(F.col("rk") > least).select(*by, F.col("rk").alias("_late"), F.row_number().over(w.orderBy("rk")).alias("_j"))
    free = ranked.where(F.col("rk") <= least).select(*by, "rk").join(F.broadcast(firsts.select(*by, "rk")), [*by, "rk"], "left_anti")
    free = free.select(*by, F.col("rk").alias("_free"), F.row_number().over(w.orderBy(F.col("rk").desc())).alias("_j"))
    both = late.join(free, [*by, "_j"])
    return both.select(*by, F.inline(F.array(F.struct(F.col("_late").alias("rk"), F.col("_free").alias("_to")), F.struct(F.col("_free").alias("rk"), F.col("_late").alias("_to")))))


def swap_ranks(ranked: DataFrame, swaps: DataFrame) -> DataFrame:
    """Exchange ranks as :func:`class_swaps` says; its few rows are broadcast."""
    both = ranked.join(F.broadcast(swaps), ["seed", "draw", "rk"], "left")
    return both.withColumn("rk", F.coalesce("_to", "rk")).drop("_to").select(*ranked.columns)


def source_ranks(pairs: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Permutation rank ``srk`` of the manifest's sources for every (seed, draw)."""
    grid = pairs.select(
        "seed", "draw", F.explode(F.array(*[F.lit(s) for s in sources])).alias("source"))
    digest = seed_hash(F.col("seed"), F.col("draw"), "s", F.col("source"))
    # A group is the manifest's source list, never the data.
    w = Window.partitionBy("seed", "draw").orderBy(digest, "source")
    return grid.withColumn("srk", F.row_number().over(w))


def nested_prefix(ranked: DataFrame, n_grid: Sequence[int]) -> DataFrame:
    """Rows of every N: one output row per (row, N) with ``rk <= N``.

    The total is the sum of the grid, and each row only meets sizes that hold it.
    """
    sizes = F.array(*[F.lit(int(n)) for n in sorted(n_grid)])
    return ranked.where(F.col("rk") <= max(n_grid)).withColumn(
        "n", F.explode(F.filter(sizes, lambda n: n >= F.col("rk")))
    )


def band(ranked: DataFrame, n_grid: Sequence[int]) -> DataFrame:
    """The smallest N that holds each row, for statistics that add up over bands."""
    sizes = F.array(*[F.lit(int(n)) for n in sorted(n_grid)])
    return ranked.where(F.col("rk") <= max(n_grid)).withColumn(
        "band", F.element_at(F.filter(sizes, lambda n: n >= F.col("rk")), 1)
    )


def expand_sources(source_rank: DataFrame, sources: DataFrame, k_grid: Sequence[int]) -> DataFrame:
    """Features of the first K sources, for every K of the grid."""
    sizes = F.array(*[F.lit(int(k)) for k in sorted(k_grid)])
    return (
        source_rank.withColumn("k", F.explode(F.filter(sizes, lambda k: k >= F.col("srk"))))
        .join(sources.select("source", F.explode("features").alias("feature")), "source")
    )


def log2_grid(total: Column, n_sizes: int, max_size: int | None = None, min_size: int = 1) -> Column:
    """Sorted distinct sizes evenly spaced in log2, from ``min_size`` to the total."""
    upper = total if not max_size or max_size <= 0 else F.least(total, F.lit(max_size))
    upper = upper.cast("bigint")
    if n_sizes == 1:
        return F.array(upper)
    low = math.log2(min_size)
    steps = F.sequence(F.lit(0), F.lit(n_sizes - 1))

    def size(i: Column) -> Column:
        power = F.lit(low) + (F.log2(upper.cast("double")) - low) * i / F.lit(float(n_sizes - 1))
        exact = F.pow(F.lit(2.0), power)
        near = F.bround(F.round(exact, 9)).cast("bigint")
        return F.greatest(F.lit(min_size).cast("bigint"), F.least(near, upper))

    return F.array_sort(F.array_distinct(F.transform(steps, size)))


def cell_seed(*keys: Column) -> Column:
    """Unsigned 32-bit model seed of a cell; the model name is not part of it."""
    return F.conv(F.substring(F.md5(F.concat_ws(",", *keys)), 1, 8), 16, 10).cast("bigint")


def row_digest(*keys: Column) -> Column:
    """24-hex-digit identity of a task row."""
    return F.substring(F.sha2(F.concat_ws(",", *keys), 256), 1, 24)


def repeat_pairs(
    spark: SparkSession, seed: int = 0, n_seeds: int = 1, n_draws: int = 1,
    pairs: Iterable[tuple[int, int]] | None = None,
) -> DataFrame:
    """(seed, draw) pairs of a run: an explicit plan, or seeds times draws."""
    rows = pairs if pairs is not None else (
        (seed + i, d) for i in range(n_seeds) for d in range(n_draws)
    )
    return spark.createDataFrame(sorted(rows), "seed int, draw int")


def repeats_by_seed(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("seed").agg(F.sort_array(F.collect_set("draw")).alias("draws"))


def design_cells(
    pairs: DataFrame, models: Sequence[str], n_grid: Sequence[int], k_grid: Sequence[int],
    repeats: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """All cells in order (repeat, K, N, model), with their position.

    ``repeats`` may thin the (seed, draw, n, k) rows, so that repeats can
    differ by grid point.
    """
    def each(values, kind):
        return F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).cast(kind).alias("v"))
                                   for i, v in enumerate(values)]))

    grid = (
        pairs.withColumn("_k", each(sorted(k_grid), "int"))
        .withColumn("_n", each(sorted(n_grid), "int"))
        .select("*", F.col("_n.v").alias("n"), F.col("_k.v").alias("k"))
    )
    if repeats is not None:
        grid = repeats(grid)
    grid = grid.withColumn("_m", each(models, "string"))
    return grid.select(
        *[c for c in pairs.columns],
        F.col("_m.v").alias("model"), "n", "k",
        F.struct("seed", "draw", F.col("_k.i").alias("ki"), F.col("_n.i").alias("ni"),
                 F.col("_m.i").alias("mi")).alias("design_pos"),
    )


PASSTHROUGH_MODELS = ("xgboost", "lightgbm")


def execution_groups(cells: DataFrame, split_stack_min_k: int | None = None,
                     stack: str = "super_learner") -> DataFrame:
    """Models of a cell that share one preprocessing pass, per mode."""
    mode = F.when(F.col("model").isin(*PASSTHROUGH_MODELS), "passthrough").otherwise("imputed")
    group = mode
    if split_stack_min_k is not None:
        group = F.when(
            (F.col("model") == stack) & (F.col("k") >= split_stack_min_k), stack
        ).otherwise(mode)
    keys = ["seed", "draw", "n", "k", "group"]
    return (
        cells.withColumn("group", group)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_set("model")).alias("models"))
    )


def contiguous_fold(pos: Column, n: Column, folds: Column) -> Column:
    """Fold of 1-based position ``pos`` among ``n``: early folds take the extra rows."""
    base, extra = F.floor(n / folds), n % folds
    wide = extra * (base + 1)
    zero = pos - 1
    return F.when(zero < wide, F.floor(zero / (base + 1))).otherwise(
        extra + F.floor((zero - wide) / base)
    ).cast("int")


def kfold_contiguous(df: DataFrame, by: Sequence[str], order: str, folds: int) -> DataFrame:
    """Unshuffled k-fold by a unique order column."""
    pos = ordered_running(df, by, order, {"_one": F.lit(1)})
    pos = pos.select(*by, order, (F.col("_one_before") + 1).alias("_pos"),
                     F.col("_one_total").alias("_size"))
    k = F.least(F.lit(folds).cast("bigint"), F.col("_size"))
    return (
        df.join(pos, [*by, order])
        .withColumn("fold", contiguous_fold(F.col("_pos"), F.col("_size"), k))
        .drop("_pos", "_size")
    )


def kfold_shuffled(df: DataFrame, by: Sequence[str], digest: Column, row_id: str,
                   folds: int) -> DataFrame:
    """k-fold over a seeded permutation."""
    ranked = hash_rank(df, by, digest, row_id, "_pos")
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    k = F.least(F.lit(folds).cast("bigint"), F.col("_size"))
    return (
        ranked.join(sizes, list(by))
        .withColumn("fold", contiguous_fold(F.col("_pos"), F.col("_size"), k))
        .drop("_pos", "_size")
    )
