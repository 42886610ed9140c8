"""Leakage-free imputation: statistics come from the training rows of one cell.

Features travel as one ``x ARRAY<DOUBLE>`` in manifest order, so the plan has
the same size for eight predictors and for eight thousand. A *unit* is a
source's single value in a row: the number itself, or for a one-hot group the
position of the level that is set (-1 for the reference of a drop-first group).
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordered import exact_quantiles, ordered_running
from tidemark.operators.design import Source, source_positions

_SPEC_DDL = (
    "array<struct<src:int,name:string,kind:string,start:int,width:int,drop:boolean,"
    "levels:array<double>,prior:array<double>>>"
)
# A per-cell table up to this size is broadcast; beyond it Spark joins by key.
MAX_BROADCAST_BYTES = 64 << 20
# Many sources with one histogram each: a coarse one combines well before the shuffle.
FILL_STEPS = 32
# Manifests up to this many features are written out as expressions that Spark compiles; longer ones are walked.
MAX_COMPILED_FEATURES = 64


def source_spec(sources: Sequence[Source], kinds: Sequence[str] | None = None) -> Column:
    """The manifest, or its sources of some kinds, as one constant array, so expressions can walk it."""
    spec = [
        {
            "src": i, "name": s.name, "kind": s.unit_type, "start": pos[0], "width": len(pos),
            "drop": s.drop_first, "levels": s.ordinal_levels, "prior": s.prior_values(),
        }
        for i, (s, pos) in enumerate(zip(sources, source_positions(sources)))
        if kinds is None or s.unit_type in kinds
    ]
    return F.from_json(F.lit(json.dumps(spec)), _SPEC_DDL)


def assemble(df: DataFrame, features: Sequence[str], out: str = "x") -> DataFrame:
    """Fold feature columns into one array; NaN becomes NULL."""
    cols = [F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) for f in features]
    rest = [c for c in df.columns if c not in features]
    return df.select(*rest, F.array(*cols).alias(out))


def _slice(x: Column, s: Column) -> Column:
    return F.slice(x, s["start"] + 1, s["width"])


def _all_null(x: Column, s: Column) -> Column:
    return F.forall(_slice(x, s), lambda v: v.isNull())


def _unit(x: Column, s: Column) -> Column:
    level = F.array_position(_slice(x, s), F.lit(1.0)).cast("double") - 1
    return F.when(
        s["kind"] == "onehot_group", F.when(~_all_null(x, s), level)
    ).otherwise(F.element_at(x, s["start"] + 1))


def _compiled(sources: Sequence[Source]) -> bool:
    return sum(len(s.features) for s in sources) <= MAX_COMPILED_FEATURES


def _own_missing(x: Column, pos: Sequence[int]) -> Column:
    return reduce(lambda a, b: a & b, [x[p].isNull() for p in pos])


def _own_unit(x: Column, s: Source, pos: Sequence[int]) -> Column:
    """As ``_unit``, of a source that is known when the plan is made."""
    if s.unit_type != "onehot_group":
        return x[pos[0]]
    level = F.when(_own_missing(x, pos), F.lit(None).cast("double"))
    for j, p in enumerate(pos):
        level = level.when(x[p] == 1.0, F.lit(float(j)))
    return level.otherwise(F.lit(-1.0))


def _own_filled(x: Column, s: Source, i: int, pos: Sequence[int], passthrough: bool) -> list[Column]:
    """As ``_filled``, of a source that is known when the plan is made: a column per feature."""
    seen, fill = F.col("seen")[i], F.col("fills")[i]
    if passthrough:
        return [F.when(seen, x[p]) for p in pos]
    priors = [F.lit(float(v)) for v in s.prior_values()]
    if s.unit_type == "onehot_group":
        missing = _own_missing(x, pos)
        return [F.when(~seen, prior).when(missing, (F.lit(float(j)) == fill).cast("double")).otherwise(x[p]) for j, (p, prior) in enumerate(zip(pos, priors))]
    return [F.when(~seen, prior).otherwise(F.coalesce(x[p], fill)) for p, prior in zip(pos, priors)]


def units(df: DataFrame, by: Sequence[str], sources: Sequence[Source], x: str = "x", kinds: Sequence[str] | None = None) -> DataFrame:
    """Long form ``(by, src, unit)`` of all sources or of some kinds; ``unit`` is NULL where the source is missing."""
    if _compiled(sources):
        own = [(i, s, pos) for i, (s, pos) in enumerate(zip(sources, source_positions(sources))) if kinds is None or s.unit_type in kinds]
        values = F.array(*[F.struct(F.lit(i).alias("src"), _own_unit(F.col(x), s, pos).alias("unit")) for i, s, pos in own])
    else:
        values = F.transform(source_spec(sources, kinds), lambda s: F.struct(s["src"].alias("src"), _unit(F.col(x), s).alias("unit")))
    return df.select(*by, F.inline(values))


def observed_sources(long: DataFrame, by: Sequence[str]) -> DataFrame:
    return long.groupBy(*by, "src").agg((F.count("unit") > 0).alias("observed"))


def fit_continuous(long: DataFrame, by: Sequence[str], how: str = "median") -> DataFrame:
    """Median or mean of the observed values, per cell and source."""
    keys = [*by, "src"]
    if how == "mean":
        return long.where(F.col("unit").isNotNull()).groupBy(*keys).agg(F.avg("unit").alias("fill"))
    return exact_quantiles(long, keys, "unit", {"fill": 0.5}, FILL_STEPS)


def _counts(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (long.where(F.col("unit").isNotNull())
            .groupBy(*keys, "unit").agg(F.count(F.lit(1)).alias("_c")))


def fit_ordinal(long: DataFrame, by: Sequence[str], sources: Sequence[Source],
                how: str = "most_frequent") -> DataFrame:
    """Mode (tie: first declared level), or median snapped to the nearest observed level."""
    keys = [*by, "src"]
    counts = _counts(long, keys)
    if how == "most_frequent":
        levels = F.element_at(source_spec(sources), F.col("src") + 1)["levels"]
        order = -F.array_position(levels, F.col("unit"))
        return counts.groupBy(*keys).agg(
            F.max_by("unit", F.struct("_c", order.alias("_first"))).alias("fill"))
    # The median of the levels' counts: no second look at the rows.
    run = ordered_running(counts, keys, "unit", {"_n": F.col("_c")})
    place = (F.col("_n_total") - 1) * 0.5

    def level(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_n_before")) & (rank < F.col("_n_before") + F.col("_n")), F.col("unit")))

    low, high = level(F.floor(place)), level(F.ceil(place))
    middle = run.groupBy(*keys).agg((low + (high - low) * F.max(place - F.floor(place))).alias("_mid"))
    gap = F.abs(F.col("unit") - F.col("_mid"))
    return counts.join(middle, keys).groupBy(*keys).agg(
        F.min_by("unit", F.struct(gap.alias("_gap"), F.col("unit").alias("_level"))).alias("fill"))


def fit_onehot(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """Most frequent state of the whole group (tie: reference, then feature order)."""
    keys = [*by, "src"]
    return _counts(long, keys).groupBy(*keys).agg(
        F.max_by("unit", F.struct("_c", (-F.col("unit")).alias("_first"))).alias("fill"))


def fit_modes(long: DataFrame, by: Sequence[str], sources: Sequence[Source]) -> DataFrame:
    """Modes of ordinal sources and of one-hot groups, as ``fit_ordinal`` and ``fit_onehot``, from one count."""
    keys = [*by, "src"]
    spec = F.element_at(source_spec(sources), F.col("src") + 1)
    order = F.when(spec["kind"] == "ordinal", -F.array_position(spec["levels"], F.col("unit")).cast("double")).otherwise(-F.col("unit"))
    return _counts(long, keys).groupBy(*keys).agg(F.max_by("unit", F.struct("_c", order.alias("_first"))).alias("fill"))


def fit_seen(train: DataFrame, by: Sequence[str], sources: Sequence[Source], x: str = "x") -> DataFrame:
    """What rows that pass through need, in the form of ``fit_fills``: which sources a cell observed."""
    return observed_sources(units(train, by, sources, x), by).select(*by, "src", F.lit(None).cast("double").alias("fill"), "observed")


def fit_fills(train: DataFrame, by: Sequence[str], sources: Sequence[Source],
              continuous: str = "median", ordinal: str = "most_frequent",
              x: str = "x") -> DataFrame:
    """Fill statistic of every source in every cell: ``(by, src, fill, observed)``."""
    by = list(by)

    def long(kind: str) -> DataFrame:
        return units(train, by, sources, x, [kind])

    kinds = {s.unit_type for s in sources}
    parts = []
    if "continuous" in kinds:
        parts.append(fit_continuous(long("continuous"), by, continuous))
    if kinds >= {"ordinal", "onehot_group"} and ordinal == "most_frequent":
        parts.append(fit_modes(units(train, by, sources, x, ["ordinal", "onehot_group"]), by, sources))
    else:
        if "ordinal" in kinds:
            parts.append(fit_ordinal(long("ordinal"), by, sources, ordinal))
        if "onehot_group" in kinds:
            parts.append(fit_onehot(long("onehot_group"), by))
    fills = parts[0]
    for p in parts[1:]:
        fills = fills.unionByName(p)
    # A source has a fill where it was observed, so cells times sources need no pass over values.
    grid = train.select(*by).distinct().withColumn("src", F.explode(F.sequence(F.lit(0), F.lit(len(sources) - 1))))
    return grid.join(fills, [*by, "src"], "left").select(
        *by, "src", "fill", F.col("fill").isNotNull().alias("observed"))


def pack_fills(fills: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per cell: fills and observed flags in source order."""
    rows = F.array_sort(F.collect_list(F.struct("src", "fill", "observed")))
    return fills.groupBy(*by).agg(rows.alias("_f")).select(
        *by, F.col("_f.fill").alias("fills"), F.col("_f.observed").alias("seen"))


def join_cells(rows: DataFrame, cells: DataFrame, by: Sequence[str], n_cells: int | None = None,
               how: str = "inner", width: int = 8) -> DataFrame:
    """Attach one row per cell, holding about ``width`` numbers.

    The table is broadcast only where the design proves it small; otherwise it
    is an ordinary join, whose skewed cells adaptive execution splits.
    """
    if n_cells is not None and n_cells * (width + 8) * 16 <= MAX_BROADCAST_BYTES:
        cells = F.broadcast(cells)
    return rows.join(cells, list(by), how)


def _filled(x: Column, s: Column, i: Column, passthrough: bool) -> Column:
    seen = F.element_at(F.col("seen"), i + 1)
    fill = F.element_at(F.col("fills"), i + 1)
    own = _slice(x, s)
    if passthrough:
        return F.when(seen, own).otherwise(F.transform(own, lambda v: F.lit(None).cast("double")))
    group = F.when(
        _all_null(x, s),
        F.transform(s["prior"], lambda _v, j: (j.cast("double") == fill).cast("double")),
    ).otherwise(own)
    single = F.transform(own, lambda v: F.coalesce(v, fill))
    return F.when(~seen, s["prior"]).when(s["kind"] == "onehot_group", group).otherwise(single)


def apply_fills(rows: DataFrame, packed: DataFrame, by: Sequence[str],
                sources: Sequence[Source], passthrough: bool = False,
                n_cells: int | None = None, x: str = "x") -> DataFrame:
    """Impute rows of any role with their cell's fills.

    A source never observed in the cell's training rows is overwritten by its
    prior (NULL when ``passthrough``), even where the row has a value.
    """
    if _compiled(sources):
        filled = F.array(*[c for i, (s, pos) in enumerate(zip(sources, source_positions(sources))) for c in _own_filled(F.col(x), s, i, pos, passthrough)])
    else:
        filled = F.flatten(F.transform(
            source_spec(sources), lambda s, i: _filled(F.col(x), s, i, passthrough)))
    return join_cells(rows, packed, by, n_cells, width=2 * len(sources)).withColumn(x, filled).drop("fills", "seen")


def k_unobserved(fills: DataFrame, selected: DataFrame, by: Sequence[str]) -> DataFrame:
    """How many of the first K sources a cell never observed.

    ``selected``: ``(seed, draw, k, src)`` rows of the chosen sources.
    """
    return (
        selected.join(fills.select(*by, "src", "observed"), ["seed", "draw", "src"])
        .groupBy(*by, "k")
        .agg(F.count_if(~F.col("observed")).alias("k_unobserved"),
             F.count(F.lit(1)).alias("k_sources"))
    )


def feature_ranges(filled: DataFrame, by: Sequence[str], sources: Sequence[Source],
                   x: str = "x") -> DataFrame:
    """Whether each feature varies within a cell, with its source."""
    owner = [i for i, pos in enumerate(source_positions(sources)) for _ in pos]
    long = filled.select(*by, F.posexplode(x).alias("pos", "v"))
    return (
        long.groupBy(*by, "pos")
        .agg((F.min("v") != F.max("v")).alias("_var"), F.count(F.lit(1)).alias("n_rows"))
        .select(*by, "pos", F.coalesce("_var", F.lit(False)).alias("varies"), "n_rows",
                F.element_at(F.array(*[F.lit(o) for o in owner]), F.col("pos") + 1).alias("src"))
    )


def k_varying(ranges: DataFrame, selected: DataFrame, by: Sequence[str]) -> DataFrame:
    """Varying sources, varying expanded columns and the underdetermined flag per K."""
    per_source = ranges.groupBy(*by, "src").agg(
        F.bool_or("varies").alias("varies"), F.count_if("varies").alias("cols"),
        F.max("n_rows").alias("n_rows"))
    return (
        selected.join(per_source, ["seed", "draw", "src"])
        .groupBy(*by, "k")
        .agg(F.count_if("varies").alias("k_varying"),
             F.sum("cols").alias("varying_columns"),
             (F.sum("cols") >= F.max("n_rows")).alias("underdetermined"))
    )


def constant_prediction(preds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Fewer than two distinct finite predictions."""
    p = F.col("y_pred")
    finite = F.when(~F.isnan(p) & (F.abs(p) != float("inf")), p)
    return preds.groupBy(*by).agg(
        (F.coalesce(F.min(finite) == F.max(finite), F.lit(True))).alias("constant_prediction"))


def standardize(filled: DataFrame, by: Sequence[str], x: str = "x",
                n_cells: int | None = None, width: int = 1000, fitted_on: DataFrame | None = None) -> DataFrame:
    """Centre and scale every feature by its cell's mean and population deviation.

    These are taken from the rows of ``fitted_on``, where given: a cell's training rows.
    """
    scales = feature_scales(filled if fitted_on is None else fitted_on, by, x)
    return apply_scales(filled, scales, by, x, n_cells, width)


def feature_scales(rows: DataFrame, by: Sequence[str], x: str = "x") -> DataFrame:
    """One row per cell: mean and deviation of every feature, ``_z`` in the order of ``x``."""
    long = rows.select(*by, F.posexplode(x).alias("pos", "v"))
    stats = long.groupBy(*by, "pos").agg(
        F.avg("v").alias("m"), F.stddev_pop("v").alias("s"),
        (F.min("v") != F.max("v")).alias("varies"))
    return stats.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("pos", "m", F.when(F.col("varies"), F.col("s"))
                                             .otherwise(1.0).alias("s")))).alias("_z"))


def apply_scales(rows: DataFrame, scales: DataFrame, by: Sequence[str], x: str = "x", n_cells: int | None = None, width: int = 1000) -> DataFrame:
    """Centre and scale rows of any role with their cell's ``feature_scales``."""
    scaled = F.zip_with(x, "_z", lambda v, z: (v - z["m"]) / z["s"])
    return join_cells(rows, scales, by, n_cells, width=3 * width).withColumn(x, scaled).drop("_z")
