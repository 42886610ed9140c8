"""Encoders from profiled raw columns to model features."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as X
from tidemark.operators.design import Source
from tidemark.operators.impute import units
from tidemark.operators.profile import RawSource

# Manifest columns (fixed names).
MANIFEST_DDL = (
    "source_column string, feature_name string, keep boolean, source_order int, "
    "feature_order int, unit_type string, drop_first boolean, is_reference boolean, "
    "reference_level string, level_value string, ordinal_levels string, source_prior double, "
    "kind string, strategy string, reason string, prevalence double, observed_variance double, "
    "mapping_id string"
)


@dataclass
class Encoded:
    """Features of a strategy, and the sources they form."""

    strategy: str
    features: DataFrame
    sources: list[Source]

    def manifest(self) -> DataFrame:
        return manifest_frame(self.features.sparkSession, self.sources, self.strategy)


def _level_name(source: RawSource, level: float) -> str:
    return f"C_{source.safe_name}__{source.suffixes[level]}"


def states(c: Column, levels: Sequence[float]) -> dict[str, Column]:
    """Number of a categorical answer and whether it is known, unknown or missing."""
    number = X.to_number(c)
    known = F.coalesce(number.isin([float(v) for v in levels]), F.lit(False))
    return {
        "number": number,
        "known": known,
        "unknown": number.isNotNull() & ~known,
        "missing": X.is_blank(c) | X.is_coded(c),
    }


def _numeric(source: RawSource) -> tuple[Source, list[Column]]:
    name = f"X_{source.safe_name}"
    return (Source(source.column, "continuous", [name], prior=0.0),
            [X.to_number(F.col(source.column)).alias(name)])


def _onehot(source: RawSource) -> tuple[Source, list[Column]]:
    s = states(F.col(source.column), source.levels)
    names = [_level_name(source, v) for v in source.levels]
    cols = [F.when(s["known"], (s["number"] == v).cast("double")).alias(n)
            for v, n in zip(source.levels, names)]
    return (Source(source.column, "onehot_group", names,
                   level_values=[source.tokens[v] for v in source.levels],
                   reference_level=source.tokens[source.levels[0]], reference_feature=names[0]), cols)


def _indicators(source: RawSource) -> list[tuple[Source, list[Column]]]:
    """One 0/1 source per kept missing code of a column."""
    out = []
    raw = F.col(source.column)
    for token, keep in source.missing:
        if not keep:
            continue
        hit = X.is_blank(raw) if token == "blank" else X.normalize(raw) == token
        last = ("blank" if source.status == "numeric" else "missing") if token == "blank" else (
            f"neg_{abs(int(float(token)))}")
        name = f"M_{source.safe_name}__{last}"
        suffix = "blank" if token == "blank" else f"code_{token}"
        out.append((Source(f"{source.column}__missing__{suffix}", "continuous", [name], prior=0.0),
                    [hit.cast("double").alias(name)]))
    return out


def _ordinal(source: RawSource) -> tuple[Source, list[Column]]:
    name = f"C_{source.safe_name}"
    s = states(F.col(source.column), source.levels)
    index = F.array_position(F.array(*[F.lit(float(v)) for v in source.levels]), s["number"]) - 1
    return (Source(source.column, "ordinal", [name],
                   ordinal_levels=[float(i) for i in range(len(source.levels))]),
            [F.when(s["known"], index.cast("double")).alias(name)])


def _encode(strategy: str, frame: DataFrame, key: str, sources: Sequence[RawSource],
            categorical, with_indicators: bool) -> Encoded:
    built: list[tuple[Source, list[Column]]] = []
    for s in sources:
        built.append(_numeric(s) if s.status == "numeric" else categorical(s))
        if with_indicators:
            built.extend(_indicators(s))
    cols = [c for _, group in built for c in group]
    return Encoded(strategy, frame.select(key, *cols), [s for s, _ in built])


def encode_median_mode(frame: DataFrame, key: str, sources: Sequence[RawSource]) -> Encoded:
    """One-hot groups that are missing as a whole; numbers pass through."""
    return _encode("median_mode", frame, key, sources, _onehot, False)


def encode_missing_indicator(frame: DataFrame, key: str, sources: Sequence[RawSource]) -> Encoded:
    """As median_mode, plus a 0/1 source per missing code after its parent."""
    return _encode("median_missing_indicator", frame, key, sources, _onehot, True)


def encode_tree_ordinal(frame: DataFrame, key: str, sources: Sequence[RawSource]) -> Encoded:
    """Categorical answers become the index of their level."""
    return _encode("tree_ordinal", frame, key, sources, _ordinal, False)


Encoder = Callable[[DataFrame, str, Sequence[RawSource]], Encoded]
ENCODERS: dict[str, Encoder] = {
    "median_mode": encode_median_mode,
    "median_missing_indicator": encode_missing_indicator,
    "tree_ordinal": encode_tree_ordinal,
}


def manifest_frame(spark: SparkSession, sources: Sequence[Source], strategy: str = "") -> DataFrame:
    """One row per feature, in (source_order, feature_order)."""
    rows = []
    for i, s in enumerate(sources):
        for j, f in enumerate(s.features):
            onehot = s.unit_type == "onehot_group"
            levels = "[" + ",".join(f"{v:g}" for v in s.ordinal_levels) + "]" if s.ordinal_levels else None
            rows.append((
                s.name, f, True, i, j, s.unit_type, s.drop_first, onehot and f == s.reference_feature,
                s.reference_level, s.level_values[j] if s.level_values else None, levels,
                None if onehot else s.prior_values()[0], f[:1], strategy, "kept", None, None, None))
    return spark.createDataFrame(rows, MANIFEST_DDL)


def kept_source_order(manifest: DataFrame) -> DataFrame:
    return (manifest.where("keep").select("source_column", "source_order").distinct()
            .orderBy("source_order"))


def same_sources(left: DataFrame, right: DataFrame) -> DataFrame:
    """Whether two manifests keep the same sources in the same order."""
    def rank(m: DataFrame) -> DataFrame:
        return m.where("keep").select("source_column", "source_order").distinct()

    both = rank(left).withColumn("l", F.lit(1)).join(
        rank(right).withColumn("r", F.lit(1)), ["source_column", "source_order"], "full_outer")
    return both.agg(F.bool_and(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("same"),
                    F.count(F.lit(1)).alias("n_sources"))


def unknown_category_qa(frame: DataFrame, test_ids: DataFrame, key: str,
                        sources: Sequence[RawSource], threshold: float = 0.95) -> DataFrame:
    """Unknown answers among numeric answers of test rows, per categorical column."""
    test = frame.join(test_ids.select(key), key, "left_semi")
    entries = []
    for s in sources:
        if s.status == "categorical":
            st = states(F.col(s.column), s.levels)
            entries.append(F.struct(F.lit(s.column).alias("source_column"), st["unknown"].alias("u"),
                                    st["number"].isNotNull().alias("d")))
    rate = F.coalesce(F.count_if("u") / F.nullif(F.count_if("d"), F.lit(0)), F.lit(0.0))
    return (
        test.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
        .groupBy("source_column")
        .agg(F.count_if("u").alias("unknown_count"), F.count_if("d").alias("denominator"),
             rate.alias("unknown_rate"))
        .withColumn("exceeds", F.col("unknown_rate") > threshold)
    )


def seen_states(rows: DataFrame, sources: Sequence[Source], outcome: str = "outcome",
                y: str = "y") -> DataFrame:
    """Category states per outcome among training rows whose outcome is observed."""
    train = rows.where((F.col("role") == "train") & F.col(y).isNotNull())
    pairs = units(train, [outcome], sources).where(F.col("unit").isNotNull()).distinct()
    categorical = [i for i, s in enumerate(sources) if s.unit_type != "continuous"]
    pairs = pairs.where(F.col("src").isin(categorical))
    # Bounded by the levels the manifest declares.
    per_source = pairs.groupBy(outcome, "src").agg(F.collect_set("unit").alias("s"))
    return per_source.groupBy(outcome).agg(
        F.map_from_entries(F.collect_list(F.struct("src", "s"))).alias("seen_states"))


def mask_unseen(rows: DataFrame, sources: Sequence[Source], outcome: str = "outcome",
                y: str = "y", threshold: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Blank test categories that no outcome-observed training row has.

    ``rows``: ``(outcome, role, row_id, y, x)``. Returns the masked rows and a
    QA table per (outcome, source).
    """
    from tidemark.operators.impute import _slice, _unit, source_spec

    seen = seen_states(rows, sources, outcome, y)
    spec = source_spec(sources)
    # One row per outcome.
    joined = rows.join(F.broadcast(seen), outcome, "left")

    def unseen(s: Column, i: Column) -> Column:
        u = _unit(F.col("x"), s)
        known = F.array_contains(F.element_at(F.col("seen_states"), i), u)
        return ((s["kind"] != "continuous") & (F.col("role") == "test") & F.col(y).isNotNull()
                & u.isNotNull() & ~F.coalesce(known, F.lit(False)))

    flags = joined.withColumn("_bad", F.transform(spec, unseen))
    blank = F.flatten(F.transform(spec, lambda s, i: F.when(
        F.element_at(F.col("_bad"), i + 1),
        F.transform(_slice(F.col("x"), s), lambda v: F.lit(None).cast("double")),
    ).otherwise(_slice(F.col("x"), s))))
    masked = flags.withColumn("x", blank).drop("_bad", "seen_states")
    test = flags.where((F.col("role") == "test") & F.col(y).isNotNull())
    entries = F.transform(spec, lambda s, i: F.struct(
        s["name"].alias("source_column"), s["kind"].alias("unit_type"),
        F.element_at(F.col("_bad"), i + 1).alias("u"), _unit(F.col("x"), s).isNotNull().alias("d")))
    rate = F.coalesce(F.count_if("u") / F.nullif(F.count_if("d"), F.lit(0)), F.lit(0.0))
    qa = (
        test.select(outcome, F.explode(entries).alias("e")).select(outcome, "e.*")
        .where(F.col("unit_type") != "continuous")
        .groupBy(outcome, "source_column", "unit_type")
        .agg(F.count_if("u").alias("unknown_count"), F.count_if("d").alias("denominator"),
             rate.alias("unknown_rate"))
        .withColumn("exceeds", F.col("unknown_rate") > threshold)
    )
    return masked, qa


def feature_universe(manifest: DataFrame) -> DataFrame:
    """Canonical description of each source, in manifest order."""
    detail = F.struct("feature_order", "feature_name", "level_value", "is_reference", "keep")
    return (
        manifest.groupBy("source_column", "source_order", "unit_type", "drop_first",
                         "reference_level", "ordinal_levels")
        .agg(F.array_sort(F.collect_list(detail)).alias("features"))
    )


def groups_from_header(columns: Sequence[str], prefix: str = "", separator: str = "_",
                       binary: Sequence[str] | None = None) -> list[Source]:
    """One-hot groups read off a header: ``source_level`` columns that stand together.

    A group needs two or more neighbouring columns with the same stem; the
    first level is the reference. Other columns are continuous.
    """
    def stem(c: str) -> str | None:
        body = c.rsplit(separator, 1)
        usable = len(body) == 2 and body[1] != "" and (binary is None or c in binary)
        return body[0] if usable else None

    blocks: list[tuple[str | None, list[str]]] = []
    for c in columns:
        if not c.startswith(prefix):
            continue
        name = stem(c)
        if blocks and name is not None and blocks[-1][0] == name:
            blocks[-1][1].append(c)
        else:
            blocks.append((name, [c]))
    names = [n for n, members in blocks if n is not None and len(members) > 1]
    if len(names) != len(set(names)):
        raise ValueError("a one-hot group must be one contiguous block of columns")
    out: list[Source] = []
    for name, members in blocks:
        if name is not None and len(members) > 1:
            levels = [m[len(name) + len(separator):] for m in members]
            out.append(Source(name, "onehot_group", members, level_values=levels,
                              reference_level=levels[0], reference_feature=members[0]))
        else:
            out.extend(Source(m, "continuous", [m]) for m in members)
    return out
