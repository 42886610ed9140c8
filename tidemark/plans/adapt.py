"""Raw survey tables to analysis-ready rows, profile and encoding fixed by the training pool."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import checks as V
from tidemark.operators import encode as E
from tidemark.operators import joins as J
from tidemark.operators import profile as P
from tidemark.operators.design import Source, feature_names
from tidemark.operators.impute import assemble
from tidemark.sources import tables as T


@dataclass
class Adapted:
    """``rows``: (outcome, role, id, y, x) with ``x`` in manifest order."""

    rows: DataFrame
    sources: list[Source]
    manifest: DataFrame
    unknown_qa: DataFrame
    coverage_qa: DataFrame
    summary: DataFrame

    def violations(self) -> DataFrame:
        return V.combine([V.check_manifest(self.manifest), V.check_unknown_rate(self.unknown_qa),
                          V.check_unknown_rate(self.coverage_qa)])

    def write(self, path: str) -> None:
        """Rows by outcome and role, manifest and QA tables below one path."""
        self.rows.write.mode("overwrite").partitionBy("outcome", "role").parquet(f"{path}/rows")
        T.write(self.manifest, f"{path}/manifest.csv")
        self.unknown_qa.write.mode("overwrite").parquet(f"{path}/unknown_categories")
        self.coverage_qa.write.mode("overwrite").parquet(f"{path}/outcome_coverage")
        self.summary.write.mode("overwrite").parquet(f"{path}/outcome_summary")


def adapt(raw: DataFrame, outcomes: DataFrame, key: str, pool: str, columns: Sequence[str],
          outcome_names: Sequence[str], strategy: str = "median_mode",
          config: P.ScreenConfig = P.ScreenConfig(), labels: dict[str, dict[float, str]] | None = None,
          unknown_ceiling: float = 0.95) -> Adapted:
    """Profile on the training pool, encode all rows, join outcomes, mask unseen states.

    ``raw`` has ``pool`` 'train' or 'test'; test rows never shape the encoding.
    Raises when a key repeats or has no partner, when the manifest is at fault, or
    when a column's unknown answers pass their ceiling.
    """
    train = raw.where(F.col(pool) == "train")
    test_ids = raw.where(F.col(pool) == "test").select(key)
    V.assert_valid(V.check_ids(train, test_ids, key))
    kept = P.collect_sources(train, columns, config, labels)
    encoded = E.ENCODERS[strategy](raw, key, kept)
    has_categories = any(s.status == "categorical" for s in kept)
    unknown = (E.unknown_category_qa(raw, test_ids, key, kept, unknown_ceiling) if has_categories else None)

    names = feature_names(encoded.sources)
    features = assemble(encoded.features, names)
    answers = outcomes.join(raw.select(key, pool), key)
    faults = J.one_to_one_violations(answers, features, key)
    V.assert_valid(faults.select(F.lit("one_to_one").alias("check_id"), F.col("kind").alias("subject"), "example", "n"))
    wide = J.join_one_to_one(answers, features, key)
    long = wide.select(
        F.explode(F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).cast("double").alias("y"))
                            for o in outcome_names])).alias("o"),
        F.col(pool).alias("role"), F.col(key), "x").select("o.outcome", "role", key, "o.y", "x")
    masked, coverage = E.mask_unseen(long, encoded.sources, threshold=unknown_ceiling)
    summary = J.outcome_summary(answers, encoded.features, key, pool, outcome_names, len(names))
    if unknown is None:
        unknown = coverage.limit(0).drop("outcome", "unit_type")
    found = Adapted(masked, encoded.sources, encoded.manifest(), unknown, coverage, summary)
    V.assert_valid(found.violations())
    return found
