"""A synthetic panel whose every cell is a pure function of (seed, row, source).

Values come from hashes, not from a partition-bound generator, so the panel is
the same however it is partitioned and whichever task is retried.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordered import seed_hash
from tidemark.operators.design import Source

# Shares of missing cells (fixed values).
CONTINUOUS_MISSING, GROUP_MISSING = 0.10, 0.08
TWO_32 = 4294967296.0


@dataclass(frozen=True)
class PanelSpec:
    n_continuous: int = 3
    group_levels: tuple[int, ...] = (3, 2)
    # Groups stored as integers are never missing.
    integer_groups: tuple[int, ...] = (1,)
    seed: int = 7


def uniform(*parts: Column | str | int) -> Column:
    """Uniform in (0, 1) from a hash."""
    return (F.conv(F.substring(seed_hash(*parts), 1, 8), 16, 10).cast("double") + 0.5) / TWO_32


def level_cuts(seed: int, group: int, levels: int) -> list[float]:
    """Cumulative shares of a group's levels, drawn from a flat Dirichlet."""
    weights = []
    for j in range(levels):
        digest = hashlib.md5(f"{seed}|w|{group}|{j}".encode()).hexdigest()[:8]
        weights.append(-math.log((int(digest, 16) + 0.5) / TWO_32))
    total, cuts, run = sum(weights), [], 0.0
    for w in weights[:-1]:
        run += w / total
        cuts.append(run)
    return cuts


def panel(ids: DataFrame, spec: PanelSpec = PanelSpec(), row_id: str = "row_id") -> DataFrame:
    """One row per id, continuous sources then one-hot groups."""
    key = F.col(row_id)
    cols: list[Column] = []
    for i in range(spec.n_continuous):
        u, v = uniform(spec.seed, "u", i, key), uniform(spec.seed, "v", i, key)
        normal = F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * v)
        gone = uniform(spec.seed, "m", i, key) < CONTINUOUS_MISSING
        cols.append(F.when(~gone, normal).alias(f"x_{i}"))
    for g, levels in enumerate(spec.group_levels):
        u = uniform(spec.seed, "g", g, key)
        level = sum((F.when(u >= c, 1).otherwise(0) for c in level_cuts(spec.seed, g, levels)), F.lit(0))
        integer = g in spec.integer_groups
        gone = uniform(spec.seed, "h", g, key) < GROUP_MISSING
        for j in range(levels):
            hit = (level == j).cast("int" if integer else "double")
            cols.append((hit if integer else F.when(~gone, hit)).alias(f"g{g}_{j}"))
    return ids.select(row_id, *cols)


def panel_sources(spec: PanelSpec = PanelSpec()) -> Sequence[Source]:
    out = [Source(f"x_{i}", "continuous", [f"x_{i}"]) for i in range(spec.n_continuous)]
    for g, levels in enumerate(spec.group_levels):
        names = [f"g{g}_{j}" for j in range(levels)]
        out.append(Source(f"g{g}", "onehot_group", names, level_values=[str(j) for j in range(levels)],
                          reference_level="0", reference_feature=names[0]))
    return out
