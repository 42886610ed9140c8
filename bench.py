"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from tidemark import views  # noqa: E402
from tidemark.catalog import load_all  # noqa: E402
from tidemark.operators import impute as I  # noqa: E402
from tidemark.operators.design import Source  # noqa: E402
from tidemark.session import local_session  # noqa: E402
from tidemark.sources.synthetic import CONTINUOUS_MISSING, uniform  # noqa: E402

HEADLINE = [
    "sweep_baseline", "split_random", "row_permutation", "impute_fit", "ridge_cv",
    "metric_rmse", "metric_pinball", "metric_medae", "metric_spearman", "metric_ks", "metric_roc_auc",
    "profile_columns", "missing_indicators", "mask_unseen_qa",
    "dedupe_prefer_completed", "materialize", "diagnostics_numeric", "finalize_model",
    "power_law_fit", "check_ids", "content_hash", "stream_upsert",
]
# The one time the reference bounds: impute one cell of this size within a minute.
CELL_ROWS = 4242
WIDTHS = [1000, 3125, 8053]


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def wide_cell(spark, sf_dir: str, width: int):
    """A cell of hashed values over real row ids, with missing cells in every source."""
    ids = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id")).orderBy("row_id").limit(CELL_ROWS)
    base = uniform(7, "w", F.col("row_id"))
    values = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.pmod(base * (i + 3) * 7919.0, F.lit(1.0)))
    holes = F.transform(values, lambda v: F.when(v >= CONTINUOUS_MISSING, v * 100))
    return ids.repartition(int(os.environ.get("BENCH_CPUS", "8"))).select(F.lit(1).alias("cell"), "row_id", holes.alias("x"))


def time_cell(spark, sf_dir: str, width: int) -> float:
    cell = wide_cell(spark, sf_dir, width).persist()
    cell.count()
    sources = [Source(f"s{i}", "continuous", [f"s{i}"]) for i in range(width)]
    start = time.time()
    packed = I.pack_fills(I.fit_fills(cell, ["cell"], sources), ["cell"])
    drain(I.apply_fills(cell, packed, ["cell"], sources, n_cells=1))
    took = time.time() - start
    cell.unpersist()
    return took


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_all().QUERIES
    drain(queries["metric_rmse"](spark, sf_dir))  # start-up is not part of any query
    times = {}
    for name in HEADLINE:
        spark.catalog.clearCache()
        start = time.time()
        drain(queries[name](spark, sf_dir))
        times[name] = round(time.time() - start, 3)
    spark.catalog.clearCache()
    if os.environ.get("BENCH_WIDE", "1") == "1":
        wide = [time_cell(spark, sf_dir, w) for w in WIDTHS]
        for w, t in zip(WIDTHS, wide):
            times[f"preprocess_cell_k{w}"] = round(t, 3)
        growth = math.log(wide[-1] / wide[0]) / math.log(WIDTHS[-1] / WIDTHS[0])
    else:
        growth = None
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1],
        "preprocess_growth_exponent_k": None if growth is None else round(growth, 3),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
