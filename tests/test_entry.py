"""Registered queries against their SQL, on the given tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402
from tools.check import rows_of  # noqa: E402

SF = "/root/testdata/sf0.01"
SAMPLE = ["sweep_baseline", "split_stratified", "metric_rmse", "metric_decile_hits", "metric_roc_auc", "impute_fit",
          "screen_columns", "missing_indicators", "dedupe_prefer_completed", "finalize_model", "power_law_fit",
          "check_manifest", "content_hash", "stream_status", "load_balance"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry.oracle_sql()[name])
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert got == want and got[1]


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150
