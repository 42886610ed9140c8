"""Scan, sink, shard and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import views
from tidemark.catalog.registry import query, r, rounded
from tidemark.operators import design as D
from tidemark.operators import results as R
from tidemark.session import scratch_path
from tidemark.sources import shards as H
from tidemark.sources import synthetic as Y
from tidemark.sources import tables as T
from tidemark.streaming import ingest as G

K6 = "experiment_id, model, seed, draw, n, k"
ROW = f"{K6}, status, seq, rmse, fit_seconds, best_rounds, converged"
BEST_SQL = f"""{views.CKPT_SQL}, best AS (SELECT * FROM ckpt QUALIFY row_number() OVER (PARTITION BY {K6}
  ORDER BY (status IN ('ok', 'skipped')) DESC, seq DESC) = 1)"""


@query("scan_projected", f"SELECT o_orderkey, {r('o_totalprice', 2)} AS o_totalprice FROM orders")
def scan_projected(spark, d):
    return rounded(T.scan(spark, f"{d}/orders.parquet", ["o_orderkey", "o_totalprice"]), 2)


@query("scan_csv_projected", f"SELECT c_custkey, {r('c_acctbal', 2)} AS c_acctbal, c_mktsegment FROM customer")
def scan_csv_projected(spark, d):
    path = scratch_path(spark, "customer") + ".csv"
    source = views.table(spark, d, "customer")
    T.write(source, path)
    return rounded(T.scan(spark, path, ["c_custkey", "c_acctbal", "c_mktsegment"], source.schema), 2)


@query("load_input_projection", f"SELECT o_totalprice, o_orderkey, o_custkey, 'train' AS role FROM orders")
def load_input_projection(spark, d):
    return T.load_input(spark, f"{d}/orders.parquet", "o_totalprice", ["o_custkey"], "o_orderkey")


@query("write_tables", f"WITH {views.ARD_SQL} SELECT row_id, {r('y', 2)} AS y, x_acctbal FROM ard")
def write_tables(spark, d):
    """Parquet sink, read back."""
    path = scratch_path(spark, "ard") + ".parquet"
    T.write(views.ard(spark, d).select("row_id", "y", "x_acctbal"), path)
    return rounded(T.scan(spark, path), 2)


CHUNK_SQL = f"{views.CKPT_SQL}, t AS (SELECT DISTINCT seed, draw, n, k, model, (seed * 4 + draw)::INT AS chunk_id FROM ckpt)"


def chunked(spark, d):
    keys = ["seed", "draw", "n", "k", "model"]
    tasks = views.ckpt(spark, d).select(*keys).distinct()
    tasks = tasks.withColumn("chunk_id", F.col("seed") * 4 + F.col("draw")).withColumn("row_id", D.row_digest(*keys))
    path = scratch_path(spark, "tasks")
    T.write_chunked(tasks, path)
    return path


@query("read_chunk_pruned", f"WITH {CHUNK_SQL} SELECT * FROM t WHERE chunk_id = 7")
def read_chunk_pruned(spark, d):
    return T.read_chunk(spark, chunked(spark, d), 7).drop("row_id")


@query("write_chunked", f"WITH {CHUNK_SQL} SELECT chunk_id, count(*)::BIGINT AS n_rows FROM t GROUP BY chunk_id")
def write_chunked(spark, d):
    return spark.read.parquet(chunked(spark, d)).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_rows"))


def shard_dir(spark, d, parts: int = 6):
    """The checkpoint rows as shards, in sequence."""
    path = scratch_path(spark, "shards")
    rows = views.ckpt(spark, d)
    (rows.withColumn("batch", F.format_string("%03d", (F.col("seq") % parts).cast("int")))
     .hint("rebalance", "batch").write.partitionBy("batch").parquet(path))
    return path, rows.schema


@query("checkpoint_index", f"WITH {BEST_SQL} SELECT {K6}, status, seq FROM best")
def checkpoint_index(spark, d):
    path, _ = shard_dir(spark, d)
    return H.checkpoint_index(spark, path)


@query("shards_without_seq", f"""WITH {views.CKPT_SQL}, last AS (SELECT *, row_number() OVER (PARTITION BY {K6} ORDER BY (status IN ('ok', 'skipped')) DESC, seq // 2500 DESC, seq DESC) AS r FROM ckpt)
SELECT {K6}, status, rmse FROM last WHERE r = 1""")
def shards_without_seq(spark, d):
    """Shards of rows without a sequence number: files and places in them decide which row is the latest."""
    rows, path = views.ckpt(spark, d), scratch_path(spark, "unnumbered")
    H.append_batches(rows, path, F.lpad(F.floor(F.col("seq") / 2500).cast("string"), 12, "0"), "seq")
    return R.prefer_completed(H.in_shard_order(spark, path, schema=rows.drop("seq").schema)).select(*R.RESULT_KEYS, "status", "rmse")


@query("compact_shards", f"WITH {BEST_SQL} SELECT {ROW} FROM best")
def compact_shards(spark, d):
    """The current rows are the same after loose shards become one."""
    path, schema = shard_dir(spark, d)
    if H.compact(spark, path, threshold=5) == 0:
        raise AssertionError("nothing was compacted")
    return R.prefer_completed(H.read_shards(spark, path, schema=schema))


@query("append_batch", f"WITH {views.CKPT_SQL} SELECT count(*)::BIGINT AS n_rows, 2::BIGINT AS n_shards FROM ckpt")
def append_batch(spark, d):
    rows, path = views.ckpt(spark, d), scratch_path(spark, "batches")
    H.append_batch(rows.where("seq % 2 = 0"), path, "001")
    H.append_batch(rows.where("seq % 2 = 1"), path, "002")
    H.append_batch(rows.where("seq < 0"), path, "003")
    n = len(H.batches(spark, path))
    return H.read_shards(spark, path, schema=rows.schema).agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(n).cast("bigint").alias("n_shards"))


@query("union_heterogeneous", f"""WITH {views.CKPT_SQL} SELECT model, seq, rmse, NULL AS converged, 'ok' AS status FROM ckpt WHERE seq % 2 = 0
 UNION ALL SELECT model, seq, NULL, converged, status FROM ckpt WHERE seq % 2 = 1""")
def union_heterogeneous(spark, d):
    rows = views.ckpt(spark, d)
    return R.union_shards([rows.where("seq % 2 = 0").select("model", "seq", "rmse"),
                           rows.where("seq % 2 = 1").select("model", "seq", "converged", "status")])


@query("missingness_stats", f"WITH {views.ARD_SQL} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count_if({c} IS NULL)::BIGINT AS n_missing, {r(f'avg(({c} IS NULL)::INT)')} AS missing_fraction FROM ard""" for c in views.ARD_FEATURES))
def missingness_stats(spark, d):
    return rounded(T.missingness_stats(views.ard(spark, d), views.ARD_FEATURES))


HASH_SQL = """SELECT count(*)::BIGINT AS n_rows, sum(('0x' || substr(h, 1, 7))::BIGINT)::BIGINT AS digest_a, sum(('0x' || substr(h, 8, 7))::BIGINT)::BIGINT AS digest_b
 FROM (SELECT md5(""" + " || ".join(
    f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")) + """) AS h FROM orders)"""


@query("content_hash", HASH_SQL)
def content_hash(spark, d):
    return T.content_identity(views.table(spark, d, "orders"))


@query("run_metadata", f"SELECT 'median_mode' AS strategy, n_rows, 6 AS n_columns, md5(concat_ws('|', n_rows, digest_a, digest_b)) AS identity FROM ({HASH_SQL})")
def run_metadata(spark, d):
    return T.run_metadata(views.table(spark, d, "orders"), "median_mode")


SPEC = Y.PanelSpec()


def _u(*parts: str) -> str:
    return f"((('0x' || substr(md5(concat_ws('|', {SPEC.seed}, {', '.join(parts)}, row_id)), 1, 8))::BIGINT + 0.5::DOUBLE) / {Y.TWO_32}::DOUBLE)"


def _panel_sql() -> str:
    cols = []
    for i in range(SPEC.n_continuous):
        u, v, m = (_u(f"'{t}'", str(i)) for t in "uvm")
        cols.append(f"CASE WHEN {m} >= {Y.CONTINUOUS_MISSING} THEN {r(f'sqrt(-2 * ln({u})) * cos(2 * pi() * {v})')} END AS x_{i}")
    for g, levels in enumerate(SPEC.group_levels):
        u = _u("'g'", str(g))
        level = " + ".join(f"({u} >= {c!r}::DOUBLE)::INT" for c in Y.level_cuts(SPEC.seed, g, levels))
        for j in range(levels):
            if g in SPEC.integer_groups:
                cols.append(f"({level} = {j})::INT AS g{g}_{j}")
            else:
                miss = _u("'h'", str(g))
                cols.append(f"CASE WHEN {miss} >= {Y.GROUP_MISSING} THEN ({level} = {j})::INT::DOUBLE END AS g{g}_{j}")
    return f"SELECT row_id, {', '.join(cols)} FROM (SELECT o_orderkey AS row_id FROM orders)"


@query("synthetic_panel", _panel_sql())
def synthetic_panel(spark, d):
    ids = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"))
    return rounded(Y.panel(ids, SPEC))


# ---- streaming ------------------------------------------------------------------
@query("stream_ingest", f"WITH {views.CKPT_SQL} SELECT {ROW} FROM ckpt")
def stream_ingest(spark, d):
    path, schema = shard_dir(spark, d)
    out, pos = scratch_path(spark, "table"), scratch_path(spark, "position")
    G.ingest(G.shard_stream(spark, path, schema, 2), out, pos)
    return spark.read.schema(schema).parquet(out)


@query("stream_upsert", f"WITH {BEST_SQL} SELECT {ROW} FROM best")
def stream_upsert(spark, d):
    path, schema = shard_dir(spark, d)
    out, pos = scratch_path(spark, "table"), scratch_path(spark, "position")
    G.upsert(G.shard_stream(spark, path, schema, 2), out, pos)
    return G.read_upserted(spark, out)


@query("stream_resume", f"WITH {views.CKPT_SQL} SELECT {ROW} FROM ckpt")
def stream_resume(spark, d):
    """Stop after two batches, go on later: nothing is lost or repeated."""
    path, schema = shard_dir(spark, d)
    out, pos = scratch_path(spark, "table"), scratch_path(spark, "position")
    G.run_batches(G.shard_stream(spark, path, schema, 1), out, pos, stop_after=2)
    G.run_batches(G.shard_stream(spark, path, schema, 1), out, pos)
    return spark.read.schema(schema).parquet(f"{out}/*")


@query("stream_status", f"WITH {views.CKPT_SQL} SELECT model, status, count(*)::BIGINT AS n FROM ckpt GROUP BY ALL")
def stream_status(spark, d):
    path, schema = shard_dir(spark, d)
    out, pos = scratch_path(spark, "table"), scratch_path(spark, "position")
    G.status_totals(G.shard_stream(spark, path, schema, 2), out, pos)
    return spark.read.parquet(out)
