"""Nearest neighbours by inner product: a pruned graph per shard, searched by beams.

Rows are dealt to shards by the size of their largest component and by their ids, so
copies of a vector spread evenly and norms in a shard are alike, as 32-bit points
need; inside a shard equal vectors are one node. The graphs are a written table. Queries meet
every shard in blocks of bounded size, each shard returns its best in exact double
precision, and the best of all shards are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import vamana
from tidemark.llm.groups import runs
from tidemark.llm.tables import stored

SHARD_ROWS, LEAST_SHARDS = 50_000, 8
QUERY_BLOCK = 4096
BEAM, WIDEST = 96, 384
#: Queries of a block whose answers are measured, and the share of true answers asked of them.
PROBES, RECALL = 64, 0.95
SCAN_QUERIES, SCAN_NODES = 64, 8192
#: Largest components in a shard differ by less than this power of two.
CLASS_BITS = 4


def usable(vector: Column) -> Column:
    """Neither NULL nor zero, without NULL, infinite or NaN components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as a matrix."""
    flat = np.concatenate([c.flatten().to_numpy() for c in col.chunks])
    return flat.reshape(len(col), -1)


def index(rows: DataFrame, most: int) -> DataFrame:
    """One row per (dimension, shard): ``shard``, vectors, edges and the ids of every node.

    Of a node's ids the ``most`` smallest are kept; no answer can hold others, since
    ties go to smaller ids.
    """
    schema = "dim int, shard long, start int, n int, vectors binary, edges binary, ids binary, id_at binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "g"):
            ids, v = t.column("vec_id").to_numpy(), _matrix(t.column("v"))
            order = np.lexsort((ids, *v.T))
            ids, v = ids[order], v[order]
            new = np.ones(len(v), bool)
            new[1:] = (v[1:] != v[:-1]).any(axis=1)
            first = np.flatnonzero(new)
            keep = np.arange(len(v)) - np.repeat(first, np.diff(np.append(first, len(v)))) < most
            node = np.cumsum(new)[keep] - 1
            g = vamana.build(v[first])
            row = (t.column("dim")[0].as_py(), t.column("shard")[0].as_py(), g.start, len(first), v[first].tobytes(), g.edges.tobytes(), ids[keep].tobytes(), np.searchsorted(node, np.arange(len(first) + 1)).tobytes())
            yield pa.RecordBatch.from_pylist([dict(zip([f.split()[0] for f in schema.split(", ")], row))], pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("vectors", "edges", "ids", "id_at"))]))

    dealt = rows.withColumn("g", F.xxhash64("dim", "shard")).select("g", "dim", "shard", "vec_id", "v")
    return stored(dealt.repartition("g").sortWithinPartitions("g", "vec_id").mapInArrow(run, schema), "ann-index")


def _scan(v: np.ndarray, unit: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """For each row of ``unit``, the nodes whose product may be among the ``most`` largest.

    Products summed in another order differ by rounding only, so nodes within that
    distance of the last place are in as well.
    """
    scale = np.abs(v).max()
    size = np.sqrt(v.shape[1])
    for s in range(0, len(unit), SCAN_QUERIES):
        ask = unit[s : s + SCAN_QUERIES]
        products = np.empty((len(ask), len(v)))
        for at in range(0, len(v), SCAN_NODES):
            products[:, at : at + SCAN_NODES] = ask @ (v[at : at + SCAN_NODES] / scale).T
        for row, q in zip(products, ask):
            last = np.partition(row, -most)[-most] if most < len(row) else -np.inf
            slack = 4 * np.finfo(float).eps * v.shape[1] * size * np.sqrt(q @ q)
            yield np.flatnonzero(row >= last - slack)


def _walk(g: vamana.Graph, asked: np.ndarray, beam: int) -> Iterator[np.ndarray]:
    """For each row of ``asked``, the nodes that a beam search ends with."""
    for s in range(0, len(asked), vamana.BATCH):
        for nodes in vamana.search(g.points, g.edges, g.start, asked[s : s + vamana.BATCH], beam)[0]:
            yield nodes[nodes >= 0]


def _beam(g: vamana.Graph, v: np.ndarray, unit: np.ndarray, asked: np.ndarray, k: int, beam: int, widest: int, recall: float) -> int | None:
    """The narrowest beam, by doubling, with which sampled queries find ``recall`` of their
    ``k`` best nodes; None if ``widest`` does not reach it.
    """
    probe = np.unique(np.linspace(0, len(unit) - 1, min(PROBES, len(unit))).astype(int))
    true = list(_scan(v, unit[probe], min(k, len(v))))
    wanted = sum(min(k, len(t)) for t in true)
    while True:
        found = _walk(g, asked[probe], beam)
        hits = sum(min(k, len(np.intersect1d(t, nodes))) for t, nodes in zip(true, found))
        if hits >= recall * wanted:
            return beam
        if beam >= widest:
            return None
        beam = min(2 * beam, widest)


def _best(q_ids: np.ndarray, q: np.ndarray, row: dict, k: int, beam: int, widest: int, recall: float) -> Iterator[tuple[np.ndarray, ...]]:
    """For each query, position, ids and scores of its ``k`` best in a shard."""
    v = np.frombuffer(row["vectors"]).reshape(row["n"], -1)
    ids, id_at = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["id_at"], np.int64)
    g = vamana.Graph(vamana.lift(v), np.frombuffer(row["edges"], np.int32).reshape(row["n"], -1), row["start"])
    unit = q / np.abs(q).max(axis=1, keepdims=True)
    size = np.sqrt(np.einsum("ij,ij->i", unit, unit))
    asked = np.concatenate([unit / size[:, None], np.zeros((len(q), 1))], axis=1).astype(np.float32)
    beam = max(beam, 2 * k)
    enough = _beam(g, v, unit, asked, k, beam, max(beam, widest), recall)
    # One node more than asked for, as the query's own may be among them.
    found = _walk(g, asked, enough) if enough else _scan(v, unit, min(k + 1, len(v)))
    for i, nodes in enumerate(found):
        score = np.cumsum(v[nodes] * q[i], axis=1)[:, -1]  # summed in order, like a plain loop
        count = id_at[nodes + 1] - id_at[nodes]
        near = np.concatenate([ids[a:b] for a, b in zip(id_at[nodes], id_at[nodes + 1])])
        score = np.repeat(score, count)
        other = near != q_ids[i]
        near, score = near[other], score[other]
        order = np.lexsort((near, -score))[:k]
        yield np.full(len(order), i), near[order], score[order]


def nearest(rows: DataFrame, queries: DataFrame, k: int, beam: int = BEAM, shard_rows: int = SHARD_ROWS, widest: int = WIDEST, recall: float = RECALL) -> DataFrame:
    """The ``k`` nearest of ``rows(vec_id, v)`` for every row of ``queries(vec_id, v)``.

    ``v`` is an array of doubles. Returns ``query_id, rank, vec_id, score``, by score,
    ties to the smaller id. A row with the query's own id is no candidate; a vector
    of another length is none either. Rows that repeat in id and vector count once.
    Without rows or queries the result is empty. A block of queries searches a shard with
    a beam of ``beam`` to ``widest`` nodes, as measured ``recall`` requires, and reads all
    its nodes if ``widest`` finds too little (``recall`` above 1: always).
    """
    largest = F.array_max(F.transform("v", F.abs))
    sized = rows.withColumn("size", F.floor(F.log2(largest) / CLASS_BITS).cast("int"))
    # A row per size class: some 520 at most, the range of doubles.
    counts = sorted((r["size"], r["count"]) for r in sized.groupBy("size").count().collect())
    total, n_shards, deals = sum(c for _, c in counts), 0, []
    for size, c in counts:
        n = max(-(-LEAST_SHARDS * c // total), -(-c // shard_rows))
        deals.append((size, n_shards, n))
        n_shards += n
    deal = F.broadcast(rows.sparkSession.createDataFrame(deals, "size int, first long, parts long"))
    once = sized.dropDuplicates(["vec_id", "v"]).join(deal, "size").select("vec_id", "v", F.size("v").alias("dim"), (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).alias("shard"))
    shards = index(once, k + 1)
    asked = queries.dropDuplicates(["vec_id", "v"])
    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.select("vec_id", "v", F.size("v").alias("dim"), F.xxhash64("v").alias("qx"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_blocks)).alias("block"))
    parts = ["vectors", "edges", "ids", "id_at"]
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n, 1) - 1).cast("long")))
    left = asked.withColumn("shard", every(n_shards)).select(F.xxhash64("dim", "shard", "block").alias("g"), F.lit(1).alias("kind"), "vec_id", "qx", "v", F.lit(0).alias("start"), F.lit(0).alias("n"), *[F.lit(None).cast("binary").alias(p) for p in parts])
    right = shards.withColumn("block", every(n_blocks)).select(F.xxhash64("dim", "shard", "block").alias("g"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("long").alias("qx"), F.lit(None).cast("array<double>").alias("v"), "start", "n", *parts)
    together = left.unionByName(right).repartition("g").sortWithinPartitions("g", "kind", "vec_id")
    schema = "query_id long, qx long, vec_id long, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "g"):
            kind = t.column("kind").to_numpy()
            if kind[0] != 0 or kind[-1] != 1:
                continue  # no shard of this dimension, or no query
            row = t.slice(0, 1).select(["start", "n", *parts]).to_pylist()[0]
            asks = t.slice(1)
            q_ids, q = asks.column("vec_id").to_numpy(), _matrix(asks.column("v"))
            at, near, score = (np.concatenate(c) for c in zip(*_best(q_ids, q, row, k, beam, widest, recall)))
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(asks.column("qx").to_numpy()[at]), pa.array(near), pa.array(score)], names=["query_id", "qx", "vec_id", "score"])

    found = together.mapInArrow(run, schema)
    rank = F.row_number().over(W.partitionBy("query_id", "qx").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_table(table: DataFrame, k: int = 20, every: int = 20, **options) -> DataFrame:
    """Rows whose ``vec_id`` is divisible by ``every``, against all rows of the table.

    Vectors that are NULL, zero or hold a NULL or non-finite component take no part,
    nor do rows without an id. Other columns are not read.
    """
    rows = table.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = stored(rows, "ann-rows")
    return nearest(rows, rows.where(F.col("vec_id") % every == 0), k, **options)
