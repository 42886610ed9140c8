"""Groups of sorted rows across Arrow batches, and connected components of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import discard, stored


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows of each key, for batches in which equal keys stand together."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        edges = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]).tolist()
        for a, b in zip(edges[:-1], edges[1:]):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)``; the root is the smallest node.

    Each round every node takes the smallest root among its neighbours' and then its
    root's root, so chains shorten by powers. Rounds are written tables; a node with
    very many links is summed up before it is shuffled.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = stored(both, "links")
    now = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "roots")
    while True:
        seen = both.join(now.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hooked = now.join(seen, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = now.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = stored(hooked.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("next", "root")).alias("root")), "roots")
        ended = new.where("root <> was").isEmpty()
        discard(now)
        now = new.select("node", "root")
        if ended:
            discard(both)
            return now
