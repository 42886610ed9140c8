"""The trie of conversation prefixes, built from ternary search trees of range shards.

A conversation is a path: one 16-byte key (SHA-256 of role and text) per turn. Paths
are range-partitioned and sorted with their ids as ties, so that copies of one
conversation spread over as many shards as they fill. Every task cuts its range into
segments of bounded size. A segment encodes its keys as small integers and inserts its
distinct paths, the median first, into a ternary search tree; one iterative traversal
lists the nodes in order, and a pass backwards adds members, leaves and savings up to
the parents.

All nodes of a segment are complete but those on its first and last path, which
neighbours may share. Their sums are merged by key, after the pairs of neighbouring
segments have told how far their paths agree: what both counted is taken off once,
on all nodes above. So merging is one aggregation, however deep the trie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.tables import stored, words_in

KEY = 16
SEGMENT_TURNS = 100_000
SUMS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: Rows of one table: complete nodes; parts of nodes that segments share; first and last paths of a partition.
PIECE = f"kind string, partition int, segment int, node binary, parent binary, first_end long, ends string, path binary, words array<int>, {NODE}"
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_key(role: Column, text: Column) -> Column:
    """Digest of a turn; the length of the role keeps role and text apart."""
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY))


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id, seq``: the turns of each conversation in order, as ``(key, words)``."""
    role, text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")]
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                                     turn_key(role, text).alias("key"), words_in(text).cast("int").alias("words"))
    seq = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn").isNotNull(), F.lit(False)).alias("known"), "turn", "key", "words")))
    own = rows.groupBy("conv_id").agg(seq.alias("seq"))
    return own.select("conv_id", F.transform("seq", lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words"))).alias("seq"))


def rebuilt(turns: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """``conv_id, path, words``: conversations with the head of their base put before them.

    The base of conversation ``c`` is ``c - c % every``, the head has crc32(c) % heads turns.
    """
    own = stored(sequences(turns), "turn-sequences")
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    base = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("seq", 1, heads - 1).alias("base_seq"))
    both = own.withColumns({"head": head, "base": F.col("conv_id") - F.col("conv_id") % every}).join(base, "base", "left")
    none = F.array().cast(own.schema["seq"].dataType)
    before = F.when(F.col("head") > 0, F.slice(F.coalesce("base_seq", none), 1, F.greatest("head", F.lit(1)))).otherwise(none)
    after = F.slice("seq", F.col("head") + 1, F.greatest(F.size("seq") - F.col("head"), F.lit(0)))
    seq = F.concat(before, after)
    path = F.unhex(F.array_join(F.transform(seq, lambda t: F.hex(t["key"])), ""))
    return both.select("conv_id", path.alias("path"), F.transform(seq, lambda t: t["words"]).alias("words"))


class TernaryTree:
    """Distinct sequences of integers; ``low`` and ``high`` are siblings, ``child`` leads one turn on."""

    def __init__(self):
        self.turn, self.low, self.high, self.child, self.parent, self.depth = [-1], [0], [0], [0], [-1], [0]

    def insert(self, seq: list[int]) -> list[int]:
        """Nodes of all prefixes of ``seq``, from the root on; new ones are added."""
        turn, low, high, child = self.turn, self.low, self.high, self.child
        at, way = 0, [0]
        for depth, x in enumerate(seq, 1):
            link, of = child, at
            here = child[at]
            while here and turn[here] != x:
                link, of = (low if x < turn[here] else high), here
                here = link[here]
            if not here:
                here = len(turn)
                link[of] = here
                turn.append(x)
                for links in (low, high, child):
                    links.append(0)
                self.parent.append(at)
                self.depth.append(depth)
            way.append(here)
            at = here
        return way

    def preorder(self) -> list[int]:
        """All nodes, a node before those below it, siblings by their integers."""
        out, waiting = [], [(0, True)]
        while waiting:
            node, open_ = waiting.pop()
            if open_ and node:  # siblings below it come first, those above after its subtree
                if self.high[node]:
                    waiting.append((self.high[node], True))
                waiting.append((node, False))
                if self.low[node]:
                    waiting.append((self.low[node], True))
                continue
            out.append(node)
            if self.child[node]:
                waiting.append((self.child[node], True))
        return out


def medians(n: int) -> Iterator[int]:
    """The positions of ``n`` sorted items, the middle of every range before its halves."""
    waiting = [(0, n)]
    while waiting:
        a, b = waiting.pop()
        if a < b:
            mid = (a + b) // 2
            yield mid
            waiting += [(mid + 1, b), (a, mid)]


def prefix_keys(path: bytes) -> list[bytes]:
    """Digest of each prefix of a path, from the root's on."""
    h = hashlib.sha256()
    out = [h.copy().digest()[:KEY]]
    for k in range(0, len(path), KEY):
        h.update(path[k : k + KEY])
        out.append(h.copy().digest()[:KEY])
    return out


def shared_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // KEY
    same = (np.frombuffer(a, np.uint8, n * KEY) == np.frombuffer(b, np.uint8, n * KEY)).reshape(n, KEY).all(axis=1)
    return n if same.all() else int(np.argmin(same))


def row(kind: str, partition: int, segment: int = 0, **values) -> dict:
    return {"kind": kind, "partition": partition, "segment": segment, **values}


def corrections(last: bytes, first: bytes, words: list[int], partition: int) -> Iterator[dict]:
    """What two neighbouring segments both counted, to be taken off every node that they share.

    Words of a shared node were charged twice, a shared child was counted twice, and if
    the one path ends where the other goes on, its end was taken for a leaf.
    """
    m = shared_turns(last, first)
    leaf = -1 if len(last) == m * KEY else 0
    keys = prefix_keys(first[: m * KEY])
    back = 0
    for depth in range(m, -1, -1):
        back += words[depth - 1] if depth else 0
        yield row("part", partition, node=keys[depth], n_convs=0, n_children=-1 if depth < m else 0, n_leaves=leaf, saved_tokens=int(back))


def segment_rows(paths: list[bytes], ids: np.ndarray, words: list[list[int]], partition: int, segment: int) -> Iterator[dict]:
    """Complete nodes and shared parts of one sorted segment."""
    n = len(paths)
    begin = [i for i in range(n) if not i or paths[i] != paths[i - 1]] + [n]
    alone = np.array([paths[i] for i in begin[:-1]], object)
    flat = np.frombuffer(b"".join(alone), f"V{KEY}") if any(len(p) for p in alone) else np.zeros(0, f"V{KEY}")
    codes = np.unique(flat.view(">u8").reshape(-1, 2), axis=0, return_inverse=True)[1].ravel().tolist()
    at = np.concatenate([[0], np.cumsum([len(p) // KEY for p in alone])]).tolist()
    tree = TernaryTree()
    members, cost, ends, least = [0], [0], {}, [None]
    ways = {}
    for k in medians(len(alone)):
        way = tree.insert(codes[at[k] : at[k + 1]])
        for depth in range(1, len(way)):
            if way[depth] >= len(cost):
                cost.append(words[begin[k]][depth - 1])
                members.append(0)
                least.append(None)
        end = way[-1]
        own = ids[begin[k] : begin[k + 1]]
        members[end], least[end], ends[end] = len(own), int(own[0]), own
        if k in (0, len(alone) - 1):
            ways[k] = way
    order = tree.preorder()
    size = len(order)
    leaves, children, saved = [0] * size, [0] * size, [0] * size
    for node in reversed(order):
        leaves[node] = leaves[node] or 1
        saved[node] += (members[node] - 1) * cost[node]
        up = tree.parent[node]
        if up >= 0:
            children[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]
            members[up] += members[node]
            if least[up] is None or least[node] < least[up]:
                least[up] = least[node]
    shared = {}
    for k, way in ways.items():
        shared.update(zip(way, prefix_keys(alone[k])))
    for node in order:
        own = ends.get(node, ())
        text = ",".join(map(str, own.tolist())) if len(own) else ""
        values = {"conv_id": least[node], "depth": tree.depth[node], "n_convs": members[node], "n_children": children[node],
                  "n_leaves": leaves[node], "saved_tokens": saved[node]}
        up = tree.parent[node]
        if node in shared:
            yield row("part", partition, segment, node=shared[node], parent=shared.get(up), ends=text or None,
                      first_end=int(own[0]) if len(own) else None, **values)
        else:
            values["ends_sha256"] = hashlib.sha256(text.encode()).hexdigest() if text else NOTHING
            if up in shared:  # its parent's smallest member is known after merging
                yield row("below", partition, segment, parent=shared[up], **values)
            else:
                yield row("node", partition, segment, parent_conv_id=least[up], **values)


def range_rows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[dict]:
    """All rows of one sorted partition: its segments, their corrections, its first and last path."""
    partition, segment, turns = 0, 0, 0
    paths, ids, words = [], [], []
    last = None

    def close() -> Iterator[dict]:
        if last is not None:
            yield from corrections(last, paths[0], words[0], partition)
        else:
            yield row("first", partition, path=paths[0], words=words[0])
        yield from segment_rows(paths, np.array(ids, np.int64), words, partition, segment)

    for batch in batches:
        for conv, path, w, p in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            if paths and turns + len(w) + 1 > most:
                yield from close()
                last, segment, turns = paths[-1], segment + 1, 0
                paths, ids, words = [], [], []
            partition = p
            turns += len(w) + 1
            paths.append(path)
            ids.append(conv)
            words.append(w)
    if paths:
        yield from close()
        yield row("last", partition, path=paths[-1])


def batched(rows: Iterator[dict], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def arrow_of(ddl: str, spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def edge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for r in batch.to_pylist():
            yield from corrections(r["before"], r["path"], r["words"], -1)


def ends_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each node's ends, whose texts follow each other in order of their ids."""
    node, h = None, None
    for batch in batches:
        done = []
        for n, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if n != node:
                if h is not None:
                    done.append((node, h.hexdigest()))
                node, h = n, hashlib.sha256(text.encode())
            else:
                h.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in done], pa.binary()), pa.array([b for _, b in done], pa.string())], names=["node", "hash"])
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([h.hexdigest()])], names=["node", "hash"])


def trie_nodes(convs: DataFrame, segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """The nodes of the trie over ``convs(conv_id, path, words)``, as ``NODE`` describes them."""
    spark = convs.sparkSession
    by = [F.col("path"), F.col("conv_id")]
    ranged = convs.select("conv_id", "path", "words").repartitionByRange(*by).sortWithinPartitions(*by).withColumn("p", F.spark_partition_id())
    pieces_of, part_of = arrow_of(PIECE, spark), arrow_of(PIECE, spark)
    pieces = stored(ranged.mapInArrow(lambda b: batched(range_rows(b, segment_turns), pieces_of), PIECE), "trie-pieces")
    # Two paths per partition of the shuffle; their number is set by the session, not by the data.
    edges = pieces.where("kind in ('first', 'last')").groupBy("partition").agg(
        F.max(F.when(F.col("kind") == "last", F.col("path"))).alias("last"), F.max(F.when(F.col("kind") == "first", F.struct("path", "words"))).alias("first"))
    pairs = edges.select(F.lag("last").over(W.partitionBy(F.lit(0)).orderBy("partition")).alias("before"), F.col("first.path").alias("path"), F.col("first.words").alias("words"))
    between = pairs.where("before is not null").mapInArrow(lambda b: batched(edge_rows(b), part_of), PIECE)
    parts = pieces.where("kind = 'part'")
    sums = parts.unionByName(between).groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), *[F.sum(c).alias(c) for c in SUMS])
    chunks = parts.where("ends is not null").select("node", "ends", "first_end")
    hashes = chunks.repartition("node").sortWithinPartitions("node", "first_end").select("node", "ends").mapInArrow(ends_hashes, "node binary, hash string")
    merged = stored(sums.join(hashes, "node", "left").withColumn("ends_sha256", F.coalesce("hash", F.lit(NOTHING))).drop("hash"), "trie-merged")
    columns = [c.split()[0] for c in NODE.split(", ")]
    up = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("up"))
    shared = merged.join(up, "parent", "left").withColumn("parent_conv_id", F.col("up")).select(columns)
    # A parent is told to each of its segments first, so that no parent holds one task's rows.
    told = parts.select("partition", "segment", F.col("node").alias("parent")).join(up, "parent")
    below = pieces.where("kind = 'below'").drop("parent_conv_id").join(told, ["partition", "segment", "parent"]).withColumn("parent_conv_id", F.col("up")).select(columns)
    return pieces.where("kind = 'node'").select(columns).unionByName(below).unionByName(shared)


def prefix_trie(turns: DataFrame, rebuild: Callable[[DataFrame], DataFrame] = rebuilt, segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations of ``turns``.

    ``turns`` needs ``conv_id, turn, role, text``; other columns are not read. A node is
    a prefix of ``depth`` turns, the root the empty one. ``conv_id`` is its smallest
    member, ``parent_conv_id`` that of its parent (NULL for the root), ``n_convs`` its
    members, ``n_children`` and ``n_leaves`` its children and the childless nodes below
    it (itself, if childless), ``saved_tokens`` the words that members after the first
    share, over its subtree, ``ends_sha256`` the digest of the members that end there.

    NULL roles and texts are empty; a NULL turn comes first; turns of one number, and
    repeated rows, are turns of their own in the order of their digests. Rows of NULL
    ``conv_id`` belong to no conversation. Texts count whole. No turns, no rows. A
    conversation is held in one task, 40 bytes a turn; the digest of a node's ends is
    read in sequence, as SHA-256 asks, in texts of at most one segment.
    """
    return trie_nodes(rebuild(turns), segment_turns)
