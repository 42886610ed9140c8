"""Packing token lists into windows by non-negative least squares.

A document's whole windows stand alone; what remains of it, shorter than a window,
is counted by length. Shallow combinations of two or three lengths that fill a
window exactly are the columns of a least-squares problem whose right side is the
histogram of lengths; its non-negative solution says how often to use each
combination. The solution is rounded down to what the histogram holds and topped up
greedily; left-over pieces follow each other and are cut where a window is full.

The histogram has one number per length, so the plan is small and made on the
driver. Pieces find their place by arithmetic: a piece is the r-th of its length,
and the plan says where the r-th piece of a length goes. Ranks come from counts per
task, so no rows are sorted or grouped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.tables import stored
from tidemark.llm.text import slices
from tidemark.llm.token_counts import transducer

#: Lengths that may be the second of three; the commonest ones.
SECONDS = 48
ROUNDS = 300


def combinations(hist: np.ndarray, window: int, seconds: int = SECONDS) -> np.ndarray:
    """Pairs and triples of present lengths that add up to ``window``; 0 fills the third place of a pair."""
    present = np.flatnonzero(hist)
    common = present[np.argsort(-(hist * np.arange(len(hist)))[present], kind="stable")][:seconds]
    a, b = np.meshgrid(present, np.append(common, 0), indexing="ij")
    c = window - a - b
    good = (c > 0) & (c < window)
    good[good] &= hist[c[good]] > 0
    found = np.sort(np.stack([a[good], b[good], c[good]], axis=1), axis=1)
    return np.unique(found, axis=0)


def solve(columns: np.ndarray, hist: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative repeats x of the combinations with least squares of ``A x - hist``.

    Accelerated projected gradient; the columns have three entries, so both products
    with A are gathers.
    """
    x = y = np.zeros(len(columns))
    real = hist.astype(float)
    real[0] = 0
    # Bound of the largest eigenvalue of A'A: largest column sum times largest row sum.
    rows = np.bincount(columns.ravel(), minlength=len(hist)).astype(float)
    rows[0] = 0
    step = 1.0 / (3 * max(1.0, rows.max()))
    t = 1.0
    for _ in range(rounds):
        fit = np.bincount(columns.ravel(), weights=np.repeat(y, 3), minlength=len(hist)) - real
        fit[0] = 0
        new = np.maximum(0, y - step * fit[columns].sum(axis=1))
        t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        x, y = new, new + (was - 1) / t * (new - x)
        y = np.maximum(y, 0)
    return x


@dataclass(frozen=True)
class Plan:
    """Slots of every length: ``slot_of[l]:slot_of[l + 1]`` index the other arrays.

    A slot serves ``count`` pieces from rank ``first``: the piece of rank r goes to
    sequence ``sequence + r - first`` at ``offset``. From rank ``planned[l]`` on,
    pieces lie in a row from position ``row_at[l]`` of the left-over row, whose
    windows are numbered from ``row_sequence``; ``sequences`` are planned in all.
    """

    window: int
    slot_of: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    planned: np.ndarray
    row_at: np.ndarray
    row_sequence: int
    sequences: int


def plan(hist: np.ndarray, window: int) -> Plan:
    """Plan for ``hist[l]`` pieces of length l, 0 < l < window."""
    hist = hist.astype(np.int64)
    columns = combinations(hist, window)
    want = solve(columns, hist) if len(columns) else np.zeros(0)
    left = hist.copy()
    left[0] = 1 << 60
    uses = np.zeros(len(columns), np.int64)
    for top_up in (False, True):
        for k in np.argsort(-want, kind="stable"):
            lengths, each = np.unique(columns[k][columns[k] > 0], return_counts=True)
            most = int((left[lengths] // each).min())
            n = most if top_up else min(most, int(want[k]))
            if n > 0:
                uses[k] += n
                left[lengths] -= n * each
    used = np.flatnonzero(uses)
    base = np.concatenate([[0], np.cumsum(uses[used])])
    slots: list[tuple[int, int, int, int]] = []
    for i, k in enumerate(used):
        at = 0
        for length in columns[k]:
            if length:
                slots.append((int(length), int(base[i]), at, int(uses[k])))
                at += int(length)
    slots.sort()
    s = np.array(slots, np.int64).reshape(-1, 4)
    slot_of = np.searchsorted(s[:, 0], np.arange(window + 1))
    ends = np.cumsum(s[:, 3])
    before = np.concatenate([[0], ends])[slot_of[s[:, 0]]] if len(s) else ends
    left[0] = 0
    mass = left * np.arange(len(left))
    row_at = np.concatenate([[0], np.cumsum(mass)[:-1]])
    row_windows = -(-int(mass.sum()) // window)
    return Plan(window, slot_of, ends - s[:, 3] - before, s[:, 1], s[:, 2], hist - left, row_at, int(base[-1]), int(base[-1]) + row_windows)


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, window: int) -> DataFrame:
    """Every row's ids with its place among the rows of its task, written once.

    ``part`` is the task, ``rank`` the row's rank among those of the task with as
    many tokens beyond whole windows (``tail``), ``full_rank`` the whole windows of
    the task before it.
    """
    schema = "doc_id long, ids binary, doc_tokens long, tail int, part int, rank long, full_rank long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, part = transducer(tokenizer), TaskContext.get().partitionId()
        seen, full = [0] * window, 0
        for piece in slices(batches, holding=f"transducer {tokenizer}"):
            ids, off = machine.encode([t or "" for t in piece.column(1).to_pylist()])
            n = len(off) - 1
            ids = np.insert(ids, off[1:], end_id).astype("<u4" if machine.length.size > 0xFFFF else "<u2")
            off = off + np.arange(n + 1)
            raw, size = ids.tobytes(), ids.itemsize
            tokens = np.diff(off)
            tails, ranks, fulls = tokens % window, [], []
            for tail, count in zip(tails.tolist(), tokens.tolist()):
                ranks.append(seen[tail])
                seen[tail] += 1
                fulls.append(full)
                full += count // window
            blobs = [raw[a:b] for a, b in zip((off[:-1] * size).tolist(), (off[1:] * size).tolist())]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(blobs, pa.binary()), pa.array(tokens), pa.array(tails.astype(np.int32)), pa.array(np.full(n, part, np.int32)),
                 pa.array(ranks, pa.int64()), pa.array(fulls, pa.int64())], names=[f.split()[0] for f in schema.split(", ")])

    return stored(docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema), "pack-tokens")


#: Rows of counts per (task, tail) that are sent to every executor; beyond it the join shuffles.
BROADCAST_ROWS = 1 << 20


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of all rows of ``docs``, packed into sequences of at most ``window`` tokens.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``
    (and ``ids``). A NULL or empty text is the end token alone. Repeated rows are
    packed each for itself; NULL ids are passed through; other columns are not read;
    an empty table gives no rows. Only the last window of the left-over row can be
    short, so all padding together is less than one window.
    """
    rows = tokenized(docs, tokenizer, end_id, window)
    counts = stored(rows.groupBy("part", "tail").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("doc_tokens") / window)).cast("long").alias("full")), "pack-counts")
    hist = np.zeros(window, np.int64)
    for tail, n in counts.where("tail > 0").groupBy("tail").agg(F.sum("n")).collect():  # one row per length
        hist[tail] = n
    made = plan(hist, window)
    parts = counts.groupBy("part").agg(F.sum("full").alias("full"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("full").over(earlier), F.lit(0)).alias("full_base"))  # one row per task
    same = W.partitionBy("tail").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("part", "tail", F.coalesce(F.sum("n").over(same), F.lit(0)).alias("rank_base")).join(parts, "part")
    if counts.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    ranked = rows.join(bases, ["part", "tail"]).select("doc_id", "ids", "doc_tokens", "tail", (F.col("rank") + F.col("rank_base")).alias("rank"), (F.col("full_rank") + F.col("full_base")).alias("full_rank"))
    shared = docs.sparkSession.sparkContext.broadcast(made)  # bounded by lengths times SECONDS slots
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = ", ".join(f"{n} long" for n in names[:7]) + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Plan = shared.value
        for batch in batches:
            out: list[tuple] = []
            for doc_id, blob, tokens, tail, rank, full in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(blob, f"<u{len(blob) // tokens}").astype("<u4")

                def piece(start: int, length: int, sequence: int, offset: int) -> None:
                    own = ids[start : start + length]
                    row = (doc_id, start, length, zlib.crc32(own.tobytes()), tokens, sequence, offset)
                    out.append(row + (own.astype(np.int32),) if with_ids else row)

                for k in range(tokens // window):
                    piece(k * window, window, p.sequences + full + k, 0)
                if not tail:
                    continue
                start = tokens - tail
                over = rank - int(p.planned[tail])
                if over < 0:
                    low, high = p.slot_of[tail], p.slot_of[tail + 1]
                    s = low + int(np.searchsorted(p.first[low:high], rank, "right")) - 1
                    piece(start, tail, int(p.sequence[s]) + rank - int(p.first[s]), int(p.offset[s]))
                    continue
                at = int(p.row_at[tail]) + over * tail
                while start < tokens:
                    length = min(tokens - start, window - at % window)
                    piece(start, length, p.row_sequence + at // window, at % window)
                    start, at = start + length, at + length
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) if k < 7 else pa.array(c, pa.list_(pa.int32())) for k, c in enumerate(zip(*out) if out else [[]] * len(names))], names=names)

    return ranked.mapInArrow(run, schema)
