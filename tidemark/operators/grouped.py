"""Trees of cells of any size: rows of the same bins are one, and meet the trees as sums.

No task gathers the rows of a cell. Bin edges are exact order statistics, found in two
map-only passes: samples of sorted blocks tell between which values a wanted rank lies,
then only the values there are counted. A third pass turns a row into a byte a feature;
rows of the same bytes (and fold) are added up by Spark, in whole numbers, so that a rerun
gives the same bits. A unit of a model grows from these groups, scores the groups of the
test rows, and drops its trees. Where rows are asked for, they are binned again and look
up what was said of their bins.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.operators import blocks as B
from tidemark.operators import small_models as S
from tidemark.operators import trees as T

#: Values of a sorted block that are handed on; a block of fewer different ones is told in full.
SAMPLES = 1 << 12
#: A missing value; bins are below.
MISSING = 255
#: Bits of the two whole numbers that hold a label, so that 2^26 of them can be added.
BITS = 37
#: Rows that look up their score together.
LOOKUP_ROWS = 1 << 19
TRAIN, TEST, ROWS, SQUARES = range(4)
SQUARES_FOLD = 100

PACKED = "groups long, role int, keys binary, fold binary, rows binary, high binary, low binary, y binary"
PARTS = "unit int, units int, train boolean, chunk int, scores binary, keys binary, rows binary, total binary, weight double, leaf_rows double, n_train long, y_min double, y_max double, best_rounds int, error string"


def seed_of(key: Sequence, seed: int) -> int:
    """Seed of a cell, from its keys alone: the same whatever else is fitted."""
    return zlib.crc32(",".join([str(seed), *map(str, key)]).encode()) & 0x7FFFFFFF


def ordered(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of numbers; the same function leads back."""
    b = x if x.dtype == np.int64 else (x + 0.0).view(np.int64)
    return b ^ ((b >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def fold_keys(row_hash: np.ndarray, seed: int) -> np.ndarray:
    """In the order by which rows are dealt to folds."""
    return ((row_hash.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(seed)) ^ np.uint64(1 << 63)).view(np.int64)


def fold_ends(n: int, folds: int) -> np.ndarray:
    return np.cumsum([len(part) for part in np.array_split(np.empty(n, np.bool_), min(folds, n))])


@dataclass
class Cell:
    """What is known of the training rows of a key of rows."""

    key: tuple
    n: int
    y_min: float
    y_max: float
    edges: list[np.ndarray]
    lacks: np.ndarray
    fold_cuts: np.ndarray
    fold_seed: int

    @property
    def exponent(self) -> int:
        top = max(abs(self.y_min), abs(self.y_max))
        return int(np.frexp(top)[1]) + 1 if top else 0


def _sampled(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Some of the values, how many each stands for, and by how many a count may be short."""
    s = np.sort(keys)
    last = np.flatnonzero(np.concatenate([s[1:] != s[:-1], [True]]))
    step = 1
    if len(last) > SAMPLES:
        step = len(s) // SAMPLES + 1
        last = np.unique(np.concatenate([np.arange(step - 1, len(s), step), [len(s) - 1]]))
    return s[last], np.diff(np.concatenate([[-1], last])), step - 1


def _columns(x: np.ndarray, own: dict[str, np.ndarray], fold_seed: int | None) -> Iterator[tuple[int, np.ndarray]]:
    for j, column in enumerate(x.T):
        known = column[~np.isnan(column)]
        if len(known):
            yield j, ordered(np.ascontiguousarray(known))
    if fold_seed is not None:
        yield x.shape[1], fold_keys(own["_hash"], fold_seed)


FOUND = "cell int, col int, known long, exact boolean, values binary, weights binary"
PIECE = "cell int, col int, short long, values binary, weights binary, below binary"


def _pieces(found: Iterator[tuple], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    for cell, col, short, values, weights, below in found:
        row = [cell, col, short, values.tobytes(), weights.astype(np.int64).tobytes(), below.tobytes()]
        yield pa.record_batch([pa.array([v], f.type) for v, f in zip(row, arrow)], schema=arrow)


def cells_of(train: DataFrame, by: Sequence[str], most: int, folds: int, seed: int) -> list[Cell]:
    """Bin edges and ends of folds of every key of rows: at most ``most`` bins a feature, those of ``trees.Binned``."""
    by = list(by)
    facts = sorted(train.groupBy(*by).agg(F.count(F.lit(1)), F.min("label"), F.max("label"), F.max(F.size("features"))).collect(), key=lambda r: tuple(r)[: len(by)])  # cells of the caller's design
    keys, counts = [tuple(r)[: len(by)] for r in facts], [tuple(r)[len(by) :] for r in facts]
    seeds = [seed_of(k, seed) if folds else None for k in keys]
    rows = B.numbered(train, by, keys)
    piece, arrow = [to_arrow_schema(StructType.fromDDL(ddl)) for ddl in (PIECE, FOUND)]

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def all_of():
            for cell, x, own in B.by_cell(batches, ["_hash"]):
                for j, values in _columns(x, own, seeds[cell]):
                    v, w, short = _sampled(values)
                    yield cell, j, short, v, w, np.zeros(0, np.int64)
        yield from _pieces(all_of(), piece)

    def wanted(cell: int, col: int, known: int) -> np.ndarray:
        if col < counts[cell][3]:
            return np.arange(most) * known // most
        return fold_ends(known, folds)[:-1] - 1

    def told(cell: int, col: int, known: int, exact: bool, values: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
        row = [cell, col, known, exact, values.tobytes(), weights.tobytes()]
        return pa.record_batch([pa.array([v], f.type) for v, f in zip(row, arrow)], schema=arrow)

    def joined(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
        values, weights, short, below = [], [], 0, 0
        for r in (r for b in batches for r in b.to_pylist()):
            values.append(np.frombuffer(r["values"], np.int64))
            weights.append(np.frombuffer(r["weights"], np.int64))
            short, below = short + r["short"], below + np.frombuffer(r["below"], np.int64)
        values, weights = np.concatenate(values), np.concatenate(weights)
        order = np.argsort(values, kind="stable")
        values, total = values[order], np.cumsum(weights[order])
        last = np.flatnonzero(np.concatenate([values[1:] != values[:-1], [True]])) if len(values) else np.zeros(0, np.int64)
        return values[last], total[last], short, below

    def locate(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, col = (k.as_py() for k in key)
        v, total, short, _ = joined(batches)
        known = int(total[-1])
        ranks = wanted(cell, col, known)
        if not short:
            if col < counts[cell][3] and len(v) <= most:
                yield told(cell, col, known, True, v, np.zeros(0, np.int64))
            else:
                yield told(cell, col, known, True, v[np.searchsorted(total, ranks, "right")], np.zeros(0, np.int64))
            return
        high = v[np.searchsorted(total, ranks + 1, "left")]
        at = np.searchsorted(total + short, ranks + 1, "left") - 1
        low = np.where(at >= 0, v[np.maximum(at, 0)], np.iinfo(np.int64).min)
        yield told(cell, col, known, False, low, high)

    found = {(r["cell"], r["col"]): r for r in rows.mapInArrow(sample, PIECE).groupBy("cell", "col").applyInArrow(locate, FOUND).collect()}
    values = {at: np.frombuffer(r["values"], np.int64) for at, r in found.items()}
    spans: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for at, r in found.items():
        if not r["exact"]:
            low, high = values[at], np.maximum.accumulate(np.frombuffer(r["weights"], np.int64))
            first = np.concatenate([[True], low[1:] >= high[:-1]])  # spans that overlap are one
            spans[at] = low[first], high[np.concatenate([np.flatnonzero(first)[1:] - 1, [len(high) - 1]])]
    if spans:
        known = {at: found[at]["known"] for at in spans}
        sought = sorted({cell for cell, _ in spans})
        near = B.numbered(train, by, [keys[c] for c in sought])

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def all_of():
                for own_cell, x, own in B.by_cell(batches, ["_hash"]):
                    cell = sought[own_cell]
                    for j, v in _columns(x, own, seeds[cell]):
                        if (cell, j) in spans:
                            low, high = spans[cell, j]
                            v = np.sort(v)
                            a, b = np.searchsorted(v, low, "right"), np.searchsorted(v, high, "right")
                            inside = np.concatenate([v[i:k] for i, k in zip(a, b)])
                            yield cell, j, 0, *np.unique(inside, return_counts=True), a.astype(np.int64)
            yield from _pieces(all_of(), piece)

        def pick(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell, col = (k.as_py() for k in key)
            v, total, _, below = joined(batches)
            ranks = wanted(cell, col, known[cell, col])
            low, high = spans[cell, col]
            out, span = np.empty(len(ranks), np.int64), np.searchsorted(below, ranks, "right") - 1
            held = np.concatenate([[0], total])
            before = held[np.searchsorted(v, low, "right")]  # of the values inside, those of earlier spans
            out = v[np.searchsorted(total, ranks - below[span] + before[span], "right")]
            yield told(cell, col, known[cell, col], True, out, np.zeros(0, np.int64))

        for r in near.mapInArrow(count, PIECE).groupBy("cell", "col").applyInArrow(pick, FOUND).collect():
            values[r["cell"], r["col"]] = np.frombuffer(r["values"], np.int64)
    out = []
    for i, (key, (n, low, high, width)) in enumerate(zip(keys, counts)):
        edges = []
        for j in range(width):
            v = ordered(np.unique(values[i, j])).view(np.float64) if (i, j) in values else np.zeros(0)
            edges.append((v[1:] + v[:-1]) / 2)
        lacks = np.array([(i, j) not in found or found[i, j]["known"] < n for j in range(width)], bool)
        out.append(Cell(key, n, low, high, edges, lacks, values.get((i, width), np.zeros(0, np.int64)), seeds[i] or 0))
    return out


def coded(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bins of rows, a byte each, ``[row, feature]``."""
    codes = np.empty(x.shape, np.uint8)
    for j, e in enumerate(edges):
        codes[:, j] = np.where(np.isnan(x[:, j]), MISSING, np.searchsorted(e, x[:, j], "left"))
    return codes


def packed_keys(codes: np.ndarray) -> np.ndarray:
    """Eight bins as one number: ``[row, word]``."""
    words = max(1, -(-codes.shape[1] // 8))
    wide = np.zeros((len(codes), 8 * words), np.uint8)
    wide[:, : codes.shape[1]] = codes
    return wide.view(np.int64)


def codes_of(keys: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(keys).view(np.uint8).reshape(len(keys), -1)[:, :width]


def _read(data: bytes, words: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(-1, words)


def summed(keys: np.ndarray, fold: np.ndarray, sums: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Rows of the same fold and keys as one, in their order, with their sums."""
    order = np.lexsort((*keys.T[::-1], fold))
    keys, fold = keys[order], fold[order]
    starts = np.flatnonzero(np.concatenate([[True], (fold[1:] != fold[:-1]) | (keys[1:] != keys[:-1]).any(axis=1)])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], fold[starts], [np.add.reduceat(s[order], starts) if len(starts) else s for s in sums]


def fixed(v: np.ndarray, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below ``2^exponent`` as two whole numbers, whose sums are exact in any order."""
    scaled = np.ldexp(v, BITS - exponent)
    high = np.floor(scaled)
    return high.astype(np.int64), np.rint(np.ldexp(scaled - high, BITS)).astype(np.int64)


def unfixed(high: np.ndarray, low: np.ndarray, exponent: int) -> np.ndarray:
    return np.ldexp(high + np.ldexp(low.astype(np.float64), -BITS), exponent - BITS)


@dataclass
class Grown:
    """Trees of all cells that were grown, scored and dropped: what they say of rows of the same bins is kept."""

    parts: DataFrame  # keys of cells and PARTS: a row per unit and chunk of groups
    picks: B.Picks
    by: list[str]
    link: bool
    cells: list[Cell]
    rows: dict[bool, DataFrame]  # training rows (True), test rows

    def _scored(self, train: bool) -> DataFrame:
        """A row per cell and chunk of groups: their keys, what is said of them, their rows and sums of labels."""
        keys = ", ".join(f"{k} {self.parts.schema[k].dataType.simpleString()}" for k in self.by)
        arrow = to_arrow_schema(StructType.fromDDL(f"{keys}, keys binary, value binary, rows binary, total binary"))
        link = self.link

        def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["unit"])  # so that a rerun gives the same bits
            total, weight = np.sum([np.frombuffer(r["scores"]) for r in rows], axis=0), sum(r["weight"] for r in rows)
            value, first = total / weight, rows[0]
            value = S.sigmoid(value) if link else value
            told = [*[k.as_py() for k in key[:-1]], first["keys"], value.tobytes(), first["rows"], first["total"]]
            yield pa.record_batch([pa.array([v], f.type) for v, f in zip(told, arrow)], schema=arrow)

        own = self.parts.where((F.col("train") == train) & F.col("scores").isNotNull()).select(*self.by, "chunk", "unit", "scores", "weight", "keys", "rows", "total")
        return own.groupBy(*self.by, "chunk").applyInArrow(add, f"{keys}, keys binary, value binary, rows binary, total binary")

    def groups(self, train: bool = False) -> DataFrame:
        """What is said of the rows of every cell, rows of the same bins as one: keys of cells, ``y_pred``, ``rows`` and the sum of their labels, ``total`` (of test rows: 0)."""
        keys = ", ".join(f"{k} {self.parts.schema[k].dataType.simpleString()}" for k in self.by)
        arrow, width = to_arrow_schema(StructType.fromDDL(f"{keys}, y_pred double, rows long, total double")), len(self.by)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in (r for b in batches for r in b.to_pylist()):
                value = np.frombuffer(r["value"])
                own = [pa.repeat(pa.scalar(r[f.name], f.type), len(value)) for f in list(arrow)[:width]]
                yield pa.record_batch([*own, pa.array(value), pa.array(np.frombuffer(r["rows"], np.int64)), pa.array(np.frombuffer(r["total"]))], schema=arrow)

        return self._scored(train).mapInArrow(read, f"{keys}, y_pred double, rows long, total double")

    def predictions(self, train: bool = False) -> DataFrame:
        """Keys of cells, ``row_id``, ``label`` and ``y_pred`` of the test rows, or of the training rows if they were scored."""
        by, picks, cells = list(self.picks.by), self.picks, self.cells
        rows, known = self.rows[train], [c.key for c in cells]
        sizes = {tuple(r)[: len(by)]: r["c"] for r in rows.groupBy(*by).agg(F.count(F.lit(1)).alias("c")).collect()}  # cells of the caller's design
        lots = [max(1, -(-sizes.get(k, 0) // LOOKUP_ROWS)) for k in known]
        schema = ", ".join([*[f"{k} {self.parts.schema[k].dataType.simpleString()}" for k in self.by], "row_id long, label double, y_pred double"])
        arrow = to_arrow_schema(StructType.fromDDL(schema))
        held = to_arrow_schema(StructType.fromDDL("_cell int, lot int, ids binary, y binary, keys binary"))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task = TaskContext.get().partitionId()
            for cell, x, own in B.by_cell(batches, ["row_id", "label"]):
                told = [cell, task % lots[cell], own["row_id"].tobytes(), own["label"].tobytes(), packed_keys(coded(x, cells[cell].edges)).tobytes()]
                yield pa.record_batch([pa.array([v], f.type) for v, f in zip(told, held)], schema=held)

        left = B.numbered(rows.select(*by, "row_id", "label", "features"), by, known).mapInArrow(pack, "_cell int, lot int, ids binary, y binary, keys binary")
        numbers = rows.sparkSession.createDataFrame([(*k, i, lots[i]) for i, k in enumerate(known)], ", ".join([*[f"{k} {rows.schema[k].dataType.simpleString()}" for k in by], "_cell int", "_lots int"]))
        right = self._scored(train).join(F.broadcast(numbers), by).withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("_lots") - 1)))
        right = right.select("_cell", "lot", *self.picks.names, "keys", "value")

        def look(own: pa.Table, told: pa.Table) -> pa.Table:
            out = []
            if own.num_rows and told.num_rows:
                cell = cells[own.column("_cell")[0].as_py()]
                width = len(cell.edges)
                rows = own.select(["ids", "y", "keys"]).to_pylist()
                ids, y = [np.concatenate([np.frombuffer(r[c], kind) for r in rows]) for c, kind in (("ids", np.int64), ("y", np.float64))]
                codes = np.concatenate([codes_of(_read(r["keys"], max(1, -(-width // 8))), width) for r in rows])
                del rows
                scored = told.to_pylist()
                for more, columns in picks.cells(cell.key, width):
                    words = max(1, -(-len(columns) // 8))
                    parts = [r for r in scored if tuple(r[n] for n in picks.names) == more]
                    if not parts:
                        continue
                    keys, value = np.concatenate([_read(r["keys"], words) for r in parts]), np.concatenate([np.frombuffer(r["value"]) for r in parts])
                    at = places(keys, packed_keys(codes[:, columns]))
                    named = [pa.repeat(pa.scalar(k, arrow.field(i).type), len(ids)) for i, k in enumerate((*cell.key, *more))]
                    out.append(pa.record_batch([*named, pa.array(ids), pa.array(y), pa.array(value[at])], schema=arrow))
            return pa.Table.from_batches(out, schema=arrow)

        return left.groupBy("_cell", "lot").cogroup(right.groupBy("_cell", "lot")).applyInArrow(look, schema)

    def reports(self) -> DataFrame:
        """One row per cell: ``trees``, ``leaf_rows``, ``n_train``, the least and largest label, ``best_rounds``, ``error``."""
        return self.parts.where(F.col("scores").isNull()).groupBy(*self.by).agg(
            F.sum("weight").alias("trees"), F.sum("leaf_rows").alias("leaf_rows"), F.max("n_train").alias("n_train"),
            F.min("y_min").alias("y_min"), F.max("y_max").alias("y_max"), F.max("best_rounds").alias("best_rounds"), F.min("error").alias("error"))


def places(keys: np.ndarray, sought: np.ndarray) -> np.ndarray:
    """Where the keys of rows are among different ``keys``."""
    if keys.shape[1] > 1:
        _, both = np.unique(np.concatenate([keys, sought]), axis=0, return_inverse=True)
        keys, sought = both.ravel()[: len(keys), None], both.ravel()[len(keys) :, None]
    order = np.argsort(keys[:, 0], kind="stable")
    return order[np.searchsorted(keys[order, 0], sought[:, 0])]


class Draws:
    """Bootstrap weights of groups: sums of Poisson numbers of mean one, a number for every row."""

    #: A weight by 16 random bits, of mean one.
    TABLE = np.zeros(0, np.float32)

    def __init__(self, groups: np.ndarray, y: np.ndarray):
        order = np.lexsort((y, groups))  # by the rows alone, however they came
        self.y, groups = y[order], groups[order]
        self.starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))

    @classmethod
    def table(cls) -> np.ndarray:
        if not len(cls.TABLE):
            share = np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 9.0)]))
            of = np.rint(share * 65536).astype(int)
            of[1] = 65536 - int((np.arange(2, 9) * of[2:]).sum())  # the mean is one
            of[0] = 65536 - int(of[1:].sum())
            cls.TABLE = np.repeat(np.arange(9), of).astype(np.float32)
        return cls.TABLE

    def of(self, seed: int, tree: int, centre: float) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the groups for a tree, and the weighted sums of their targets."""
        rng, table, ends = np.random.default_rng([seed, tree]), self.table(), np.append(self.starts, len(self.y))
        n, s, a = np.empty(len(self.starts)), np.empty(len(self.starts)), 0
        while a < len(self.starts):  # some groups at a time
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + (1 << 20), "right")) - 1)
            rows = slice(ends[a], ends[b])
            w = table[rng.integers(0, 65536, ends[b] - ends[a], np.uint16)].astype(np.float64)
            n[a:b] = np.add.reduceat(w, self.starts[a:b] - ends[a])
            s[a:b] = np.add.reduceat(w * (self.y[rows] - centre), self.starts[a:b] - ends[a])
            a = b
        return n, s


def grow_cells(train: DataFrame, test: DataFrame, by: Sequence[str], kind, seed: int, score_train: bool,
               keep: Callable[[DataFrame, str], DataFrame], picks: B.Picks | None, bins: int, unit_work: int, batch_work: int, chunk_rows: int) -> Grown:
    """Trees of all cells from sums of rows of the same bins; see ``cells.forest_cells``."""
    by, picks = list(by), picks or B.Picks(tuple(by))
    columns = ["row_id", F.xxhash64("row_id").alias("_hash"), F.col("label").cast("double").alias("label"), "features"]
    train, test = [part.select(*picks.by, *columns) for part in (train, test)]
    cells = cells_of(train, picks.by, bins, kind.folds, seed)
    rows_needed = bool(kind.trees) and not kind.random and not kind.classifier
    cell_keys = ", ".join(f"{k} {train.schema[k].dataType.simpleString() if k in picks.by else 'int'}" for k in by)
    packed_arrow, parts_arrow = [to_arrow_schema(StructType.fromDDL(f"{cell_keys}, {ddl}")) for ddl in (PACKED, PARTS)]
    errors, units_of, places_of = {}, {}, {}
    for i, c in enumerate(cells):
        for more, own in picks.cells(c.key, len(c.edges)):
            key = (*c.key, *more)
            places_of[key] = (i, own)
            if kind.classifier and c.y_min == c.y_max:
                errors[key] = "the training rows are of one class"
            elif not kind.missing and c.lacks[own].any():
                errors[key] = "a feature is missing"
    words = max([1, *[-(-len(c.edges) // 8) for c in cells]])
    names = [f"key{w}" for w in range(words)]
    both = train.withColumn("_train", F.lit(True)).unionByName(test.withColumn("_train", F.lit(False)))
    both = B.numbered(both, picks.by, [c.key for c in cells])
    group_ddl = ", ".join(["_cell int, fold int", *[f"{k} long" for k in names], "n long, high long, low long"])
    group_arrow = to_arrow_schema(StructType.fromDDL(group_ddl))

    def group_batch(cell: int, fold: np.ndarray, keys: np.ndarray, sums: Sequence[np.ndarray]) -> pa.RecordBatch:
        wide = np.zeros((len(keys), words), np.int64)
        wide[:, : keys.shape[1]] = keys
        return pa.record_batch([pa.repeat(pa.scalar(cell, pa.int32()), len(keys)), pa.array(fold.astype(np.int32)), *[pa.array(k) for k in wide.T.copy()], *[pa.array(s) for s in sums]], schema=group_arrow)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, x, own in B.by_cell(batches, ["_hash", "label", "_train"]):
            cell = cells[i]
            keys, role = packed_keys(coded(x, cell.edges)), own["_train"]
            if role.any():
                y = own["label"][role]
                fold = np.searchsorted(cell.fold_cuts, fold_keys(own["_hash"][role], cell.fold_seed), "left") if kind.folds else np.zeros(len(y), np.int64)
                k, f, sums = summed(keys[role], fold, [np.ones(len(y), np.int64), *fixed(y, cell.exponent)])
                yield group_batch(i, f, k, sums)
                if kind.folds:  # sums of squares of each fold, for its error
                    _, f, sums = summed(np.zeros((len(y), 1), np.int64), fold, [np.zeros(len(y), np.int64), *fixed(y * y, 2 * cell.exponent)])
                    yield group_batch(i, f + SQUARES_FOLD, np.zeros((len(f), 1), np.int64), sums)
            if not role.all():
                none = np.zeros(int((~role).sum()), np.int64)
                k, f, sums = summed(keys[~role], none - 1, [none + 1, none, none])
                yield group_batch(i, f, k, sums)

    groups = both.mapInArrow(group, group_ddl).groupBy("_cell", "fold", *names).agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")])

    def record(key: tuple, role: int, keys=None, fold=None, n=None, high=None, low=None, y=None, groups: int = 0) -> pa.RecordBatch:
        told = [*key, groups, role, *[None if v is None else v.tobytes() for v in (keys, fold, n, high, low, y)]]
        return pa.record_batch([pa.array([v], f.type) for v, f in zip(told, packed_arrow)], schema=packed_arrow)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _some(batches):
            number = held.column("_cell").to_numpy()
            fold, n, high, low = [held.column(c).to_numpy() for c in ("fold", "n", "high", "low")]
            keys = np.column_stack([held.column(k).to_numpy() for k in names])
            for i in np.unique(number).tolist():
                own = number == i
                cell = cells[i]
                width = len(cell.edges)
                codes = codes_of(keys[own], width)
                own_fold, own_sums = fold[own], [s[own] for s in (n, high, low)]
                for more, columns in picks.cells(cell.key, width):
                    key = (*cell.key, *more)
                    if key in errors:
                        continue
                    for role, part in ((TRAIN, (own_fold >= 0) & (own_fold < SQUARES_FOLD)), (TEST, own_fold < 0), (SQUARES, own_fold >= SQUARES_FOLD)):
                        if part.any():
                            k, f, sums = summed(packed_keys(codes[part][:, columns]), own_fold[part], [s[part] for s in own_sums])
                            f = (f - SQUARES_FOLD if role == SQUARES else np.maximum(f, 0)).astype(np.uint8)
                            yield record(key, role, k, f, *(sums if role != TEST else sums[:1]), groups=int(part.sum()) if role == TRAIN else 0)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, x, own in B.by_cell(batches, ["label"]):
            cell = cells[i]
            codes = coded(x, cell.edges)
            for more, columns in picks.cells(cell.key, x.shape[1]):
                key = (*cell.key, *more)
                if key not in errors:
                    keys = packed_keys(codes[:, columns])
                    order = np.lexsort((own["label"], *keys.T[::-1]))  # alike side by side are fewer bytes
                    yield record(key, ROWS, keys[order], y=own["label"][order])

    packed = keep(groups.mapInArrow(pack, f"{cell_keys}, {PACKED}"), "packed-rows")
    if kind.trees:  # told by the groups of all features, which are the same however rows are dealt out
        for r in packed.where(F.col("role") == TRAIN).groupBy(*by).agg(F.sum("groups").alias("groups")).collect():  # a row per cell of the design
            key = tuple(r[k] for k in by)
            i, own = places_of[key]
            work = min(float(r["groups"]), float(np.prod([len(cells[i].edges[j]) + 2.0 for j in own]))) * kind.trees
            units_of[key] = int(min(kind.trees, -(-work // unit_work)))
    if rows_needed:
        packed = packed.unionByName(B.numbered(train, picks.by, [c.key for c in cells]).mapInArrow(rows_of, f"{cell_keys}, {PACKED}"))
    spark = train.sparkSession
    if units_of:
        numbers = spark.createDataFrame([(*k, u) for k, u in units_of.items()], f"{cell_keys}, _units int")
        dealt = packed.join(F.broadcast(numbers), by).withColumn("unit", F.explode(F.sequence(F.lit(0), F.col("_units") - 1))).drop("_units")
    else:
        dealt = packed.withColumn("unit", F.lit(0))

    def part(told: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([told], parts_arrow)

    def grow(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *own_key, unit = [k.as_py() for k in key]
        own_key = tuple(own_key)
        cell, columns = cells[places_of[own_key][0]], places_of[own_key][1]
        words, units = max(1, -(-len(columns) // 8)), units_of.get(own_key, 1)
        held: dict[int, list[dict]] = {TRAIN: [], TEST: [], ROWS: [], SQUARES: []}
        for batch in batches:
            for r in batch.to_pylist():
                held[r["role"]].append(r)
        if not held[TRAIN]:
            return
        shared = dict(zip(by, own_key)) | {"unit": unit, "units": units, "n_train": cell.n, "y_min": cell.y_min, "y_max": cell.y_max, "train": True, "chunk": -1}

        def read(role: int, column: str, kind: type = np.int64) -> np.ndarray:
            return np.concatenate([np.frombuffer(r[column], kind) for r in held[role]])

        keys, fold, (n, high, low) = summed(read(TRAIN, "keys").reshape(-1, words), read(TRAIN, "fold", np.uint8), [read(TRAIN, c) for c in ("rows", "high", "low")])
        held[TRAIN].clear()
        total, count = unfixed(high, low, cell.exponent), n.astype(np.float64)
        del high, low
        edges = [cell.edges[j] for j in columns]
        padded = np.full((len(columns), max([1, *map(len, edges)])), np.inf)
        for row, e in zip(padded, edges):
            row[: len(e)] = e
        most = padded.shape[1] + 2

        def codes(of: np.ndarray) -> np.ndarray:
            own = codes_of(of, len(columns)).copy()
            own[own == MISSING] = most - 1
            return own

        data = T.Binned(np.ascontiguousarray(codes(keys).T), padded, most)
        test_keys = np.zeros((0, words), np.int64)
        if held[TEST]:
            test_keys, _, (test_n,) = summed(read(TEST, "keys").reshape(-1, words), read(TEST, "fold", np.uint8), [read(TEST, "rows")])
            held[TEST].clear()
        sets = [(False, test_keys, test_n, np.zeros(len(test_keys)))] if len(test_keys) else []

        def written(scores: list[np.ndarray], weight: float) -> Iterator[pa.RecordBatch]:
            for (of_train, own, rows, labels), score in zip(sets, scores):
                for chunk, a in enumerate(range(0, len(own), chunk_rows)):
                    b = a + chunk_rows
                    more = {"keys": own[a:b].tobytes(), "rows": rows[a:b].tobytes(), "total": labels[a:b].tobytes()} if unit == 0 else {}
                    yield part(shared | {"train": of_train, "chunk": chunk, "scores": score[a:b].tobytes(), "weight": weight} | more)

        if kind.boosting:
            how, rounds = kind.boosting, kind.boosting.rounds
            if kind.folds:
                squares = np.zeros(int(fold.max()) + 1)
                for r in held[SQUARES]:
                    f, h, lo = np.frombuffer(r["fold"], np.uint8), np.frombuffer(r["high"], np.int64), np.frombuffer(r["low"], np.int64)
                    squares[f] += unfixed(h, lo, 2 * cell.exponent)
                rounds = T.best_rounds(data, total, fold, how, kind.patience, count, squares)
            base, nodes, roots, own = T.boost_and_score(data, total, rounds, how, count)
            nodes["cut"] = T.code_cuts(nodes, padded)
            yield part(shared | {"weight": 1.0, "best_rounds": rounds})
            scores = [T.leaf_sums(nodes, roots, codes(test_keys), base, most - 1)] if sets else []
            if score_train:
                sets.append((True, keys, n, total))
                scores.append(own)
            yield from written(scores, 1.0)
            return
        centre, span = float(total.sum() / count.sum()), cell.y_max - cell.y_min
        target = total - count * centre if span else np.zeros(len(total))
        squares, cell_seed = float(count.sum()) * span * span / 4, seed_of(own_key, seed)
        draws = None
        if rows_needed:
            drawn_keys, y = read(ROWS, "keys").reshape(-1, words), read(ROWS, "y", np.float64)
            held[ROWS].clear()
            draws = Draws(places(keys, drawn_keys).astype(np.int32), y)
            del drawn_keys, y

        def weights(tree: int) -> tuple[np.ndarray, np.ndarray]:
            if kind.random:
                return count, target
            if draws is not None:
                w, s = draws.of(cell_seed, tree, centre)
                return w, s if span else np.zeros(len(s))
            rng = np.random.default_rng([cell_seed, tree])  # so many rows of each class, each with a weight of its own
            one, none = rng.poisson(total), rng.poisson(np.maximum(count - total, 0.0))
            return (one + none).astype(np.float64), one * (1 - centre) - none * centre

        if score_train:
            sets.append((True, keys, n, total))
        rows = [codes(own) for _, own, _, _ in sets]
        scores, leaf_rows, trees = [np.zeros(len(r)) for r in rows], 0.0, np.arange(unit, kind.trees, units)
        batch = max(1, batch_work // max(1, len(count)))
        for a in range(0, len(trees), batch):
            own = trees[a : a + batch]
            w, s = [np.array(v) for v in zip(*map(weights, own.tolist()))]
            nodes = T._grow(data, w, s, centre, squares, kind.min_leaf, kind.depth, cell_seed * 1009 + int(own[0]), kind.random)
            leaf_rows += float(nodes["count"][nodes["feature"] < 0].sum())
            nodes["cut"] = T.code_cuts(nodes, padded)
            for r, score in zip(rows, scores):
                score += T.leaf_values(nodes, np.arange(len(own)), r).sum(axis=0)
        yield part(shared | {"weight": float(len(trees)), "leaf_rows": leaf_rows})
        yield from written(scores, float(len(trees)))

    lots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism)
    parts = dealt.repartition(lots, *by, "unit").groupBy(*by, "unit").applyInArrow(grow, f"{cell_keys}, {PARTS}")
    if errors:
        bad = [tuple({**dict(zip(by, k)), "unit": 0, "units": 1, "train": True, "chunk": -1, "n_train": cells[places_of[k][0]].n, "y_min": cells[places_of[k][0]].y_min, "y_max": cells[places_of[k][0]].y_max, "error": e}.get(c) for c in parts.columns) for k, e in errors.items()]
        parts = parts.unionByName(spark.createDataFrame(bad, parts.schema))  # a row per cell of the design
    return Grown(keep(parts, "forest-sums"), picks, by, kind.link, cells, {True: train, False: test})


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= B.ROWS:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)
