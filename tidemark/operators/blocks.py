"""Rows of cells in a map-only pass: Arrow batches as matrices, some at a time and by cell.

Cells are of the caller's design, so their keys and what is known of them fit the driver;
their rows stay where they are and meet them in a closure.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Rows that a task looks at together.
ROWS = 1 << 17


@dataclass(frozen=True)
class Picks:
    """Which features the cells over the same rows take, so that rows are not repeated for them.

    ``by`` are the keys of rows, ``names`` what a cell's key has beside them, and ``of`` lists
    for a key of rows the further keys of its cells with the places of their features.
    Without ``of`` the keys of rows are cells, of all features.
    """

    by: tuple[str, ...]
    names: tuple[str, ...] = ()
    of: dict[tuple, list[tuple[tuple, list[int]]]] | None = None

    @property
    def keys(self) -> list[str]:
        return [*self.by, *self.names]

    def cells(self, key: tuple, width: int) -> list[tuple[tuple, list[int]]]:
        """Keys of the cells over the rows of ``key``, and the places of their features."""
        return [((), list(range(width)))] if self.of is None else self.of.get(key, [])


    def without(self, cells: set[tuple]) -> Picks:
        """All but some cells, by their keys."""
        return Picks(self.by, self.names, {key: [own for own in more if (*key, *own[0]) not in cells] for key, more in (self.of or {}).items()})


def matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray | pa.LargeListArray) else pa.chunked_array([c.flatten() for c in flat.chunks]).combine_chunks()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def numbered(rows: DataFrame, by: Sequence[str], keys: Sequence[tuple]) -> DataFrame:
    """Rows of the cells ``keys`` only, with the number of their cell, ``_cell``."""
    schema = StructType([*[StructField(b, rows.schema[b].dataType) for b in by], StructField("_cell", StructType.fromDDL("c int")[0].dataType)])
    cells = rows.sparkSession.createDataFrame([(*k, i) for i, k in enumerate(keys)], schema)  # cells of the caller's design
    return rows.join(F.broadcast(cells), list(by)).drop(*by)


def by_cell(batches: Iterator[pa.RecordBatch], columns: Sequence[str]) -> Iterator[tuple[int, np.ndarray, dict[str, np.ndarray]]]:
    """Number, features and other ``columns`` of the rows of every cell among some batches of :func:`numbered` rows."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= ROWS:
            yield from _parted(held, columns)
            held, size = [], 0
    if size:
        yield from _parted(held, columns)


def _parted(held: list[pa.RecordBatch], columns: Sequence[str]) -> Iterator[tuple[int, np.ndarray, dict[str, np.ndarray]]]:
    table = pa.Table.from_batches(held)
    x, cell = matrix(table.column("features"), table.num_rows), table.column("_cell").to_numpy()
    own = {c: table.column(c).to_numpy() for c in columns}
    order = np.argsort(cell, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(cell[order]) > 0]))
    for rows in np.split(order, starts[1:]):
        yield int(cell[rows[0]]), x[rows], {c: v[rows] for c, v in own.items()}


def added(parts: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Sums of the vectors ``v`` by ``cell`` and ``slot``, in the order of the tasks ``task`` that made them, at the driver."""
    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["task"])
        total = np.sum([np.frombuffer(r["v"]) for r in rows], axis=0)
        yield pa.record_batch([pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([total.tobytes()], pa.binary())], names=["cell", "slot", "v"])

    found = parts.groupBy("cell", "slot").applyInArrow(add, "cell int, slot int, v binary").collect()  # a row per cell of the design
    return {(r["cell"], r["slot"]): np.frombuffer(r["v"]) for r in found}
