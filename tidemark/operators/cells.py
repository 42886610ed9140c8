"""Models of many cells in one plan.

A design has up to millions of cells, each with a bounded sample. Spark deals the rows
to (cell, unit) groups; a unit is all of a model, or as many trees of a forest as one
task should grow. Models come back as rows, meet the test rows by (cell, block, unit),
and the parts of a prediction are added up by row. So no driver loop runs over cells,
and neither the trees nor the rows of two cells meet in one task.

Cells of any size are fitted in the same way. A caller that sets ``MAX_VALUES`` has
``oversized`` list the cells above it, for the distributed estimators of ``models``.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.functions.ordered import seed_hash, short_digest
from tidemark.operators import blocks as B
from tidemark.operators import grouped as Q
from tidemark.operators import logistic as G
from tidemark.operators import small_models as S
from tidemark.operators import trees as T
from tidemark.operators.models import nonnegative_weights

#: Values (rows times features) above which a cell is left to Spark ML, if a caller sets it: by itself no size changes how a cell is fitted.
MAX_VALUES: int | None = None
#: So many times as much for boosted trees, which hold a byte a value once rows are binned, and for networks, which take a few rows at a time.
PACKED_TIMES = 2
#: Rows times trees that one unit grows, and rows of a block that is predicted at once.
UNIT_PLACEMENTS, BLOCK_ROWS = 1 << 18, 1 << 16
#: Rows of different bins times trees of a forest's unit that grows and scores batches of ``UNIT_PLACEMENTS``, and such rows of a chunk.
UNIT_WORK, CHUNK_ROWS = 1 << 24, 1 << 18
FOREST_BINS = 31

MODEL = "unit int, units int, weight double, start double, body binary, roots binary, n_train long, y_min double, y_max double, n_iter int, best_rounds int, converged boolean, error string"


@dataclass
class Part:
    """A model, or a unit's share of it: predictions are sums of parts over sums of weights."""

    body: np.ndarray
    roots: np.ndarray | None = None
    start: float = 0.0
    weight: float = 1.0
    n_iter: int | None = None
    best_rounds: int | None = None
    converged: bool = True


@dataclass(frozen=True)
class Kind:
    """How a named model is fitted on one group and how its part scores rows."""

    fit: Callable[..., Part]  # x, y, row_hash, seed, unit, units
    score: Callable[[Part, np.ndarray], np.ndarray]
    trees: int = 0  # more than none: dealt to units
    classifier: bool = False
    link: bool = False  # scores are log odds
    missing: bool = False  # takes missing features
    random: bool = False  # forests: random cuts of all rows, no bootstrap
    rounds: int = 0
    min_leaf: int = 1
    depth: int = 20
    boosting: T.Boosting | None = None
    folds: int = 0  # rounds are chosen over so many
    patience: int | None = None
    batched: bool = False  # fitted a few rows at a time
    linear: bool = False  # the score is an intercept and a product of coefficients
    logistic: tuple[float, float] | None = None  # C and share of the absolute penalty of a regression of distributed rows

    @property
    def packed(self) -> bool:
        """Grown from bins and scored where the rows are, by ``forest_cells``."""
        return bool(self.trees or self.boosting)


def _forest(trees: int, min_leaf: int, depth: int, random: bool, classifier: bool) -> Kind:
    def fit(x, y, row_hash, seed, unit, units):
        own = np.arange(unit, trees, units)
        weights = np.ones((len(own), len(y))) if random else T.bootstrap_weights(row_hash, own, seed)
        nodes = T.grow_forest(T.Binned.of(x, FOREST_BINS), y, weights, min_leaf, depth, seed * 1009 + unit, random)
        return Part(nodes, np.arange(len(own)), weight=float(len(own)))

    return Kind(fit, lambda part, x: T.leaf_values(part.body, part.roots, x).sum(axis=0), trees, classifier, random=random, min_leaf=min_leaf, depth=depth)


def _folds(row_hash: np.ndarray, seed: int, folds: int) -> np.ndarray:
    """Fold of each row, from its hash; the rows come in the order of their hashes."""
    order = np.argsort(row_hash * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(seed), kind="stable")
    fold = np.empty(len(order), np.uint8)
    for k, rows in enumerate(np.array_split(order, min(folds, len(order)))):
        fold[rows] = k
    return fold


def _boosted(how: T.Boosting, folds: int, patience: int | None) -> Kind:
    def fit(x, y, row_hash, seed, unit, units):
        rounds = T.best_rounds(x, y, _folds(row_hash, seed, folds), how, patience) if folds else how.rounds
        start, nodes, roots = T.boost(T.Binned.of(x, how.bins), y, rounds, how)
        return Part(nodes, roots, start, n_iter=rounds, best_rounds=rounds)

    return Kind(fit, lambda part, x: part.start + T.leaf_values(part.body, part.roots, x).sum(axis=0), classifier=how.logistic, link=how.logistic, missing=True, rounds=how.rounds, boosting=how, folds=folds, patience=patience)


def _linear(fitter: Callable, classifier: bool, logistic: tuple[float, float] | None = None) -> Kind:
    def fit(x, y, row_hash, seed, unit, units):
        w, n_iter, converged = fitter(x, y)
        return Part(w, n_iter=n_iter, converged=converged)

    return Kind(fit, lambda part, x: part.body[0] + x @ part.body[1:], classifier=classifier, link=classifier, linear=True, logistic=logistic)


def _logistic(c: float, l1: float) -> Kind:
    return _linear(lambda x, y: S.logistic(x, y, c, l1), True, (c, l1))


def _network(hidden: int, iterations: int, l2: float, rate: float) -> Kind:
    def fit(x, y, row_hash, seed, unit, units):
        theta, n_iter, converged = S.network(x, y, hidden, iterations, l2, rate, seed)
        return Part(theta, n_iter=n_iter, converged=converged)

    return Kind(fit, lambda part, x: S.network_score(part.body, x, hidden), classifier=True, link=True, batched=True)


# Parameters of the named models (fixed values).
KINDS: dict[str, Kind] = {
    "random_forest": _forest(500, 5, 20, False, False),
    "random_forest_classifier": _forest(500, 1, 20, False, True),
    "extra_trees": _forest(500, 5, 20, True, False),
    "extra_trees_classifier": _forest(500, 1, 20, True, True),
    "boosted": _boosted(T.Boosting(0.3, 90, 4, 2, l2=1.0), 5, None),
    "boosted_classifier": _boosted(T.Boosting(0.3, 90, 4, 2, l2=1.0, logistic=True), 0, None),
    "boosted_leaf": _boosted(T.Boosting(0.05, 200, 10, 64, min_rows=10, min_hessian=1e-3), 5, 10),
    "boosted_leaf_classifier": _boosted(T.Boosting(0.05, 200, 10, 64, min_rows=10, min_hessian=1e-3, logistic=True), 0, None),
    "ridge": _linear(lambda x, y: (S.ridge(x, y, 1.0), 1, True), False),
    "ols_classifier": _logistic(1e12, 0.0),
    "ridge_classifier": _logistic(1.0, 0.0),
    "lasso_classifier": _logistic(1.0, 1.0),
    "neural_net_classifier": _network(64, 500, 1e-4, 1e-3),
}
# Base models of the stacks where they differ from the models by themselves.
BASES: dict[str, dict[str, Kind]] = {
    "stack": {
        "ridge": KINDS["ridge"],
        "extra_trees": KINDS["extra_trees"],
        "boosted_leaf": _boosted(T.Boosting(0.05, 200, 10, 64, min_rows=10, min_hessian=1e-3), 0, None),
    },
    "stack_classifier": {
        "ridge_classifier": KINDS["ridge_classifier"],
        "boosted_leaf_classifier": _boosted(T.Boosting(0.05, 200, 10, 64, min_rows=20, min_hessian=1e-3, logistic=True), 0, None),
        "extra_trees_classifier": _forest(300, 1, 20, True, True),
        "neural_net_classifier": KINDS["neural_net_classifier"],
    },
}


def oversized(train: DataFrame, by: Sequence[str], max_values: int | None = None, kind: Kind | None = None) -> DataFrame:
    """Cells with more values than a caller allows, none if it does not say; boosted trees and networks take more."""
    if MAX_VALUES is None and max_values is None:
        return train.select(*by, F.lit(0).alias("values")).limit(0)
    most = MAX_VALUES * (PACKED_TIMES if kind is not None and (kind.boosting or kind.batched) else 1) if max_values is None else max_values
    return train.groupBy(*by).agg((F.count(F.lit(1)) * F.max(F.size("features"))).alias("values")).where(F.col("values") > most)


def forest_sizes(models: DataFrame, by: Sequence[str], kind: Kind) -> DataFrame:
    """``trees`` of each forest and the rows in all their leaves, ``leaf_rows``."""
    def read(batches):
        for batch in batches:
            bodies = [np.frombuffer(b, T.NODE) for b in batch.column(len(by)).to_pylist()]
            leaves = [float(b["count"][b["feature"] < 0].sum()) for b in bodies]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(by))], batch.column(len(by) + 1), pa.array(leaves, pa.float64())], names=[*by, "weight", "leaves"])

    parts = models.where("error is null").select(*by, "body", "weight").mapInArrow(read, f"{_ddl(models, by)}, weight double, leaves double")
    return parts.groupBy(*by).agg(F.sum("weight").alias("trees"), F.sum("leaves").alias("leaf_rows"))


_matrix = B.matrix


def _gathered(batches: Iterator[pa.RecordBatch], columns: Sequence[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Features of a group as one matrix, which is filled as its rows come, and its other ``columns``."""
    values, parts = bytearray(), {c: [] for c in columns}
    for batch in batches:
        table = pa.Table.from_batches([batch])
        values += _matrix(table.column("features"), table.num_rows).data.cast("B")
        for c in columns:
            parts[c].append(table.column(c).to_numpy())
    own = {c: np.concatenate(parts.pop(c)) for c in columns}
    n = len(own[columns[0]])
    return np.frombuffer(values).reshape(n, -1), own


def _fittable(kind: Kind, x: np.ndarray, y: np.ndarray) -> None:
    """Raise for rows that a kind does not take."""
    if kind.classifier and y.min() == y.max():
        raise ValueError("the training rows are of one class")
    if not kind.missing and any(np.isnan(x[a : a + BLOCK_ROWS]).any() for a in range(0, len(x), BLOCK_ROWS)):
        raise ValueError("a feature is missing")


def _seed(key: tuple, names: Sequence[str], seed: int) -> int:
    """Seed of a cell, from its keys alone: the same whatever else is fitted."""
    return zlib.crc32(",".join([str(seed), *(str(k.as_py()) for k, n in zip(key, names) if n != "unit")]).encode()) & 0x7FFFFFFF


def _ddl(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in names)


def fit_cells(train: DataFrame, by: Sequence[str], kind: Kind, seed: int = 0, picks: B.Picks | None = None) -> DataFrame:
    """Models of all cells: ``by`` and the columns of ``MODEL``, a row per unit.

    Logistic regressions leave the rows where they are, whatever the size of a cell; their
    rows may be given once for several cells, with the ``picks`` of these.

    ``train``: ``by``, ``row_id``, ``label`` and ``features``. A cell that cannot be fitted
    (a classifier's rows of one class, a feature that is missing where none may be)
    has one row with its error.
    """
    by = list(by)
    if kind.logistic is not None:
        return _regressions(train, by, kind, picks or B.Picks(tuple(by)))
    rows = train.withColumn("_hash", F.xxhash64("row_id"))
    if kind.trees:
        sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
        units = F.least(F.lit(kind.trees), F.ceil(F.col("_n") * kind.trees / UNIT_PLACEMENTS)).cast("int")
        rows = rows.join(sizes.select(*by, units.alias("units")), by)
    else:
        rows = rows.withColumn("units", F.lit(1))
    rows = rows.withColumn("unit", F.explode(F.sequence(F.lit(0), F.col("units") - 1)))
    names = [*by, "unit"]
    schema = f"{_ddl(train, by)}, {MODEL}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def fit(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, own = _gathered(batches, ["row_id", "_hash", "label", "units"])
        order = np.lexsort((own["row_id"], own["_hash"]))
        for column in x.T:  # one at a time: the features are held once
            column[:] = column[order]
        y, row_hash, n = own["label"][order], own["_hash"][order].view(np.uint64), len(x)
        unit, units = key[-1].as_py(), int(own["units"][0])
        del own, order
        part, error = Part(np.zeros(0)), None
        try:
            _fittable(kind, x, y)
            part = kind.fit(x, y, row_hash, _seed(key, names, seed), unit, units)
        except (ValueError, np.linalg.LinAlgError) as e:  # becomes the cell's error
            error = str(e)
        ok = error is None
        values = dict(zip(by, (k.as_py() for k in key))) | {
            "unit": unit, "units": units, "weight": part.weight if ok else None, "start": part.start if ok else None,
            "body": part.body.tobytes() if ok else None, "roots": part.roots.astype("<i8").tobytes() if ok and part.roots is not None else None,
            "n_train": n, "y_min": float(y.min()), "y_max": float(y.max()), "n_iter": part.n_iter, "best_rounds": part.best_rounds,
            "converged": part.converged if ok else None, "error": error}
        yield pa.RecordBatch.from_pylist([values], arrow)

    dealt = rows.select(*names, "units", "row_id", "_hash", F.col("label").cast("double").alias("label"), "features")
    return dealt.groupBy(*names).applyInArrow(fit, schema)


def _regressions(train: DataFrame, by: list[str], kind: Kind, picks: B.Picks) -> DataFrame:
    rows = []
    for f in G.fit(train, picks, *kind.logistic):
        ok = f["error"] is None
        rows.append({k: f[k] for k in (*by, "n_train", "y_min", "y_max", "n_iter", "converged", "error")} | {
            "unit": 0, "units": 1, "weight": 1.0 if ok else None, "start": 0.0 if ok else None, "body": bytearray(f["w"].tobytes()) if ok else None, "roots": None, "best_rounds": None})
    keys = ", ".join(f"{k} {train.schema[k].dataType.simpleString() if k in picks.by else 'int'}" for k in by)
    schema = StructType.fromDDL(f"{keys}, {MODEL}")
    return train.sparkSession.createDataFrame([tuple(r[c] for c in schema.names) for r in rows], schema)  # a row per cell of the design


def _linear_predictions(models: DataFrame, test: DataFrame, by: list[str], kind: Kind, picks: B.Picks, keep: list[str]) -> DataFrame:
    """As ``predict_cells``: the few coefficients of all cells go to the rows, which are not moved."""
    fits = {tuple(r[k] for k in by): np.frombuffer(r["body"]) for r in models.where(F.col("error").isNull()).select(*by, "body").collect()}  # a row per cell of the design
    keys = sorted({k[: len(picks.by)] for k in fits})
    passed = ["row_id", "label", *keep]
    rows = B.numbered(test.withColumn("label", F.col("label").cast("double")).select(*picks.by, *passed, "features"), picks.by, keys)
    ints = {n: "int" for n in picks.names}
    schema = ", ".join([*[f"{k} {ints.get(k) or test.schema[k].dataType.simpleString()}" for k in by], _ddl(rows, passed), "y_pred double"])
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, x, own in B.by_cell(batches, passed):
            for more, columns in picks.cells(keys[cell], x.shape[1]):
                key = (*keys[cell], *more)
                if key not in fits:
                    continue
                value = kind.score(Part(fits[key]), x[:, columns])
                value = S.sigmoid(value) if kind.link else value
                named = [pa.repeat(pa.scalar(k, arrow.field(i).type), len(x)) for i, k in enumerate(key)]
                yield pa.record_batch([*named, *[pa.array(own[c], arrow.field(c).type) for c in passed], pa.array(value)], schema=arrow)

    return rows.mapInArrow(score, schema)


def _part(row: dict, kind: Kind) -> Part:
    body = np.frombuffer(row["body"], T.NODE if row["roots"] is not None else np.float64)
    roots = None if row["roots"] is None else np.frombuffer(row["roots"], np.int64)
    return Part(body, roots, row["start"], row["weight"])


def predict_cells(models: DataFrame, test: DataFrame, by: Sequence[str], kind: Kind, keep: Sequence[str] = (), picks: B.Picks | None = None) -> DataFrame:
    """``by, row_id, label, y_pred`` (and ``keep``) of the rows of every fitted cell.

    Rows meet the units of their own cell only, in blocks of bounded size. A cell with
    an error has no rows. Rows of linear models may be given once for several cells, with their ``picks``.
    """
    by, keep = list(by), list(keep)
    if kind.linear:
        return _linear_predictions(models, test, by, kind, picks or B.Picks(tuple(by)), keep)
    good = models.where(F.col("error").isNull())
    sizes = test.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    blocks = sizes.select(*by, F.ceil(F.col("_n") / BLOCK_ROWS).cast("int").alias("_blocks"))
    wide = good.select(*by, "unit", "weight", "start", "body", "roots").join(blocks, by)
    wide = wide.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    units = good.groupBy(*by).agg(F.max("units").alias("_units"))
    rows = test.join(blocks, by).join(units, by)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("row_id"), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("unit", F.explode(F.sequence(F.lit(0), F.col("_units") - 1)))
    names = [*by, "block", "unit"]
    passed = ["row_id", "label", *keep]
    rows = rows.withColumn("label", F.col("label").cast("double")).select(*names, *passed, "features")
    schema = f"{_ddl(rows, [*by, *passed])}, _score double, _weight double"

    def score(key: tuple, own: pa.Table, model: pa.Table) -> pa.Table:
        part = _part(model.slice(0, 1).to_pylist()[0], kind) if model.num_rows else None
        if part is None or not own.num_rows:
            return own.select([*by, *passed]).slice(0, 0).append_column("_score", pa.array([], pa.float64())).append_column("_weight", pa.array([], pa.float64()))
        value = kind.score(part, _matrix(own.column("features"), own.num_rows))
        out = own.select([*by, *passed]).append_column("_score", pa.array(value, pa.float64()))
        return out.append_column("_weight", pa.array(np.full(own.num_rows, part.weight)))

    parts = rows.groupBy(*names).cogroup(wide.groupBy(*names)).applyInArrow(score, schema)
    total = F.sum("_score") / F.sum("_weight")
    value = 1 / (1 + F.exp(-total)) if kind.link else total
    return parts.groupBy(*by, "row_id").agg(*[F.first(c).alias(c) for c in ["label", *keep]], value.alias("y_pred"))


PACKED = "units int, train boolean, chunk int, codes binary, y binary, ids binary, fold binary, edges binary, n_train long, y_min double, y_max double, error string"
FOREST = "unit int, units int, train boolean, chunk int, scores binary, y binary, ids binary, weight double, leaf_rows double, n_train long, y_min double, y_max double, best_rounds int, error string"


@dataclass
class Forests:
    """Forests or boosted trees of all cells that were grown, scored and dropped: only what they say of rows is kept."""

    parts: DataFrame  # by and FOREST: a row per unit and chunk of rows
    by: list[str]
    kind: Kind

    def predictions(self, train: bool = False) -> DataFrame:
        """``by, row_id, label, y_pred`` of the test rows, or of the training rows if they were scored."""
        schema = f"{_ddl(self.parts, self.by)}, row_id long, label double, y_pred double"
        arrow, link = to_arrow_schema(StructType.fromDDL(schema)), self.kind.link

        def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, weight, ids, y = 0.0, 0.0, None, None
            for row in (r for b in batches for r in b.to_pylist()):
                total, weight = total + np.frombuffer(row["scores"], np.float64), weight + row["weight"]
                if row["ids"] is not None:
                    ids, y = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["y"], np.float64)
            keys = [pa.repeat(k, len(ids)) for k in key[:-1]]
            value = total / weight
            yield pa.record_batch([*keys, pa.array(ids), pa.array(y), pa.array(S.sigmoid(value) if link else value)], schema=arrow)

        own = self.parts.where((F.col("train") == train) & F.col("scores").isNotNull())
        # Sums run in the order of units, so that a rerun gives the same bits.
        return _spread(own.select(*self.by, "chunk", "unit", "scores", "weight", "ids", "y"), [*self.by, "chunk"]).sortWithinPartitions(*self.by, "chunk", "unit").groupBy(*self.by, "chunk").applyInArrow(add, schema)

    def reports(self) -> DataFrame:
        """One row per cell: ``trees``, ``leaf_rows``, ``n_train``, the least and largest label, ``best_rounds``, ``error``."""
        once = F.col("scores").isNull()
        return self.parts.where(once).groupBy(*self.by).agg(
            F.sum("weight").alias("trees"), F.sum("leaf_rows").alias("leaf_rows"), F.max("n_train").alias("n_train"),
            F.min("y_min").alias("y_min"), F.max("y_max").alias("y_max"), F.max("best_rounds").alias("best_rounds"), F.min("error").alias("error"))


def _spread(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows dealt to tasks that adaptive execution does not merge: their work is not told by their bytes."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def forest_cells(train: DataFrame, test: DataFrame, by: Sequence[str], kind: Kind, seed: int = 0, score_train: bool = False,
                 keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df, stack: Stack | None = None, picks: B.Picks | None = None) -> Forests | Q.Grown:
    """Grow the forests of all cells and score the cell's rows where the trees are.

    Rows are binned, to a byte a value, and those of the same bins are one for the units
    (``grouped``). A unit's trees are dropped when they have scored the test rows
    (with ``score_train`` also the training rows): what is written is one sum per unit
    and different row, whatever the number and size of the trees. Boosted trees are one
    unit. Rows may be given once for several cells, with the ``picks`` of these.

    With ``stack`` a cell's rows come once to a task, and what is packed of them are its parts
    (a key ``part`` more): forests of every fold, which score the rows held out, and one
    of all rows, which scores the test rows.
    """
    if stack is None:
        bins = kind.boosting.bins if kind.boosting else FOREST_BINS
        return Q.grow_cells(train, test, by, kind, seed, score_train, keep, picks, bins, UNIT_WORK, UNIT_PLACEMENTS, CHUNK_ROWS)
    cell_by = list(by)
    bins = kind.boosting.bins if kind.boosting else FOREST_BINS
    columns = ["row_id", (F.xxhash64("row_id") if kind.boosting else F.lit(None).cast("long")).alias("_hash"), F.col("label").cast("double").alias("label"), "features",
               (stack.digest() if stack else F.lit(None).cast("long")).alias("_digest")]
    both = train.select(*cell_by, *columns, F.lit(True).alias("_train")).unionByName(test.select(*cell_by, *columns, F.lit(False).alias("_train")))
    by = [*cell_by, "part"] if stack else cell_by
    keys = _ddl(train, cell_by) + (", part int" if stack else "")
    packed_schema, forest_schema = [to_arrow_schema(StructType.fromDDL(f"{keys}, {ddl}")) for ddl in (PACKED, FOREST)]

    def pack(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {True: [], False: []}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            own = table.column("_train").to_numpy()
            x, ids, y = _matrix(table.column("features"), len(own)), table.column("row_id").to_numpy(), table.column("label").to_numpy()
            hashes = table.column("_hash").to_numpy() if kind.boosting else ids
            digests = table.column("_digest").to_numpy() if stack else ids
            for role in (True, False):
                if (own == role).any():
                    held[role].append((x[own == role], ids[own == role], y[own == role], hashes[own == role], digests[own == role]))
        if not held[True]:
            return
        if not stack:
            yield from packed_rows(key, *[[rows[:4] for rows in held.pop(role)] for role in (True, False)])
            return
        _, ids, y, _, digests = zip(*held[True])
        folds = stack.folds_of(np.concatenate(ids), np.concatenate(y), np.concatenate(digests))
        folds = np.split(folds, np.cumsum([len(own) for own in y])[:-1])
        for part in range(-1, max(int(f.max()) for f in folds) + 1):
            taken = [[rows[:4] if part < 0 else tuple(a[fold != part] for a in rows[:4]) for rows, fold in zip(held[True], folds)]]
            taken.append([tuple(a[fold == part] for a in rows[:4]) for rows, fold in zip(held[True], folds)] if part >= 0 else [rows[:4] for rows in held[False]])
            yield from packed_rows((*key, pa.scalar(part, pa.int32())), *[[rows for rows in own if len(rows[1])] for own in taken])

    def packed_rows(key: tuple[pa.Scalar, ...], own: list[tuple], scored: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not own:
            return
        cell = dict(zip(by, (k.as_py() for k in key)))
        xs, *rest = zip(*own)
        own.clear()
        ids, y, hashes = [np.concatenate(part) for part in rest]
        report = {"n_train": len(y), "y_min": float(y.min()), "y_max": float(y.max())}
        if kind.classifier and y.min() == y.max():
            report["error"] = "the training rows are of one class"
        elif not kind.missing and any(np.isnan(x).any() for x in xs):
            report["error"] = "a feature is missing"
        if "error" in report:
            yield pa.RecordBatch.from_pylist([cell | report | {"units": 1, "train": True, "chunk": 0}], packed_schema)
            return
        units = int(min(kind.trees, -(-len(y) * kind.trees // UNIT_WORK))) if kind.trees else 1
        # A column at a time: beside the rows as they came only one is held in full.
        data = T.Binned.of_columns(lambda f: np.concatenate([x[:, f] for x in xs]), xs[0].shape[1], len(y), bins, np.uint8)
        del xs
        order = np.lexsort((ids, hashes if kind.boosting else T.mixed(ids.view(np.uint64))))  # by the rows alone, however they came
        fold = _folds(hashes[order].view(np.uint64), _seed(key, by, seed), kind.folds) if kind.folds else None
        for f, codes in enumerate(data.codes):
            data.codes[f] = codes[order]
        parts = [(True, data.codes, ids[order], y[order])]
        if scored:
            xs, ids, y, _ = zip(*scored)
            parts.append((False, np.concatenate([data.codes_of(x) for x in xs], axis=1), np.concatenate(ids), np.concatenate(y)))
        for role, codes, ids, y in parts:
            for chunk, a in enumerate(range(0, len(y), CHUNK_ROWS)):
                b = a + CHUNK_ROWS
                values = {"units": units, "train": role, "chunk": chunk, "codes": codes[:, a:b].tobytes(), "y": y[a:b].tobytes(), "ids": ids[a:b].tobytes(), "edges": data.edges.tobytes(),
                          "fold": fold[a:b].tobytes() if role and fold is not None else None}
                yield pa.RecordBatch.from_pylist([cell | report | values], packed_schema)

    packed = keep(both.groupBy(*cell_by).applyInArrow(pack, f"{keys}, {PACKED}"), "packed-rows")
    dealt = packed.withColumn("unit", F.explode(F.sequence(F.lit(0), F.col("units") - 1))).withColumn("ids", F.when((F.col("unit") == 0) & (~F.col("train") | F.lit(score_train)), F.col("ids")))

    def boosted(shared: dict, rows: list[dict], codes: list[np.ndarray], data: T.Binned, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        how, rounds = kind.boosting, kind.boosting.rounds
        if kind.folds:
            fold = np.concatenate([np.frombuffer(r["fold"], np.uint8) for r in rows if r["train"]])
            rounds = T.best_rounds(data, y, fold, how, kind.patience)
        base, nodes, roots, own = T.boost_and_score(data, y, rounds, how)
        nodes["cut"] = T.code_cuts(nodes, data.edges)
        yield pa.RecordBatch.from_pylist([shared | {"weight": 1.0, "best_rounds": rounds}], forest_schema)
        for r, c in zip(rows, codes):
            if r["train"]:
                a = r["chunk"] * CHUNK_ROWS
                scores = own[a : a + CHUNK_ROWS]
            else:
                c, group = T.alike(c, data.bins)
                scores = T.leaf_sums(nodes, roots, np.ascontiguousarray(c.T), base, data.bins - 1)[group]
            if score_train or not r["train"]:
                yield pa.RecordBatch.from_pylist([shared | {"train": r["train"], "chunk": r["chunk"], "scores": scores.tobytes(), "weight": 1.0, "ids": r["ids"], "y": r["y"]}], forest_schema)

    def grow(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, unit = dict(zip(by, (k.as_py() for k in key))), key[-1].as_py()
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (not r["train"], r["chunk"]))
        first = rows[0]
        shared = cell | {"unit": unit, "units": first["units"], "n_train": first["n_train"], "y_min": first["y_min"], "y_max": first["y_max"], "error": first["error"], "train": True, "chunk": -1}
        if first["error"] is not None:
            yield pa.RecordBatch.from_pylist([shared], forest_schema)
            return
        y = np.concatenate([np.frombuffer(r["y"]) for r in rows if r["train"]])
        codes = [np.frombuffer(r["codes"], np.uint8).reshape(-1, len(r["y"]) // 8) for r in rows]
        edges = np.frombuffer(first["edges"]).reshape(len(codes[0]), -1)
        data = T.Binned(np.concatenate([c for c, r in zip(codes, rows) if r["train"]], axis=1), edges, edges.shape[1] + 2)
        if kind.boosting:
            yield from boosted(shared, rows, codes, data, y)
            return
        grouped = T.Grouped.of(data, y)
        scored = [(r, *T.alike(c, data.bins)) for r, c in zip(rows, codes) if score_train or not r["train"]]
        scored = [(r, np.ascontiguousarray(c.T), group, np.zeros(c.shape[1])) for r, c, group in scored]
        own, cell_seed = np.arange(unit, kind.trees, first["units"]), _seed(key, [*by, "unit"], seed)
        batch, leaf_rows, place = max(1, UNIT_PLACEMENTS // grouped.data.codes.shape[1]), 0.0, T.mixed(np.arange(len(y), dtype=np.uint64))
        weights = None if kind.random else lambda tree: T.bootstrap_weights(place, np.array([tree]), cell_seed)[0]
        for a in range(0, len(own), batch):
            trees = own[a : a + batch]
            nodes = grouped.grow(weights, trees, kind.min_leaf, kind.depth, cell_seed * 1009 + int(trees[0]), kind.random)
            leaf_rows += float(nodes["count"][nodes["feature"] < 0].sum())
            nodes["cut"] = T.code_cuts(nodes, edges)
            for _, c, _, total in scored:
                total += T.leaf_values(nodes, np.arange(len(trees)), c).sum(axis=0)
        yield pa.RecordBatch.from_pylist([shared | {"weight": float(len(own)), "leaf_rows": leaf_rows}], forest_schema)
        for r, _, group, total in scored:
            own_rows = {"train": r["train"], "chunk": r["chunk"], "scores": total[group].tobytes(), "weight": float(len(own)), "ids": r["ids"], "y": r["y"] if r["ids"] is not None else None}
            yield pa.RecordBatch.from_pylist([shared | own_rows], forest_schema)

    names = [*by, "unit"]
    parts = _spread(dealt, names).groupBy(*names).applyInArrow(grow, f"{keys}, {FOREST}")
    return Forests(keep(parts, "forest-sums"), by, kind)


@dataclass(frozen=True)
class Stack:
    """Folds of a stack's base models; the task that holds a cell deals them, so no row is repeated for them."""

    seed: int
    folds: int
    stratified: bool

    def digest(self) -> Column:
        return short_digest(seed_hash(self.seed, "k", F.col("row_id")))

    def folds_of(self, ids: np.ndarray, y: np.ndarray, digest: np.ndarray) -> np.ndarray:
        """Fold of each row: contiguous shares of the permutation, with ``stratified`` of each class."""
        fold = np.zeros(len(ids), np.int16)
        for label in np.unique(y) if self.stratified else [None]:
            own = np.arange(len(ids)) if label is None else np.flatnonzero(y == label)
            own = own[np.lexsort((ids[own], digest[own]))]
            for k, rows in enumerate(np.array_split(own, min(self.folds, len(own)))):
                fold[rows] = k
        return fold


def part_cells(train: DataFrame, test: DataFrame, by: Sequence[str], kind: Kind, seed: int, stack: Stack) -> DataFrame:
    """``by, part, row_id, label, y_pred, error``: what models of every fold say of the rows held out, and that of all rows (``part`` -1) of the test rows.

    A cell's rows come once and its models are fitted one after the other where they
    are. A part that cannot be fitted has one row, with its error.
    """
    by = list(by)
    columns = ["row_id", F.xxhash64("row_id").alias("_hash"), stack.digest().alias("_digest"), F.col("label").cast("double").alias("label"), "features"]
    both = train.select(*by, *columns, F.lit(True).alias("_train")).unionByName(test.select(*by, *columns, F.lit(False).alias("_train")))
    schema = f"{_ddl(train, by)}, part int, row_id long, label double, y_pred double, error string"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def fit(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, own = _gathered(batches, ["row_id", "_hash", "_digest", "label", "_train"])
        ids, y, known = own["row_id"], own["label"], np.flatnonzero(own["_train"])
        known = known[np.lexsort((ids[known], own["_hash"][known]))]
        if not len(known):
            return
        fold, tests = stack.folds_of(ids[known], y[known], own["_digest"][known]), np.flatnonzero(~own["_train"])
        for part in range(-1, int(fold.max()) + 1):
            rows, scored = (known, tests) if part < 0 else (known[fold != part], known[fold == part])
            if not len(rows):
                continue
            part_key, part_x, part_y, error = (*key, pa.scalar(part, pa.int32())), x[rows], y[rows], None
            try:
                _fittable(kind, part_x, part_y)
                model = kind.fit(part_x, part_y, own["_hash"][rows].view(np.uint64), _seed(part_key, [*by, "part"], seed), 0, 1)
            except (ValueError, np.linalg.LinAlgError) as e:  # becomes the cell's error
                error = str(e)
            del part_x
            if error is not None:
                yield pa.RecordBatch.from_pylist([dict(zip([*by, "part"], (k.as_py() for k in part_key))) | {"error": error}], arrow)
                continue
            for a in range(0, len(scored), BLOCK_ROWS):
                some = scored[a : a + BLOCK_ROWS]
                value = kind.score(model, x[some]) / model.weight
                value = S.sigmoid(value) if kind.link else value
                keys = [pa.repeat(k, len(some)) for k in part_key]
                yield pa.record_batch([*keys, pa.array(ids[some]), pa.array(y[some]), pa.array(value), pa.nulls(len(some), pa.string())], schema=arrow)

    return _spread(both, by).groupBy(*by).applyInArrow(fit, schema)


def stack_cells(train: DataFrame, test: DataFrame, by: Sequence[str], name: str, seed: int = 0, folds: int = 5,
                keep_models: Callable[[DataFrame, str], DataFrame] = lambda df, name: df, bases: dict[str, Kind] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stacks of all cells: test predictions, the combining weights, and the errors of failed cells.

    Each base is fitted once per fold and once on all rows, by tasks that get the rows of
    a cell once. Regression combines out-of-fold predictions by non-negative least
    squares with an intercept, classification by a logistic regression (C = 1).
    ``keep_models`` may write what the bases say of the rows, which is read twice.
    """
    by = list(by)
    bases = BASES[name] if bases is None else bases
    classifier = name.endswith("_classifier")
    dealt = Stack(seed, folds, classifier)
    scored, errors = None, None
    for base, kind in bases.items():
        if kind.packed:
            forests = forest_cells(train, test, by, kind, seed, keep=lambda df, label: keep_models(df, f"{base}-{label}"), stack=dealt)
            found, models = forests.predictions(), forests.reports()
        else:
            models = keep_models(part_cells(train, test, by, kind, seed, dealt), base)
            found = models.where(F.col("error").isNull())
        own = found.select(*by, "part", "row_id", "label", "y_pred", F.lit(base).alias("base"))
        bad = models.where(F.col("error").isNotNull()).select(*by, F.concat(F.lit(f"{base}: "), F.col("error")).alias("error"))
        scored = own if scored is None else scored.unionByName(own)
        errors = bad if errors is None else errors.unionByName(bad)
    errors = errors.groupBy(*by).agg(F.min("error").alias("error"))
    columns = [F.max(F.when(F.col("base") == b, F.col("y_pred"))).alias(b) for b in bases]
    wide = scored.groupBy(*by, "part", "row_id").agg(F.first("label").alias("label"), *columns).join(errors, by, "left_anti")
    wide = keep_models(wide.withColumn("features", F.array(*bases)), "scores")
    oof, final = wide.where(F.col("part") >= 0), wide.where(F.col("part") < 0)
    if classifier:
        kind = _logistic(1.0, 0.0)
        meta = fit_cells(oof, by, kind, seed)
        return predict_cells(meta, final, by, kind), _weights_of(meta, by), errors
    names = list(bases)
    pairs = [(a, b) for i, a in enumerate([*names, "label"]) for b in [*names, "label"][i:]]
    moments = oof.groupBy(*by).agg(*[F.avg(c).alias(f"m_{c}") for c in [*names, "label"]], *[F.covar_pop(a, b).alias(f"c_{a}_{b}") for a, b in pairs])

    def solve(batches):
        for batch in batches:
            weights, starts = [], []
            for r in batch.to_pylist():
                xx = np.array([[r[f"c_{min(a, b, key=names.index)}_{max(a, b, key=names.index)}"] for b in names] for a in names])
                w = nonnegative_weights(xx, np.array([r[f"c_{a}_label"] for a in names]))
                weights.append(w.tolist())
                starts.append(r["m_label"] - float(sum(v * r[f"m_{c}"] for v, c in zip(w, names))))
            keys = [batch.column(i) for i in range(len(by))]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(starts, pa.float64()), pa.array(weights, pa.list_(pa.float64()))], names=[*by, "intercept", "weights"])

    meta = moments.mapInArrow(solve, f"{_ddl(moments, by)}, intercept double, weights array<double>")
    value = F.col("intercept") + F.aggregate(F.zip_with("features", "weights", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return final.join(meta, by).select(*by, "row_id", "label", value.alias("y_pred")), meta, errors


def _weights_of(models: DataFrame, by: Sequence[str]) -> DataFrame:
    """Intercept and coefficients of linear models as columns."""
    def read(batches):
        for batch in batches:
            bodies = [np.frombuffer(b, np.float64) if b is not None else np.zeros(1) for b in batch.column(len(by)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(by))], pa.array([float(b[0]) for b in bodies]), pa.array([b[1:].tolist() for b in bodies], pa.list_(pa.float64()))],
                                             names=[*by, "intercept", "weights"])

    return models.select(*by, "body").mapInArrow(read, f"{_ddl(models, by)}, intercept double, weights array<double>")
