"""Near-duplicate detection by ProbMinHash.

Texts are signed once (``probminhash``). Equal bands of registers make buckets of
candidate texts; copies of one text are one candidate. Pairs inside a bucket are not
listed. Each bucket names a pivot, the member that shares most with others, and
every member is compared with its pivots only. Members that this joins to the pivot's
class need no more comparison with it, whatever their similarity to each other. For
those left out, distances to the pivot decide: one minus probability Jaccard is a
metric, so two texts whose distances to the pivot differ by more than the limit
cannot be near. What remains is compared in blocks of bounded size, which pass on
only links that join two classes. Signatures only choose; a link is the exact
probability Jaccard of two texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import probminhash as M
from tidemark.llm.groups import components, runs
from tidemark.llm.sieve import sieve
from tidemark.llm.tables import apart, discard, stored
from tidemark.llm.text import Words, slices

SHINGLE = 5
SIMILARITY = 0.8
#: Pairs at the limit share none of 32 bands of 5 registers with probability 3e-6.
BANDS, ROWS = 32, 5
#: The estimate from 160 registers discards a pair at the limit with probability 3e-6.
MARGIN = 0.15
BLOCK = 512


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("k"), "text")


def signed(docs: DataFrame, shingle: int, n_bands: int, rows: int) -> DataFrame:
    """``doc_id, k, bands, registers`` for every row with a word; ``k`` names the text."""
    schema = "doc_id long, k long, bands array<long>, registers binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            w = Words.of(part.column(2))
            winners = M.signatures(*M.shingles(w, shingle), part.num_rows, n_bands * rows)
            keep = np.flatnonzero(w.count)
            band = M.bands(winners, rows)[keep]
            short = (winners[keep] >> np.uint64(48)).astype("<u2")
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * n_bands), pa.array(band.ravel()))
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), lists, pa.array([r.tobytes() for r in short], pa.binary())], names=["doc_id", "k", "bands", "registers"])

    return stored(_keyed(docs).where("text is not null").mapInArrow(run, schema), "near-signatures")


def stars(signs: DataFrame) -> DataFrame:
    """Pairs ``k, p`` of a text and a pivot that it shares a bucket with."""
    flat = signs.select("k", F.explode("bands").alias("band"))
    shared = flat.groupBy("band").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo < hi")
    shared = stored(shared.select("band"), "near-bands")
    members = stored(flat.where(sieve(shared, "band")).join(shared, "band", "left_semi").distinct(), "near-members")
    size = members.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    weight = stored(members.join(size, "band").groupBy("k").agg(F.sum("n").alias("weight")), "near-weights")
    pivots = members.join(weight, "k").groupBy("band").agg(F.max(F.struct("weight", "k")).alias("p")).select("band", F.col("p.k").alias("p"))
    found = stored(members.join(pivots, "band").where("k <> p").select("k", "p").distinct(), "near-stars")
    discard(shared, members, weight)
    return found


def estimated(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """``k, p, est, registers``: share of registers in which both agree, and those of ``k``."""
    one = signs.groupBy("k").agg(F.min("registers").alias("registers"))
    both = pairs.join(one, "k").join(one.select(F.col("k").alias("p"), F.col("registers").alias("q")), "p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            a, q = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(b.num_rows, -1) for c in (2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((a == q).mean(axis=1)), b.column(2)], names=["k", "p", "est", "registers"])

    return both.select("k", "p", "registers", "q").mapInArrow(run, "k long, p long, est double, registers binary")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Those of ``pairs(k, p)`` whose exact probability Jaccard is ``least`` or more."""
    both = pairs.join(texts, "k").join(texts.select(F.col("k").alias("p"), F.col("text").alias("other")), "p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            known: dict[int, int] = {}
            column = part.column(2).to_pylist()
            others = []
            for p, t in zip(part.column(1).to_pylist(), part.column(3).to_pylist()):
                if p not in known:
                    known[p] = len(column) + len(others)
                    others.append(t)
            w = Words.of(pa.array(column + others, pa.string()))
            doc, item, weight = M.shingles(w, shingle)
            off = np.searchsorted(doc, np.arange(len(w.count) + 1)).tolist()
            own = lambda d: (item[off[d] : off[d + 1]], weight[off[d] : off[d + 1]])
            near = [M.probability_jaccard(*own(d), *own(known[p])) >= least for d, p in enumerate(part.column(1).to_pylist())]
            yield part.select(["k", "p"]).filter(pa.array(near, pa.bool_()))

    return both.select("k", "p", "text", "other").mapInArrow(run, "k long, p long")


def _blocks(star: DataFrame, *payload: str) -> DataFrame:
    """Rows of each pivot dealt to blocks of bounded size, all pairs with one that asks.

    ``star``: ``k, p, est, registers, root, asks`` and the payload. Members that ask
    meet all members of their pivot; pivots without an asking pair are left out.
    """
    sizes = star.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("asks").cast("int")).alias("u")).where("n > 1 and u > 0")
    sizes = sizes.select("p", F.ceil(F.col("n") / BLOCK).alias("nb"), F.ceil(F.col("u") / BLOCK).alias("ub"))
    s = star.join(sizes, "p").withColumn("own", F.pmod(F.xxhash64("k"), F.col("nb"))).withColumn("of", F.pmod(F.xxhash64("k"), F.col("ub")))
    names = ["k", "p", "est", "registers", "root", "asks", *payload]
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    refs = s.select(*names, F.lit(False).alias("turn"), every("ub").alias("i"), F.col("own").alias("j"))
    asks = s.where("asks").select(*names, F.lit(True).alias("turn"), F.col("of").alias("i"), every("nb").alias("j"))
    rows = refs.unionByName(asks).withColumn("g", F.xxhash64("p", "i", "j"))
    return rows.repartition("g").sortWithinPartitions("g", "turn", "k")


def _partners(t: pa.Table, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each asking row of a block, the rows of other classes that may be near it."""
    k, p, i, j, est, root = (t.column(c).to_numpy() for c in ("k", "p", "i", "j", "est", "root"))
    asks, turn = (t.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "turn"))
    regs = np.frombuffer(b"".join(t.column("registers").to_pylist()), "<u2").reshape(len(k), -1)
    window = 1 - least + 2 * MARGIN  # of estimated distances to the pivot
    b = np.flatnonzero(~turn)
    for q in np.flatnonzero(turn):
        # Of two that ask, the one with the smaller key does.
        c = b[(np.abs(est[b] - est[q]) <= window) & (root[b] != root[q]) & (~asks[b] | (k[b] > k[q])) & (p[b] == p[q]) & (i[b] == i[q]) & (j[b] == j[q])]
        c = c[(regs[c] == regs[q]).mean(axis=1) >= least - MARGIN]
        if len(c):
            yield q, c


def unresolved(star: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Links ``k, p`` between members of a pivot that are in different classes so far.

    A first pass over signatures names the members with a possible partner; only
    their texts are dealt to blocks, where pairs are checked exactly. A block passes
    on the links that join classes, at most one for each of its rows.
    """
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "g"):
            hit = np.zeros(t.num_rows, bool)
            for q, c in _partners(t, least):
                hit[q] = True
                hit[c] = True
            yield from t.filter(pa.array(hit)).select(["k", "p"]).to_batches()

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "g"):
            found: list[tuple[int, int]] = []
            k, root = t.column("k").to_numpy(), t.column("root").to_numpy().copy()
            sets: dict[int, tuple] = {}

            def items(row: int) -> tuple[np.ndarray, np.ndarray]:
                if row not in sets:
                    sets[row] = M.shingles(Words.of(pa.array([t.column("text")[row].as_py()], pa.string())), shingle)[1:]
                return sets[row]

            for q, c in _partners(t, least):
                for row in c.tolist():
                    if root[row] != root[q] and M.probability_jaccard(*items(q), *items(row)) >= least:
                        found.append((k[q], k[row]))
                        root[root == root[row]] = root[q]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["k", "p"])

    need = stored(_blocks(star).mapInArrow(mark, "k long, p long").distinct(), "near-open")
    small = star.join(need, ["k", "p"]).join(texts, "k")
    links = stored(_blocks(small, "text").mapInArrow(link, "k long, p long"), "near-links")
    discard(need)
    return links


def near_classes(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, k, root, class_id, class_rows`` for every row of ``docs``.

    Rows are in one class if a chain of texts with a probability Jaccard of
    ``least`` or more joins them; ``class_id`` is its smallest id. ``k`` hashes the
    text, ``root`` names the class. A row whose text is NULL or has no word is a class of its own. Repeated
    rows are members of one class. NULL ids are passed through and name no class.
    Other columns are not read.
    """
    signs = signed(docs, shingle, n_bands, rows)
    pairs = stars(signs)
    inside = stored(pairs.select("k").unionByName(pairs.select(F.col("p").alias("k"))).distinct(), "near-inside")
    texts = _keyed(docs).where(sieve(inside, "k")).select("k", "text").join(inside, "k", "left_semi").dropDuplicates(["k"])
    texts = stored(texts, "near-texts")
    own = signs.select("k", "registers").where(sieve(inside, "k"))
    est = stored(estimated(pairs, own), "near-estimates")
    first = stored(verified(est.where(F.col("est") >= least - MARGIN).select("k", "p"), texts, shingle, least), "near-links")
    roots = components(first.select(F.col("k").alias("a"), F.col("p").alias("b")))
    of_k = roots.withColumnRenamed("node", "k")
    of_p = roots.select(F.col("node").alias("p"), F.col("root").alias("_r"))
    star = est.join(of_k, "k", "left").join(of_p, "p", "left").withColumn("root", F.coalesce("root", "k"))
    star = star.withColumn("asks", F.col("root") != F.coalesce("_r", "p")).drop("_r")
    second = unresolved(star, texts, shingle, least)
    if not second.isEmpty():
        all_links = first.unionByName(second)
        whole = components(all_links.select(F.col("k").alias("a"), F.col("p").alias("b")))
        discard(roots)
        roots = whole
    named = signs.select("doc_id", "k").join(roots.withColumnRenamed("node", "k"), "k", "left").select("doc_id", "k", F.coalesce("root", "k").alias("root"))
    named = stored(named, "near-roots")
    discard(signs, pairs, inside, texts, est, first, second, roots)
    classes = named.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_rows"))
    out = named.join(classes, "root").select("doc_id", "k", "root", "class_id", "class_rows")
    rest = _keyed(docs).where(~_has_word(F.col("text"))).select("doc_id", "k", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_rows"))
    return out.unionByName(rest)


def _has_word(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row of each class, that of the smallest id, with the columns of ``docs``.

    Of rows that repeat this id and text one stays, of different texts under it that
    of the smallest hash. Rows without words and rows without an id all stay.
    """
    found = near_classes(docs, **options).where("root is not null and doc_id = class_id")
    same = found.groupBy("root", "doc_id", "k").agg(F.count(F.lit(1)).alias("n"))
    keep = same.groupBy("root").agg(F.min(F.struct("k", "n", "doc_id")).alias("m"))
    keep = stored(keep.select(F.col("m.doc_id").alias("_i"), F.col("m.k").alias("_k"), F.col("m.n").alias("_n")), "near-keep")
    plain, (doc_id, text) = apart(docs, "doc_id", "text")
    marked = plain.withColumns({"_x": F.xxhash64(text), "_d": F.col(doc_id).cast("long")})
    judged = _has_word(F.col(text)) & F.col("_d").isNotNull()
    kept = marked.where(judged).join(keep, (F.col("_d") == F.col("_i")) & (F.col("_x") == F.col("_k")))
    kept = kept.where("_n = 1").unionByName(kept.where("_n > 1").dropDuplicates(["_d", "_x"]))
    return kept.select(*plain.columns).unionByName(marked.where(~judged).select(*plain.columns)).toDF(*docs.columns)
