"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL.

Words are runs of letters and digits or runs of marks; a word that equals the one
before it is written as a back reference, so that repetition is a feature whatever
the word. Single words, pairs and the shapes of triples are hashed into a fixed number of
weights. A text's score is a sparse dot product of its n-gram shares with the
weights. Training follows the regularised leader on a bounded sample of labelled
texts; scoring reads every text where it is scanned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from tidemark.llm.tables import apart
from tidemark.llm.text import _BYTE, _GAP, mix, slices, span_hash, utf8, window_hash

_MARK = np.ones(256, bool)
_MARK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 256)]] = False
_KIND = np.where(_GAP, 0, np.where(_MARK, 2, 1)).astype(np.uint8)
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
BACK = np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    scale: float = 30.0  # of n-gram shares, so that a step moves the score
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    epochs: int = 3
    max_train_rows: int = 4096


def ngrams(raw: np.ndarray, bounds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all n-grams of a slice, ordered by text, and each text's offsets."""
    kind = _KIND[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[bounds] = True
    new = edge[:-1].copy()
    new[1:] |= kind[1:] != kind[:-1]
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(raw))
    solid = kind[start] > 0
    start, end = start[solid], end[solid]
    off = np.searchsorted(start, bounds)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(off))
    words = span_hash(_BYTE[raw], start, end)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    words[same] = BACK
    # Shape: what kind of run, whether it begins and goes on in capitals; marks keep their text.
    first, second = _UPPER[raw[start]], _UPPER[raw[np.minimum(start + 1, end - 1)]]
    shape = mix((first * np.uint64(2) + second * np.uint64(1) + np.uint64(7)).astype(np.uint64))
    marks = (kind[start] == 2) | same
    shape[marks] = words[marks]
    shift = np.uint64(64 - bits)
    found, owner = [words >> shift], [doc]
    for values, n, salt in ((words, 2, 1), (shape, 3, 2)):
        if len(values) >= n:
            inside = doc[n - 1 :] == doc[: len(doc) - n + 1]
            found.append(mix(window_hash(values, n)[inside] + np.uint64(salt)) >> shift)
            owner.append(doc[: len(doc) - n + 1][inside])
    slot, text = np.concatenate(found).astype(np.int64), np.concatenate(owner)
    order = np.argsort(text, kind="stable")
    return slot[order], np.searchsorted(text[order], np.arange(len(bounds)))


def train(texts: pa.Array, labels: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias after ``epochs`` passes in the given order."""
    examples = []
    for part in slices(iter([pa.RecordBatch.from_arrays([texts, pa.array(labels)], names=["text", "y"])])):
        slot, off = ngrams(*utf8(part.column(0)), s.bits)
        for a, b, y in zip(off[:-1].tolist(), off[1:].tolist(), part.column(1).to_pylist()):
            at, count = np.unique(slot[a:b], return_counts=True)
            examples.append((at.astype(np.int32), (count * (s.scale / max(1, b - a))).astype(np.float32), float(y)))
    z, n = np.zeros(1 << s.bits), np.zeros(1 << s.bits)
    zb = nb = 0.0

    def weight(z, n):
        return np.where(np.abs(z) <= s.l1, 0.0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))

    for _ in range(s.epochs):
        for at, x, y in examples:
            w = weight(z[at], n[at])
            bias = -zb / ((s.beta + np.sqrt(nb)) / s.alpha)
            g = 1.0 / (1.0 + np.exp(-np.clip(w @ x + bias, -35, 35))) - y
            gx, m = g * x, n[at]
            z[at] += gx - (np.sqrt(m + gx * gx) - np.sqrt(m)) / s.alpha * w
            n[at] = m + gx * gx
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / s.alpha * bias
            nb += g * g
    return weight(z, n).astype(np.float32), float(-zb / ((s.beta + np.sqrt(nb)) / s.alpha))


def scores(col: pa.Array, weights: np.ndarray, bias: float, s: Settings) -> np.ndarray:
    slot, off = ngrams(*utf8(col), s.bits)
    sums = np.zeros(len(slot) + 1)
    np.cumsum(weights[slot], out=sums[1:])
    dots = (sums[off[1:]] - sums[off[:-1]]) * s.scale / np.maximum(1, np.diff(off))
    return 1.0 / (1.0 + np.exp(-np.clip(dots + bias, -35, 35)))


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text modulo 5; 0 is the held-out fold. A missing id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> tuple[bytes, float]:
    """Weights (32-bit floats) and bias from labelled rows outside the held-out fold.

    The sample is bounded: the ``max_train_rows`` labelled ids with the smallest
    hashes, one text for each. Of several labels of an id the larger counts. One
    task trains; with no labelled row the model scores 0.5 throughout.
    """
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.where(remainder(F.col("doc_id")) != 0).withColumn("h", F.xxhash64("doc_id"))
    chosen = chosen.orderBy("h", "doc_id").limit(s.max_train_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # max_train_rows ids
    sample = texts.groupBy("doc_id", "h", "quality").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if rows:
            t = pa.Table.from_batches(rows).combine_chunks()
            w, b = train(t.column("text").combine_chunks(), t.column("quality").to_numpy(), s)
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([b])], names=["w", "b"])

    ordered = sample.repartition(1).sortWithinPartitions("h", "doc_id")
    found = ordered.select("text", "quality").mapInArrow(run, "w binary, b double").collect()  # one row
    return (bytes(found[0].w), found[0].b) if found else (np.zeros(1 << s.bits, np.float32).tobytes(), 0.0)


def score_quality(docs: DataFrame, model: tuple[bytes, float], s: Settings = Settings()) -> DataFrame:
    """``docs`` with the score in a column ``_score``: how likely the text has label 1.

    NULL counts as the empty text, which gets the score of the bias. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.frombuffer(shared.value[0], np.float32)
        for part in slices(batches):
            at = part.schema.get_field_index("text")
            found = scores(part.column(at), weights, shared.value[1], s)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found)], names=[*part.schema.names, "_score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("_score", DoubleType()))


def quality_report(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Repeated rows get one score each, NULL ids are passed through and count as held
    out. Other columns are not read.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score_quality(read, fit(docs, labels, s), s)
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), threshold: float = 0.3, training: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with their columns.

    The labelled texts come from ``training``, by default ``docs`` itself.
    """
    plain, (text,) = apart(docs, "text")
    scored = score_quality(plain.withColumnRenamed(text, "text"), fit(docs if training is None else training, labels, s), s)
    return scored.where(F.col("_score") >= threshold).drop("_score").toDF(*docs.columns)
