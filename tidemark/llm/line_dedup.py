"""Lines that many documents share: exploded, hashed, counted and dropped.

A line's key is the line without white space at its ends and in lower case (A-Z).
Lines are exploded with their positions, keys are hashed to 128 bits of SHA-256, and
documents are counted per hash. A line whose hash is found in enough documents stays
only in the first of them, in the order of ids; what remains of a document is put
together again by position.

Texts move once, to meet the positions they lose. A hash that holds more than
``1 / HOT`` of all lines is joined by broadcast, and there can be at most ``HOT`` such
hashes; so no task of the other join holds more than that share for one key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import apart, discard, null_safe, stored
from tidemark.llm.text import slices

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOT = 1024


def line_key(line: Column) -> Column:
    """The line without space, tab, line and page breaks at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), UPPER, LOWER)


def digest16(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def exploded(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """``row, dkey, id, pos, h`` of every line whose key is long enough to be counted."""
    lines = docs.select(row_key(doc_id, text), null_safe(F.col(doc_id)).alias("dkey"), F.col(doc_id).alias("id"),
                        F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("pos", "line"))
    keyed = lines.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    return keyed.select("row", "dkey", "id", "pos", digest16(F.col("key")).alias("h"))


def row_key(doc_id: str, text: str) -> Column:
    """Rows that agree in id and text lose the same lines and may share a key."""
    return digest16(F.concat(null_safe(F.col(doc_id)), F.lit("\n"), F.coalesce(F.col(text), F.lit("")))).alias("row")


def lost_positions(docs: DataFrame, doc_id: str, text: str, min_chars: int, min_docs: int) -> DataFrame:
    """``row, lost``: the positions of the lines that go, for each row that loses any."""
    lines = stored(exploded(docs, doc_id, text, min_chars), "lines")
    pairs = lines.groupBy("h", "dkey", "id").agg(F.count(F.lit(1)).alias("n"))
    # NULL counts as one document, after all others.
    owners = pairs.groupBy("h").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_lines"), F.min("id").alias("first"))
    owners = stored(owners.where(F.col("n_docs") >= min_docs).select("h", "first", "n_lines"), "line-owners")
    total = lines.count()
    hot = owners.where(F.col("n_lines") * HOT > total).select("h", "first")  # at most HOT rows
    cold = owners.where(F.col("n_lines") * HOT <= total).select("h", "first")
    plain = lines.select("row", "id", "pos", "h")
    found = plain.join(F.broadcast(hot), "h").unionByName(plain.join(F.broadcast(hot.select("h")), "h", "left_anti").join(cold, "h"))
    gone = found.where(~F.col("id").eqNullSafe(F.col("first")))
    lost = stored(gone.groupBy("row").agg(F.collect_set("pos").alias("lost")), "lost-lines")
    discard(lines, owners)
    return lost


def _assemble(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[pa.RecordBatch]:
    """Put the lines that stay together; add ``n_lines`` and ``n_dropped`` for the positions."""
    for part in slices(batches, "text"):
        texts, n_lines, n_dropped = [], [], []
        for text, lost in zip(part.column(text_at).to_pylist(), part.column(part.num_columns - 1)):
            at = np.asarray(lost.values, np.int64) if lost.is_valid else ()
            lines = (text or "").split("\n")
            n_lines.append(len(lines))
            n_dropped.append(len(at))
            if len(at):
                stays = np.ones(len(lines), bool)
                stays[at] = False
                text = "\n".join([lines[k] for k in np.flatnonzero(stays).tolist()])
            texts.append(text)
        cols = [part.column(i) for i in range(part.num_columns - 1)]
        cols[text_at] = pa.array(texts, cols[text_at].type)
        yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                                         names=[*part.schema.names[:-1], "n_lines", "n_dropped"])


def drop_repeated_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` without the lines that at least ``min_docs`` documents share, and how many went.

    Keys of fewer than ``min_chars`` characters are never counted. The first document
    of a line, by ``doc_id``, keeps all its occurrences. Columns of ``docs`` keep their
    names and order; ``n_lines`` (before dropping) and ``n_dropped`` follow, or
    ``n_lines_``, ``n_dropped_`` where ``docs`` has such columns.

    NULL and empty texts are one empty line, which is never dropped; a NULL text stays
    NULL. A text that loses all lines becomes empty. Rows that share an id are one
    document: they count once and lose a line only to a smaller id, so copies under one
    id all keep it. NULL ids together are one document that comes after all others. An
    empty table gives an empty one. A text is held whole in one task, beside its lines.
    """
    plain, (doc_id, text) = apart(docs, "doc_id", "text")
    lost = lost_positions(plain, doc_id, text, min_chars, min_docs)
    keyed = plain.withColumn("row", row_key(doc_id, text)).join(lost, "row", "left")
    rest = [c for c in plain.columns if c != text]
    rows = keyed.select(*rest, F.col(text).alias("text"), "lost")
    schema = ", ".join([*(f"{c} {plain.schema[c].dataType.simpleString()}" for c in rest), "text string, n_lines long, n_dropped long"])
    out = rows.mapInArrow(lambda batches: _assemble(batches, len(rest)), schema)
    names = [n if n not in docs.columns else f"{n}_" for n in ("n_lines", "n_dropped")]
    return out.select(*[F.col("text") if c == text else F.col(c) for c in plain.columns], "n_lines", "n_dropped").toDF(*docs.columns, *names)


def line_report(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of every row of ``docs``."""
    out = drop_repeated_lines(docs.select("doc_id", "text"), min_chars, min_docs)
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped", digest.alias("kept_sha256"))
