"""Quality rules on repetition: how much of a text lies in n-grams and lines seen before.

Rolling hashes give every n-gram of a slice of documents at once. An n-gram counts
as repeated when the same one starts earlier in its text; what it covers is
measured in characters of words, each character once per length n. Lines count the
same way. A text with too large a share is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.text import Words, byte_table, covered, mix, repeats, slices, span_hash, totals, window_hash
from tidemark.llm.text import _BYTE

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """Largest shares, in percent of the characters of words."""

    grams: dict[int, int] = field(default_factory=lambda: {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10})
    lines: int = 20
    min_words: int = 50
    repeat_window: int = 3
    repeat_words: int = 50


def schema(limits: Limits) -> str:
    grams = "".join(f", chars_in_{n}grams long" for n in limits.grams)
    return f"doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars_in_lines long{grams}, base_failed boolean, kept boolean"


def measure(col: pa.Array, limits: Limits) -> dict[str, np.ndarray]:
    """The counts and verdicts of the texts of a column."""
    w = Words.of(col)
    hashes, n_words = w.hashes(), len(w.start)
    salt = mix(w.doc.astype(np.uint64) + np.uint64(1))
    solid_chars = np.zeros(len(w.raw) + 1, np.int64)
    np.cumsum(w.solid & ((w.raw & 0xC0) != 0x80), out=solid_chars[1:])
    word_chars = solid_chars[w.end] - solid_chars[w.start]
    out = {"n_words": w.count.astype(np.int64), "word_chars": totals(word_chars, w.off), "n_symbols": totals(byte_table(SYMBOLS)[w.raw], w.bounds)}

    def marks(n: int) -> tuple[np.ndarray, np.ndarray]:
        inside = w.whole(n)[: max(0, n_words - n + 1)]
        keys = (window_hash(hashes, n) ^ salt[: len(inside)])[inside]
        shared, later = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
        shared[inside], later[inside] = repeats(mix(keys))
        return shared, later

    shared, _ = marks(limits.repeat_window)
    out["n_repeat_words"] = totals(covered(shared, limits.repeat_window, n_words), w.off)

    breaks = np.flatnonzero(w.raw == 0x0A)
    first = np.union1d(w.bounds[:-1], breaks + 1)
    first = first[first < len(w.raw)]
    last = np.minimum(np.append(first[1:], len(w.raw)), np.append(breaks, len(w.raw))[np.searchsorted(breaks, first)])
    chars = solid_chars[last] - solid_chars[first]
    first, last, chars = first[chars > 0], last[chars > 0], chars[chars > 0]
    line_off = np.searchsorted(first, w.bounds)
    line_doc = np.repeat(np.arange(len(w.count)), np.diff(line_off)).astype(np.uint64)
    _, later = repeats(mix(span_hash(_BYTE[w.raw], first, last) ^ mix(line_doc + np.uint64(1))))
    out["n_dup_lines"] = totals(later, line_off)
    out["chars_in_lines"] = totals(np.where(later, chars, 0), line_off)

    bad = 100 * out["chars_in_lines"] > limits.lines * out["word_chars"]
    for n, share in limits.grams.items():
        _, later = marks(n)
        out[f"chars_in_{n}grams"] = inside = totals(np.where(covered(later, n, n_words), word_chars, 0), w.off)
        bad |= 100 * inside > share * out["word_chars"]
    out["base_failed"] = (w.count < limits.min_words) | (100 * out["n_repeat_words"] > limits.repeat_words * w.count)
    out["kept"] = ~out["base_failed"] & ~bad
    return out


def repetition_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per row of ``docs``: counts, ``base_failed`` and ``kept``.

    NULL and empty texts have no words and fail the base rule. Repeated rows are
    measured alike, NULL ids are passed through. Only ``doc_id`` and ``text`` are
    read. No shuffle: each text is measured where it is scanned.
    """
    names = [f.split()[0] for f in schema(limits).split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = measure(part.column(1), limits)
            yield pa.RecordBatch.from_arrays([part.column(0)] + [pa.array(found[n]) for n in names[1:]], names=names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema(limits))
