"""What each filter of a set removes, in every order in which they could run.

Tasks turn each document into a bit mask of the filters that it fails. Documents of
a part (a language) that agree in their mask are one cell, so a part is at most
``2 ** filters`` numbers. A Gray code visits all subsets of filters, switching one
filter on or off at a time: every cell keeps the number of active filters that it
fails, and a cell enters or leaves the survivors when that number turns to or from
zero. The survivors of all subsets are stored; a step of an order is the difference
between two of them.

Copies are found without a join on the text: the smallest id of each text is an
aggregate, and a document meets it by (text, id), a key that no two documents share.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import WORD, null_safe, words_in

MOST_FILTERS = 7  # all orders are listed
COPY = "E"
REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_filters(text: Column, min_words: int = 100, distinct_percent: int = 80, capital_percent: int = 10, symbols: str = "#$%&*|") -> dict[str, Column]:
    """Failure conditions on a text by letter: A short, B repetitive, C capitals, D symbols."""
    words = words_in(text)
    distinct = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return {
        "A": words < min_words,
        "B": F.lit(100) * distinct < distinct_percent * words,
        "C": F.lit(100) * capitals > capital_percent * F.length(text),
        "D": F.length(F.translate(text, symbols, "")) < F.length(text),
    }


def fail_masks(docs: DataFrame, labels: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """``part, mask, good, toxic, n``: documents by the filters they fail, copies (``E``) included.

    Bit k of ``mask`` is the k-th filter in order of the letters. Texts are read once;
    what is shuffled is a digest, an id and a byte for each distinct (text, id).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    letters = sorted([*filters, COPY])
    bits = sum((F.when(f, 1 << letters.index(k)).otherwise(0) for k, f in filters.items()), F.lit(0))
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("doc_id").alias("id"),
                       F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("h"), bits.alias("mask"))
    entries = rows.groupBy("h", "id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    # NULL ids come after all others, and are no copies of each other.
    firsts = entries.groupBy("h").agg(F.min("id").alias("first")).select("h", null_safe(F.col("first")).alias("key"), F.lit(True).alias("is_first"))
    seen = entries.withColumn("key", null_safe(F.col("id"))).join(firsts, ["h", "key"], "left")
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marked = seen.join(marks, "id", "left")
    copy = F.when(F.col("is_first"), 0).otherwise(1 << letters.index(COPY))
    weigh = [F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")]
    return marked.groupBy("part", (F.col("mask") + copy).cast("int").alias("mask")).agg(*weigh, F.sum("n").alias("n"))


def walk(masks: np.ndarray, weights: np.ndarray, n_filters: int) -> np.ndarray:
    """Weights of the cells that pass, for every subset of active filters.

    ``weights`` has a row per cell; row ``s`` of the result belongs to the subset with
    the bits ``s``.
    """
    states = np.zeros((1 << n_filters, weights.shape[1]), np.int64)
    failing = np.zeros(len(masks), np.int64)
    running = weights.sum(axis=0)
    states[0] = running
    active = 0
    for i in range(1, 1 << n_filters):
        k = (i & -i).bit_length() - 1  # the bit in which the Gray codes of i - 1 and i differ
        fails = (masks >> k) & 1 == 1
        if active >> k & 1:
            failing[fails] -= 1
            running = running + weights[fails & (failing == 0)].sum(axis=0)
        else:
            running = running - weights[fails & (failing == 0)].sum(axis=0)
            failing[fails] += 1
        active ^= 1 << k
        states[active] = running
    return states


def order_report(part: str, letters: str, states: np.ndarray) -> pd.DataFrame:
    """Rows of all orders of one part from its stored states ``(documents, good, toxic)``."""
    full = len(states) - 1
    fails = {k: states[0, 0] - states[1 << b, 0] for b, k in enumerate(letters)}
    alone = {k: states[full ^ (1 << b), 0] - states[full, 0] for b, k in enumerate(letters)}
    shapley = dict.fromkeys(letters, 0)
    rows = []
    for order in permutations(letters):
        active = 0
        for step, k in enumerate(order, 1):
            now = active | 1 << letters.index(k)
            lost = states[active] - states[now]
            shapley[k] += lost[0]
            rows.append((part, "".join(order), step, states[now, 0], lost[0], fails[k] - lost[0], alone[k], lost[1], lost[2], k))
            active = now
    out = pd.DataFrame(rows, columns=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "k"])
    out["shapley"] = out.pop("k").map(shapley)
    return out


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None) -> DataFrame:
    """How filters act together: one row per part, order of the filters and step.

    ``docs`` needs ``doc_id, text, lang``; ``labels`` ``doc_id, quality, toxic``. Filters
    are conditions of failure by letter (those of ``text_filters`` unless given); ``E``
    is added: a text identical to that of a smaller id. Part and counts are described
    by ``REPORT``: ``kept`` after the step, ``removed`` in it, ``redundant`` failing the
    step's filter but removed before, ``unique_fails`` failing that filter only,
    ``good_lost`` and ``toxic_lost`` among the removed, ``shapley`` the filter's removed
    summed over all orders.

    NULL texts count as empty and NULL languages as the part ''. An empty text fails A
    only (and E if it is a copy). Rows that share id and text are copies of nobody, rows
    of NULL id are copies where an id has their text. A condition that is NULL does not
    fail. A document is good or toxic if any of its labels says so; labels of NULL id or
    NULL value say nothing. Other columns are not read. No documents, no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    filters = text_filters(text) if filters is None else filters
    letters = "".join(sorted([*filters, COPY]))
    if COPY in filters or len(letters) > MOST_FILTERS or any(len(k) != 1 for k in filters):
        raise ValueError(f"filters are single letters other than {COPY}, {MOST_FILTERS - 1} at most")

    def report(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        states = walk(cells["mask"].to_numpy(np.int64), cells[["n", "good", "toxic"]].to_numpy(np.int64), len(letters))
        return order_report(key[0], letters, states)

    return fail_masks(docs, labels, filters).groupBy("part").applyInPandas(report, REPORT)
