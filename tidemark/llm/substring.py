"""Substring dedup: words covered by a long window that starts in an earlier document.

Every window of ``length`` words is filed under its anchor, the smallest hash among
the shorter word runs inside it, so equal windows have the same anchor wherever they
stand. Neighbouring windows of one anchor form a segment. Anchors found in a single
document need no further look. For the others, equal segments are interned: only
the earliest document's copy is a reference, and the copies of later documents are
covered whole. Where an anchor has several different segments, they are the
reference shard of that anchor: they are streamed in document order through a suffix
automaton of those before them, and the matching statistics tell the windows that
occur there. Shards of very common anchors are split by window instead, each window
its own key.

Texts move only for documents that share something, kept apart by a bitmap of fixed
size before the join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.sieve import sieve
from tidemark.llm.tables import apart, discard, stored
from tidemark.llm.text import Words, slices, span_hash, window_hash

LENGTH = 50
RUN = 16
#: Segments that one automaton meets at most: some 100 MB and a second of work where
#: all of them differ. Shards above it are split by window.
SHARD = 4096


class SuffixAutomaton:
    """All substrings of the sequences added so far."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.long, self.last, self.breaks = [-1], [0], 0, 0

    def _extend(self, x: int) -> None:
        new, p = len(self.next), self.last
        self.next.append({})
        self.long.append(self.long[p] + 1)
        self.link.append(0)
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][x]
            if self.long[q] == self.long[p] + 1:
                self.link[new] = q
            else:
                twin = len(self.next)
                self.next.append(dict(self.next[q]))
                self.long.append(self.long[p] + 1)
                self.link.append(self.link[q])
                while p >= 0 and self.next[p].get(x) == q:
                    self.next[p][x] = twin
                    p = self.link[p]
                self.link[q] = self.link[new] = twin
        self.last = new

    def add(self, words: list[int]) -> None:
        """Add a sequence. A symbol that is in no text keeps it apart from the next."""
        for x in words:
            self._extend(x)
        self.breaks += 1
        self._extend(-self.breaks)

    def matches(self, words: list[int]) -> list[int]:
        """For each place, the length of the longest match that ends there."""
        state, size, out = 0, 0, []
        for x in words:
            while state and x not in self.next[state]:
                state = self.link[state]
                size = self.long[state]
            if x in self.next[state]:
                state = self.next[state][x]
                size += 1
            out.append(size)
        return out


def spans(marked: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of marked places as pairs of first and end."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def anchors(w: Words, hashes: np.ndarray, length: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of all windows of a slice, and which windows lie in one text."""
    inside = w.whole(length)[: max(0, len(hashes) - length + 1)]
    low, reach, width = window_hash(hashes, run), 1, length - run + 1
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    rest = width - reach
    return (np.minimum(low[: len(low) - rest], low[rest:]) if rest else low)[: len(inside)], inside


def segments(w: Words, length: int, run: int) -> tuple[np.ndarray, ...]:
    """Document, first window, number of windows, anchor and content hash of every segment."""
    hashes = w.hashes()
    if len(hashes) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    anchor, inside = anchors(w, hashes, length, run)
    doc = w.doc[: len(inside)]
    new = np.ones(len(inside), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(inside)))
    keep = inside[first]
    first, count = first[keep], count[keep]
    content = span_hash(hashes, first, first + count + length - 1)
    return doc[first], first - w.off[doc[first]], count, anchor[first].view(np.int64), content.view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("x"), "text")


def scanned(docs: DataFrame, length: int, run: int) -> tuple[DataFrame, DataFrame]:
    """Per row its number of words and the hash of all of them; and all segments."""
    schema = "doc_id long, x long, n_words long, sha string, first array<int>, count array<int>, anchor array<long>, content array<long>"
    names = [f.split()[0] for f in schema.split(", ")]

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            col = part.column(2)
            w = Words.of(col)
            raw = w.raw.tobytes()
            shas = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist())]
            doc, *found = segments(w, length, run)
            off = pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(off, pa.array(v.astype(t))) for v, t in zip(found, (np.int32, np.int32, np.int64, np.int64))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(w.count.astype(np.int64)), pa.array(shas), *lists], names=names)

    rows = stored(_keyed(docs).mapInArrow(run_, schema), "substring-scan")
    flat = rows.where("doc_id is not null").select("doc_id", "x", F.explode(F.arrays_zip("first", "count", "anchor", "content")).alias("s"))
    return rows.select("doc_id", "x", "n_words", "sha"), flat.select("doc_id", "x", "s.*")


def _words_of(docs: DataFrame, heads: DataFrame, length: int, windows: bool) -> DataFrame:
    """Words of the segments ``heads`` (or the hash of each of their windows)."""
    wanted = heads.groupBy("doc_id", "x").agg(F.collect_list(F.struct("first", "count", "anchor", "content")).alias("want"))
    texts = _keyed(docs).where(sieve(heads, "doc_id", "x")).join(wanted, ["doc_id", "x"]).dropDuplicates(["doc_id", "x"])
    schema = "anchor long, content long, doc_id long, " + ("window long, at int" if windows else "words array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            w = Words.of(part.column(1))
            hashes = w.hashes()
            keys = window_hash(hashes, length).view(np.int64) if windows else None
            out: list[list] = [[], [], [], []]
            at: list[int] = []
            for base, doc_id, want in zip(w.off.tolist(), part.column(0).to_pylist(), part.column(2).to_pylist()):
                for s in want:
                    a = base + s["first"]
                    n = s["count"] if windows else 1
                    for c, v in zip(out, (s["anchor"], s["content"], doc_id)):
                        c += [v] * n
                    if windows:
                        out[3] += keys[a : a + n].tolist()
                        at += range(n)
                    else:
                        out[3].append(hashes[a : a + s["count"] + length - 1].view(np.int64))
            last = [pa.array(out[3], pa.int64()), pa.array(at, pa.int32())] if windows else [pa.array(out[3], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out[:3]] + last, names=[f.split()[0] for f in schema.split(", ")])

    return texts.select("doc_id", "text", "want").mapInArrow(run, schema)


def _through_automata(words: DataFrame, length: int) -> DataFrame:
    """Windows of every segment that occur in segments of its anchor from earlier documents.

    One automaton lives at a time: rows come sorted by anchor and document.
    """
    schema = "anchor long, content long, low int, high int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor = doc = machine = None
        waiting: list[list[int]] = []  # what the present document adds
        for batch in batches:
            out: list[tuple] = []
            for a, content, d, words in zip(*(c.to_pylist() for c in batch.columns)):
                if a != anchor:
                    anchor, doc, machine, waiting = a, d, SuffixAutomaton(), []
                elif d != doc:
                    for w in waiting:
                        machine.add(w)
                    doc, waiting = d, []
                known = np.array(machine.matches(words)[length - 1 :]) >= length
                out += [(a, content, low, high) for low, high in spans(known)]
                waiting += [words[low : high + length - 1] for low, high in spans(~known)]  # the rest is in it
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["anchor", "content", "low", "high"])

    return words.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "content").mapInArrow(run, schema)


def covered_windows(docs: DataFrame, segs: DataFrame, length: int, shard: int) -> DataFrame:
    """``doc_id, x, ranges``: windows that occur in a document with a smaller id."""
    by_anchor = segs.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    common = stored(by_anchor.where("lo < hi").select("anchor"), "substring-anchors")
    cand = stored(segs.where(sieve(common, "anchor")).join(common, "anchor", "left_semi"), "substring-candidates")
    heads = cand.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "x", "first", "count")).alias("h"))
    heads = stored(heads.select("anchor", "content", "h.*"), "substring-heads")
    sizes = heads.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    many = heads.join(sizes.where("n > 1"), "anchor")
    few, most = many.where(F.col("n") <= shard).drop("n"), many.where(F.col("n") > shard).drop("n")
    marks = _through_automata(_words_of(docs, few, length, windows=False), length)
    keyed = stored(_words_of(docs, most, length, windows=True), "substring-windows")
    earliest = keyed.groupBy("anchor", "window").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor", "window", "lo")
    single = keyed.join(earliest, ["anchor", "window"]).where("doc_id > lo").select("anchor", "content", F.col("at").alias("low"), (F.col("at") + 1).alias("high"))
    marks = stored(marks.unionByName(single), "substring-marks")
    first = heads.select("anchor", "content", F.col("doc_id").alias("lo"))
    placed = cand.join(first, ["anchor", "content"])
    whole = placed.where("doc_id > lo").select("doc_id", "x", F.col("first").alias("low"), (F.col("first") + F.col("count")).alias("high"))
    partly = placed.where("doc_id = lo").join(marks, ["anchor", "content"]).select("doc_id", "x", (F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high")).alias("high"))
    found = whole.unionByName(partly)
    ranges = stored(found.groupBy("doc_id", "x").agg(F.collect_set(F.struct("low", "high")).alias("ranges")), "substring-ranges")
    discard(common, cand, heads, keyed, marks)
    return ranges


def _removed(n_words: int, ranges: list, length: int) -> np.ndarray:
    edge = np.zeros(n_words + 1, np.int32)
    for r in ranges:
        edge[r["low"]] += 1
        edge[r["high"] + length - 1] -= 1
    return np.cumsum(edge)[:n_words] > 0


def dedup_substrings(docs: DataFrame, length: int = LENGTH, run: int = RUN, shard: int = SHARD, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256``.

    With ``with_text`` the rows of ``docs`` come back with what is left of their
    texts: as they were where nothing is removed, else the kept words joined by
    single spaces, with ``n_chars`` to match. NULL and empty texts have no words; texts
    below ``length`` words lose none. Rows with one id are judged each for itself
    and never against each other; rows that agree in id and text are treated alike.
    Rows without an id lose nothing and are no reference. Other columns are not read.
    """
    rows, segs = scanned(docs, length, run)
    ranges = covered_windows(docs, segs, length, shard)
    touched = _keyed(docs).where(sieve(ranges, "doc_id", "x")).join(ranges, ["doc_id", "x"])
    schema = "doc_id long, x long, n_removed long, kept string, text string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out: list[tuple] = []
            for doc_id, x, text, found_ in zip(*(c.to_pylist() for c in part.columns)):
                words = text.encode().split()
                gone = _removed(len(words), found_, length)
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                out.append((doc_id, x, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["doc_id", "x", "n_removed", "kept", "text"])

    changed = touched.select("doc_id", "x", "text", "ranges").mapInArrow(cut, schema)
    if with_text:
        changed = changed.dropDuplicates(["doc_id", "x"]).select(F.col("doc_id").alias("_d"), F.col("x").alias("_x"), F.col("text").alias("_kept"))
        plain, (doc_id, text, n_chars) = apart(docs, "doc_id", "text", "n_chars")
        both = plain.withColumns({"_x": F.xxhash64(text), "_d": F.col(doc_id).cast("long")}).join(changed, ["_d", "_x"], "left")
        if n_chars:
            size = F.when(F.col("_kept").isNotNull(), F.length("_kept")).otherwise(F.col(n_chars))
            both = both.withColumn(n_chars, size.cast(docs.schema["n_chars"].dataType))
        return both.withColumn(text, F.coalesce("_kept", text)).select(*plain.columns).toDF(*docs.columns)
    changed = changed.select("doc_id", "x", "n_removed", "kept").dropDuplicates(["doc_id", "x"])
    both = rows.join(changed, ["doc_id", "x"], "left")
    return both.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept", "sha").alias("kept_sha256"))
