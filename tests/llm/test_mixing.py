"""Source mixing against a plain loop."""

import hashlib
import re
from collections import Counter, defaultdict

from tidemark.llm import mixing


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    rest, open_, out = sum(sizes.values()), set(names), {}
    while open_:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > most * sizes[s]}
        if not full:
            return out | share
        for s in full:
            out[s] = most * sizes[s]
            rest -= out[s]
        open_ -= full
    return out


def brute(rows):
    sizes = Counter()
    for i, t, s in rows:
        sizes[s] += len(words(t))
    goal = targets(sizes)
    out = []
    for s in sizes:
        own = sorted({(int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16), "-" if i is None else f"={i}", len(words(t)), i) for i, t, x in rows if x == s})
        copies = Counter((i, len(words(t))) for i, t, x in rows if x == s)
        epochs = int(goal[s] // sizes[s]) if sizes[s] else 0
        left = int(goal[s]) - epochs * sizes[s]
        for _, _, n, i in own:
            for _ in range(copies[i, n]):
                more = n > 0 and 2 * left >= n
                left -= n
                out.append((i, n, sizes[s], round(goal[s], 6), (epochs + more) * n))
    return Counter(out), goal


def corpus():
    rows = [(i, "w " * (i % 40), f"s{i % 5}") for i in range(400)]
    rows += [(1000 + i, "hot word " * 6, "s0") for i in range(300)] + [(2000 + i, "few", "tiny") for i in range(3)]
    rows += [(3000, "copy of it", "s1")] * 40 + [(3001, None, "s1"), (3002, "", None), (None, "no id", None), (None, "no id", None), (3003, "x", None), (3004, None, "only null"), (3005, "Ä", "Zß"), (3006, "é", "zz")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 9) for i, t, s in rows], "doc_id long, text string, source string, size int, target int").repartition(5)


def test_report(spark):
    rows = corpus()
    want, goal = brute(rows)
    for per_slice in (16, 4096):
        got = mixing.mix_report(frame(spark, rows), rows_per_slice=per_slice).collect()
        assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got) == want


def test_documents(spark):
    rows = [(i, t, s) for i, t, s in corpus()]
    docs = frame(spark, rows)
    got = mixing.mix_documents(docs)
    assert got.columns == docs.columns
    have, times = defaultdict(int), Counter()
    for r in got.collect():
        have[r.source] += len(words(r.text))
        times[r.doc_id, r.text, r.source] += 1
    whole = Counter(rows)
    assert set(times) <= set(whole) and all(n <= 3 * whole[k] for k, n in times.items())  # texts are whole
    report = Counter()
    for r in mixing.mix_report(docs).collect():
        report[r.doc_id] += r.taken
    by_id = Counter()
    for (i, t, _), n in times.items():
        by_id[i] += n * len(words(t))
    assert by_id == +report
    _, goal = brute(rows)
    assert all(abs(have[s] - g) <= 40 for s, g in goal.items())


def test_the_cut_falls_between_copies(spark):
    rows = [(7, f"{'ab'[k % 2]} copy of ten words in all and some more", "a") for k in range(1000)] + [(1, "b " * 500, "b"), (2, "c " * 400, "c")]
    want, goal = brute(rows)
    docs = frame(spark, rows)
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.mix_report(docs).collect()) == want
    taken = sum(len(words(r.text)) for r in mixing.mix_documents(docs).where("source = 'a'").collect())
    assert abs(taken - goal["a"]) <= 5 and taken % 10 == 0


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_report(none).count() == 0 and mixing.mix_documents(none).count() == 0
    silent = spark.createDataFrame([(1, None, "a"), (2, " ", None)], none.schema)
    assert [(r.size, r.target, r.taken) for r in mixing.mix_report(silent).collect()] == [(0, 0.0, 0)] * 2
