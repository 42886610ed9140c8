"""Line dedup against a loop over lines."""

import hashlib
import random
import string
from collections import Counter, defaultdict

from tidemark.llm import line_dedup as L

GAPS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, min_chars=10, min_docs=2):
    order = lambda i: (i is None, i or 0)
    owner = defaultdict(set)
    keys = lambda t: [x.strip(GAPS).translate(LOWER) for x in (t or "").split("\n")]
    for i, t in rows:
        for k in keys(t):
            owner[k].add(order(i))
    out = []
    for i, t in rows:
        gone = [len(k) >= min_chars and len(owner[k]) >= min_docs and min(owner[k]) != order(i) for k in keys(t)]
        kept = "\n".join(x for x, g in zip((t or "").split("\n"), gone) if not g)
        out.append((i, len(gone), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def corpus():
    rng = random.Random(3)
    pool = [f"line {k} of all the lines" for k in range(60)] + ["short", "exactly 10", "ÄÖÜäöüÄÖÜß", "Äöüäöüäöüß", "日本語日本語日本語日"]
    dress = lambda x: rng.choice(["", " ", "\t\r", "\x0b"]) + rng.choice([x, x.upper(), x.title()]) + rng.choice(["", "  ", "\r", "\x85", " "])
    rows = [(i, "\n".join(dress(rng.choice(pool)) for _ in range(rng.randrange(0, 9)))) for i in range(150)]
    rows += [(500 + i, "a very common line\nown line number %d" % i) for i in range(300)] + [(900, "a very common line\n" * 40), (901, "x" * 3_000_000 + "\na very common line")]
    rows += [(5, None), (6, ""), (None, "no id has this line"), (None, "no id has this line"), (None, "a very common line"), (7, "\n\n\n"), (8, "twice the same row"), (8, "twice the same row"), (8, "other text\ntwice the same row")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(9, i, t, "x") for i, t in rows], "n_lines int, doc_id long, text string, lost string").repartition(4)


def test_report(spark, monkeypatch):
    rows = corpus()
    for hot in (1024, 4):  # 4 sends the common line through the other join
        monkeypatch.setattr(L, "HOT", hot)
        assert Counter(tuple(r) for r in L.line_report(frame(spark, rows)).collect()) == brute(rows)
    assert Counter(tuple(r) for r in L.line_report(frame(spark, rows), 3, 5).collect()) == brute(rows, 3, 5)


def test_documents(spark):
    docs = frame(spark, [(2, "first of all lines\nkeep"), (1, "First of all lines "), (3, None)])
    out = L.drop_repeated_lines(docs)
    assert out.columns == [*docs.columns, "n_lines_", "n_dropped"]
    assert {r.doc_id: (r.n_lines, r.text, r.n_lines_, r.n_dropped) for r in out.collect()} == {
        1: (9, "First of all lines ", 1, 0), 2: (9, "keep", 2, 1), 3: (9, None, 1, 0)}
    assert L.line_report(docs.limit(0)).count() == 0
