"""Substring dedup against a dictionary of all windows."""

import hashlib
import random
import re

import pytest

from tidemark.llm import substring


def brute(rows, length):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, split):
        if i is not None:
            for k in range(len(w) - length + 1):
                key = tuple(w[k : k + length])
                first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, split):
        gone = set()
        for k in range(len(w) - length + 1):
            if i is not None and first[tuple(w[k : k + length])] < i:
                gone |= set(range(k, k + length))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((-1 if i is None else i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = lambda n, pool=400: " ".join(f"w{rng.randrange(pool)}" for _ in range(n))
    passage = [words(n) for n in (9, 12, 15, 40)]
    rows = []
    for i in range(60):
        parts = [words(rng.randrange(1, 20)) for _ in range(3)]
        for p in rng.sample(passage, 2):
            parts.insert(rng.randrange(len(parts) + 1), p)
        rows.append((i, "\n ".join(parts)))
    base = words(80).split()
    for i in range(60, 100):  # near copies
        w = list(base)
        w[rng.randrange(80)] = f"e{i}"
        rows.append((i, " ".join(w)))
    rows += [(i, "and " * 30) for i in range(100, 104)] + [(104, "and " * 50)]
    rows += [(3, rows[7][1]), (3, rows[3][1]), (3, rows[3][1]), (None, rows[5][1]), (None, None), (200, ""), (201, None), (202, " \n\t ")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard", [2, 256])
def test_against_all_windows(spark, shard):
    rows = corpus(shard)
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, anchor int, x string").repartition(4)
    got = substring.dedup_substrings(df, length=10, run=4, shard=shard)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == brute(rows, 10)


def test_text_keeps_the_columns(spark):
    rows = corpus(5)
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, _x string")
    got = substring.dedup_substrings(df, length=10, run=4, with_text=True)
    assert got.columns == df.columns
    split = lambda t: " ".join(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    shas = sorted((-1 if r.doc_id is None else r.doc_id, hashlib.sha256(split(r.text).encode()).hexdigest()) for r in got.collect())
    assert shas == sorted((r[0], r[3]) for r in brute(rows, 10))


def test_empty_table(spark):
    assert substring.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_automaton_finds_longest_matches():
    rng = random.Random(3)
    for _ in range(50):
        machine, seen = substring.SuffixAutomaton(), []
        for _ in range(3):
            s = [rng.randrange(3) for _ in range(rng.randrange(0, 12))]
            machine.add(s)
            seen.append(s)
        q = [rng.randrange(4) for _ in range(20)]
        parts = {tuple(s[a:b]) for s in seen for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
        want = [max((k for k in range(1, i + 2) if tuple(q[i + 1 - k : i + 1]) in parts), default=0) for i in range(len(q))]
        assert machine.matches(q) == want


def test_built_words_that_collide_modulo_a_power_of_two(spark):
    """Two documents of 60 words that differ in ten copy no window of each other."""
    bits = [bin(k).count("1") & 1 for k in range(1 << 11)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    plain = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(one if k % 6 == 0 else w for k, w in enumerate(plain))), (2, " ".join(two if k % 6 == 0 else w for k, w in enumerate(plain)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.dedup_substrings(docs).collect()} == {1: 0, 2: 0}


def test_a_text_above_a_slice(spark):
    rng = random.Random(8)
    long = " ".join(f"word{rng.randrange(10**6)}" for _ in range(150_000))  # 1.6 MB: a slice of its own
    rows = [(1, "x " + long[:2000]), (2, long), (3, None)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_removed int")
    got = sorted(tuple(r) for r in substring.dedup_substrings(docs).collect())
    assert got == brute(rows, 50) and got[1][2] > 0
