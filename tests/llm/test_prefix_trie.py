"""Prefix tries against dictionaries of prefixes."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tidemark.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, depth int, path string"


def key(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, key(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    convs = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        convs[c] = tuple(own.get(c - c % 20, [])[:h] + ts[h:])
    members, below = defaultdict(set), defaultdict(set)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].add(c)
            for e in range(d):
                below[ts[:e]].add(ts[:d])
    out = []
    for p, m in members.items():
        tree = below[p] | {p}
        ends = ",".join(map(str, sorted(c for c in m if convs[c] == p)))
        words = lambda q: len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) if q else 0
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len([q for q in below[p] if len(q) == len(p) + 1]),
                    len([q for q in tree if not below[q]]), sum((len(members[q]) - 1) * words(q) for q in tree), hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def turns(seed, convs=160):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(400), convs):
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, t, rng.choice(["u", "a"]), "say " * rng.randrange(4) + rng.choice("xyz")))
    rows += [(c, 0, "u", "the same") for c in range(1000, 1120)]  # many copies
    rows += [(c, t, "u", "long") for c in (2000, 2001, 2005) for t in range(120)]  # deep
    rows += [(None, 0, "u", "nobody's"), (7, None, None, None), (8, 3, "ab", "c"), (8, 3, "a", "bc"), (8, 3, "a", "bc"), (9, 0, "u", "é " * 3000)]
    return rows


@pytest.mark.parametrize("segment_turns", [1, 7, 60, 100_000])
def test_against_dictionaries(spark, segment_turns):
    rows = turns(segment_turns)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    got = P.prefix_trie(df, segment_turns=segment_turns).collect()
    assert Counter(tuple(r) for r in got) == brute(rows)


def test_empty_and_turnless(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert P.prefix_trie(none).count() == 0
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "u", "gone")]
    got = [tuple(r) for r in P.prefix_trie(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)).collect()]
    assert got == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_ternary_tree_is_ordered_and_shallow():
    seqs = sorted({tuple(random.Random(i).choices(range(50), k=i % 5)) for i in range(400)})
    tree = P.TernaryTree()
    for k in P.medians(len(seqs)):
        tree.insert(list(seqs[k]))
    paths = []
    for node in tree.preorder():
        p = []
        while node:
            p.append(tree.turn[node])
            node = tree.parent[node]
        paths.append(tuple(reversed(p)))
    assert paths == sorted({s[:d] for s in seqs for d in range(len(s) + 1)})
    assert sorted(P.medians(13)) == list(range(13)) and next(P.medians(13)) == 6
