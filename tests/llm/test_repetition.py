"""Repetition rules against loops over words."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tidemark.llm import repetition, text

WORD = r"[^\x20\x09-\x0D]+"


def brute(text, limits=repetition.Limits()):
    text = text or ""
    w = re.findall(WORD, text)
    chars = sum(map(len, w))
    grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    again = {j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
    seen, dup, inside = set(), 0, 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            if line in seen:
                dup += 1
                inside += sum(map(len, re.findall(WORD, line)))
            seen.add(line)
    row = [len(w), chars, sum(text.count(c) for c in repetition.SYMBOLS), dup, len(again), inside]
    bad = 100 * inside > limits.lines * chars
    for n, share in limits.grams.items():
        known, cover = set(), set()
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            if g in known:
                cover |= set(range(k, k + n))
            known.add(g)
        row.append(sum(len(w[k]) for k in cover))
        bad |= 100 * row[-1] > share * chars
    failed = len(w) < limits.min_words or 100 * len(again) > limits.repeat_words * len(w)
    return (*row, failed, not failed and not bad)


def texts():
    rng = random.Random(2)
    word = lambda: rng.choice(["a", "bb", "ccc", "dé", "日本", "#x", "<|>", "e%$"]) + str(rng.randrange(60))
    out = [None, "", " \n\t\x0b\x0c\r", "one", "\n\n\n", "a\na\n a\na ", "x y z " * 200, "and\u00a0and \x1c \x85 b", "é" * 30000, "\n".join(["same line here"] * 30)]
    for _ in range(60):
        lines = [" ".join(word() for _ in range(rng.randrange(0, 14))) for _ in range(rng.randrange(1, 30))]
        lines += rng.choices(lines, k=rng.randrange(0, 12))
        rng.shuffle(lines)
        out.append(rng.choice(["\n", "\r\n", " \n"]).join(lines))
    return out


def test_against_loops(spark):
    rows = list(enumerate(texts())) + [(None, "one two"), (3, "one"), (3, "one")]
    df = spark.createDataFrame([(i, t, True, 1) for i, t in rows], "doc_id long, text string, kept boolean, n_words int").repartition(3)
    got = Counter(tuple(r) for r in repetition.repetition_rules(df).collect())
    assert got == Counter((i, *brute(t)) for i, t in rows)
    assert repetition.repetition_rules(df.limit(0)).count() == 0


def thue_morse(n, a, b):
    """Two texts that every polynomial modulo 2**64 at an odd place takes for one."""
    bits = [bin(k).count("1") & 1 for k in range(n)]
    return [b if x else a for x in bits], [a if x else b for x in bits]


def test_spans_that_collide_modulo_a_power_of_two():
    one, two = ("".join(x) for x in thue_morse(1 << 12, "a", "b"))
    raw = np.frombuffer((one + two + one).encode(), np.uint8)
    at = np.arange(3) << 12
    h = text.span_hash(text._BYTE[raw], at, at + (1 << 12))
    assert h[0] == h[2] != h[1]
    docs = [f"{one}\n{two}", " ".join([one, "x", "y", two, "x", "y"])]
    for d in docs:
        got = repetition.measure(pa.array([d]), repetition.Limits())
        assert got["n_dup_lines"][0] == 0 and got["n_repeat_words"][0] == brute(d)[4]


def test_span_hash_is_the_polynomial():
    rng = random.Random(4)
    step, prime = text._STEP, text.PRIME
    for top in (256, prime - 1):
        values = np.array([rng.randrange(1, top + 1) for _ in range(500)], np.uint64)
        spans = sorted((rng.randrange(500), rng.randrange(500)) for _ in range(50))
        start, end = np.array([min(s) for s in spans]), np.array([max(s) for s in spans])
        want = [sum(int(v) * pow(step, k, prime) for k, v in enumerate(values[a:b])) % prime ^ ((b - a) % 8 << 61) for a, b in zip(start.tolist(), end.tolist())]
        assert (text.span_hash(values, start, end) == text.mix(np.array(want, np.uint64))).all()
