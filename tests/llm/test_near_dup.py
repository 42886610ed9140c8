"""Near duplicates against all pairs."""

import math
import random
import re
from collections import Counter

from tidemark.llm import near_dup
from tidemark.llm.groups import components


def weights(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)] or ([tuple(w)] if w else [])
    return {g: 1 + math.log(c) for g, c in Counter(grams).items()}


def jaccard(x, y):
    both = set(x) | set(y)
    return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in both) for d in set(x) & set(y))


def corpus():
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts = []
    for size in (60, 120):
        base = words(size)
        for _ in range(40):  # from near to less near
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    shared = words(30)
    texts += [" ".join(words(30) + shared + words(30)) for _ in range(30)]
    texts += [texts[0]] * 5 + [texts[0].replace(" ", "\n ")] + ["a b c", "a b c", "a b", "x " * 300, "x " * 310]
    rows = list(enumerate(texts, start=10))
    rows += [(10, texts[0]), (10, texts[0]), (11, texts[90]), (None, texts[1]), (None, None), (900, None), (901, ""), (902, " \n"), (903, "")]
    rng.shuffle(rows)
    return rows


def expected(rows):
    known = {t: weights(t) for _, t in rows}
    distinct = [t for t in known if known[t]]
    root = {t: t for t in distinct}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if jaccard(known[a], known[b]) >= 0.8:
                root[find(a)] = find(b)
    groups = {}
    for i, t in rows:
        if known[t]:
            groups.setdefault(find(t), []).append(i)
    ids = {r: min((i for i in g if i is not None), default=None) for r, g in groups.items()}
    return Counter((i, ids[find(t)], len(groups[find(t)])) if known[t] else (i, i, 1) for i, t in rows)


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id long, text string, k int, root string").repartition(4)


def test_classes_are_those_of_all_pairs(spark):
    rows = corpus()
    got = near_dup.near_classes(table(spark, rows)).collect()
    assert Counter((r.doc_id, r.class_id, r.class_rows) for r in got) == expected(rows)


def test_one_document_of_each_class_stays(spark):
    rows = corpus()
    docs = table(spark, rows)
    got = near_dup.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    kept = Counter(r.doc_id for r in got.collect())
    want = expected(rows)
    no_words = Counter(i for i, t in rows if not weights(t))
    assert kept[None] == sum(i is None for i, _ in rows)
    ids = {c for (i, c, n) in want if c is not None}
    assert {i for i in kept if i is not None} == ids
    assert all(kept[i] == max(1, no_words[i]) for i in kept if i not in (None, 11))


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 7), (3, 2), (2, 3), (559, 700)]
    rng.shuffle(links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 500 for i in [*range(500, 560), 700]} | {2: 2, 3: 2}
    assert got == want


def test_empty_table(spark):
    assert near_dup.near_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimate_rarely_discards_a_pair_at_the_limit():
    n, p = near_dup.BANDS * near_dup.ROWS, near_dup.SIMILARITY
    lost = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1) if i / n < p - near_dup.MARGIN - 1e-9)
    assert lost < 1e-5


def test_built_words_that_collide_modulo_a_power_of_two(spark):
    bits = [bin(k).count("1") & 1 for k in range(1 << 11)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    plain = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(x if k % 6 == 0 else w for k, w in enumerate(plain))) for i, x in ((1, one), (2, two), (3, one))]
    got = near_dup.near_classes(table(spark, rows))
    assert {r.doc_id: r.class_id for r in got.collect()} == {1: 1, 2: 2, 3: 1}
