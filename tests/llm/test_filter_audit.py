"""Filter audits against running every order over every document."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import filter_audit as A


def failing(docs):
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t, _ in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": t in least and (i is None or least[t] < i)}
        out.append({k for k, v in fails.items() if v})
    return out


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    fails = failing(docs)
    out = []
    for part in {p or "" for *_, p in docs}:
        own = [(i, f) for (i, _, p), f in zip(docs, fails) if (p or "") == part]
        rows, total = [], Counter()
        for order in permutations("ABCDE"):
            alive = own
            for step, k in enumerate(order, 1):
                gone = [i for i, f in alive if k in f]
                alive = [(i, f) for i, f in alive if k not in f]
                every = sum(k in f for _, f in own)
                total[k] += len(gone)
                rows.append((k, (part, "".join(order), step, len(alive), len(gone), every - len(gone), sum(f == {k} for _, f in own),
                                 sum(i in good for i in gone), sum(i in toxic for i in gone))))
        out += [(*r, total[k]) for k, r in rows]
    return Counter(out)


def corpus():
    rng = random.Random(5)
    docs = []
    for i in range(120):
        words = [rng.choice(["a", "bc", "Def", "GHI", "j" + str(rng.randrange(400))]) for _ in range(rng.choice([0, 3, 99, 100, 101, 200]))]
        docs.append((i, " ".join(words) + rng.choice(["", "", "#", "|"]), rng.choice(["en", "de", None, ""])))
    docs += [(200 + i, docs[rng.randrange(20)][1], "en") for i in range(60)]
    docs += [(300, None, "fr"), (301, "", "en"), (None, "", "en"), (None, "only null ids", "xx"), (None, "only null ids", "xx"), (302, "row twice", "de"), (302, "row twice", "de"), (1, docs[0][1], "it"), (303, "w   é " * 40000, "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 300, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (302, 1, 1)]
    return docs, labels


def test_against_running_every_order(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, lang string, n int, mask int").repartition(3)
    m = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = A.audit(d, m).collect()
    assert Counter(tuple(r) for r in got) == brute(docs, labels)
    assert A.audit(d.limit(0), m).count() == 0
    assert {r.good_lost for r in A.audit(d, m.limit(0)).collect()} == {0}
    own = A.audit(d, m, {"Z": F.col("text").like("%#%")}).collect()
    assert {r.filter_order for r in own} == {"EZ", "ZE"}
    with pytest.raises(ValueError):
        A.audit(d, m, {"E": F.lit(True)})


def test_walk_is_a_gray_code_over_all_subsets():
    rng = np.random.default_rng(1)
    masks = np.arange(32)
    weights = rng.integers(0, 9, (32, 3))
    states = A.walk(masks, weights, 5)
    for s in range(32):
        assert (states[s] == weights[(masks & s) == 0].sum(axis=0)).all()
